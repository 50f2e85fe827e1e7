"""Rule categorisation: a deterministic cascade, then keyword, pattern and hint scores.

The cascade is a table of rules; the first that holds wins, and all of it is one CASE expression.
Scores of the fall-back are sums per category inside the row, so no rule ever needs a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermint.functions.lineage import compiled_by_parts
from ledgermint.functions.predicates import Between, Equals, Finds, Has, Is, Predicate, WordIndex, indexed, searched, with_index

HIGH, MEDIUM, CAP = 0.95, 0.90, 0.98

# The words and patterns of the cascade. Text is matched in lower or upper case as named.
REFUND = ("REFUND", "REVERSAL", "CHARGEBACK", "RETURN MERCHANDISE", "MERCHANDISE RETURN")
TRANSFER = ("IMPS", "UPI", "NEFT", "RTGS")
SHOPS = [
    (r"\bpan\s+shop\b", "food_dining", "Fast Food"), (r"\b(tea|chai)\s+(stall|shop|stall|corner)\b", "food_dining", "Cafes & Coffee"),
    (r"\b(badnaam|badnam)\s+(chai|chay|tea)\b", "food_dining", "Cafes & Coffee"), (r"\b(omlet|omelette|egg)\s+shop\b", "food_dining", "Fast Food"),
    (r"\bjalpaan\s+(ghrah|ghar|shop)\b", "food_dining", "Restaurants"), (r"\bkirana\s+(store|shop)\b", "groceries", "Local Stores"),
    (r"\b(mega|super)\s+mart\b", "groceries", "Supermarkets"), (r"\b(sangam|mega|super).*mart\b", "groceries", "Supermarkets"),
    (r"\bwhole\s*foods\b", "groceries", "Supermarkets"), (r"\btrader\s*joe['s]*\b", "groceries", "Supermarkets"),
    (r"\bcement\s+(supplier|suppliers|shop)\b", "home_improvement", "Home Repairs"), (r"\bhardware\s+(store|shop)\b", "home_improvement", "Home Repairs"),
]
FULL_NAMES = (r"\b(om|ram|shyam|rajesh|suresh|mukesh|mahesh|dinesh|naresh|nilesh)\s+(yadav|kumar|singh|sharma|verma|gupta|agarwal|ji)\b", r"\b(officer|shri|smt|mr|mrs|ms)\s+\w+\b")
FIRST_NAMES = (
    r"\b(vikas|rahul|aman|amit|ajay|anil|arun|akshay|akhilesh|ankit|ashok|bharat|chetan|deepak|dev|gaurav|gopal|harsh|jatin|karan|kunal|lalit|manoj|manish|mohit|neeraj|nikhil|pankaj|prashant|prateek|praveen|ravi|rohan|sachin|sanjay|sandeep|shivam|sumit|tarun|varun|vijay|vinay|vineet|vishal|yogesh)\b",
    r"\b(neetu|priya|pooja|ritu|sonia|anita|asha|deepa|geeta|kavita|meera|nisha|rekha|seema|suman|sunita|usha|veena)\b",
)
NAME_NOT_BEFORE = r"\s+(?:shop|store|mart|stall)"
#: Words of which each text that the patterns of full and of first names match has one.
FULL_NAME_WORDS = tuple(w for p in FULL_NAMES for w in p[3 : p.index(")")].split("|"))
FIRST_NAME_WORDS = tuple(w for p in FIRST_NAMES for w in p[3 : p.index(")")].split("|"))
UPI_CONTEXT = ("PAID TO", "UPI/", "@", "UPI-")
BANK_FEES = (r"micro\s+atm\s+(wdl|gst|fee|charge)", r"micro\s+atm.*(fee|gst|tax)", r"atm\s+(wdl|withdrawal)\s+(fee|charge|gst)", r"debit\s+card\s+(fee|charge|amc)", r"sms\s+alert\s+(fee|charge)", r"min\s+bal\s+(charge|fee)", r"imbs\s+fee", r"neft\s+fee", r"rtgs\s+fee")
ATM_FEES, ATM_WORDS = ("FEE", "GST", "TAX", "CHARGE"), ("ATM CASH", "ATM WDL", "ATM WITHDRAWAL", "CASH WITHDRAWAL")
MORTGAGE = ("MORTGAGE", "HOME LOAN", "HOUSING LOAN")
RENT = ("RENT PAYMENT", "TO LANDLORD", "RENT TO")
BUILDINGS, UPKEEP = ("SOCIETY", "APARTMENT", "BUILDING", "HOA"), ("HOA PAYMENT", "MAINTENANCE CHARGE", "MAINTENANCE FEE")
LOANS = ("EMI ", " EMI", " LOAN ", "LOAN REPAYMENT", "EMI-")
TELECOM = ("verizon", "t-mobile", "tmobile", "at&t", "att", "sprint", "xfinity", "comcast", "spectrum", "cox", "frontier", "vodafone", "airtel", "jio", "bsnl", "idea", "electric", "electricity", "power bill", "water bill", "gas bill", "internet bill", "broadband bill", "cable bill", "phone bill")
PHONE = ("verizon", "t-mobile", "tmobile", "at&t", "att", "vodafone", "airtel", "jio", "phone")
SALARY = ("SALARY", "SAL CREDIT", "PAYROLL")
CHARITY = ("temple", "church", "mosque", "gurudwara", "synagogue", "mandir", "donation", "charity", "ngo", "red cross", "unicef", "oxfam", "crowdfunding", "gofundme", "ketto", "milaap", "give india", "donate", "zakat", "sadaqah", "tithe")
RELIGIOUS = ("temple", "church", "mosque", "gurudwara", "mandir")
PROPERTY_TAX = ("PROPERTY TAX", "HOUSE TAX", "MUNICIPAL TAX")
GST, NOT_GST = (r"\bgst\b", r"\b(igst|cgst|sgst)\b"), ("micro atm", "wdl", "withdrawal", "bank charge", "service charge")
TAXES = ("income tax", "tax payment", "irs", "advance tax", "self assessment tax", "tds payment", "challan", "government fee", "license fee", "passport fee", "visa fee")
INSURERS = ("lic", "hdfc life", "icici prudential", "sbi life", "max life", "bajaj allianz", "star health", "care health", "niva bupa", "progressive", "state farm", "allstate", "geico", "birla sun life", "aditya birla")
INSURANCE = ("insurance premium", "car insurance", "health insurance", "life insurance", "term insurance", "vehicle insurance")
PHARMACY = ("cvs", "walgreens", "rite aid", "rite-aid", "walmart pharmacy", "target pharmacy", "kroger pharmacy", "apollo pharmacy", "medplus", "pharmeasy", "netmeds", "1mg")
HOSPITAL = ("hospital", "clinic", "medical center", "health center", "urgent care", "doctor", "physician", "dentist", "dental", "orthodontist", "fortis", "max healthcare", "apollo hospitals", "columbia asia", "narayana health", "aster")
FUEL = ("hpcl", "iocl", "bpcl", "indian oil", "bharat petroleum", "hindustan petroleum", "shell", "reliance petrol", "essar", "gas station", "petrol pump")
CHARGING = ("supercharger", "tesla charging", "electric charging", "ev charging", "charging station")
FEES, NOT_FEES = (r"\bfee\b", r"\bcharge\b", r"\bpenalty\b", r"service charge", r"bank charge", r"service fee"), ("starbucks", "coffee", "cafe", "restaurant", "food", "grocery", "store")
STREAMING = ("apple.com", "netflix", "spotify", "google.com/bill", "microsoft.com", "adobe.com", "amazon prime", "disney", "hotstar", "youtube premium", "apple music", "apple tv", "hulu", "hbo max", "paramount+", "peacock")
FRAUD = ("unauthorized", "fraud alert", "suspicious activity", "disputed charge", "chargeback")
HOME = ("home depot", "lowes", "ace hardware", "menards", "true value", "benjamin moore", "sherwin williams", "floor & decor", "lumber liquidators", "harbor freight", "tractor supply", "hardware", "plumber", "electrician", "carpenter", "contractor", "renovation", "repair service", "handyman", "paint store", "lumber", "flooring", "roofing", "hvac", "appliance repair")
PETS = ("petsmart", "petco", "chewy", "pet supplies", "vca", "banfield", "bluepearl", "veterinary", "vet clinic", "pet hospital", "dog food", "cat food", "pet food", "pet grooming", "dog grooming", "cat grooming", "pet boarding", "doggy daycare", "pet sitting", "dog walking", "purina", "royal canin", "blue buffalo", "hills science diet")
KIDS = ("firstcry", "hopscotch", "mothercare", "babyoye", "hamleys", "toys r us", "childrens place", "carters", "oshkosh", "gymboree", "gap kids", "buy buy baby", "pottery barn kids", "daycare", "preschool", "kindergarten", "nursery", "kids activities", "baby clothes", "diapers", "baby formula", "pampers", "huggies", "baby food", "kids clothing", "toys", "kids education", "playschool", "kids camp", "kids lessons")
ELECTRONICS = ("best buy", "apple store", "microsoft store", "b&h photo", "micro center", "newegg", "crutchfield", "gamestop", "dell", "hp store", "lenovo", "asus", "sony store", "samsung store", "reliance digital", "croma", "vijay sales", "sangeetha mobiles", "poorvika", "laptop", "computer", "smartphone", "iphone", "ipad", "macbook", "tablet", "monitor", "keyboard", "headphones", "camera", "electronics repair", "tech support", "geek squad", "screen replacement")
SUBSCRIPTIONS = (
    "hulu", "hbo max", "paramount+", "peacock", "discovery+", "youtube tv", "sling tv", "fubo tv", "tidal", "pandora", "soundcloud", "icloud storage", "google one", "dropbox", "onedrive", "pcloud", "office 365", "microsoft 365", "grammarly", "canva pro", "notion",
    "evernote", "lastpass", "1password", "nordvpn", "expressvpn", "surfshark", "medium membership", "patreon", "github pro", "slack premium", "zoom pro", "asana", "trello", "kindle unlimited", "audible", "scribd", "blinkist", "peloton", "apple fitness", "beachbody",
    "fitbit premium", "strava", "playstation plus", "playstationplus", "xbox game pass", "nintendo online", "ea play", "coursera", "udemy", "linkedin learning", "skillshare", "masterclass", "duolingo", "babbel", "rosetta stone", "costco membership", "sams club",
    "aaa membership", "24 hour fitness", "planet fitness", "la fitness", "equinox", "classpass", "headspace", "calm", "betterhelp",
)
PHRASES = ("monthly subscription", "annual subscription", "premium subscription", "premium monthly", "premium annual", "pro plan", "recurring payment", "membership fee", "subscription fee")
SUBSCRIPTION_PHRASES = tuple(rf"\b{p}\b" for p in PHRASES)
AUTOMOTIVE = ("auto parts", "spare parts", "car repair", "bike repair", "vehicle service", "oil change", "tire change", "wheel alignment", "car wash", "service station")


#: Words of which each text that those patterns match has one.
SHOP_WORDS = ("shop", "stall", "corner", "chai", "chay", "tea", "jalpaan", "kirana", "mart", "foods", "trader", "cement", "hardware")
BANK_FEE_WORDS, FEE_WORDS = ("micro", "atm", "card", "alert", "bal", "fee"), ("fee", "charge", "penalty")


@dataclass(frozen=True)
class Rule:
    """When `when` holds: a category, its subcategory (the first choice that holds, else the default), a confidence."""

    name: str
    category: str
    subcategory: str
    confidence: float
    when: Predicate
    choices: tuple[tuple[Predicate, str], ...] = ()
    explains: str = ""


def _low(*words: str) -> Has:
    return Has("lower", words)


def _up(*words: str) -> Has:
    return Has("upper", words)


_VI = Finds("lower", (r"\bvi\b",), needs=("vi",))
_GST = Finds("lower", GST, needs=("gst",))
CASCADE: list[Rule] = [
    Rule("transfer_refund", "transfers_upi", "Refund", HIGH, _up(*REFUND) & _up(*TRANSFER), explains="refund_keyword+transfer_channel"),
    Rule("refund", "income_salary", "Refunds", HIGH, _up(*REFUND), explains="refund_keyword"),
    *[Rule(f"shop_{i}", c, s, MEDIUM, Finds("lower", (p,), needs=SHOP_WORDS), explains="local_shop_pattern") for i, (p, c, s) in enumerate(SHOPS)],
    Rule("person_name_upi", "transfers_upi", "Peer to Peer", MEDIUM, (Finds("lower", FULL_NAMES, needs=FULL_NAME_WORDS) | Finds("lower", FIRST_NAMES, NAME_NOT_BEFORE, FIRST_NAME_WORDS)) & _up(*UPI_CONTEXT), explains="person_name_pattern+upi_context"),
    Rule("bank_fee", "fees_charges", "Bank Fees", HIGH, Finds("lower", BANK_FEES, needs=BANK_FEE_WORDS), explains="bank_fee_pattern"),
    Rule("atm", "atm_cash", "Cash Withdrawal", HIGH, ~_up(*ATM_FEES) & (Is("channel", ("ATM",)) | _up(*ATM_WORDS)), explains="atm_channel_or_keyword"),
    Rule("mortgage", "rent", "Mortgage/Home Loan", HIGH, _up(*MORTGAGE), explains="mortgage_keyword"),
    Rule("rent", "rent", "rent", HIGH, _up(*RENT), explains="rent_keyword"),
    Rule("maintenance", "rent", "HOA/Maintenance", MEDIUM, (_up("MAINTENANCE") & _up(*BUILDINGS)) | _up(*UPKEEP), explains="maintenance_keyword"),
    Rule("emi", "bills", "Loan EMI", HIGH, _up(*LOANS), explains="emi_or_loan_keyword"),
    Rule("utilities", "bills", "Utilities", HIGH, _low(*TELECOM) | _VI, ((_VI | _low(*PHONE), "Phone/Internet"),), "utility_telecom_keyword"),
    Rule("salary", "income_salary", "Salary", HIGH, _up(*SALARY), explains="salary_keyword"),
    Rule("charity", "charity_donations", "Charitable Donation", HIGH, _low(*CHARITY), ((_low(*RELIGIOUS), "Religious Donation"),), "charity_donation_keyword"),
    Rule("property_tax", "taxes_government", "Property Tax", HIGH, _up(*PROPERTY_TAX), explains="property_tax_keyword"),
    Rule("tax", "taxes_government", "Government Fees", HIGH, (_GST & ~_low(*NOT_GST)) | _low(*TAXES), ((_GST, "GST"), (_low("income tax", "irs"), "Income Tax")), "tax_government_keyword"),
    Rule("insurance", "insurance", "Insurance", HIGH, (_low(*INSURERS) & _low("insurance")) | _low(*INSURANCE), ((_low("life"), "Life Insurance"), (_low("health"), "Health Insurance"), (_low("car", "bike", "motor", "vehicle"), "Vehicle Insurance")), "insurance_keyword"),
    Rule("health", "health", "Doctor/Hospital", HIGH, _low(*PHARMACY) | _low(*HOSPITAL), ((_low(*PHARMACY), "Pharmacy"),), "health_medical_keyword"),
    Rule("fuel", "fuel", "Petrol/Diesel", HIGH, _low(*FUEL) | _low(*CHARGING), ((_low(*CHARGING), "Electric Charging"),), "fuel_brand_keyword"),
    Rule("fee", "fees_charges", "Bank Fees", MEDIUM, Between("amount", high=500) & ~Equals("amount", 0) & Finds("lower", FEES, needs=FEE_WORDS) & ~_low(*NOT_FEES), explains="fee_keyword_small_amount"),
    Rule("streaming", "subscriptions_memberships", "Streaming/Software", HIGH, _low(*STREAMING), explains="subscription_merchant"),
    Rule("fraud", "fraud_security", "Suspicious International", HIGH, _low(*FRAUD), explains="fraud_keyword"),
    Rule("home_improvement", "home_improvement", "Hardware/Repairs", MEDIUM, _low(*HOME), explains="home_improvement_keyword"),
    Rule("pets", "pets", "Pet Care", MEDIUM, _low(*PETS), explains="pets_keyword"),
    Rule("kids_family", "kids_family", "Kids Products/Services", MEDIUM, _low(*KIDS), explains="kids_family_keyword"),
    Rule("electronics", "electronics_technology", "Electronics/Computers", MEDIUM, _low(*ELECTRONICS), explains="electronics_keyword"),
    Rule("subscription", "subscriptions_memberships", "Subscription Service", MEDIUM, _low(*SUBSCRIPTIONS) | Finds("lower", SUBSCRIPTION_PHRASES, needs=PHRASES), explains="subscription_membership_keyword"),
    Rule("automotive", "automotive", "Vehicle Maintenance", MEDIUM, _low(*AUTOMOTIVE), ((_low("repair"), "Auto Repairs"),), "automotive_keyword"),
]

#: Date hints as (days of the month, least amount, words, category, boost, tag), the first that holds.
TEMPORAL = [
    (((1, 5),), 10000, ("salary", "credit", "income", "payroll", "sal"), "income_salary", 0.10, "temporal_salary_pattern"),
    (((1, 5), (25, 31)), 5000, ("rent", "lease", "landlord", "housing"), "rent", 0.10, "temporal_rent_pattern"),
    (((1, 10),), 1000, ("emi", "loan", "repayment", "installment"), "bills", 0.08, "temporal_emi_pattern"),
    (((1, 31),), None, ("subscription", "recurring", "monthly", "netflix", "spotify", "prime"), "bills", 0.08, "temporal_subscription_pattern"),
    (((10, 20), (25, 31)), None, ("bill", "electricity", "water", "gas", "internet", "broadband"), "bills", 0.07, "temporal_utility_pattern"),
]
#: Channel and amount hints as (predicate, category, score), of which the first of a group counts.
HINTS: list[list[tuple[Predicate, str, float]]] = [
    [(Is("channel", ("ATM",)), "atm_cash", 0.8), (Is("channel", ("UPI", "IMPS", "NEFT", "RTGS")) & _low("to", "from", "transfer"), "transfers_upi", 0.6), (Is("channel", ("POS",)) & _low("hpcl", "iocl", "bpcl", "fuel", "petrol"), "fuel", 0.7)],
    [(Between("amount", 10000) & _low("rent", "lease", "emi", "loan"), "rent", 0.5), (Between("amount", 10000) & _low("invest", "mutual fund", "sip"), "investments", 0.5), (Between("amount", high=100) & _low("recharge", "mobile", "dth"), "bills", 0.4)],
]


@dataclass(frozen=True)
class Category:
    """One category of a taxonomy, in its order."""

    id: str
    name: str = ""
    keywords: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    subcategories: tuple[str, ...] = ()
    mcc_codes: tuple[str, ...] = field(default=())


def fields_of(text: Column, channel: Column, amount: Column) -> dict[str, Column]:
    """The fields that the rules name."""
    t = F.coalesce(text, F.lit(""))
    return {"lower": F.lower(t), "upper": F.upper(t), "channel": channel, "amount": amount}


def cascade(fields: dict[str, Column], rules: list[Rule] = CASCADE) -> Column:
    """struct<rule, category, subcategory, confidence, explanation> of the first rule that holds, else null. For one use; `with_cascade` serves tables."""
    return rule_struct(cascade_number(fields, rules), fields, rules)


_indexes: dict[str, WordIndex] = {}


def word_indexes() -> dict[str, WordIndex]:
    """The indexes of the words of the cascade, its choices and the hints."""
    if not _indexes:
        every = [r.when for r in CASCADE] + [test for r in CASCADE for test, _ in r.choices] + [p for group in HINTS for p, _, _ in group] + [Has("lower", words) for _, _, words, _, _, _ in TEMPORAL]
        _indexes.update({f: indexed(every, f) for f in ("lower", "upper")})
    return _indexes


def with_cascade(df: DataFrame, fields: dict[str, Column], taxonomy: list[Category] = (), merchant: Column | None = None) -> tuple[DataFrame, dict]:
    """`df` with `_rule`, the number of the first rule that holds, `_lists_lower` and `_lists_upper`; and the fields by which more predicates use these.

    With a taxonomy, its keywords are looked for in the same pass, and, given a `merchant`, in this too: `_small_merchant` is
    its name in small letters, `_lists_merchant` the keywords in it (as numbers of `keyword_index`). Small and capital letters are made once, as `_lower` and `_upper`.
    """
    compiled_by_parts(df.sparkSession)
    indexes = word_indexes()
    if taxonomy:
        indexes = indexes | {"lower": WordIndex([*indexes["lower"].lists, *keyword_index(taxonomy).lists])}
    made = {f"_{f}": fields[f] for f in indexes} | ({} if merchant is None else {"_small_merchant": F.lower(merchant)})
    df, fields = with_index(df.withColumns(made), fields | {f: F.col(f"_{f}") for f in indexes}, indexes)
    if merchant is not None:
        df = df.withColumn("_lists_merchant", keyword_index(taxonomy).found(F.col("_small_merchant")))
    return df.withColumn("_rule", cascade_number(fields)), fields


def cascade_number(fields: dict[str, Column], rules: list[Rule] = CASCADE) -> Column:
    """The number, from 1, of the first rule that holds, else null."""
    out = None
    for i, r in enumerate(rules, 1):
        out = F.when(r.when.column(fields), i) if out is None else out.when(r.when.column(fields), i)
    return out


def rule_struct(number: Column, fields: dict[str, Column], rules: list[Rule] = CASCADE) -> Column:
    """What a rule's number stands for."""
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), number)
    sub = pick([r.subcategory for r in rules])
    for i, r in enumerate(rules, 1):
        for test, value in reversed(r.choices):
            sub = F.when((number == i) & test.column(fields), value).otherwise(sub)
    made = F.struct(pick([r.name for r in rules]).alias("rule"), pick([r.category for r in rules]).alias("category"), sub.alias("subcategory"), pick([r.confidence for r in rules]).alias("confidence"), pick([r.explains for r in rules]).alias("explanation"))
    return F.when(number.isNotNull(), made)


def temporal_hint(fields: dict[str, Column], date: Column) -> Column:
    """struct<category, boost, tag> of the first date pattern that holds, else null."""
    day, amount, out = F.dayofmonth(date), fields["amount"], None
    for days, least, words, category, boost, tag in TEMPORAL:
        in_days = reduce(lambda a, b: a | b, [day.between(a, b) for a, b in days])
        test = date.isNotNull() & in_days & _low(*words).column(fields)
        test = test & F.coalesce(amount >= least, F.lit(False)) if least is not None else test
        value = F.struct(F.lit(category).alias("category"), F.lit(boost).alias("boost"), F.lit(tag).alias("tag"))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(F.lit(None).cast("struct<category:string,boost:double,tag:string>"))


def _subcategories(taxonomy: list[Category]) -> Column:
    """Literal map of category to array<struct<name, words>>."""
    return F.create_map(*[x for c in taxonomy for x in (F.lit(c.id), F.array(*[F.struct(F.lit(n).alias("name"), F.array(*[F.lit(w) for w in n.lower().split()]).alias("words")) for n in c.subcategories or ("",)]))])


def subcategory_of(lower: Column, category: Column, taxonomy: list[Category]) -> Column:
    """The first subcategory of the category any of whose words occurs in the text, else its first."""
    listed = F.try_element_at(_subcategories(taxonomy), category)
    named = F.filter(listed, lambda s: F.exists(s["words"], lambda w: lower.contains(w)))
    return F.nullif(F.coalesce(F.get(named, F.lit(0))["name"], F.get(listed, F.lit(0))["name"]), F.lit(""))


def _keywords(taxonomy: list[Category]) -> list[tuple[str, int, str]]:
    """(keyword, place of its category, category) in taxonomy order."""
    return [(k.lower(), i, c.id) for i, c in enumerate(taxonomy) for k in c.keywords]


def keyword_index(taxonomy: list[Category]) -> WordIndex:
    """The index of the keywords, each a list of its own."""
    return WordIndex([(k,) for k, _, _ in _keywords(taxonomy)])


def _keywords_of(numbers: Column, taxonomy: list[Category]) -> Column:
    """The places, in `_keywords`, of the keywords with those numbers in `keyword_index`."""
    lists = keyword_index(taxonomy).lists
    by_list: dict[int, list[int]] = {}
    for at, (k, _, _) in enumerate(_keywords(taxonomy)):
        by_list.setdefault(lists[(k,)], []).append(at)
    places = F.array(*[F.array(*[F.lit(at) for at in by_list[i]]) for i in range(len(lists))])
    return F.flatten(F.transform(numbers, lambda i: F.get(places, i)))


def keywords_in(text: Column, taxonomy: list[Category]) -> Column:
    """The places, in `_keywords`, of the keywords that a lower-case text contains, by one pass over it."""
    return _keywords_of(keyword_index(taxonomy).found(text), taxonomy) if _keywords(taxonomy) else F.array().cast("array<int>")


def _pattern_test(low: Column, pattern: str) -> Column:
    """Whether a pattern is found; one that lists plain words is a search for these."""
    plain = re.fullmatch(r"\(?([a-z0-9 ]+(?:\|[a-z0-9 ]+)*)\)?", pattern)
    if plain is None or pattern.startswith("(") != pattern.endswith(")"):
        return low.rlike(pattern)
    return reduce(lambda a, b: a | b, [low.contains(w) for w in plain[1].split("|")])


def with_hints(df: DataFrame, fields: dict) -> tuple[DataFrame, dict]:
    """`df` with `_hint0`, `_hint1`, the number of the first hint of each group that holds; and the fields by which `scores` uses these."""
    for at, group in enumerate(HINTS):
        df, fields = df.withColumn(f"_hint{at}", _first_hint(fields, group)), fields | {f"hint:{at}": F.col(f"_hint{at}")}
    return df, fields


def _first_hint(fields: dict, group: list[tuple[Predicate, str, float]]) -> Column:
    out = None
    for i, (p, _, _) in enumerate(group):
        out = F.when(p.column(fields), i) if out is None else out.when(p.column(fields), i)
    return out


def scores(fields: dict, taxonomy: list[Category]) -> Column:
    """array<struct<score, order, category>>, one for each category, 0 where it does not score: 1 for each keyword, 1.2 for each pattern, and the hints.

    No lambda stands in it: Spark interprets those, and what is handed to them, row by row.
    """
    last = {c.id: i for i, c in enumerate(taxonomy)}
    hints = [fields.get(f"hint:{at}", _first_hint(fields, group)) for at, group in enumerate(HINTS)]
    out = []
    for i, c in enumerate(taxonomy):
        score = reduce(lambda a, k: a + F.when(_low(k.lower()).column(fields), 1.0).otherwise(0.0), c.keywords, F.lit(0.0))
        for p in c.patterns:
            score = score + (F.lit(1.2) if p == ".*" else F.when(_pattern_test(fields["lower"], searched(p.lower())), 1.2).otherwise(0.0))
        for hint, group in zip(hints, HINTS, strict=True):
            for j, (_, category, points) in enumerate(group):
                if last.get(category) == i:
                    score = score + F.when(hint == j, points).otherwise(0.0)
        out.append(F.struct(F.round(score, 6).alias("score"), F.lit(-i).alias("order"), F.lit(c.id).alias("category")))
    return F.array(*out) if out else F.array().cast("array<struct<score:double,order:int,category:string>>")


def keyword_scores(fields: dict, taxonomy: list[Category]) -> Column:
    """The `scores` of the categories that score."""
    return F.filter(scores(fields, taxonomy), lambda s: s["score"] > 0)


def best_score(df: DataFrame, fields: dict, taxonomy: list[Category], when: Column) -> DataFrame:
    """`df` with `_best`, the highest of the `keyword_scores` of rows for which `when` holds; of equal ones the first category's."""
    df, fields = with_hints(df, fields)
    df = df.withColumn("_most", F.when(when, F.array_max(scores(fields, taxonomy))))
    return df.withColumn("_best", F.when(F.col("_most.score") > 0, F.col("_most"))).drop("_most", *[f"_hint{at}" for at in range(len(HINTS))])


def merchant_rule(numbers: Column, taxonomy: list[Category]) -> Column:
    """struct<keyword, pos, category>: the keyword, first in taxonomy order, that the merchant contains, of those with these numbers in `keyword_index`; else null."""
    listed = F.array(*[F.struct(F.lit(k).alias("keyword"), F.lit(i).alias("pos"), F.lit(c).alias("category")) for k, i, c in _keywords(taxonomy)])
    return F.get(listed, F.array_min(_keywords_of(numbers, taxonomy)))


def categorize_by_rules(df: DataFrame, taxonomy: list[Category], text: str = "search_text", merchant: str = "merchant", channel: str = "channel", amount: str = "amount", date: str = "date", compat: bool = False) -> DataFrame:
    """`df` with `rule_result` (rule, category, subcategory, confidence, explanation): cascade, else merchant keyword, else scores.

    `compat` leaves out the date boost on the merchant branch.
    """
    fields = fields_of(F.col(text), F.col(channel), F.col(amount))
    listed = bool(_keywords(taxonomy))
    work, fields = with_cascade(df, fields, taxonomy, F.col(merchant) if listed else None)
    none = F.lit(None).cast("struct<keyword:string,pos:int,category:string>")
    work = work.withColumn("_merchant", F.when(F.col("_rule").isNull(), merchant_rule(F.col("_lists_merchant"), taxonomy)) if listed else none)
    work = best_score(work, fields, taxonomy, F.col("_rule").isNull() & F.col("_merchant").isNull())
    work = work.withColumn("_day", F.col(date).try_cast("date")).withColumn("_hint", temporal_hint(fields, F.col("_day")))
    m, best, hint = F.col("_merchant"), F.col("_best"), F.col("_hint")
    category = F.coalesce(m["category"], best["category"])
    conf = F.when(m.isNotNull(), HIGH).otherwise(F.least(F.lit(1.0), best["score"] / 3.0))
    raised = F.least(F.lit(CAP), conf + hint["boost"])
    conf = F.when((hint["category"] == category) & (F.lit(not compat) | m.isNull()), raised).otherwise(conf)
    low = F.when(m.isNotNull(), F.col("_small_merchant")).otherwise(fields["lower"]) if listed else fields["lower"]
    soft = F.struct(F.when(m.isNotNull(), "merchant").otherwise("scores").alias("rule"), category.alias("category"), subcategory_of(low, category, taxonomy).alias("subcategory"), F.round(conf, 6).alias("confidence"), F.coalesce(F.concat(F.lit("merchant_keyword="), m["keyword"]), F.concat(F.lit("score="), best["category"])).alias("explanation"))
    return work.withColumn("rule_result", F.when(F.col("_rule").isNotNull(), rule_struct(F.col("_rule"), fields)).when(category.isNotNull(), soft)).drop("_rule", "_merchant", "_best", "_day", "_hint", "_lower", "_upper", "_small_merchant", "_lists_lower", "_lists_upper", "_lists_merchant")
