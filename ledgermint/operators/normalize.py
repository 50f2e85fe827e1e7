"""Normalised transactions: clean text, channel, reference, location, merchant, amount, date, search text, features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermint.functions.text import ascii_fold, bound, collapse, contains_any, first_date, found, number, parsed_date, share_of, word_count

# The patterns of each channel, in order; a channel is the first any of whose patterns is found.
CHANNELS: dict[str, list[str]] = {
    "UPI": [r"(?i)UPI[-/]?(\d+)[-/]?(.+?)(?:\s|$)", r"(?i)UPI[/\-\s]+([A-Za-z0-9\s]+)[/\-]+(\d+)", r"(?i)UPI\s+(?:TO|FROM)?\s*(.+?)(?:\s+REF\s*[:\-]?\s*(\d+))?", r"(?i)([A-Za-z0-9]+)[\*\-]UPI"],
    "IMPS": [r"(?i)IMPS[-/]?(\d+)[-/]?(?:TO|FROM)?\s*([A-Za-z\s]+)", r"(?i)IMPS[/\-\s]+([A-Za-z\s]+)[/\-]+(\d+)", r"(?i)IMPS\s+(?:TO|FROM)?\s*(.+?)(?:\s+REF\s*[:\-]?\s*(\d+))?"],
    "NEFT": [r"(?i)NEFT[-/]?(\d+)[-/]?(?:TO|FROM)?\s*([A-Za-z\s]+)", r"(?i)NEFT[/\-\s]+([A-Za-z\s]+)[/\-]+(\d+)", r"(?i)NEFT\s+(?:TO|FROM)?\s*(.+?)(?:\s+REF\s*[:\-]?\s*(\d+))?"],
    "RTGS": [r"(?i)RTGS[-/]?(\d+)[-/]?(?:TO|FROM)?\s*([A-Za-z\s]+)", r"(?i)RTGS[/\-\s]+([A-Za-z\s]+)[/\-]+(\d+)", r"(?i)RTGS\s+(?:TO|FROM)?\s*(.+?)(?:\s+REF\s*[:\-]?\s*(\d+))?"],
    "POS": [r"(?i)POS\s+(\d+)\s+([A-Za-z0-9\s]+?)(?:\s+([A-Za-z\s]+?))?$", r"(?i)POS[/\-\s]+(.+?)[/\-\s]+([A-Za-z\s]+)", r"(?i)POS\s+(.+?)(?:\s+AT\s+(.+?))?$"],
    "ATM": [r"(?i)ATM\s+(?:WDL|WITHDRAWAL)\s+(\d+)\s*(.+)?", r"(?i)ATM[/\-\s]+(\d+)[/\-\s]*(.+)?", r"(?i)ATM\s+(.+?)(?:\s+AT\s+(.+?))?$"],
    "CARD": [r"(?i)(?:CARD|DEBIT|CREDIT)\s+(?:ENDING\s+)?[X*]*(\d{4})\s+(?:AT|@)\s+(.+)", r"(?i)(?:CARD|DEBIT|CREDIT)\s+(.+?)(?:\s+AT\s+(.+?))?$"],
}
#: The group of each of those patterns that holds the name; `compat` takes the last, second or first group instead.
NAME_GROUP = {"UPI": [2, 1, 1, 1], "IMPS": [2, 1, 1], "POS": [2, 1, 1]}
COMPAT_GROUP = {"UPI": [2, 2, 2, 1], "IMPS": [2, 2, 2], "POS": [1, 1, 1]}
#: Reference numbers, places, merchants, amounts and dates, in the order they are tried, and abbreviations.
REFERENCES = [r"(?i)REF\s*[:\-#]?\s*(\d+)", r"(?i)TXN\s*[:\-#]?\s*(\d+)", r"(?i)TRANSACTION\s*[:\-#]?\s*(\d+)", r"(?i)RRN\s*[:\-#]?\s*(\d+)"]
LOCATIONS = [r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s*(?:IN|INDIA)?$", r"(?i)(?:AT|@|IN)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"]
MERCHANTS = [r"(?i)\bTO\s+([A-Z][A-Z0-9\s]+)", r"(?i)([A-Za-z0-9]+)[\*\-](?:PAY|PAYMENT|PMT)", r"(?i)(?:PAID\s+TO|FROM)\s+([A-Za-z0-9\s]+)"]
AMOUNTS = [r"(?i)(?:INR|RS|₹)\s*([0-9,]+\.?\d*)", r"(?i)([0-9,]+\.?\d*)\s*(?:INR|RS|₹)"]
#: Year first, else the day-first pattern takes the end of an ISO date.
DATES = [r"(\d{4}[-/]\d{1,2}[-/]\d{1,2})", r"(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})", r"(?i)(\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{2,4})"]
#: Words, in capitals, of which each text that one of the patterns matches has one; others are not searched.
NEEDS: dict[str, tuple[str, ...]] = {p: ("CARD", "DEBIT", "CREDIT") if c == "CARD" else (c,) for c, ps in CHANNELS.items() for p in ps}
NEEDS |= dict(zip(REFERENCES, (("REF",), ("TXN",), ("TRANSACTION",), ("RRN",)), strict=True)) | {LOCATIONS[1]: ("AT", "@", "IN")}
NEEDS |= dict(zip(MERCHANTS, (("TO",), ("PAY", "PMT"), ("PAID", "FROM")), strict=True)) | {p: ("INR", "RS", "\u20b9") for p in AMOUNTS}
NEEDS |= dict(zip(DATES, (("-", "/"), ("-", "/"), ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")), strict=True))
#: Words that a text without a named merchant loses.
NO_NAMES = ("TRANSACTION", "PAYMENT", "PURCHASE", "ORDER", "BILL")
#: Short forms.
ABBREVIATIONS = {"txn": "transaction", "ref": "reference", "pymnt": "payment", "pmt": "payment", "rcvd": "received", "wdl": "withdrawal", "dep": "deposit", "chq": "cheque", "ck": "cheque"}
# Words of the flag features.
FLAG_WORDS = {
    "has_bigram_bill_payment": ["bill payment", "billpayment"], "has_bigram_fee_charge": ["fee charge", "service charge", "penalty charge"], "has_bigram_utility_bill": ["utility bill", "electricity bill", "water bill", "phone bill"],
    "has_bigram_card_payment": ["card payment", "cardpayment"], "has_bigram_online_order": ["online order", "onlineorder"],
    "contains_fuel": ["hpcl", "iocl", "bpcl", "petrol", "fuel", "diesel", "gas"], "contains_food": ["zomato", "swiggy", "food", "restaurant", "cafe", "dining"], "contains_grocery": ["bigbasket", "blinkit", "zepto", "grocery", "dmart", "supermarket"],
    "contains_transport": ["uber", "ola", "rapido", "cab", "taxi", "auto", "rickshaw"], "contains_bills": ["bill", "utility", "electricity", "water", "phone", "internet", "bsnl", "airtel", "jio"], "contains_fees": ["fee", "charge", "penalty"],
    "contains_shopping": ["amazon", "flipkart", "myntra", "shopping", "purchase", "order"], "contains_entertainment": ["netflix", "prime", "hotstar", "spotify", "movie", "cinema"], "contains_health": ["hospital", "doctor", "pharmacy", "medical", "medicine", "clinic"],
    "contains_education": ["school", "college", "tuition", "course", "education", "exam"], "contains_investment": ["mutual fund", "sip", "investment", "stocks", "shares"], "contains_ref": ["ref", "reference"],
}


def may_match(text: Column, *patterns: str) -> Column:
    """Whether a text has a word that one of the patterns needs."""
    return contains_any(F.upper(text), tuple(dict.fromkeys(w for p in patterns for w in NEEDS[p])))


def searched(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of a pattern's first match, else null, of texts that may match."""
    test = may_match(text, pattern) if pattern in NEEDS else text != F.upper(text)  # the first place pattern needs a small letter
    return F.when(test, found(text, pattern, group))


def first_searched(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[searched(text, p) for p in patterns])


def clean_text(text: Column) -> Column:
    """ASCII, single spaces, only word characters and - . / : * @, without runs of those marks."""
    t = F.regexp_replace(collapse(ascii_fold(text)), r"[^\w\s\-./:*@]", "")
    return F.trim(F.regexp_replace(t, r"[\-./:*@]{2,}", ""))


def expand_abbreviations(text: Column) -> Column:
    words = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    return F.array_join(F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.coalesce(F.try_element_at(words, w), w)), " ")


def channel_of(text: Column) -> Column:
    out = None
    for name, patterns in CHANNELS.items():
        test = may_match(text, *patterns) & text.rlike("|".join(f"(?:{p})" for p in patterns))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def merchant_of(text: Column, channel: Column, compat: bool = False) -> Column:
    """The merchant a text names. For UPI, IMPS and POS the first matching pattern decides, even where its group is empty."""
    groups = COMPAT_GROUP if compat else NAME_GROUP
    generic = F.trim(first_searched(text, MERCHANTS))
    edged = F.left(text, F.lit(1)).rlike(r"\W") | F.right(text, F.lit(1)).rlike(r"\W")
    rest = F.regexp_replace(F.when(edged, F.regexp_replace(text, r"^\W+|\W+$", "")).otherwise(text), r"\s+\d{6,}.*$", "")
    rest = F.trim(F.when(contains_any(F.upper(text), NO_NAMES), F.regexp_replace(rest, r"(?i)\b(transaction|payment|purchase|order|bill)\b", "")).otherwise(rest))
    other = F.coalesce(generic, bound(rest, lambda r: F.when(F.length(r) >= 3, r)))

    def decided(tries: list[tuple[str, int]]) -> Column:
        """An array of what the first matching pattern names, else null; a pattern is searched again only where its group is empty."""
        if not tries:
            return F.lit(None).cast("array<string>")
        (p, g), *more = tries
        return bound(F.regexp_extract(text, p, g), lambda v: F.when(v != "", F.array(F.trim(v))).when(text.rlike(p), F.array(F.lit(None).cast("string"))).otherwise(decided(more)))

    out = None
    for name in groups:
        test, value = channel == name, decided(list(zip(CHANNELS[name], groups[name], strict=True)))
        out = F.when(test, value) if out is None else out.when(test, value)
    return bound(out, lambda v: F.when(v.isNull(), other).otherwise(F.get(v, F.lit(0))))


def normalize(df: DataFrame, text: str = "text", amount: str | None = "amount", date: str | None = "date", merchant: str | None = None, compat: bool = False) -> DataFrame:
    """`df` with cleaned_text, channel, reference, location, pattern_merchant, merchant, norm_amount, norm_date, search_text.

    Null text counts as empty. A given amount or date wins over the text; a given date that cannot be read gives null.
    """
    return with_values(with_search_text(df, text, merchant, compat), text, amount, date)


def with_search_text(df: DataFrame, text: str = "text", merchant: str | None = None, compat: bool = False) -> DataFrame:
    """The columns of `normalize` that its search text is made of, and this."""
    t = F.col("cleaned_text")
    work = df.withColumn("cleaned_text", clean_text(F.coalesce(F.col(text), F.lit(""))))
    work = work.withColumn("channel", channel_of(t)).withColumn("location", first_searched(t, LOCATIONS))
    work = work.withColumn("pattern_merchant", merchant_of(t, F.col("channel"), compat))
    work = work.withColumn("merchant", F.coalesce(F.col(merchant), F.col("pattern_merchant")) if merchant else F.col("pattern_merchant"))
    mark = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}:"), F.col(c)))
    return work.withColumn("search_text", F.concat_ws(" ", t, mark("channel", "channel"), mark("merchant", "pattern_merchant"), mark("location", "location")))


def with_values(df: DataFrame, text: str = "text", amount: str | None = "amount", date: str | None = "date") -> DataFrame:
    """The other columns of `normalize`: reference, norm_amount, norm_date. They need the text and `cleaned_text` alone, so that a write between may leave them out."""
    raw = F.coalesce(F.col(text), F.lit(""))
    given = F.col(date).cast("string") if date else F.lit(None).cast("string")
    amounts = [number(searched(raw, p), "decimal(15,2)") for p in AMOUNTS]
    work = df.withColumn("reference", first_searched(F.col("cleaned_text"), REFERENCES))
    work = work.withColumn("norm_amount", F.coalesce(*([F.col(amount).cast("decimal(15,2)")] if amount else []), *amounts))
    return work.withColumn("norm_date", F.when(given.isNotNull() & (given != ""), parsed_date(given)).otherwise(first_date([searched(raw, p) for p in DATES])))


def normalize_batch(df: DataFrame, compat: bool = False) -> DataFrame:
    """Rows of texts or of records: `text` else `description`, `date` else `timestamp`, `amount`, `currency` else INR, whichever of these the table has."""
    first = lambda *names: F.coalesce(*[F.col(c).cast("string") for c in names if c in df.columns], F.lit(None).cast("string"))
    amount = F.col("amount") if "amount" in df.columns else F.lit(None).cast("double")
    rest = [c for c in df.columns if c not in ("text", "description", "date", "timestamp", "amount", "currency")]
    return normalize(df.select(*rest, first("text", "description").alias("text"), first("date", "timestamp").alias("date"), amount.alias("amount"), F.coalesce(first("currency"), F.lit("INR")).alias("currency")), compat=compat)


def features(df: DataFrame) -> DataFrame:
    """The 58 features of normalised rows, added as columns; missing values count as 0 or false."""
    t, channel, merchant, day = F.col("cleaned_text"), F.coalesce("channel", F.lit("")), F.coalesce("merchant", F.lit("")), F.col("norm_date")
    low, up, amount = F.lower(t), F.upper(t), F.coalesce(F.col("norm_amount").cast("double"), F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    false = lambda c: F.coalesce(c, F.lit(False))
    positive = amount > 0
    out = {f"is_{c.lower()}": channel == c for c in ("UPI", "IMPS", "NEFT", "POS", "ATM", "CARD")}
    out |= {"has_channel": channel != "", "has_merchant": merchant != "", "merchant_length": F.length(merchant), "has_numbers_in_merchant": merchant.rlike(r"\d"), "merchant_word_count": word_count(merchant)}
    out |= {
        "amount": amount, "amount_log": F.when(positive, F.log1p(amount)).otherwise(0.0), "amount_sqrt": F.when(amount >= 0, F.sqrt(amount)).otherwise(0.0),
        "amount_bucket": F.when(amount == 0, 0).when(amount < 100, 1).when(amount < 500, 2).when(amount < 2000, 3).when(amount < 10000, 4).otherwise(5),
        "is_round_amount": positive & (F.pmod(amount, F.lit(100)) == 0), "is_round_amount_50": positive & (F.pmod(amount, F.lit(50)) == 0),
        "amount_rounded_to_100": F.when(positive, F.bround(amount / 100, 0) * 100).otherwise(0.0), "amount_digits": F.when(positive, F.length(F.floor(amount).cast("string"))).otherwise(0),
    }
    out |= {"text_length": F.length(t), "word_count": word_count(t), "has_numbers": t.rlike(r"\d"), "has_special_chars": t.rlike(r"[^\w\s]"), "has_reference": F.col("reference").isNotNull(), "has_location": F.col("location").isNotNull(), "uppercase_ratio": share_of(t, "[A-Z]"), "digit_ratio": share_of(t, "[0-9]")}
    out |= {k: contains_any(low, w) for k, w in FLAG_WORDS.items()}
    month_day = F.dayofmonth(day)
    out |= {"day_of_month": zero(month_day), "day_of_week": zero(F.weekday(day)), "is_month_end": false(month_day >= 25), "is_month_start": false(month_day <= 5), "is_weekend": false(F.weekday(day) >= 5), "month": zero(F.month(day)), "quarter": zero(F.quarter(day))}
    out |= {f"starts_with_{c.lower()}": up.startswith(c) for c in ("UPI", "IMPS", "NEFT", "POS", "ATM")}
    out |= {"contains_at": up.contains(" AT "), "contains_to": up.contains(" TO ")}
    return df.select("*", *[c.alias(f"f_{k}") for k, c in out.items()])


FEATURES = 58
