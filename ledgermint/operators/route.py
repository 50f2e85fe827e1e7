"""Routing: early exits by rule, merchant and code, else the vote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ledgermint.functions.lineage import materialise, step
from ledgermint.functions.text import contains_any

from .merchant_codes import category_id, classify_codes, code_in_text
from .merchant_index import MerchantIndex
from .normalize import with_search_text, with_values
from .resolve import attach_merchant
from .rules import Category, categorize_by_rules
from .vote import METHODS, Config, vote

#: Words of a refund.
REFUND_WORDS = ["refund", "return", "reversal", "chargeback"]


def _exit_vote(none: Column, category: Column, confidence: Column, method: Column) -> Column:
    """The vote of a row that left early: one method, all agree; `none` is an empty list of alternatives."""
    return F.struct(
        category.alias("category"), confidence.alias("confidence"), method.alias("method"), F.lit(1).alias("agreement"), F.lit(1).alias("methods"), none.alias("alternatives"),
        F.lit(0.0).alias("ambiguity"), F.lit(False).alias("requires_review"), F.map_from_arrays(F.array(category), F.array(confidence)).alias("weighted"),
    )


def categorize(df: DataFrame, taxonomy: list[Category], gazetteer: DataFrame | MerchantIndex, codes: DataFrame, cfg: Config = Config(), fuzzy: bool = True, compat: bool = False, text_search: bool = True) -> DataFrame:
    """Transactions (text, amount, date, mcc) with category, subcategory, confidence, method, requires_review, merchant_resolved, vote.

    Early exits: a sure rule; then the merchant that the whole text names (`text_search`), else the one
    extracted from it; then a sure code. The rest is voted on. External scorers take part through the
    columns ml_category, ml_conf, ml_alternatives, llm_category, llm_conf of `df`, where present.

    The rows with their rules are written once, since merchants are resolved from the distinct texts of those that no rule
    settles; only these are joined with merchants and voted on. References, amounts and dates, which no step needs, are made
    after the write, and only for a reader who takes them. With a `MerchantIndex` in the
    gazetteer's place (whose own `fuzzy` holds) merchants are found in the row instead: nothing is written, no job
    runs, and `df` may be a stream; its result is then written with `writeStream` as it is.
    """
    w = cfg.weights()
    compiled = isinstance(gazetteer, MerchantIndex)
    work = step(with_search_text(df, compat=compat), "normalised")  # either cut also keeps the generated code of each step within bounds
    work = categorize_by_rules(work, taxonomy, amount="amount", date="date", compat=compat)
    rule = F.col("rule_result")
    work = work.withColumn("rule_category", category_id(rule["category"])).withColumn("rule_conf", rule["confidence"])
    work = work.withColumn("_ruled", F.coalesce(F.lit(w["rule"] > 0) & (F.col("rule_conf") >= cfg.rule_exit), F.lit(False)))
    whole = "_text" if text_search else None
    if compiled:
        work = with_values(step(work, "ruled"))
        open_ = lambda c: F.when(~F.col("_ruled"), F.col(c))
        work = gazetteer.attach(work.withColumn("_name", open_("merchant")).withColumn("_text", open_("text")), "_name", cfg.name_least, whole, cfg.text_least)
        return _decided(work, codes, cfg, compat)
    work = with_values(materialise(work))
    rest = work.where(~F.col("_ruled")).withColumn("_name", F.col("merchant")).withColumn("_text", F.col("text"))
    rest = _decided(attach_merchant(rest, gazetteer, "_name", cfg.name_least, fuzzy, whole, cfg.text_least), codes, cfg, compat)
    return _settled(work.where("_ruled"), codes).select(*rest.columns).union(rest)


def _with_codes(work: DataFrame, codes: DataFrame) -> DataFrame:
    work = classify_codes(work.withColumn("_mcc", F.coalesce("mcc", code_in_text(F.col("text")))), codes, "_mcc")
    return work.withColumn("mcc_category", category_id(F.col("mcc_category"))).drop("_mcc")


def _settled(work: DataFrame, codes: DataFrame) -> DataFrame:
    """The answers of rows that a rule settles, as `_decided` gives them, without a search for merchants or a vote."""
    rule, way, none = F.col("rule_result"), F.lit("rule_deterministic"), F.lit(None).cast("string")
    out = _with_codes(work, codes).withColumns({"merchant_resolved": F.col("merchant"), "merchant_category": none, "merchant_subcategory": none, "merchant_score": F.lit(None).cast("double")})
    out = out.withColumns({"category": F.col("rule_category"), "subcategory": rule["subcategory"], "confidence": F.col("rule_conf"), "method": way})
    empty = F.array().cast("array<struct<score:double,category:string>>")
    return out.withColumn("vote", _exit_vote(empty, F.col("category"), F.col("confidence"), way)).withColumn("requires_review", F.col("vote")["requires_review"])


def _decided(work: DataFrame, codes: DataFrame, cfg: Config, compat: bool) -> DataFrame:
    """Rows with their merchants: exits by rule, merchant and code, else the vote."""
    w, rule = cfg.weights(), F.col("rule_result")
    work = _with_codes(work, codes)
    refund = contains_any(F.lower(F.coalesce("text", F.lit(""))), REFUND_WORDS)
    by_merchant = F.lit(w["mcc"] + w["rule"] + w["llm"] > 0) & (F.col("merchant_score") >= cfg.merchant_exit) & ~refund
    by_code = F.lit(w["mcc"] > 0) & (F.col("mcc_conf") >= cfg.mcc_exit)
    work = work.withColumn("_way", F.when(F.col("_ruled"), "rule_deterministic").when(by_merchant, "merchant_gazetteer").when(by_code, "mcc_deterministic"))
    way = F.col("_way")
    # rows that left have no votes left to count
    voters = [c for c in (f"{m}_category" for m in METHODS) if c in work.columns]
    masked = work.withColumns({f"_own_{c}": F.col(c) for c in voters}).withColumns({c: F.when(way.isNull(), F.col(c)) for c in voters})
    work = vote(masked, cfg, compat).withColumns({c: F.col(f"_own_{c}") for c in voters})
    v = F.col("vote")
    pick = lambda a, b, c, d: F.when(way == "rule_deterministic", a).when(way == "merchant_gazetteer", b).when(way == "mcc_deterministic", c).otherwise(d)
    none = F.lit(None).cast("string")
    raised = F.round(F.least(F.lit(cfg.merchant_cap), F.col("merchant_score") + cfg.merchant_boost), 6)
    out = work.withColumn("category", pick(F.col("rule_category"), category_id(F.col("merchant_category")), F.col("mcc_category"), v["category"]))
    out = out.withColumn("subcategory", pick(rule["subcategory"], F.col("merchant_subcategory"), none, F.when(v["category"] == F.col("rule_category"), rule["subcategory"])))
    out = out.withColumn("confidence", pick(F.col("rule_conf"), raised, F.col("mcc_conf"), v["confidence"])).withColumn("method", F.coalesce(way, v["method"]))
    out = out.withColumn("merchant_resolved", F.when(F.col("_ruled"), F.col("merchant")).otherwise(F.col("merchant_resolved")))
    out = out.withColumn("vote", F.when(way.isNotNull(), _exit_vote(F.filter(v["alternatives"], lambda x: F.lit(False)), F.col("category"), F.col("confidence"), way)).otherwise(v))
    return out.withColumn("requires_review", v["requires_review"]).drop("_way", "_ruled", "_name", "_text", *[f"_own_{c}" for c in voters])


def stream_categorize(transactions: DataFrame, sink: Callable[[DataFrame, int], None], taxonomy: list[Category], gazetteer: DataFrame, codes: DataFrame, **options) -> DataStreamWriter:
    """A stream of transactions routed batch by batch, for gazetteers too large for an index; `sink` takes each routed batch and its number, which makes writes repeatable.

    With a `MerchantIndex`, `categorize` takes the stream itself.
    """
    return transactions.writeStream.foreachBatch(lambda rows, number: sink(categorize(rows, taxonomy, gazetteer, codes, **options), number))


def assembled(df: DataFrame) -> DataFrame:
    """The answers to requests: the normalised fields, the result, and alternatives as results with the winner's method."""
    alternative = lambda a: F.struct(a["category"].alias("category"), F.lit(None).cast("string").alias("subcategory"), a["score"].alias("confidence"), F.col("method").alias("method"))
    alternatives = F.when(F.size("vote.alternatives") > 0, F.transform("vote.alternatives", alternative))
    normalized = F.struct(F.col("norm_amount").cast("double").alias("amount"), F.coalesce("currency", F.lit("INR")).alias("currency"), F.col("norm_date").cast("string").alias("date"), "merchant", "channel", "reference", "location")
    return df.select("txn_key", F.col("text").alias("original_text"), normalized.alias("normalized"), "category", "subcategory", "confidence", "method", alternatives.alias("alternatives"), "requires_review", F.col("vote").alias("ensemble_votes"))


def batch_answers(df: DataFrame, error: str = "error") -> DataFrame:
    """One answer per row of a batch: rows whose `error` is not null are Unknown, with 0, method and status error and the message."""
    bad = F.col(error).isNotNull()
    good = lambda c: F.when(~bad, F.col(c))
    return df.select(
        "txn_key", F.col("text").alias("transaction"), F.when(bad, "Unknown").otherwise(F.col("category")).alias("category"), good("subcategory").alias("subcategory"), F.when(bad, 0.0).otherwise(F.col("confidence")).alias("confidence"),
        F.when(bad, "error").otherwise(F.col("method")).alias("method"), F.when(bad, "error").otherwise("success").alias("status"), F.when(bad, F.coalesce(F.nullif(F.col(error), F.lit("")), F.lit("Unknown error"))).alias("error_message"),
    )


def batch_counts(answers: DataFrame) -> DataFrame:
    """(total, successful, failed) of a batch."""
    return answers.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "success").alias("successful"), F.count_if(F.col("status") == "error").alias("failed"))


def hybrid(df: DataFrame, threshold: float = 0.85, review: float = 0.60) -> DataFrame:
    """`df` with `hybrid`: struct<category, confidence, method, requires_review> from rule and model: a sure rule, a sure model, agreement, the higher one, the only one, or Other."""
    rc, mc, r, m = F.col("rule_category"), F.col("ml_category"), F.coalesce("rule_conf", F.lit(0.0)), F.coalesce("ml_conf", F.lit(0.0))
    has_rule, has_ml = rc.isNotNull(), mc.isNotNull()
    made = lambda c, conf, name: F.struct(c.alias("category"), F.round(conf, 6).alias("confidence"), F.lit(name).alias("method"))
    by_rule, by_ml = made(rc, r, "rule"), made(mc, m, "ml")
    best = F.when(has_rule & (r >= threshold), by_rule).when(has_ml & (m >= threshold), by_ml)
    best = best.when(has_rule & has_ml & (rc == mc), made(rc, F.least(F.lit(1.0), (r + m) / 2 * 1.2), "hybrid")).when(has_rule & has_ml, F.when(r >= m, by_rule).otherwise(by_ml)).when(has_rule, by_rule).when(has_ml, by_ml)
    best = best.otherwise(made(F.lit("Other"), F.lit(0.0), "fallback"))
    return df.withColumn("hybrid", F.struct(best["category"].alias("category"), best["confidence"].alias("confidence"), best["method"].alias("method"), (best["confidence"] < review).alias("requires_review")))


#: Keywords and patterns of twelve further categories, in order.
KEYWORD_LABELS = [
    ("insurance", ["insurance", "lic", "hdfc life", "icici prudential", "star health", "max life", "sbi life", "bajaj allianz", "policy", "premium"], [r"\binsurance\b", r"\bpremium\b", r"\bpolicy\b", r"\blic\b"]),
    ("charity_donations", ["donation", "charity", "ngo", "temple", "church", "mosque", "red cross", "unicef", "oxfam", "donate", "milaap", "ketto"], [r"\bdonation\b", r"\bcharity\b", r"\bngo\b", r"\btemple\b", r"\bchurch\b"]),
    ("personal_care", ["salon", "spa", "gym", "fitness", "cult.fit", "urban company", "vlcc", "naturals", "lakme", "massage", "facial", "haircut"], [r"\bsalon\b", r"\bspa\b", r"\bgym\b", r"\bfitness\b", r"\bmassage\b"]),
    ("pets", ["pedigree", "whiskas", "drools", "royal canin", "pet", "dog food", "cat food", "veterinary", "vet", "pet shop", "pet store"], [r"\bpet\b", r"\bdog\b", r"\bcat\b", r"\bvet\b", r"\bpedigree\b"]),
    ("home_improvement", ["furniture", "ikea", "pepperfry", "urban ladder", "livspace", "carpenter", "plumber", "electrician", "home repair", "renovation"], [r"\bfurniture\b", r"\bikea\b", r"\bcarpenter\b", r"\bplumber\b"]),
    ("automotive", ["car service", "bike service", "vehicle", "auto", "tyre", "tire", "maruti", "honda", "hyundai", "mechanic", "spare parts", "oil change"], [r"\bcar\b", r"\bvehicle\b", r"\bauto\b", r"\bmechanic\b", r"\btyre\b"]),
    ("taxes_government", ["income tax", "gst", "property tax", "tax payment", "tds", "challan", "municipal", "government fee", "license fee", "passport"], [r"\btax\b", r"\bgst\b", r"\btds\b", r"\bchallan\b", r"\bgovernment\b"]),
    ("electronics_technology", ["iphone", "samsung", "laptop", "macbook", "ipad", "dell", "hp", "lenovo", "croma", "reliance digital", "vijay sales", "electronics"], [r"\biphone\b", r"\blaptop\b", r"\bmacbook\b", r"\belectronics\b"]),
    ("professional_services", ["lawyer", "attorney", "legal", "consultant", "consulting", "accountant", "ca", "advocate", "professional fee"], [r"\blawyer\b", r"\blegal\b", r"\bconsultant\b", r"\battorney\b"]),
    ("kids_family", ["firstcry", "kids", "children", "baby", "toy", "hamleys", "daycare", "diaper", "infant", "school supplies"], [r"\bkids\b", r"\bbaby\b", r"\btoy\b", r"\bchildren\b", r"\bdiaper\b"]),
    ("subscriptions_memberships", ["netflix", "spotify", "amazon prime", "hotstar", "youtube premium", "icloud", "office 365", "subscription", "membership", "monthly"], [r"\bnetflix\b", r"\bspotify\b", r"\bprime\b", r"\bsubscription\b"]),
    ("gifts_occasions", ["gift", "flower", "bouquet", "ferns n petals", "archies", "gift card", "present", "birthday", "anniversary"], [r"\bgift\b", r"\bflower\b", r"\bbouquet\b", r"\bbirthday\b"]),
]


def label_by_keywords(text, labels: list[tuple[str, list[str], list[str]]] = KEYWORD_LABELS):
    """The first label any of whose keywords or patterns is in the text; null without one."""
    low, out = F.lower(text), None
    for label, words, patterns in labels:
        test = contains_any(low, words) | low.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else contains_any(low, words)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out
