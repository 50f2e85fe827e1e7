"""Learning from feedback: merchants, few-shot sets, training rows, gates, review queues, explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgermint.functions.lineage import materialise

#: Words that are no part of a merchant's name.
NOISE = (
    "UPI", "IMPS", "NEFT", "RTGS", "POS", "CARD", "ATM",
    "PAYMENT", "PURCHASE", "BILL", "INR", "RS",
    "DEBIT", "CREDIT", "TXN", "TRANSACTION", "TO", "FROM",
    "AT", "ON", "IN", "VIA", "BY",
)
RETRAIN_EVERY = 50


def correction_merchant(text: Column) -> Column:
    """The longest run of words of three or more characters that begin with a letter, without noise words; the first on a tie."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.upper(text), r"\b(" + "|".join(NOISE) + r")\b", ""), r"\s+", " "))
    marks = F.transform(F.split(plain, " "), lambda w: F.when((F.length(w) >= 3) & w.rlike(r"^\p{L}"), w).otherwise("\n"))
    runs = F.transform(F.split(F.array_join(marks, " "), "\n"), lambda r: F.trim(r))
    best = F.array_max(F.transform(runs, lambda r, i: F.struct(F.length(r).alias("n"), (-i).alias("order"), r.alias("run"))))["run"]
    return F.nullif(best, F.lit(""))


def numbered(df: DataFrame, order: str, first: int = 1) -> DataFrame:
    """`df` with `number`: consecutive from `first` by `order`. Rows are dealt into ranges, counted, and numbered in each, so that no task sees all."""
    ranged = materialise(df.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row per partition
    before = F.broadcast(counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return ranged.withColumn("_rank", rank).join(before, "_part").withColumn("number", F.col("_before") + F.col("_rank") + (first - 1)).drop("_part", "_rank", "_before")


def learned_merchants(corrections: DataFrame, least: int = 3, first_id: int = 1) -> DataFrame:
    """(merchant_id, canonical_name, category, subcategory, aliases, n) of names with enough corrections (text, label, subcategory, pos); the majority label, the first seen on a tie."""
    named = corrections.withColumn("name", correction_merchant(F.col("text"))).where("name IS NOT NULL")
    per = named.groupBy("name", "label", F.coalesce("subcategory", F.lit("")).alias("subcategory")).agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    labels = per.groupBy("name", "label").agg(F.sum("n").alias("ln"), F.min("first").alias("lf"), F.max_by("subcategory", F.struct("n", -F.col("first"))).alias("subcategory"))
    best = labels.groupBy("name").agg(F.sum("ln").alias("n"), F.max_by(F.struct("label", "subcategory"), F.struct("ln", -F.col("lf"))).alias("b")).where(F.col("n") >= least)
    aliases = F.array_join(F.array_distinct(F.array(F.lower("name"), F.lower(F.replace("name", F.lit(" "), F.lit(""))), F.lower(F.element_at(F.split("name", " "), 1)))), ",")
    return numbered(best, "name", first_id).select(F.col("number").alias("merchant_id"), F.col("name").alias("canonical_name"), F.col("b.label").alias("category"), F.col("b.subcategory").alias("subcategory"), aliases.alias("aliases"), "n")


def extended_gazetteer(gazetteer: DataFrame, learned: DataFrame) -> DataFrame:
    """A gazetteer followed by the learned merchants that it lacks, with ids and row positions that go on after its own."""
    last = gazetteer.agg(F.coalesce(F.max("row_pos"), F.lit(-1)).alias("_row"), F.coalesce(F.max("merchant_id"), F.lit(0)).alias("_id"))
    new = numbered(new_merchants(learned, gazetteer), "canonical_name").crossJoin(F.broadcast(last))  # one row of maxima
    rows = new.select((F.col("_row") + F.col("number")).cast("int").alias("row_pos"), (F.col("_id") + F.col("number")).cast("int").alias("merchant_id"), "canonical_name", "aliases", "category", "subcategory")
    return gazetteer.select(rows.columns).unionByName(rows)


def new_merchants(learned: DataFrame, known: DataFrame) -> DataFrame:
    return learned.join(known.select(F.upper("canonical_name").alias("canonical_name")), "canonical_name", "left_anti")


def correction_summary(corrections: DataFrame, k: int = 10) -> DataFrame:
    """The labels that corrections name most, with how many were wrong before."""
    return corrections.groupBy("label").agg(F.count("*").alias("n"), F.count_if("was_incorrect").alias("incorrect")).orderBy(F.desc("n"), "label").limit(k)


def retrain_points(corrections: DataFrame, every: int = RETRAIN_EVERY, order: str = "pos") -> DataFrame:
    """The corrections at which retraining starts. `order` is dense from 1 where corrections are numbered as they arrive."""
    return corrections.where(F.pmod(F.col(order), F.lit(every)) == 0)


def feedback_training_rows(feedback: DataFrame, least: int = 1) -> DataFrame:
    """Corrected feedback as training rows, or none while there are fewer than `least`."""
    rows = feedback.where("was_incorrect").select("text", F.col("label").alias("category"), "label", "amount", F.lit("feedback").alias("source"))
    enough = F.broadcast(rows.agg((F.count("*") >= least).alias("_enough")))
    return rows.crossJoin(enough).where("_enough").drop("_enough")


def few_shot_set(accepted: DataFrame, corrected: DataFrame, most: int = 50, least_conf: float = 0.9) -> DataFrame:
    """Half sure accepted rows, half corrected ones, (text, category, confidence)."""
    a = accepted.where((F.col("confidence") >= least_conf) & ~F.col("requires_review")).orderBy(F.desc("confidence"), "txn_key").limit(most // 2).select("txn_key", "text", "category", "confidence")
    b = corrected.orderBy("txn_key").limit(most // 2).select("txn_key", "text", F.col("label").alias("category"), F.lit(1.0).alias("confidence"))
    return a.unionByName(b)


def votes_of_method(method: Column) -> Column:
    """(agreement, methods) rebuilt from a method's name: agreement is known for unanimous votes alone."""
    return F.struct(F.when(method.contains("unanimous"), 1).otherwise(0).alias("agreement"), (F.regexp_count(method, F.lit(r"\+")) + 1).alias("methods"))


def uncertainty(confidence: Column, agreement: Column, methods: Column, method: Column) -> Column:
    ratio = F.when(methods > 0, agreement / methods).otherwise(0.0)
    low = F.lower(method)
    by_method = F.when(low.contains("llm"), 0.1).when(low.contains("rule") & ~low.contains("ml"), 0.05).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), (1 - confidence) + (1 - ratio) * 0.3 + by_method), 6)


def review_queue(df: DataFrame, most: int = 50, least: float = 0.3, key: str = "txn_key", created: str | None = None, today: Column | None = None, max_age_days: int = 7) -> DataFrame:
    """Rows for review, the most uncertain first: of the `most` least confident ones those that are uncertain enough.

    With `created`, rows older than `max_age_days` before `today` are left out; with a column `reviewed`, those that were reviewed.
    """
    open_ = df.where("requires_review")
    open_ = open_.where(~F.col("reviewed")) if "reviewed" in df.columns else open_
    if created:
        open_ = open_.where(F.col(created) >= F.date_sub(today if today is not None else F.current_date(), max_age_days))
    first = open_.orderBy("confidence", key).limit(most)
    v = votes_of_method(F.col("method"))
    scored = first.withColumn("uncertainty", uncertainty(F.col("confidence"), v["agreement"], v["methods"], F.col("method")))
    return scored.where(F.col("uncertainty") >= least).orderBy(F.desc("uncertainty"), key)


def prioritise(df: DataFrame, least: float = 0.3, low: float = 0.6) -> DataFrame:
    return df.withColumn("for_review", (F.col("uncertainty") > least) | (F.col("confidence") < low))


def explain(df: DataFrame) -> DataFrame:
    """`df` with `explanation`: components, decision path and alternatives of a routed row."""
    part = lambda name, c, conf, why: F.when(c.isNotNull(), F.struct(F.lit(name).alias("component"), c.alias("category"), conf.cast("double").alias("confidence"), why.alias("reason")))
    components = F.array_compact(F.array(
        part("rule", F.col("rule_category"), F.col("rule_conf"), F.col("rule_result.explanation")),
        part("mcc", F.col("mcc_category"), F.col("mcc_conf"), F.lit("merchant code")),
        *[part(m, F.col(f"{m}_category"), F.col(f"{m}_conf"), F.lit(f"{m} prediction")) for m in ("ml", "llm") if f"{m}_category" in df.columns],
        part("merchant", F.col("merchant_category"), F.col("merchant_score"), F.concat(F.lit("matched "), F.col("merchant_resolved"))),
    ))
    v = F.col("vote")
    how = F.when(F.col("method") == "ensemble_unanimous", F.format_string("All %d methods agree", v["methods"])).when(F.col("method").startswith("ensemble"), F.format_string("%d of %d methods chose %s", v["agreement"], v["methods"], v["category"])).otherwise(F.concat(F.lit("Single method: "), F.col("method")))
    path = F.array(how, F.concat(F.lit("Final: "), F.col("category")))
    return df.withColumn("explanation", F.struct(components.alias("components"), path.alias("decision_path"), v["alternatives"].alias("alternatives")))


def explanation_json(df: DataFrame, key: str = "txn_key") -> DataFrame:
    """(key, json): the explanation of each row as one document; fields without value stay."""
    e = F.col("explanation")
    shown = F.struct(F.col(key).alias("transaction_id"), F.col("category").alias("final_category"), F.col("confidence").alias("final_confidence"), F.col("method").alias("method_used"), e["components"].alias("components"), F.col("vote").alias("ensemble_votes"), e["decision_path"].alias("decision_path"), e["alternatives"].alias("alternatives"))
    return df.select(key, F.to_json(shown, {"ignoreNullFields": "false"}).alias("json"))


def correction_rows(feedback: DataFrame) -> DataFrame:
    """Corrections from feedback (text, predicted and correct category and subcategory, amount, date, timestamp), with `was_incorrect`."""
    return feedback.select("text", "predicted_category", "correct_category", "predicted_subcategory", "correct_subcategory", F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("method"), "timestamp", (~F.col("predicted_category").eqNullSafe(F.col("correct_category"))).alias("was_incorrect"), "amount", "date")


def confirmed_rows(feedback: DataFrame) -> DataFrame:
    """Transactions as feedback confirms them: the correct category, sure, reviewed."""
    return feedback.select("text", F.col("amount").cast("decimal(15,2)").alias("amount"), F.lit("INR").alias("currency"), F.col("date").try_cast("date").alias("date"), F.col("correct_category").alias("category"), F.col("correct_subcategory").alias("subcategory"), F.lit(1.0).cast("decimal(5,4)").alias("confidence"), F.lit("user_feedback").alias("method"), F.lit(False).alias("requires_review"), F.lit(True).alias("reviewed"))


def audit(feedback: DataFrame, most: int = 100) -> DataFrame:
    """The latest corrected predictions."""
    return correction_rows(feedback).where("was_incorrect").orderBy(F.desc("timestamp"), "text").limit(most)


def retained(df: DataFrame, day: str, today: Column, days: int = 90) -> DataFrame:
    """Rows of the last `days` days; those without a day stay."""
    return df.where(F.coalesce(F.col(day).cast("date") >= F.date_sub(today, days), F.lit(True)))


def votes_long(df: DataFrame, key: str = "txn_key", methods: tuple[str, ...] = ("mcc", "rule", "ml", "llm")) -> DataFrame:
    """(key, method, confidence in percent, category or N/A): one row per method."""
    have = [m for m in methods if f"{m}_category" in df.columns]
    rows = F.array(*[F.struct(F.lit(m).alias("method"), F.round(F.coalesce(F.col(f"{m}_conf"), F.lit(0.0)) * 100, 2).alias("percent"), F.coalesce(F.col(f"{m}_category"), F.lit("N/A")).alias("category")) for m in have])
    return df.select(key, F.inline(rows))


def mask_personal(text: Column) -> Column:
    """E-mail addresses, card numbers, twelve-digit ids, tax ids and phone numbers replaced by marks."""
    for pattern, mark in [(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"), (r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b", "[CARD]"), (r"\b\d{4} ?\d{4} ?\d{4}\b", "[ID]"), (r"\b[A-Z]{5}\d{4}[A-Z]\b", "[TAXID]"), (r"\+?\d{1,3}[ -]?\(?\d{3}\)?[ -]?\d{3}[ -]?\d{4}\b", "[PHONE]")]:
        text = F.regexp_replace(text, pattern, mark)
    return text
