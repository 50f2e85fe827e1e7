"""Evaluation of predictions (true label, predicted label, confidence, amount) and fairness reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermint.functions.lineage import materialise

#: Amount ranges as (name, above, up to).
AMOUNT_RANGES = [("small", None, 100), ("medium", 100, 1000), ("large", 1000, None)]
FIVE_RANGES = [("0-100", None, 100), ("100-500", 100, 500), ("500-2000", 500, 2000), ("2000-10000", 2000, 10000), ("10000+", 10000, None)]
DISPARITY, MINORITY_ROWS, MINORITY_GAP = 0.10, 20, 0.15


def confusion(df: DataFrame, true: str = "label", pred: str = "pred") -> DataFrame:
    return df.groupBy(F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, true: str = "label", pred: str = "pred") -> DataFrame:
    """(class, support, precision, recall, f1, incorrect) of every class; a division by zero is 0.

    One pass over the rows; the rest is over class pairs, which are written: a filter on the report would otherwise be
    pushed below one of the two groupings of the pairs, and the rows be read and judged for each.
    """
    c = materialise(confusion(df, true, pred))
    hit = F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0))
    rows = c.groupBy(F.col("true").alias("class")).agg(F.sum("n").alias("support"), hit.alias("tp"))
    cols = c.groupBy(F.col("pred").alias("class")).agg(F.sum("n").alias("predicted"), hit.alias("tp2"))
    both = rows.join(cols, "class", "full_outer").na.fill(0)
    tp = F.greatest("tp", "tp2")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(tp, F.col("predicted")), ratio(tp, F.col("support"))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return both.select("class", F.col("support").cast("long").alias("support"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"), (F.col("support") - tp).cast("long").alias("incorrect"))


def summary(report: DataFrame, gate: float = 0.90) -> DataFrame:
    """Macro and weighted averages over true classes, accuracy, and whether macro F1 reaches the gate."""
    r, n = report.where("support > 0"), F.sum("support")
    macro = [F.round(F.avg(c), 6).alias(f"macro_{c}") for c in ("precision", "recall", "f1")]
    weighted = [F.round(F.sum(F.col(c) * F.col("support")) / n, 6).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")]
    return r.agg(*macro, *weighted, F.round(1 - F.sum("incorrect") / n, 6).alias("accuracy"), F.sum((F.col("f1") == 1).cast("long")).alias("perfect"), (F.round(F.avg("f1"), 6) >= gate).alias("passes"))


def joined(predictions: DataFrame, labels: DataFrame, key: str = "txn_key") -> DataFrame:
    """Predictions with their true labels: one row per prediction whose `key` has a label; of a key that has several, the smallest label counts."""
    true = labels.groupBy(key).agg(F.min("label").alias("label"))
    return predictions.drop("label").join(true, key)


def misclassified(report: DataFrame) -> DataFrame:
    """(class, support, incorrect, accuracy) of true classes that have errors, the most errors first."""
    rows = report.where("support > 0 and incorrect > 0")
    return rows.select("class", "support", "incorrect", F.round(1 - F.col("incorrect") / F.col("support"), 6).alias("accuracy")).orderBy(F.desc("incorrect"), "class")


def report_totals(report: DataFrame, near: float = 0.99) -> DataFrame:
    """(classes, total_rows, total_errors, perfect, nearly_perfect): of true classes, those with an F1 of 1 and of `near` or more."""
    r = report.where("support > 0")
    return r.agg(F.count("*").alias("classes"), F.sum("support").alias("total_rows"), F.sum("incorrect").alias("total_errors"), F.count_if(F.col("f1") == 1).alias("perfect"), F.count_if(F.col("f1") >= near).alias("nearly_perfect"))


def confusion_matrix(df: DataFrame, labels: list[str], true: str = "label", pred: str = "pred") -> DataFrame:
    """One row per true class, a column per label, zero filled."""
    return df.groupBy(F.col(true).alias("true")).pivot(pred, sorted(labels)).count().na.fill(0)


def confidence_bands(df: DataFrame, true: str = "label", pred: str = "pred", conf: str = "confidence") -> DataFrame:
    hit, c = F.col(true) == F.col(pred), F.col(conf)
    count = lambda test: F.count_if(test)
    return df.agg(F.count("*").alias("total"), count(hit).alias("correct"), count(hit & (c > 0.8)).alias("correct_high"), count(hit & (c > 0.5) & (c <= 0.8)).alias("correct_medium"), count(hit & (c <= 0.5)).alias("correct_low"), F.round(F.avg(c), 6).alias("avg_confidence"))


def amount_range(amount, ranges=AMOUNT_RANGES):
    a, out = F.coalesce(amount, F.lit(0.0)), None
    for name, _, high in ranges:
        if high is not None:
            out = F.when(a <= high, name) if out is None else out.when(a <= high, name)
    return out.otherwise(ranges[-1][0])


def accuracy_by_amount(df: DataFrame, true: str = "label", pred: str = "pred", amount: str = "amount", ranges=AMOUNT_RANGES) -> DataFrame:
    """(range, n, accuracy); empty ranges are listed with 0 rows."""
    hit = (F.col(true) == F.col(pred)).cast("double")
    some = df.groupBy(amount_range(F.col(amount), ranges).alias("range")).agg(F.count("*").alias("n"), F.round(F.avg(hit), 6).alias("accuracy"))
    names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(r[0]) for r in ranges])).alias("range"))
    return names.join(some, "range", "left").select("range", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "accuracy")


def disparity(by_group: DataFrame, bound: float = DISPARITY) -> DataFrame:
    gap = F.max("accuracy") - F.min("accuracy")
    return by_group.agg(F.round(gap, 6).alias("disparity"), (F.round(gap, 6) > bound).alias("flagged"))


def accuracy_by_class(df: DataFrame, true: str = "label", pred: str = "pred") -> DataFrame:
    return df.groupBy(F.col(true).alias("class")).agg(F.count("*").alias("n"), F.round(F.avg((F.col(true) == F.col(pred)).cast("double")), 6).alias("accuracy"))


def minority_report(df: DataFrame, true: str = "label", pred: str = "pred", rows: int = MINORITY_ROWS, gap: float = MINORITY_GAP) -> DataFrame:
    """Mean accuracy of classes with few rows against the overall accuracy."""
    by = accuracy_by_class(df, true, pred)
    one = by.agg(F.round(F.sum(F.col("n") * F.col("accuracy")) / F.sum("n"), 6).alias("overall"), F.round(F.avg(F.when(F.col("n") < rows, F.col("accuracy"))), 6).alias("minority"), F.count_if(F.col("n") < rows).alias("classes"))
    return one.withColumn("flagged", F.coalesce(F.col("minority") < F.col("overall") - gap, F.lit(False)))


def best_and_worst(report: DataFrame, k: int = 5) -> DataFrame:
    """The k best and k worst classes by F1; ties by name."""
    r = report.where("support > 0").select("class", "f1")
    best = r.orderBy(F.desc("f1"), "class").limit(k).withColumn("end", F.lit("best"))
    return best.unionByName(r.orderBy("f1", "class").limit(k).withColumn("end", F.lit("worst")))


def mcnemar(a: DataFrame, b: DataFrame, key: str, true: str = "label", pred: str = "pred") -> DataFrame:
    """Two models on the same rows: both right, one right, none right, and McNemar's statistic with continuity correction."""
    x = a.select(key, (F.col(true) == F.col(pred)).alias("x"))
    y = b.select(key, (F.col(true) == F.col(pred)).alias("y"))
    n = lambda p, q: F.count_if((F.col("x") == p) & (F.col("y") == q))
    one = x.join(y, key).agg(n(True, True).alias("both"), n(True, False).alias("only_a"), n(False, True).alias("only_b"), n(False, False).alias("neither"))
    d = F.abs(F.col("only_a") - F.col("only_b")) - 1
    return one.withColumn("statistic", F.round(F.coalesce(F.try_divide(d * d, F.col("only_a") + F.col("only_b")), F.lit(0.0)), 6))


def batch_stats(df: DataFrame) -> DataFrame:
    """Counts and means of a routed batch: total, average confidence, reviews, unanimous votes."""
    n = F.count("*")
    review = F.count_if("requires_review")
    unanimous = F.count_if(F.col("method").contains("unanimous"))
    share = lambda c: F.round(F.coalesce(F.try_divide(100.0 * c, n), F.lit(0.0)), 1)
    return df.agg(n.alias("total"), F.round(F.avg("confidence"), 3).alias("avg_confidence"), review.alias("review_count"), share(review).alias("review_percent"), unanimous.alias("unanimous_count"), share(unanimous).alias("unanimous_percent"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def agreement_distribution(df: DataFrame) -> DataFrame:
    """How many rows had three, two, or at most one method behind the winner; confidence bands; reviews."""
    a, c = F.col("vote.agreement"), F.col("confidence")
    return df.agg(F.count_if(a >= 3).alias("three"), F.count_if(a == 2).alias("two"), F.count_if(a <= 1).alias("one"), F.count_if(c > 0.8).alias("high"), F.count_if((c > 0.5) & (c <= 0.8)).alias("medium"), F.count_if(c <= 0.5).alias("low"), F.count_if("requires_review").alias("reviews"))


def service_stats(df: DataFrame) -> DataFrame:
    """(total, accuracy, review_rate) of stored results; the mean confidence stands for accuracy, and 0 for figures of nothing."""
    zero = lambda c: F.coalesce(F.round(c, 6), F.lit(0.0))
    return df.agg(F.count("*").alias("total"), zero(F.avg(F.col("confidence").cast("double"))).alias("accuracy"), zero(F.try_divide(F.count_if("requires_review"), F.count("*"))).alias("review_rate"))


def run_report(df: DataFrame, true: str = "label", pred: str = "pred", latency: str = "latency_ms") -> DataFrame:
    """(total, correct, accuracy, and average, least and most confidence and latency) of a test run."""
    figures = [f(c).alias(f"{n}_{name}") if n != "avg" else F.round(f(c), 6).alias(f"{n}_{name}") for name, c in (("confidence", "confidence"), ("latency", latency)) for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))]
    hit = F.col(true) == F.col(pred)
    return df.agg(F.count("*").alias("total"), F.count_if(hit).alias("correct"), F.round(F.avg(hit.cast("int")), 6).alias("accuracy"), *figures)


def fairness(df: DataFrame, true: str = "label", pred: str = "pred") -> DataFrame:
    """(range, n, accuracy, confidence, review_rate) by five amount ranges."""
    hit = F.coalesce(F.col(true) == F.col(pred), F.lit(False)).cast("int")
    return df.where("amount IS NOT NULL").groupBy(range_of(FIVE_RANGES).alias("range")).agg(F.count("*").alias("n"), F.round(F.avg(hit), 6).alias("accuracy"), F.round(F.avg("confidence"), 6).alias("confidence"), F.round(F.avg(F.col("requires_review").cast("int")), 6).alias("review_rate"))


def range_of(ranges: list[tuple], amount: str = "amount"):
    """The name of the first range (name, above, up to) whose end an amount does not exceed."""
    out = None
    for name, _, high in ranges:
        test = F.col(amount) <= high if high is not None else F.col(amount).isNotNull()
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def chi_square(df: DataFrame, true: str = "label", pred: str = "pred") -> DataFrame:
    """(statistic, freedom): whether being right depends on the amount range, from the counts of both."""
    hit = F.coalesce(F.col(true) == F.col(pred), F.lit(False))
    cells = df.where("amount IS NOT NULL").groupBy(range_of(FIVE_RANGES).alias("range")).agg(F.count("*").alias("n"), F.count_if(hit).alias("right"))
    all_ = cells.agg(F.sum("n").alias("_n"), F.sum("right").alias("_right"), F.count("*").alias("_k"))  # one row
    share = F.col("_right") / F.col("_n")
    gap = (F.col("right") - F.col("n") * share) * (F.col("right") - F.col("n") * share)
    cell = F.try_divide(gap, F.col("n") * share) + F.try_divide(gap, F.col("n") * (1 - share))
    return cells.crossJoin(F.broadcast(all_)).agg(F.round(F.coalesce(F.sum(cell), F.lit(0.0)), 6).alias("statistic"), (F.max("_k") - 1).alias("freedom"))


def merchant_rollup(df: DataFrame, merchant: str = "merchant_resolved") -> DataFrame:
    """(merchant, n, avg_confidence) of each merchant."""
    return df.where(F.col(merchant).isNotNull()).groupBy(F.col(merchant).alias("merchant")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))
