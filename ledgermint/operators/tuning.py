"""Choice of the vote's weights: every vector of a grid is judged by macro F1 over stored votes, in one pass.

A row has a vote of each method, so for each vector it has a winner: a position in a list of its own categories.
Rows are counted by what they look like to the grid (their votes and their label) before anything is judged, and
what is shuffled then are counts per vector, true and predicted class, never rows times vectors.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vote import METHODS

#: Confidences are told apart to so many decimals.
DECIMALS = 6


def weight_grid(step: float = 0.1, methods: tuple[str, ...] = METHODS) -> list[dict[str, float]]:
    """All weights of the methods in steps that sum to one; a method may have none."""
    n = round(1 / step)
    return [dict(zip(methods, (round(k / n, 9) for k in (*ks, n - sum(ks))), strict=True)) for ks in product(range(n + 1), repeat=len(methods) - 1) if sum(ks) <= n]


def vote_patterns(votes: DataFrame, label: str = "label") -> DataFrame:
    """(label, <method>_category, <method>_conf, n): equal votes of equal labels as one row."""
    have = [m for m in METHODS if f"{m}_category" in votes.columns]
    cols = [F.col(f"{m}_category") for m in have] + [F.round(F.col(f"{m}_conf").cast("double"), DECIMALS).alias(f"{m}_conf") for m in have]
    return votes.select(F.col(label).alias("label"), *cols).groupBy(*["label", *[f"{m}_{x}" for x in ("category", "conf") for m in have]]).agg(F.count("*").alias("n"))


def judged_weights(votes: DataFrame, grid: list[dict[str, float]], label: str = "label") -> DataFrame:
    """(vector, weights, macro_f1, accuracy, rows) of each vector, numbered in the grid's order.

    The winner is that of `vote.vote`: the category with the largest sum of confidence times weight, ties to the
    method that comes first; where rule and model disagree, an external scorer with weight decides. A row without
    a vote is of the class Other. Macro F1 is the mean over the true classes.
    """
    have = [m for m in METHODS if f"{m}_category" in votes.columns]
    voted = [F.struct(F.col(f"{m}_category").alias("c"), F.coalesce(f"{m}_conf", F.lit(0.0)).alias("s"), F.lit(i).alias("at")) for i, m in enumerate(have)]
    rows = vote_patterns(votes, label).withColumn("_v", F.filter(F.array(*voted), lambda x: x["c"].isNotNull()))
    vectors = F.array(*[F.struct(F.lit(i).alias("vector"), F.array(*[F.lit(float(w.get(m, 0.0))) for m in have]).alias("w")) for i, w in enumerate(grid)])
    v = F.col("_v")

    def winner(w):
        total = lambda c: F.aggregate(F.filter(v, lambda x: x["c"] == c), F.lit(0.0), lambda a, x: a + x["s"] * F.get(w, x["at"]))
        sums = F.transform(F.array_distinct(F.transform(v, lambda x: x["c"])), lambda c, i: F.struct(F.round(total(c), 9).alias("score"), (-i).alias("order"), c.alias("c")))
        best = F.coalesce(F.array_max(sums)["c"], F.lit("Other"))
        if not {"rule", "ml", "llm"} <= set(have):
            return best
        decides = F.coalesce((F.get(w, F.lit(have.index("llm"))) > 0) & (F.col("rule_category") != F.col("ml_category")) & F.col("llm_category").isNotNull(), F.lit(False))
        return F.when(decides, F.col("llm_category")).otherwise(best)

    wins = F.transform(vectors, lambda x: F.struct(x["vector"].alias("vector"), winner(x["w"]).alias("pred")))
    # winners of one row are few: vectors that agree leave the row together
    by_pred = F.transform(F.array_distinct(F.transform("_wins", lambda x: x["pred"])), lambda p: F.struct(p.alias("pred"), F.transform(F.filter("_wins", lambda x: x["pred"] == p), lambda x: x["vector"]).alias("vectors")))
    grouped = rows.withColumn("_wins", wins).select("label", "n", F.explode(by_pred).alias("g")).groupBy("label", "g.pred", "g.vectors").agg(F.sum("n").alias("n"))
    pairs = grouped.select("label", "pred", "n", F.explode("vectors").alias("vector")).groupBy("vector", "label", "pred").agg(F.sum("n").alias("n"))
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)
    true = pairs.groupBy("vector", F.col("label").alias("class")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    predicted = pairs.groupBy("vector", F.col("pred").alias("class")).agg(F.sum("n").alias("predicted"))
    classes = true.join(predicted, ["vector", "class"], "left")
    # F1 is 2 tp / (support + predicted), 0 where nothing is right
    f1 = F.coalesce(2 * F.col("tp") / (F.col("support") + F.coalesce("predicted", F.lit(0))), F.lit(0.0))
    judged = classes.groupBy("vector").agg(F.round(F.avg(f1), 6).alias("macro_f1"), F.round(F.sum("tp") / F.sum("support"), 6).alias("accuracy"), F.sum("support").alias("rows"))
    named = F.create_map(*[x for i, w in enumerate(grid) for x in (F.lit(i), F.struct(*[F.lit(float(w.get(m, 0.0))).alias(m) for m in METHODS]))])
    return judged.select("vector", named[F.col("vector")].alias("weights"), "macro_f1", "accuracy", "rows")


def best_weights(judged: DataFrame) -> DataFrame:
    """The vector of the highest macro F1; ties by accuracy, then by the grid's order."""
    return judged.orderBy(F.desc("macro_f1"), F.desc("accuracy"), "vector").limit(1)
