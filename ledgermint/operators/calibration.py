"""Calibration of class probabilities: isotonic regression of all classes at once, on out-of-fold scores.

Rows are dealt into folds by a hash of their key, and each fold is scored by a model that was fitted on the others.
Scores are then summed per class and step of the score, and adjacent steps are pooled where their shares of hits fall:
a sum over rows, whatever the number of classes, and a small table of steps at the end of it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scores are told apart in so many steps between 0 and 1.
STEPS = 1000


def fold_of(key: str, folds: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(folds))


def out_of_fold(rows: DataFrame, key: str, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], folds: int = 3) -> DataFrame:
    """`rows` with `fold` and what a model gives that was fitted on the other folds: `fit` takes rows and returns a scoring function. One fit per fold."""
    dealt = rows.withColumn("fold", fold_of(key, folds))
    parts = [fit(dealt.where(F.col("fold") != k))(dealt.where(F.col("fold") == k)) for k in range(folds)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def step_sums(scored: DataFrame, labels: list[str], label: str = "label", probability: str = "probability", steps: int = STEPS, weight: str | None = None) -> DataFrame:
    """(class, step, x, hits, n): per class, the mean score, the rows of the class and all rows of each step of the score. One pass for all classes."""
    p = F.col(probability) if dict(scored.dtypes)[probability].startswith("array") else vector_to_array(probability)
    names = F.array(*[F.lit(x) for x in labels])
    w = F.col(weight) if weight else F.lit(1.0)
    each = scored.select(F.col(label).alias("_l"), w.alias("_w"), F.posexplode(p).alias("_i", "_p")).withColumn("class", F.get(names, F.col("_i")))
    keyed = each.groupBy("class", F.least(F.floor(F.col("_p") * steps), F.lit(steps - 1)).cast("int").alias("step"))
    return keyed.agg(F.sum(F.col("_p") * F.col("_w")).alias("x"), F.sum(F.when(F.col("_l") == F.col("class"), F.col("_w")).otherwise(0.0)).alias("hits"), F.sum("_w").alias("n")).withColumn("x", F.col("x") / F.col("n"))


def pooled(steps: pd.DataFrame) -> pd.DataFrame:
    """Adjacent violators of one class pooled: (class, low, high, value) of each block, with mean scores of its first and last step."""
    s = steps.sort_values("x")
    blocks: list[list[float]] = []  # hits, rows, first x, last x
    for x, hits, n in zip(s["x"], s["hits"], s["n"], strict=True):
        blocks.append([hits, n, x, x])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            h, m, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + h, blocks[-1][1] + m, blocks[-1][2], last]
    a = np.array(blocks)
    return pd.DataFrame({"class": s["class"].iloc[0], "low": a[:, 2], "high": a[:, 3], "value": a[:, 0] / a[:, 1]})


def isotonic(sums: DataFrame) -> DataFrame:
    """(class, low, high, value): the isotonic regression of each class, from `step_sums`: one small group of steps a class."""
    return sums.groupBy("class").applyInPandas(pooled, "class string, low double, high double, value double")


def curve_points(curves: DataFrame) -> DataFrame:
    """(class, points): the corners of each class's curve as an array of (x, y), in order; a block gives its two ends."""
    ends = F.array(F.struct(F.col("low").alias("x"), F.col("value").alias("y")), F.struct(F.col("high").alias("x"), F.col("value").alias("y")))
    return curves.select("class", F.explode(ends).alias("p")).groupBy("class").agg(F.array_distinct(F.array_sort(F.collect_list("p"))).alias("points"))


def on_curve(points: Column, x: Column) -> Column:
    """The value of a curve at x, linear between its corners and constant beyond them."""
    below, above = F.filter(points, lambda p: p["x"] <= x), F.filter(points, lambda p: p["x"] > x)
    last, first = F.get(below, F.size(below) - 1), F.get(above, F.lit(0))
    inner = last["y"] + (first["y"] - last["y"]) * (x - last["x"]) / (first["x"] - last["x"])
    return F.when(F.size(below) == 0, first["y"]).when(F.size(above) == 0, last["y"]).otherwise(inner)


def calibrated(scored: DataFrame, curves: DataFrame, labels: list[str], probability: str = "probability") -> DataFrame:
    """`scored` with `calibrated`: each class's probability on its curve, divided by their sum; as it was where the sum is 0 or a class has no curve.

    The curves, a row per class of at most twice the steps, go along as one row.
    """
    p = F.col(probability) if dict(scored.dtypes)[probability].startswith("array") else vector_to_array(probability)
    by_class = {r["class"]: [(float(q["x"]), float(q["y"])) for q in r["points"]] for r in curve_points(curves).collect()}  # bounded: classes times steps
    kind = "array<struct<x:double,y:double>>"
    listed = F.array(*[F.from_json(F.lit("[" + ",".join(f'{{"x":{x!r},"y":{y!r}}}' for x, y in by_class.get(name, [])) + "]"), kind) for name in labels])
    raw = F.zip_with(p, listed, lambda x, points: F.when(F.size(points) > 0, on_curve(points, x)).otherwise(x))
    out = scored.withColumn("_raw", raw)
    total = F.aggregate("_raw", F.lit(0.0), lambda a, x: a + x)
    return out.withColumn("calibrated", F.when(total > 0, F.transform("_raw", lambda x: x / total)).otherwise(p)).drop("_raw")
