"""Multi-class gradient boosting: a tree per class and round, grown from distributed histograms of gradients.

Features are dealt into bins once, by quantiles of all rows. For each level of the trees one job sums gradients and
curvatures per (class, node, feature, bin): tasks sum what they hold, Spark adds the sums, and what reaches the driver
is one best split per class and node. Trees are small arrays that go along with the next job; no row ever does.

Rows keep their margins, which are written every few rounds, so that a pass applies few trees and a lost executor
repeats little. Labels, weights and features must not be null in a row that is used; others are left out of the fit.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgermint.functions.lineage import materialise

#: Rounds between two writes of the margins.
WRITE_EVERY = 5


@dataclass
class Tree:
    """A binary tree in arrays: node i has the children 2i + 1 and 2i + 2; rows with a bin up to `bin` go left. A feature of -1 is a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node in which each row of bins ends."""
        at = np.zeros(len(bins), np.int64)
        for _ in range(int(np.log2(len(self.feature) + 1)) - 1):
            f = self.feature[at]
            inner = f >= 0
            left = bins[np.arange(len(bins)), np.maximum(f, 0)] <= self.bin[at]
            at = np.where(inner, 2 * at + 2 - left, at)
        return at


@dataclass
class BoostedTrees:
    """A fitted model: class names, base margins, bin edges per feature, and per round a tree of each class."""

    labels: list[str]
    base: np.ndarray
    edges: list[np.ndarray]
    rounds: list[list[Tree]] = field(default_factory=list)
    gains: np.ndarray | None = None

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1).astype(np.uint8) if len(self.edges) else np.zeros((len(x), 0), np.uint8)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x)
        return softmax(added(np.tile(self.base, (len(x), 1)), self.rounds, bins))

    def to_json(self) -> str:
        trees = [[[t.feature.tolist(), t.bin.tolist(), t.value.tolist()] for t in r] for r in self.rounds]
        return json.dumps({"labels": self.labels, "base": self.base.tolist(), "edges": [e.tolist() for e in self.edges], "rounds": trees, "gains": self.gains.tolist()})

    @staticmethod
    def from_json(text: str) -> BoostedTrees:
        d = json.loads(text)
        trees = [[Tree(np.array(f), np.array(b), np.array(v, float)) for f, b, v in r] for r in d["rounds"]]
        return BoostedTrees(d["labels"], np.array(d["base"]), [np.array(e, float) for e in d["edges"]], trees, np.array(d["gains"]))


def softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def added(margins: np.ndarray, rounds: list[list[Tree]], bins: np.ndarray) -> np.ndarray:
    """Margins with those of further rounds."""
    for trees in rounds:
        margins = margins + np.stack([t.value[t.leaves(bins)] for t in trees], 1)
    return margins


def bin_edges(rows: DataFrame, features: str, bins: int) -> list[np.ndarray]:
    """Up to bins - 1 edges per feature: its approximate quantiles, each once. One row a feature is collected."""
    shares = [k / bins for k in range(1, bins)]
    each = rows.select(F.posexplode(features).alias("j", "x")).where("x IS NOT NULL")
    found = each.groupBy("j").agg(F.percentile_approx("x", shares, 10_000).alias("q")).collect()
    width = rows.agg(F.max(F.size(features))).first()[0] or 0
    by = {r["j"]: np.unique(np.array(r["q"], float)) for r in found}
    return [by.get(j, np.empty(0)) for j in range(width)]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)


def histograms(rows: DataFrame, model: BoostedTrees, recent: list[list[Tree]], growing: list[Tree], level: int, bins: int) -> DataFrame:
    """(class, node, feature, g_0.., h_0..): sums of gradients and curvatures of each bin, for the nodes of a level. `rows` is (y, w, bins, margins)."""
    classes, width = len(model.labels), len(model.edges)
    first, nodes = 2**level - 1, 2**level
    names = [f"g_{b}" for b in range(bins)] + [f"h_{b}" for b in range(bins)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((classes, nodes, width, bins, 2))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            y, w = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(n, width)
            p = softmax(added(_matrix(batch.column(3), classes), recent, x))
            for k in range(classes):
                g, h = w * (p[:, k] - (y == k)), w * p[:, k] * (1 - p[:, k])
                node = growing[k].leaves(x) - first
                here = np.flatnonzero(node >= 0)
                cell = (node[here, None] * width + np.arange(width)) * bins + x[here]
                for part, v in enumerate((g, h)):
                    total[k, ..., part] += np.bincount(cell.ravel(), np.repeat(v[here], width), nodes * width * bins).reshape(nodes, width, bins)
        k, node, feature = np.nonzero(np.abs(total).sum((3, 4)) > 0)
        cells = total[k, node, feature]
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(node + first), pa.array(feature), *[pa.array(cells[:, b, part]) for part in range(2) for b in range(bins)]], names=["class", "node", "feature", *names])

    schema = "class bigint, node bigint, feature bigint, " + ", ".join(f"{c} double" for c in names)
    return rows.select("y", "w", "bins", "margins").mapInArrow(sums, schema).groupBy("class", "node", "feature").agg(*[F.sum(c).alias(c) for c in names])


def split_gains(g: np.ndarray, h: np.ndarray, l2: float, least: float) -> np.ndarray:
    """The gain of a split after each bin of a feature (last axis); -inf where a side has less curvature than `least`."""
    gl, hl = g.cumsum(-1)[..., :-1], h.cumsum(-1)[..., :-1]
    gt, ht = g.sum(-1, keepdims=True), h.sum(-1, keepdims=True)
    gr, hr = gt - gl, ht - hl
    gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - gt**2 / (ht + l2)
    return np.where((hl >= least) & (hr >= least), gain, -np.inf)


def best_splits(hist: DataFrame, bins: int, l2: float, least: float) -> DataFrame:
    """(class, node, feature, bin, gain, left, right) of each class and node: the split of the largest gain, ties to the first feature and bin, with the Newton steps of both sides."""

    def best(group: pd.DataFrame) -> pd.DataFrame:
        s = group.sort_values("feature")
        g, h = s[[f"g_{b}" for b in range(bins)]].to_numpy(), s[[f"h_{b}" for b in range(bins)]].to_numpy()
        gain = np.round(split_gains(g, h, l2, least), 9)
        i, b = np.unravel_index(np.argmax(gain), gain.shape)
        if not gain[i, b] > 0:
            return pd.DataFrame(columns=["class", "node", "feature", "bin", "gain", "left", "right"])
        gl, hl = g[i, : b + 1].sum(), h[i, : b + 1].sum()
        gr, hr = g[i, b + 1 :].sum(), h[i, b + 1 :].sum()
        return pd.DataFrame([(s["class"].iloc[0], s["node"].iloc[0], s["feature"].iloc[i], b, gain[i, b], -gl / (hl + l2), -gr / (hr + l2))], columns=["class", "node", "feature", "bin", "gain", "left", "right"])

    return hist.groupBy("class", "node").applyInPandas(best, "class bigint, node bigint, feature bigint, bin bigint, gain double, left double, right double")


def fit(rows: DataFrame, features: str = "features", label: str = "label", weight: str | None = None, rounds: int = 20, depth: int = 3, bins: int = 32, rate: float = 0.3, l2: float = 1.0, least: float = 1e-3) -> BoostedTrees:
    """Boosted trees of `rounds` rounds. `features` is an array of numbers of one length (or a vector); bins are at most 256."""
    x = F.col(features) if dict(rows.dtypes)[features].startswith("array") else vector_to_array(features)
    used = rows.select(F.col(label).cast("string").alias("l"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), x.cast("array<double>").alias("x")).where("l IS NOT NULL AND w IS NOT NULL AND x IS NOT NULL")
    counts = sorted((r["l"], r["n"]) for r in used.groupBy("l").agg(F.sum("w").alias("n")).collect())  # a row a class
    labels, shares = [l for l, _ in counts], np.array([n for _, n in counts], float)
    if not labels:
        raise ValueError("no row has a label, a weight and features")
    model = BoostedTrees(labels, np.log(np.maximum(shares, 1e-12) / shares.sum()), bin_edges(used, "x", bins))
    width, classes, base = len(model.edges), len(labels), model.base
    model.gains = np.zeros(width)
    number = F.array_position(F.array(*[F.lit(l) for l in labels]), F.col("l")).cast("long") - 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = model.binned(_matrix(batch.column(2), width))
            margins = pa.FixedSizeListArray.from_arrays(pa.array(np.tile(base, batch.num_rows)), classes).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), margins], names=["y", "w", "bins", "margins"])

    work = materialise(used.select(number.alias("y"), "w", "x").mapInArrow(deal, "y bigint, w double, bins binary, margins array<double>"))
    recent: list[list[Tree]] = []
    for r in range(rounds):
        size = 2 ** (depth + 1) - 1
        trees = [Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)) for _ in labels]
        for level in range(depth):
            found = best_splits(histograms(work, model, recent, trees, level, bins), bins, l2, least).collect()  # one row a class and node
            for s in found:
                t, i = trees[s["class"]], s["node"]
                t.feature[i], t.bin[i] = s["feature"], s["bin"]
                t.value[2 * i + 1], t.value[2 * i + 2] = rate * s["left"], rate * s["right"]
                model.gains[s["feature"]] += s["gain"]
            if not found:
                break
        model.rounds.append(trees)
        recent.append(trees)
        if len(recent) == WRITE_EVERY and r + 1 < rounds:
            work, recent = materialise(_advanced(work, recent, width, classes)), []
    return model


def _advanced(work: DataFrame, recent: list[list[Tree]], width: int, classes: int) -> DataFrame:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, width)
            m = added(_matrix(batch.column(3), classes), recent, x)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), classes).cast(pa.list_(pa.float64()))], names=["y", "w", "bins", "margins"])

    return work.mapInArrow(step, work.schema)


def probabilities(model: BoostedTrees, features: Column) -> Column:
    """Class probabilities of rows of features, in the order of the model's labels; null where the features are."""
    width = len(model.edges)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def score(x: pa.Array) -> pa.Array:
        there = x.is_valid().to_numpy(zero_copy_only=False)
        out: list = [None] * len(x)
        if there.any():
            p = model.probabilities(_matrix(x.filter(x.is_valid()), width))
            for i, row in zip(np.flatnonzero(there).tolist(), p.tolist(), strict=True):
                out[i] = row
        return pa.array(out, pa.list_(pa.float64()))

    return score(features.cast("array<double>"))


class BoostedModel:
    """Boosted trees behind the stages that make their features: `transform` adds `probability` (an array)."""

    def __init__(self, stages, trees: BoostedTrees, features: str):
        self.stages, self.trees, self.features, self.labels = stages, trees, features, trees.labels

    def transform(self, rows: DataFrame) -> DataFrame:
        made = self.stages.transform(rows) if self.stages is not None else rows
        x = F.col(self.features) if dict(made.dtypes)[self.features].startswith("array") else vector_to_array(self.features)
        return made.withColumn("probability", probabilities(self.trees, x))

    def save(self, path: str, spark: SparkSession) -> None:
        if self.stages is not None:
            self.stages.write().overwrite().save(f"{path}/stages")
        spark.createDataFrame([(self.trees.to_json(), self.features, self.stages is not None)], "trees string, features string, staged boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")

    @staticmethod
    def load(path: str, spark: SparkSession) -> BoostedModel:
        from pyspark.ml import PipelineModel

        r = spark.read.parquet(f"{path}/trees").first()
        return BoostedModel(PipelineModel.load(f"{path}/stages") if r["staged"] else None, BoostedTrees.from_json(r["trees"]), r["features"])
