"""Learned vectors of words and texts: a low-rank factorisation of which words stand near each other.

Words within a window of each other are counted over all texts. The counts become positive pointwise mutual
information, a sparse symmetric matrix held as (word, other, value) rows. Its leading directions are found by
subspace iteration from a start that hashes give: a product with the matrix is a join and sums, the small
Gram matrix (size x size) that makes directions orthogonal again is summed over tasks. Only such small matrices
reach the driver. Words that stand in the same company get near vectors, whether or not they share a letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgermint.functions.lineage import materialise

#: Words of a small vocabulary may be broadcast with their vectors.
MOST_WORDS = 100_000


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits; numbers are one word, so that they are no vocabulary of their own."""
    found = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    return F.transform(found, lambda w: F.when(w.rlike("^[0-9]+$"), F.lit("0")).otherwise(w))


def cooccurrence(texts: DataFrame, text: str = "text", window: int = 4) -> DataFrame:
    """(word, other, n): how often two words stand at most `window` places apart in a text, both ways, counted over all texts.

    Texts of equal words, which may differ in their numbers, are counted once and weighed. The counts are written, since
    totals and values are made of them.
    """
    placed = texts.select(words_of(F.col(text)).alias("_w")).groupBy("_w").agg(F.count("*").alias("_m"))
    near = F.flatten(F.transform("_w", lambda w, i: F.transform(F.slice("_w", i + 2, window), lambda o: F.struct(w.alias("word"), o.alias("other")))))
    pairs = placed.where(F.size("_w") > 1).select("_m", F.explode(near).alias("p")).groupBy("p.word", "p.other").agg(F.sum("_m").alias("n"))
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other"), "n"))
    return materialise(both.groupBy("word", "other").agg(F.sum("n").alias("n")))


def information(pairs: DataFrame, least: int = 1) -> DataFrame:
    """(word, other, value): positive pointwise mutual information of words with `least` neighbours or more."""
    totals = pairs.groupBy("word").agg(F.sum("n").alias("t")).where(F.col("t") >= least)
    every = totals.agg(F.sum("t")).first()[0] or 0
    a, b = totals.select("word", F.col("t").alias("_a")), totals.select(F.col("word").alias("other"), F.col("t").alias("_b"))
    value = F.log(F.col("n") * F.lit(float(every)) / (F.col("_a") * F.col("_b")))
    return pairs.join(a, "word").join(b, "other").select("word", "other", value.alias("value")).where("value > 0")


def _product(matrix: DataFrame, vectors: DataFrame, size: int) -> DataFrame:
    """(word, v): the rows of matrix times vectors."""
    joined = matrix.join(vectors.select(F.col("word").alias("other"), "v"), "other")
    return joined.groupBy("word").agg(F.array(*[F.sum(F.col("value") * F.get("v", F.lit(k))) for k in range(size)]).alias("v"))


def _gram(left: DataFrame, size: int, other: str | None = None) -> np.ndarray:
    """The sum over words of the outer products of `v` with itself or with the column `other`; size x size numbers are collected."""
    columns = ["v", other or "v"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                a, b = (np.asarray(c.flatten().to_numpy(zero_copy_only=False)).reshape(-1, size) for c in batch.columns)
                total += a.T @ b
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(size), size)), pa.array(np.tile(np.arange(size), size)), pa.array(total.ravel())], names=["i", "j", "x"])

    named = left.select(F.col(columns[0]).alias("a"), F.col(columns[1]).alias("b"))
    out = np.zeros((size, size))
    for r in named.mapInArrow(sums, "i bigint, j bigint, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        out[r["i"], r["j"]] = r["x"]
    return out


def _turned(vectors: DataFrame, by: np.ndarray) -> DataFrame:
    """`v` times a small matrix."""
    size = by.shape[1]

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, len(by)) @ by
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(a.ravel()), size).cast(pa.list_(pa.float64()))], names=["word", "v"])

    return vectors.select("word", "v").mapInArrow(turn, "word string, v array<double>")


def _orthogonal(vectors: DataFrame, size: int) -> DataFrame:
    values, directions = np.linalg.eigh(_gram(vectors, size))
    keep = values > values.max(initial=0.0) * 1e-10
    return _turned(vectors, directions * np.where(keep, 1 / np.sqrt(np.where(keep, values, 1.0)), 0.0))


def word_vectors(texts: DataFrame, text: str = "text", size: int = 32, window: int = 4, least: int = 1, steps: int = 4, seed: int = 7) -> DataFrame:
    """(word, v): vectors of length one, equal up to rounding in every run. Two jobs a step, each a pass over the matrix."""
    matrix = materialise(information(cooccurrence(texts, text, window), least))
    start = F.array(*[F.xxhash64(F.lit(seed), F.lit(k), "word") / F.lit(float(1 << 63)) for k in range(size)])
    vectors = matrix.select("word").distinct().withColumn("v", start)
    for _ in range(steps):
        vectors = materialise(_orthogonal(materialise(_product(matrix, vectors, size)), size))
    moved = _product(matrix, vectors, size).withColumnRenamed("v", "u")
    both = materialise(vectors.join(moved, "word"))
    core = _gram(both, size, "u")
    values, directions = np.linalg.eigh((core + core.T) / 2)
    order = np.argsort(-np.abs(values), kind="stable")
    directions = directions[:, order] * np.where(directions[:, order].sum(0) < 0, -1.0, 1.0)
    scaled = _turned(both.select("word", "v"), directions * np.sqrt(np.abs(values[order])))
    return scaled.select("word", unit(F.col("v")).alias("v"))


def unit(v: Column) -> Column:
    """A vector divided by its length; a null vector stays."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: F.when(length > 0, x / length).otherwise(x))


def text_vectors(rows: DataFrame, words: DataFrame, key: str, text: str = "text", size: int = 32, rare: float = 1e-3) -> DataFrame:
    """`rows` with `text_vector`: the mean of their words' vectors, rare words weighing more, of length one; zeros where no word has one.

    Distinct texts are embedded once. The words are broadcast within a bound, else joined by a shuffle.
    """
    texts = rows.select(F.col(text).alias("_x")).where("_x IS NOT NULL").distinct()
    each = texts.select("_x", F.explode(words_of(F.col("_x"))).alias("word"))
    counts = each.groupBy("word").agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 1
    known = materialise(words.join(counts, "word").withColumn("_w", rare / (rare + F.col("_n") / total)))
    known = F.broadcast(known) if known.count() <= MOST_WORDS else known
    sums = each.join(known, "word").groupBy("_x").agg(F.array(*[F.sum(F.get("v", F.lit(k)) * F.col("_w")) for k in range(size)]).alias("text_vector"))
    zeros = F.array(*[F.lit(0.0)] * size)
    return rows.join(sums.withColumn("text_vector", unit(F.col("text_vector"))), F.col(text) == F.col("_x"), "left").withColumn("text_vector", F.coalesce("text_vector", zeros)).drop("_x")


def neighbours(words: DataFrame, chosen: list[str], k: int = 5) -> DataFrame:
    """(word, other, similarity, rank): the nearest words of each chosen word, looked for among all words."""
    asked = words.where(F.col("word").isin(*chosen)).select("word", "v").collect()
    names, block = [r["word"] for r in asked], np.array([r["v"] for r in asked], float)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not names:
                continue
            v = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, -1)
            close, others = v @ block.T, batch.column(0).to_pylist()
            for j, name in enumerate(names):  # the best of a batch are enough
                best = np.argsort(-close[:, j], kind="stable")[: k + 1]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(best)), pa.array([others[i] for i in best]), pa.array(close[best, j])], names=["word", "other", "similarity"])

    found = words.select("word", "v").mapInArrow(near, "word string, other string, similarity double").where("word <> other").withColumn("similarity", F.round("similarity", 6))
    order = Window.partitionBy("word").orderBy(F.desc("similarity"), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
