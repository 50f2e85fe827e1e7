"""Importance resampling towards a target distribution: which documents look like the target's texts.

Texts are bags of hashed words and word pairs. Each bucket gains the logarithm of how much more often it occurs in
the target than in all documents, with one added to every bucket. A document weighs the mean gain of its features;
with Gumbel noise drawn from its id, the highest scores are a sample without replacement in proportion to the
weights, the same one in every run.

Features are made by Arrow kernels on batches: lower case, split by a pattern, flattened lists, a dictionary of the
words; pairs of neighbouring dictionary indices are the word pairs. CRCs are taken of distinct words and pairs alone.

Null texts have no words. Repeated rows are drawn one by one (of rows that tie in score and id, which one is drawn
shows in no column but extra ones). A null id counts as the empty text in the noise and stands first among ties.
With no target text all of a bucket's gains come from the documents' counts; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, small_arrow_batches, small_batches, table, utf8

BUCKETS, LEAST_WORDS, SHARE = 10_000, 20, 25
#: What stands between words, once A-Z are lower case: ASCII but digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Scores that share a coarse step when ranks are counted.
STEP = 256


def features(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words of a batch and the row of each, then buckets of the word pairs and their rows."""
    # offsets from 0: a cast of a part of a batch keeps those of the whole, with which `ascii_lower` reads other bytes
    data, offsets = utf8(texts)
    whole = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(data))
    lists = pc.split_pattern_regex(pc.ascii_lower(whole), pattern=SEPARATORS)
    words, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.not_equal(words, "")
    words, rows = words.filter(full), rows.filter(full).to_numpy(zero_copy_only=False)
    coded = pc.dictionary_encode(words)
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    known = coded.dictionary.cast(pa.large_binary()).to_pylist()
    single = [zlib.crc32(w) for w in known]
    spaced = [zlib.crc32(b" ", c) for c in single]
    together = rows[1:] == rows[:-1]
    pairs = pc.dictionary_encode(pa.array((index[:-1] * max(1, len(known)) + index[1:])[together]))
    first, second = np.divmod(pairs.dictionary.to_numpy(zero_copy_only=False), max(1, len(known)))
    double = [zlib.crc32(known[b], spaced[a]) for a, b in zip(first.tolist(), second.tolist(), strict=True)]
    of_word, of_pair = (pa.array(np.array(x, np.int64) % buckets) for x in (single, double))
    take = lambda bucket, at: pc.take(bucket, at).to_numpy(zero_copy_only=False)
    return take(of_word, coded.indices), rows, take(of_pair, pairs.indices), rows[1:][together]


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how often each bucket occurs in all texts; buckets that never occur are missing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in small_batches(batch, text):
                words, _, pairs, _ = features(part.column(0), buckets)
                total += np.bincount(words, minlength=buckets) + np.bincount(pairs, minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["bucket", "n"])

    small_arrow_batches(texts.sparkSession)
    partial = texts.select(F.col(text).cast("string").alias(text)).mapInArrow(count, "bucket bigint, n bigint")
    return partial.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, in thousandths; the driver holds these `buckets` numbers and no more."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, texts in ((s, raw), (t, target)):
        for bucket, n in bucket_counts(texts, text, buckets).collect():
            counts[bucket] = n
    over, under = int(s.sum()) + buckets, int(t.sum()) + buckets
    return np.array([math.floor(1000 * math.log(float((b + 1) * over) / float((a + 1) * under))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weighted(docs: DataFrame, gains: np.ndarray, text: str = "text") -> DataFrame:
    """`docs` without its text, with n_words, n_features and weight (the floored mean gain of its features)."""
    buckets = len(gains)
    kept = [c for c in docs.columns if c not in {text, "n_words", "n_features", "weight"}]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = pa.array(gains)
        for batch in batches:
            for part in small_batches(batch, "_text"):
                words, row, pairs, row_of_pair = features(part.column(len(kept)), buckets)
                n, total = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
                for bucket, rows in ((words, row), (pairs, row_of_pair)):
                    if len(rows):
                        begins = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
                        total[rows[begins]] += np.add.reduceat(pc.take(gain, pa.array(bucket)).to_numpy(zero_copy_only=False), begins)
                        n[rows[begins]] += np.diff(np.append(begins, len(rows)))
                weight = np.floor_divide(total, np.maximum(n, 1))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array((n + 1) // 2), pa.array(n), pa.array(weight)], names=[*kept, "n_words", "n_features", "weight"])

    small_arrow_batches(docs.sparkSession)
    rows = docs.select(*kept, F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(weigh, rows.drop("_text").schema.add("n_words", "long").add("n_features", "long").add("weight", "long"))


def noise(doc_id, seed: int):
    """Gumbel noise in thousandths, from the id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def importance_resample(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text: str = "text", share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """`docs` without its text, with n_words, n_features, weight, score and rank.

    Of the documents with `least_words` words or more, `share` percent (rounded down) are drawn: those with the
    highest scores, ties going to the smaller id. `rank` counts them from 1; it is null for all others.

    Ranks come from counts per score. Scores are thousandths of logarithms, so that there are some ten thousands
    of them whatever the rows; noise spreads equal texts over them.
    """
    gains = bucket_gains(docs, target, text, buckets)
    clean = docs.drop("score", "rank")
    scored = materialise(weighted(clean, gains, text).withColumn("score", F.col("weight") + noise(F.col(id_column), seed)))
    counts = scored.where(F.col("n_words") >= least_words).groupBy("score").agg(F.count("*").alias("_n")).withColumn("_step", F.floor(F.col("score") / STEP))
    steps = counts.groupBy("_step").agg(F.sum("_n").alias("_rows"))
    above = F.sum("_rows").over(Window.orderBy(F.desc("_step")).rowsBetween(Window.unboundedPreceding, -1))  # a row a coarse step: about a hundred
    every = F.sum("_rows").over(Window.orderBy(F.desc("_step")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    steps = steps.select("_step", F.coalesce(above, F.lit(0)).alias("_above"), F.floor(every * share / 100).alias("_drawn"))
    within = F.coalesce(F.sum("_n").over(Window.partitionBy("_step").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.withColumn("_within", within).join(F.broadcast(steps), "_step").select("score", (F.col("_above") + F.col("_within")).alias("_before"), "_drawn")
    near = scored.join(F.broadcast(first.where("_before < _drawn")), "score", "left")  # bounded by the range of scores
    may = (F.col("n_words") >= least_words) & F.col("_before").isNotNull()
    nth = F.row_number().over(Window.partitionBy("score").orderBy(F.col(id_column).asc_nulls_first(), "weight", "n_features"))
    ranked = near.where(may).withColumn("_rank", F.col("_before") + nth)
    rank = F.when(F.col("_rank") <= F.col("_drawn"), F.col("_rank")).cast("long").alias("rank")
    order = [c for c in scored.columns]
    return ranked.select(*order, rank).unionByName(near.where(~F.coalesce(may, F.lit(False))).select(*order, F.lit(None).cast("long").alias("rank")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; `benchmark` is the target."""
    drawn = importance_resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 of features by its table, as the other engine has no such function.
ORACLE_SQL = r"""
WITH table_step AS (SELECT b, list_reduce(range(8), lambda acc, i: CASE WHEN acc % 2 = 1 THEN xor(acc // 2, 3988292384) ELSE acc // 2 END, b) AS v FROM (SELECT unnest(range(256))::BIGINT AS b)),
tab AS (SELECT list(v ORDER BY b) AS t FROM table_step),
texts AS (SELECT 'd' AS kind, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
words AS (SELECT kind, id, regexp_extract_all(x, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
feats AS (SELECT kind, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words),
crcs AS (SELECT f, list_reduce(list_transform(range(1, octet_length(encode(f)) + 1), lambda i: ('0x' || substr(hex(encode(f)), 2 * i - 1, 2))::BIGINT),
    lambda acc, y: xor(acc // 256, t[xor(acc % 256, y) + 1]), 4294967295) AS c FROM (SELECT DISTINCT f FROM feats), tab),
hashed AS (SELECT kind, id, xor(c, 4294967295) % 10000 AS bucket FROM feats JOIN crcs USING (f)),
counts AS (SELECT b AS bucket, coalesce(sum((kind = 'd')::INT), 0)::BIGINT AS s, coalesce(sum((kind = 'b')::INT), 0)::BIGINT AS t
  FROM (SELECT unnest(range(10000)) AS b) LEFT JOIN hashed ON bucket = b GROUP BY b),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000))::DOUBLE / ((s + 1) * (sum(t) OVER () + 10000))::DOUBLE))::BIGINT AS g FROM counts),
sums AS (SELECT id, count(*) AS n, sum(g) AS total FROM hashed JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY id),
scored AS (SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(total::DOUBLE / n), 0)::BIGINT AS weight,
    coalesce(floor(total::DOUBLE / n), 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || d.doc_id), 1, 8))::BIGINT + 0.5) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents d LEFT JOIN sums ON id = d.doc_id),
ranked AS (SELECT *, n_features >= 39 AS may, row_number() OVER (PARTITION BY n_features >= 39 ORDER BY score DESC, doc_id) AS r, floor(25 * count(*) FILTER (n_features >= 39) OVER () / 100) AS k FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND r <= k THEN r END AS rank FROM ranked
"""
