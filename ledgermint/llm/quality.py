"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector: hashed lower-cased words with their share of the text, one-hot bins
of structure statistics (shares of character classes, marked words, repetition, word lengths), and
one-hot bins of metadata that the text itself has (bytes, words, lines). The score is

    sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

whose last term is all pairwise interactions at rank f, in time linear in the entries.

Training uses at most `SAMPLE` labelled documents, chosen by a hash of the id over the whole table:
the documented bound on what reaches the driver. Scores cover whole texts.

Null counts as empty; an empty text has a score like any other. Without labelled rows the score is
0.5. Repeated rows get equal scores. Where labels repeat for an id, the lowest one counts. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, crc_bucket, table, utf8
from .kernels import LOWER, NOT_SPACE, U64, span_hashes, word_spans

WORDS, RANK, SAMPLE = 1 << 15, 8, 12000
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.02, 1e-4
THRESHOLD = 0.3
#: Words weigh so much against statistics.
WORD_WEIGHT = 2.0
#: Bins of one statistic.
BINS = 12
_STATS = ("bytes", "words", "lines", "upper", "digit", "mark", "bar", "space", "beyond", "marked_words", "repeated_next", "distinct", "word_length", "top_word", "long_line", "ends_open")
COLUMNS = WORDS + BINS * len(_STATS)


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _DIGIT = _class(bytes(range(65, 91))), _class(bytes(range(48, 58)))
_MARK, _BAR, _LINE = _class(b"!#$%&*+/<=>?@[\\]^_`{}~"), _class(b"|"), _class(b"\n")
_BEYOND = _class(bytes(range(128, 256)))


def _share_bin(x: np.ndarray) -> np.ndarray:
    """0 for none, then a bin for each doubling up to 1."""
    return np.where(x <= 0, 0, np.clip(BINS - 1 + np.floor(np.log2(np.maximum(x, 1e-9))), 1, BINS - 1)).astype(np.int64)


def _size_bin(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(np.log2(np.maximum(x, 0) + 1) * 0.75), 0, BINS - 1).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the non-zero entries of a batch of texts, by row."""
    n = len(offsets) - 1
    lowered = LOWER[data]
    starts, ends, rows = word_spans(lowered, offsets, NOT_SPACE)
    h = span_hashes(lowered, starts, ends)
    words = np.bincount(rows, minlength=n)
    size = np.diff(offsets)
    one = np.maximum(size, 1)

    def share(table_: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table_[data])])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / one

    at_least = np.maximum(words, 1)
    per_word = lambda flags: np.bincount(rows, weights=flags, minlength=n) / at_least
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
    bucket = (h >> U64(40)).astype(np.int64) % WORDS
    pair, count = np.unique(rows * WORDS + bucket, return_counts=True)
    row, column = pair // WORDS, pair % WORDS
    distinct = np.bincount(row, minlength=n) / at_least
    top = np.zeros(n)
    np.maximum.at(top, row, count)
    length = np.bincount(rows, weights=ends - starts, minlength=n) / at_least
    lines = share(_LINE) * one + 1
    last = np.where(size > 0, data[np.maximum(offsets[1:] - 1, 0)] if len(data) else 0, 32)
    stats = [
        _size_bin(size), _size_bin(words), _size_bin(lines), _share_bin(share(_UPPER)), _share_bin(share(_DIGIT)), _share_bin(share(_MARK)), _share_bin(share(_BAR)), _share_bin(share(~NOT_SPACE)),
        _share_bin(share(_BEYOND)), _share_bin(per_word(_MARK[data[ends - 1]] if len(ends) else np.zeros(0))), _share_bin(per_word(same)), np.clip((distinct * BINS).astype(np.int64), 0, BINS - 1),
        np.clip(length.astype(np.int64), 0, BINS - 1), _share_bin(top / at_least), _size_bin(size / lines), np.where(np.isin(last, (46, 33, 63)), 1, 0),
    ]
    k = len(stats)
    value = WORD_WEIGHT * count / np.sqrt(np.bincount(row, weights=count.astype(float) ** 2, minlength=n))[row]
    row = np.concatenate([row, np.repeat(np.arange(n), k)])
    column = np.concatenate([column, (np.stack(stats, axis=1) + WORDS + BINS * np.arange(k)).reshape(-1)])
    value = np.concatenate([value, np.full(n * k, k**-0.5)])
    order = np.argsort(row, kind="stable")
    return row[order], column[order], value[order].astype(np.float32)


class FactorisationMachine:
    """Second-order factorisation machine with logistic output, trained by AdaGrad."""

    def __init__(self, columns: int = COLUMNS, rank: int = RANK, seed: int = 3):
        self.bias = 0.0
        self.w = np.zeros(columns, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (columns, rank)).astype(np.float32)

    def _parts(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vx = self.v[column] * value[:, None]
        begin = np.searchsorted(row, np.arange(n))
        total = np.add.reduceat(vx, begin, axis=0)
        linear = np.add.reduceat(self.w[column] * value, begin)
        squares = np.add.reduceat(vx * vx, begin, axis=0)
        return vx, total, self.bias + linear + 0.5 * (total**2 - squares).sum(axis=1)

    def score(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """Scores of n rows; each row has an entry."""
        return 1 / (1 + np.exp(-np.clip(self._parts(row, column, value, n)[2], -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 4) -> None:
        r = np.random.default_rng(seed)
        gw, gv, gb = np.full(self.w.shape, 1e-6, np.float32), np.full(self.v.shape, 1e-6, np.float32), 1e-6
        good = max(1.0, float(labels.sum()))
        weight = np.where(labels == 1, len(labels) / (2 * good), len(labels) / (2 * max(1.0, len(labels) - good))).astype(np.float32)  # both classes count alike
        for _ in range(EPOCHS):
            for part in np.array_split(r.permutation(len(rows)), max(1, len(rows) // BATCH)):
                column = np.concatenate([rows[i][0] for i in part])
                value = np.concatenate([rows[i][1] for i in part])
                row = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
                vx, total, z = self._parts(row, column, value, len(part))
                error = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) * weight[part] / len(part)).astype(np.float32)
                each = (error[row] * value)[:, None]
                ids, at = np.unique(column, return_inverse=True)
                dw, dv = np.zeros(len(ids), np.float32), np.zeros((len(ids), self.v.shape[1]), np.float32)
                np.add.at(dw, at, each[:, 0])
                np.add.at(dv, at, each * (total[row] - vx))
                dw += DECAY * self.w[ids] / 10
                dv += DECAY * self.v[ids]
                gw[ids] += dw * dw
                gv[ids] += dv * dv
                db = float(error.sum())
                gb += db * db
                self.w[ids] -= RATE * dw / np.sqrt(gw[ids])
                self.v[ids] -= RATE * dv / np.sqrt(gv[ids])
                self.bias -= RATE * db / gb**0.5


def train_quality_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> FactorisationMachine | None:
    """The machine, from at most about `sample` labelled rows; None where there are none."""
    labelled = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("lid")).agg(F.min(label_col).cast("int").alias("label"))
    n = labelled.count()
    if not n:
        return None
    chosen = labelled.where(F.pmod(F.xxhash64(F.lit("sample"), "lid"), F.lit(1 << 30)) < min(1.0, sample / n) * (1 << 30))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for a, b in chunks(offsets):
                part = offsets[a : b + 1]
                row, column, value = features(data[part[0] : part[-1]], part - part[0])
                ends = np.searchsorted(row, np.arange(b - a + 1))
                blob = lambda x, kind: pa.array([x[i:j].astype(kind).tobytes() for i, j in zip(ends, ends[1:], strict=False)], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([blob(column, np.int32), blob(value, np.float32), batch.column(1).slice(a, b - a)], ["columns", "values", "label"])

    joined = docs.select(F.col(id_col).alias("lid"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "lid")  # about `sample` rows
    rows = joined.select("text", "label").mapInArrow(cut, "columns binary, values binary, label int").toArrow().to_pydict()
    order = sorted(range(len(rows["label"])), key=lambda i: (rows["columns"][i], rows["label"][i]))
    machine = FactorisationMachine()
    if order:
        machine.fit([(np.frombuffer(rows["columns"][i], np.int32), np.frombuffer(rows["values"][i], np.float32)) for i in order], np.array([rows["label"][i] for i in order], np.float32))
    return machine


def quality_score(text: Column, machine: FactorisationMachine | None) -> Column:
    """The score of a text column, 0 to 1."""
    if machine is None:
        return F.lit(0.5)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            data, offsets = utf8(batch)
            out = [np.empty(0)]
            for a, b in chunks(offsets):
                part = offsets[a : b + 1]
                out.append(machine.score(*features(data[part[0] : part[-1]], part - part[0]), b - a))
            yield pa.array(np.concatenate(out).astype(np.float64))

    return score(text)


def learned_rows(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The labels that may be learned from: crc32 of the id as text modulo 5 is not 0."""
    return labels.where(crc_bucket(F.col(id_col), 5) != 0)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """Quality scores of every whole text of `documents`, learned from `labels` that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = train_quality_model(docs, learned_rows(table(spark, sf_dir, "labels")))
    held = crc_bucket(F.col("doc_id"), 5) == 0
    return docs.select("doc_id", held.alias("held_out"), quality_score(F.col("text"), machine).alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
