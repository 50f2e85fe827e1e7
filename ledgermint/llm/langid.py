"""Language identification by a byte convolutional network.

A text's UTF-8 bytes (A-Z folded) are cut into fixed windows that cover all of it. In a window,
byte embeddings go through filters of three widths (2, 4 and 6 bytes, stride 2), a rectifier, max
pooling over the window and a softmax. A document's probabilities are the mean over its windows,
weighted by their bytes. The network is trained in numpy with Adam.

For prediction, embedding and filters are multiplied out once into a table over byte pairs, so a
filter of width 2k costs k row look-ups.

Training draws on at most `SAMPLE_PER_LANG` documents of each language (chosen by a hash of the id,
so the choice covers the whole table) and at most `WINDOWS_PER_DOC` windows of each, spread over its
length. That is the documented bound on what reaches the driver; predictions cover every byte.

A null text, or one without a letter, is `und` with score 0. Without labelled rows every text is
`und` with score 0. Repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, crc_bucket, table, utf8
from .kernels import LOWER

WINDOW, EMBED, FILTERS, WIDTHS = 192, 8, 16, (1, 2, 3)  # widths in byte pairs
SAMPLE_PER_LANG, WINDOWS_PER_DOC = 1500, 4
EPOCHS, BATCH, RATE = 5, 64, 0.004
_CHUNK = 1 << 18


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts as rows of bytes, padded with spaces; the row and the byte count of each."""
    sizes = np.diff(offsets)
    count = -(-sizes // WINDOW)
    rows = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[:-1][rows] + nth * WINDOW
    length = np.minimum(WINDOW, offsets[1:][rows] - start)
    padded = np.concatenate([LOWER[data], np.full(WINDOW, 32, np.uint8)])
    cells = padded[start[:, None] + np.arange(WINDOW)]
    cells[np.arange(WINDOW) >= length[:, None]] = 32
    return cells, rows, length


class ByteConvNet:
    """Multi-width filters over byte embeddings, max pooling, softmax."""

    def __init__(self, classes: int, seed: int = 1):
        r = np.random.default_rng(seed)
        self.params = {"embed": r.normal(0, 0.3, (256, EMBED)).astype(np.float32), "out": r.normal(0, 0.1, (FILTERS * len(WIDTHS), classes)).astype(np.float32), "out_bias": np.zeros(classes, np.float32)}
        for w in WIDTHS:
            self.params[f"conv{w}"] = r.normal(0, (2 * w * EMBED) ** -0.5, (2 * w * EMBED, FILTERS)).astype(np.float32)
            self.params[f"bias{w}"] = np.zeros(FILTERS, np.float32)

    def loss_gradient(self, cells: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p, n = self.params, len(cells)
        embedded = p["embed"][cells].reshape(n, -1)
        pooled, tops, views = [], [], []
        for w in WIDTHS:
            view = np.lib.stride_tricks.sliding_window_view(embedded, 2 * w * EMBED, axis=1)[:, :: 2 * EMBED]
            y = view @ p[f"conv{w}"]
            top = y.argmax(axis=1)
            pooled.append(np.take_along_axis(y, top[:, None], 1)[:, 0] + p[f"bias{w}"])
            tops.append(top)
            views.append(view)
        hidden = np.concatenate(pooled, axis=1)
        active = np.maximum(hidden, 0)
        logits = active @ p["out"] + p["out_bias"]
        prob = softmax(logits)
        loss = -np.log(prob[np.arange(n), labels] + 1e-9).mean()
        prob[np.arange(n), labels] -= 1
        prob /= n
        grad = {"out": active.T @ prob, "out_bias": prob.sum(axis=0)}
        back = (prob @ p["out"].T) * (hidden > 0)
        embed_grad = np.zeros_like(p["embed"])
        for i, w in enumerate(WIDTHS):
            g = back[:, i * FILTERS : (i + 1) * FILTERS]
            picked = views[i][np.arange(n)[:, None], tops[i]]  # rows, filters, 2 w EMBED
            grad[f"conv{w}"] = np.einsum("nfk,nf->kf", picked, g)
            grad[f"bias{w}"] = g.sum(axis=0)
            into = (g[:, :, None] * p[f"conv{w}"].T[None]).reshape(n, FILTERS, 2 * w, EMBED)
            at = cells[np.arange(n)[:, None, None], 2 * tops[i][:, :, None] + np.arange(2 * w)]
            np.add.at(embed_grad, at.reshape(-1), into.reshape(-1, EMBED))
        return float(loss), grad | {"embed": embed_grad}

    def fit(self, cells: np.ndarray, labels: np.ndarray, seed: int = 2) -> None:
        r, t = np.random.default_rng(seed), 0
        first = {k: np.zeros_like(v) for k, v in self.params.items()}
        second = {k: np.zeros_like(v) for k, v in self.params.items()}
        for _ in range(EPOCHS):
            for part in np.array_split(r.permutation(len(cells)), max(1, len(cells) // BATCH)):
                t += 1
                for k, g in self.loss_gradient(cells[part], labels[part])[1].items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.params[k] -= RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)

    def tables(self) -> list[np.ndarray]:
        """For each place k: what a byte pair adds, at k pairs after the filter's start, to each filter wider than k."""
        p = self.params
        both = np.concatenate([np.repeat(p["embed"][None], 256, 0), np.repeat(p["embed"][:, None], 256, 1)], axis=2).reshape(65536, 2 * EMBED)  # little-endian: low byte first
        return [np.concatenate([both @ p[f"conv{w}"][2 * EMBED * k : 2 * EMBED * (k + 1)] for w in WIDTHS if w > k], axis=1) for k in range(len(WIDTHS))]

    def predict(self, cells: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """Class probabilities of each window."""
        pairs = np.ascontiguousarray(cells).view("<u2")
        n, length = pairs.shape
        whole = tables[0][pairs]
        for k in range(1, len(WIDTHS)):
            whole[:, : length - k, FILTERS * k :] += tables[k][pairs[:, k:]]
        hidden = np.concatenate([whole[:, : length - w + 1, FILTERS * i : FILTERS * (i + 1)].max(axis=1) + self.params[f"bias{w}"] for i, w in enumerate(WIDTHS)], axis=1)
        return softmax(np.maximum(hidden, 0) @ self.params["out"] + self.params["out_bias"])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def training_windows(docs: DataFrame, text_col: str, lang_col: str, id_col: str, per_lang: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """A bounded sample of windows with their labels, and the languages."""
    counts = {r["lang"]: r["n"] for r in docs.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return np.empty((0, WINDOW), np.uint8), np.empty(0, np.int64), []
    share = None
    for lang in langs:
        ok = min(1.0, per_lang / counts[lang])
        share = F.when(F.col(lang_col) == lang, ok) if share is None else share.when(F.col(lang_col) == lang, ok)
    chosen = docs.where(F.pmod(F.xxhash64(F.lit("sample"), id_col), F.lit(1 << 30)) < share * (1 << 30))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            cells, rows, _ = windows(data, offsets)
            count = np.bincount(rows, minlength=batch.num_rows)
            begin = np.cumsum(count) - count
            some = [np.unique(np.linspace(b, b + c - 1, min(c, WINDOWS_PER_DOC)).astype(int)) for b, c in zip(begin, count, strict=True) if c]
            picked = np.concatenate(some) if some else np.empty(0, int)
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in cells[picked]], pa.binary()), batch.column(1).take(pa.array(rows[picked]))], ["cells", "lang"])

    sample = chosen.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInArrow(cut, "cells binary, lang string").toArrow().to_pydict()
    order = sorted(range(len(sample["lang"])), key=lambda i: (sample["lang"][i], sample["cells"][i]))
    cells = np.frombuffer(b"".join(sample["cells"][i] for i in order), np.uint8).reshape(-1, WINDOW)
    return cells, np.array([langs.index(sample["lang"][i]) for i in order], np.int64), langs


def train_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_PER_LANG) -> tuple[ByteConvNet, list[str]]:
    """The network and its languages, from the rows of `docs` that have a text and a language."""
    cells, labels, langs = training_windows(docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()), text_col, lang_col, id_col, per_lang)
    net = ByteConvNet(max(1, len(langs)))
    if len(cells):
        net.fit(cells, labels)
    return net, langs


def predicted_language(text: Column, net: ByteConvNet, langs: list[str]) -> Column:
    """struct<lang, score> of a text column."""

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables = net.tables()
        letters = np.zeros(256, bool)
        letters[[*range(65, 91), *range(97, 123)]] = True
        for batch in batches:
            data, offsets = utf8(batch)
            names, scores = [], []
            for a, b in chunks(offsets, _CHUNK):
                part = offsets[a : b + 1]
                piece = data[part[0] : part[-1]]
                total = np.zeros((b - a, len(langs) or 1))
                cells, rows, length = windows(piece, part - part[0])
                for s in range(0, len(cells) if langs else 0, 2048):
                    np.add.at(total, rows[s : s + 2048], net.predict(cells[s : s + 2048], tables) * length[s : s + 2048, None])
                total /= np.maximum(np.diff(part), 1)[:, None]
                ascii_letters = np.concatenate([[0], np.cumsum(letters[piece])])
                has = ascii_letters[part[1:] - part[0]] > ascii_letters[part[:-1] - part[0]]
                for i in np.flatnonzero(~has):  # letters beyond ASCII, if any
                    has[i] = any(c.isalpha() for c in bytes(data[part[i] : part[i + 1]]).decode())
                best = total.argmax(axis=1)
                for i in range(b - a):
                    known = bool(has[i]) and bool(langs)
                    names.append(langs[best[i]] if known else "und")
                    scores.append(float(min(1.0, total[i, best[i]])) if known else 0.0)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return predict(text)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """Languages of every whole text of `documents`, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    bucket = crc_bucket(F.col("doc_id"), 4)
    net, langs = train_language_model(docs.where(bucket != 2))
    found = docs.select("doc_id", (bucket == 2).alias("held_out"), predicted_language(F.col("text"), net, langs).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
