import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgermint.llm.resampling import bucket_gains, features, importance_resample

UPPER = {i: i + 32 for i in range(65, 91)}


def bag(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    return [zlib.crc32(f.encode()) % 10_000 for f in [*words, *[f"{a} {b}" for a, b in zip(words, words[1:])]]], len(words)


def brute(docs, target):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(bag(text)[0])
    for text in target:
        t.update(bag(text)[0])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    rows = []
    for i, text in docs:
        f, n = bag(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    drawn = {id(r): k + 1 for k, r in enumerate(able[: 25 * len(able) // 100])}
    return sorted([(r[0], *r[1:4], drawn.get(id(r))) for r in rows], key=str)


TEXTS = ["", None, "ONE", "one two " * 30, "Ünï cödé × 7 " * 12, "a-b_c\x00d\te" * 20, "The quick brown fox " * 5000, *[" ".join(f"w{(i * j) % 17}" for j in range(15 + i)) for i in range(60)]]


def result(spark, docs, target, schema="doc_id long, text string, score string"):
    rows = spark.createDataFrame([(i, t, "clash") for i, t in docs], schema)
    found = importance_resample(rows, spark.createDataFrame([(t,) for t in target], "text string"))
    return sorted([(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in found.collect()], key=str)


def test_counts_weights_scores_and_ranks_are_those_of_brute_force(spark):
    docs, target = list(enumerate(TEXTS)), ["w1 w2 w3 w4", "one two", None, ""]
    assert result(spark, docs, target) == brute(docs, target)


def test_repeated_rows_null_ids_and_ties(spark):
    text = "alpha beta gamma " * 10
    docs = [(5, text)] * 9 + [(None, text)] * 4 + [(6, None)] * 3
    assert result(spark, docs, ["alpha"]) == brute(docs, ["alpha"])


def test_empty_tables(spark):
    assert result(spark, [], ["x"]) == []
    docs = list(enumerate(TEXTS[:8]))
    assert result(spark, docs, []) == brute(docs, [])
    none = spark.createDataFrame([], "text string")
    assert (bucket_gains(none, none) == np.zeros(10_000)).all()


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_features_of_a_part_of_a_batch_are_those_of_its_texts(kind):
    texts = ["x0 Y", "a B a", "c d e", "f", "Ünï cödé", "", "z " * 30]
    for first, n in [(0, 7), (1, 3), (3, 4), (6, 1), (2, 0)]:
        words, rows, pairs, rows_of_pairs = features(pa.array(texts, kind).slice(first, n))
        found = [[] for _ in range(n)]
        for bucket, row in [*zip(words.tolist(), rows.tolist()), *zip(pairs.tolist(), rows_of_pairs.tolist())]:
            found[row].append(bucket)
        assert found == [bag(t)[0] for t in texts[first : first + n]]


def test_a_batch_of_long_texts_is_judged_in_parts(spark):
    docs = [(i, " ".join(f"W{(i * j) % 9973} no{j % (i + 2)}" for j in range(12_000))) for i in range(60)]
    assert sum(len(t) for _, t in docs) > 1.5 * 2**22  # of one task: over the bytes of a part
    rows = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    found = importance_resample(rows, spark.createDataFrame([("w1 no1 w2",)], "text string")).collect()
    assert sorted([(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in found], key=str) == brute(docs, ["w1 no1 w2"])
