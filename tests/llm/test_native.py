from collections import Counter

from ledgermint.llm import decontam, sharding
from pyspark.sql import functions as F

ITEM = "One two three four five six seven eight nine ten eleven"
DOCS = [
    (1, f"start {ITEM.upper()} end"), (2, "nothing here"), (3, None), (4, ""), (5, "--- !!"), (6, "the short ITEM."), (7, "one two three four five six seven eight nine"), (8, f"{ITEM}\n{ITEM}"),
    (9, "É one " + "filler " * 70000 + ITEM), (2, "nothing here"), (10, "Éa short item Σ"), (None, ITEM),
]
BENCH = [(1, ITEM), (2, "short, item"), (3, None), (4, "..."), (None, "filler filler"), (2, "short, item")]


def brute(text):
    import re

    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")
    words = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(s))
    w, hits, items = words(text), set(), set()
    for i, t in BENCH:
        b = words(t)
        k = min(len(b), 10)
        for s in range(len(b) - k + 1 if b else 0):
            for p in range(len(w) - k + 1):
                if w[p : p + k] == b[s : s + k]:
                    hits |= set(range(p, p + k))
                    items.add(i)
    return len(w), sorted(hits), sorted(i for i in items if i is not None)


def test_decontamination_matches_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in DOCS], "doc_id long, text string, items string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = decontam.find_contamination(docs, bench).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in DOCS)
    for i, text in DOCS:
        r = next(x for x in got if x.doc_id == i)
        assert (r.n_words, r.hits, r.items) == brute(text), i
    kept = {r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()}
    assert kept == {2, 3, 4, 5, 7}


def test_decontamination_of_empty_tables(spark):
    docs, bench = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_contamination(docs, bench).where(F.size("hits") > 0).count() == 0
    assert decontam.find_contamination(docs.limit(0), spark.createDataFrame(BENCH, "item_id long, text string")).count() == 0


def test_spans_go(spark):
    df = spark.createDataFrame([("a, b c! d", [1, 2]), (" x y", [0]), ("q", [])], "t string, h array<int>")
    assert [r[0] for r in df.select(decontam.remove_spans(F.col("t"), F.col("h"))).collect()] == ["a,  ! d", "  y", "q"]


def test_shards(spark):
    rows = [(i, "x" * (i % 300), f"s{i % 3 if i % 4 else 0}", "en") for i in range(4000)] + [(5000 + i, "same text", "s0", None) for i in range(2000)] + [(9000, None, None, None), (1, "x", "s1", "en")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, lang string, shard int")
    got = sharding.shard_documents(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    by = Counter()
    for r in got:
        by[r.shard] += r.size
    mean = sum(by.values()) / 40
    assert set(by) == set(range(40)) and max(by.values()) < 1.1 * mean and min(by.values()) > 0.9 * mean
    for s in range(40):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_documents(docs.limit(0)).count() == 0
    assert sharding.shard_documents(docs.limit(3)).count() == 3


def plain_tree(rows, shards):
    """Shards of (size, dims, tie) by sorting: each node is cut where its bytes are halved, along its widest dimension."""
    n_dims = len(rows[0][1])
    spans = [max(1.0, max(r[1][d] for r in rows) - min(r[1][d] for r in rows)) for d in range(n_dims)]

    def split(part, n, first):
        if n == 1 or not part:
            return dict.fromkeys(part, first)
        dim = max(range(n_dims), key=lambda d: (max(rows[i][1][d] for i in part) - min(rows[i][1][d] for i in part)) / spans[d])
        part = sorted(part, key=lambda i: rows[i][1][dim] + rows[i][2])
        target, before, cut = sum(rows[i][0] for i in part) * (n // 2) / n, 0, 0
        for k, i in enumerate(part):
            if before + rows[i][0] >= target:
                cut = k if target - before < before + rows[i][0] - target else k + 1
                break
            before += rows[i][0]
        return split(part[:cut], n // 2, first) | split(part[cut:], n - n // 2, first + n // 2)

    return split(list(range(len(rows))), shards, 0)


def test_the_tree_matches_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    n = 3000
    ties = rng.permutation(n) / n
    size = np.where(rng.random(n) < 0.02, rng.integers(5000, 90000, n), rng.integers(16, 900, n))
    dims = [size.astype(float), rng.choice([0.0, 7.0, 30000.0], n, p=[0.6, 0.3, 0.1]), rng.integers(-1, 4, n).astype(float)]
    rows = [(int(size[i]), tuple(float(d[i]) for d in dims), float(ties[i])) for i in range(n)]
    df = spark.createDataFrame([(i, r[0], *r[1], r[2]) for i, r in enumerate(rows)], "i long, size long, d0 double, d1 double, d2 double, tie double")
    for shards in (1, 7):
        got = {r.i: r.shard for r in sharding.kd_shards(df, "size", ["d0", "d1", "d2"], "tie", shards).collect()}
        assert got == plain_tree(rows, shards), shards


def test_long_texts_and_null_metadata_in_shards(spark):
    rows = [(1, "x" * 3_000_000, None, ""), (2, None, "", None), (3, "y", None, None), (3, "y", None, None)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()
    assert sorted((r.doc_id, r.size) for r in got) == [(1, 3_000_016), (2, 16), (3, 17), (3, 17)]
    assert spark.createDataFrame([(None,), ("",)], "s string").select(sharding._category(F.col("s")).alias("c")).distinct().count() == 2
