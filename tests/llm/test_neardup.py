import re
import string

import numpy as np
import pyarrow as pa
from ledgermint.llm.common import utf8
from ledgermint.llm.components import connected_components
from ledgermint.llm.kernels import mix64
from ledgermint.llm.neardup import near_duplicates, shingle_sets, similar_links, super_minhash

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain_set(text, width=4):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width=4):
    sets, parent = {i: plain_set(t, width) for i, t in rows}, {i: i for i, _ in rows}
    find = lambda x: x if parent[x] == x else find(parent[x])
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(n_groups=12, seed=0):
    rng = np.random.default_rng(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    rows, i = [], 0
    for g in range(n_groups):
        base = rng.choice(vocabulary, rng.integers(5, 160)).tolist()
        for _ in range(int(rng.integers(1, 12))):
            words = list(base)
            for _ in range(int(rng.integers(0, 4))):
                words[int(rng.integers(len(words)))] = "e%d" % rng.integers(10**6)
            rows.append((i, " ".join(words) if g % 2 else "\n".join(words).upper()))
            i += 1
    return rows + [(i, ""), (i + 1, None), (i + 2, "one two"), (i + 3, "ONE\ttwo"), (i + 4, " \n"), (i + 5, "É é"), (i + 6, "é É")]


def test_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, n long, key string".replace("n long", "n string"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_many_blocks_give_the_same(spark):
    rows = corpus(4, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, block=3).collect()} == {i: c for i, (_, c) in brute(rows).items()}


def test_edge_rows(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (None, "a b c d e"), (3, None), (4, "word " * 30000)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [(d, c) for n, d, c in got if not n] == [(1, 1), (1, 1), (2, 1), (3, 3), (4, 4)]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_super_minhash_is_the_sequential_algorithm():
    data, offsets = utf8(pa.array([" ".join(f"t{i * k}" for i in range(40)) for k in (1, 3, 7)] + ["x", "", "a b c d e f"]))
    elements, at = shingle_sets(data, offsets, 4)
    got = super_minhash(elements, at)
    for r in range(len(at) - 1):
        h = [None] * 128
        for v in elements[at[r] : at[r + 1]]:
            p = list(range(128))
            for j in range(128):
                x = int(mix64(np.array([v ^ mix64(np.full(1, j, np.uint64))[0]], np.uint64))[0])
                k = j + (((x >> 32) * (128 - j)) >> 32)
                p[j], p[k] = p[k], p[j]
                value = (j << 32) | (x & 0xFFFFFFFF)
                if h[p[j]] is None or value < h[p[j]]:
                    h[p[j]] = value
        if at[r + 1] > at[r]:
            assert got[r].tolist() == h


def test_links_by_bits_and_by_lists_agree(monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**60, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(200) > 0.1], rng.integers(0, 2**60, 5, dtype=np.uint64)])) for _ in range(40)]
    ids = np.arange(40)
    links = similar_links(ids, sets, 80)
    groups = lambda es: {frozenset(x) for x in _closure(es, 40)}
    every = [(a, b) for a in range(40) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))]
    assert groups(links) == groups(every)


def _closure(edges, n):
    group = {i: {i} for i in range(n)}
    for a, b in edges:
        if group[a] is not group[b]:
            merged = group[a] | group[b]
            for x in merged:
                group[x] = merged
    return list(group.values())


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 900 + k) for k in range(50)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[900 + k] == 900 for k in range(50)) and got[1000] == 900


def test_an_id_with_several_texts_keeps_the_links_of_each(spark):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, one), (1, two), (2, one + " x"), (3, two + " y"), (4, "quite another text of some words")]
    got = sorted((r.doc_id, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_a_crowded_bucket_of_several_groups(spark):
    """All documents share a passage, so that their rows meet in buckets; chains of copies drift away from the first one."""
    rng, rows, i = np.random.default_rng(8), [], 0
    passage = [f"p{k}" for k in range(90)]
    for group in range(6):
        words = passage + [f"g{group}x{k}" for k in range(60)]
        for _ in range(14):
            words = list(words)
            words[int(rng.integers(len(words)))] = f"e{rng.integers(10**6)}"
            rows.append((i, " ".join(words)))
            i += 1
    rng.shuffle(rows)
    rows = [(int(a), b) for a, b in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = {i: c for i, (_, c) in brute(rows).items()}
    assert len(set(expected.values())) < len(rows)
    for block in (4, 256):
        assert {r.doc_id: r.component_id for r in near_duplicates(docs, block=block).collect()} == expected
