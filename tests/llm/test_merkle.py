import hashlib

from pyspark.sql import functions as F

from ledgermint.llm.merkle import climbed, lower_ascii, merkle_manifest, proofs


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def digest(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes, arity):
    """The top digest, and the proof of each node."""
    proofs, members = [""] * len(nodes), [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(a, min(a + arity, len(nodes))) for a in range(0, len(nodes), arity)]
        for run in runs:
            for j in run:
                for i in members[j]:
                    proofs[i] += "".join(nodes[k] for k in run if k != j)
        members = [[i for j in run for i in members[j]] for run in runs]
        nodes = [H(*[nodes[j] for j in run]) for run in runs]
    return nodes[0], proofs


def brute(rows, arity):
    first = lambda v: (v is not None, v)
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    made = []
    for s in names:
        leaves = sorted(((r[0], digest(r)) for r in by[s]), key=lambda x: (first(x[0]), x[1]))
        made.append((leaves, *tree([d for _, d in leaves], arity)))
    root, upper = tree([top for _, top, _ in made], arity)
    return sorted([(i, leaf, top, root, proof + up) for (leaves, top, proofs), up in zip(made, upper) for (i, leaf), proof in zip(leaves, proofs)], key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, up string"


def found(spark, rows, arity):
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    manifest = merkle_manifest(docs, tampered={"text": F.when(F.col("doc_id") % 3 == 0, lower_ascii(F.col("text"))).otherwise(F.col("text"))}, arity=arity)
    joined = manifest["leaves"].join(proofs(manifest, climbed(manifest)), "row").collect()
    for r in joined:
        assert (r.folded == r.root) == (r.tampered == r.leaf)
    again = climbed(manifest, "leaf").select("folded").distinct().collect()
    assert len(again) <= 1 and all(r.folded == joined[0].root for r in again)
    return sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in joined], key=str)


def test_roots_and_proofs_are_those_of_brute_force(spark):
    rows = [(i, ["hot", "b", "ß", None, "lone"][0 if i % 3 else i % 4] if i else "lone", None if i % 7 == 0 else "en", i * 10, None if i % 11 == 0 else f"Text É {i}" * (i % 5)) for i in range(150)]
    for arity in (2, 16):
        assert found(spark, rows, arity) == brute(rows, arity)


def test_many_sources_repeated_rows_null_ids_and_long_texts(spark):
    rows = [(i, f"s{i % 40}", "en", 1, "T" * (200_000 if i == 5 else 3)) for i in range(90)] + [(7, "s7", "en", 1, "TTT")] * 3 + [(None, "s7", None, None, None)] * 2 + [(7, "s7", "en", 1, "other")]
    assert found(spark, rows, 4) == brute(rows, 4)


def test_one_source_one_row_and_no_row(spark):
    assert found(spark, [(i, "a", "en", 1, "x") for i in range(20)], 16) == brute([(i, "a", "en", 1, "x") for i in range(20)], 16)
    assert found(spark, [(3, None, "en", 1, "X")], 16) == brute([(3, None, "en", 1, "X")], 16)
    assert found(spark, [], 16) == []
    lone = [(i, f"s{i}", "en", 1, "x") for i in range(20)]
    assert found(spark, lone, 16) == brute(lone, 16)
