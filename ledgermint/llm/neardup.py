"""MinHash near-dedup: SuperMinHash signatures, banding, verification and union-find grouping.

A document's set holds the hashes of its distinct word shingles. Two documents are linked when the
Jaccard similarity of their sets is at least a threshold, and the components of the links are the
groups. The steps:

1. Sign. SuperMinHash: element e visits the slots in the order of a pseudo-random permutation and
   offers slot p the value j + r at its j-th step. The permutation correlates the slots, which gives
   lower variance than independent hashes, and a set stops as soon as every slot holds a value
   below the next step. All elements of a batch of texts take a step together.
2. Fold exact copies. Equal sets share a key; one row of each key goes on, so a text that holds a
   third of all rows costs one row. (`min` is summed before it is shuffled.)
3. Band. Rows of a band with equal slots form a bucket; its leader is the smallest of them (a sum
   before the shuffle). Each row's signature is compared with those of its buckets' leaders, and an
   estimate near the threshold or above is a candidate edge. A row far from a leader is open in that
   bucket: there it is compared with all rows, dealt into blocks, so that no bucket meets in one task
   and no bucket's pairs are ever listed. Only forest edges leave a block.
4. Candidate groups are the components of those edges. Every link of step 5 lies inside one.
5. Verify on whole sets. A group is dealt into blocks of `BLOCK` members, the group's leader stands in
   each, and the members of a block are compared with one another. Where that leaves a group in several
   classes, the members outside the largest one are compared with those of all other blocks. Again
   only forest edges leave; their components are the result.

Rows that leave a task grow with a group's members, and with members x blocks only for those that
neither a leader nor a block connects. The joins on hot keys (a leader's signature, a bucket's rows)
are equi-joins, which Spark splits where they are skewed.

What banding can lose is set by its parameters: at a similarity of 0.8, 32 bands of 4 rows miss a
pair with probability 5e-8, and the estimate of 128 slots falls below 0.56 with less than 1e-10.

Sets, not ids, are what is linked, so rows of one id with different texts keep the links of each.

Texts without words, and null texts, have empty sets and are linked with nothing. Repeated rows
share a component. Rows without id are returned with a null component and kept. An empty table
gives an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, chunks, materialise, table, utf8
from .components import UnionFind, connected_components, forest
from .kernels import U64, mix64, word_hashes

SLOTS, BANDS = 128, 32
#: Slots of two signatures that must agree for a pair to be verified, for a similarity of 0.8.
LEAST_EQUAL = 72
#: Members of a candidate group, or rows of a bucket, that are compared with each other at once.
BLOCK = 256
#: Steps whose permutation is followed through the swaps; after them it is written out.
_FOLLOWED = 6
_NEVER = U64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, ascending, and the offsets of the texts.

    A text of fewer words than `width` has one shingle, all its words; a text without words none.
    """
    h, rows = word_hashes(data, offsets)
    n = len(offsets) - 1
    words = np.bincount(rows, minlength=n)
    end = np.cumsum(words)
    start = end - words
    # shingle i starts at word i; a short text has one shingle, of its own width
    length = np.minimum(words, width)
    first = np.arange(len(h))
    whole = first + length[rows] <= end[rows]
    at, row = first[whole], rows[whole]
    s = np.zeros(len(at), U64)
    padded = np.concatenate([h, np.zeros(width, U64)])
    for k in range(width):
        inside = k < length[row]
        s += np.where(inside, mix64(padded[at + k] + U64(k * 0x9E37 + 1)) * U64(2 * k + 1), U64(0))
    s = mix64(s + length[row].astype(U64))
    order = np.lexsort((s, row))
    s, row = s[order], row[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    s, row = s[fresh], row[fresh]
    return s, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]) if len(start) else np.zeros(1, np.int64)


def super_minhash(elements: np.ndarray, offsets: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures, one row of `slots` values for each set; an empty set has no values."""
    n = len(offsets) - 1
    signature = np.full((n, slots), _NEVER, U64)
    flat = signature.reshape(-1)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(n), sizes)
    e = elements.copy()
    swaps: list[np.ndarray] = []
    order: np.ndarray | None = None
    for j in range(slots):
        if not len(e):
            break
        x = mix64(e ^ mix64(np.full(1, j, U64))[0])
        k = (j + (((x >> U64(32)) * U64(slots - j)) >> U64(32))).astype(np.int64)
        if order is None:
            p = k.copy()
            for i in range(j - 1, -1, -1):
                p[p == swaps[i]] = i
            swaps.append(k)
        else:
            lines = np.arange(len(e))
            p = order[lines, k].astype(np.int64)
            order[lines, k] = order[:, j]
        np.minimum.at(flat, row * slots + p, (U64(j) << U64(32)) | (x & U64(0xFFFFFFFF)))
        open_ = (signature == _NEVER).any(axis=1)
        going = open_[row]
        if not going.all():
            e, row = e[going], row[going]
            swaps = [s[going] for s in swaps]
            order = order[going] if order is not None else None
        if order is None and j + 1 >= _FOLLOWED and len(e):
            order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), (len(e), 1))
            lines = np.arange(len(e))
            for i, s in enumerate(swaps):
                kept = order[lines, s].copy()
                order[lines, s] = order[:, i]
                order[:, i] = kept
            swaps = []
    return signature


def _sets_of(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = utf8(batch.column(1))
    for a, b in chunks(offsets):
        part = offsets[a : b + 1]
        yield a, b, *shingle_sets(data[part[0] : part[-1]], part - part[0], width)


def set_keys(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128 bits of each set, as two numbers."""
    n = np.diff(at)
    sums = np.zeros((len(n), 2), U64)  # sums of two mixes of distinct elements
    some = n > 0
    if some.any():
        for c, salt in enumerate((1, 2)):
            sums[some, c] = np.add.reduceat(mix64(s ^ mix64(np.full(1, salt, U64))[0]), at[:-1][some])
    size = n.astype(U64)
    return np.stack([mix64(sums[:, 0] + size), mix64(sums[:, 1] ^ size)], axis=1)


def _blobs(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1] * x.itemsize), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())


def set_key(text: Column, width: int) -> Column:
    """The key of each text's set, as `near_duplicates` gives it."""

    @F.arrow_udf("binary")
    def keys(column: pa.Array) -> pa.Array:
        data, offsets = utf8(column)
        parts = (offsets[a : b + 1] for a, b in chunks(offsets))
        return pa.concat_arrays([pa.array([], pa.binary()), *[_blobs(set_keys(*shingle_sets(data[p[0] : p[-1]], p - p[0], width))) for p in parts]])

    return keys(text)


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, slots: int = SLOTS, bands: int = BANDS) -> DataFrame:
    """(id, n, key, bands, sig) of each row: set size, 128-bit key of the set, band keys, one byte of each slot."""
    rows_each = slots // bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = mix64(np.arange(slots, dtype=U64) + U64(7777))
        for batch in batches:
            for a, b, s, at in _sets_of(batch, width):
                n = np.diff(at)
                sig = super_minhash(s, at, slots)
                band = mix64((mix64(sig ^ salts)).reshape(b - a, bands, rows_each).sum(axis=2, dtype=U64) + np.arange(bands, dtype=U64))
                small = (mix64(sig) >> U64(56)).astype(np.uint8)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a) * bands + 1, bands, dtype=np.int32)), pa.array(band.view(np.int64).reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), _blobs(set_keys(s, at)), flat, _blobs(small)], ["id", "n", "key", "bands", "sig"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n long, key binary, bands array<long>, sig binary")


def _groups(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[pa.Table]:
    """The rows of each value of the first `keys` columns, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        if held:
            new[0] = any(held[-1].column(i)[-1].as_py() != batch.column(i)[0].as_py() for i in range(keys))
        marks = np.flatnonzero(new)
        edges = [0, *marks.tolist(), batch.num_rows] if not len(marks) or marks[0] else [*marks.tolist(), batch.num_rows]
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            if held and (k > 0 or new[0]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


@F.arrow_udf(T.IntegerType())
def slots_alike(a: pa.Array, b: pa.Array) -> pa.Array:
    """The slots in which two signatures of one byte a slot agree."""
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8) for c in (a, b))
    return pa.array((x == y).reshape(len(a), -1).sum(axis=1) if len(a) else [], pa.int32())


class _Forest:
    """Edges between rows that are not yet connected; rows of one id, or one given class, are connected at first."""

    def __init__(self, ids: np.ndarray, classes: np.ndarray | None = None):
        self.ids, self.edges = ids, []
        self.group = np.unique(ids if classes is None else classes, return_inverse=True)[1]

    def link(self, i: int, others: np.ndarray) -> None:
        group = self.group
        for j in others:
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                self.edges.append((int(self.ids[i]), int(self.ids[j])))


def bucket_links(ids: np.ndarray, sig: np.ndarray, seeks: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Forest edges between the rows that seek and all rows whose signatures agree with theirs in `least` slots or more."""
    forest_ = _Forest(ids)
    for i in np.flatnonzero(seeks):
        others = np.flatnonzero(forest_.group != forest_.group[i])
        forest_.link(i, others[(sig[others] == sig[i]).sum(axis=1) >= least])
    return forest_.edges


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])


def similar_links(ids: np.ndarray, sets: list[np.ndarray], percent: int, seeks: np.ndarray | None = None, classes: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Forest edges over sets with 100 * intersection >= percent * union, found by whole sets.

    With `seeks`, only pairs with a row that seeks are compared; with `classes`, none within a class.
    """
    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    _, token, often = np.unique(flat, return_inverse=True, return_counts=True)
    shared = often[token] > 1  # what one set alone holds is in no intersection
    _, token = np.unique(token[shared], return_inverse=True)
    owner = owner[shared]
    width = -(-max(1, int(token.max(initial=-1)) + 1) // 64)

    if n * width * 8 <= 1 << 26:
        bits = np.zeros((n, width), U64)
        np.bitwise_or.at(bits, (owner, token >> 6), U64(1) << (token & 63).astype(U64))
        counts = lambda i, others: np.bitwise_count(bits[others] & bits[i]).sum(axis=1, dtype=np.int64)
    else:  # many tokens: count the owners of each token of the row
        by_token = np.argsort(token, kind="stable")
        owners, ends = owner[by_token], np.cumsum(np.bincount(token))
        starts, mine = ends - np.bincount(token), np.searchsorted(owner, np.arange(n + 1))

        def counts(i: int, others: np.ndarray) -> np.ndarray:
            lists = [owners[starts[t] : ends[t]] for t in token[mine[i] : mine[i + 1]]]
            return np.bincount(np.concatenate(lists), minlength=n)[others] if lists else np.zeros(len(others), np.int64)

    forest_ = _Forest(ids, classes)
    for i in range(n - 1) if seeks is None else np.flatnonzero(seeks):
        others = np.flatnonzero(forest_.group != forest_.group[i])
        others = others if seeks is not None else others[others > i]
        low, high = percent * sizes[i], 100 * sizes[i]  # sizes that can reach the threshold
        others = others[(100 * sizes[others] >= low) & (percent * sizes[others] <= high)]
        if len(others):
            common = counts(i, others)
            forest_.link(i, others[100 * common >= percent * (sizes[i] + sizes[others] - common)])
    return forest_.edges


def _dealt(rows: DataFrame, number: str, seek: Column, seek_number: str, block: int) -> DataFrame:
    """`rows` (with the row's `id`, the rows and the seeking rows of its group) dealt so that each seeking row meets every row of its group.

    Rows go to one of `number` / `block` blocks, once for each block of seeking rows; these go to one of
    theirs, once for each block of rows. Adds `held`, `sought` (the blocks) and `seeks`.
    """
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / block)).cast("int")
    of = lambda c: F.pmod(F.xxhash64("id"), blocks(c)).cast("int")
    every = lambda c: F.sequence(F.lit(0), blocks(c) - 1)
    places = F.transform(every(seek_number), lambda s: F.struct(of(number).alias("held"), s.alias("sought"), F.lit(False).alias("seeks")))
    seeking = F.transform(every(number), lambda h: F.struct(h.alias("held"), of(seek_number).alias("sought"), F.lit(True).alias("seeks")))
    return rows.select("*", F.inline(F.when(seek, F.concat(places, seeking)).otherwise(places)))


def candidate_edges(reps: DataFrame, least: int, block: int, parts: int) -> DataFrame:
    """(a, b): forest edges of rows (id, bands, sig) that share a bucket and agree in `least` slots or more."""
    banded = reps.select("id", F.posexplode("bands").alias("band", "slot_key"))
    crowded = banded.groupBy("band", "slot_key").agg(F.count("*").alias("rows"), F.min("id").alias("leader")).where("rows > 1")
    members = materialise(banded.join(crowded, ["band", "slot_key"]).where("id <> leader"))
    sigs = reps.select("id", "sig")
    pairs = members.select("id", "leader").distinct().join(sigs, "id").join(sigs.select(F.col("id").alias("leader"), F.col("sig").alias("leader_sig")), "leader")
    rated = materialise(pairs.select("id", "leader", slots_alike("sig", "leader_sig").alias("alike")))
    near = rated.where(F.col("alike") >= least).select(F.col("id").alias("a"), F.col("leader").alias("b"))
    # rows far from the leader of a bucket of three rows or more meet all its rows
    far = materialise(members.where("rows > 2").join(rated.where(F.col("alike") < least), ["id", "leader"]).select("band", "slot_key", "id"))
    n_far = far.count()  # few as a rule: then no bucket is shuffled to find them
    lost = bounded(far.groupBy("band", "slot_key").agg(F.count("*").alias("open")), n_far)
    rest = members.join(lost, ["band", "slot_key"]).join(bounded(far.withColumn("far", F.lit(True)), n_far), ["band", "slot_key", "id"], "left")
    dealt = _dealt(rest, "rows", F.col("far").isNotNull(), "open", block).select("band", "slot_key", "held", "sought", "id", "seeks")
    keys = ["band", "slot_key", "held", "sought"]
    met = dealt.join(sigs, "id").select(*keys, "id", "seeks", "sig").repartition(parts, *keys).sortWithinPartitions(*keys, "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for group in _groups(batches, 4):
            ids, seeks = group.column(4).to_numpy(), group.column(5).to_numpy()
            if len(ids) > 1:
                out += bucket_links(ids, np.frombuffer(b"".join(group.column(6).to_pylist()), np.uint8).reshape(len(ids), -1), seeks, least)
            if len(out) > 1 << 16:
                yield _edge_batch(out)
                out = []
        yield _edge_batch(out)

    return near.union(met.mapInArrow(compare, "a long, b long"))


def member_sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, width: int) -> DataFrame:
    """`wanted` (id, rep, key and more) with `elements`: the set of each node, from the text whose set has its key."""
    more = [c for c in wanted.columns if c not in ("id", "rep", "key")]
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")).join(bounded(wanted), "rep")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, s, at in _sets_of(batch, width):
                blobs = pa.array([s[x:y].tobytes() for x, y in zip(at, at[1:], strict=False)], pa.binary())
                cut = pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), blobs, *[batch.column(k).slice(a, b - a) for k in range(3, 3 + len(more))]], ["id", "elements", *more])
                # of the texts of an id, those whose set is the node's
                yield cut.filter(pc.equal(_blobs(set_keys(s, at)), batch.column(2).slice(a, b - a)))

    kinds = dict(wanted.dtypes)
    schema = ", ".join(["id long", "elements binary", *[f"{c} {kinds[c]}" for c in more]])
    return texts.select("id", "text", "key", *more).mapInArrow(sets, schema).dropDuplicates(["id"])


def verified_edges(sets: DataFrame, keys: list[str], percent: int, parts: int) -> DataFrame:
    """(a, b): forest edges of sets (keys, id, elements[, seeks, class]) that stand under equal keys and reach the threshold."""
    extra = [c for c in ("seeks", "class") if c in sets.columns]
    met = sets.select(*keys, "id", "elements", *extra).repartition(parts, *keys).sortWithinPartitions(*keys, "id")
    at = len(keys)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, at):
            elements = [np.frombuffer(x, U64) for x in group.column(at + 1).to_pylist()]
            yield _edge_batch(similar_links(group.column(at).to_numpy(), elements, percent, *[group.column(at + 2 + k).to_numpy() for k in range(len(extra))]))

    return met.mapInArrow(verify, "a long, b long")


def linked_sets(docs: DataFrame, id_col: str, text_col: str, groups: DataFrame, width: int, percent: int, block: int, parts: int) -> DataFrame:
    """(id, component) of the nodes in `groups` (id, component, rep, key) that links connect, verified on whole sets."""
    large = groups.groupBy("component").agg(F.count("*").alias("members"))
    sized = materialise(groups.join(large, "component").withColumn("blocks", F.ceil(F.col("members") / block).cast("int")))
    places = F.when(F.col("id") == F.col("component"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    sets = member_sets(docs, id_col, text_col, sized.select("id", "rep", "key", "component", "blocks"), width)
    first = materialise(verified_edges(sets.select("component", "id", "elements", F.explode(places).alias("block")), ["component", "block"], percent, parts))
    linked = connected_components(first)
    # groups of several blocks that are not one class yet: what stands outside the largest class meets all others
    classes = sized.where("blocks > 1").join(linked.withColumnRenamed("component", "class"), "id", "left").withColumn("class", F.coalesce("class", "id"))
    counts = classes.groupBy("component", "class").agg(F.count("*").alias("n"))
    tops = counts.groupBy("component").agg(F.count("*").alias("classes"), F.max_by("class", F.struct("n", -F.col("class"))).alias("top"), F.max("n").alias("most")).where("classes > 1")
    open_ = materialise(classes.join(tops, "component").withColumn("open", F.col("members") - F.col("most")))
    if open_.isEmpty():
        return linked
    sets = member_sets(docs, id_col, text_col, open_.select("id", "rep", "key", "component", "class", "top", "members", "open"), width)
    dealt = _dealt(sets, "members", F.col("class") != F.col("top"), "open", block)
    second = verified_edges(dealt, ["component", "held", "sought"], percent, parts)
    return connected_components(first.union(second))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 80, slots: int = SLOTS, bands: int = BANDS, least_equal: int = LEAST_EQUAL, block: int = BLOCK, keep_keys: bool = False) -> DataFrame:
    """(id, n_shingles, component_id[, set_key, component_key]) of each row: links at a Jaccard similarity of `percent` / 100 or more.

    `component_id` is the smallest id that links reach. `least_equal` belongs to the threshold. `set_key` is
    that of the row's set, `component_key` the smallest that stands with `component_id` in the component.
    """
    spark = docs.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    signed = materialise(signatures(docs, id_col, text_col, width, slots, bands))
    copies = signed.where("n > 0 and id is not null").groupBy("key").agg(F.min("id").alias("rep"))
    # Nodes are sets: an id may stand with several texts.
    copies = materialise(copies.withColumn("node", F.monotonically_increasing_id()))
    chosen = signed.where("n > 0").withColumnRenamed("id", "rep").join(copies, ["rep", "key"]).dropDuplicates(["key"])
    reps = materialise(chosen.select(F.col("node").alias("id"), "bands", "sig"))
    groups = connected_components(materialise(forest(candidate_edges(reps, least_equal, block, parts))))
    groups = materialise(groups.join(copies.withColumnRenamed("node", "id"), "id"))
    linked = linked_sets(docs, id_col, text_col, groups, width, percent, block, parts)
    placed = materialise(copies.join(linked.withColumnRenamed("id", "node"), "node", "left").select("key", "rep", "component"))
    members = placed.where("component is not null")
    # written before it is joined: Spark splits a skewed join only where no sum stands between it and the shuffle
    first = materialise(members.groupBy("component").agg(F.min(F.struct("rep", "key")).alias("first")))
    named = lambda id_, key: ("key", id_.alias("component_id"), key.alias("component_key"))
    alone = placed.where("component is null").select(*named(F.col("rep"), F.col("key")))
    final = alone.union(members.join(bounded(first), "component").select(*named(F.col("first.rep"), F.col("first.key"))))
    own = F.col("n") > 0
    out = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(own, F.col("component_id")).otherwise(F.col("id")).alias("component_id")]
    keys = [F.col("key").alias("set_key"), F.when(own, F.col("component_key")).otherwise(F.col("key")).alias("component_key")]
    return signed.select("id", "n", "key").join(final, "key", "left").select(*out, *(keys if keep_keys else []))


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all `documents`: 4-word shingles, similarity of 0.8 or more."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


_LOWER_SQL = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
ORACLE_SQL = f"""
with recursive d as (select doc_id, list_filter(string_split_regex({_LOWER_SQL}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, array_to_string(list_slice(w, i, i + 3), ' ') as sh from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2),
e as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 80 * (nx.n + ny.n - c)),
r(doc_id, c) as (select doc_id, doc_id from d union select r.doc_id, e.y from r join e on r.c = e.x)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, m.c as component_id, m.c = d.doc_id as kept
from d join (select doc_id, min(c) as c from r group by 1) m on d.doc_id = m.doc_id left join n on n.doc_id = d.doc_id
"""
