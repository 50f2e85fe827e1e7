"""Best-fit packing of tokenised documents into fixed-length sequences.

1. Tokenise and cut (`token_pieces`): ids of a public vocabulary (`tokens`), then an end id.
   A document longer than a sequence is cut into full pieces; its first piece takes the rest and
   may be shorter. Full pieces are sequences of their own.
2. Pack (`best_fit_pack`): shorter pieces are dealt by a hash of the id into groups of bounded size
   and each group is packed best-fit decreasing. A segment tree over remaining capacities finds the
   tightest open bin in log2(capacity) steps. A group's last few bins are all that dealing can cost.

Null text counts as empty: such a document is the end id alone. Repeated rows are packed as often as
they occur. A null id is kept. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, table, utf8
from .tokens import encoder_of

CAPACITY, END_ID = 1024, 2
#: Rows that one group packs; more rows make more groups.
GROUP_ROWS = 1 << 17
#: Distinct pieces that a worker keeps the ids of before it starts anew (memory against time).
CACHE_ENTRIES = 1_000_000


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): the pieces of each row's tokens, of at most `capacity` tokens; the first may be shorter.

    `ids` holds little-endian 32-bit ids. Rows leave one piece at a time, so a very long document is no large row.
    """
    most = 1 << 21  # bytes of ids in a batch that leaves, about

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path(vocabulary), cache_entries)
        end = np.array([end_id], "<u4")
        rows: list[tuple[int, int, int, int, int, bytes]] = []

        def leave(keys: pa.Array) -> pa.RecordBatch:
            at, piece, start, length, crc, ids = zip(*rows, strict=True)
            cols = [keys.take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                cols.append(pa.array(ids, pa.binary()))
                names.append("ids")
            rows.clear()
            return pa.RecordBatch.from_arrays(cols, names)

        for batch in batches:
            size = 0
            for i, found in enumerate(encoder.rows(*utf8(batch.column(1)))):
                whole = np.concatenate([found.astype("<u4", copy=False), end])
                n, at = len(whole), 0
                stop = (n - 1) % capacity + 1
                for k in range(-(-n // capacity)):
                    ids = whole[at:stop].tobytes()
                    rows.append((i, k, at, stop - at, zlib.crc32(ids), ids if keep_ids else b""))
                    at, stop = stop, stop + capacity
                    size += len(rows[-1][5]) + 64
                    if size >= most:
                        yield leave(batch.column(0))
                        size = 0
            if rows:
                yield leave(batch.column(0))

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


class BestFit:
    """Best-fit over bins by remaining capacity: a segment tree says which capacities have an open bin."""

    def __init__(self, capacity: int):
        self.capacity, self.size = capacity, 1 << capacity.bit_length()
        self.tree = bytearray(2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bins = 0

    def _mark(self, room: int, on: int) -> None:
        i, tree = room + self.size, self.tree
        tree[i] = on
        while i > 1:
            i >>= 1
            now = tree[2 * i] | tree[2 * i + 1]
            if tree[i] == now:
                return
            tree[i] = now

    def _tightest(self, least: int) -> int:
        """The smallest remaining capacity of `least` or more that an open bin has, else -1."""
        i, tree = least + self.size, self.tree
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):
                i >>= 1
            if i <= 1:
                return -1
            i += 1
            while i < self.size:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        return i - self.size

    def place(self, length: int) -> tuple[int, int]:
        """The bin that takes `length`, and the offset in it."""
        room = self._tightest(length)
        if room < 0:
            bin_, room = self.bins, self.capacity
            self.bins += 1
        else:
            bin_ = self.open[room].pop()
            if not self.open[room]:
                self._mark(room, 0)
        left = room - length
        if left:
            self.open[left].append(bin_)
            if len(self.open[left]) == 1:
                self._mark(left, 1)
        return bin_, self.capacity - room


def best_fit_pack(items: DataFrame, group_col: str, length_col: str, capacity: int = CAPACITY) -> DataFrame:
    """`items` with bin (from 0 in each group) and offset, packed best-fit decreasing within each group.

    Lengths are 1 to `capacity`. Ties go in the order of all columns, so a task that runs again
    packs alike.
    """

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([(length_col, "descending")] + [(c, "ascending") for c in t.column_names if c != length_col])
        tree = BestFit(capacity)
        placed = [tree.place(n) for n in t.column(length_col).to_pylist()]
        return t.append_column("bin", pa.array([b for b, _ in placed], pa.int64())).append_column("offset", pa.array([o for _, o in placed], pa.int64()))

    kept = [(c, k) for c, k in items.dtypes if c not in ("bin", "offset")]
    return items.select(*[c for c, _ in kept]).groupBy(group_col).applyInArrow(pack, ", ".join(f"`{c}` {k}" for c, k in kept) + ", bin long, offset long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True, group_rows: int = GROUP_ROWS, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and with `keep_ids` its ids.

    `sequence_id` is unique over the table, not consecutive: packed bins from 0, full pieces below 0.
    The pieces are kept in the shared folder; only the keys and lengths of short ones are shuffled to
    be packed, and only short ones meet their places again by a join.
    """
    pieces = token_pieces(docs, id_col, text_col, vocabulary, capacity, end_id, keep_ids, cache_entries)
    pieces = materialise(pieces.withColumn("_key", F.monotonically_increasing_id()))
    short = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-short.count() // group_rows))
    items = short.select("_key", "length", F.pmod(F.xxhash64("_key"), F.lit(groups)).cast("int").alias("_pack"))
    packed = best_fit_pack(items, "_pack", "length", capacity).select(F.col("_key").alias("_k"), (F.col("_pack").cast("long") * F.lit(1 << 40) + F.col("bin")).alias("sequence_id"), "offset")
    columns = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if keep_ids else [])]
    placed = short.join(packed, F.col("_key") == F.col("_k")).select(*columns)
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", -F.col("_key") - 1).withColumn("offset", F.lit(0).cast("long"))
    return placed.unionByName(full.select(*columns))


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All `documents` packed into sequences of at most 1024 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), keep_ids=False)
