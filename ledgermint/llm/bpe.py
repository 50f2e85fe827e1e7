"""Byte-level BPE: texts to token ids and back, over overlapping chunks of long texts.

A text of at most `chunk` bytes is one chunk. A longer one is cut into chunks that overlap by `overlap` bytes.
Chunks are dealt over all tasks and pre-tokenised there, each from its own first byte. The scan of a chunk keeps
no memory of what stood before a pre-token, so once two scans have a boundary in common they agree from there on:
neighbours are stitched at the first boundary of the overlap that both have. Where they have none (a word longer
than the overlap), the left scan goes on over the right chunk until they meet, so no length of word is lost. Then
the pieces between the stitches are encoded, each distinct one once per worker. Ids decode by concatenating the
bytes of their tokens.

Nulls encode as the empty text, which has no ids. Repeated rows give repeated results; a long text that repeats
is encoded once. An empty table gives an empty result. Input columns named like the added ones are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, chunks, small_arrow_batches, table, utf8
from .tokens import UNKNOWN, BatchEncoder, byte_classes, piece_starts

#: Bytes of a chunk, and of the overlap of two chunks.
CHUNK, OVERLAP = 1 << 14, 1 << 9
#: Pieces that a worker remembers; they and the vocabulary take some 200 MB.
ENTRIES = 500_000
#: A boundary is certain where so many bytes of the chunk follow it: the scan has then seen all it looks at.
SEEN = 8


class RankEncoder(BatchEncoder):
    """Ids of batches of texts by a file of ranks: one line a token, its bytes in base 64 and its rank."""

    def __init__(self, path: str, pattern: str, entries: int = 1_000_000, longest: int = 64):
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.entries, self.longest = entries, longest
        by_rank = sorted((r, b) for b, r in ranks.items())
        self.sizes = np.zeros(by_rank[-1][0] + 1, np.int64)
        self.sizes[[r for r, _ in by_rank]] = [len(b) for _, b in by_rank]
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(b for _, b in by_rank), np.uint8)
        self._empty()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), np.uint32)

    def _encoded(self, pieces: list[bytes]) -> tuple[np.ndarray, list[int]]:
        encode = self.encoding.encode_ordinary
        made = [encode(p.decode()) for p in pieces]  # a pre-token alone is one pre-token again
        counts = [len(m) for m in made]
        return np.array([i for m in made for i in m], np.uint32), counts

    def starts(self, data: np.ndarray) -> np.ndarray:
        """Where the pre-tokens of one run of bytes begin."""
        if not len(data):
            return np.empty(0, np.int64)
        classes = byte_classes(data)
        if (classes != UNKNOWN).all():
            return piece_starts(data, classes, np.array([0, len(data)]))
        text = data.tobytes().decode()
        at = np.fromiter((m.start() for m in self.pattern.finditer(text)), np.int64)
        return np.flatnonzero((data & 0xC0) != 0x80)[at]  # from characters to bytes

    def pieces(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The ids of bytes whose pre-tokens begin at `starts`, in parts of bounded size."""
        made = []
        cut = np.append(starts, len(data))
        for a, b in chunks(cut, 2 * CHUNK_BYTES):
            made.append(self._of_pieces(data[cut[a] : cut[b]], cut[a:b] - cut[a])[0])
        return np.concatenate(made) if made else np.empty(0, np.uint32)

    def decoded(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of tokens in a row."""
        n = self.sizes[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(n) else 0
        return self.bytes[np.repeat(self.begins[ids] - (ends - n), n) + np.arange(total)]


_encoders: dict[tuple[str, str], RankEncoder] = {}


def _encoder(path: str, pattern: str, entries: int) -> RankEncoder:
    """The encoder that this worker process keeps from task to task."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = RankEncoder(path, pattern)
    _encoders[path, pattern].entries = entries
    return _encoders[path, pattern]


def cut_chunks(data: np.ndarray, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """(begin, end) of the chunks of a text: each ends `overlap` bytes after the next one begins; all cut before a character."""
    begins = np.arange(0, max(1, len(data) - overlap), chunk - overlap)
    ends = np.minimum(begins + chunk, len(data))
    ends[-1] = len(data)

    def before_character(at: np.ndarray) -> np.ndarray:
        for _ in range(3):
            inside = at < len(data)
            inside[inside] = (data[at[inside]] & 0xC0) == 0x80
            at = at - inside
        return at

    return list(zip(before_character(begins).tolist(), before_character(ends).tolist(), strict=True))


def stitched(parts: Iterator[tuple[int, np.ndarray, np.ndarray]], scan) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text and its pre-token starts, from (begin, bytes, starts in the chunk) of its chunks in order.

    `scan` gives the starts of some bytes; it is asked only where two chunks do not meet in their overlap. It then
    waits until the bytes since the last certain boundary have doubled, so that its work stays in proportion to them.
    """
    texts: list[np.ndarray] = []
    found: list[np.ndarray] = []
    left, end = None, 0
    since, limit, open_scan = 0, 0, False

    def rescanned() -> np.ndarray:
        back, size = [], 0
        for part in reversed(texts):
            back.append(part)
            size += len(part)
            if size >= end - since:
                break
        return since + scan(np.concatenate(back[::-1])[size - (end - since) :])

    for begin, data, own in parts:
        before, own = end, own + begin
        texts.append(data[end - begin :])
        end = begin + len(data)
        if left is None:
            left = own
        elif not open_scan:
            certain = left[left <= before - SEEN]
            shared = np.intersect1d(certain[certain > begin], own, assume_unique=True)  # the first byte of a chunk begins a scan, not a pre-token
            if len(shared):
                found.append(certain[certain < shared[0]])
                left = own[own >= shared[0]]
            else:
                since = int(certain[-1])
                found.append(certain[:-1])
                open_scan, limit = True, 2 * (before - since)
        if open_scan and end - since >= limit:
            left, open_scan = rescanned(), False
    if open_scan:
        left = rescanned()
    if left is None:
        return np.empty(0, np.uint8), np.empty(0, np.int64)
    return np.concatenate(texts), np.concatenate([*found, left])


def _pack(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()


def bpe_encode(docs: DataFrame, path: str, pattern: str, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, entries: int = ENTRIES, decode: bool = False, derive: dict[str, Column] | None = None) -> DataFrame:
    """`docs` without its text, with `n_tokens` and `ids` (binary: little-endian unsigned 32-bit integers).

    `path` names the file of ranks, which every worker must be able to read; `entries` bounds the pieces that a
    worker remembers. `chunk` must be over twice `overlap`, so that the overlaps of a chunk are apart. With
    `decode`, the result is that of `bpe_decode` of it, with one Python worker a task instead of two.

    `derive` gives columns that are made of `n_tokens`, `ids` and `decoded` and stand for the last two: what is derived
    from a long text, once for all its copies, is then all that is joined to its rows.
    """
    if not chunk > 2 * overlap > 4 * SEEN:
        raise ValueError("chunk must be over twice overlap, and overlap over twice what a scan sees")
    small_arrow_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in {text, "ids", "n_tokens", "decoded"}]
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(*kept, whole.alias("_text"))
    is_long = F.octet_length("_text") > chunk

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern, entries)
        for batch in batches:
            data, offsets = utf8(batch.column(len(kept)))
            for a, b in chunks(offsets, 4 * CHUNK_BYTES):
                ids = list(encoder.rows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                own = batch.slice(a, b - a)
                columns = [*own.columns[: len(kept)], pa.array([len(x) for x in ids], pa.int64()), pa.array(map(_pack, ids), pa.binary())]
                columns += [pa.array([encoder.decoded(x).tobytes() for x in ids], pa.binary())] if decode else []
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n_tokens", "ids", *["decoded"] * decode])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, key in enumerate(batch.column(0).to_pylist()):
                own = data[offsets[i] : offsets[i + 1]]
                places = cut_chunks(own, chunk, overlap)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(places)), pa.array([a for a, _ in places], pa.int64()), pa.array([own[a:b].tobytes() for a, b in places], pa.binary())], names=["_key", "_begin", "_part"])

    def pre_tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern, entries)
        for batch in batches:
            marks = []
            for part in batch.column(2):
                data = np.frombuffer(part.as_buffer(), np.uint8)
                mark = np.zeros(len(data), bool)
                mark[encoder.starts(data)] = True
                marks.append(np.packbits(mark).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.binary())], names=["_key", "_begin", "_part", "_marks"])

    def stitch(group: pa.Table) -> pa.Table:
        encoder = _encoder(path, pattern, entries)
        group = group.sort_by("_begin")

        def parts():
            for begin, part, marks in zip(group["_begin"].to_pylist(), group["_part"].to_pylist(), group["_marks"].to_pylist(), strict=True):
                data = np.frombuffer(part, np.uint8)
                yield begin, data, np.flatnonzero(np.unpackbits(np.frombuffer(marks, np.uint8))[: len(data)])

        ids = encoder.pieces(*stitched(parts(), encoder.starts))
        columns = {"_key": [group["_key"][0].as_py()], "n_tokens": pa.array([len(ids)], pa.int64()), "ids": pa.array([_pack(ids)], pa.binary())}
        return pa.table(columns | ({"decoded": pa.array([encoder.decoded(ids).tobytes()], pa.binary())} if decode else {}))

    made = [("n_tokens", "long"), ("ids", "binary"), *[("decoded", "binary")] * decode]
    out = ", ".join(f"{c} {kind}" for c, kind in made)
    schema = rows.drop("_text").schema
    for c, kind in made:
        schema = schema.add(c, kind)
    derived = [c.alias(name) for name, c in derive.items()] if derive else [c for c, _ in made[1:]]
    short = rows.where(~is_long).mapInArrow(encode, schema).select(*kept, "n_tokens", *derived)
    long = rows.where(is_long).withColumn("_key", F.sha2("_text", 256))
    distinct = rows.where(is_long).select("_text").distinct().select(F.sha2("_text", 256).alias("_key"), "_text")
    parts = distinct.mapInArrow(cut, "_key string, _begin bigint, _part binary").repartition("_key", "_begin")
    found = parts.mapInArrow(pre_tokenise, "_key string, _begin bigint, _part binary, _marks binary").groupBy("_key").applyInArrow(stitch, f"_key string, {out}")
    return short.unionByName(long.drop("_text").join(found.select("_key", "n_tokens", *derived), "_key").drop("_key"))


def bpe_decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", entries: int = ENTRIES) -> DataFrame:
    """`encoded` with `decoded` (binary), the bytes of its ids; null ids decode to no bytes."""
    small_arrow_batches(encoded.sparkSession)
    kept = [c for c in encoded.columns if c != "decoded"]
    at = kept.index(ids)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern, entries)
        for batch in batches:
            data, offsets = utf8(batch.column(at).cast(pa.large_binary()))
            for a, b in chunks(offsets, 4 * CHUNK_BYTES):
                own = batch.slice(a, b - a)
                made = [encoder.decoded(np.frombuffer(data[offsets[i] : offsets[i + 1]].tobytes(), "<u4")).tobytes() for i in range(a, b)]
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(made, pa.binary())], names=[*kept, "decoded"])

    return encoded.select(*kept).mapInArrow(decode, encoded.select(*kept).schema.add("decoded", "binary"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    digests = {f"{c}_sha256": F.sha2(c, 256) for c in ("ids", "decoded")}
    return bpe_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern, decode=True, derive=digests)
