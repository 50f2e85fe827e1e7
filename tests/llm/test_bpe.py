import base64
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from ledgermint.llm.bpe import RankEncoder, bpe_decode, bpe_encode, cut_chunks, stitched

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    return RankEncoder(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def whole():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("whole", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_text(rng, n):
    kinds = ["word ", "It's we'll ", "'s't", "12345", "  \n\t ", "…—", "naïve ", "日本語", "𝒳", "don't", "!!!", " ", " ", "x" * 70, "é" * 40]
    return "".join(rng.choice(kinds) for _ in range(n))


def chunked(encoder, text, chunk, overlap):
    data = np.frombuffer(text.encode(), np.uint8)
    asked = []

    def scan(part):
        asked.append(len(part))
        return encoder.starts(part)

    parts = ((a, data[a:b], encoder.starts(data[a:b])) for a, b in cut_chunks(data, chunk, overlap))
    return *stitched(parts, scan), data, asked


def test_stitched_chunks_are_the_pre_tokens_of_the_whole_text(encoder):
    rng = random.Random(7)
    for _ in range(400):
        text = random_text(rng, rng.randrange(1, 120))
        made, starts, data, _ = chunked(encoder, text, rng.choice([96, 130, 200]), rng.choice([36, 40]))
        assert (made == data).all() and starts.tolist() == encoder.starts(data).tolist()


def test_words_longer_than_the_overlap_are_scanned_on_in_proportion(encoder):
    for text in ("a" * 40_000, "a" * 5_000 + " b" * 3_000 + "1" * 5_000, " " * 20_000 + "x", "'" * 9_000):
        made, starts, data, asked = chunked(encoder, text, 200, 50)
        assert (made == data).all() and starts.tolist() == encoder.starts(data).tolist()
        assert sum(asked) < 6 * len(text)


def test_ids_are_those_of_the_whole_encoder_and_decode_to_the_bytes(spark, whole):
    rng = random.Random(3)
    long = random_text(rng, 6_000)
    texts = ["", None, "a", long, long, "a" * 30_000, "<|endoftext|> as text", *[random_text(rng, rng.randrange(1, 60)) for _ in range(40)]]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, ids string")
    for sizes in ({}, {"chunk": 500, "overlap": 64}):
        encoded = bpe_encode(docs, PATH, P.PATTERN, **sizes)
        found = bpe_decode(encoded, PATH, P.PATTERN).collect()
        assert sorted(map(str, bpe_encode(docs, PATH, P.PATTERN, decode=True, **sizes).collect())) == sorted(map(str, found))
        assert len(found) == len(rows) + 1 and set(encoded.columns) == {"doc_id", "n_tokens", "ids"}
        for r in found:
            text = texts[r.doc_id] or ""
            ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
            assert ids == whole.encode_ordinary(text) and len(ids) == r.n_tokens and bytes(r.decoded) == text.encode()


def test_derived_columns_stand_for_ids_and_bytes(spark, whole):
    long = "long text of words " * 100
    docs = spark.createDataFrame([(1, long), (2, long), (3, "short"), (4, None)], "doc_id long, text string")
    got = bpe_encode(docs, PATH, P.PATTERN, chunk=500, overlap=64, decode=True, derive={"bytes": F.length("decoded"), "first": F.hex(F.substring("ids", 1, 4))})
    assert got.columns == ["doc_id", "n_tokens", "bytes", "first"]
    for r in got.collect():
        text = {1: long, 2: long, 3: "short", 4: ""}[r.doc_id]
        ids = whole.encode_ordinary(text)
        assert (r.n_tokens, r.bytes) == (len(ids), len(text)) and (r.first == np.array(ids[:1], "<u4").tobytes().hex().upper())


def test_an_empty_table_gives_an_empty_result_and_chunks_need_apart_overlaps(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_decode(bpe_encode(docs, PATH, P.PATTERN), PATH, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe_encode(docs, PATH, P.PATTERN, chunk=100, overlap=60)
