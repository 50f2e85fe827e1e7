import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from ledgermint.llm.common import utf8
from ledgermint.llm.packing import BestFit, pack_documents, tokenizer_path
from ledgermint.llm.tokens import BatchEncoder

SCHEMA = "doc_id long, text string, length string"
ROWS = [(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (4, "secret é € 漢字 " * 900, "x"), (5, "hello world", "x"), (5, "hello world", "x"), (None, "no id", None)]


def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return t


def encoded(texts, **options):
    return [ids.tolist() for ids in BatchEncoder(tokenizer_path(), **options).rows(*utf8(pa.array(texts, pa.string())))]


def test_batches_are_encoded_like_whole_texts(monkeypatch):
    t, rng = tokenizer(), random.Random(5)
    texts = ["it's  we've\n\n x\t\ty ", "½ ² x3 Ⅷ 一二 三", "a\x1cb \x1f c", "<|endoftext|> x", " “q” — € 12٣", "", None, " ", "_x_ __ a_b", "😀 ok😀", "Ünïcode ÿ 'S's", "x" * 300 + " y" * 80, "\x85\xa0 ", "''s 'll'd"]
    marks = [*"abz'srtmdvel  \n\t19_-.,\"’“—…€é×÷ßøŁſƀɐ²ºª\xa0\x85\x1c\x00\x7f漢😀", "'re", "'ve", "'ll", " '", "\n "]
    texts += ["".join(rng.choice(marks) for _ in range(rng.randrange(40))) for _ in range(4000)]
    whole = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert encoded(texts) == whole
    assert encoded(texts, entries=300, longest=3) == whole  # the table starts anew again and again
    monkeypatch.setattr("ledgermint.llm.tokens.SPLIT_BYTES", 64)  # long texts are cut
    assert encoded([" ".join(x for x in texts if x), None, "a b"]) == [t.encode(x, add_special_tokens=False).ids for x in (" ".join(x for x in texts if x), "", "a b")]


def test_round_trip_and_places(spark):
    out = pack_documents(spark.createDataFrame(ROWS, SCHEMA)).collect()
    t, by_doc, bins = tokenizer(), defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
    for doc_id, text, _ in ROWS:
        rows = sorted(by_doc[doc_id], key=lambda r: (r.piece, r.sequence_id))
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        if doc_id != 5:
            assert np.frombuffer(b"".join(bytes(r.ids) for r in rows), "<u4").tolist() == ids
            assert [r.start for r in rows] == list(np.cumsum([0, *[r.length for r in rows]])[:-1])
        assert all(r.length == 1024 for r in rows if r.piece > 0)
    assert len(by_doc[5]) == 2
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024


def test_best_fit_takes_the_tightest_bin():
    rng = np.random.default_rng(0)
    tree, rooms = BestFit(100), []
    for n in sorted(rng.integers(1, 101, 400).tolist(), reverse=True):
        bin_, offset = tree.place(n)
        fitting = [r for r in rooms if r >= n]
        if fitting:
            assert rooms[bin_] == min(fitting)
            assert offset == 100 - rooms[bin_]
            rooms[bin_] -= n
        else:
            assert bin_ == len(rooms) and offset == 0
            rooms.append(100 - n)


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0
