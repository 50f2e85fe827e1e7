import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgermint.operators import merchant_codes, merchant_index, resolve, route
from ledgermint.plans.fixture import TAXONOMY, gazetteer, txn

COLUMNS = "row_pos int, merchant_id int, canonical_name string, aliases string, category string, subcategory string"
WORDS = "apex blue cedar delta ember frost grand haven iron jade foods stores motors pharma traders telecom bakery books sweets optics".split()


def random_gazetteer(spark, rng, n):
    name = lambda: " ".join(rng.choices(WORDS, k=rng.randint(1, 3))) + rng.choice(["", "*", f" {rng.randrange(9)}"])
    rows = [(i, 100 + i, name(), ",".join(name() for _ in range(rng.randrange(3))), rng.choice(["a", "b", None]), None) for i in range(n)]
    return spark.createDataFrame([*rows, (n, 1, "AB", "pvr,,é1", "c", "d"), (n + 1, 2, "", "pvr", None, None)], COLUMNS)


def random_texts(spark, rng, n):
    def text():
        s = " ".join(rng.choices(WORDS, k=rng.randint(1, 3))) + rng.choice(["", " 7", "-PAY", "*x"])
        return "".join(c if rng.random() > 0.1 else rng.choice("aé ") for c in s)

    texts = [text() for _ in range(n)] + [None, "", " ", "*", "A", "AB", "ABC", "pvr cinemas", "x" * 5000, "pvr", "pvr"]
    return spark.createDataFrame([(i, t, rng.choice(texts), "clash") for i, t in enumerate(texts)], "k int, whole string, merchant string, score string")


def test_answers_are_those_of_the_joins(spark):
    rng = random.Random(5)
    g, rows = random_gazetteer(spark, rng, 60), random_texts(spark, rng, 150)
    for least, fuzzy, text in ((0.6, True, "whole"), (0.8, False, None)):
        index = merchant_index.compile_index(g, least, fuzzy)
        got = index.attach(rows, "merchant", max(least, 0.8), text, least)
        want = resolve.attach_merchant(rows, g, "merchant", max(least, 0.8), fuzzy, text, least)
        assert got.columns == want.columns
        a, b = [{r.k: tuple(r) for r in df.collect()} for df in (got, want)]
        assert a == b and sum(r[-1] is not None for r in a.values()) > 30


def test_bounds_and_empty_tables(spark, monkeypatch):
    none = spark.createDataFrame([], COLUMNS)
    rows = spark.createDataFrame([(1, "ZOMATO"), (2, None)], "k int, merchant string")
    assert [r.merchant_score for r in merchant_index.compile_index(none).attach(rows).collect()] == [None, None]
    index = merchant_index.compile_index(gazetteer(spark))
    assert index.attach(rows.where("false")).count() == 0
    with pytest.raises(ValueError, match="compiled for thresholds"):
        index.attach(rows, threshold=0.6)
    monkeypatch.setattr(merchant_index, "MOST_NAMES", 10)
    with pytest.raises(ValueError, match="too many for an index"):
        merchant_index.compile_index(gazetteer(spark))


def test_a_stream_is_one_plan(spark, tmp_path, monkeypatch):
    rows = txn(spark, "/root/testdata/sf0.001").where("txn_key % 5 = 0").repartition(3)
    rows.write.parquet(f"{tmp_path}/in")
    codes, g = merchant_codes.code_table(spark), gazetteer(spark)
    shown = ["txn_key", "category", "subcategory", "confidence", "method", "requires_review", "merchant_resolved", "merchant_score"]
    want = Counter(tuple(r) for r in route.categorize(rows, TAXONOMY, g, codes).select(*shown).collect())  # keys repeat in this table
    index = merchant_index.compile_index(g)

    def refused(_):
        raise AssertionError("a stream must not be written on its way")

    monkeypatch.setattr(route, "materialise", refused)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    routed = route.categorize(stream, TAXONOMY, index, codes).select(*shown)
    assert routed.isStreaming
    q = routed.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(q.recentProgress) >= 3 and not q.lastProgress["stateOperators"]
    out = spark.read.parquet(f"{tmp_path}/out")
    assert Counter(tuple(r) for r in out.collect()) == want and want.total() > 500
    # a second start reads only what is new
    rows.limit(1).select(F.lit(-1).cast("long").alias("txn_key"), *rows.columns[1:]).write.mode("append").parquet(f"{tmp_path}/in")
    q = routed.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == want.total() + 1
