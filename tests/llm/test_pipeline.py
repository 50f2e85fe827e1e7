from collections import Counter

import corpus_pipeline as cp
from ledgermint.llm.decontam import find_contamination
from ledgermint.llm.neardup import near_duplicates
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_and_decisions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "minhash_near_dedup", "benchmark_decontamination", "secret_scan", "best_fit_packing"]
    previous = docs.cache()
    for name, stage in cp.STAGES:
        out = stage(spark, previous, SF).cache()
        if name != "best_fit_packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        ids, before = Counter(r.doc_id for r in out.select("doc_id").collect()), {r.doc_id for r in previous.select("doc_id").collect()}
        assert set(ids) <= before
        if name == "minhash_near_dedup":
            classes = near_duplicates(previous, width=5).select("doc_id", "component_id").collect()
            assert set(ids) == {r.doc_id for r in classes if r.doc_id == r.component_id} and max(ids.values()) == 1
        if name == "benchmark_decontamination":
            assert find_contamination(out, spark.read.parquet(f"{SF}/benchmark.parquet")).where(F.size("hits") > 0).count() == 0
        if name in ("secret_scan", "best_fit_packing"):
            assert set(ids) == before
        if name == "secret_scan":
            assert out.where(F.col("text").rlike("AKIA[A-Z0-9]{12}")).count() == 0
        previous = out


def test_rows_of_the_whole(spark):
    out = cp.run(spark, SF)
    assert out.count() == out.select("doc_id", "piece").distinct().count() > 0


def test_clashing_and_odd_rows(spark, tmp_path):
    rows = [(1, "a good plain text of several words here", "en", None, None, "k"), (2, None, None, None, 0, "k"), (2, None, None, None, 0, "k"), (3, "", "en", "s", 0, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.doc_id for r in cp.run(spark, str(tmp_path)).collect()} == {1, 2, 3}


def test_a_near_copy_does_not_take_another_text_of_its_id(spark):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, one), (2, one + " x"), (2, two), (2, two), (3, two + " y"), (4, "some few other words in a row"), (4, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text or "") for r in cp.near_duplicate_stage(spark, docs, SF).collect())
    assert got == [(1, one), (2, two), (4, ""), (4, "some few other words in a row")]
