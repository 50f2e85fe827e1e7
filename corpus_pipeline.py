"""A training-data pipeline over `documents`: five stages, each one operator of `ledgermint.llm`.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each stage's result as
Parquet into the shared folder and reads it again for the next one. All stages but the last return
the columns of `documents`, whatever else these may be. Each works on all that its predecessor kept.

Null texts pass the filters as empty texts; repeated rows are judged one by one; an empty table gives
an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgermint.llm.common import bounded, materialise, shared_folder, small_arrow_batches, table
from ledgermint.llm.decontam import drop_contaminated
from ledgermint.llm.neardup import near_duplicates, set_key
from ledgermint.llm.packing import pack_documents
from ledgermint.llm.quality import THRESHOLD, learned_rows, quality_score, train_quality_model
from ledgermint.llm.secrets import redact, secret_spans


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below the threshold go."""
    small_arrow_batches(spark)
    machine = train_quality_model(docs, learned_rows(table(spark, sf_dir, "labels")))
    scored = docs.withColumn("_score", quality_score(F.col("text"), machine))
    return scored.where(F.col("_score") >= THRESHOLD).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id. Five-word shingles, similarity 0.8.

    Rows of one id with different texts are judged by their texts, each in its own group.
    """
    small_arrow_batches(spark)
    found = near_duplicates(docs, width=5, keep_keys=True)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id")
    if repeated.isEmpty():
        return docs.join(bounded(materialise(gone)), "doc_id", "left_anti").select(*docs.columns)
    repeated = materialise(repeated)
    gone = materialise(gone.join(repeated, "doc_id", "left_anti"))
    single = docs.join(repeated, "doc_id", "left_anti").join(bounded(gone), "doc_id", "left_anti")
    # Of rows that repeat both the id and the set of shingles, one stays: the first by its text, then by the hash of the row.
    first = found.where((F.col("doc_id") == F.col("component_id")) & (F.col("set_key") == F.col("component_key"))).select("doc_id", F.col("set_key").alias("_key")).distinct()
    keyed = docs.join(repeated, "doc_id", "left_semi").withColumn("_key", set_key(F.col("text"), 5)).join(first, ["doc_id", "_key"], "left_semi")
    order = Window.partitionBy("doc_id", "_key").orderBy("text", F.xxhash64(*docs.columns))
    once = keyed.withColumn("_rank", F.row_number().over(order)).where("_rank = 1")
    return single.select(*docs.columns).unionByName(once.select(*docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark in the text, and `n_chars` follows; every document stays."""
    small_arrow_batches(spark)
    spans = docs.withColumn("_spans", secret_spans(F.col("text"))).withColumn("_text", redact(F.col("text"), F.col("_spans")))
    changed = F.size("_spans") > 0
    fresh = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(changed, F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return spans.select(*[fresh[c].alias(c) if c in fresh else F.col(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, tokenised and packed best-fit into sequences of at most 1024 tokens: one row per piece, with its ids."""
    small_arrow_batches(spark)
    return pack_documents(docs, keep_ids=True, cache_entries=500_000)  # the stages before leave their workers' memory in use


STAGES = [
    ("quality_classifier", quality_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scan", secret_stage),
    ("best_fit_packing", packing_stage),
]
#: A trained classifier and a tokenizer are beyond SQL; tests compare each stage with its operator, which has tests of its own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over the whole table `documents`."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
