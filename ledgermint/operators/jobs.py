"""Training jobs: preparation, training with validation, models on disk, feedback and retraining pipelines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermint.functions.lineage import materialise

from . import dataset, evaluate, learn, ml, normalize
from .boosting import BoostedModel


def prepared(df: DataFrame, templates: DataFrame | None = None, share: float = 0.3, label: str = "label", key: str = "txn_key") -> DataFrame:
    """Training rows (key, text, label, amount, date): given ones and, with templates, spoken forms of a `share` of them, normalised, with numeric features."""
    rows = df.withColumn("augmented", F.lit(False)) if templates is None else dataset.augmented(df, templates, share, label, key)
    return ml.numeric_features(normalize.features(normalize.normalize(rows)))


@dataclass
class Trained:
    """A fitted model, its classes, the predictions on the rows it was not fitted on, and their metrics (one row)."""

    model: PipelineModel | BoostedModel
    labels: list[str]
    predictions: DataFrame
    metrics: DataFrame


def train(rows: DataFrame, label: str = "label", key: str = "txn_key", kind: str = "forest", share: float = 0.8, weighted: bool = True, vector: str | None = None, gate: float = 0.90, **settings) -> Trained:
    """A model (a forest, a regression, or boosted trees with their `settings`) fitted on `share` of the rows of each class and judged on the rest. `weighted` weighs classes where they are unbalanced."""
    parts = dataset.split(rows, share, key, by=label)
    weights = dataset.class_weights(rows, label).select(F.col(label).alias("_l"), F.col("weight").alias("class_weight"))
    parts = materialise(parts.join(F.broadcast(weights), F.col(label) == F.col("_l")).drop("_l"))  # a row per class
    model = ml.trained(parts.where("part = 'train'"), label, kind, "class_weight" if weighted else None, vector, **settings)
    labels = ml.labels_of(model)
    scored = ml.top_k(model.transform(parts.where("part = 'validation'")), labels).withColumn("pred", F.col("ml_category"))
    predictions = materialise(scored.select(key, label, "pred", F.col("ml_conf").alias("confidence")))
    return Trained(model, labels, predictions, evaluate.summary(evaluate.class_report(predictions, label), gate))


def save(model: PipelineModel | BoostedModel, path: str, spark: SparkSession | None = None) -> None:
    if isinstance(model, BoostedModel):
        model.save(path, spark or SparkSession.active())
    else:
        model.write().overwrite().save(path)


def load(path: str, boosted: bool = False) -> PipelineModel | BoostedModel:
    return BoostedModel.load(path, SparkSession.active()) if boosted else PipelineModel.load(path)


def score(rows: DataFrame, model: PipelineModel | BoostedModel, k: int = 3) -> DataFrame:
    """`rows` with ml_category, ml_conf and ml_alternatives of a model."""
    return ml.top_k(model.transform(rows), ml.labels_of(model), k)


def feedback_learning(base: DataFrame, feedback: DataFrame, accepted: DataFrame, least: int = 1, **options) -> tuple[DataFrame, DataFrame, Trained]:
    """From feedback (txn_key, text, label, amount, date, was_incorrect): the training rows with it, a few-shot set, and a model of these rows."""
    more = learn.feedback_training_rows(feedback, least)
    rows = dataset.union_sources(base, more)
    shots = learn.few_shot_set(accepted, feedback.where("was_incorrect"))
    return rows, shots, train(prepared(rows), **options)


def retrain(spark: SparkSession, base: DataFrame, corrections: DataFrame, path: str, **options) -> Trained:
    """Merges corrections (text, label, pos, and amount, date, subcategory where known) into the training rows, writes these with all their columns below `path`, and trains and saves a model there."""
    merged = dataset.merge_corrections(base, corrections)
    for name, kind in (("amount", "double"), ("date", "string")):
        merged = merged if name in merged.columns else merged.withColumn(name, F.lit(None).cast(kind))
    merged.withColumn("txn_key", F.xxhash64("text", "label", "amount", "date")).write.mode("overwrite").parquet(f"{path}/rows")
    trained = train(prepared(spark.read.parquet(f"{path}/rows")), **options)
    save(trained.model, f"{path}/model", spark)
    return trained
