"""Learned classification with Spark ML: text vectors, feature matrix, training, calibration, top-k, importance."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IDF, HashingTF, Normalizer, StringIndexer, Tokenizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import calibration
from .boosting import BoostedModel, fit

TEXT_DIMENSIONS = 384


def text_stages(text: str = "search_text", size: int = TEXT_DIMENSIONS) -> list:
    """Tokens hashed to `size` dimensions, weighted by rarity, of length one."""
    return [Tokenizer(inputCol=text, outputCol="tokens"), HashingTF(inputCol="tokens", outputCol="tf", numFeatures=size), IDF(inputCol="tf", outputCol="idf"), Normalizer(inputCol="idf", outputCol="text_vector")]


def feature_columns(df: DataFrame) -> list[str]:
    """Feature columns in sorted order; booleans are cast by `numeric_features`."""
    return sorted(c for c in df.columns if c.startswith("f_"))


def numeric_features(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in feature_columns(df)})


def trained(df: DataFrame, label: str = "label", kind: str = "forest", weight: str | None = None, vector: str | None = None, seed: int = 7, **settings) -> PipelineModel | BoostedModel:
    """A fitted model. `vector` names a given vector column; else text and features are assembled. `kind`: forest, boosted or regression."""
    if kind == "boosted":
        made = None if vector else Pipeline(stages=[*text_stages(), VectorAssembler(inputCols=["text_vector", *feature_columns(df)], outputCol="vector")]).fit(df)
        rows = df if made is None else made.transform(df)
        return BoostedModel(made, fit(rows, vector or "vector", label, weight, **settings), vector or "vector")
    stages: list = [StringIndexer(inputCol=label, outputCol="label_index", handleInvalid="skip", stringOrderType="alphabetAsc")]
    if vector is None:
        stages += [*text_stages(), VectorAssembler(inputCols=["text_vector", *feature_columns(df)], outputCol="vector")]
    vector = vector or "vector"
    common = {"featuresCol": vector, "labelCol": "label_index"} | ({"weightCol": weight} if weight else {})
    stages.append(RandomForestClassifier(numTrees=20, maxDepth=8, seed=seed, **common) if kind == "forest" else LogisticRegression(maxIter=40, regParam=1e-3, **common))
    return Pipeline(stages=stages).fit(df)


def top_k(scored: DataFrame, labels: list[str], k: int = 3) -> DataFrame:
    """`scored` with ml_category, ml_conf and ml_alternatives from its probability vector; ties by label order."""
    p = F.col("probability") if dict(scored.dtypes)["probability"].startswith("array") else vector_to_array("probability")
    named = F.transform(p, lambda p, i: F.struct(F.round(p, 6).alias("confidence"), (-i).alias("order"), F.element_at(F.array(*[F.lit(x) for x in labels]), i + 1).alias("category")))
    best = F.slice(F.reverse(F.array_sort(named)), 1, k)
    out = scored.withColumn("_top", best)
    return out.withColumn("ml_category", F.get("_top", F.lit(0))["category"]).withColumn("ml_conf", F.get("_top", F.lit(0))["confidence"]).withColumn("ml_alternatives", F.transform(F.slice("_top", 2, k), lambda x: F.struct(x["category"].alias("category"), x["confidence"].alias("confidence")))).drop("_top")


def labels_of(model: PipelineModel | BoostedModel) -> list[str]:
    return list(model.labels) if isinstance(model, BoostedModel) else list(model.stages[0].labels)


def importance(spark: SparkSession, model: PipelineModel | BoostedModel, names: list[str], k: int = 20) -> DataFrame:
    """(rank, feature, importance): the k most important inputs of a forest or of boosted trees (shares of all gain). The text's dimensions stand before the named features in the order of the assembler."""
    raw = model.trees.gains if isinstance(model, BoostedModel) else model.stages[-1].featureImportances.toArray()
    total = float(raw.sum()) or 1.0
    if len(names) != len(raw):
        raise ValueError(f"{len(names)} names for {len(raw)} inputs")
    best = sorted(zip(names, (raw / total).tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:k]  # as many as the model has inputs
    return spark.createDataFrame([(i + 1, n, round(v, 9)) for i, (n, v) in enumerate(best)], "rank int, feature string, importance double")


def input_names(df: DataFrame, size: int = TEXT_DIMENSIONS) -> list[str]:
    """The inputs of an assembled vector, in its order."""
    return [*(f"text_{i}" for i in range(size)), *feature_columns(df)]


def out_of_fold(rows: DataFrame, key: str, label: str = "label", kind: str = "forest", folds: int = 3, weight: str | None = None, vector: str | None = None, **settings) -> tuple[DataFrame, list[str]]:
    """`rows` with `fold` and `probability` (an array by the returned labels) of models that did not see the row's fold: one fit per fold, whatever the number of classes."""
    labels = sorted(r[0] for r in rows.where(F.col(label).isNotNull()).select(F.col(label).cast("string")).distinct().collect())  # a row a class

    def fit_on(part: DataFrame):
        model = trained(part, label, kind, weight, vector, **settings)
        own = labels_of(model)

        def score(rest: DataFrame) -> DataFrame:
            made = model.transform(rest) if isinstance(model, BoostedModel) else PipelineModel(model.stages[1:]).transform(rest)
            p = F.col("probability") if isinstance(model, BoostedModel) else vector_to_array("probability")
            return made.select(*rest.columns, F.array(*[F.get(p, F.lit(own.index(x))) if x in own else F.lit(0.0) for x in labels]).alias("probability"))

        return score

    return calibration.out_of_fold(rows, key, fit_on, folds), labels


def centroids(df: DataFrame, embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(label, centroid): mean vector of each label, by sums before the shuffle."""
    cells = df.select(label, F.posexplode(embedding).alias("i", "x"))
    means = cells.groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def nearest_label(df: DataFrame, centres: DataFrame, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(key, pred, distance): the label whose centroid is nearest, distances compared to 9 digits and ties to the smaller label; `centres` has a row per label, and goes into each row's expression as one array.

    `distance` is not rounded, so that a caller who rounds it rounds once.
    """
    listed = [(r["label"], [float(x) for x in r["centroid"]]) for r in centres.select("label", "centroid").collect()]
    kind = dict(centres.dtypes)["label"]
    literal = F.array(*[F.struct(F.lit(l).cast(kind).alias("label"), F.array(*[F.lit(x) for x in c]).alias("centre")) for l, c in sorted(listed, key=lambda x: str(x[0]))])
    gap = lambda c: F.aggregate(F.zip_with(embedding, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    gaps = F.transform(literal, lambda c: F.struct(gap(c["centre"]).alias("distance"), c["label"].alias("pred")))
    best = F.array_min(F.transform(gaps, lambda g: F.struct(F.round(g["distance"], 9).alias("near"), g["pred"].alias("pred"), g["distance"].alias("distance"))))
    return df.select(key, best.alias("b")).select(key, "b.pred", "b.distance")


def vectors(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    return df.withColumn("vector", array_to_vector(F.transform(embedding, lambda x: x.cast("double"))))


def most_confident(df: DataFrame, per_label: int) -> DataFrame:
    w = Window.partitionBy("ml_category").orderBy(F.desc("ml_conf"))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_label).drop("_n")
