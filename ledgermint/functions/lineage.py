"""Cutting lineage where a result is used several times, and spreading small inputs."""

from __future__ import annotations

import itertools
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STEPS = itertools.count(1)


def materialise(df: DataFrame) -> DataFrame:
    """`df` written once to the session's ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves a session on one machine; on a cluster, whose
    executors could not see it, this is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager=True)


def step(df: DataFrame, name: str) -> DataFrame:
    """`df` with its rows counted as the metric `name`-number, which a stream reports with its progress.

    Projections are not merged across the count and generated code ends at it, so that long expressions are planned
    and compiled by steps without a write; it takes streams too.
    """
    return df.observe(f"{name}-{next(_STEPS)}", F.count(F.lit(1)).alias("rows"))


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan dealt over all cores, where its files are too small to occupy them; a larger one as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def compiled_by_parts(spark: SparkSession) -> None:
    """Lowers the session's bound on a generated method to 8000 bytes, beyond which HotSpot never compiles one.

    At Spark's own bound, steps with dozens of conditions become one such method, which is interpreted at every row; below it
    Spark takes the same expressions apart into small ones. A bound that the session has set itself stays.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(name) == "65535":
        spark.conf.set(name, "8000")
