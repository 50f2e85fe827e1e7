"""Helpers that the operators of this subpackage share.

Conventions that hold for every operator here:

* An operator takes the columns it names, drops what it does not need as early as it can,
  and replaces input columns whose names clash with the columns it adds.
* A null text counts as the empty text unless the docstring says otherwise.
* Work is cut with ``checkpoint()`` into the folder that ``spark.checkpoint.dir`` names, so a
  lost executor costs only the tasks it ran.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; bounds the memory of a Python worker.
CHUNK_BYTES = 1 << 19


#: Rows of texts in an Arrow batch: Spark's default of 10,000 may be gigabytes of long documents.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` below `sf_dir`, read by Spark from any store.

    Sets the session's Arrow batches to `ARROW_ROWS` rows, so that the memory of Python workers is bounded.
    """
    small_arrow_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_arrow_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to `ARROW_ROWS` rows; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and the executors share: ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves a session on one machine; on a cluster, whose
    executors could not see it, this is an error.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder
    if sc.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    return tempfile.mkdtemp(prefix="spark-checkpoint-")


def materialise(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder (`shared_folder`); its lineage ends there."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Rows of a side of ids and a few numbers that may be broadcast (some tens of bytes each).
BROADCAST_ROWS = 500_000


def bounded(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """`df` marked for broadcast if its counted rows are within the bound; else as it is, to be joined by shuffle."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= most else df


def crc_bucket(doc_id, buckets: int):
    """crc32 of the id written as text, modulo `buckets`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(buckets))


def small_batches(batch: pa.RecordBatch, column: str, limit: int = 8 * CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """`batch` cut into row ranges of at most `limit` bytes of `column`, one row at least."""
    _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
    for a, b in chunks(offsets, limit):
        yield batch.slice(a, b - a)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_string()).cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one row if that is longer."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = b
