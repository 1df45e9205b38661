"""Reading the given tables and cutting lineage at tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haberdash.sources.warehouse import shared_folder, shuffles_removed

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

# Rows of a few numbers that may be broadcast: some 50 MB.
MAX_BROADCAST_ROWS = 1_000_000
# Rows and bytes that go to a Python worker at once: whole texts make batches large.
BATCH_ROWS, BATCH_BYTES = "2000", "16777216b"


def small_batches(spark: SparkSession) -> None:
    """Send ``BATCH_ROWS`` rows or ``BATCH_BYTES`` to Python at once, unless the session asks for others than Spark's."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, BATCH_ROWS)
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, BATCH_BYTES)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path, not used before, in the folder that all executors share."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/haberdash-llm/{app}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """``df`` written once as Parquet and read back: a lost executor costs no recomputation.

    The files stay until the shared folder is cleared; plans that read them are lazy.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = new_folder(spark, name)
    with shuffles_removed(spark):
        writer = df.write
        if by:
            writer = writer.partitionBy(*by)
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(rows: DataFrame) -> DataFrame:
    """``rows``, of a few numbers each, marked for broadcast up to ``MAX_BROADCAST_ROWS``.

    ``rows`` is stored, so counting them reads file footers only. Beyond the limit the
    join is Spark's choice: a shuffle.
    """
    return F.broadcast(rows) if rows.count() <= MAX_BROADCAST_ROWS else rows
