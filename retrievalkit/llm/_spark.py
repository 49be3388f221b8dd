"""Small Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrievalkit.session import ensure_checkpoint_dir, shared_files as files_of, ship_package  # noqa: F401

#: Sides of up to this many (long) keys are broadcast; larger ones are shuffled.
BROADCAST_KEYS = 1_000_000


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """Shared checkpoint folder and package on the executors. Unless the session
    sets it, texts go to Python in batches of 4 MB rather than 64: an executor
    holds several copies of a batch in each of its tasks."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(4 << 20))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str):
    """The text, empty for null."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def keyed(ids: DataFrame, n: int) -> DataFrame:
    """``ids`` as the smaller side of a join: broadcast if its checked size
    ``n`` is within the bound, else left to a shuffle."""
    return F.broadcast(ids) if n <= BROADCAST_KEYS else ids
