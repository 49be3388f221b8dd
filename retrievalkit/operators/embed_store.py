"""The embedding store (E4) as batches of hash buckets.

Each write is a folder ``batch=<name>`` of its own, bucketed and sorted by
``text_md5``, so a lookup shuffles the texts that are looked up and no stored
vector. A batch counts once Spark has marked it with ``_SUCCESS`` (the default
of Hadoop's committer), so writers never share a folder: any number may append
at once, and a writer that dies leaves a batch that no reader sees. Two writers
may store the same key; readers take one of its rows (of equal keys the vectors
are equal).

``compact`` writes the keys of all batches once, as a new batch, and then names
the batches it replaces in ``_replaced/<name>``, which counts once marked too. In
between, both are read, with the same result. The replaced folders stay for
readers that began before; ``unused_batches`` lists them.

The number of buckets is set by the first batch and is part of every batch's
name. If first writers at once set different ones, lookups read plain files,
with a shuffle, until ``compact`` has run. The session's catalog is used for table names of the moment only.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retrievalkit.session import materialised

BUCKETS = 64
STORE_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("instruction", T.StringType()),
    T.StructField("normalize", T.BooleanType()),
    T.StructField("text_md5", T.StringType()),
    T.StructField("vec", T.ArrayType(T.FloatType())),
])
_KEY = ["model", "role", "instruction", "normalize", "text_md5"]


def _marked(spark: SparkSession, pattern: str) -> list[str]:
    """Folders of the pattern that Spark has finished, by name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{pattern}/_SUCCESS")
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path)
    return sorted(f.getPath().getParent().toString() for f in (found or []))


def _names(spark: SparkSession, store: str) -> list[str]:
    return [p.rsplit("batch=", 1)[1] for p in _marked(spark, f"{store}/batch=*")]


def unused_batches(spark: SparkSession, store: str) -> list[str]:
    """Batches that a compaction has replaced."""
    logs = _marked(spark, f"{store}/_replaced/*")
    return sorted({r["value"] for r in spark.read.text(logs).distinct().collect()}) if logs else []


def batches(spark: SparkSession, store: str) -> list[str]:
    """The batches a reader of this moment reads. The replaced ones are looked up
    after the batches, so a batch is never left out before its successor is in."""
    while True:
        names, unused = _names(spark, store), set(unused_batches(spark, store))
        if _names(spark, store) == names:
            return [n for n in names if n not in unused]


def _buckets(names: list[str], buckets: int) -> int:
    return int(names[0].split("-")[0]) if names else buckets


@contextmanager
def stored(spark: SparkSession, store: str):
    """The rows of the store, one a key, as a bucketed table that lasts as long as
    the context; None if there are no batches."""
    names = batches(spark, store)
    if not names:
        yield None
        return
    def one_a_key(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*_KEY).agg(F.first("vec").alias("vec"))

    if len({_buckets([n], 0) for n in names}) > 1:
        yield one_a_key(spark.read.schema(STORE_SCHEMA).parquet(*[f"{store}/batch={n}" for n in names]))
        return
    table = f"rk_store_{uuid.uuid4().hex}"
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in STORE_SCHEMA.fields)
    place = store.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {table} ({fields}, batch STRING) USING parquet PARTITIONED BY (batch) "
              f"CLUSTERED BY (text_md5) SORTED BY (text_md5) INTO {_buckets(names, 0)} BUCKETS LOCATION '{place}'")
    try:
        for n in names:
            spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS PARTITION (batch = '{n}')")
        yield one_a_key(spark.table(table).where(F.col("batch").isin(names)))
    finally:
        spark.sql(f"DROP TABLE {table}")             # external: the files stay


def append(rows: DataFrame, store: str, buckets: int = BUCKETS) -> str:
    """``rows`` (``STORE_SCHEMA``) as a new batch; its name."""
    spark = rows.sparkSession
    n = _buckets(_names(spark, store), buckets)
    name, table = f"{n:05d}-{uuid.uuid4().hex}", f"rk_batch_{uuid.uuid4().hex}"
    (rows.select(*[f.name for f in STORE_SCHEMA.fields]).repartition(n, "text_md5")
     .write.format("parquet").bucketBy(n, "text_md5").sortBy("text_md5")
     .option("path", f"{store}/batch={name}").saveAsTable(table))
    spark.sql(f"DROP TABLE {table}")
    return name


def lookup(keys: DataFrame, store: str, model: str, role: str, instruction: str, normalize: bool) -> DataFrame:
    """``keys`` (with ``text_md5``) and their stored ``vec``, null where there is
    none; every row of ``keys`` once. Written to the shared folder."""
    with stored(keys.sparkSession, store) as known:
        if known is None:
            return materialised(keys.withColumn("vec", F.lit(None).cast("array<float>")), "embed-lookup")
        mine = known.where((F.col("model") == model) & (F.col("role") == role)
                           & (F.col("instruction") == instruction) & (F.col("normalize") == F.lit(normalize)))
        return materialised(keys.join(mine.select("text_md5", "vec"), "text_md5", "left"), "embed-lookup")


def compact(spark: SparkSession, store: str) -> str | None:
    """All batches as one, every key once; the new batch's name. Nothing to do
    for fewer than two."""
    old = batches(spark, store)
    if len(old) < 2:
        return None
    with stored(spark, store) as rows:
        name = append(rows, store)
    spark.createDataFrame([(n,) for n in old], "value string").coalesce(1).write.text(f"{store}/_replaced/{name}")
    return name


__all__ = ["STORE_SCHEMA", "append", "batches", "compact", "lookup", "stored", "unused_batches"]
