"""Session helpers.

On a cluster the session is configured by the deployment; these helpers only
fill in settings that are unset (tests, bench, local runs).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
}


def get_spark(master: str | None = None, app: str = "retrievalkit", **conf) -> SparkSession:
    """Return the active session or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        ship_package(active)
        return active
    b = SparkSession.builder.appName(app)
    b = b.master(master or os.environ.get("SPARK_MASTER", "local[8]"))
    for k, v in {**_LOCAL_DEFAULTS, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the cluster names, if any."""
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    return spark.conf.get("spark.checkpoint.dir", None)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use ``spark.checkpoint.dir`` when set; only a local master gets a
    scratch folder of its own (tests, bench)."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="rk-ckpt-", dir=os.environ.get("RK_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def materialised(df, name: str):
    """``df`` written once to the shared folder and read back, so whatever is
    built on it runs the work behind it a single time."""
    import uuid

    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any Hadoop file system exists; errors are raised."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(jpath)


def shared_files(uri: str):
    """``(file system, path)`` of a file or folder that tasks read or write
    themselves (pyarrow). Hadoop's ``s3a`` is the library's ``s3``; a scheme that
    ``pyarrow.fs`` does not know raises."""
    from pyarrow import fs

    scheme, _, rest = uri.partition("://")
    if not rest:
        uri = f"file://{uri.removeprefix('file:')}"
    return fs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else uri)


def ship_package(spark: SparkSession) -> None:
    """Make ``retrievalkit`` importable in Python workers (``--py-files``
    equivalent), once per SparkContext."""
    sc = spark.sparkContext
    if getattr(sc, "_rk_shipped", False):
        return
    import shutil

    pkg = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="rk-pyfiles-")
    archive = shutil.make_archive(os.path.join(out, "retrievalkit"), "zip",
                                  root_dir=os.path.dirname(pkg), base_dir="retrievalkit")
    sc.addPyFile(archive)
    sc._rk_shipped = True
