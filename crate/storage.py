"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table of a few numbers that may be sent to every executor; larger ones are joined by a shuffle.
BROADCAST_ROWS = 250_000
#: Bytes of rows handed to Python at once while a table is saved.
BATCH_BYTES = "8m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only on a local master where that is unset (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    own = sc._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is unset: executors need a folder that they all share")
    made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(f"file://{made}")
    return sc._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame, tag: str, rows: int = 0) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage, survives lost executors.

    While it is written, Python workers get batches of BATCH_BYTES at most; the session's own setting is put back.
    rows: of a file at most, for tables of large rows, since Spark reads thousands of rows of a file at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, BATCH_BYTES)
    try:
        (df.write.option("maxRecordsPerFile", rows) if rows else df.write).parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder for files of other formats; release() deletes what stands there."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A saved table for one side of a join: broadcast if it has few rows, else merged by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df.hint("merge")


def discard(*tables: DataFrame) -> None:
    """Delete tables that saved() has written and nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
            _delete(df.sparkSession, path)


def settle(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that have ended: it does so once the driver has let go of them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release() -> None:
    """Delete the tables that saved() has written; call it once the results that read them are stored."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; its folder goes with it
            return


atexit.register(release)
