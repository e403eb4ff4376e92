"""Shared helpers: input tables, tables written to the shared folder, null-safe columns."""
from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

#: The words of every contract: maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    narrow_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (`spark.checkpoint.dir`).  Where it is unset, a local session (as in tests) gets a temporary one; on a cluster
    executors would write apart, so that is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = getattr(spark, "_tickframe_shared", None)
        if d is None:
            d = spark._tickframe_shared = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return d


#: Rows at a time in an Arrow batch of a task and in Spark's Parquet reader: texts and n-gram sets are wide, so the defaults (10,000 and 4096) hold tens of megabytes at once.
BATCH_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.parquet.columnarReaderBatchSize": 256}


def narrow_batches(spark: SparkSession) -> None:
    """Lower the session's batch sizes to BATCH_ROWS, where they are higher; results do not depend on them."""
    for name, rows in BATCH_ROWS.items():
        if not 0 < int(spark.conf.get(name)) <= rows:
            spark.conf.set(name, str(rows))


_recording: list[list[str]] = []


@contextmanager
def recorded():
    """The paths that `written` makes inside the block, for `discard`."""
    paths: list[str] = []
    _recording.append(paths)
    try:
        yield paths
    finally:
        _recording.remove(paths)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete intermediate tables, once all that reads them is written itself."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for p in paths:
        path = hadoop.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    narrow_batches(spark)
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    for paths in _recording:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_fold(col, mod: int):
    """crc32 of the id as text, modulo `mod`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod
