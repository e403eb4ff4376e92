"""Event tables kept in buckets of sample_id: written once with one shuffle, after which families and their joins over them need none."""
from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path
from .adapter import Tables

ORDER = ("sample_id", "seconds_before_predict", "seq")


def write_bucketed(df: DataFrame, name: str, buckets: int, path: str | None = None) -> DataFrame:
    """Saves df as table `name` (replaced if there), `buckets` files of sample_id sorted by sample and time, and reads it.  Rows are dealt by the bucket's own hash first, so each bucket is
    one file however many partitions df has.  All rows of a sample lie in one bucket, as every family needs them in one task anyway."""
    if buckets < 1:
        raise ValueError("at least one bucket")
    spark = df.sparkSession
    order = [c for c in ORDER if c in df.columns]
    dealt = df.repartition(buckets, "sample_id")  # the same hash as the buckets'
    dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, "sample_id").sortBy(*order).option("path", path or scratch_path(spark)).saveAsTable(name)
    return spark.table(name)


def bucket_tables(tables: Tables, prefix: str, buckets: int) -> Tables:
    """All event tables of a split in equal buckets, so that they join each other in place."""
    return Tables(*(write_bucketed(getattr(tables, f.name), f"{prefix}_{f.name}", buckets) for f in fields(Tables)))


def open_bucketed(spark: SparkSession, prefix: str) -> Tables:
    """Tables that `bucket_tables` has written."""
    return Tables(*(spark.table(f"{prefix}_{f.name}") for f in fields(Tables)))


def bucket_sizes(df: DataFrame) -> DataFrame:
    """(bucket, samples, rows) of the files of a bucketed table: what to look at before choosing the number of buckets."""
    bucket = F.regexp_extract(F.col("_metadata.file_name"), r"_(\d+)\.c", 1).cast("int")
    per = df.groupBy(bucket.alias("bucket"), "sample_id").agg(F.count("*").alias("n"))
    return per.groupBy("bucket").agg(F.count("*").alias("samples"), F.sum("n").alias("rows"))
