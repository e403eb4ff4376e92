"""Files that an evaluation reads and writes: submissions, prediction artifacts, run summaries, schema reports, samples of rows; and a reader of Arrow IPC files."""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.exprs import finite
from ..operators import checks as B

SUBMISSION = "sample_id long, prediction double"


def write_table(df: DataFrame, path: str, partition_by=(), mode: str = "errorifexists") -> None:
    """Parquet with zstd (page statistics are Spark's default)."""
    df.write.option("compression", "zstd").mode(mode).partitionBy(*partition_by).parquet(path)


def write_submission(df: DataFrame, path: str, prediction: str = "prediction", key: str = "sample_id") -> None:
    """CSV files of (sample_id, prediction), sorted by id over all files; raises on repeated ids or values that are not finite."""
    rows = df.select(F.col(key).cast("long").alias("sample_id"), F.col(prediction).cast("double").alias("prediction"))
    B.enforce(B.unique_key(rows, "sample_id"), B.finite_values(rows, "prediction"))
    rows.orderBy("sample_id").write.csv(path, header=True)


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=SUBMISSION)


def save_predictions(df: DataFrame, path: str, split: str) -> None:
    """The prediction artifact of a split: sample_id, month, target, pred under split=<name>, once only."""
    rows = df.select("sample_id", "month", "target", "pred").withColumn("split", F.lit(split))
    B.enforce(B.unique_key(rows, "sample_id"), B.finite_values(rows, "target", "pred"))
    write_table(rows, path, ["split"], "append")


def load_predictions(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(F.col("split") == split) if split else df


def run_summary(df: DataFrame, **scores: Column) -> DataFrame:
    """One row: rows, ids, month range, an order-insensitive content hash, and the given scores."""
    return df.agg(F.count("*").alias("rows"), F.countDistinct("sample_id").alias("ids"), F.min("month").alias("first_month"), F.max("month").alias("last_month"),
                  F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("content"), *[c.alias(k) for k, c in scores.items()])


def summary_json(summary: DataFrame) -> str:
    """The one-row summary as JSON text, keys in order."""
    return json.dumps(summary.head().asDict(), sort_keys=True)


def schema_report(df: DataFrame) -> DataFrame:
    """Per column: type, nulls, share of nulls, distinct values, least and greatest value as text, mean and deviation of numbers."""
    number = {c for c, t in df.dtypes if t in ("int", "bigint", "double", "float", "smallint", "tinyint")}

    def one(c, t):
        v = F.col(c)
        mean, std = (F.avg(v), F.stddev_samp(v)) if c in number else (F.lit(None).cast("double"), F.lit(None).cast("double"))
        low, high = F.min(v).cast("string"), F.max(v).cast("string")
        return F.struct(F.lit(c).alias("name"), F.lit(t).alias("type"), F.count_if(v.isNull()).alias("nulls"), (F.count_if(v.isNull()) / F.count("*")).alias("null_share"),
                        F.countDistinct(v).alias("distinct"), low.alias("low"), high.alias("high"), mean.cast("double").alias("mean"), std.cast("double").alias("std")).alias(f"s_{c}")

    wide = df.agg(*[one(c, t) for c, t in df.dtypes])
    return wide.select(F.explode(F.array(*[F.col(f"s_{c}") for c in df.columns])).alias("r")).select("r.*")


def value_preview(df: DataFrame, codes: list[str], numbers: list[str], key: str = "sample_id") -> DataFrame:
    """Value domains of a stream: the distinct codes, range and quantiles of numbers, and rows per sample."""
    q = F.array(*[F.lit(x) for x in (0.01, 0.5, 0.99)])
    lists = [F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ",").alias(f"{c}_codes") for c in codes]
    wide = df.agg(*lists, *[x for c in numbers for x in (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.percentile(c, q).alias(f"{c}_q"))])
    per = df.groupBy(key).agg(F.count("*").alias("n")).agg(F.min("n").alias("rows_min"), F.percentile("n", 0.5).alias("rows_median"), F.max("n").alias("rows_max"))
    flat = [F.col(f"{c}_q")[i].alias(f"{c}_p{p}") for c in numbers for i, p in enumerate(("01", "50", "99"))]
    return wide.join(per).select(*[f"{c}_codes" for c in codes], *[y for c in numbers for y in (f"{c}_min", f"{c}_max")], *flat, "rows_min", "rows_median", "rows_max")


def first_per_month(df: DataFrame, n: int, key: str = "sample_id") -> DataFrame:
    """The first n rows of each month by id, for a smoke run."""
    r = F.row_number().over(W.partitionBy("month").orderBy(key))
    return df.withColumn("__r", r).where(F.col("__r") <= n).drop("__r")


def load_pair(labels: DataFrame, features: DataFrame, key: str = "sample_id") -> DataFrame:
    """Labels with their features; raises unless both have the same unique ids and finite targets."""
    missing = B.contained(labels, features.select(key), key), B.contained(features, labels.select(key), key)
    B.enforce(B.unique_key(labels, key), B.unique_key(features, key), B.finite_values(labels, "target"), *missing)
    return labels.join(features, key)


def representatives(events: DataFrame, value: str, key: str = "sample_id") -> DataFrame:
    """Ids that show a stream's shapes (ties: the lesser id): rows nearest the median number, widest range of a value, a single row (or the fewest)."""
    per = events.groupBy(key).agg(F.count("*").alias("n"), (F.max(value) - F.min(value)).alias("range"))
    per = per.join(F.broadcast(per.agg(F.percentile("n", 0.5).alias("mid"))))
    pick = lambda order: F.min_by(key, F.struct(order, F.col(key)))
    return per.agg(pick(F.abs(F.col("n") - F.col("mid"))).alias("median_activity"), pick(-F.col("range")).alias("widest"), pick(F.col("n")).alias("fewest"))


def head_tail(events: DataFrame, ids: DataFrame, order: list, k: int, key: str = "sample_id") -> DataFrame:
    """The first and last k events of the given ids."""
    w = W.partitionBy(key).orderBy(*order)
    r = events.join(F.broadcast(ids), key, "left_semi").withColumn("place", F.row_number().over(w)).withColumn("of", F.count("*").over(W.partitionBy(key)))
    return r.where((F.col("place") <= k) | (F.col("place") > F.col("of") - k))


def enforce_finite(df: DataFrame, *cols: str, fill: float = 0.0) -> DataFrame:
    """Nulls, NaNs and infinities of the columns replaced."""
    return df.withColumns({c: F.when(finite(c), F.col(c)).otherwise(fill) for c in cols})


class _Batch(InputPartition):
    def __init__(self, path: str, index: int):
        super().__init__((path, index))


class _ArrowReader(DataSourceReader):
    def __init__(self, schema, options):
        self.names, self.paths = schema.fieldNames(), options["path"].split(",")

    def partitions(self):
        import pyarrow.ipc as ipc

        return [_Batch(p, i) for p in self.paths for i in range(ipc.open_file(p).num_record_batches)]

    def read(self, partition):
        import pyarrow.ipc as ipc

        path, index = partition.value
        yield ipc.open_file(path).get_batch(index).select(self.names)


class ArrowFiles(DataSource):
    """`spark.read.format("arrow_ipc").option("path", ...)`: Arrow IPC (Feather 2) files on storage that all executors mount, one partition a record batch.
    Give a schema to read only some columns."""

    @classmethod
    def name(cls):
        return "arrow_ipc"

    def schema(self):
        import pyarrow.ipc as ipc
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(ipc.open_file(self.options["path"].split(",")[0]).schema)

    def reader(self, schema):
        return _ArrowReader(schema, self.options)


def read_arrow(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    spark.dataSource.register(ArrowFiles)
    r = spark.read.format("arrow_ipc").option("path", path)
    return (r.schema(schema) if schema else r).load()
