"""Session defaults of the library."""
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **conf) -> SparkSession:
    """A session with UTC time, ANSI arithmetic and adaptive execution; anything else is the caller's."""
    b = SparkSession.builder.appName("tickframe")
    if master:
        b = b.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true"}
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch_path(spark: SparkSession) -> str:
    """A new path in the folder that all executors share (`spark.checkpoint.dir`); a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, and a lost executor costs one read."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
