"""A training corpus from raw documents: quality rules, near-duplicate removal, personal data, mixing, packing."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickframe.llm.common import written
from tickframe.llm.stages import STAGES

#: SQL cannot express the learned rules, the span classifier or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
