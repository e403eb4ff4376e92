"""Pruned nearest neighbours against brute force, and what the pivots rule out."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickframe.operators import neighbours as N

SCHEMA = "b long, month int, z array<double>"


def brute(z, months, asked, k, metric="euclidean"):
    x = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12) if metric == "cosine" else z
    out = {}
    for i in asked:
        d = np.sqrt(((x - x[i]) ** 2).sum(1)).round(9)
        out[i] = [j for _, j in sorted((d[j], j) for j in range(len(z)) if months[j] < months[i])[:k]]
    return {i: v for i, v in out.items() if v}


def found(df):
    got = {}
    for r in df.orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append(r.b)
    return got


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_clusters_ties_and_a_hot_cell(spark, metric):
    rng = np.random.default_rng(3)
    z = np.concatenate([rng.normal(100 * m, 1, (200, 4)) for m in range(4)]).round(2)
    z[:150] = z[0]  # a third of a month in one place: one cell over many bins, ties by id
    months = np.arange(len(z)) % 5
    bank = spark.createDataFrame([(i, int(months[i]), z[i].tolist()) for i in range(len(z))], SCHEMA)
    asked = list(range(0, len(z), 7))
    got = found(N.knn(bank.where(F.col("b") % 7 == 0).toDF("q", "month", "z"), bank, 5, block=8, metric=metric))
    assert got == brute(z, months, asked, 5, metric)


def test_clustered_data_meet_few_bins(spark):
    rng = np.random.default_rng(4)
    z = np.concatenate([rng.normal(50 * m, 1, (250, 3)) for m in range(8)])
    rows = [(i, int(i % 2), z[i].tolist()) for i in range(len(z))]
    bank = spark.createDataFrame(rows, SCHEMA)
    at = N.pivots(bank, 64, "euclidean")  # some in every cluster
    lain = N.placed(bank, at, "euclidean")
    cells = N.packed(lain.groupBy("month", "p").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).withColumn("ring", F.lit(0)).toPandas(), 32)
    asked = bank.where("month = 1").select(F.col("b").alias("q"), "month", "z", F.lit(0).alias("block"), F.lit(3.0).alias("tau"))
    visits = N.routes(asked, cells, at, 3, "euclidean").groupBy("q").count().agg(F.avg("count")).head()[0]
    bins = int((cells[cells["month"] == 0]["first"] + cells[cells["month"] == 0]["parts"]).max())
    assert visits < bins / 4


def test_a_far_offset_loses_nothing(spark):
    rng = np.random.default_rng(5)
    z = 1e6 + rng.normal(size=(120, 3)).round(3)
    months = np.arange(120) % 3
    bank = spark.createDataFrame([(i, int(months[i]), z[i].tolist()) for i in range(120)], SCHEMA)
    assert found(N.knn(bank.toDF("q", "month", "z"), bank, 3, block=8)) == brute(z, months, range(120), 3)


def test_empty_null_and_scarce(spark):
    bank = spark.createDataFrame([(0, 0, [1.0, 0.0]), (1, 0, [1.0, 0.0]), (2, None, [1.0, 0.0]), (3, 0, None), (4, 1, [1.0, 0.0])], SCHEMA)
    query = bank.toDF("q", "month", "z")
    assert found(N.knn(query, bank, 3)) == {4: [0, 1]}
    assert N.knn(query.limit(0), bank, 3).count() == 0 and N.knn(query, bank.limit(0), 3).count() == 0
    assert N.knn(query, bank, 3).columns == ["q", "b", "dist", "rank"]


def test_packing_of_cells():
    cells = N.packed(pd.DataFrame({"month": [0, 0, 0, 0, 1], "p": [0, 1, 2, 3, 0], "ring": 0, "n": [3, 4, 25, 2, 1]}), 10)
    assert list(cells["first"]) == [0, 0, 1, 4, 5] and list(cells["parts"]) == [1, 1, 3, 1, 1]
