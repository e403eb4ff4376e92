"""Ranks and quantiles of whole tables: against numpy, with ties across range borders, and without a task that holds all rows."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickframe.operators import metrics, order


def ranks(x):
    x = np.asarray(x, float)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(4)
    rows = [(i, i % 3 if i % 7 else None, rng.choice([0.0, -0.0, 1.5, rng.gauss(0, 1), rng.gauss(0, 1e-9), 1e300 * rng.random(), -1e12, None]), rng.gauss(0, 1)) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, g int, x double, y double").repartition(5), rows


def test_value_ranks(values):
    df, rows = values
    for by in ([], ["g"]):
        got = {(r.g if by else None, r.x + 0.0): (r.n, r["rank"]) for r in order.value_ranks(df, "x", by).collect()}
        for g in {r[1] for r in rows} if by else [None]:
            x = [r[2] + 0.0 for r in rows if r[2] is not None and (not by or r[1] == g)]
            for v, k in zip(x, ranks(x), strict=True):
                assert got[g, v] == (x.count(v), k)


def test_auc_and_spearman(values):
    df, rows = values
    kept = [r for r in rows if r[2] is not None]
    x, y = np.array([r[2] for r in kept]), np.array([r[3] for r in kept])
    k = ranks(x)
    n1 = (y > 0).sum()
    want = (k[y > 0].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))
    assert metrics.auc(df, "x", F.col("y") > 0, []).head().auc == pytest.approx(want, abs=1e-12)
    assert metrics.auc(df.where("y > 0"), "x", F.col("y") > 0, []).head().auc is None
    assert metrics.spearman(df, "x", "y", []).head().spearman == pytest.approx(np.corrcoef(k, ranks(y))[0, 1], abs=1e-12)
    by = {r.g: r.spearman for r in metrics.spearman(df, "x", "y", ["g"]).collect()}
    for g in (0, 1, 2):
        a, b = zip(*[(r[2], r[3]) for r in kept if r[1] == g], strict=True)
        assert by[g] == pytest.approx(np.corrcoef(ranks(a), ranks(b))[0, 1], abs=1e-12)


def test_no_task_ranks_all_rows(values):
    """The plan's only exchange to one task is over one row a range."""
    df, _ = values
    plan = order.value_ranks(df, "x", [])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert any("__range" in w and "__at" in w for w in windows) and all("__own" in w or "[__range" in w for w in windows)


@pytest.mark.parametrize("few", [0, 100, 50_000])
def test_quantiles_like_percentile(values, monkeypatch, few):
    """All the same, whether the passes go on to single values or stop early."""
    df, rows = values
    monkeypatch.setattr(order, "FEW", few)
    monkeypatch.setattr(order, "CELLS", 16 if few == 100 else 4096)
    shares = [0.0, 0.013, 0.25, 0.5, 0.77, 0.999, 1.0]
    got = order.quantiles(df, {"x": ("x", shares), "y": (F.abs("y"), 0.9), "none": (F.lit(None).cast("double"), [0.5])}).head()
    want = df.agg(F.percentile("x", F.array(*map(F.lit, shares))).alias("x"), F.percentile(F.abs("y"), 0.9).alias("y")).head()
    assert list(got.x) == pytest.approx(list(want.x), rel=1e-15) and got.y == pytest.approx(want.y, rel=1e-15) and got.none is None
    by = {r.g: r.x for r in order.quantiles(df, {"x": ("x", [0.1, 0.5])}, ["g"]).collect()}
    want = {r.g: r.x for r in df.groupBy("g").agg(F.percentile("x", F.array(F.lit(0.1), F.lit(0.5))).alias("x")).collect()}
    assert {k: list(v) for k, v in by.items()} == {k: pytest.approx(list(v), rel=1e-15) for k, v in want.items()}


def test_quantiles_of_odd_values(spark):
    df = spark.createDataFrame([(math.inf,), (-math.inf,), (math.nan,), (None,), (5e-324,), (-5e-324,), (0.0,)], "x double")
    got = order.quantiles(df, {"x": ("x", [0.0, 0.25, 0.5, 0.75, 1.0])}).head().x
    assert got == [-math.inf, -5e-324, 0.0, 5e-324, math.inf]
    assert order.quantiles(df.where("x > 9 and x < 8"), {"x": ("x", [0.5]), "z": ("x", 0.5)}).head() == (None, None)
