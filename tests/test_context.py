"""Context-shift diagnostic against numpy, and that no score month's target reaches a fit."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickframe.operators import context as C, models as M
from tickframe.plans.protocol import CONTEXT

FEATURES = ["x0", "x1"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1420, 2))
    base = rng.normal(size=1420)
    y = 0.5 * base + np.where(x[:, 0] > 0, 0.4, -0.4) * (x[:, 1] > 0) + 0.1 * x[:, 1] + 0.1
    data = [(i, i % 71, float(y[i]), float(base[i]), float(x[i, 0]), float(x[i, 1]) if i % 50 else None) for i in range(1420)]
    return spark.createDataFrame(data, "sample_id long, month int, target double, base double, x0 double, x1 double").repartition(3).cache()


@pytest.fixture(scope="module")
def scored(rows):
    return C.forward_models(rows, CONTEXT, FEATURES, "base", "target", M.boosted(10, 2)).cache()


def test_ridge_and_beta(rows, scored):
    all_, got = rows.toPandas().fillna(0.0), scored.toPandas()
    assert len(got) == 4 * 200 and sorted(got.split.unique()) == sorted({r[0] for r in CONTEXT})
    for name in got.split.unique():
        (lo, hi), = [(a, b) for s, role, a, b in CONTEXT if s == name and role == "train"]
        t, g = all_[all_.month.between(lo, hi)], got[got.split == name]
        beta = (t.base * t.target).sum() / (t.base**2).sum()
        assert g.beta.to_numpy() == pytest.approx(beta)
        r, mu, sd = t.target - beta * t.base, t[FEATURES].mean(), t[FEATURES].std(ddof=0)
        z = ((t[FEATURES] - mu) / sd).to_numpy()
        w = np.linalg.solve(z.T @ z + 10 * np.eye(2), z.T @ (r - r.mean()))
        assert g.ridge.to_numpy() == pytest.approx(((g[FEATURES] - mu) / sd).to_numpy() @ w + r.mean(), abs=1e-6)


def test_scores_gate_and_bias(rows, scored):
    got, g = scored.toPandas(), C.forward_scores(scored).toPandas().set_index(["split", "model"])
    for (split, model), s in g.iterrows():
        d = got if split == "all" else got[got.split == split]
        p, r = d[model], d.residual
        want = [len(d), (p * r).sum() / np.sqrt((p * p).sum() * (r * r).sum()), 1 - ((p - r) ** 2).mean() / (r * r).mean(), np.sqrt((p * p).mean()), p.mean(), p.std(ddof=0), np.corrcoef(p, d.ridge)[0, 1]]
        assert list(s) == pytest.approx(want)
    assert g.loc[("all", "trees"), "cosine"] > g.loc[("all", "ridge"), "cosine"]  # the interaction is none of a line's
    gate = C.forward_gate(scored, rounds=100).head()
    assert gate.passed and gate.positive_splits == 4 and gate.low <= gate.cosine <= gate.high
    bad = C.forward_gate(scored.withColumn("trees", F.when(F.col("sample_id") == 40, float("nan")).otherwise(F.col("trees"))), rounds=20).head()
    assert not bad.finite and not bad.passed
    bias = C.context_bias(rows, scored, CONTEXT, FEATURES).toPandas()
    assert bias.n.sum() == 2 * len(got) and set(bias.quartile) == {0, 1, 2, 3}
    (lo, hi), = [(a, b) for s, role, a, b in CONTEXT if s == "C31_40" and role == "train"]
    all_ = rows.toPandas().fillna(0.0)
    edges = np.quantile(all_[all_.month.between(lo, hi)].x0, [0.25, 0.5, 0.75])
    d = got[got.split == "C31_40"]
    want = (d.residual - d.trees).groupby(np.digitize(d.x0, edges)).mean()
    have = bias[(bias.split == "C31_40") & (bias.feature == "x0")].sort_values("quartile").bias
    assert have.to_numpy() == pytest.approx(want.to_numpy())


def test_score_months_reach_no_fit(rows, scored):
    late = rows.withColumn("target", F.when(F.col("month") >= 61, F.col("target") * -7 + 3).otherwise(F.col("target")))
    again = C.forward_models(late, [r for r in CONTEXT if r[0] == "C61_70"], FEATURES, "base", "target", M.boosted(10, 2))
    key = lambda d: d.where("split = 'C61_70'").select("sample_id", "beta", "ridge", "trees").toPandas().sort_values("sample_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(key(again), key(scored))


def test_constant_context(rows):
    flat = rows.withColumn("x0", F.lit(1.0)).withColumn("x1", F.lit(None).cast("double"))
    got = C.forward_scores(C.forward_models(flat, CONTEXT[:2], FEATURES, "base", "target", M.boosted(2, 2)))
    assert {r.agreement for r in got.collect()} == {0.0}
