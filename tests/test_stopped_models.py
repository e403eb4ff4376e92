"""Stopped learners in the month protocol: numbers of trees from inner months only, refits, resumed runs."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tickframe.operators import models as M
from tickframe.operators.metrics import cosine
from tickframe.plans import protocol as H

ALPHAS = [0.0, 0.1, 0.2]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(710, 3))
    y = np.where(x[:, 0] > 0, 1.0, -1.0) * np.abs(x[:, 1]) + 0.2 * rng.normal(size=710)
    data = [(i, i % 71, float(y[i]), float(0.3 * y[i] + rng.normal()), *map(float, x[i])) for i in range(710)]
    return spark.createDataFrame(data, "sample_id long, month int, target double, base double, x0 double, x1 double, x2 double").repartition(3).cache()


FEATURES = ["x0", "x1", "x2"]


def test_outer_targets_change_no_inner_state(rows):
    learner = M.Stopped(6, 2, 0.3)
    first = M.residual_protocol(rows, "T3", "base", FEATURES, "target", learner, ALPHAS)
    lo, hi = H.NESTED_MONTHS["T3"][3]
    other = rows.withColumn("target", F.when(F.col("month").between(lo, hi), -5 * F.col("target") + 1).otherwise(F.col("target")))
    second = M.residual_protocol(other, "T3", "base", FEATURES, "target", learner, ALPHAS)
    state = lambda d: {r.sample_id: (r.trees, r.alpha, r.ka, r.kb, round(r.residual_pred, 12)) for r in d.collect()}
    assert state(first) == state(second) and first.count() == 100


def test_trees_follow_the_held_rows(rows):
    train, held = rows.where("month <= 40"), rows.where("month between 41 and 50")
    k = M.Stopped(12, 2, 0.5).choose(train, held, FEATURES, "target")
    assert 1 < k <= 12
    noise = held.withColumn("target", -F.col("target"))  # no tree helps against it
    assert M.Stopped(12, 2, 0.5).choose(train, noise, FEATURES, "target") == 1
    assert M.Stopped(9).fixed(4)("x", "target").getMaxIter() == 4
    with pytest.raises(ValueError):
        M.Stopped(by="luck")


def test_staged_cosines_are_those_of_shorter_fits(rows):
    train, held = rows.where("month <= 40"), M.with_vector(rows.where("month between 41 and 50"), FEATURES)
    learner = M.Stopped(4, 2, 0.5, "cosine")
    curve = M.staged_cosines(learner("x", "target").fit(M.with_vector(train, FEATURES)), held, "target")
    for i in range(4):
        short = learner("x", "target", i + 1).fit(M.with_vector(train, FEATURES)).transform(held)
        assert curve[i] == pytest.approx(short.agg(cosine("prediction", "target")).head()[0], abs=1e-9)
    best = learner.choose(train, rows.where("month between 41 and 50"), FEATURES, "target")
    assert best == int(np.argmax(np.round(curve, 9))) + 1


def test_ensemble_refits_with_the_number_found(rows):
    members = {"trees": (0.5, M.Stopped(4, 2, 0.5, "cosine")), "ridge": (0.5, M.linear())}
    out, found = M.ensemble_protocol(rows, "T4", FEATURES, "target", members)
    assert set(found) == {"trees"} and 1 <= found["trees"] <= 4
    refit = M.fitted(rows.where("month <= 50"), rows.where("month between 61 and 70"), FEATURES, "target", M.Stopped(4, 2, 0.5).fixed(found["trees"]), "p")
    both = out.join(refit.select("sample_id", "p"), "sample_id").agg(F.max(F.abs(F.col("trees") - F.col("p"))), F.max(F.abs(F.col("blend") - (F.col("trees") + F.col("ridge")) / 2)), F.count("*")).head()
    assert both[0] < 1e-9 and both[1] < 1e-12 and both[2] == 100


def test_runs_go_on_where_they_ended(rows, tmp_path, monkeypatch):
    store = str(tmp_path / "runs")
    base = rows.select("sample_id", "month", "target", "base")
    frames = {"a": rows.select("sample_id", "x0"), "b": rows.select("sample_id", "x1", "x2")}
    run = lambda f: M.run_candidates(base, f, "base", "target", M.linear(), ALPHAS, ("T3", "T4"), store)
    one = run({"a": frames["a"]})
    fits = []
    real = M.residual_protocol
    monkeypatch.setattr(M, "residual_protocol", lambda *a: fits.append(a[1]) or real(*a))
    both = run(frames)
    assert fits == ["T3", "T4"] and both.count() == 4  # only those of b
    assert {tuple(r) for r in one.collect()} <= {tuple(r) for r in both.collect()}
    run({"a": frames["a"].withColumn("x0", F.col("x0") + 1)})  # other values: run anew
    assert fits == ["T3", "T4"] * 2


def test_count_curve(rows):
    ranked = M.importances(rows.where("month <= 40"), FEATURES, "target", 5)
    assert {f for f, _ in ranked} == set(FEATURES) and [x for _, x in ranked] == sorted((x for _, x in ranked), reverse=True)
    seen = []
    run = lambda f: seen.append(f) or M.residual_protocol(rows, "T4", "base", f, "target", M.linear(), ALPHAS)
    out = {r.features: r for r in M.count_curve(run, [*ranked[:2], (ranked[2][0], 0.0)], (1, 3, 9), "base", "target").collect()}
    names = [f for f, _ in ranked]
    assert seen == [names[:1], names, names[:2]] and {k: r.used for k, r in out.items()} == {1: 1, 3: 3, 0: 2}
