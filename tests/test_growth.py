"""Work that must grow no faster than the input: plans and equal results of the forms that larger tables need."""
import re

import pytest
from conftest import SF
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Window as W, functions as F

from tickframe.operators import models as M, sequences as Q, stack as S
from tickframe.queries import QUERIES
from tickframe.queries.models import _stored_rows
from tickframe.session import stored
from tickframe.sources.adapter import frame, ordered_orders, read_tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"\bExchange (?:hash|range|Single)", plan(df)))


@pytest.mark.parametrize("kind", ["reverse", "shuffle", "block", "desync"])
def test_surrogate_paths_equal_surrogates_of_steps(spark, kind):
    """the packed form deals the same steps, nulls included."""
    market = frame(spark, SF, "mkt").withColumn("bid_price_1", F.when(F.col("seq") % 13 != 0, F.col("bid_price_1")))
    seq = Q.sequence(market).select("sample_id", "step", "mid", "imb1")
    full = seq.join(seq.groupBy("sample_id").count().where("count = 200"), "sample_id", "left_semi")
    want = {(r.sample_id, r.step): (r.mid, r.imb1) for r in Q.surrogate(full, kind, ["mid", "imb1"], 200, 20).collect()}
    packed = Q.full_sequences(market, ["mid", "imb1"]).select("sample_id", F.posexplode(Q.surrogate_path(kind, ["mid", "imb1"], 200, 20)).alias("step", "x"))
    got = {(r.sample_id, r.step): (r.x.mid, r.x.imb1) for r in packed.collect()}
    assert len(want) > 200 and any(v[0] is None for v in want.values())
    assert got == want


def test_surrogates_shuffle_no_steps(spark):
    """quotes are shuffled once; the 800 steps a sample are neither shuffled nor sorted."""
    df = QUERIES["surrogate_sequences"](spark, SF)
    assert exchanges(df) == 1 and "SortMergeJoin" not in plan(df)


def test_market_states_build_only_their_columns(spark):
    """no quantiles, no whole seconds, no order of trades and orders, no wide distinct."""
    df = QUERIES["market_states"](spark, SF)
    text = plan(df)
    assert "q90" not in text and "Generate" not in text and "distinct" not in text.lower()
    assert "Window" not in "".join(x for x in text.splitlines() if "l_suppkey" in x or "order_action" in x)


def test_pruned_stack_equals_full_stack(spark):
    """any kept columns are those of the full table; the mean gap without order is the one in order."""
    t = read_tables(spark, SF)
    full = S.stack(t.market, t.order, t.trade)
    keep = ["x_sec_price_mid_diff", "x_large_trade_imbalance", "o_avg_time_gap", "t_avg_time_gap", "o_order_count", "m_rv"]
    want = {r.sample_id: r for r in full.select("sample_id", *keep).collect()}
    got = S.stack(t.market, t.order, t.trade, keep)
    assert got.columns == ["sample_id", *keep]
    rows = got.collect()
    assert len(rows) == len(want) > 0
    numbers = lambda r: [float("nan") if r[c] is None else float(r[c]) for c in keep]
    for r in rows:
        assert numbers(r) == pytest.approx(numbers(want[r.sample_id]), rel=1e-9, abs=1e-12, nan_ok=True)


def test_orders_are_numbered_by_no_sort_of_their_own(spark):
    """the struct sorts as the numbers do, and the wide stack has neither that sort nor a distinct over all columns."""
    by = W.partitionBy("sample_id").orderBy("seq")
    numbered = frame(spark, SF, "ord").select("sample_id", F.row_number().over(by).alias("k"), "seconds_before_predict", "price", "volume", "side", "order_action")
    packed = ordered_orders(spark, SF).select("sample_id", F.row_number().over(by).alias("k"), "seconds_before_predict", "price", "volume", "side", "order_action")
    assert numbered.exceptAll(packed).count() == packed.exceptAll(numbered).count() == 0
    assert exchanges(QUERIES["stack_orders"](spark, SF)) == 1


@pytest.mark.parametrize("learner", ["linear", "boosted"])
def test_splits_with_the_same_past_are_fitted_once(spark, monkeypatch, learner):
    """T3 and T4 share their fits, a stopped learner's search is its fit of the inner months, and the outer rows are those of single calls."""
    rows = stored(frame(spark, SF, "prd").withColumn("noise", ((F.col("sample_id") * 7919) % 101) / 100.0))
    factory = M.linear() if learner == "linear" else M.Stopped(3, 2)
    run = lambda k, **more: M.residual_protocol(rows, k, "pred_a", ["pred_b", "noise"], "target", factory, (0.0, 0.1, 0.2), **more)
    result = lambda d: {r.sample_id: (r.split, r.month, r.alpha, round(r.blend, 9)) for r in d.collect()}
    single = {k: result(run(k)) for k in ("T3", "T4")}
    made, cls = [], LinearRegression if learner == "linear" else GBTRegressor
    fit = cls.fit
    monkeypatch.setattr(cls, "fit", lambda self, *a, **k: made.append(1) or fit(self, *a, **k))
    fits = {}
    assert {k: result(run(k, fits=fits)) for k in ("T3", "T4")} == single
    assert len(made) == 2


def test_learner_queries_read_a_stored_table(spark):
    """linear fits read the narrow table, not the orders anew."""
    assert "orders.parquet" not in plan(_stored_rows(spark, SF))
