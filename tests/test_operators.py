"""Hand cases and metamorphic checks."""
import math

import pytest
from pyspark.sql import functions as F

from tickframe.functions import exprs as X
from tickframe.operators import asof as A, blend as J, checks as B, families as E, metrics as I
from tickframe.plans import protocol as H

MKT = "sample_id long, seq long, seconds_before_predict double, bid_price_1 double, ask_price_1 double, bid_price_2 double, ask_price_2 double, bid_volume_1 double, ask_volume_1 double, bid_volume_2 double, ask_volume_2 double, transaction_avgprice double, transaction_count long, transaction_volume double"


def quotes(spark, rows):
    """(sample, seconds, bid, ask, bid volume, ask volume)"""
    return spark.createDataFrame([(s, i, float(t), float(b), float(a), b - 1.0, a + 1.0, float(bv), float(av), 50.0, 60.0, None, 0, 0.0) for i, (s, t, b, a, bv, av) in enumerate(rows)], MKT)


def test_signed_order_flow(spark):
    df = spark.createDataFrame([(1.0, s, a) for s in (0, 1) for a in (0, 1)], "volume double, side int, order_action int")
    assert [r[0] for r in df.select(X.signed_order_flow()).collect()] == [1, -1, -1, 1]


def test_quote_ofi(spark):
    m = quotes(spark, [(1, 4, 100, 102, 10, 10), (1, 3, 101, 102, 20, 12), (1, 2, 101, 101.5, 25, 15), (1, 1, 100, 101.5, 30, 14)])
    got = [r.v for r in m.select("seq", E.quote_ofi(1, E.path_window()).alias("v")).orderBy("seq").collect()]
    assert got == [0, 18, 20, -24]


def events(spark):
    o = spark.createDataFrame([(1, 0, 1.0, 10.0, 0, 0), (1, 1, 5.0, 5.0, 1, 0), (1, 2, 8.0, 100.0, 0, 0), (2, 3, -1.0, 7.0, 0, 0)], "sample_id long, seq long, seconds_before_predict double, volume double, side int, order_action int")
    t = o.drop("order_action").limit(0)
    lab = spark.createDataFrame([(1, 0, 0.1), (2, 0, 0.2)], "sample_id long, month int, target double")
    return o, t, lab


def test_event_flow(spark):
    o, t, lab = events(spark)
    r = {x.sample_id: x for x in E.event_flow(o, t, lab).collect()}
    assert (r[1].order_signed_volume_per_second_5, r[1].order_signed_volume_per_event_5, r[1].order_event_count_per_second_5) == (1.0, 2.5, 0.4)
    assert r[2].order_signed_volume_per_second_60 == 0 and r[1].trade_event_count_per_second_5 == 0


def test_event_flow_ignores_future_and_partitioning(spark):
    o, t, lab = events(spark)
    more = o.union(spark.createDataFrame([(1, 9, -2.0, 1e6, 0, 0), (1, 10, 61.0, 1e6, 0, 0)], o.schema)).repartition(7)
    assert sorted(E.event_flow(o, t, lab).collect()) == sorted(E.event_flow(more, t, lab).collect())


def test_crossed_quote_is_missing(spark):
    m = quotes(spark, [(1, 1, 100, 99, 10, 10), (2, 1, 100, 101, 10, 10)])
    r = {x.sample_id: x for x in E.lob_geometry(m).collect()}
    assert r[1].lob_quote_missing == 1 and r[1].lob_l1_depth_share == 0 and r[2].lob_quote_missing == 0


def test_asof_grid(spark):
    m = quotes(spark, [(1, 5.5, 100, 101, 1, 1), (1, 3.0, 100, 101, 2, 2), (1, 3.0, 100, 101, 3, 3), (1, 0.5, 100, 101, 4, 4)])
    got = {r.g: r.bid_volume_1 for r in A.asof_grid(m, "bid_volume_1").collect()}
    assert got == {5: 1, 4: 1, 3: 3, 2: 3, 1: 3, 0: 4}


def test_short_path_has_zero_signature(spark):
    lab = spark.createDataFrame([(1, 0, 0.1)], "sample_id long, month int, target double")
    t = spark.createDataFrame([], "sample_id long, seconds_before_predict double, volume double, side int")
    r = A.path_signature(quotes(spark, [(1, 1.0, 100, 101, 1, 1)]), t, lab).head().asDict()
    assert len(r) == 115 and all(v == 0 for k, v in r.items() if k.startswith("path_sig"))


def test_blend_prefers_the_better_member_and_first_maximum(spark):
    df = spark.createDataFrame([(0, 1.0, 0.0, 1.0), (0, 0.0, 1.0, 0.05)], "g int, a double, b double, y double")
    r = J.fit_blend(df, "a", "b", "y", ["g"]).head()
    assert r.weight == pytest.approx(0.05, abs=0.011) and r.method == "raw"
    zero = spark.createDataFrame([(0, 1.0, 0.0, 1.0)], df.schema)
    assert J.fit_blend(zero, "a", "b", "y", ["g"]).head().weight == 0


def test_cosine_of_zero_is_zero(spark):
    df = spark.createDataFrame([(0.0, 1.0)], "p double, y double")
    assert df.agg(I.cosine("p", "y")).head()[0] == 0.0
    assert df.agg(I.cosine(F.lit(2.0), "y")).head()[0] == pytest.approx(1.0)


def test_splits_reject_leaks(spark):
    with pytest.raises(ValueError):
        H.splits(spark, [("x", "train", 0, 10), ("x", "score", 10, 20)])


def test_checks(spark):
    df = spark.createDataFrame([(1, 0, 2), (1, 1, 0), (2, 2, None)], "sample_id long, month int, side int")
    assert B.unique_key(df, "sample_id").head().violations == 1
    assert B.code_domain(df, "side").head().violations == 2
    assert {r["check"]: r.violations for r in B.month_coverage(df, 0, 3).collect()} == {"month_missing": 1, "month_extra": 0}
    assert B.aligned(df, df, "month", ["side"]).head().violations == 0
    with pytest.raises(ValueError):
        B.enforce(B.unique_key(df, "sample_id"))
    assert B.content_hash(df).head() == B.content_hash(df.repartition(3)).head()


def test_drift_uses_earlier_months_only(spark):
    m = spark.createDataFrame([(i, float(i)) for i in range(6)], "month int, mean double")
    r = {x.month: x for x in J.drift_estimates(m).collect()}
    assert r[0].expanding is None and r[3].expanding == 1.0 and r[5].rolling_3 == 3.0
    assert math.isclose(r[1].ewma_3, 0.0)
