"""Descriptor families: small cases by hand, samples that do not touch each other, one row, none, nulls."""
import pytest
from pyspark.sql import functions as F

from tickframe.operators import descriptors as D

MARKET = "sample_id long, seq long, seconds_before_predict double, bid_price_1 double, ask_price_1 double, bid_price_2 double, ask_price_2 double, bid_volume_1 double, ask_volume_1 double, bid_volume_2 double, ask_volume_2 double, transaction_avgprice double, transaction_count long, transaction_volume double"
ORDER = "sample_id long, seq long, seconds_before_predict double, price double, volume double, side int, order_action int"
FAMILIES = (D.path_descriptors, D.history_600, D.flow_forms)


def quote(sample, seq, s, bid, ask, bv=10.0, av=10.0, traded=None):
    return sample, seq, s, bid, ask, bid - 1, ask + 1 if ask else 0.0, bv, av, 5.0, 5.0, traded, 1, 2.0


ONE = [quote(1, 0, 500.0, 10.0, 12.0, 10.0, 20.0), quote(1, 1, 200.0, 11.0, 14.0, 15.0, 10.0, 12.0), quote(1, 2, 4.0, 10.0, 12.0, 8.0, 8.0)]


def by_id(df):
    return {r.sample_id: r.asDict() for r in df.collect()}


def test_by_hand(spark):
    m = spark.createDataFrame(ONE, MARKET)
    p, h, f = (by_id(g(m))[1] for g in FAMILIES)
    assert (p["mid_first"], p["mid_last"], p["mid_range"], p["n_snap"]) == (11.0, 11.0, 1.5, 3)
    assert p["spread_widen_freq"] == pytest.approx(1 / 3) and p["depth_depletion_freq"] == pytest.approx(2 / 3)
    assert p["mid_ret_acf1"] == pytest.approx(1.5 * -1.5 / 3) and p["mid_avgprice_gap"] == pytest.approx(0.5 / 3)
    # the last of three rows begins at 0.666: nothing is recent, so nothing is compared
    assert (p["mid_seg_mean_early"], p["mid_seg_mean_mid"], p["mid_seg_mean_recent"], p["mid_path_drift"], p["vol_recent_early"]) == (11.0, 11.75, 0.0, 0.0, 0.0)
    assert (h["seg1_mid"], h["seg3_mid"], h["tx_cnt_total"], h["depth_trend_600"]) == (12.5, 11.0, 3, pytest.approx(16 / 30))
    # steps: bid up +5, ask up 10 - 20; then bid down -8, ask down -8
    assert f["m_ofi_sum_600"] == pytest.approx((5 + 10) + (-8 + 8)) and f["m_ofi_sum_5"] == 0.0 and f["m_mid_last_5"] == 11.0


def test_samples_do_not_touch_each_other(spark):
    two = [quote(2, k, 600.0 - 50 * k, 20.0 + k % 3, 22.0 + k % 2, 7.0 + k, 3.0 + k) for k in range(9)]
    alone, with_others = spark.createDataFrame(ONE, MARKET), spark.createDataFrame(two + ONE, MARKET).repartition(3)
    for g in FAMILIES:
        assert by_id(g(alone))[1] == pytest.approx(by_id(g(with_others))[1])


def test_one_quote_no_quote_and_nulls(spark):
    rows = [quote(1, 0, 30.0, 10.0, 12.0), quote(2, 0, 30.0, 10.0, 0.0), (3, 0, 30.0, *[None] * 11)]
    for g in FAMILIES:
        got = by_id(g(spark.createDataFrame(rows, MARKET)))
        assert set(got) == {1} and None not in got[1].values()
        assert g(spark.createDataFrame([], MARKET)).count() == 0


def test_windows_are_strict(spark):
    m = spark.createDataFrame([quote(1, 0, 5.0, 10.0, 12.0), quote(1, 1, 4.0, 30.0, 32.0)], MARKET)
    got = by_id(D.flow_forms(m))[1]
    assert got["m_imb_mean_5"] == 0.0 and got["m_mid_last_5"] == 31.0 and got["m_mid_std_5"] == 0.0 and got["m_mid_std_15"] > 0


def test_order_trade_aggregates(spark):
    o = spark.createDataFrame([(1, 0, 50.0, 2.0, 100.0, 0, 0), (1, 1, 20.0, 4.0, 300.0, 1, 0), (1, 2, 14.0, 6.0, 50.0, 0, 1)], ORDER)
    t = o.where("seq < 1").drop("order_action")
    lab = spark.createDataFrame([(1, 0), (9, 1)], "sample_id long, month int")
    got = by_id(D.order_trade_aggregates(o, t, lab))
    a = got[1]
    assert len(a) == 75 and (a["ob_add_cnt"], a["ob_bid_cancel_cnt"], a["ob_signed_vol"], a["ob_act_signed_vol"]) == (2, 1, -150.0, 350.0)
    assert (a["ob_iat_mean"], a["ob_iat_max"], a["ob_recent15_cnt"], a["ob_prev30_vol"], a["ob_size_p75"]) == (18.0, 30.0, 1, 300.0, 200.0)
    assert a["tb_iat_mean"] is None and a["tb_trade_cnt"] == 1 and set(list(got[9].values())[2:]) == {None}


def test_one_shuffle_of_the_quotes(spark):
    m = spark.range(100).select(*[(F.col("id") % 7).cast(c.rsplit(" ", 1)[1]).alias(c.split()[0]) for c in MARKET.split(", ")])
    for g in FAMILIES:
        plan = g(m)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "SinglePartition" not in plan
