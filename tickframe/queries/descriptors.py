"""Complete descriptor families of raw streams as queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import tidied
from ..operators import descriptors as D
from ..sources.adapter import duck, frame
from .sqltext import SIGNED_TRADE, flt, ratio, rnd

QUERIES: dict = {}
ORACLES: dict = {}
_PATH = "w AS (PARTITION BY sample_id ORDER BY seconds_before_predict DESC, seq)"
_QUOTES = """q AS (SELECT *, (bid_price_1 + ask_price_1) / 2 AS mid, ask_price_1 - bid_price_1 AS spread, ask_price_2 - bid_price_2 AS spread2, bid_volume_1 + ask_volume_1 AS depth, bid_volume_2 + ask_volume_2 AS depth2,
 bid_volume_1 / (bid_volume_1 + ask_volume_1 + 1e-12) AS imb FROM mkt WHERE ask_price_1 > 0)"""


def query(sql):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _listed(cols: dict, longs=()) -> str:
    return ", ".join(f"{v} AS {k}" if k in longs else rnd(f"coalesce({v}, 0)", k) for k, v in cols.items())


def _path_sql():
    a = {"n_snap": "count(*)", "mid_max": "max(mid)", "mid_min": "min(mid)", "mid_range": "max(mid) - min(mid)", "spread_max": "max(spread)"}
    for c in ("mid", "spread", "depth", "imb"):
        a |= {f"{c}_mean": f"avg({c})", f"{c}_std": f"stddev_samp({c})", f"{c}_first": f"arg_min({c}, k)", f"{c}_last": f"arg_max({c}, k)"}
    a |= {"bid_depth_mean": "avg(bid_volume_1)", "ask_depth_mean": "avg(ask_volume_1)", "spread_widen_freq": "avg((spread > spread0)::INT)", "depth_depletion_freq": "avg((depth < depth0)::INT)"}
    a |= {"mid_avgprice_gap": "avg(coalesce(mid - transaction_avgprice, 0))", "mid_ret_acf1": "1e8 * avg(coalesce(step * next, 0))"}
    for i, s in enumerate(D.SEGMENTS):
        ok = f"part = {i}"
        a |= {f"mid_seg_std_{s}": flt("stddev_samp(mid)", ok), **{f"{c}_seg_mean_{s}": flt(f"avg({c})", ok) for c in ("mid", "spread", "depth", "imb")}}
    z = {k: v if k == "n_snap" else f"coalesce({v}, 0)" for k, v in a.items()}
    late = "CASE WHEN (n_snap - 1) * 1000 >= 667 * n_snap THEN 1 ELSE 0 END"
    more = {"mid_trend": ratio("mid_last - mid_first", "abs(mid_first)"), "spread_trend": ratio("spread_last - spread_first", "abs(spread_first)"), "depth_trend": ratio("depth_last", "depth_first"), "imb_disp": "imb_last - imb_first", "mid_vol_rel": ratio("mid_std", "abs(mid_first)")}
    more |= {f"{n}_recent_early": ratio(f"{c}_recent", f"{c}_early") for n, c in (("vol", "mid_seg_std"), ("spread", "spread_seg_mean"), ("depth", "depth_seg_mean"))}
    more |= {n: f"({late}) * ({c}_recent - {c}_early)" for n, c in (("imb_recent_early", "imb_seg_mean"), ("mid_path_drift", "mid_seg_mean"))}
    return f"""WITH {duck('mkt')}, {_QUOTES}, r AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY sample_id) AS n, mid - lag(mid) OVER w AS step, lead(mid) OVER w - mid AS next, first_value(spread) OVER w AS spread0, first_value(depth) OVER w AS depth0 FROM q WINDOW {_PATH}),
 s AS (SELECT *, CASE WHEN (k - 1) * 1000 < 333 * n THEN 0 WHEN (k - 1) * 1000 < 667 * n THEN 1 ELSE 2 END AS part FROM r), d AS (SELECT sample_id, {', '.join(f'{v} AS {k}' for k, v in z.items())} FROM s GROUP BY 1)
SELECT sample_id, {_listed({**{k: k for k in z}, **more}, ('n_snap',))} FROM d"""


@query(_path_sql())
def path_descriptors(spark, d):
    """The path of each sample's quotes; the product of neighbouring steps in squares of a ten-thousandth."""
    return tidied(D.path_descriptors(frame(spark, d, "mkt")).withColumn("mid_ret_acf1", F.col("mid_ret_acf1") * 1e8))


def _history_sql():
    a = {"spread1_mean": "avg(spread)", "spread1_std": "stddev_samp(spread)", "depth1_mean": "avg(depth)", "depth2_mean": "avg(depth2)", "tx_vol_total": "sum(transaction_volume)", "tx_cnt_total": "CAST(coalesce(sum(transaction_count), 0) AS BIGINT)", "mid_std": "stddev_samp(mid)", "mid_mean": "avg(mid)", "imb1_mean": "avg(imb)"}
    for n, c in (("mid", "mid"), ("depth1", "depth"), ("spread1", "spread")):
        a |= {f"{n}_first": f"arg_min({c}, k)", f"{n}_last": f"arg_max({c}, k)"}
    for i, (lo, hi) in enumerate(D.HISTORY):
        ok = f"seconds_before_predict >= {lo} AND seconds_before_predict < {hi}"
        a |= {f"seg{i}_spread": flt("avg(spread)", ok), f"seg{i}_depth": flt("avg(depth)", ok), f"seg{i}_vol": flt("sum(transaction_volume)", ok), f"seg{i}_mid": flt("avg(mid)", ok)}
    more = {"mid_trend_600": ratio("mid_last - mid_first", "abs(mid_first)"), "depth_trend_600": ratio("depth1_last", "depth1_first"), "spread_trend_600": ratio("spread1_last - spread1_first", "abs(spread1_first)")}
    return f"""WITH {duck('mkt')}, {_QUOTES}, r AS (SELECT *, row_number() OVER w AS k FROM q WINDOW {_PATH}), d AS (SELECT sample_id, {', '.join(f'{v} AS {k}' for k, v in a.items())} FROM r GROUP BY 1)
SELECT sample_id, {_listed({**{k: k for k in a}, **more}, ('tx_cnt_total',))} FROM d"""


@query(_history_sql())
def history_600(spark, d):
    return tidied(D.history_600(frame(spark, d, "mkt")))


def _forms_sql():
    out = {}
    for w in D.FORM_WINDOWS:
        ok = f"seconds_before_predict < {w}"
        out |= {f"m_ofi_sum_{w}": flt("sum(ofi)", ok), f"m_imb_mean_{w}": flt("avg(gap)", ok), f"m_mid_std_{w}": flt("stddev_samp(mid)", ok), f"m_mid_last_{w}": flt("arg_max(mid, k)", ok)}
    out |= {"m_ofi_sum_600": "sum(ofi)", "m_imb_mean_600": "avg(gap)", "m_imb2_mean_600": "avg(bid_volume_2 - ask_volume_2)", "m_mid_std_600": "stddev_samp(mid)", "m_mid_slope_600": "arg_max(mid, k) / arg_min(mid, k) - 1", "m_spread1_mean_600": "avg(spread)", "m_spread2_mean_600": "avg(spread2)", "m_txvol_600": "sum(transaction_volume)"}
    part = lambda s: f"CASE WHEN {s}_price_1 < lag({s}_price_1) OVER w THEN -{s}_volume_1 ELSE {s}_volume_1 - lag({s}_volume_1) OVER w END"
    return f"""WITH {duck('mkt')}, {_QUOTES}, r AS (SELECT *, row_number() OVER w AS k, bid_volume_1 - ask_volume_1 AS gap, coalesce({part('bid')} - {part('ask')}, 0) AS ofi FROM q WINDOW {_PATH}) SELECT sample_id, {_listed(out)} FROM r GROUP BY sample_id"""


@query(_forms_sql())
def flow_forms(spark, d):
    return tidied(D.flow_forms(frame(spark, d, "mkt")))


def _events_sql(p: str, more: dict) -> tuple[dict, dict]:
    """(aggregates, what is made of them)."""
    s, t = "seconds_before_predict", lambda x, ok: f"coalesce({flt(f'sum({x})', ok)}, 0)"
    a = {"signed_vol": "sum(sv)", "buy_vol": t("volume", "side = 0"), "sell_vol": t("volume", "side <> 0"), "iat_mean": "avg(iat)", "iat_std": "stddev_samp(iat)", "iat_max": "max(iat)", "size_max": "max(volume)", "px_mean": "avg(price)", "px_std": "stddev_samp(price)"}
    a |= {f"size_p{round(100 * q)}": f"quantile_cont(volume, {q})" for q in (0.25, 0.75, 0.9)}
    for n, ok in (("recent15", f"{s} < 15"), ("prev30", f"{s} >= 15 AND {s} < 45")):
        a |= {f"{n}_cnt": flt("count(*)", ok), f"{n}_vol": t("volume", ok), f"{n}_sv": t("sv", ok)}
    made = {"sv_imb": "{p}_signed_vol / ({p}_buy_vol + {p}_sell_vol + 1)", "iat_cv": "{p}_iat_std / ({p}_iat_mean + 1e-6)", "burst_ratio": "{p}_iat_max / ({p}_iat_mean + 1e-6)", "recent_prev_rate": "({p}_recent15_cnt / 15.0) / ({p}_prev30_cnt / 30.0 + 1e-6)", "recent_prev_vol": "({p}_recent15_vol / 15.0) / ({p}_prev30_vol / 30.0 + 1e-6)", "recent15_sv_imb": "{p}_recent15_sv / ({p}_recent15_vol + 1)", "iat_mean_log": "ln(1 + {p}_iat_mean)"}
    return {f"{p}_{k}": v for k, v in {**a, **more}.items()}, {f"{p}_{k}": v.format(p=p) for k, v in made.items()}


def _aggregates_sql():
    k = {"add": "order_action = 0", "cancel": "order_action <> 0", "bid_add": "side = 0 AND order_action = 0", "ask_add": "side <> 0 AND order_action = 0", "bid_cancel": "side = 0 AND order_action <> 0", "ask_cancel": "side <> 0 AND order_action <> 0"}
    o, om = _events_sql("ob", {**{f"{n}_cnt": flt("count(*)", c) for n, c in k.items()}, "act_signed_vol": "sum(CASE WHEN order_action = 0 THEN volume ELSE -volume END)", "add_vol": f"coalesce({flt('sum(volume)', 'order_action = 0')}, 0)", "cancel_vol": f"coalesce({flt('sum(volume)', 'order_action <> 0')}, 0)", "event_cnt": "count(*)"})
    om |= {"ob_add_cancel_ratio": "ob_add_cnt / (ob_cancel_cnt + 1)", "ob_add_side_imb": "(ob_bid_add_cnt - ob_ask_add_cnt) / (ob_add_cnt + 1)", "ob_cancel_side_imb": "(ob_bid_cancel_cnt - ob_ask_cancel_cnt) / (ob_cancel_cnt + 1)", "ob_event_cnt_log": "ln(1 + ob_event_cnt)", "ob_add_cancel_vol_ratio": "ob_add_vol / (ob_cancel_vol + 1)"}
    t, tm = _events_sql("tb", {"buy_cnt": flt("count(*)", "side = 0"), "sell_cnt": flt("count(*)", "side <> 0"), "trade_cnt": "count(*)", "px_max": "max(price)", "px_min": "min(price)"})
    tm |= {"tb_cnt_imb": "(tb_buy_cnt - tb_sell_cnt) / (tb_trade_cnt + 1)", "tb_px_range": "tb_px_max - tb_px_min", "tb_trade_cnt_log": "ln(1 + tb_trade_cnt)"}
    plain = lambda x: ", ".join(f"{v} AS {k}" for k, v in x.items())
    cols = ", ".join(c if c.endswith("_cnt") else rnd(x, c) for c, x in {**{c: c for c in (*o, *t)}, **om, **tm}.items())
    steps = lambda n, src: f"{n} AS (SELECT *, {SIGNED_TRADE} AS sv, lag(seconds_before_predict) OVER w - seconds_before_predict AS iat FROM {src} WINDOW {_PATH})"
    return f"""WITH {duck('ord', 'trd', 'lab')}, {steps('os', 'ord')}, {steps('ts', 'trd')}, o AS (SELECT sample_id, {plain(o)} FROM os GROUP BY 1), t AS (SELECT sample_id, {plain(t)} FROM ts GROUP BY 1)
SELECT lab.sample_id, month, {cols} FROM lab LEFT JOIN o USING (sample_id) LEFT JOIN t USING (sample_id)"""


@query(_aggregates_sql())
def order_trade_aggregates(spark, d):
    return tidied(D.order_trade_aggregates(*(frame(spark, d, n) for n in ("ord", "trd", "lab"))))
