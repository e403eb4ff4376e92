"""Micro-structure and context families as queries."""
from __future__ import annotations

from ..functions.exprs import tidied
from ..operators import micro as M
from ..sources.adapter import duck, read_tables
from .features import KEEP
from .paths import VALID
from .sqltext import SIGNED_ORDER, SIGNED_TRADE, rnd, win

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _s(cond, what, of=None):
    f = f"FILTER (WHERE {cond})"
    return f"coalesce(sum({what}) {f}, 0) / ({of or f'coalesce(sum(volume) {f}, 0)'} + 1)"


def _micro_sql():
    o = {"o_add_imb": _s("order_action = 0", "sv"), "o_cancel_imb": _s("order_action = 1", "sv"), "o_add_cancel_ratio": _s("order_action = 0", "volume", "coalesce(sum(volume) FILTER (WHERE order_action = 1), 0)"), "o_ofi_norm": _s("true", "volume * (1 - 2 * order_action)"), "o_arrival_rate": "count(iat) / 60.0", "o_iat_mean_log": "ln(1 + avg(iat))", "o_iat_cv": "stddev_samp(iat) / (avg(iat) + 1e-8)", "o_burst_ratio": "max(iat) / (quantile_cont(iat, 0.5) + 1e-8)", "o_large_imb": _s("volume > q90", "sv"), "o_large_share": _s("volume > q90", "volume", "sum(volume)")}
    t = {"t_signed_norm": _s("true", "sv"), "t_arrival_rate": "count(iat) / 60.0", "t_iat_cv": "stddev_samp(iat) / (avg(iat) + 1e-8)", "t_large_imb": _s("volume > q90", "sv"), "t_large_share": _s("volume > q90", "volume", "sum(volume)"), "t_flow_fast_slow": _s("seconds_before_predict <= 5", "sv") + " - " + _s("true", "sv")}
    m = {"m_micro_gap_last": "arg_max(gap, k)", "m_micro_gap_mean": "avg(gap)", "m_sp_rel_last": "arg_max(sp, k) / (arg_max(mid, k) + 1e-8)", "m_sp_rel_mean": "avg(sp) / (avg(mid) + 1e-8)", "m_imb2_last": "arg_max(imb2, k)", "m_imb2_mean": "avg(imb2)"}
    lag = "abs(seconds_before_predict - lag(seconds_before_predict) OVER (PARTITION BY sample_id ORDER BY seconds_before_predict DESC, seq)) AS iat, quantile_cont(volume, 0.9) OVER (PARTITION BY sample_id) AS q90"
    sel = lambda d: ", ".join(f"{v} AS {k}" for k, v in d.items())
    return f"""WITH {duck('mkt', 'ord', 'trd', 'lab')},
 o0 AS (SELECT *, {SIGNED_TRADE} AS sv, {lag} FROM ord), t0 AS (SELECT *, {SIGNED_TRADE} AS sv, {lag} FROM trd),
 m0 AS (SELECT sample_id, ask_price_1 - bid_price_1 AS sp, (ask_price_1 + bid_price_1) / 2 AS mid, ((ask_price_1 * bid_volume_1 + bid_price_1 * ask_volume_1) / (ask_volume_1 + bid_volume_1 + 1) - mid) / (sp + 1e-8) AS gap,
   (ask_volume_2 - bid_volume_2) / (ask_volume_2 + bid_volume_2 + 1) AS imb2, row_number() OVER (PARTITION BY sample_id ORDER BY seconds_before_predict DESC, seq) AS k FROM mkt WHERE ask_price_1 > 0),
 o AS (SELECT sample_id, {sel(o)} FROM o0 GROUP BY 1), t AS (SELECT sample_id, {sel(t)} FROM t0 GROUP BY 1), m AS (SELECT sample_id, {sel(m)} FROM m0 GROUP BY 1)
SELECT lab.sample_id, month, target, {', '.join(rnd(k, k) for k in [*o, *t, *m])} FROM lab LEFT JOIN o USING (sample_id) LEFT JOIN t USING (sample_id) LEFT JOIN m USING (sample_id)"""


@query(_micro_sql())
def micro_structure(spark, d):
    t = read_tables(spark, d)
    return tidied(M.micro_structure(t.market, t.order, t.trade, t.label), *KEEP)


def _enhanced_sql():
    f = lambda n: f"FILTER (WHERE seconds_before_predict <= {n})"
    rv = lambda n: f"sqrt(coalesce(sum(dm * dm) {f(n)}, 0))"
    out = {}
    for n in (5, 30, 300):
        out |= {f"m_rv_{n}": rv(n), f"m_ofi_sum_{n}": f"coalesce(sum(ofi) {f(n)}, 0)", f"m_txv_sum_{n}": f"coalesce(sum(transaction_volume) {f(n)}, 0)"}
    out |= {"m_mid_p25_60": f"quantile_cont(mid, 0.25) {f(60)}", "m_mid_p75_60": f"quantile_cont(mid, 0.75) {f(60)}", "m_sp_std_60": f"stddev_samp(sp) {f(60)}", "m_imb_range_60": f"max(imb) {f(60)} - min(imb) {f(60)}", "m_mid_ret_60": f"arg_max(mid, k) {f(60)} - arg_min(mid, k) {f(60)}", "x_ofi_5_over_full": f"coalesce(sum(ofi) {f(5)}, 0) / (abs(sum(ofi) {f(600)}) + 1e-8)", "x_rv_5_over_full": f"{rv(5)} / nullif({rv(600)}, 0)", "x_mid_std_60_over_full": f"stddev_samp(mid) {f(60)} / nullif(stddev_samp(mid) {f(600)}, 0)"}
    out |= {"m_mid_skew_60": "avg(pow(dev, 3)) / nullif(pow(sqrt(avg(pow(dev, 2))), 3), 0)", "m_mid_kurt_60": "avg(pow(dev, 4)) / nullif(pow(avg(pow(dev, 2)), 2), 0) - 3"}
    near = "CASE WHEN seconds_before_predict <= 60 THEN (ask_price_1 + bid_price_1) / 2 END"
    return f"""WITH {duck('mkt')}, a AS (SELECT *, round({near} - avg({near}) OVER (PARTITION BY sample_id), 9) AS dev, (ask_price_1 + bid_price_1) / 2 AS mid, ask_price_1 - bid_price_1 AS sp, (ask_volume_1 - bid_volume_1) / (ask_volume_1 + bid_volume_1 + 1) AS imb, ask_volume_1 - bid_volume_1 AS gap, row_number() OVER (PARTITION BY sample_id ORDER BY seconds_before_predict DESC, seq) AS k FROM mkt),
 b AS (SELECT *, coalesce(mid - lag(mid) OVER w, 0) AS dm, coalesce(gap - lag(gap) OVER w, 0) AS ofi FROM a WINDOW w AS (PARTITION BY sample_id ORDER BY k))
SELECT sample_id, {', '.join(rnd(v, k, 3 if k == 'x_ofi_5_over_full' else 6) for k, v in out.items())} FROM b GROUP BY sample_id"""


@query(_enhanced_sql())
def enhanced_windows(spark, d):
    from ..functions.exprs import tidy
    from pyspark.sql import functions as F

    out = M.enhanced_windows(read_tables(spark, d).market)
    return tidied(out, "x_ofi_5_over_full").withColumn("x_ofi_5_over_full", tidy(F.col("x_ofi_5_over_full"), 3))


def _normalised_sql():
    m, e = [], {"order": [], "trade": []}
    for w in (5, 15, 30, 60):
        f = f"FILTER (WHERE {win(w)})"
        m += [f"arg_min(lm, k) {f} AS lf_{w}", f"arg_max(lm, k) {f} AS ll_{w}", f"max(lm) {f} - min(lm) {f} AS lr_{w}", f"sqrt(avg(step * step) {f}) AS rms_{w}", f"quantile_cont(sr, 0.5) {f} AS sm_{w}", f"avg(sr) {f} AS sa_{w}", f"arg_max(mg, k) {f} AS mg_{w}", f"arg_min(d, k) {f} AS df_{w}", f"arg_max(d, k) {f} AS dl_{w}", f"sqrt(avg(d * d) {f}) AS dr_{w}"]
        for k, flow in (("order", SIGNED_ORDER), ("trade", SIGNED_TRADE)):
            e[k] += [f"count(*) {f} AS {k}_n_{w}", f"sum({flow}) {f} AS {k}_f_{w}", f"avg(volume * volume) {f} AS {k}_v_{w}"]
    names = [c.rsplit(" AS ", 1)[1] for c in [*m, *e["order"], *e["trade"]]]
    fl = lambda v: f"greatest({v}, 1e-8)"
    out = {}
    for w in (5, 15, 30, 60):
        ps, ds = f"greatest(rms_{w}, sm_{w}, 1e-8)", fl(f"dr_{w}")
        out |= {f"mid_net_z_{w}": f"(ll_{w} - lf_{w}) / {ps}", f"mid_range_z_{w}": f"lr_{w} / {ps}", f"spread_mean_z_{w}": f"sa_{w} / {ps}", f"microgap_last_z_{w}": f"mg_{w} / {ps}", f"depth_change_z_{w}": f"(dl_{w} - df_{w}) / {ds}"}
        out |= {f"{k}_flow_z_{w}": f"{k}_f_{w} / {fl(f'sqrt({k}_n_{w} * {k}_v_{w})')}" for k in ("order", "trade")}
    out |= {"log_ret_sigma_60": f"ln({fl('rms_60')})", "log_depth_rms_60": f"ln({fl('dr_60')})", "log_order_volume_rms_60": f"ln({fl('sqrt(order_v_60)')})", "log_trade_volume_rms_60": f"ln({fl('sqrt(trade_v_60)')})", "log1p_order_event_rate_60": "ln(1 + order_n_60 / 60)", "log1p_trade_event_rate_60": "ln(1 + trade_n_60 / 60)", "market_missing": "CASE WHEN dr_60 > 0 THEN 0 ELSE 1 END", "order_missing": "CASE WHEN order_n_60 > 0 THEN 0 ELSE 1 END", "trade_missing": "CASE WHEN trade_n_60 > 0 THEN 0 ELSE 1 END"}
    ok = VALID.replace("AND seconds_before_predict BETWEEN 0 AND 60", "AND seconds_before_predict >= 0 AND bid_price_1 + ask_price_1 > 0")
    return f"""WITH {duck('mkt', 'ord', 'trd', 'lab')},
 q0 AS (SELECT *, ln((bid_price_1 + ask_price_1) / 2) AS lm, (ask_price_1 - bid_price_1) / ((bid_price_1 + ask_price_1) / 2) AS sr, bid_volume_1 + ask_volume_1 + bid_volume_2 + ask_volume_2 AS d,
   CASE WHEN bid_volume_1 + ask_volume_1 > 0 THEN ((ask_price_1 * bid_volume_1 + bid_price_1 * ask_volume_1) / (bid_volume_1 + ask_volume_1) - (bid_price_1 + ask_price_1) / 2) / ((bid_price_1 + ask_price_1) / 2) ELSE 0 END AS mg,
   row_number() OVER (PARTITION BY sample_id ORDER BY seconds_before_predict DESC, seq) AS k FROM mkt WHERE {ok}),
 q AS (SELECT *, lm - lag(lm) OVER (PARTITION BY sample_id ORDER BY k) AS step FROM q0), m AS (SELECT sample_id, {', '.join(m)} FROM q GROUP BY 1), o AS (SELECT sample_id, {', '.join(e['order'])} FROM ord GROUP BY 1), t AS (SELECT sample_id, {', '.join(e['trade'])} FROM trd GROUP BY 1),
 j AS (SELECT lab.*, {', '.join(f'coalesce({c}, 0)::DOUBLE AS {c}' for c in names)} FROM lab LEFT JOIN m USING (sample_id) LEFT JOIN o USING (sample_id) LEFT JOIN t USING (sample_id))
SELECT sample_id, month, target, {', '.join(rnd(f'({v})::DOUBLE', f'revol_{k}') for k, v in out.items())} FROM j"""


@query(_normalised_sql())
def normalised_windows(spark, d):
    t = read_tables(spark, d)
    return tidied(M.normalised_windows(t.market, t.order, t.trade, t.label), *KEEP)


def _context_sql():
    parts = " ".join(f"WHEN seconds_before_predict >= {a} AND seconds_before_predict < {b} THEN {i}" for i, (a, b) in enumerate(M.SEGMENTS))
    g = {"std": "stddev_samp(mid)", "spread": "avg(sp)", "depth": "avg(depth)", "volume": "sum(transaction_volume)", "change": "(arg_max(mid, k) - arg_min(mid, k)) / (arg_min(mid, k) + 1e-12)", "step": "avg(abs(mid - was))", "acf": "CASE WHEN count(was) > 2 AND var_pop(was) > 1e-12 AND var_pop(mid) FILTER (WHERE was IS NOT NULL) > 1e-12 THEN corr(mid, was) END"}
    cols = ", ".join(rnd(f"coalesce(max({c}) FILTER (WHERE part = {i}), 0)::DOUBLE", f"seg_{a}_{b}_{c}") for i, (a, b) in enumerate(M.SEGMENTS) for c in g)
    return f"""WITH {duck('mkt', 'lab')}, a AS (SELECT *, (bid_price_1 + ask_price_1) / 2 AS mid, ask_price_1 - bid_price_1 AS sp, bid_volume_1 + ask_volume_1 AS depth, CASE {parts} END AS part, row_number() OVER (PARTITION BY sample_id ORDER BY seconds_before_predict DESC, seq) AS k FROM mkt),
 b AS (SELECT *, lag(mid) OVER (PARTITION BY sample_id, part ORDER BY k) AS was FROM a WHERE part IS NOT NULL), c AS (SELECT sample_id, part, {', '.join(f'{v} AS {k}' for k, v in g.items())} FROM b GROUP BY ALL)
SELECT lab.sample_id, any_value(month) AS month, any_value(target) AS target, {cols} FROM lab LEFT JOIN c USING (sample_id) GROUP BY lab.sample_id"""


@query(_context_sql())
def long_context(spark, d):
    t = read_tables(spark, d)
    return tidied(M.long_context(t.market, t.label), *KEEP)


@query(f"""WITH {duck('mkt', 'ord', 'trd', 'lab')},
 m AS (SELECT sample_id, max((bid_price_1 + ask_price_1) / 2) - min((bid_price_1 + ask_price_1) / 2) AS mid_range, stddev_samp((bid_price_1 + ask_price_1) / 2) AS mid_std, avg(bid_volume_1 + ask_volume_1) AS depth, CASE WHEN quantile_cont((bid_price_1 + ask_price_1) / 2, 0.5) < 0.7 THEN 1 ELSE 0 END AS half_price FROM mkt WHERE ask_price_1 > 0 AND bid_price_1 > 0 GROUP BY 1),
 o AS (SELECT sample_id, count(*) AS n_order, avg(side) AS order_sell, avg(1 - 2 * order_action) AS add_cancel FROM ord GROUP BY 1), t AS (SELECT sample_id, count(*) AS n_trade, avg(side) AS trade_sell FROM trd GROUP BY 1), n AS (SELECT sample_id, count(*) AS n_market FROM mkt GROUP BY 1)
SELECT lab.sample_id, month, target, {', '.join(rnd(f'coalesce({c}, 0)::DOUBLE', c) for c in ('mid_range', 'mid_std', 'depth', 'order_sell', 'add_cancel', 'trade_sell'))}, coalesce(half_price, 0) AS half_price, coalesce(n_order, 0) AS n_order, coalesce(n_trade, 0) AS n_trade, coalesce(n_market, 0) AS n_market
FROM lab LEFT JOIN m USING (sample_id) LEFT JOIN o USING (sample_id) LEFT JOIN t USING (sample_id) LEFT JOIN n USING (sample_id)""")
def activity(spark, d):
    t = read_tables(spark, d)
    return tidied(M.activity(t.market, t.order, t.trade, t.label), *KEEP)
