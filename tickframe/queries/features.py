"""Feature families as queries over the adapter's tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import tidied, tidy
from ..operators import families as E
from ..sources.adapter import duck, read_tables
from .sqltext import SIGNED_ORDER, SIGNED_TRADE, flt, ratio, rnd, win, zero

WINDOWS = (5, 15, 30, 60)
KEEP = ("target",)


def event_flow(spark, d):
    t = read_tables(spark, d)
    return tidied(E.event_flow(t.order, t.trade, t.label), *KEEP)


def _flow_sql(prefix, flow, table, windows=WINDOWS):
    cols = []
    for w in windows:
        s, n = zero(flt(f"sum({flow})", win(w))), flt("count(*)", win(w))
        cols += [f"{s} / {w}.0 AS {prefix}_signed_volume_per_second_{w}", f"{ratio(s, n)} AS {prefix}_signed_volume_per_event_{w}", f"{n} / {w}.0 AS {prefix}_event_count_per_second_{w}"]
    return f"SELECT sample_id, {', '.join(cols)} FROM {table} GROUP BY sample_id", [c.rsplit(" AS ", 1)[1] for c in cols]


_O, _ON = _flow_sql("order", SIGNED_ORDER, "ord")
_T, _TN = _flow_sql("trade", SIGNED_TRADE, "trd")
FLOW_CTE = f"fo AS ({_O}), ft AS ({_T}), flow AS (SELECT lab.*, {', '.join(f'coalesce({c}, 0)::DOUBLE AS {c}' for c in _ON + _TN)} FROM lab LEFT JOIN fo USING (sample_id) LEFT JOIN ft USING (sample_id))"
EVENT_FLOW_SQL = f"WITH {duck('ord', 'trd', 'lab')}, {FLOW_CTE} SELECT sample_id, month, target, {', '.join(rnd(c, c) for c in _ON + _TN)} FROM flow"


def official(spark, d):
    t = read_tables(spark, d)
    return tidied(E.assembled(t.market, t.order, t.trade, t.label), *KEEP)


def _official_sql():
    m = ["arg_max(mid, {k}) AS m_mid_last", "avg(mid) AS m_mid_mean", "stddev_samp(mid) AS m_mid_std", "max(mid) - min(mid) AS m_mid_range", "arg_max(sp, {k}) AS m_sp_last", "avg(sp) AS m_sp_mean", "arg_max(imb, {k}) AS m_imb_last", "avg(imb) AS m_imb_mean", "stddev_samp(imb) AS m_imb_std", "avg(depth) AS m_depth_mean", "sqrt(sum(dmid * dmid)) AS m_rv", "sum(ofi) AS m_ofi_sum"]
    m = [x.format(k="n") for x in m]
    for w in (15, 60, 180):
        f = f"FILTER (WHERE seconds_before_predict <= {w})"
        m += [f"avg(mid) {f} AS m_mid_mean_{w}", f"stddev_samp(mid) {f} AS m_mid_std_{w}", f"avg(sp) {f} AS m_sp_mean_{w}", f"avg(imb) {f} AS m_imb_mean_{w}", f"sqrt(coalesce(sum(dmid * dmid) {f}, 0)) AS m_rv_{w}", f"coalesce(sum(ofi) {f}, 0) AS m_ofi_sum_{w}", f"coalesce(sum(transaction_volume) {f}, 0) AS m_txv_sum_{w}"]
    for tau in (30, 120):
        e = f"exp(-seconds_before_predict / {tau}.0)"
        m += [f"sum({e} * {c}) / (sum({e}) + 1e-8) AS m_{c}_ewm_{tau}" for c in ("mid", "imb", "ofi")]
    t = ["sum(volume) AS t_vol_sum", "sum(sv) AS t_sv_sum", "sum(sd) AS t_sd_sum", "avg(lv) AS t_lv_mean", "stddev_samp(price) AS t_px_std", "arg_max(price, n) AS t_px_last", "avg(CASE WHEN side = 0 THEN 1.0 ELSE 0.0 END) AS t_buy_ratio"]
    o = ["sum(volume) AS o_vol_sum", "sum(sv) AS o_sv_sum", "sum(av) AS o_av_sum", "avg(CASE WHEN side = 0 THEN 1.0 ELSE 0.0 END) AS o_buy_ratio", "avg(CASE WHEN order_action = 0 THEN 1.0 ELSE 0.0 END) AS o_add_ratio", "stddev_samp(price) AS o_px_std"]
    for w in (15, 45, 120):
        f = f"FILTER (WHERE seconds_before_predict <= {w})"
        t += [f"coalesce(sum({c}) {f}, 0) AS t_{k}_{w}" for c, k in (("volume", "vol"), ("sv", "sv"), ("sd", "sd"))] + [f"avg(lv) {f} AS t_lv_mean_{w}", f"avg(CASE WHEN side = 0 THEN 1.0 ELSE 0.0 END) {f} AS t_buy_ratio_{w}", f"count(*) {f} AS t_n_{w}"]
        o += [f"coalesce(sum({c}) {f}, 0) AS o_{c}_{w}" for c in ("sv", "av")] + [f"avg(CASE WHEN side = 0 THEN 1.0 ELSE 0.0 END) {f} AS o_buy_ratio_{w}", f"count(*) {f} AS o_n_{w}"]
    x = ["m_sp_mean * m_imb_mean AS x_sp_imb", "t_sv_sum / (t_vol_sum + 1) AS x_t_signed_ratio", "o_sv_sum / (o_vol_sum + 1) AS x_o_signed_ratio", "t_sd_sum / (t_vol_sum + 1) - m_mid_last AS x_vwap_vs_mid", "m_ofi_ewm_30 - m_ofi_ewm_120 AS x_ofi_ewm_short_long", "m_imb_ewm_30 - m_imb_ewm_120 AS x_imb_ewm_short_long", "t_sv_15 / (t_vol_15 + 1) AS x_t_signed_ratio_15", "m_rv_15 / (m_rv + 1e-8) AS x_rv_15_over_full"]
    name = lambda c: c.rsplit(" AS ", 1)[1]
    every = [name(c) for c in m + t + o + x]
    out = ", ".join(c if "_n_" in c else rnd(c, c) for c in every)
    rank = "row_number() OVER (PARTITION BY sample_id ORDER BY seconds_before_predict DESC, seq) AS n"
    return f"""WITH {duck('mkt', 'ord', 'trd', 'lab')},
 q0 AS (SELECT *, (ask_price_1 + bid_price_1) * 0.5 AS mid, ask_price_1 - bid_price_1 AS sp, (ask_volume_1 - bid_volume_1) / (ask_volume_1 + bid_volume_1 + 1) AS imb,
   ask_volume_1 + bid_volume_1 AS depth, ask_volume_1 - bid_volume_1 AS gap, {rank} FROM mkt),
 q AS (SELECT *, coalesce(mid - lag(mid) OVER w, 0) AS dmid, coalesce(gap - lag(gap) OVER w, 0) AS ofi FROM q0 WINDOW w AS (PARTITION BY sample_id ORDER BY n)),
 t0 AS (SELECT *, ln(1 + volume) AS lv, {SIGNED_TRADE} AS sv, {SIGNED_TRADE} * price AS sd, {rank} FROM trd),
 o0 AS (SELECT *, {SIGNED_TRADE} AS sv, volume * (CASE WHEN order_action = 0 THEN 1 ELSE -1 END) AS av FROM ord),
 m AS (SELECT sample_id, {', '.join(m)} FROM q GROUP BY sample_id), t AS (SELECT sample_id, {', '.join(t)} FROM t0 GROUP BY sample_id), o AS (SELECT sample_id, {', '.join(o)} FROM o0 GROUP BY sample_id),
 j AS (SELECT lab.month, lab.target, m.*, t.* EXCLUDE (sample_id), o.* EXCLUDE (sample_id) FROM lab JOIN m USING (sample_id) LEFT JOIN t ON t.sample_id = m.sample_id LEFT JOIN o ON o.sample_id = m.sample_id),
 k AS (SELECT *, {', '.join(x)} FROM j)
SELECT sample_id, month, target, {out} FROM k"""


def full_ofi(spark, d):
    t = read_tables(spark, d)
    return tidied(E.full_ofi(t.order, t.trade, t.market, t.label), *KEEP)


def _ofi_case(n):
    b, pb = f"bid_price_{n}", f"lag(bid_price_{n}) OVER w"
    bid = f"CASE WHEN {b} > {pb} THEN bid_volume_{n} WHEN {b} < {pb} THEN -lag(bid_volume_{n}) OVER w ELSE bid_volume_{n} - lag(bid_volume_{n}) OVER w END"
    a, pa = f"ask_price_{n}", f"lag(ask_price_{n}) OVER w"
    ask = f"CASE WHEN {a} < {pa} THEN ask_volume_{n} WHEN {a} > {pa} THEN -lag(ask_volume_{n}) OVER w ELSE lag(ask_volume_{n}) OVER w - ask_volume_{n} END"
    return f"CASE WHEN {pb} IS NULL THEN 0 ELSE ({bid}) + ({ask}) END AS q{n}"


def _full_ofi_sql():
    o, t, m, out = [], [], [], {}
    for w in WINDOWS:
        o += [f"{zero(flt(f'sum({SIGNED_ORDER})', win(w)))} AS of_{w}", f"{zero(flt('sum(volume)', win(w)))} AS ov_{w}", f"{flt('count(*)', win(w))} AS on_{w}"]
        t += [f"{zero(flt(f'sum({SIGNED_TRADE})', win(w)))} AS tf_{w}", f"{zero(flt('sum(volume)', win(w)))} AS tv_{w}", f"{flt('count(*)', win(w))} AS tn_{w}"]
        m += [f"{zero(flt('sum(q1)', win(w)))} AS q1_{w}", f"{zero(flt('sum(q2)', win(w)))} AS q2_{w}", f"{zero(flt('avg(d)', win(w)))} AS d_{w}"]
        out |= {f"ofi_event_rate_{w}": f"of_{w} / {w}.0", f"trade_flow_rate_{w}": f"tf_{w} / {w}.0", f"ofi_event_count_rate_{w}": f"on_{w} / {w}.0", f"trade_event_count_rate_{w}": f"tn_{w} / {w}.0", f"ofi_depth_{w}": ratio(f"of_{w}", f"abs(d_{w})"), f"ofi_volume_{w}": ratio(f"of_{w}", f"ov_{w}"), f"ofi_trade_volume_{w}": ratio(f"of_{w}", f"tv_{w}")}
        for n in (1, 2):
            out |= {f"quote_ofi_l{n}_rate_{w}": f"q{n}_{w} / {w}.0", f"quote_ofi_l{n}_depth_{w}": ratio(f"q{n}_{w}", f"abs(d_{w})")}
    more = {}
    for name, rate in (("ofi_event_rate", "of"), ("trade_flow_rate", "tf"), ("quote_ofi_l1", "q1"), ("quote_ofi_l2", "q2")):
        r = lambda w, rate=rate: f"{rate}_{w} / {w}.0"
        more |= {f"{name}_fast_slow_{a}_{b}": f"{r(a)} - {r(b)}" for a, b in ((5, 15), (15, 30), (30, 60))}
        if rate in ("of", "tf"):
            more[f"{name}_acceleration"] = f"({r(5)} - {r(15)}) - ({r(15)} - {r(30)})"
    more |= {"order_trade_gap_15": "of_15 / 15.0 - tf_15 / 15.0", "order_trade_agreement_15": "(of_15 / 15.0) * (tf_15 / 15.0)", "quote_trade_agreement_l1_15": "(q1_15 / 15.0) * (tf_15 / 15.0)", "quote_trade_agreement_l2_15": "(q2_15 / 15.0) * (tf_15 / 15.0)"}
    names = [c.rsplit(" AS ", 1)[1] for c in o + t + m]
    return f"""WITH {duck('mkt', 'ord', 'trd', 'lab')},
 q AS (SELECT sample_id, seconds_before_predict, bid_volume_1 + ask_volume_1 + bid_volume_2 + ask_volume_2 AS d, {_ofi_case(1)}, {_ofi_case(2)} FROM mkt WINDOW w AS (PARTITION BY sample_id ORDER BY seconds_before_predict DESC, seq)),
 o AS (SELECT sample_id, {', '.join(o)} FROM ord GROUP BY sample_id), t AS (SELECT sample_id, {', '.join(t)} FROM trd GROUP BY sample_id), m AS (SELECT sample_id, {', '.join(m)} FROM q GROUP BY sample_id),
 j AS (SELECT lab.*, {', '.join(f'coalesce({c}, 0)::DOUBLE AS {c}' for c in names)} FROM lab LEFT JOIN o USING (sample_id) LEFT JOIN t USING (sample_id) LEFT JOIN m USING (sample_id))
SELECT sample_id, month, target, {', '.join(rnd(v, k) for k, v in (out | more).items())} FROM j"""


def lob_geometry(spark, d):
    t = read_tables(spark, d)
    return tidied(E.onto_spine(t.label, E.lob_geometry(t.market)), *KEEP)


def _geometry_cte():
    fl = lambda x: f"greatest({x}, 1e-12)"
    s, tot = fl("ask_price_1 - bid_price_1"), fl("bid_volume_1 + ask_volume_1 + bid_volume_2 + ask_volume_2")
    b1, a1, b2, a2 = "bid_volume_1 / tot", "ask_volume_1 / tot", "bid_volume_2 / tot", "ask_volume_2 / tot"
    raw = {
        "lob_l1_depth_share": "(bid_volume_1 + ask_volume_1) / tot", "lob_bid_l1_l2_gap": "(bid_price_1 - bid_price_2) / spr", "lob_ask_l1_l2_gap": "(ask_price_2 - ask_price_1) / spr",
        "lob_bid2_rel_mid_spread": "(bid_price_2 - (bid_price_1 + ask_price_1) / 2) / spr", "lob_ask2_rel_mid_spread": "(ask_price_2 - (bid_price_1 + ask_price_1) / 2) / spr",
        "lob_bid1_depth_share": b1, "lob_ask1_depth_share": a1, "lob_bid2_depth_share": b2, "lob_ask2_depth_share": a2,
        "lob_bid_depth_share": "(bid_volume_1 + bid_volume_2) / tot", "lob_ask_depth_share": "(ask_volume_1 + ask_volume_2) / tot",
        "lob_near_far_bid": f"bid_volume_1 / {fl('bid_volume_2')}", "lob_near_far_ask": f"ask_volume_1 / {fl('ask_volume_2')}",
        "lob_depth_slope_bid": "bid_volume_2 - bid_volume_1", "lob_depth_slope_ask": "ask_volume_2 - ask_volume_1",
        "lob_depth_entropy": "-(" + " + ".join(f"CASE WHEN {p} > 0 THEN ({p}) * ln({p}) ELSE 0 END" for p in (b1, a1, b2, a2)) + ")",
        "lob_depth_hhi": " + ".join(f"({p}) * ({p})" for p in (b1, a1, b2, a2)), "lob_shape_asymmetry": "(bid_volume_1 + bid_volume_2 - ask_volume_1 - ask_volume_2) / tot",
        "lob_slope_asymmetry": "(bid_volume_2 - bid_volume_1) - (ask_volume_2 - ask_volume_1)", "lob_l1_l2_volume_ratio": f"(bid_volume_1 + ask_volume_1) / {fl('bid_volume_2 + ask_volume_2')}",
    }
    ok = "bid_price_2 <= bid_price_1 AND bid_price_1 < ask_price_1 AND ask_price_1 <= ask_price_2 AND least(bid_volume_1, ask_volume_1, bid_volume_2, ask_volume_2) >= 0"
    cols = [f"CASE WHEN {ok} THEN {v} ELSE 0 END AS {k}" for k, v in raw.items()] + [f"CASE WHEN {ok} THEN 0.0 ELSE 1.0 END AS lob_quote_missing"]
    names = [*raw, "lob_quote_missing"]
    return f"""g0 AS (SELECT *, {s} AS spr, {tot} AS tot FROM mkt QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY seconds_before_predict, seq DESC) = 1),
 geo AS (SELECT sample_id, {', '.join(cols)} FROM g0)""", names


GEO_CTE, GEO_NAMES = _geometry_cte()
GEOMETRY_SQL = f"WITH {duck('mkt', 'lab')}, {GEO_CTE} SELECT lab.sample_id, month, target, {', '.join(rnd(f'coalesce({c}, 0)::DOUBLE', c) for c in GEO_NAMES)} FROM lab LEFT JOIN geo USING (sample_id)"


def interactions(spark, d):
    t = read_tables(spark, d)
    out = E.interactions(E.lob_geometry(t.market), E.event_flow(t.order, t.trade, t.label))
    triplets = [c for c in out.columns if c.startswith("triplet")]  # ratios to a gap that may vanish: two digits
    return tidied(out, *KEEP, *triplets).withColumns({c: tidy(F.col(c), 2) for c in triplets})


def _interactions_sql():
    rel = lambda a, b: f"(({a} - {b}) / (abs({a}) + abs({b}) + 1e-12))"

    def tri(x, y, z):
        hi, lo = f"greatest({x}, {y}, {z})", f"least({x}, {y}, {z})"
        mi = f"greatest(least({x}, {y}), least(greatest({x}, {y}), {z}))"
        return f"({hi} - {mi}) / ({mi} - {lo} + 1e-12)"

    b1, b2, a1, a2 = (f"lob_{k}_depth_share" for k in ("bid1", "bid2", "ask1", "ask2"))
    base = {"i1": rel(b1, a1), "i2": rel(b2, a2), "ib": rel("lob_bid_depth_share", "lob_ask_depth_share"), "px": "greatest(lob_bid_l1_l2_gap + lob_ask_l1_l2_gap, 0)"}
    for w in WINDOWS:
        base |= {f"op{w}": f"asinh(order_signed_volume_per_event_{w})", f"tp{w}": f"asinh(trade_signed_volume_per_event_{w})", f"n{w}": f"greatest(order_event_count_per_second_{w} + trade_event_count_per_second_{w}, 0)"}
    bg, ag, vr = "lob_bid_l1_l2_gap", "lob_ask_l1_l2_gap", "lob_l1_l2_volume_ratio"
    out = {f"triplet_imbalance_{k}": v for k, v in {"bid1_share_bid2_share_ask1_share": tri(b1, b2, a1), "bid1_share_bid2_share_ask2_share": tri(b1, b2, a2), "ask1_share_ask2_share_bid1_share": tri(a1, a2, b1), "ask1_share_ask2_share_bid2_share": tri(a1, a2, b2), "l1_imbalance_l2_imbalance_book_imbalance": tri("i1", "i2", "ib"), "bid_gap_ask_gap_l1_l2_volume_ratio": tri(bg, ag, vr)}.items()}
    out |= {f"urgency_relative_spread_{k}": f"px * {v}" for k, v in {"l1_imbalance": "i1", "l2_imbalance": "i2", "book_imbalance": "ib", "order_pressure_5": "op5", "trade_pressure_5": "tp5", "order_trade_agreement_5": "(tanh(op5) * tanh(tp5))"}.items()}
    out |= {"depth_pressure_l1_imbalance_bid_gap": f"i1 * {bg}", "depth_pressure_l2_imbalance_ask_gap": f"i2 * {ag}", "depth_pressure_book_imbalance_mean_gap": f"ib * ({bg} + {ag}) / 2", "depth_pressure_shape_asymmetry_book_imbalance": "lob_shape_asymmetry * ib"}
    for w in WINDOWS:
        out |= {f"flow_combined_pressure_relative_spread_{w}": f"(op{w} + tp{w}) * px", f"flow_combined_pressure_log_event_intensity_{w}": f"(op{w} + tp{w}) * ln(1 + n{w})"}
    return f"""WITH {duck('mkt', 'ord', 'trd', 'lab')}, {FLOW_CTE}, {GEO_CTE},
 b AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in base.items())} FROM flow JOIN geo USING (sample_id))
SELECT sample_id, month, target, {', '.join(rnd(v, k, 2 if k.startswith('triplet') else 6) for k, v in out.items())} FROM b"""


QUERIES = {"event_flow": event_flow, "official_features": official, "full_ofi": full_ofi, "lob_geometry": lob_geometry, "book_event_interactions": interactions}
ORACLES = {"event_flow": EVENT_FLOW_SQL, "official_features": _official_sql(), "full_ofi": _full_ofi_sql(), "lob_geometry": GEOMETRY_SQL, "book_event_interactions": _interactions_sql()}
