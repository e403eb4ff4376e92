"""The wide stack of raw-stream features: trades, orders, whole seconds of orders, quotes, and what is formed across them.

Each family is a table of named aggregate expressions over prepared events, one grouped pass a family.  "Old" and "new" halves are by time: events are numbered from the
oldest to the newest.  Thresholds of large trades are global.  The texts are plain SQL, so that another engine can evaluate the same definitions."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from ..functions import exprs as X
from .order import quantiles

WEIGHTS = (15, 30, 60)
WINDOWS = (15, 30, 45, 120)
_W = "WINDOW w AS (PARTITION BY sample_id ORDER BY seconds_before_predict DESC, seq)"

#: Events with sign, log volume, gap and return since the event before, the price ten events before, place from the oldest, and number of events.
PREPARED = """SELECT *, CASE WHEN side = 0 THEN 1e0 ELSE -1e0 END AS sgn, ln(1 + volume) AS lv, (lag(seconds_before_predict) OVER w) - seconds_before_predict AS gap,
 price / (lag(price) OVER w) - 1 AS ret, lag(price, 10) OVER w AS price10, row_number() OVER w AS place, count(*) OVER (PARTITION BY sample_id) AS events,
 price - avg(price) OVER (PARTITION BY sample_id) AS dev, price - avg(CASE WHEN seconds_before_predict <= 15 THEN price END) OVER (PARTITION BY sample_id) AS dev15 FROM {events} """ + _W


def at(agg: str, cond: str) -> str:
    return f"{agg} FILTER (WHERE {cond})"


def zero(x: str) -> str:
    return f"coalesce({x}, 0e0)"


def share(x: str, y: str) -> str:
    return f"({x}) / (({y}) + 1e-8)"


OLD, NEW = "2 * place <= events", "2 * place > events"
OLD3, NEW3 = "3 * place <= events", "3 * place > 2 * events"


def skew(dev: str, cond: str = "true") -> str:
    return f"{at(f'avg({dev} * {dev} * {dev})', cond)} / nullif(pow(sqrt({at(f'avg({dev} * {dev})', cond)}), 3), 0e0)"


def weighted(p: str, what: dict[str, str]) -> dict[str, str]:
    return {f"{p}_{k}_weighted_{w}": f"sum(exp(-seconds_before_predict / {w}e0) * {v})" for w in WEIGHTS for k, v in what.items()}


def within(w: int) -> str:
    return f"seconds_before_predict <= {w}"


def _trades() -> dict[str, str]:
    f = {
        "t_vol_sum": "sum(volume)", "t_sv_sum": "sum(sgn * volume)", "t_sd_sum": "sum(sgn * price * volume)", "t_lv_mean": "avg(lv)", "t_px_std": "stddev_samp(price)",
        "t_buy_ratio": "avg(CASE WHEN sgn > 0 THEN 1e0 ELSE 0e0 END)", "t_vwap": share("sum(price * volume)", "sum(volume)"),
        "t_price_momentum_10": "max_by(price / price10 - 1, place)", "t_price_volatility": "stddev_samp(ret)", "t_price_range_ratio": share("max(price) - min(price)", "avg(price)"),
        "t_avg_signed_vol": "avg(sgn * volume / (volume + 1e-8))", "t_px_skew": skew("dev"),
        "t_buy_sell_vol_ratio": share(zero(at("sum(volume)", "side = 0")), zero(at("sum(volume)", "side = 1"))),
        **{f"t_large_{n}_{q}": at("count(*)", f"side = {s} AND volume > q{q}") for q in (90, 95) for n, s in (("buy", 0), ("sell", 1))},
        **weighted("t", {"vol": "volume", "sv": "sgn * volume", "price": "price", "value": "volume * price"}),
        "t_avg_time_gap": "avg(gap)", "t_time_gap_std": "stddev_samp(gap)", "t_max_time_gap": "max(gap)", "t_time_range": "max(seconds_before_predict) - min(seconds_before_predict)",
        "t_transaction_count": "count(*)", "t_transaction_rate": "count(*) / 60e0",
        "t_price_old_vs_new": f"{share(at('avg(price)', OLD), at('avg(price)', NEW))} - 1", "t_sign_old_vs_new": f"{at('avg(sgn)', OLD)} - {at('avg(sgn)', NEW)}",
        "t_vol_old_vs_new_third": share(zero(at("sum(volume)", OLD3)), zero(at("sum(volume)", NEW3))), "t_price_change": "max_by(price, place) - min_by(price, place)",
        "t_gap_old_vs_new": share(at("avg(gap)", OLD), at("avg(gap)", NEW))}
    for w in WINDOWS:
        c = within(w)
        f |= {f"t_vol_{w}": zero(at("sum(volume)", c)), f"t_sv_{w}": zero(at("sum(sgn * volume)", c)), f"t_sd_{w}": zero(at("sum(sgn * price * volume)", c)), f"t_lv_mean_{w}": at("avg(lv)", c),
              f"t_buy_ratio_{w}": at("avg(CASE WHEN sgn > 0 THEN 1e0 ELSE 0e0 END)", c), f"t_n_{w}": at("count(*)", c), f"t_px_std_{w}": at("stddev_samp(price)", c),
              f"t_avg_signed_vol_{w}": at("avg(sgn * volume / (volume + 1e-8))", c)}
    c = within(15)
    return f | {"t_px_skew_15": skew("dev15", c), "t_price_range_ratio_15": share(f"{at('max(price)', c)} - {at('min(price)', c)}", at("avg(price)", c))}


def _orders() -> dict[str, str]:
    add, cancel = "CASE WHEN order_action = 0 THEN 1e0 ELSE 0e0 END", "CASE WHEN order_action = 1 THEN 1e0 ELSE 0e0 END"
    f = {
        "o_vol_sum": "sum(volume)", "o_sv_sum": "sum(sgn * volume)", "o_av_sum": "sum(volume * (1 - 2 * order_action))", "o_buy_ratio": "avg(CASE WHEN sgn > 0 THEN 1e0 ELSE 0e0 END)",
        "o_add_ratio": f"avg({add})", "o_cancel_ratio": f"avg({cancel})", "o_px_std": "stddev_samp(price)", "o_px_skew": skew("dev"),
        "o_bid_depth": zero(at("sum(volume)", "side = 0")), "o_ask_depth": zero(at("sum(volume)", "side = 1")),
        **weighted("o", {"vol": "volume", "sv": "sgn * volume", "av": "volume * (1 - 2 * order_action)", "cancel": f"({cancel})"}),
        "o_avg_time_gap": "avg(gap)", "o_time_gap_std": "stddev_samp(gap)", "o_order_count": "count(*)", "o_order_rate": "count(*) / 60e0",
        "o_price_old_vs_new": f"{share(at('avg(price)', OLD), at('avg(price)', NEW))} - 1", "o_vol_old_vs_new_third": share(zero(at("sum(volume)", OLD3)), zero(at("sum(volume)", NEW3))),
        "o_cancel_old_vs_new": f"{at(f'avg({cancel})', OLD)} - {at(f'avg({cancel})', NEW)}"}
    for w in WINDOWS:
        c = within(w)
        f |= {f"o_vol_{w}": zero(at("sum(volume)", c)), f"o_sv_{w}": zero(at("sum(sgn * volume)", c)), f"o_av_{w}": zero(at("sum(volume * (1 - 2 * order_action))", c)), f"o_n_{w}": at("count(*)", c),
              f"o_buy_ratio_{w}": at("avg(CASE WHEN sgn > 0 THEN 1e0 ELSE 0e0 END)", c), f"o_add_ratio_{w}": at(f"avg({add})", c), f"o_cancel_ratio_{w}": at(f"avg({cancel})", c)}
    return f


#: Quotes with mid, spread, slopes, imbalance, their steps, and rolling means of the absolute return over full windows of 5 and 20 quotes.
QUOTES = f"""SELECT *, CASE WHEN count(ra) OVER r5 = 5 THEN avg(ra) OVER r5 END AS vol5, CASE WHEN count(ra) OVER r20 = 20 THEN avg(ra) OVER r20 END AS vol20 FROM (
 SELECT *, coalesce(mid - lag(mid) OVER w, 0e0) AS dmid, coalesce(ask_volume_1 - lag(ask_volume_1) OVER w, 0e0) - coalesce(bid_volume_1 - lag(bid_volume_1) OVER w, 0e0) AS ofi,
  abs(mid / (lag(mid) OVER w) - 1) AS ra, mid - avg(mid) OVER (PARTITION BY sample_id) AS dev, row_number() OVER w AS place FROM (
  SELECT *, (ask_price_1 + bid_price_1) / 2 AS mid, ask_price_1 - bid_price_1 AS sp, (ask_price_1 - bid_price_1) / ((ask_price_1 + bid_price_1) / 2 + 1e-8) AS rel,
   (ask_price_2 - ask_price_1) / (ask_volume_2 - ask_volume_1 + 1e-8) / 1e6 AS ask_slope, (bid_price_1 - bid_price_2) / (bid_volume_1 - bid_volume_2 + 1e-8) / 1e6 AS bid_slope,
   (ask_volume_1 - bid_volume_1) / (ask_volume_1 + bid_volume_1 + 1) AS imb FROM {{events}}) a {_W}) b
 WINDOW r5 AS (PARTITION BY sample_id ORDER BY place ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), r20 AS (PARTITION BY sample_id ORDER BY place ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""


def _quotes() -> dict[str, str]:
    f = {
        "m_mid_last": "max_by(mid, place)", "m_mid_mean": "avg(mid)", "m_mid_std": "stddev_samp(mid)", "m_mid_range": "max(mid) - min(mid)", "m_sp_last": "max_by(sp, place)", "m_sp_mean": "avg(sp)",
        "m_imb_last": "max_by(imb, place)", "m_imb_mean": "avg(imb)", "m_imb_std": "stddev_samp(imb)", "m_rv": "sqrt(sum(dmid * dmid))", "m_ofi_sum": "sum(ofi)", "m_ask_slope_mean": "avg(ask_slope)",
        "m_bid_slope_mean": "avg(bid_slope)", "m_mid_skew": skew("dev"),
        **{f"m_{k}_weighted_{w}": f"sum(exp(-seconds_before_predict / {w}e0) * {v})" for w in (60, 300) for k, v in (("mid", "mid"), ("imb", "imb"), ("ofi", "ofi"), ("vol", "transaction_volume"))},
        "m_vol_short": "avg(vol5)", "m_vol_long": "avg(vol20)", "m_vol_short_long_ratio": share("avg(vol5)", "avg(vol20)")}
    for w in (60, 180):
        c = within(w)
        f |= {f"m_mid_mean_{w}": at("avg(mid)", c), f"m_mid_std_{w}": at("stddev_samp(mid)", c), f"m_sp_mean_{w}": at("avg(sp)", c), f"m_imb_mean_{w}": at("avg(imb)", c), f"m_rv_{w}": f"sqrt({zero(at('sum(dmid * dmid)', c))})",
              f"m_ofi_sum_{w}": zero(at("sum(ofi)", c)), f"m_txv_sum_{w}": zero(at("sum(transaction_volume)", c)), f"m_spread_ratio_{w}": at("avg(rel)", c)}
    f["m_mid_range_60"] = f"{at('max(mid)', within(60))} - {at('min(mid)', within(60))}"
    e = "exp(-seconds_before_predict / 120e0)"
    return f | {f"m_{k}_ewm_120": share(f"sum({e} * {v})", f"sum({e})") for k, v in (("mid", "mid"), ("imb", "imb"), ("ofi", "ofi"), ("spread", "rel"))}


#: One row for every sample with events and every second 0..60: volumes, counts and mean price; empty seconds have zeros and no price.
SECONDS = """SELECT s.sample_id, s.g, coalesce(v, 0e0) AS v, coalesce(new_v, 0e0) AS new_v, coalesce(cancel_v, 0e0) AS cancel_v, coalesce(n_new, 0) AS n_new, coalesce(n_cancel, 0) AS n_cancel, coalesce(n, 0) AS n, price, avg(coalesce(v, 0e0)) OVER (PARTITION BY s.sample_id) AS m,
  lag(coalesce(v, 0e0), 1) OVER w AS v1, lag(coalesce(v, 0e0), 5) OVER w AS v5 FROM {grid} s LEFT JOIN (
 SELECT sample_id, CAST(floor(seconds_before_predict) AS INT) AS g, sum(volume) AS v, coalesce(sum(volume) FILTER (WHERE kind = 0), 0e0) AS new_v, coalesce(sum(volume) FILTER (WHERE kind = 1), 0e0) AS cancel_v, count(*) FILTER (WHERE kind = 0) AS n_new,
  count(*) FILTER (WHERE kind = 1) AS n_cancel, count(*) AS n, avg(price) AS price FROM {events} WHERE seconds_before_predict BETWEEN 0 AND 60 GROUP BY 1, 2) x ON x.sample_id = s.sample_id AND x.g = s.g
 WINDOW w AS (PARTITION BY s.sample_id ORDER BY s.g DESC)"""


def _seconds(p: str, a: str, b: str) -> dict[str, str]:
    """Per-second statistics; a and b name the two kinds of events (new and cancel, buy and sell)."""
    auto = lambda c: f"sum((v - m) * ({c} - m)) / nullif(sum((v - m) * (v - m)), 0e0)"
    f = {
        f"{p}_vol_sum": "sum(v)", f"{p}_vol_mean": "avg(v)", f"{p}_vol_std": "stddev_samp(v)", f"{p}_vol_max": "max(v)", f"{p}_price_mean": "avg(price)", f"{p}_price_std": "stddev_samp(price)",
        f"{p}_has_data_ratio": "avg(CASE WHEN n > 0 THEN 1e0 ELSE 0e0 END)", f"{p}_total_row_count": "CAST(sum(n) AS BIGINT)", f"{p}_{a}_count": "CAST(sum(n_new) AS BIGINT)", f"{p}_{b}_count": "CAST(sum(n_cancel) AS BIGINT)",
        f"{p}_{b}_{a}_ratio": share("sum(n_cancel)", "sum(n_new)"), f"{p}_{b}_{a}_vol_ratio": share("sum(cancel_v)", "sum(new_v)"), f"{p}_price_trend": "regr_slope(price, CAST(-g AS DOUBLE))", f"{p}_autocov_1": auto("v1"), f"{p}_autocov_5": auto("v5"),
        f"{p}_vol_weighted": "sum(exp(-g / 15e0) * v) / sum(exp(-g / 15e0))"}
    for w in (15, 30):
        f |= {f"{p}_vol_near_far_ratio_{w}": share(at("sum(v)", f"g < {w}"), at("sum(v)", f"g >= {w}")), f"{p}_price_near_far_diff_{w}": f"{at('avg(price)', f'g < {w}')} - {at('avg(price)', f'g >= {w}')}",
              f"{p}_{b}_near_far_ratio_{w}": share(at("sum(n_cancel)", f"g < {w}"), at("sum(n_cancel)", f"g >= {w}")), f"{p}_vol_{w}": at("sum(v)", f"g < {w}"), f"{p}_busy_{w}": at("count(*)", f"g < {w} AND n > 0")}
    return f


TRADES, ORDERS, MARKET = _trades(), _orders(), _quotes()
TRADE_SECONDS, ORDER_SECONDS = _seconds("t_sec", "buy", "sell"), _seconds("o_sec", "new", "cancel")

#: Projections over the joined families.
CROSS = {
    "x_sp_imb": "m_sp_mean * m_imb_mean", "x_o_signed_ratio": "o_sv_sum / (o_vol_sum + 1)", "x_ofi_ewm_short_long": "m_ofi_ewm_120 - m_ofi_weighted_60", "x_imb_ewm_short_long": "m_imb_ewm_120 - m_imb_weighted_60",
    "x_t_signed_ratio_15": "t_sv_15 / (t_vol_15 + 1)", "x_rv_60_over_full": share("m_rv_60", "m_rv"), "x_trans_order_vol_ratio": share("t_vol_sum", "o_vol_sum"), "x_vwap_mid_ratio": share("t_vwap - m_mid_last", "m_mid_last"),
    "x_rv_60_180_ratio": share("m_rv_60", "m_rv_180"), "x_trans_order_buy_diff": "t_buy_ratio - o_buy_ratio", "x_large_trade_imbalance": "(t_large_buy_90 - t_large_sell_90) / greatest(t_n_15, 1)",
    "x_slope_imbalance": "m_bid_slope_mean - m_ask_slope_mean", "x_trans_order_buy_diff_15": "t_buy_ratio_15 - o_buy_ratio_15", "x_t_vol_15_45_ratio": share("t_vol_15", "t_vol_45 + 1"),
    "x_sharpe_like": share("t_price_momentum_10", "t_price_volatility"), "x_mid_zscore": share("m_mid_last - m_mid_mean", "m_mid_std"),
    **{f"x_{s}_vol_weight_ratio_{w}": f"{s}_vol_weighted_{w} / ({s}_vol_{w} + 1)" for s in "to" for w in (15, 30)},
    **{f"x_t_price_trend_{w}": f"t_sec_price_near_far_diff_{w}" for w in (15, 30)}, **{f"x_t_vol_trend_{w}": f"t_sec_vol_{w} / (t_sec_vol_sum + 1)" for w in (15, 30)}, "x_o_cancel_trend_15": "o_sec_cancel_near_far_ratio_15 - 1",
    "x_tx_order_rate_ratio": share("t_transaction_rate", "o_order_rate"), "x_tx_order_count_ratio": share("t_transaction_count", "o_order_count"), "x_t_gap_stability": share("t_time_gap_std", "t_avg_time_gap"),
    "x_o_gap_stability": share("o_time_gap_std", "o_avg_time_gap"), "x_m_mid_long_short_diff": "m_mid_weighted_60 - m_mid_weighted_300", "x_m_vol_long_short_ratio": share("m_vol_weighted_60", "m_vol_weighted_300"),
    "x_m_ofi_long_short_diff": "m_ofi_weighted_60 - m_ofi_weighted_300", "x_m_vol_regime_change": "m_vol_short_long_ratio - 1", **{f"x_{s}_signed_weighted_{w}": share(f"{s}_sv_weighted_{w}", f"{s}_vol_weighted_{w}") for s in "to" for w in (15, 30)},
    **{f"x_{s}_signed_weight_diff_15": f"{share(f'{s}_sv_weighted_15', f'{s}_vol_weighted_15')} - {share(f'{s}_sv_15', f'{s}_vol_15 + 1')}" for s in "to"}, "x_m_imb_trend": "m_imb_weighted_60 - m_imb_weighted_300",
    "x_sec_trans_order_vol_ratio": share("t_sec_vol_sum", "o_sec_vol_sum"), "x_sec_price_mid_diff": "t_sec_price_mean - m_mid_mean", "x_sec_has_data_imb": "t_sec_has_data_ratio * m_imb_mean", "x_sec_cancel_spread": "o_sec_cancel_new_ratio * m_sp_mean",
    "x_sec_tx_order_data_ratio_diff": "t_sec_has_data_ratio - o_sec_has_data_ratio", "x_sec_t_empty_ratio": "1 - t_sec_has_data_ratio", "x_sec_o_empty_ratio": "1 - o_sec_has_data_ratio",
    "x_sec_price_trend_normalized": share("t_sec_price_trend", "t_sec_price_std"), "x_sec_price_trend_acceleration": "t_sec_price_near_far_diff_15 - t_sec_price_near_far_diff_30", "x_sec_tx_order_activity_ratio": share("t_sec_total_row_count", "o_sec_total_row_count")}
#: Columns that the assembled stack leaves out, as others say the same.
DROPPED = ("t_transaction_rate", "o_order_rate", "x_sec_t_empty_ratio", "x_sec_o_empty_ratio")


#: The mean gap needs no order: the gaps between the oldest and the newest event add up to their distance.
UNORDERED = {"avg(gap)": "(max(seconds_before_predict) - min(seconds_before_predict)) / nullif(count(seconds_before_predict) - 1, 0)"}
_NUMBERED = re.compile(r"\b(gap|ret|price10|place|events|dev|dev15)\b")


def _family(prepared: DataFrame, features: dict[str, str]) -> DataFrame:
    return prepared.groupBy("sample_id").agg(*[F.expr(e).alias(n) for n, e in features.items()])


def _names(text: str) -> set[str]:
    return set(re.findall(r"[A-Za-z_]\w*", text))


def _kept(features: dict[str, str], keep) -> dict[str, str]:
    return features if keep is None else {n: e for n, e in features.items() if n in keep}


def _events(rows: DataFrame, features: dict[str, str]) -> DataFrame:
    """A family of trades or orders; one without features of the order of events needs neither sort nor shuffled rows."""
    plain = {n: UNORDERED.get(e, e) for n, e in features.items()}
    if any(_NUMBERED.search(e) for e in plain.values()):
        return _family(rows.sparkSession.sql(PREPARED.format(events="{events}"), events=rows), features)
    return _family(rows.withColumns({"sgn": F.when(F.col("side") == 0, 1.0).otherwise(-1.0), "lv": F.ln(1 + F.col("volume"))}), plain)


def trades(trade: DataFrame, keep=None) -> DataFrame:
    f = _kept(TRADES, keep)
    if any(_names(e) & {"q90", "q95"} for e in f.values()):
        trade = trade.join(F.broadcast(quantiles(trade, {"q90": ("volume", 0.9), "q95": ("volume", 0.95)})))
    return _events(trade, f)


def orders(order: DataFrame, keep=None) -> DataFrame:
    return _events(order, _kept(ORDERS, keep))


def quotes(market: DataFrame, keep=None) -> DataFrame:
    return _family(market.sparkSession.sql(QUOTES.format(events="{events}"), events=market.where("ask_price_1 > 0")), _kept(MARKET, keep))


def seconds(events: DataFrame, kind: str, features: dict[str, str]) -> DataFrame:
    """Whole-second statistics of a stream; `kind` names the column that tells the two kinds of events apart."""
    e = events.where(X.within(upto=60)).withColumn("kind", F.col(kind))
    grid = e.select("sample_id").distinct().withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(60))))
    return _family(events.sparkSession.sql(SECONDS, events=e, grid=grid), features)


def stack(market: DataFrame, order: DataFrame, trade: DataFrame, keep=None) -> DataFrame:
    """All families and what is formed across them, one row a sample with trades, without the dropped columns.  Each family has a row a sample, so no row comes twice.  With `keep` (names of columns)
    only the families and features that these columns need are built.  Of `seq` only its order counts."""
    cross = {n: e for n, e in CROSS.items() if (keep is None or n in keep) and n not in DROPPED}
    need = None if keep is None else set(keep).union(*map(_names, cross.values()))
    t = trades(trade, need)
    if need is None or need & set(ORDERS):
        t = t.join(orders(order, need), "sample_id", "left")
    for rows, kind, features in ((trade, "side", TRADE_SECONDS), (order, "order_action", ORDER_SECONDS)):
        if _kept(features, need):
            t = t.join(seconds(rows, kind, _kept(features, need)), "sample_id", "left")
    if need is None or need & set(MARKET):
        t = t.join(quotes(market, need), "sample_id", "left")
    out = t.select("*", *[F.expr(e).alias(n) for n, e in cross.items()]).drop(*DROPPED)
    out = out.fillna(0, [c for c, kind in out.dtypes if kind == "bigint" and c != "sample_id"])
    return out if keep is None else out.select("sample_id", *[c for c in keep if c != "sample_id"])
