"""Feature families: one wide row per sample_id.  Each is one grouped pass of conditional aggregates over its table; older-to-newer order is descending
seconds, ties by seq."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import exprs as X


def sec() -> Column:
    return F.col("seconds_before_predict")


def newest() -> Column:
    """Order key: later in time, then later in seq."""
    return F.struct(-sec(), F.col("seq"))


def path_window(by="sample_id"):
    return W.partitionBy(by).orderBy(F.desc("seconds_before_predict"), F.asc("seq"))


def onto_spine(label: DataFrame, *families: DataFrame, fill: float = 0.0) -> DataFrame:
    """Families left-joined onto the label spine; samples without rows get `fill`."""
    out = label
    for f in families:
        out = out.join(f, "sample_id", "left")
    kinds = dict(out.dtypes)
    return out.select(*[F.coalesce(F.col(c), F.lit(fill if kinds[c] == "double" else 0)).alias(c) if c not in label.columns and kinds[c] in ("double", "bigint", "int") else F.col(c) for c in out.columns])


def _flow_aggs(prefix: str, flow: Column, windows) -> list[Column]:
    out = []
    for w in windows:
        ok = X.within(upto=w)
        n, s = F.count_if(ok), F.sum(F.when(ok, flow))
        out += [(F.coalesce(s, F.lit(0.0)) / w).alias(f"{prefix}_signed_volume_per_second_{w}"), X.ratio(F.coalesce(s, F.lit(0.0)), n).alias(f"{prefix}_signed_volume_per_event_{w}"), (n / w).alias(f"{prefix}_event_count_per_second_{w}")]
    return out


def event_flow(order: DataFrame, trade: DataFrame, label: DataFrame, windows=(5, 15, 30, 60)) -> DataFrame:
    """Signed flow per second and per event, and event counts per second, of orders and trades."""
    keep = X.within(upto=max(windows))
    o = order.where(keep).groupBy("sample_id").agg(*_flow_aggs("order", X.signed_order_flow(), windows))
    t = trade.where(keep).groupBy("sample_id").agg(*_flow_aggs("trade", X.signed_trade_flow(), windows))
    return onto_spine(label, o, t)


def official_market(market: DataFrame, windows=(15, 60, 180), taus=(30, 120)) -> DataFrame:
    """Level, dispersion, imbalance, realised volatility and flow of the quotes, whole, by window and exponentially weighted."""
    m = market.select("sample_id", "seq", "seconds_before_predict", "transaction_volume", ((F.col("ask_price_1") + F.col("bid_price_1")) * 0.5).alias("mid"), (F.col("ask_price_1") - F.col("bid_price_1")).alias("sp"), X.imbalance(F.col("ask_volume_1"), F.col("bid_volume_1")).alias("imb"), (F.col("ask_volume_1") + F.col("bid_volume_1")).alias("depth"), (F.col("ask_volume_1") - F.col("bid_volume_1")).alias("gap"))
    w = path_window()
    m = m.withColumn("dmid", F.coalesce(F.col("mid") - F.lag("mid").over(w), F.lit(0.0))).withColumn("ofi", F.coalesce(F.col("gap") - F.lag("gap").over(w), F.lit(0.0)))
    last = lambda c: F.max_by(c, newest())
    aggs = [last("mid").alias("m_mid_last"), F.avg("mid").alias("m_mid_mean"), F.stddev_samp("mid").alias("m_mid_std"), (F.max("mid") - F.min("mid")).alias("m_mid_range"), last("sp").alias("m_sp_last"), F.avg("sp").alias("m_sp_mean"), last("imb").alias("m_imb_last"), F.avg("imb").alias("m_imb_mean"), F.stddev_samp("imb").alias("m_imb_std"), F.avg("depth").alias("m_depth_mean"), F.sqrt(F.sum(F.col("dmid") * F.col("dmid"))).alias("m_rv"), F.sum("ofi").alias("m_ofi_sum")]
    for n in windows:
        at = lambda c, n=n: F.when(sec() <= n, F.col(c))
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        aggs += [F.avg(at("mid")).alias(f"m_mid_mean_{n}"), F.stddev_samp(at("mid")).alias(f"m_mid_std_{n}"), F.avg(at("sp")).alias(f"m_sp_mean_{n}"), F.avg(at("imb")).alias(f"m_imb_mean_{n}"), F.sqrt(zero(F.sum(at("dmid") * at("dmid")))).alias(f"m_rv_{n}"), zero(F.sum(at("ofi"))).alias(f"m_ofi_sum_{n}"), zero(F.sum(at("transaction_volume"))).alias(f"m_txv_sum_{n}")]
    for tau in taus:
        weight = F.exp(sec() * (-1.0 / tau))
        aggs += [(F.sum(weight * F.col(c)) / (F.sum(weight) + 1e-8)).alias(f"m_{c}_ewm_{tau}") for c in ("mid", "imb", "ofi")]
    return m.groupBy("sample_id").agg(*aggs)


def official_trade(trade: DataFrame, windows=(15, 45, 120)) -> DataFrame:
    t = trade.withColumn("sgn", X.sign("side")).withColumn("lv", F.log1p("volume")).withColumn("sv", F.col("sgn") * F.col("volume")).withColumn("sd", F.col("sgn") * F.col("price") * F.col("volume"))
    buy = F.when(F.col("sgn") > 0, 1.0).otherwise(0.0)
    aggs = [F.sum("volume").alias("t_vol_sum"), F.sum("sv").alias("t_sv_sum"), F.sum("sd").alias("t_sd_sum"), F.avg("lv").alias("t_lv_mean"), F.stddev_samp("price").alias("t_px_std"), F.max_by("price", newest()).alias("t_px_last"), F.avg(buy).alias("t_buy_ratio")]
    for n in windows:
        at = lambda c, n=n: F.when(sec() <= n, c)
        aggs += [F.coalesce(F.sum(at(F.col(c))), F.lit(0.0)).alias(f"t_{k}_{n}") for c, k in (("volume", "vol"), ("sv", "sv"), ("sd", "sd"))]
        aggs += [F.avg(at(F.col("lv"))).alias(f"t_lv_mean_{n}"), F.avg(at(buy)).alias(f"t_buy_ratio_{n}"), F.count_if(sec() <= n).alias(f"t_n_{n}")]
    return t.groupBy("sample_id").agg(*aggs)


def official_order(order: DataFrame, windows=(15, 45, 120)) -> DataFrame:
    o = order.withColumn("sgn", X.sign("side")).withColumn("act", X.sign("order_action")).withColumn("sv", F.col("sgn") * F.col("volume")).withColumn("av", F.col("act") * F.col("volume"))
    up = lambda c: F.when(F.col(c) > 0, 1.0).otherwise(0.0)
    aggs = [F.sum("volume").alias("o_vol_sum"), F.sum("sv").alias("o_sv_sum"), F.sum("av").alias("o_av_sum"), F.avg(up("sgn")).alias("o_buy_ratio"), F.avg(up("act")).alias("o_add_ratio"), F.stddev_samp("price").alias("o_px_std")]
    for n in windows:
        at = lambda c, n=n: F.when(sec() <= n, c)
        aggs += [F.coalesce(F.sum(at(F.col(c))), F.lit(0.0)).alias(f"o_{c}_{n}") for c in ("sv", "av")]
        aggs += [F.avg(at(up("sgn"))).alias(f"o_buy_ratio_{n}"), F.count_if(sec() <= n).alias(f"o_n_{n}")]
    return o.groupBy("sample_id").agg(*aggs)


def cross_source(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumns({
        "x_sp_imb": c("m_sp_mean") * c("m_imb_mean"), "x_t_signed_ratio": c("t_sv_sum") / (c("t_vol_sum") + 1.0), "x_o_signed_ratio": c("o_sv_sum") / (c("o_vol_sum") + 1.0),
        "x_vwap_vs_mid": c("t_sd_sum") / (c("t_vol_sum") + 1.0) - c("m_mid_last"), "x_ofi_ewm_short_long": c("m_ofi_ewm_30") - c("m_ofi_ewm_120"),
        "x_imb_ewm_short_long": c("m_imb_ewm_30") - c("m_imb_ewm_120"), "x_t_signed_ratio_15": c("t_sv_15") / (c("t_vol_15") + 1.0), "x_rv_15_over_full": c("m_rv_15") / (c("m_rv") + 1e-8)})


def assembled(market: DataFrame, order: DataFrame, trade: DataFrame, label: DataFrame) -> DataFrame:
    """The wide table: market, trade and order families with their cross terms, for labelled samples."""
    wide = official_market(market).join(official_trade(trade), "sample_id", "left").join(official_order(order), "sample_id", "left")
    return label.join(cross_source(wide), "sample_id")


def quote_ofi(level: int, w, convention: str = "queue") -> Column:
    """Order-flow imbalance of one book level between a quote and the one before; 0 for the first.  `cont` flips the ask side's moves."""
    bp, bv, ap, av = (F.col(f"{s}_{k}_{level}") for s in ("bid", "ask") for k in ("price", "volume"))
    pbp, pbv, pap, pav = (F.lag(x).over(w) for x in (bp, bv, ap, av))
    bid = F.when(bp > pbp, bv).when(bp < pbp, -pbv).otherwise(bv - pbv)
    sgn = 1.0 if convention == "queue" else -1.0
    ask = F.when(ap < pap, av * sgn).when(ap > pap, -pav * sgn).otherwise(-(av - pav))
    return F.when(pbp.isNull(), 0.0).otherwise(bid + ask)


def full_ofi(order: DataFrame, trade: DataFrame, market: DataFrame, label: DataFrame, windows=(5, 15, 30, 60)) -> DataFrame:
    """Event, trade and quote flow rates by window, normalised by depth and volume, with fast-slow contrasts and agreements."""
    top = max(windows)
    pick = lambda c, w: F.coalesce(F.sum(F.when(X.within(upto=w), c)), F.lit(0.0))
    o = order.where(X.within(upto=top)).groupBy("sample_id").agg(*[x for w in windows for x in (pick(X.signed_order_flow(), w).alias(f"of_{w}"), pick(F.col("volume"), w).alias(f"ov_{w}"), F.count_if(X.within(upto=w)).alias(f"on_{w}"))])
    t = trade.where(X.within(upto=top)).groupBy("sample_id").agg(*[x for w in windows for x in (pick(X.signed_trade_flow(), w).alias(f"tf_{w}"), pick(F.col("volume"), w).alias(f"tv_{w}"), F.count_if(X.within(upto=w)).alias(f"tn_{w}"))])
    p = path_window()
    q = market.select("sample_id", "seconds_before_predict", quote_ofi(1, p).alias("q1"), quote_ofi(2, p).alias("q2"), X.depth4().alias("d")).where(X.within(upto=top))
    m = q.groupBy("sample_id").agg(*[x for w in windows for x in (pick(F.col("q1"), w).alias(f"q1_{w}"), pick(F.col("q2"), w).alias(f"q2_{w}"), F.coalesce(F.avg(F.when(X.within(upto=w), F.col("d"))), F.lit(0.0)).alias(f"d_{w}"))])
    df = onto_spine(label, o, t, m)
    c, out = F.col, {}
    for w in windows:
        out |= {f"ofi_event_rate_{w}": c(f"of_{w}") / w, f"trade_flow_rate_{w}": c(f"tf_{w}") / w, f"ofi_event_count_rate_{w}": c(f"on_{w}") / w, f"trade_event_count_rate_{w}": c(f"tn_{w}") / w}
        out |= {f"ofi_depth_{w}": X.ratio(c(f"of_{w}"), F.abs(c(f"d_{w}"))), f"ofi_volume_{w}": X.ratio(c(f"of_{w}"), c(f"ov_{w}")), f"ofi_trade_volume_{w}": X.ratio(c(f"of_{w}"), c(f"tv_{w}"))}
        for n in (1, 2):
            out |= {f"quote_ofi_l{n}_rate_{w}": c(f"q{n}_{w}") / w, f"quote_ofi_l{n}_depth_{w}": X.ratio(c(f"q{n}_{w}"), F.abs(c(f"d_{w}")))}
    df = df.select(*label.columns, *[v.alias(k) for k, v in out.items()])
    more = {}
    for name in ("ofi_event_rate", "trade_flow_rate", "quote_ofi_l1", "quote_ofi_l2"):
        rate = (lambda w, name=name: c(f"{name}_rate_{w}" if name.startswith("quote") else f"{name}_{w}"))
        for a, b in ((5, 15), (15, 30), (30, 60)):
            more[f"{name}_fast_slow_{a}_{b}"] = rate(a) - rate(b)
        if not name.startswith("quote"):
            more[f"{name}_acceleration"] = (rate(5) - rate(15)) - (rate(15) - rate(30))
    more |= {"order_trade_gap_15": c("ofi_event_rate_15") - c("trade_flow_rate_15"), "order_trade_agreement_15": c("ofi_event_rate_15") * c("trade_flow_rate_15")}
    more |= {f"quote_trade_agreement_l{n}_15": c(f"quote_ofi_l{n}_rate_15") * c("trade_flow_rate_15") for n in (1, 2)}
    return df.withColumns(more)


def lob_geometry(market: DataFrame) -> DataFrame:
    """Shape of each sample's latest quote: shares, gaps, slopes, entropy; an unusable quote gives zeros and lob_quote_missing = 1."""
    last = market.groupBy("sample_id").agg(F.max_by(F.struct("seconds_before_predict", *X.LEVELS), newest()).alias("q")).select("sample_id", "q.*")
    b1, a1, b2, a2, bv1, av1, bv2, av2 = (F.col(c) for c in X.LEVELS)
    floor = lambda v: F.greatest(v, F.lit(1e-12))
    spread, total = floor(a1 - b1), floor(bv1 + av1 + bv2 + av2)
    share = [v / total for v in (bv1, av1, bv2, av2)]
    raw = {
        "lob_l1_depth_share": (bv1 + av1) / total, "lob_bid_l1_l2_gap": (b1 - b2) / spread, "lob_ask_l1_l2_gap": (a2 - a1) / spread,
        "lob_bid2_rel_mid_spread": (b2 - X.mid()) / spread, "lob_ask2_rel_mid_spread": (a2 - X.mid()) / spread,
        "lob_bid1_depth_share": share[0], "lob_ask1_depth_share": share[1], "lob_bid2_depth_share": share[2], "lob_ask2_depth_share": share[3],
        "lob_bid_depth_share": (bv1 + bv2) / total, "lob_ask_depth_share": (av1 + av2) / total, "lob_near_far_bid": bv1 / floor(bv2), "lob_near_far_ask": av1 / floor(av2),
        "lob_depth_slope_bid": bv2 - bv1, "lob_depth_slope_ask": av2 - av1, "lob_depth_entropy": -sum((F.when(p > 0, p * F.ln(p)).otherwise(0.0) for p in share), F.lit(0.0)),
        "lob_depth_hhi": sum((p * p for p in share), F.lit(0.0)), "lob_shape_asymmetry": (bv1 + bv2 - av1 - av2) / total,
        "lob_slope_asymmetry": (bv2 - bv1) - (av2 - av1), "lob_l1_l2_volume_ratio": (bv1 + av1) / floor(bv2 + av2),
    }
    ok = X.valid_quote()
    return last.select("sample_id", *[F.when(ok, v).otherwise(0.0).alias(k) for k, v in raw.items()], F.when(ok, 0.0).otherwise(1.0).alias("lob_quote_missing"))


def interactions(geometry: DataFrame, flow: DataFrame, windows=(5, 15, 30, 60), eps: float = 1e-12) -> DataFrame:
    """24 products and contrasts of the book's shape with event pressure."""
    df = flow.join(geometry, "sample_id")
    c = F.col
    rel = lambda a, b: (a - b) / (F.abs(a) + F.abs(b) + eps)

    def triplet(x, y, z):
        hi, lo = F.greatest(x, y, z), F.least(x, y, z)
        middle = F.greatest(F.least(x, y), F.least(F.greatest(x, y), z))
        return (hi - middle) / (middle - lo + eps)

    b1, b2, a1, a2 = (c(f"lob_{k}_depth_share") for k in ("bid1", "bid2", "ask1", "ask2"))
    bg, ag, vr = c("lob_bid_l1_l2_gap"), c("lob_ask_l1_l2_gap"), c("lob_l1_l2_volume_ratio")
    i1, i2, ib = rel(b1, a1), rel(b2, a2), rel(c("lob_bid_depth_share"), c("lob_ask_depth_share"))
    proxy = F.greatest(bg + ag, F.lit(0.0))
    op = {w: F.asinh(c(f"order_signed_volume_per_event_{w}")) for w in windows}
    tp = {w: F.asinh(c(f"trade_signed_volume_per_event_{w}")) for w in windows}
    both = {w: F.greatest(c(f"order_event_count_per_second_{w}") + c(f"trade_event_count_per_second_{w}"), F.lit(0.0)) for w in windows}
    agree = F.tanh(op[5]) * F.tanh(tp[5])
    out = {"bid1_share_bid2_share_ask1_share": triplet(b1, b2, a1), "bid1_share_bid2_share_ask2_share": triplet(b1, b2, a2), "ask1_share_ask2_share_bid1_share": triplet(a1, a2, b1), "ask1_share_ask2_share_bid2_share": triplet(a1, a2, b2), "l1_imbalance_l2_imbalance_book_imbalance": triplet(i1, i2, ib), "bid_gap_ask_gap_l1_l2_volume_ratio": triplet(bg, ag, vr)}
    out = {f"triplet_imbalance_{k}": v for k, v in out.items()}
    out |= {f"urgency_relative_spread_{k}": v * proxy for k, v in (("l1_imbalance", i1), ("l2_imbalance", i2), ("book_imbalance", ib), ("order_pressure_5", op[5]), ("trade_pressure_5", tp[5]), ("order_trade_agreement_5", agree))}
    out |= {"depth_pressure_l1_imbalance_bid_gap": i1 * bg, "depth_pressure_l2_imbalance_ask_gap": i2 * ag, "depth_pressure_book_imbalance_mean_gap": ib * (bg + ag) / 2, "depth_pressure_shape_asymmetry_book_imbalance": c("lob_shape_asymmetry") * ib}
    for w in windows:
        out |= {f"flow_combined_pressure_relative_spread_{w}": (op[w] + tp[w]) * proxy, f"flow_combined_pressure_log_event_intensity_{w}": (op[w] + tp[w]) * F.log1p(both[w])}
    return df.select("sample_id", "month", "target", *[v.alias(k) for k, v in out.items()])


def market_forms(market: DataFrame, windows=(5, 10, 15, 30, 60, 120, 180, 300, 600)) -> DataFrame:
    """Flow, imbalance, dispersion and last mid by window (seconds strictly below it), usable quotes only."""
    m = market.where("ask_price_1 > 0").select("sample_id", "seq", "seconds_before_predict", X.mid().alias("mid"), (F.col("bid_volume_1") - F.col("ask_volume_1")).alias("imb"))
    m = m.withColumn("step", F.coalesce(F.col("imb") - F.lag("imb").over(path_window()), F.lit(0.0)))
    aggs = []
    for w in windows:
        at = lambda c, w=w: F.when(sec() < w, F.col(c))
        aggs += [F.coalesce(F.sum(at("step")), F.lit(0.0)).alias(f"form_flow_{w}"), F.avg(at("imb")).alias(f"form_imb_{w}"), F.stddev_samp(at("mid")).alias(f"form_std_{w}"), F.max_by(at("mid"), F.when(sec() < w, newest())).alias(f"form_last_{w}")]
    return m.groupBy("sample_id").agg(*aggs)


#: Fixed replacements: column, its scale, and the offset of the denominator.
RELATIVE = {"m_sp_mean": ("m_mid_mean", 1e-8), "m_depth_mean": ("m_txv_sum_60", 1.0), "m_rv": ("m_mid_std", 1e-8), "o_vol_sum": ("t_vol_sum", 1.0), "o_n_120": ("t_n_120", 1.0), "m_txv_sum_180": ("m_txv_sum_60", 1.0), "m_sp_mean_60": ("m_mid_mean_60", 1e-8), "m_sp_mean_180": ("m_mid_mean_180", 1e-8)}


def relativised(df: DataFrame) -> DataFrame:
    """Eight columns replaced by their ratio to a scale column; all ratios read the original columns."""
    return df.withColumns({c: F.col(c).cast("double") / (F.col(s) + o) for c, (s, o) in RELATIVE.items()})
