"""Further families: micro-structure, enhanced windows, locally normalised windows, long-context segments, activity."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import exprs as X
from .families import newest, onto_spine, path_window, sec
from .metrics import correlation


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _stream(df: DataFrame) -> DataFrame:
    """Rows with signed volume, time to the row before, and the sample's 90th percentile of volume (one aggregate joined back)."""
    q = df.groupBy("sample_id").agg(F.percentile("volume", 0.9).alias("q90"))
    return df.withColumn("sv", X.signed_trade_flow()).withColumn("iat", F.abs(sec() - F.lag("seconds_before_predict").over(path_window()))).join(q, "sample_id")


def _share(cond: Column, what: str, of: Column | None = None) -> Column:
    base = of if of is not None else _zero(F.sum(F.when(cond, F.col("volume"))))
    return _zero(F.sum(F.when(cond, F.col(what)))) / (base + 1.0)


def micro_structure(market: DataFrame, order: DataFrame, trade: DataFrame, label: DataFrame) -> DataFrame:
    """22 features: add/cancel balance, arrival and burstiness, large events, micro-price and second-level imbalance."""
    add, cancel, big = F.col("order_action") == 0, F.col("order_action") == 1, F.col("volume") > F.col("q90")
    every = F.lit(True)
    o = _stream(order).withColumn("av", X.sign("order_action") * F.col("volume")).groupBy("sample_id").agg(
        _share(add, "sv").alias("o_add_imb"), _share(cancel, "sv").alias("o_cancel_imb"), _share(add, "volume", _zero(F.sum(F.when(cancel, F.col("volume"))))).alias("o_add_cancel_ratio"), _share(every, "av").alias("o_ofi_norm"),
        (F.count("iat") / 60).alias("o_arrival_rate"), F.log1p(F.avg("iat")).alias("o_iat_mean_log"), (F.stddev_samp("iat") / (F.avg("iat") + 1e-8)).alias("o_iat_cv"), (F.max("iat") / (F.percentile("iat", 0.5) + 1e-8)).alias("o_burst_ratio"),
        _share(big, "sv").alias("o_large_imb"), _share(big, "volume", F.sum("volume")).alias("o_large_share"))
    fast = sec() <= 5
    t = _stream(trade).groupBy("sample_id").agg(
        _share(every, "sv").alias("t_signed_norm"), (F.count("iat") / 60).alias("t_arrival_rate"), (F.stddev_samp("iat") / (F.avg("iat") + 1e-8)).alias("t_iat_cv"),
        _share(big, "sv").alias("t_large_imb"), _share(big, "volume", F.sum("volume")).alias("t_large_share"), (_share(fast, "sv") - _share(every, "sv")).alias("t_flow_fast_slow"))
    c = F.col
    sp, mid = c("ask_price_1") - c("bid_price_1"), X.mid()
    gap = ((c("ask_price_1") * c("bid_volume_1") + c("bid_price_1") * c("ask_volume_1")) / (c("ask_volume_1") + c("bid_volume_1") + 1.0) - mid) / (sp + 1e-8)
    m = market.where("ask_price_1 > 0").select("sample_id", "seq", "seconds_before_predict", sp.alias("sp"), mid.alias("mid"), gap.alias("gap"), X.imbalance(c("ask_volume_2"), c("bid_volume_2")).alias("imb2"))
    last = lambda v: F.max_by(v, newest())
    m = m.groupBy("sample_id").agg(last("gap").alias("m_micro_gap_last"), F.avg("gap").alias("m_micro_gap_mean"), (last("sp") / (last("mid") + 1e-8)).alias("m_sp_rel_last"), (F.avg("sp") / (F.avg("mid") + 1e-8)).alias("m_sp_rel_mean"), last("imb2").alias("m_imb2_last"), F.avg("imb2").alias("m_imb2_mean"))
    out = o.join(t, "sample_id", "full").join(m, "sample_id", "full")
    return label.join(out, "sample_id", "left")


def enhanced_windows(market: DataFrame, windows=(5, 30, 300)) -> DataFrame:
    """Volatility, flow and volume at further windows; shape, quartiles and return of the last minute; ratios to the whole."""
    c, w = F.col, path_window()
    m = market.select("sample_id", "seq", "seconds_before_predict", "transaction_volume", X.mid().alias("mid"), (c("ask_price_1") - c("bid_price_1")).alias("sp"), X.imbalance(c("ask_volume_1"), c("bid_volume_1")).alias("imb"), (c("ask_volume_1") - c("bid_volume_1")).alias("gap"))
    m = m.withColumn("dm", _zero(c("mid") - F.lag("mid").over(w))).withColumn("ofi", _zero(c("gap") - F.lag("gap").over(w)))
    at = lambda v, n: F.when(sec() <= n, c(v))
    m = m.withColumn("dev", F.round(at("mid", 60) - F.avg(at("mid", 60)).over(W.partitionBy("sample_id")), 9))
    moment = lambda k: F.avg(F.pow("dev", F.lit(float(k))))
    rv = lambda n: F.sqrt(_zero(F.sum(at("dm", n) * at("dm", n))))
    aggs = [x for n in windows for x in (rv(n).alias(f"m_rv_{n}"), _zero(F.sum(at("ofi", n))).alias(f"m_ofi_sum_{n}"), _zero(F.sum(at("transaction_volume", n))).alias(f"m_txv_sum_{n}"))]
    near = at("mid", 60)
    when = F.when(sec() <= 60, newest())
    aggs += [F.percentile(near, 0.25).alias("m_mid_p25_60"), F.percentile(near, 0.75).alias("m_mid_p75_60"), F.stddev_samp(at("sp", 60)).alias("m_sp_std_60"), (F.max(at("imb", 60)) - F.min(at("imb", 60))).alias("m_imb_range_60"), (F.max_by(near, when) - F.min_by(near, when)).alias("m_mid_ret_60")]
    aggs += [(_zero(F.sum(at("ofi", 5))) / (F.abs(F.sum(at("ofi", 600))) + 1e-8)).alias("x_ofi_5_over_full"), F.try_divide(rv(5), rv(600)).alias("x_rv_5_over_full"), F.try_divide(F.stddev_samp(near), F.stddev_samp(at("mid", 600))).alias("x_mid_std_60_over_full")]
    aggs += [F.try_divide(moment(3), F.pow(F.sqrt(moment(2)), F.lit(3.0))).alias("m_mid_skew_60"), (F.try_divide(moment(4), moment(2) * moment(2)) - 3.0).alias("m_mid_kurt_60")]
    return m.groupBy("sample_id").agg(*aggs)


def normalised_windows(market: DataFrame, order: DataFrame, trade: DataFrame, label: DataFrame, windows=(5, 15, 30, 60)) -> DataFrame:
    """37 features: seven z-scores a window against local volatility, depth and flow, six context logs, three missing flags.  Log-mid steps run between
    consecutive valid quotes."""
    ok = market.where(X.valid_quote(positive_mid=True))
    mid = X.mid()
    bv, av = F.col("bid_volume_1"), F.col("ask_volume_1")
    micro = F.when(bv + av > 0, ((F.col("ask_price_1") * bv + F.col("bid_price_1") * av) / (bv + av) - mid) / mid).otherwise(0.0)
    q = ok.select("sample_id", "seq", "seconds_before_predict", F.ln(mid).alias("lm"), ((F.col("ask_price_1") - F.col("bid_price_1")) / mid).alias("sr"), X.depth4().alias("d"), micro.alias("mg"))
    q = q.withColumn("step", F.col("lm") - F.lag("lm").over(path_window()))
    flow = lambda df, f: df.where(X.within(upto=max(windows))).withColumn("f", f)
    ev = {"order": flow(order, X.signed_order_flow()), "trade": flow(trade, X.signed_trade_flow())}
    m_aggs, e_aggs = [], {k: [] for k in ev}
    for w in windows:
        on = X.within(upto=w)
        at = lambda v, on=on: F.when(on, F.col(v))
        key = F.when(on, newest())
        m_aggs += [F.min_by(at("lm"), key).alias(f"lf_{w}"), F.max_by(at("lm"), key).alias(f"ll_{w}"), (F.max(at("lm")) - F.min(at("lm"))).alias(f"lr_{w}"), F.sqrt(F.avg(at("step") * at("step"))).alias(f"rms_{w}"), F.percentile(at("sr"), 0.5).alias(f"sm_{w}"), F.avg(at("sr")).alias(f"sa_{w}"), F.max_by(at("mg"), key).alias(f"mg_{w}"), F.min_by(at("d"), key).alias(f"df_{w}"), F.max_by(at("d"), key).alias(f"dl_{w}"), F.sqrt(F.avg(at("d") * at("d"))).alias(f"dr_{w}")]
        for k in ev:
            e_aggs[k] += [F.count_if(on).alias(f"{k}_n_{w}"), F.sum(at("f")).alias(f"{k}_f_{w}"), F.avg(at("volume") * at("volume")).alias(f"{k}_v_{w}")]
    m = q.where(X.within(upto=max(windows))).groupBy("sample_id").agg(*m_aggs)
    o, t = (ev[k].groupBy("sample_id").agg(*e_aggs[k]) for k in ("order", "trade"))
    df = onto_spine(label, m, o, t)
    c = F.col
    floor = lambda v: F.greatest(v, F.lit(1e-8))
    out = {}
    for w in windows:
        ps, ds = floor(F.greatest(c(f"rms_{w}"), c(f"sm_{w}"))), floor(c(f"dr_{w}"))
        out |= {f"mid_net_z_{w}": (c(f"ll_{w}") - c(f"lf_{w}")) / ps, f"mid_range_z_{w}": c(f"lr_{w}") / ps, f"spread_mean_z_{w}": c(f"sa_{w}") / ps, f"microgap_last_z_{w}": c(f"mg_{w}") / ps, f"depth_change_z_{w}": (c(f"dl_{w}") - c(f"df_{w}")) / ds}
        out |= {f"{k}_flow_z_{w}": c(f"{k}_f_{w}") / floor(F.sqrt(c(f"{k}_n_{w}") * c(f"{k}_v_{w}"))) for k in ("order", "trade")}
    out |= {"log_ret_sigma_60": F.ln(floor(c("rms_60"))), "log_depth_rms_60": F.ln(floor(c("dr_60"))), "log_order_volume_rms_60": F.ln(floor(F.sqrt("order_v_60"))), "log_trade_volume_rms_60": F.ln(floor(F.sqrt("trade_v_60"))), "log1p_order_event_rate_60": F.log1p(c("order_n_60") / 60), "log1p_trade_event_rate_60": F.log1p(c("trade_n_60") / 60)}
    out |= {"market_missing": F.when(c("dr_60") > 0, 0.0).otherwise(1.0), "order_missing": F.when(c("order_n_60") > 0, 0.0).otherwise(1.0), "trade_missing": F.when(c("trade_n_60") > 0, 0.0).otherwise(1.0)}
    return df.select(*label.columns, *[v.alias(f"revol_{k}") for k, v in out.items()])


SEGMENTS = ((300, 600), (120, 300), (60, 120), (0, 60))


def long_context(market: DataFrame, label: DataFrame, segments=SEGMENTS) -> DataFrame:
    """Four time segments: dispersion, spread, depth, volume, relative change (older to newer), mean step, lag-one correlation."""
    part = F.coalesce(*[F.when((sec() >= a) & (sec() < b), F.lit(i)) for i, (a, b) in enumerate(segments)])
    m = market.select("sample_id", "seq", "seconds_before_predict", "transaction_volume", X.mid().alias("mid"), (F.col("ask_price_1") - F.col("bid_price_1")).alias("sp"), (F.col("bid_volume_1") + F.col("ask_volume_1")).alias("depth"), part.alias("part")).where("part is not null")
    m = m.withColumn("was", F.lag("mid").over(W.partitionBy("sample_id", "part").orderBy(F.desc("seconds_before_predict"), "seq")))
    first, last = F.min_by("mid", newest()), F.max_by("mid", newest())
    g = m.groupBy("sample_id", "part").agg(F.stddev_samp("mid").alias("std"), F.avg("sp").alias("spread"), F.avg("depth").alias("depth"), F.sum("transaction_volume").alias("volume"), ((last - first) / (first + 1e-12)).alias("change"), F.avg(F.abs(F.col("mid") - F.col("was"))).alias("step"), F.when((F.count("was") > 2) & (F.var_pop("was") > 1e-12) & (F.var_pop(F.when(F.col("was").isNotNull(), F.col("mid"))) > 1e-12), correlation("mid", "was")).alias("acf"))
    names = [c for c in g.columns if c not in ("sample_id", "part")]
    flat = g.groupBy("sample_id").agg(*[F.max(F.when(F.col("part") == i, F.col(c))).alias(f"seg_{a}_{b}_{c}") for i, (a, b) in enumerate(segments) for c in names])
    return onto_spine(label, flat)


def activity(market: DataFrame, order: DataFrame, trade: DataFrame, label: DataFrame) -> DataFrame:
    """Range, dispersion and depth of usable quotes, half-price flag, event counts, sell and add shares."""
    m = market.where("ask_price_1 > 0 and bid_price_1 > 0").groupBy("sample_id").agg((F.max(X.mid()) - F.min(X.mid())).alias("mid_range"), F.stddev_samp(X.mid()).alias("mid_std"), F.avg(F.col("bid_volume_1") + F.col("ask_volume_1")).alias("depth"), F.when(F.percentile(X.mid(), 0.5) < 0.7, 1).otherwise(0).alias("half_price"))
    o = order.groupBy("sample_id").agg(F.count("*").alias("n_order"), F.avg(F.col("side").cast("double")).alias("order_sell"), F.avg(1.0 - 2.0 * F.col("order_action")).alias("add_cancel"))
    t = trade.groupBy("sample_id").agg(F.count("*").alias("n_trade"), F.avg(F.col("side").cast("double")).alias("trade_sell"))
    n = market.groupBy("sample_id").agg(F.count("*").alias("n_market"))
    return onto_spine(label, m, o, t, n)


def relative_streams(df: DataFrame) -> DataFrame:
    """Six rates of one stream relative to the other, from the micro-structure family; nulls count as 0."""
    v = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return df.select("sample_id", "month", "target", (v("o_arrival_rate") / (v("t_arrival_rate") + 1e-4)).alias("o_arrival_rel"), (v("o_iat_cv") - v("t_iat_cv")).alias("o_iat_cv_diff"), (v("o_large_share") / (v("t_large_share") + 1e-4)).alias("o_large_share_rel"), (v("o_burst_ratio") / (v("t_iat_cv") + 1e-4)).alias("o_burst_rel"), (v("t_arrival_rate") / (v("o_arrival_rate") + 1e-4)).alias("t_arrival_rel"), (v("o_add_cancel_ratio") / (v("t_arrival_rate") + 1e-4)).alias("o_ac_ratio_rel"))
