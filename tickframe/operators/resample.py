"""Whole-second resampling and what is computed on it; ten-second bars; long history; raw event aggregates."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import exprs as X
from .families import newest, path_window, sec


def secondly_trades(trade: DataFrame, seconds: int = 60) -> DataFrame:
    """One row for every sample that trades and every second 0..seconds: volumes of buys and sells, mean price, rows (0 when empty)."""
    t = trade.where(X.within(upto=seconds)).groupBy("sample_id", F.floor("seconds_before_predict").cast("int").alias("g")).agg(F.sum(F.when(F.col("side") == 0, F.col("volume")).otherwise(0.0)).alias("buy"), F.sum(F.when(F.col("side") == 1, F.col("volume")).otherwise(0.0)).alias("sell"), F.avg("price").alias("price"), F.count("*").alias("rows"))
    full = t.select("sample_id").distinct().withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(seconds))))
    return full.join(t, ["sample_id", "g"], "left").select("sample_id", "g", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("buy", "sell")], "price", F.coalesce("rows", F.lit(0)).alias("rows"))


def secondly_statistics(grid: DataFrame) -> DataFrame:
    """Busy seconds, trend of the price over them, lag-1 and lag-5 autocovariance ratios of volume, near against far half, weighted flow."""
    w = W.partitionBy("sample_id").orderBy(F.desc("g"))
    g = grid.withColumn("v", F.col("buy") + F.col("sell")).withColumns({"v1": F.lag("v", 1).over(w), "v5": F.lag("v", 5).over(w), "m": F.avg("v").over(W.partitionBy("sample_id"))})
    ac = lambda c: F.try_divide(F.sum((F.col("v") - F.col("m")) * (F.col(c) - F.col("m"))), F.sum((F.col("v") - F.col("m")) * (F.col("v") - F.col("m"))))
    near, far = F.sum(F.when(F.col("g") < 30, F.col("v"))), F.sum(F.when(F.col("g") >= 30, F.col("v")))
    weight = F.exp(-F.col("g") / 15)
    return g.groupBy("sample_id").agg(F.count_if(F.col("rows") > 0).alias("busy"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.regr_slope(F.col("price"), (-F.col("g")).cast("double")).alias("price_trend"), ac("v1").alias("autocov_1"), ac("v5").alias("autocov_5"), (near / (far + 1.0)).alias("near_far"), (F.sum(weight * (F.col("buy") - F.col("sell"))) / F.sum(weight)).alias("weighted_flow"))


def slow_bars(market: DataFrame, width: int = 10, bars: int = 60) -> DataFrame:
    """Bars of `width` seconds: last mid, mean spread, depth and imbalance, traded volume and count, rows, return over the bar before (older) that is present."""
    m = market.where(X.within(upto=width * bars) & (F.col("ask_price_1") > 0)).withColumn("mid", X.mid())
    b = m.groupBy("sample_id", F.floor(sec() / width).cast("int").alias("bar")).agg(F.max_by("mid", newest()).alias("last"), F.avg(F.col("ask_price_1") - F.col("bid_price_1")).alias("spread"), F.avg(F.col("bid_volume_1") + F.col("ask_volume_1")).alias("depth"), F.coalesce(F.sum("transaction_volume"), F.lit(0.0)).alias("volume"), F.avg(X.imbalance_of("bid_ask")).alias("imb"), F.sum("transaction_count").alias("trades"), F.count("*").alias("rows"))
    was = F.lag("last").over(W.partitionBy("sample_id").orderBy(F.desc("bar")))
    return b.withColumn("ret", F.coalesce(F.col("last") / was - 1, F.lit(0.0)))


def history(market: DataFrame, edges=(0, 60, 180, 300, 600)) -> DataFrame:
    """Level, oldest and newest mid, trend, and per segment mean, dispersion, volume and rows, named by time."""
    m = market.where("ask_price_1 > 0").withColumn("mid", X.mid())
    old, new = F.min_by("mid", newest()), F.max_by("mid", newest())
    aggs = [F.avg("mid").alias("mean"), old.alias("oldest"), new.alias("newest"), (new / old - 1).alias("trend")]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        at = lambda c, a=a, b=b: F.when((sec() >= a) & (sec() < b), F.col(c))
        aggs += [F.avg(at("mid")).alias(f"mean_{a}_{b}"), F.stddev_samp(at("mid")).alias(f"std_{a}_{b}"), F.coalesce(F.sum(at("transaction_volume")), F.lit(0.0)).alias(f"volume_{a}_{b}"), F.count(at("mid")).alias(f"rows_{a}_{b}")]
    return m.groupBy("sample_id").agg(*aggs)


def raw_aggregates(order: DataFrame, trade: DataFrame) -> DataFrame:
    """Counts and volumes by side and action, size quantiles, prices, and the last 15 seconds against the 15 before."""
    s, a, v = F.col("side"), F.col("order_action"), F.col("volume")
    kinds = {"bid_add": (s == 0) & (a == 0), "ask_add": (s == 1) & (a == 0), "bid_cancel": (s == 0) & (a == 1), "ask_cancel": (s == 1) & (a == 1)}
    vol = lambda c: F.coalesce(F.sum(F.when(c, v)), F.lit(0.0))
    recent, before = sec() <= 15, (sec() > 15) & (sec() <= 30)

    def tail(p: str) -> list[Column]:
        q = [F.percentile(v, x).alias(f"{p}_size_p{round(100 * x)}") for x in (0.25, 0.5, 0.75, 0.95)]
        return [*q, F.max("volume").alias(f"{p}_size_max"), F.avg("price").alias(f"{p}_price_mean"), F.stddev_samp("price").alias(f"{p}_price_std"), vol(recent).alias(f"{p}_recent"), vol(before).alias(f"{p}_before"), (vol(recent) / (vol(before) + 1.0)).alias(f"{p}_recent_ratio")]

    o = order.groupBy("sample_id").agg(*[x for k, c in kinds.items() for x in (F.count_if(c).alias(f"n_{k}"), vol(c).alias(f"v_{k}"))], *tail("order"))
    t = trade.groupBy("sample_id").agg(*[x for k, c in (("buy", s == 0), ("sell", s == 1)) for x in (F.count_if(c).alias(f"n_{k}"), vol(c).alias(f"v_{k}"))], *tail("trade"))
    return o.join(t, "sample_id", "full")


def gap_features(order: DataFrame, gaps=(1, 7, 14, 21, 30, 60, 120)) -> DataFrame:
    """Per event over several gaps back: volume change, time, price change, its change and its ratio to the price then; their means per sample."""
    w = path_window()
    p, was = F.col("price"), lambda c, g: F.lag(c, g).over(w)
    cols = {}
    for g in gaps:
        cols |= {f"change_{g}": F.col("volume") - was("volume", g), f"time_{g}": was("seconds_before_predict", g) - sec(), f"price_{g}": p - was("price", g)}
        cols |= {f"second_{g}": p - 2 * was("price", g) + was("price", 2 * g), f"ratio_{g}": (p - was("price", g)) / (was("price", g) + 1e-8)}
    return order.select("sample_id", *[v.alias(k) for k, v in cols.items()]).groupBy("sample_id").agg(*[F.avg(k).alias(k) for k in cols])
