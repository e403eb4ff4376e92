"""Quote sequences on a regular grid, their layers of features, surrogates of them, event intensity, tensors of seconds, and forensics of neighbouring samples.

Grid step 0 is the newest; `t` counts from the oldest of the chosen steps.  Feature layers are plain SQL texts over prepared columns, so that another engine can evaluate
the same definitions."""
from __future__ import annotations

import math
import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import exprs as X
from .families import newest, path_window
from .prep import numbered
from .order import quantiles

RAW = ("bid_price_1", "ask_price_1", "bid_volume_1", "ask_volume_1", "bid_price_2", "ask_price_2", "bid_volume_2", "ask_volume_2", "transaction_avgprice", "transaction_volume", "transaction_count")


def _channels() -> dict[str, Column]:
    out = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in RAW} | {"mid": X.mid()}
    for i in (1, 2):
        b, a = F.col(f"bid_volume_{i}"), F.col(f"ask_volume_{i}")
        out |= {f"spread{i}": F.col(f"ask_price_{i}") - F.col(f"bid_price_{i}"), f"depth{i}": b + a, f"imb{i}": X.imbalance_of("bid_ask", i)}
    return out


def _covering(market: DataFrame, steps: int, width: float) -> DataFrame:
    """The quotes that hold any step, with the first and last step of each (`lo`, `hi`): at most `steps` quotes a sample."""
    s = F.col("seconds_before_predict")
    nxt = F.lead(s).over(path_window())
    q = market.withColumns({"hi": F.floor(s / width).cast("int"), "lo": F.coalesce(F.floor(nxt / width).cast("int") + 1, F.lit(0))})
    return q.withColumn("hi", F.least("hi", F.lit(steps - 1))).where("lo <= hi")


def sequence(market: DataFrame, steps: int = 200, width: float = 3.0) -> DataFrame:
    """sample_id, step and 18 channels: step s holds the last quote at or before s * width seconds before the prediction; steps older than the first quote are absent."""
    return _covering(market, steps, width).select("sample_id", *[v.alias(k) for k, v in _channels().items()], F.explode(F.sequence("lo", "hi")).alias("step"))


def full_sequences(market: DataFrame, channels: list[str], steps: int = 200, width: float = 3.0) -> DataFrame:
    """The full sequences, a row a sample: `path` holds structs of step and channels from step 0 on.  Quotes are gathered before they are spread over their steps, in the tasks that hold their sample, so
    that no step is shuffled or sorted."""
    every = _channels()
    q = _covering(market, steps, width).where("sample_id is not null").select("sample_id", F.struct("lo", "hi", *[every[c].alias(c) for c in channels]).alias("run"))
    runs = q.groupBy("sample_id").agg(F.sum(F.col("run.hi") - F.col("run.lo") + 1).alias("n"), F.sort_array(F.collect_list("run")).alias("runs")).where(F.col("n") == steps)
    spread = lambda r: F.transform(F.sequence(r.lo, r.hi), lambda i: F.struct(i.alias("step"), *[r[c].alias(c) for c in channels]))
    return runs.select("sample_id", F.flatten(F.transform("runs", spread)).alias("path"))


#: Prepared columns of the newest {T} steps: c0.. (channels), z0.. (standardised inside the sample), n1_0.. (z one step newer) up to three steps.
def prepared_text(channels: list[str], steps: int) -> str:
    k = range(len(channels))
    z = ", ".join(f"(c{i} - avg(c{i}) OVER (PARTITION BY sample_id)) / (stddev_pop(c{i}) OVER (PARTITION BY sample_id) + 1e-9) AS z{i}" for i in k)
    n = ", ".join(f"lead(z{i}, {lag}) OVER w AS n{lag}_{i}" for lag in (1, 2, 3) for i in k)
    c = ", ".join(f"{x} AS c{i}" for i, x in enumerate(channels))
    return f"SELECT *, {n} FROM (SELECT *, {z} FROM (SELECT sample_id, {steps - 1} - step AS t, {c} FROM {{events}} WHERE step < {steps}) a) b WINDOW w AS (PARTITION BY sample_id ORDER BY t)"


def layer_texts(k: int, steps: int) -> tuple[dict[str, str], dict[str, str]]:
    """Aggregates per sample, and projections over them: moments, covariances, lagged correlations (even and odd), cross-spectra at the first two frequencies."""
    agg, out = {"rows": "count(*)"}, {}
    for i in range(k):
        c = f"c{i}"
        agg |= {f"mean_{i}": f"avg({c})", f"sd_{i}": f"stddev_pop({c})", f"min_{i}": f"min({c})", f"max_{i}": f"max({c})", f"first_{i}": f"min_by({c}, t)", f"last_{i}": f"max_by({c}, t)",
                f"late_{i}": f"coalesce(sum({c} * {c}) FILTER (WHERE t >= {steps - 3}), 0e0)", f"all_{i}": f"sum({c} * {c})"}
        out |= {f"mean_{i}": f"mean_{i}", f"sd_{i}": f"sd_{i} + 1e-9", f"min_{i}": f"min_{i}", f"max_{i}": f"max_{i}", f"range_{i}": f"max_{i} - min_{i}", f"slope_{i}": f"(last_{i} - first_{i}) / {steps - 1}",
                f"change_{i}": f"last_{i} - first_{i}", f"energy_{i}": f"late_{i} / (all_{i} + 1e-12)"}
        for f in (1, 2):
            a = 2 * math.pi * f / steps
            agg |= {f"re_{i}_{f}": f"sum({c} * cos({a!r} * t))", f"im_{i}_{f}": f"-sum({c} * sin({a!r} * t))"}
    power = {f: " + ".join(f"(re_{i}_{f} * re_{i}_{f} + im_{i}_{f} * im_{i}_{f})" for i in range(k)) for f in (1, 2)}
    for i in range(k):
        for f in (1, 2):
            own = f"(re_{i}_{f} * re_{i}_{f} + im_{i}_{f} * im_{i}_{f})"
            out |= {f"power_{i}_{f}": own, f"power_share_{i}_{f}": f"{own} / ({power[f]} + 1e-12)"}
        for j in range(i + 1, k):
            agg |= {f"cov_{i}_{j}": f"avg(c{i} * c{j}) - avg(c{i}) * avg(c{j})", f"corr_{i}_{j}": f"avg(z{i} * z{j})"}
            out |= {f"cov_{i}_{j}": f"cov_{i}_{j}", f"corr_{i}_{j}": f"corr_{i}_{j}"}
            for lag in (1, 2, 3):
                agg |= {f"lag{lag}_{i}_{j}": f"avg(z{i} * n{lag}_{j})", f"lag{lag}_{j}_{i}": f"avg(z{j} * n{lag}_{i})"}
                out |= {f"even{lag}_{i}_{j}": f"(lag{lag}_{i}_{j} + lag{lag}_{j}_{i}) / 2", f"odd{lag}_{i}_{j}": f"(lag{lag}_{i}_{j} - lag{lag}_{j}_{i}) / 2"}
            for f in (1, 2):
                re, im = f"(re_{i}_{f} * re_{j}_{f} + im_{i}_{f} * im_{j}_{f})", f"(im_{i}_{f} * re_{j}_{f} - re_{i}_{f} * im_{j}_{f})"
                size = f"(sqrt(re_{i}_{f} * re_{i}_{f} + im_{i}_{f} * im_{i}_{f}) * sqrt(re_{j}_{f} * re_{j}_{f} + im_{j}_{f} * im_{j}_{f}) + 1e-12)"
                out |= {f"cross_re_{i}_{j}_{f}": re, f"cross_im_{i}_{j}_{f}": im, f"phase_cos_{i}_{j}_{f}": f"{re} / {size}", f"phase_sin_{i}_{j}_{f}": f"abs({im}) / {size}"}
    return agg, out


def sequence_layers(seq: DataFrame, channels: list[str], steps: int = 10) -> DataFrame:
    """One row a sample: the layers over the newest steps (those that are there)."""
    agg, out = layer_texts(len(channels), steps)
    p = seq.sparkSession.sql(prepared_text(channels, steps), events=seq)
    got = p.groupBy("sample_id").agg(*[F.expr(e).alias(f"a_{n}") for n, e in agg.items()]).toDF("sample_id", *agg)
    return got.select("sample_id", "rows", *[F.expr(e).alias(f"f_{n}") for n, e in out.items()])


def _hash(seed: int, *cols: str) -> Column:
    """Arithmetic hash, the same in any engine."""
    return _dealt(seed, *[F.col(c) for c in cols])


def _dealt(seed: int, *cols: Column) -> Column:
    return (sum((c * m for c, m in zip(cols, (7919, 104729, 1299709), strict=False)), F.lit(0)) + seed * 15485863 + 12345) % 1000003


def surrogate(seq: DataFrame, kind: str, channels: list[str], steps: int, block: int = 10, seed: int = 1) -> DataFrame:
    """Sequences with their steps dealt anew: `shuffle`, `reverse`, `block` (whole blocks dealt anew) or `desync` (every channel turned by its own shift).  Full
    sequences of `steps` steps are meant."""
    if kind == "reverse":
        return seq.withColumn("step", F.lit(steps - 1) - F.col("step"))
    if kind == "shuffle":
        return seq.withColumn("step", F.row_number().over(W.partitionBy("sample_id").orderBy(_hash(seed, "sample_id", "step"), "step")) - 1)
    if kind == "block":
        b = seq.withColumn("b", F.floor(F.col("step") / block))
        place = F.dense_rank().over(W.partitionBy("sample_id").orderBy(_hash(seed, "sample_id", "b"), "b")) - 1
        return b.withColumn("step", (place * block + F.col("step") % block).cast("int")).drop("b")
    parts = []
    for i, c in enumerate(channels):
        shift = F.pmod(F.col("sample_id") * 31 + (i + seed) * 17, F.lit(steps))
        parts.append(seq.select("sample_id", F.pmod(F.col("step") + shift, F.lit(steps)).cast("int").alias("step"), c))
    return reduce(lambda a, b: a.join(b, ["sample_id", "step"]), parts)


def surrogate_path(kind: str, channels: list[str], steps: int, block: int = 10, seed: int = 1) -> Column:
    """`surrogate` for rows of `full_sequences`: structs of the channels, in the order of their new steps."""
    path = F.col("path")
    if kind == "reverse":
        return F.transform(F.reverse(path), lambda x: F.struct(*[x[c].alias(c) for c in channels]))
    if kind == "desync":
        at = [F.col("sample_id") * 31 + (i + seed) * 17 for i in range(len(channels))]
        return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda s: F.struct(*[F.get(path, F.pmod(s - a, F.lit(steps)).cast("int"))[c].alias(c) for a, c in zip(at, channels, strict=True)]))
    if steps % block:
        raise ValueError("steps must be whole blocks")
    unit = lambda x: F.floor(x.step / block) if kind == "block" else x.step.cast("long")
    dealt = lambda x: F.struct(_dealt(seed, F.col("sample_id"), unit(x)).alias("h"), unit(x).alias("unit"), x.step.alias("step"), *[x[c].alias(c) for c in channels])
    return F.transform(F.sort_array(F.transform(path, dealt)), lambda x: F.struct(*[x[c].alias(c) for c in channels]))


def path_sums(path: Column, mid: str, with_: str) -> Column:
    """Struct of (n, total) of the mid, (steps, moved) of its absolute changes from the older step, and (pairs, together) of the changes times a channel: one walk from the oldest step to the newest, nulls apart."""
    none = F.lit(None).cast("double")
    zero = F.struct(none.alias("older"), *[F.lit(0).cast("long").alias(n) if n in ("n", "steps", "pairs") else F.lit(0.0).alias(n) for n in ("n", "total", "steps", "moved", "pairs", "together")])

    def step(a: Column, x: Column) -> Column:
        d = F.coalesce(x[mid] - a.older, F.lit(0.0))
        has = lambda v: v.isNotNull().cast("long")
        return F.struct(x[mid].alias("older"), (a.n + has(x[mid])).alias("n"), (a.total + F.coalesce(x[mid], F.lit(0.0))).alias("total"), (a.steps + 1).alias("steps"), (a.moved + F.abs(d)).alias("moved"),
                        (a.pairs + has(x[with_])).alias("pairs"), (a.together + F.coalesce(d * x[with_], F.lit(0.0))).alias("together"))

    return F.aggregate(F.reverse(path), zero, step)


def phase_randomised(seq: DataFrame, channels: list[str], seed: int = 1) -> DataFrame:
    """Sequences with the same power spectrum and random phases: one Fourier transform a sample (a few hundred rows) in an Arrow task."""

    def turn(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("step")
        rng = np.random.default_rng([seed, int(g["sample_id"].iloc[0])])
        spec = np.fft.rfft(g[channels].to_numpy(float), axis=0)
        phase = np.exp(2j * np.pi * rng.random(len(spec)))[:, None]
        phase[0] = 1
        if len(g) % 2 == 0:
            phase[-1] = 1
        return pd.DataFrame({"sample_id": g["sample_id"], "step": g["step"], **dict(zip(channels, np.fft.irfft(spec * phase, len(g), axis=0).T, strict=True))})

    return seq.select("sample_id", "step", *channels).groupBy("sample_id").applyInPandas(turn, ", ".join(["sample_id long", "step int", *(f"{c} double" for c in channels)]))


def target_probes(df: DataFrame, y: str, train: Column, bins: int = 100) -> DataFrame:
    """Sign, size, place among `bins` exact quantiles of the training targets, and whether the size passes their 90 % quantile."""
    q = quantiles(df.where(train), {"e": (y, [i / bins for i in range(1, bins)]), "p90": (F.abs(y), 0.9)})
    place = F.size(F.filter("e", lambda v: v <= F.col(y))) / bins
    return df.join(F.broadcast(q)).withColumns({"sign": F.signum(y), "size": F.abs(y), "place": place, "large": F.abs(y) > F.col("p90")}).drop("e", "p90")


CLASSES = ("bid_add", "ask_add", "bid_cancel", "ask_cancel", "buy", "sell")


def _classed(order: DataFrame, trade: DataFrame, seconds: int) -> DataFrame:
    """(sample_id, g, class, volume, price) of all events of the window."""
    side = F.when(F.col("side") == 0, "bid").otherwise("ask")
    kind = F.concat(side, F.when(F.col("order_action") == 0, "_add").otherwise("_cancel"))
    g = F.floor("seconds_before_predict").cast("int").alias("g")
    inside = X.within(upto=seconds, strict=True)
    o = order.where(inside).select("sample_id", g, kind.alias("kind"), "volume", "price")
    return o.unionByName(trade.where(inside).select("sample_id", g, F.when(F.col("side") == 0, "buy").otherwise("sell").alias("kind"), "volume", "price"))


def intensity(order: DataFrame, trade: DataFrame, seconds: int = 60) -> DataFrame:
    """Per sample and class: events a second, the busiest second, and the newer half's rate less the older half's."""
    per = _classed(order, trade, seconds).groupBy("sample_id", "g").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in CLASSES])
    half = seconds // 2
    near, far = (lambda k: F.coalesce(F.sum(F.when(F.col("g") < half, F.col(k))), F.lit(0))), (lambda k: F.coalesce(F.sum(F.when(F.col("g") >= half, F.col(k))), F.lit(0)))
    return per.groupBy("sample_id").agg(*[x for k in CLASSES for x in ((F.sum(k) / seconds).alias(f"{k}_rate"), F.max(k).alias(f"{k}_peak"), ((near(k) - far(k)) / half).alias(f"{k}_trend"))])


def fast_tensor(order: DataFrame, trade: DataFrame, seconds: int = 60) -> DataFrame:
    """Sixteen channels for each busy second: volume and count of the six classes, signed volume of orders and trades, and their mean prices."""
    kind, v = F.col("kind"), F.col("volume")
    is_trade = kind.isin("buy", "sell")
    vol = lambda k: F.coalesce(F.sum(F.when(kind == k, v)), F.lit(0.0))
    flow = vol("bid_add") - vol("ask_add") - vol("bid_cancel") + vol("ask_cancel")
    return _classed(order, trade, seconds).groupBy("sample_id", "g").agg(
        *[vol(k).alias(f"{k}_volume") for k in CLASSES], *[F.count_if(kind == k).alias(f"{k}_count") for k in CLASSES], flow.alias("order_flow"), (vol("buy") - vol("sell")).alias("trade_flow"),
        F.avg(F.when(~is_trade, F.col("price"))).alias("order_price"), F.avg(F.when(is_trade, F.col("price"))).alias("trade_price"))


def window_proxies(market: DataFrame, seconds: int = 60) -> DataFrame:
    """Return, deviation, spread, depth, traded volume and count, and rows of the last seconds (the bound itself is outside)."""
    m = market.where(X.within(upto=seconds, strict=True) & (F.col("ask_price_1") > 0)).withColumn("mid", X.mid())
    old, new = F.min_by("mid", newest()), F.max_by("mid", newest())
    return m.groupBy("sample_id").agg(((new - old) / (old + 1e-12)).alias("ret"), F.stddev_samp("mid").alias("std"), F.avg(F.col("ask_price_1") - F.col("bid_price_1")).alias("spread"), F.avg(F.col("bid_volume_1") + F.col("ask_volume_1")).alias("depth"),
                                      F.coalesce(F.sum("transaction_volume"), F.lit(0.0)).alias("volume"), F.sum("transaction_count").alias("trades"), F.count("*").alias("rows"))


def adjacency(order: DataFrame, edge: float = 2.0, span: float = 60.0) -> DataFrame:
    """Do samples follow each other?  Mean jump from a sample's newest median price to the oldest one of the next id, and to one dealt by a hash: (pairs, jump, dealt)."""
    new = F.percentile(F.when(F.col("seconds_before_predict") <= edge, F.col("price")), 0.5)
    old = F.percentile(F.when(F.col("seconds_before_predict") >= span - edge, F.col("price")), 0.5)
    ends = order.groupBy("sample_id").agg(old.alias("oldest"), new.alias("newest")).where("oldest is not null and newest is not null")
    a = numbered(ends, ["sample_id"], "i")
    dealt = numbered(ends.select(_hash(1, "sample_id").alias("h"), "sample_id", F.col("oldest").alias("other")), ["h", "sample_id"], "i").select((F.col("i") - 1).alias("i"), "other")
    nxt = a.select((F.col("i") - 1).alias("i"), F.col("oldest").alias("following"))
    met = a.join(nxt, "i").join(dealt, "i")
    return met.agg(F.count("*").alias("pairs"), F.avg(F.abs(F.col("following") - F.col("newest"))).alias("jump"), F.avg(F.abs(F.col("other") - F.col("newest"))).alias("dealt"))


#: Stages of the order-flow family: each adds the columns of its rule to those of the stages before it.
STAGES = {
    "A": r"^(ofi_event_rate|trade_flow_rate|ofi_event_count_rate|trade_event_count_rate)_(5|15|30|60)$", "B": r"^quote_ofi_l1_rate_(5|15|30|60)$", "C": r"^quote_ofi_l2_rate_(5|15|30|60)$",
    "D": r"^(ofi_depth|ofi_volume|ofi_trade_volume|quote_ofi_l1_depth|quote_ofi_l2_depth)_(5|15|30|60)$", "E": r"fast_slow|acceleration", "F": r"^(order_trade|quote_trade)_"}
#: The sixteen columns of the wide stack that describe a market state.
STATE = ("m_mid_std", "m_rv", "m_sp_mean_60", "m_imb_mean_60", "m_ofi_sum_60", "m_mid_range_60", "m_mid_std_180", "m_imb_mean_180", "m_ofi_sum_180", "t_buy_ratio_15", "t_px_std_15", "t_avg_time_gap", "o_buy_ratio_15", "o_add_ratio_15", "o_avg_time_gap", "x_trans_order_buy_diff_15")
#: The context columns of the normalised family: scales of the longest window, and its states.
CONTEXT = r"^revol_(log.*_60|mid_net_z_60|spread_mean_z_60|depth_change_z_60|order_flow_z_60|trade_flow_z_60)$"


def staged(df: DataFrame, stage: str, keep=("sample_id", "month", "target")) -> DataFrame:
    """The kept columns and those of all stages up to the given one."""
    rules = [re.compile(r) for k, r in STAGES.items() if k <= stage.upper()]
    if stage.upper() not in STAGES:
        raise ValueError(f"unknown stage: {stage}")
    return df.select(*[c for c in df.columns if c in keep or any(r.search(c) for r in rules)])


def matching(df: DataFrame, rule: str, keep=("sample_id",)) -> DataFrame:
    return df.select(*keep, *[c for c in df.columns if re.search(rule, c)])
