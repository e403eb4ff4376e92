"""As-of resampling of quotes onto whole seconds, and the path features built on it.

Second g of a sample holds the last quote with seconds_before_predict >= g (older-to-newer order, ties by seq, the last one wins).  Each quote covers the whole seconds
down to the next quote's, so one `lead` and one `explode` give the grid: no range join, no union with the grid."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import exprs as X
from .families import onto_spine, path_window, quote_ofi
from .order import quantiles

WINDOWS = (5, 15, 30, 60)


def asof_grid(quotes: DataFrame, *cols: str) -> DataFrame:
    """sample_id, g and the given columns for every covered whole second."""
    s = F.col("seconds_before_predict")
    nxt = F.lead(s).over(path_window())
    q = quotes.select("sample_id", *cols, F.floor(s).cast("int").alias("hi"), F.coalesce(F.floor(nxt).cast("int") + 1, F.lit(0)).alias("lo"))
    return q.where("lo <= hi").select("sample_id", *cols, F.explode(F.sequence("lo", "hi")).alias("g"))


def quote_channels() -> dict[str, Column]:
    b1, a1, b2, a2 = (F.col(c) for c in X.LEVELS[4:])
    floor = lambda v: F.greatest(v, F.lit(1e-12))
    l1, l2 = floor(b1 + a1), floor(b2 + a2)
    t = floor(l1 + l2)
    return {"c0": b1 / t, "c1": a1 / t, "c2": b2 / t, "c3": a2 / t, "c4": (b1 - a1) / l1, "c5": (b2 - a2) / l2, "c6": (b1 + b2 - a1 - a2) / t, "c7": (l1 - l2) / t}


def ring(c: Column, windows) -> Column:
    """Number of the first of the nested windows that holds c."""
    out = F.when(c <= windows[0], 0)
    for i, w in enumerate(windows[1:], 1):
        out = out.when(c <= w, i)
    return out


def over_windows(rings: DataFrame, windows, *aggs) -> DataFrame:
    """Sums of disjoint rings (sample_id, ring, ...) put together for each nested window w: a ring counts for its own window and all wider ones."""
    w = F.explode(F.slice(F.array(*[F.lit(x) for x in windows]), F.col("ring") + 1, len(windows))).alias("w")
    return rings.select("*", w).groupBy("sample_id", "w").agg(*aggs)


def pivoted(df: DataFrame, windows, names, prefix: str) -> DataFrame:
    """One row a sample: <prefix><w>_<name>."""
    return df.groupBy("sample_id").agg(*[F.max(F.when(F.col("w") == w, F.col(n))).alias(f"{prefix}{w}_{n}") for w in windows for n in names])


def _corr(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Correlation from sums; 0 with fewer than three pairs or a vanishing norm."""
    k = F.greatest(n, F.lit(1))  # a window may hold no pair, and Spark computes shared parts of both branches before it looks at the condition
    var = lambda q, s: F.greatest(q / k - (s / k) * (s / k), F.lit(0.0))
    norm = k * F.sqrt(var(sxx, sx) * var(syy, sy))
    return F.when((n >= 3) & (norm > 1e-8), F.try_divide(sxy - sx * sy / k, norm)).otherwise(0.0)


PAIRS = ((0, 2), (1, 3), (4, 5), (6, 7))


def geometry_temporal(market: DataFrame, label: DataFrame, windows=WINDOWS) -> DataFrame:
    """Per window: coverage, log of updates, four channel correlations, four lead-lag differences, and level, spread and change of two imbalances.  The windows are
    nested, so plain sums of the disjoint rings between them are taken once and added up."""
    ok = market.where(X.valid_quote() & (F.col("seconds_before_predict") <= max(windows)))
    ch = quote_channels()
    grid = asof_grid(ok.select("sample_id", "seq", "seconds_before_predict", *[v.alias(k) for k, v in ch.items()]), *ch)
    grid = grid.withColumns({f"n{i}": F.lead(f"c{i}").over(path_window_g()) for i in range(8)}).withColumn("ring", ring(F.col("g"), windows))
    c, n, has = (lambda i: F.col(f"c{i}")), (lambda i: F.col(f"n{i}")), F.col("n0").isNotNull()
    sums = {"rows": F.lit(1), "pairs": has.cast("int")}
    for i in range(8):
        before = F.when(has, c(i))
        sums |= {f"s{i}": c(i), f"q{i}": c(i) * c(i), f"sb{i}": before, f"qb{i}": before * before, f"sn{i}": n(i), f"qn{i}": n(i) * n(i)}
    for a, b in PAIRS:
        sums |= {f"x{a}": c(a) * c(b), f"l{a}": c(a) * n(b), f"m{a}": n(a) * c(b)}
    ends = F.struct("c6", "c7")
    rings = grid.groupBy("sample_id", "ring").agg(*[F.sum(v).alias(k) for k, v in sums.items()], F.max_by(ends, "g").alias("old"), F.min_by(ends, "g").alias("new"))
    per = over_windows(rings, windows, *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in sums], F.max_by("old", "ring").alias("old"), F.min_by("new", "ring").alias("new"))
    v, out = F.col, {"coverage": F.col("rows") / (F.col("w") + 1)}
    for a, b in PAIRS:
        out[f"corr_{a}_{b}"] = _corr(v("rows"), v(f"s{a}"), v(f"s{b}"), v(f"q{a}"), v(f"q{b}"), v(f"x{a}"))
    for a, b in PAIRS:
        lead = _corr(v("pairs"), v(f"sb{a}"), v(f"sn{b}"), v(f"qb{a}"), v(f"qn{b}"), v(f"l{a}"))
        out[f"leadlag_{a}_{b}"] = lead - _corr(v("pairs"), v(f"sn{a}"), v(f"sb{b}"), v(f"qn{a}"), v(f"qb{b}"), v(f"m{a}"))
    for s in (6, 7):
        mean = v(f"s{s}") / v("rows")
        out |= {f"c{s}_mean": mean, f"c{s}_std": F.sqrt(F.greatest(v(f"q{s}") / v("rows") - mean * mean, F.lit(0.0))), f"c{s}_change": v(f"new.c{s}") - v(f"old.c{s}")}
    path = pivoted(per.select("sample_id", "w", *[x.alias(k) for k, x in out.items()]), windows, out, "geom_t")
    # windows wider than the first covered ring have rows; narrower ones are empty, not null
    empty = [k for k in out if k == "coverage" or k.startswith(("corr", "leadlag"))]
    path = path.fillna(0.0, [f"geom_t{w}_{k}" for w in windows for k in empty])
    updates = ok.groupBy("sample_id").agg(*[F.log1p(F.count_if(F.col("seconds_before_predict") <= w).cast("double")).alias(f"geom_t{w}_log_updates") for w in windows])
    return onto_spine(label, path, updates)


def path_window_g(*by):
    return W.partitionBy("sample_id", *by).orderBy(F.desc("g"))


CHANNELS = ("mid", "spread", "imb1", "imb2", "ofi", "trade", "clock")


def path_signature(market: DataFrame, trade: DataFrame, label: DataFrame, windows=WINDOWS) -> DataFrame:
    """Depth-two signature of a seven-channel path per window: end increments and signed areas; zeros with fewer than three covered seconds.

    Channels differ between windows by a shift and a scale only.  So the sums of x_i x'_j - x_j x'_i (x' is the next second's) over the disjoint rings between the nested
    windows are taken once and added up; with the window's first and last points f and l, its area is half of that sum plus f_j l_i - f_i l_j, times both scales."""
    top = max(windows)
    ok = market.where(X.valid_quote() & (F.col("seconds_before_predict") <= top))
    w = path_window()
    q = ok.withColumn("step", quote_ofi(1, w) + quote_ofi(2, w))
    q = q.withColumn("cum", F.sum("step").over(w.rowsBetween(W.unboundedPreceding, 0)))
    t = trade.where(X.within(upto=top)).select("sample_id", "seconds_before_predict", "volume", X.signed_trade_flow().alias("v"))
    steps = t.groupBy("sample_id", F.floor("seconds_before_predict").cast("int").alias("g")).agg(F.sum("v").alias("tv_step"))
    p = asof_grid(q, "cum", *X.LEVELS).join(steps, ["sample_id", "g"], "full")
    g = path_window_g()
    p = p.withColumn("tcum", F.sum("tv_step").over(g)).where("bid_price_1 is not null")
    mid, tiny = X.mid(), F.lit(1e-12)
    raw = [F.ln(mid) * 1e4, (F.col("ask_price_1") - F.col("bid_price_1")) / F.greatest(F.abs(mid), tiny) * 1e4]
    raw += [(F.col(f"bid_volume_{i}") - F.col(f"ask_volume_{i}")) / (F.col(f"bid_volume_{i}") + F.col(f"ask_volume_{i}") + 1e-12) for i in (1, 2)]
    raw += [F.col("cum"), F.coalesce("tcum", F.lit(0.0)), -F.col("g").cast("double")]
    p = p.select("sample_id", "g", *[x.alias(f"r{i}") for i, x in enumerate(raw)])
    p = p.withColumns({f"x{i}": F.col(f"r{i}") - F.first(f"r{i}").over(g) for i in range(7)})  # near zero, so that the sums below keep their digits
    p = p.withColumns({f"z{i}": F.lead(f"x{i}").over(g) for i in range(7)}).withColumn("ring", ring(F.col("g"), windows))
    pairs = [(i, j) for i in range(7) for j in range(i + 1, 7)]
    point = F.struct(*[f"x{i}" for i in range(7)])
    area = lambda i, j: F.sum(F.col(f"x{i}") * F.col(f"z{j}") - F.col(f"x{j}") * F.col(f"z{i}")).alias(f"a{i}_{j}")
    rings = p.groupBy("sample_id", "ring").agg(F.count("*").alias("n"), *[area(i, j) for i, j in pairs], F.max_by(point, "g").alias("f"), F.min_by(point, "g").alias("l"))
    sig = over_windows(rings, windows, F.sum("n").alias("n"), *[F.coalesce(F.sum(f"a{i}_{j}"), F.lit(0.0)).alias(f"a{i}_{j}") for i, j in pairs], F.max_by("f", "ring").alias("f"), F.min_by("l", "ring").alias("l"))
    second = ring(F.col("seconds_before_predict"), windows).alias("ring")
    depth = ok.groupBy("sample_id", second).agg(F.sum(X.depth4()).alias("d"), F.count("*").alias("k"))
    depth = over_windows(depth, windows, (F.sum("d") / F.sum("k")).alias("scale"))
    traded = over_windows(t.groupBy("sample_id", second).agg(F.sum(F.abs("volume")).alias("tv")), windows, F.sum("tv").alias("tv"))
    sig = sig.join(depth, ["sample_id", "w"], "left").join(traded, ["sample_id", "w"], "left")
    one = F.lit(1.0)
    unit = [one, one, one, one, 1 / F.greatest(F.coalesce("scale", tiny), tiny), 1 / F.greatest("tv", tiny), 1 / F.col("w")]
    f, last = (lambda i: F.col(f"f.x{i}")), (lambda i: F.col(f"l.x{i}"))
    enough = F.col("n") >= 3
    out = {f"level1_{CHANNELS[i]}": (last(i) - f(i)) * unit[i] for i in range(7)}
    out |= {f"area_{CHANNELS[i]}__{CHANNELS[j]}": 0.5 * (F.col(f"a{i}_{j}") + f(j) * last(i) - f(i) * last(j)) * unit[i] * unit[j] for i, j in pairs}
    rows = sig.select("sample_id", "w", *[F.when(enough, x).otherwise(0.0).alias(k) for k, x in out.items()])
    return onto_spine(label, pivoted(rows, windows, out, "path_sig_t"))


def second_grid(order: DataFrame, trade: DataFrame, seconds: int = 60) -> DataFrame:
    """Volume per whole second and class: bid/ask adds and cancels, buys and sells; only seconds with events."""
    at = F.floor("seconds_before_predict").cast("int").alias("g")
    vol = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("volume"))), F.lit(0.0))
    s, a = F.col("side"), F.col("order_action")
    o = order.where(X.within(upto=seconds)).groupBy("sample_id", at).agg(vol((s == 0) & (a == 0)).alias("bid_add"), vol((s == 1) & (a == 0)).alias("ask_add"), vol((s == 0) & (a == 1)).alias("bid_cancel"), vol((s == 1) & (a == 1)).alias("ask_cancel"))
    t = trade.where(X.within(upto=seconds)).groupBy("sample_id", at).agg(vol(s == 0).alias("buy"), vol(s == 1).alias("sell"))
    return o.join(t, ["sample_id", "g"], "full").fillna(0.0)


def price_histogram(trade: DataFrame, bins: int = 16) -> DataFrame:
    """Signed and total volume per sample and log-price bin; edges are exact global quantiles."""
    x = trade.where("price > 0").withColumn("lp", F.ln("price"))
    edges = quantiles(x, {"e": ("lp", [i / bins for i in range(1, bins)])})
    b = x.join(F.broadcast(edges)).withColumn("bin", F.size(F.filter("e", lambda e: e <= F.col("lp"))))
    return b.groupBy("sample_id", "bin").agg(F.sum(X.signed_trade_flow()).alias("signed"), F.sum("volume").alias("total"), F.count("*").alias("n"))


def longest_gap(order: DataFrame, seconds: int = 60) -> DataFrame:
    """Longest run of whole seconds without an event inside the window, and how many seconds have one (gaps and islands by lead)."""
    busy = order.where(X.within(upto=seconds, strict=True)).select("sample_id", F.floor("seconds_before_predict").cast("int").alias("g")).distinct()
    w = path_window_g()
    runs = busy.withColumn("gap", F.coalesce(F.lag("g").over(w), F.lit(seconds)) - F.col("g") - 1)
    return runs.groupBy("sample_id").agg(F.greatest(F.max("gap"), F.min("g")).alias("longest_gap"), F.count("*").alias("busy_seconds"))
