"""Blends and calibration.  A blend's cosine needs only six sums, so a grid of weights costs one pass over the data."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .metrics import cosine

def sums(df: DataFrame, a: str, b: str, y: str, by: list[str]) -> DataFrame:
    x, z, t = F.col(a), F.col(b), F.col(y)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(x).alias("sa"), F.sum(z).alias("sb"), F.sum(x * x).alias("aa"), F.sum(z * z).alias("bb"), F.sum(x * z).alias("ab"), F.sum(x * t).alias("ay"), F.sum(z * t).alias("by"), F.sum(t * t).alias("yy"))


def scales(s: DataFrame) -> DataFrame:
    """One row per method: raw, std (population) or rms scale of both members; a zero scale counts as 1."""
    std = lambda q, m: F.sqrt(F.greatest(F.col(q) / F.col("n") - (F.col(m) / F.col("n")) * (F.col(m) / F.col("n")), F.lit(0.0)))
    pick = {"raw": (F.lit(1.0), F.lit(1.0)), "std": (std("aa", "sa"), std("bb", "sb")), "rms": (F.sqrt(F.col("aa") / F.col("n")), F.sqrt(F.col("bb") / F.col("n")))}
    safe = lambda v: F.when(v > 0, v).otherwise(1.0)
    rows = F.array(*[F.struct(F.lit(i).alias("m"), F.lit(k).alias("method"), safe(a).alias("ka"), safe(b).alias("kb")) for i, (k, (a, b)) in enumerate(pick.items())])
    return s.select("*", F.explode(rows).alias("k")).select(*s.columns, "k.*")


def blend_cosine(w: Column) -> Column:
    u, v = (1 - w) / F.col("ka"), w / F.col("kb")
    norm = u * u * F.col("aa") + 2 * u * v * F.col("ab") + v * v * F.col("bb")
    return F.when(norm * F.col("yy") > 0, (u * F.col("ay") + v * F.col("by")) / F.sqrt(norm * F.col("yy"))).otherwise(0.0)


def fit_blend(df: DataFrame, a: str, b: str, y: str, by: list[str], steps: int = 100) -> DataFrame:
    """Best method and weight by cosine (first maximum wins, to nine digits)."""
    grid = scales(sums(df, a, b, y, by)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    grid = grid.withColumn("score", F.round(blend_cosine(F.col("i") / steps), 9))
    best = W.partitionBy(*by).orderBy(F.desc("score"), "m", "i")
    return grid.withColumn("r", F.row_number().over(best)).where("r = 1").select(*by, "method", (F.col("i") / steps).alias("weight"), "score", "ka", "kb")


def apply_blend(df: DataFrame, state: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Rows with `blend`, by the frozen scales and weight of their group (or of one state row for all)."""
    got = df.join(F.broadcast(state), by) if by else df.join(F.broadcast(state))
    return got.withColumn("blend", (1 - F.col("weight")) * F.col(a) / F.col("ka") + F.col("weight") * F.col(b) / F.col("kb"))


def fit_alpha(df: DataFrame, base: str, resid: str, y: str, by: list[str], alphas) -> DataFrame:
    """Best alpha of base / rms(base) + alpha * resid / rms(resid) by cosine (first maximum wins, to nine digits), with the frozen scales and the cosine of
    the base alone."""
    safe = lambda v: F.when(v > 0, v).otherwise(1.0)
    s = sums(df, base, resid, y, by)
    s = s.withColumn("ka", safe(F.sqrt(F.col("aa") / F.col("n")))).withColumn("kb", safe(F.sqrt(F.col("bb") / F.col("n"))))
    grid = s.select("*", F.posexplode(F.array(*[F.lit(float(a)) for a in alphas])).alias("i", "alpha"))
    u, v = 1 / F.col("ka"), F.col("alpha") / F.col("kb")
    norm = (u * u * F.col("aa") + 2 * u * v * F.col("ab") + v * v * F.col("bb")) * F.col("yy")
    score = F.when(norm > 0, (u * F.col("ay") + v * F.col("by")) / F.sqrt(norm)).otherwise(0.0)
    alone = F.when(F.col("aa") * F.col("yy") > 0, F.col("ay") / F.sqrt(F.col("aa") * F.col("yy"))).otherwise(0.0)
    grid = grid.withColumns({"score": F.round(score, 9), "base_score": alone})
    best = W.partitionBy(*by).orderBy(F.desc("score"), "i")
    return grid.withColumn("r", F.row_number().over(best)).where("r = 1").select(*by, "alpha", "score", "base_score", "ka", "kb")


def apply_alpha(df: DataFrame, state: DataFrame, base: str, resid: str, by: list[str]) -> DataFrame:
    """Rows with `blend`, by frozen scales and alpha (by group, or one state row for all)."""
    got = df.join(F.broadcast(state), by) if by else df.join(F.broadcast(state))
    return got.withColumn("blend", F.col(base) / F.col("ka") + F.col("alpha") * F.col(resid) / F.col("kb"))


def fixed_blend(members: dict[str, float]) -> Column:
    """Weighted sum of columns by fixed weights, which must sum to one."""
    if abs(sum(members.values()) - 1) > 1e-9:
        raise ValueError("weights must sum to one")
    return sum((w * F.col(c) for c, w in members.items()), F.lit(0.0))


def residual_view(df: DataFrame, p: str, y: str, visible: Column) -> DataFrame:
    """beta = sum(p y) / sum(p p) over visible rows, and the residual of every row."""
    beta = df.where(visible).agg(F.try_divide(F.sum(F.col(p) * F.col(y)), F.sum(F.col(p) * F.col(p))).alias("beta"))
    return df.join(F.broadcast(beta)).withColumn("residual", F.col(y) - F.coalesce("beta", F.lit(0.0)) * F.col(p))


def drift_estimates(months: DataFrame, x: str = "mean") -> DataFrame:
    """Estimates of a month's mean from earlier months only: expanding, rolling 3, 6 and 12, and exponentially weighted by age."""
    w = W.orderBy("month")
    past = lambda n: w.rowsBetween(-n if n else W.unboundedPreceding, -1)
    out = months.withColumn("expanding", F.avg(x).over(past(0)))
    for n in (3, 6, 12):
        out = out.withColumn(f"rolling_{n}", F.avg(x).over(past(n)))
    for h in (3, 6, 12):
        rate = 1 - 0.5 ** (1 / h)
        grow = F.exp(rate * F.col("month").cast("double"))
        out = out.withColumn(f"ewma_{h}", F.try_divide(F.sum(F.col(x) * grow).over(past(0)), F.sum(grow).over(past(0))))
    # the line through the last twelve months, read off at this month
    m = F.col("month").cast("double")
    n, sm, sx = (F.sum(c).over(past(12)) for c in (F.lit(1.0), m, F.col(x)))
    smm, smx = F.sum(m * m).over(past(12)), F.sum(m * F.col(x)).over(past(12))
    slope = F.try_divide(n * smx - sm * sx, F.when(n >= 2, n * smm - sm * sm))
    return out.withColumn("trend_12", (sx - slope * sm) / n + slope * m)


def drift_corrected(df: DataFrame, pred: str, y: str, tune: Column, alphas, estimate: str = "expanding") -> DataFrame:
    """Per month outside `tune`: what adding alpha times the estimated monthly mean (of earlier months only) changes of the cosine; alpha is chosen on `tune` rows."""
    means = drift_estimates(df.groupBy("month").agg(F.avg(y).alias("mean"))).select("month", F.coalesce(estimate, F.lit(0.0)).alias("drift"))
    rows = df.join(F.broadcast(means), "month")
    got = apply_alpha(rows.where(~tune), fit_alpha(rows.where(tune), pred, "drift", y, [], alphas), pred, "drift", [])
    return got.groupBy("month").agg(F.first("alpha").alias("alpha"), (cosine("blend", y) - cosine(pred, y)).alias("delta"))


def simplex_scores(df: DataFrame, members: list[str], y: str, by: str, steps: int = 10) -> DataFrame:
    """Cosine c of each group for every vector of non-negative weights (w0, w1, ... in steps) with sum 1: one pass for the Gram sums, then a small table of weights."""
    k = len(members)
    cols = [F.col(m) for m in members]
    gram = df.groupBy(by).agg(*[F.sum(cols[i] * cols[j]).alias(f"g{i}{j}") for i in range(k) for j in range(i, k)], *[F.sum(c * F.col(y)).alias(f"h{i}") for i, c in enumerate(cols)], F.sum(F.col(y) * F.col(y)).alias("yy"))
    grid = df.sparkSession.range(1).select(F.lit(0).alias("used"))
    for i in range(k - 1):
        grid = grid.withColumn(f"w{i}", F.explode(F.sequence(F.lit(0), F.lit(steps) - F.col("used")))).withColumn("used", F.col("used") + F.col(f"w{i}"))
    grid = grid.withColumn(f"w{k - 1}", F.lit(steps) - F.col("used")).drop("used")
    w = [F.col(f"w{i}") / steps for i in range(k)]
    norm = sum((w[i] * w[j] * F.col(f"g{min(i, j)}{max(i, j)}") for i in range(k) for j in range(k)), F.lit(0.0))
    dot = sum((w[i] * F.col(f"h{i}") for i in range(k)), F.lit(0.0))
    scored = gram.join(F.broadcast(grid)).withColumn("c", F.when(norm * F.col("yy") > 0, dot / F.sqrt(norm * F.col("yy"))).otherwise(0.0))
    return scored.select(by, *[f"w{i}" for i in range(k)], "c")


def simplex_by_fold(df: DataFrame, members: list[str], y: str, by: str, steps: int = 10) -> DataFrame:
    """Best weights of each fold on its own rows (ties: the lesser weights first)."""
    names = [f"w{i}" for i in range(len(members))]
    best = W.partitionBy(by).orderBy(F.desc("score"), *names)
    scored = simplex_scores(df, members, y, by, steps).withColumn("score", F.round("c", 9)).withColumn("r", F.row_number().over(best)).where("r = 1")
    return scored.select(by, *[(F.col(w) / steps).alias(m) for w, m in zip(names, members, strict=True)], "score")


def simplex_search(df: DataFrame, members: list[str], y: str, by: str, steps: int = 10) -> DataFrame:
    """Best weights by the cosine averaged over groups."""
    k = len(members)
    names = [f"w{i}" for i in range(k)]
    scored = simplex_scores(df, members, y, by, steps)
    return scored.groupBy(*names).agg(F.round(F.avg("c"), 9).alias("score")).orderBy(F.desc("score"), *names).limit(1).select(*[(F.col(f"w{i}") / steps).alias(m) for i, m in enumerate(members)], "score")
