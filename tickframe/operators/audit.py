"""Audits and diagnostics: correlation tables, effect sizes, conditional grids, monthly means, gates, magnitude buckets, distinct spacing."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .metrics import correlation, cosine
from .order import quantiles


def correlation_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """Correlation of every pair of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    wide = df.agg(*[correlation(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"p{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def effect_size(df: DataFrame, high: Column, cols: list[str], fold: Column) -> DataFrame:
    """Cohen's d of each column between two groups, overall and its sign consistency over folds."""
    flat = df.select(high.alias("high"), fold.alias("fold"), F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in cols])).alias("x")).select("high", "fold", "x.*")
    v1, v0 = F.when(F.col("high"), F.col("v")), F.when(~F.col("high"), F.col("v"))
    d = F.try_divide(F.avg(v1) - F.avg(v0), F.sqrt((F.var_samp(v1) + F.var_samp(v0)) / 2))
    per = flat.groupBy("name", "fold").agg((F.avg(v1) - F.avg(v0)).alias("gap"))
    same = per.groupBy("name").agg(F.greatest(F.avg(F.when(F.col("gap") > 0, 1.0).otherwise(0.0)), F.avg(F.when(F.col("gap") < 0, 1.0).otherwise(0.0))).alias("consistency"))
    return flat.groupBy("name").agg(d.alias("d")).join(same, "name")


def quintile(by: list[str], x: str, tie: str, k: int = 5) -> Column:
    """Rank-based group 1..k with exact edges (ties by key)."""
    r = F.row_number().over(W.partitionBy(*by).orderBy(x, tie)) if by else F.row_number().over(W.orderBy(x, tie))
    n = F.count("*").over(W.partitionBy(*by) if by else W.partitionBy(F.lit(1)))
    return (F.floor((r - 1) * k / n) + 1).cast("int")


def conditional_grid(df: DataFrame, a: str, b: str, y: str, key: str) -> DataFrame:
    """Mean of y over quintile-by-quintile cells; quintiles are taken inside each month, so no window spans the whole table."""
    q = df.select(quintile(["month"], a, key).alias("qa"), quintile(["month"], b, key).alias("qb"), y)
    return q.groupBy("qa", "qb").agg(F.count("*").alias("n"), F.avg(y).alias("mean"))


def magnitude_buckets(df: DataFrame, p: str, y: str, edges=(0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Sign accuracy, correlation and share of the inner product by half-open buckets of |y|."""
    e = quantiles(df, {"e": (F.abs(y), list(edges))})
    b = df.join(F.broadcast(e)).withColumn("bucket", F.size(F.filter("e", lambda v: v <= F.abs(F.col(y)))))
    out = b.groupBy("bucket").agg(F.count("*").alias("n"), F.avg(F.when(F.signum(p) == F.signum(y), 1.0).otherwise(0.0)).alias("sign_accuracy"), correlation(p, y).alias("corr"), F.sum(F.col(p) * F.col(y)).alias("inner"))
    return out.withColumn("share", F.try_divide(F.col("inner"), F.sum("inner").over(W.partitionBy(F.lit(1))))).drop("inner")


def monthly_mean_diagnostics(months: DataFrame, x: str = "mean", lags=tuple(range(1, 13))) -> DataFrame:
    """Autocorrelation, sign persistence and trend of at most a few hundred monthly means, and how many standard errors (column se) they are from zero."""
    w = W.orderBy("month")
    m = months.withColumns({f"l{k}": F.lag(x, k).over(w) for k in lags})
    keep = F.avg(F.when(F.signum(x) == F.signum("l1"), 1.0).otherwise(0.0))
    same = m.where("l1 is not null").agg(keep.alias("persistence"))
    out = m.agg(*[correlation(x, f"l{k}").alias(f"acf_{k}") for k in lags], F.regr_slope(F.col(x), F.col("month").cast("double")).alias("slope"), F.avg(F.abs(x)).alias("mean_abs"), F.avg(F.try_divide(F.abs(x), F.col("se"))).alias("mean_abs_se"))
    return out.join(F.broadcast(same))


def gate(df: DataFrame, base: str, cand: str, y: str, least: float = 0.0, worst: float = -1.0) -> DataFrame:
    """Boolean rules over the monthly difference of two predictions."""
    m = df.groupBy("month").agg((cosine(cand, y) - cosine(base, y)).alias("delta"))
    return m.agg((F.avg("delta") > least).alias("mean_up"), (F.percentile("delta", 0.5) > least).alias("median_up"), (F.min("delta") > worst).alias("no_bad_month"), (F.avg(F.when(F.col("delta") > 0, 1.0).otherwise(0.0)) >= 0.5).alias("mostly_up"))


def null_audit(df: DataFrame, cols: list[str], extreme: float = 1e6) -> DataFrame:
    """Per column: nulls, NaNs, infinities, extremes, distinct count capped at constant or not."""
    def one(c):
        v = F.col(c).cast("double")
        return F.struct(F.lit(c).alias("name"), F.count_if(v.isNull()).alias("nulls"), F.count_if(F.isnan(v)).alias("nans"), F.count_if(F.abs(v) == float("inf")).alias("infinite"), F.count_if(F.abs(v) > extreme).alias("extreme"), (F.min(v) == F.max(v)).alias("constant")).alias(f"s_{c}")

    wide = df.agg(*[one(c) for c in cols])
    return wide.select(F.explode(F.array(*[F.col(f"s_{c}") for c in cols])).alias("r")).select("r.*")


def spacing(df: DataFrame, x: str, by: str) -> DataFrame:
    """Gaps between neighbouring distinct values per group, and how often each occurs."""
    d = df.select(by, x).distinct()
    gap = F.round(F.col(x) - F.lag(x).over(W.partitionBy(by).orderBy(x)), 6)
    return d.withColumn("gap", gap).where("gap is not null").groupBy("gap").agg(F.count("*").alias("n"))


def orthogonal_residual(df: DataFrame, a: str, b: str, by: str) -> DataFrame:
    """What b adds to a: per group the slope and intercept of b on a, and the residual's deviation."""
    s = df.groupBy(by).agg(F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.stddev_pop(b).alias("sb"), F.coalesce(correlation(a, b), F.lit(0.0)).alias("r"), F.count("*").alias("n"))
    return s.select(by, "n", "slope", "intercept", (F.col("sb") * F.sqrt(F.greatest(1 - F.col("r") * F.col("r"), F.lit(0.0)))).alias("residual_std"))
