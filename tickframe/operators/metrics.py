"""Evaluation metrics as aggregates: each also works by month, fold or bucket."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .order import quantiles, rank_correlations, value_ranks


def c_(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def cosine(p, y) -> Column:
    """Uncentred cosine; 0 if either norm is 0."""
    p, y = c_(p), c_(y)
    d = F.sum(p * p) * F.sum(y * y)
    return F.when(d > 0, F.sum(p * y) / F.sqrt(d)).otherwise(0.0)


def correlation(x, y) -> Column:
    """Aggregate: Pearson correlation over the rows that have both values; null, not an error, where there are none or one of the two does not vary.  A deviation of
    less than 1e-12 of the largest value is rounding, not variation."""
    x, y = c_(x).cast("double"), c_(y).cast("double")
    both = lambda v: F.when(x.isNotNull() & y.isNotNull(), v)
    sd = lambda v: F.when(F.stddev_pop(both(v)) > 1e-12 * F.max(F.abs(both(v))), F.stddev_pop(both(v)))
    r = F.nullif(F.try_divide(F.covar_pop(x, y), sd(x) * sd(y)), F.lit(float("nan")))
    return F.when(r > 1, 1.0).when(r < -1, -1.0).otherwise(r)


def centred(p, y) -> Column:
    """Centred cosine; 0 if either side does not vary."""
    return F.coalesce(correlation(p, y), F.lit(0.0))


def rms(x) -> Column:
    x = c_(x)
    return F.sqrt(F.avg(x * x))


def r2(p, y) -> Column:
    p, y = c_(p), c_(y)
    ss = F.sum(y * y) - F.sum(y) * F.sum(y) / F.count(y)
    return F.when(ss > 0, 1 - F.sum((y - p) * (y - p)) / ss).otherwise(0.0)


QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def distribution(df: DataFrame, x: str, *by: str) -> DataFrame:
    """Count, mean, population deviation, range and exact quantiles."""
    q = quantiles(df, {"q": (x, list(QUANTILES))}, list(by))
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(x).isNotNull() & ~F.isnan(x)).alias("finite"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    out = out.join(F.broadcast(q), list(by), "left") if by else out.join(F.broadcast(q))  # one row a group
    return out.select(*by, "n", "finite", "mean", "std", "lo", "hi", *[F.col("q")[i].alias(f"q{round(100 * v):02d}") for i, v in enumerate(QUANTILES)])


def spearman(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Rank correlation with average ranks, over the rows that have both values."""
    return rank_correlations(df, {"spearman": (a, b)}, by)


def auc(df: DataFrame, score: str, label: Column, by: list[str]) -> DataFrame:
    """Mann-Whitney area with average ranks; null where a class is missing.  Rows without score or label do not count.  Works on the distinct scores, so no task ranks all rows."""
    rows = df.select(*by, F.col(score).alias("score"), label.cast("long").alias("__y")).where("__y is not null")
    r = value_ranks(rows, "score", by, y=F.sum("__y"))
    n1, n = F.sum("y").cast("double"), F.sum("n").cast("double")
    return r.groupBy(*by).agg(F.when((n1 > 0) & (n1 < n), F.try_divide(F.sum(F.col("rank") * F.col("y")) - n1 * (n1 + 1) / 2, n1 * (n - n1))).alias("auc"))


def monthly(df: DataFrame, base: str, cand: str, y: str) -> DataFrame:
    """Cosines of a baseline and a candidate per month, with the sums they come from."""
    b, c, t = F.col(base), F.col(cand), F.col(y)
    return df.groupBy("month").agg(F.count("*").alias("n"), F.sum(b * t).alias("bt"), F.sum(c * t).alias("ct"), F.sum(b * b).alias("bb"), F.sum(c * c).alias("cc"), F.sum(t * t).alias("tt"), cosine(b, t).alias("base"), cosine(c, t).alias("cand")).withColumn("delta", F.col("cand") - F.col("base"))


def stability(months: DataFrame) -> DataFrame:
    """Share of positive months, worst, median, mean, slope over months, and the top three months' share of the gain."""
    w = W.orderBy(F.desc("delta"), "month")
    m = months.withColumn("k", F.row_number().over(w))
    gain = F.greatest(F.col("delta"), F.lit(0.0))
    return m.agg(F.avg(F.when(F.col("delta") > 0, 1.0).otherwise(0.0)).alias("positive"), F.min("delta").alias("worst"), F.percentile("delta", 0.5).alias("median"), F.avg("delta").alias("mean"), F.regr_slope(F.col("delta"), F.col("month").cast("double")).alias("slope"), F.try_divide(F.sum(F.when(F.col("k") <= 3, gain)), F.sum(gain)).alias("top3"))


def bootstrap(months: DataFrame, rounds: int = 5000, seed: int = 7) -> DataFrame:
    """Interval of the pooled cosine difference when months are drawn with replacement.  Draws come from an arithmetic generator, on month sums only."""
    w = W.orderBy("month")
    m = months.withColumn("i", F.row_number().over(w) - 1)
    n = m.count()
    spark = months.sparkSession
    draws = spark.range(rounds).withColumnRenamed("id", "b").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    x = (F.col("b") * 1103515245 + F.col("j") * 12345 + seed * 2654435761) % 2147483647
    draws = draws.select("b", ((x * 48271 % 2147483647) % n).alias("i"))
    got = draws.join(F.broadcast(m), "i").groupBy("b").agg(*[F.sum(c).alias(c) for c in ("bt", "ct", "bb", "cc", "tt")])
    cos = lambda a, b: F.when(F.col(b) * F.col("tt") > 0, F.col(a) / F.sqrt(F.col(b) * F.col("tt"))).otherwise(0.0)
    d = got.select((cos("ct", "cc") - cos("bt", "bb")).alias("d"))
    return d.agg(F.avg("d").alias("mean"), F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"), F.avg(F.when(F.col("d") > 0, 1.0).otherwise(0.0)).alias("positive"))


def state_conditioned(df: DataFrame, state: str, base: str, cand: str, y: str, inner: Column) -> DataFrame:
    """Quartile edges of the state from inner rows, cosine difference per bucket on the others."""
    edges = quantiles(df.where(inner), {"e": (state, [0.25, 0.5, 0.75])})
    out = df.where(~inner).join(F.broadcast(edges))
    bucket = F.size(F.filter("e", lambda e: e <= F.col(state)))
    return out.withColumn("bucket", bucket).groupBy("bucket").agg(F.count("*").alias("n"), (cosine(cand, y) - cosine(base, y)).alias("delta"))
