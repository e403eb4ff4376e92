"""Diagnostics of predictions, members, features and event times, as aggregates."""
from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.protocol import random_fold
from .audit import correlation_pairs
from .metrics import centred, correlation, cosine, distribution
from .order import quantiles, rank_correlations


def scale(x: str, method: str) -> Column:
    """Aggregate: raw (1), std (population) or rms scale of a column; a zero scale counts as 1."""
    v = F.col(x)
    s = {"raw": F.lit(1.0), "std": F.stddev_pop(v), "rms": F.sqrt(F.avg(v * v))}[method]
    return F.when(s > 0, s).otherwise(1.0)


def normalised(df: DataFrame, cols: list[str], method: str) -> DataFrame:
    """Columns divided by their scale."""
    state = df.agg(*[scale(c, method).alias(f"{c}__scale") for c in cols])
    return df.join(F.broadcast(state)).withColumns({c: F.col(c) / F.col(f"{c}__scale") for c in cols}).select(*df.columns)


def prediction_report(df: DataFrame, pred: str, reference: str, *by: str) -> DataFrame:
    """Distribution of a prediction and its correlation with a reference one."""
    corr = df.groupBy(*by).agg(centred(pred, reference).alias("reference_corr"))
    return distribution(df, pred, *by).join(corr, list(by))


def drift_report(df: DataFrame, x: str, late: Column) -> DataFrame:
    """Mean, mean shift, ratio of deviations and of the 99 % quantiles of |x|, late rows and early ones against the early ones."""
    stats = [F.avg(x).alias("m"), F.stddev_pop(x).alias("s")]
    rows = df.withColumn("late", late)
    q = quantiles(rows, {"q": (F.abs(x), 0.99)}, ["late"])
    both = rows.groupBy("late").agg(F.count("*").alias("n"), *stats).join(F.broadcast(q), "late", "left")
    ref = both.where(~F.col("late")).select(F.col("m").alias("m0"), F.col("s").alias("s0"), F.col("q").alias("q0"))
    return both.join(F.broadcast(ref)).select("late", "n", F.col("m").alias("mean"), (F.col("m") - F.col("m0")).alias("mean_shift"), F.try_divide("s", "s0").alias("std_ratio"), F.try_divide("q", "q0").alias("abs_p99_ratio"))


def associations(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Pearson and Spearman correlation of x with y and with |y|."""
    r = df.select(*by, F.col(x).alias("x"), F.col(y).alias("y"), F.abs(y).alias("ay"))
    plain = r.groupBy(*by).agg(correlation("x", "y").alias("pearson"), correlation("x", "ay").alias("pearson_abs"))
    ranked = rank_correlations(r, {"spearman": ("x", "y"), "spearman_abs": ("x", "ay")}, by)
    return plain.join(ranked, by, "left") if by else plain.join(F.broadcast(ranked))


def overlap_audit(df: DataFrame, new: list[str], known: list[str]) -> DataFrame:
    """Per new column the known one it correlates most with (ties: the lesser name)."""
    p = correlation_pairs(df, [*known, *new]).where(F.col("left").isin(known) & F.col("right").isin(new)).withColumn("corr", F.abs("corr"))
    best = F.max_by(F.struct("left", "corr"), F.struct("corr", -F.array_position(F.array(*[F.lit(k) for k in sorted(known)]), F.col("left"))))
    return p.groupBy(F.col("right").alias("name")).agg(best.alias("b")).select("name", F.col("b.left").alias("nearest"), F.col("b.corr").alias("overlap"))


def stratified_delta(df: DataFrame, activity: str, base: str, cand: str, y: str, cuts=(0.5, 0.9)) -> DataFrame:
    """Change of the cosine in strata of activity cut at exact quantiles."""
    e = quantiles(df, {"e": (activity, list(cuts))})
    s = df.join(F.broadcast(e)).withColumn("stratum", F.size(F.filter("e", lambda v: v <= F.col(activity))))
    return s.groupBy("stratum").agg(F.count("*").alias("n"), (cosine(cand, y) - cosine(base, y)).alias("delta"))


def unit_disagreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows with `disagreement`: a / |a| - b / |b|, the norms taken over all rows."""
    norm = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)))
    s = df.agg(norm(a).alias("__na"), norm(b).alias("__nb"))
    safe = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(1.0)
    return df.join(F.broadcast(s)).withColumn("disagreement", F.col(a) / safe("__na") - F.col(b) / safe("__nb")).drop("__na", "__nb")


def principal_shares(df: DataFrame, members: list[str], by: str) -> DataFrame:
    """Per group the variance shares of the members' principal axes (largest first) and the effective rank exp(entropy); k x k sums in Spark, one small
    eigenproblem a group in an Arrow task."""
    k = len(members)
    c = [F.col(m) for m in members]
    sums = df.groupBy(by).agg(F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(c)], *[F.sum(c[i] * c[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)])

    def solve(batches):
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                m = np.array([r[f"s{i}"] for i in range(k)]) / r["n"]
                g = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] / r["n"] for j in range(k)] for i in range(k)]) - np.outer(m, m)
                v = np.clip(np.sort(np.linalg.eigvalsh(g))[::-1], 0, None)
                p = v / max(v.sum(), 1e-12)
                out += [(r[by], i, float(x), float(np.exp(-(p * np.log(np.maximum(p, 1e-12))).sum()))) for i, x in enumerate(p)]
            yield pd.DataFrame(out, columns=[by, "axis", "share", "effective_rank"])

    return sums.mapInPandas(solve, f"{by} {dict(df.dtypes)[by]}, axis int, share double, effective_rank double")


def permutation_null(df: DataFrame, x: str, y: str, key: str, by: str, rounds: int = 10) -> DataFrame:
    """Squared correlation of x with y when y is dealt anew inside each group by a hash of the ids: (round, r2); round 0 is the true order."""
    w = W.partitionBy(by)
    place = df.select(by, F.col(x).alias("x"), F.row_number().over(w.orderBy(key)).alias("r"))
    true = df.agg(F.pow(correlation(x, y), 2).alias("r2")).select(F.lit(0).alias("round"), "r2")
    out = [true]
    for i in range(1, rounds + 1):
        dealt = df.select(by, F.col(y).alias("y"), F.row_number().over(w.orderBy(random_fold(key, 1000003, i), key)).alias("r"))
        out.append(place.join(dealt, [by, "r"]).agg(F.pow(correlation("x", "y"), 2).alias("r2")).select(F.lit(i).alias("round"), "r2"))
    return reduce(DataFrame.unionByName, out)


def missingness(df: DataFrame, cols: list[str], group: Column) -> DataFrame:
    """Share of nulls of each column in a group and outside it, and the difference."""
    flat = df.select(group.alias("g"), F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).isNull().cast("double").alias("gone")) for c in cols])).alias("x")).select("g", "x.*")
    a, b = F.avg(F.when(F.col("g"), F.col("gone"))), F.avg(F.when(~F.col("g"), F.col("gone")))
    return flat.groupBy("name").agg(a.alias("inside"), b.alias("outside"), (a - b).alias("difference"))


def against_best(scores: DataFrame, group: str, name: str, score: str, k: int) -> DataFrame:
    """The k best candidates of each group (ties: the lesser name) and how far each is behind the best."""
    w = W.partitionBy(group).orderBy(F.desc(score), name)
    return scores.withColumns({"rank": F.row_number().over(w), "behind": F.first(score).over(w) - F.col(score)}).where(F.col("rank") <= k)


def ablation(scores: DataFrame, group: str, score: str, full: str) -> DataFrame:
    """Per left-out feature group the mean score over folds and what it is against the full set's."""
    m = scores.groupBy(group).agg(F.avg(score).alias("mean"), F.count("*").alias("folds"))
    ref = m.where(F.col(group) == full).select(F.col("mean").alias("ref"))
    return m.join(F.broadcast(ref)).withColumn("change", F.col("mean") - F.col("ref")).drop("ref")


def event_density(events: DataFrame, width: int = 1) -> DataFrame:
    """Events and their share per bin of `width` seconds."""
    b = events.groupBy(F.floor(F.col("seconds_before_predict") / width).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return b.join(F.broadcast(b.agg(F.sum("n").alias("all")))).select("bin", "n", (F.col("n") / F.col("all")).alias("share"))


def interarrival(events: DataFrame, by: str, quantiles=(0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Per code the quantiles of the seconds between neighbouring events of a sample."""
    w = W.partitionBy("sample_id").orderBy(F.desc("seconds_before_predict"), "seq")
    gap = events.withColumn("gap", F.lag("seconds_before_predict").over(w) - F.col("seconds_before_predict"))
    q = gap.where("gap is not null").groupBy(by).agg(F.count("*").alias("n"), F.percentile("gap", F.array(*[F.lit(x) for x in quantiles])).alias("q"))
    return q.select(by, "n", *[F.col("q")[i].alias(f"p{round(100 * x)}") for i, x in enumerate(quantiles)])


def label_statistics(df: DataFrame, y: str, by: str) -> DataFrame:
    """Per group: count, mean, deviation, share of positives, quantiles of |y|, median absolute deviation, skewness, excess kurtosis, share of the squares that the largest
    1 % of |y| holds."""
    mid = df.groupBy(by).agg(F.avg(y).alias("__m"), F.percentile(y, 0.5).alias("__mid"), F.percentile(F.abs(y), 0.99).alias("__top"))
    v = F.col(y)
    r = df.join(F.broadcast(mid), by).withColumn("__d", v - F.col("__m"))
    m = lambda k: F.avg(F.pow("__d", F.lit(float(k))))
    q = F.percentile(F.abs(y), F.array(*[F.lit(x) for x in (0.5, 0.9, 0.99)]))
    top = F.try_divide(F.sum(F.when(F.abs(y) >= F.col("__top"), v * v).otherwise(0.0)), F.sum(v * v))
    out = r.groupBy(by).agg(F.count("*").alias("n"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"), F.avg((v > 0).cast("double")).alias("positive"), q.alias("q"), F.avg(F.abs(y)).alias("mean_abs"), F.percentile(F.abs(v - F.col("__mid")), 0.5).alias("mad"),
                            F.try_divide(m(3), F.pow(F.sqrt(m(2)), F.lit(3.0))).alias("skewness"), (F.try_divide(m(4), m(2) * m(2)) - 3.0).alias("kurtosis"), top.alias("top_share"))
    return out.select(*[c for c in out.columns if c != "q"], *[F.col("q")[i].alias(f"abs_p{p}") for i, p in enumerate((50, 90, 99))])
