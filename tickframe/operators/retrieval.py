"""What is made of history-only nearest neighbours: means, support, local ridges, prototypes and experts."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .neighbours import knn  # noqa: F401


def neighbour_mean(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """Gaussian weights with the k-th distance as bandwidth; weighted mean of the neighbours' value.  values(b, v)."""
    h = F.max("dist").over(W.partitionBy("q"))
    w = F.exp(-0.5 * F.pow(F.col("dist") / F.greatest(h, F.lit(1e-12)), 2))
    got = pairs.withColumn("w", w).join(values, "b")
    return got.groupBy("q").agg(F.count("*").alias("k"), (F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("estimate"), F.min("dist").alias("nearest"))


def gram(df: DataFrame, x: list[str], y: str, by: list[str]) -> DataFrame:
    """Sums of products of columns (with an intercept) and of each with y, one row per group."""
    cols = [F.lit(1.0), *[F.col(c) for c in x]]
    out = [F.sum(cols[i] * cols[j]).alias(f"g_{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    return df.groupBy(*by).agg(*out, *[F.sum(c * F.col(y)).alias(f"h_{i}") for i, c in enumerate(cols)])


def ridge(df: DataFrame, x: list[str], y: str, lam: float, by: list[str], intercept: bool = True) -> DataFrame:
    """Coefficients per group: Gram sums in Spark, one small solve per group in an Arrow task; the intercept is not shrunk (without one it is 0)."""
    n = len(x) + 1
    names = ["intercept", *x]

    def solve(batches):
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                g = np.zeros((n, n))
                for i in range(n):
                    for j in range(i, n):
                        g[i, j] = g[j, i] = r[f"g_{i}_{j}"]
                g += lam * np.diag([0.0, *[1.0] * (n - 1)])
                h = np.array([r[f"h_{i}"] for i in range(n)])
                w = np.linalg.solve(g, h) if intercept else np.append(0.0, np.linalg.solve(g[1:, 1:], h[1:]))
                rows.append([*(r[c] for c in by), *w])
            yield pd.DataFrame(rows, columns=[*by, *names])

    g = gram(df, x, y, by)
    ddl = ", ".join([*(f"{c} {dict(g.dtypes)[c]}" for c in by), *(f"`{c}` double" for c in names)])
    return g.mapInPandas(solve, ddl)


def support(pairs: DataFrame, months: DataFrame) -> DataFrame:
    """How spread a query's neighbours are over months: entropy (natural log) and number of months.  months(b, month)."""
    n = pairs.join(months, "b").groupBy("q", "month").agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("q")))
    return p.groupBy("q").agg((-F.sum(F.col("p") * F.ln("p"))).alias("entropy"), F.count("*").alias("months"))


def local_ridge(pairs: DataFrame, values: DataFrame, x: list[str], y: str, lam: float) -> DataFrame:
    """Per query the weighted ridge coefficients over its neighbours (Gaussian weights as in neighbour_mean, no intercept).  values(b, x..., y).  The weighted
    sums are Spark aggregates; each query's small system is solved in an Arrow task."""
    h = F.max("dist").over(W.partitionBy("q"))
    got = pairs.withColumn("w", F.exp(-0.5 * F.pow(F.col("dist") / F.greatest(h, F.lit(1e-12)), 2))).join(values, "b")
    n = len(x)
    w = F.col("w")
    sums = got.groupBy("q").agg(*[F.sum(w * F.col(x[i]) * F.col(x[j])).alias(f"g_{i}_{j}") for i in range(n) for j in range(i, n)], *[F.sum(w * F.col(c) * F.col(y)).alias(f"h_{i}") for i, c in enumerate(x)])

    def solve(batches):
        for b in batches:
            g = np.zeros((len(b), n, n))
            for i in range(n):
                for j in range(i, n):
                    g[:, i, j] = g[:, j, i] = b[f"g_{i}_{j}"]
            g += lam * np.eye(n)
            beta = np.linalg.solve(g, b[[f"h_{i}" for i in range(n)]].to_numpy()[:, :, None])[:, :, 0] if len(b) else np.zeros((0, n))
            yield pd.DataFrame({"q": b["q"], **{c: beta[:, i] for i, c in enumerate(x)}})

    return sums.mapInPandas(solve, ", ".join(["q long", *(f"`{c}` double" for c in x)]))


def inverse_square_mean(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """Mean of the neighbours' value weighted by inverse squared distance.  values(b, v)."""
    w = 1 / F.pow(F.greatest("dist", F.lit(1e-6)), 2)
    return pairs.withColumn("w", w).join(values, "b").groupBy("q").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("estimate"))


def sq_dist(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def centres(df: DataFrame, k: int, dims: int, by: str, rounds: int = 5) -> DataFrame:
    """k-means per group (by, key, z): (by, c, z, n) after a fixed number of rounds from the k rows with the least hash of their key.  Every round is one pass
    with the centres (at most k a group) broadcast, and sums per centre: no group is gathered."""
    start = W.partitionBy(by).orderBy(F.xxhash64("key"), "key")
    at = df.withColumn("c", F.row_number().over(start) - 1).where(F.col("c") < k).select(by, "c", F.transform("z", lambda v: v.cast("double")).alias("z"), F.lit(0).cast("long").alias("n"))
    for _ in range(rounds):
        got = assigned(df, at, by).groupBy(by, "c").agg(F.array(*[F.avg(F.col("z")[i]) for i in range(dims)]).alias("z"), F.count("*").alias("n"))
        at = df.sparkSession.createDataFrame(got.toArrow())  # at most k rows a group
    return at


def assigned(df: DataFrame, at: DataFrame, by: str) -> DataFrame:
    """Rows with the nearest centre of their group in c (ties: the lesser c)."""
    near = at.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("c", F.col("z").alias("m")))).alias("__near"))
    got = df.join(F.broadcast(near), by).withColumn("d", F.transform("__near", lambda s: F.struct(F.round(F.aggregate(F.zip_with("z", s.m, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x), 9).alias("d"), s.c.alias("c"))))
    return got.withColumn("c", F.array_min("d").c).drop("__near", "d")


def prototypes(df: DataFrame, k: int, dims: int, rounds: int = 5) -> DataFrame:
    """df(key, month, z, v) -> b, month, z, v: per month at most k centres with the mean value of their rows."""
    at = centres(df, k, dims, "month", rounds)
    means = assigned(df, at, "month").groupBy("month", "c").agg(F.avg("v").alias("v"))
    return at.join(means, ["month", "c"]).select((F.col("month") * k + F.col("c")).cast("long").alias("b"), "month", "z", "v")


def expert_mixture(train: DataFrame, query: DataFrame, k: int, dims: int, x: list[str], y: str, lam: float, tau: float) -> DataFrame:
    """Ridge experts (no intercept) at k state centres, mixed for each query by exp(-d^2 / (2 tau^2)).  train(key, z, x..., y), query(q, z, x...) -> q, estimate."""
    rows = train.withColumn("all", F.lit(0))
    at = centres(rows, k, dims, "all")
    local = assigned(rows, at, "all")
    beta = ridge(local, x, y, lam, ["c"], intercept=False)
    gate = F.exp(-sq_dist("z", "m") / (2 * tau * tau))
    got = query.join(F.broadcast(at.select("c", F.col("z").alias("m"))))
    coef = beta.select("c", *[F.col(n).alias(f"beta_{n}") for n in x])
    got = got.join(F.broadcast(coef), "c").withColumns({"p": gate, "r": sum((F.col(n) * F.col(f"beta_{n}") for n in x), F.lit(0.0))})
    return got.groupBy("q").agg(F.coalesce(F.try_divide(F.sum(F.col("p") * F.col("r")), F.sum("p")), F.lit(0.0)).alias("estimate"))
