"""Ridge regressions over folds from block sums, and what is read off them."""
from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..plans.protocol import splits, tag_roles
from .order import quantiles
from .retrieval import gram


def _solved(sums: DataFrame, x: list[str], lam: float, by: list[str], standard: bool) -> DataFrame:
    """Coefficients from rows of Gram sums: with `standard` a ridge of standardised columns without the mean of y, else ordinary with an intercept; and the
    share r2 of the variance of y that they explain on their own rows (needs yy)."""
    n = len(x) + 1

    def solve(batches):
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                g = np.array([[r[f"g_{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)], float)
                h, rows = np.array([r[f"h_{i}"] for i in range(n)], float), max(r["g_0_0"], 1)
                mu = g[0, 1:] / rows
                c, u = g[1:, 1:] - rows * np.outer(mu, mu), h[1:] - mu * h[0]
                if standard:
                    sd = np.sqrt(np.maximum(np.diag(c) / rows, 0)) + 1e-9
                    beta = np.linalg.solve(c / np.outer(sd, sd) + lam * np.eye(n - 1), u / sd) / sd
                    start = -float(beta @ mu)
                else:
                    beta = np.linalg.lstsq(c + lam * np.eye(n - 1), u, rcond=None)[0]
                    start = float(h[0] / rows - beta @ mu)
                total = r["yy"] - h[0] ** 2 / rows
                fit = float((2 * beta @ u - beta @ c @ beta) / total) if total > 0 else 0.0
                out.append([*(r[k] for k in by), start, *beta, fit])
            yield pd.DataFrame(out, columns=[*by, "intercept", *x, "r2"])

    kinds = dict(sums.dtypes)
    return sums.mapInPandas(solve, ", ".join([*(f"{k} {kinds[k]}" for k in by), "intercept double", *(f"`{c}` double" for c in x), "r2 double"]))


def _sums(df: DataFrame, x: list[str], y: str, by: list[str]) -> DataFrame:
    g = gram(df.withColumn("__y", F.col(y)), x, "__y", by)
    yy = df.groupBy(*by).agg(F.sum(F.col(y) * F.col(y)).alias("yy"))
    return g.join(yy, by) if by else g.join(yy)


def fold_ridge(train: DataFrame, x: list[str], y: str, fold: str, lam: float) -> DataFrame:
    """(fold, intercept, x..., r2): the ridge fitted on all other folds of `train`, from the sums of all folds less the fold's own; and one on all of them, with fold -1."""
    per = _sums(train, x, y, [fold])
    names = [c for c in per.columns if c != fold]
    total = per.agg(*[F.sum(c).alias(f"t_{c}") for c in names])
    rest = per.join(F.broadcast(total)).select(F.col(fold).cast("int").alias("fold"), *[(F.col(f"t_{c}") - F.col(c)).alias(c) for c in names])
    whole = total.select(F.lit(-1).alias("fold"), *[F.col(f"t_{c}").alias(c) for c in names])
    got = _solved(rest.unionByName(whole), x, lam, ["fold"], True)
    return train.sparkSession.createDataFrame(got.toArrow())  # one row a fold: solved once, however often it is used


def predicted(df: DataFrame, coefs: DataFrame, x: list[str], fold: str, name: str) -> DataFrame:
    """Rows with the prediction of their fold's coefficients."""
    c = coefs.select(F.col("fold").alias(fold), F.col("intercept").alias("__c"), *[F.col(k).alias(f"__{k}") for k in x])
    return df.join(F.broadcast(c), fold).withColumn(name, sum((F.col(k) * F.col(f"__{k}") for k in x), F.col("__c"))).drop("__c", *[f"__{k}" for k in x])


def oof_predictions(df: DataFrame, models: dict[str, list[str]], y: str, fold: str, lam: float) -> DataFrame:
    """Rows with one out-of-fold prediction a model."""
    return reduce(lambda d, m: predicted(d, fold_ridge(df, models[m], y, fold, lam), models[m], fold, m), models, df)


def innovations(df: DataFrame, drivers: list[str], value: str, fold: str, inner, lam: float, bound: float = 6.0) -> DataFrame:
    """Rows with `innovation`: what the drivers do not explain of a value, over the median absolute deviation of the inner rows' cross-fitted residuals, clipped to
    +-bound.  Inner rows are predicted by the other folds, all others by all inner rows."""
    train = df.where(inner)
    coefs = fold_ridge(train, drivers, value, fold, lam)
    rows = predicted(df.withColumn("__fold", F.when(inner, F.col(fold)).otherwise(-1).cast("int")), coefs, drivers, "__fold", "__p")
    rows = rows.withColumn("__r", F.col(value) - F.col("__p"))
    mid = quantiles(rows.where(inner), {"__mid": ("__r", 0.5)})
    mad = quantiles(rows.where(inner).join(F.broadcast(mid)), {"__mad": (F.abs(F.col("__r") - F.col("__mid")), 0.5)})
    z = F.col("__r") / F.when(F.col("__mad") > 0, F.col("__mad")).otherwise(1.0)
    return rows.join(F.broadcast(mad)).withColumn("innovation", F.least(F.greatest(z, F.lit(-bound)), F.lit(bound))).drop("__fold", "__p", "__r", "__mad")


def explained(df: DataFrame, sets: dict[str, list[str]], y: str) -> DataFrame:
    """(name, r2): share of the variance of y that an ordinary regression on each set of columns explains."""
    parts = [_solved(_sums(df, cols, y, []), cols, 0.0, [], False).select(F.lit(name).alias("name"), "r2") for name, cols in sets.items()]
    return reduce(DataFrame.unionByName, parts)


def sign_stability(df: DataFrame, x: list[str], y: str, by: str) -> DataFrame:
    """(name, months, agree): in how many groups the slope of y on each column has the sign of the slope over all rows."""
    flat = df.select(by, F.col(y).alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("x")) for c in x])).alias("s")).select(by, "y", "s.*")
    whole = flat.groupBy("name").agg(F.signum(F.covar_pop("x", "y")).alias("sign"))
    per = flat.groupBy("name", by).agg(F.signum(F.covar_pop("x", "y")).alias("own"))
    return per.join(F.broadcast(whole), "name").groupBy("name").agg(F.count("*").alias("months"), F.avg((F.col("own") == F.col("sign")).cast("double")).alias("agree"))


def forward_ridge(df: DataFrame, table, x: list[str], y: str, lam: float) -> DataFrame:
    """Rows of each split's score months with the prediction of a ridge on its train months."""
    tagged = tag_roles(df, splits(df.sparkSession, table))
    coefs = _solved(_sums(tagged.where("role = 'train'"), x, y, ["split"]), x, lam, ["split"], True).withColumnRenamed("split", "fold")
    return predicted(tagged.where("role = 'score'"), coefs, x, "split", "forward")
