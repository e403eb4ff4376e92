"""Context-shift diagnostic: how far context alone explains, in later months, what a base prediction leaves over; a ridge against boosted trees on forward splits."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import exprs as X
from ..plans.protocol import splits, tag_roles
from .blend import residual_view
from .linear import forward_ridge
from .metrics import bootstrap, centred, cosine, monthly, rms
from .models import Factory, fitted
from .order import quantiles


def forward_models(df: DataFrame, table: list[tuple], features: list[str], base: str, y: str, factory: Factory, alpha: float = 10.0) -> DataFrame:
    """Rows of each split's score months with `split`, `beta` (of the base on the train months), `residual`, and its predictions `ridge` (standardised columns, with the train months' mean)
    and `trees` (any learner), both fitted on the train months only.  Missing context is 0.  The loop is over the protocol's few splits; df is read several times for each, so pass a written table."""
    parts = []
    for name in sorted({r[0] for r in table}):
        own = [r for r in table if r[0] == name]
        rows = residual_view(tag_roles(df.fillna(0.0, features), splits(df.sparkSession, own)), base, y, F.col("role") == "train")
        train = rows.where("role = 'train'")
        level = train.agg(F.coalesce(F.avg("residual"), F.lit(0.0)).alias("__level"))
        ridge = forward_ridge(rows.drop("split", "role"), own, features, "residual", alpha).join(F.broadcast(level))
        ridge = ridge.withColumn("ridge", F.col("forward") + F.col("__level")).drop("forward", "__level", "role")
        parts.append(fitted(train, ridge, features, "residual", factory, "trees"))
    return reduce(DataFrame.unionByName, parts)


def forward_scores(rows: DataFrame, models: tuple[str, ...] = ("ridge", "trees")) -> DataFrame:
    """(split, model, n, cosine, improvement, rms, mean, std, agreement) of each split and of `all`: improvement is the share of the residual's mean square that the prediction removes
    (0 where there is none), agreement the correlation with the first model (0 where either does not vary)."""
    p, r, first = F.col("p"), F.col("residual"), F.col(models[0])
    flat = rows.select(F.explode(F.array("split", F.lit("all"))).alias("split"), "residual", *models)
    flat = flat.select("split", "residual", models[0], F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("p")) for m in models])).alias("s")).select("split", "residual", models[0], "s.*")
    zero = F.sum(r * r)
    return flat.groupBy("split", "model").agg(F.count("*").alias("n"), cosine(p, r).alias("cosine"), F.when(zero > 0, 1 - F.try_divide(F.sum((p - r) * (p - r)), zero)).otherwise(0.0).alias("improvement"), rms(p).alias("rms"), F.avg(p).alias("mean"), F.stddev_pop(p).alias("std"), centred(p, first).alias("agreement"))


def forward_gate(rows: DataFrame, model: str = "trees", rounds: int = 1000, least: float = 0.01, folds: int = 3, worst: float = -0.002) -> DataFrame:
    """One row: pooled cosine and its interval over resampled months, positive splits, worst split, whether all predictions are finite, and whether everything holds."""
    boot = bootstrap(monthly(rows.withColumn("__zero", F.lit(0.0)), "__zero", model, "residual"), rounds).select("low", "high")
    scores = forward_scores(rows, (model,))
    each = scores.where("split <> 'all'").agg(F.count_if(F.col("cosine") > 0).alias("positive_splits"), F.min("cosine").alias("worst_split"))
    whole = rows.agg(cosine(model, "residual").alias("cosine"), F.coalesce(F.min(X.finite(model)), F.lit(False)).alias("finite"))
    out = whole.join(F.broadcast(boot)).join(F.broadcast(each))  # one row each
    passed = (F.col("cosine") >= least) & (F.col("low") > 0) & (F.col("positive_splits") >= folds) & (F.col("worst_split") >= worst) & F.col("finite")
    return out.withColumn("passed", F.coalesce(passed, F.lit(False)))


def context_bias(df: DataFrame, rows: DataFrame, table: list[tuple], features: list[str], model: str = "trees") -> DataFrame:
    """(split, feature, quartile, n, actual, predicted, bias) of the score rows by the exact quartile edges of the split's train rows (a value on an edge belongs above it)."""
    train = tag_roles(df.fillna(0.0, features), splits(df.sparkSession, [r for r in table if r[1] == "train"]))
    edges = quantiles(train, {f: (f, [0.25, 0.5, 0.75]) for f in features}, ["split"])
    long = lambda d, *more: d.select("split", *more, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("v")) for f in features])).alias("s")).select("split", *more, "s.*")
    e = long(edges).withColumnRenamed("v", "edges")  # splits x features rows
    got = long(rows, "residual", model).join(F.broadcast(e), ["split", "feature"])
    quartile = F.size(F.filter("edges", lambda x: x <= F.col("v"))).cast("int")
    got = got.groupBy("split", "feature", quartile.alias("quartile")).agg(F.count("*").alias("n"), F.avg("residual").alias("actual"), F.avg(model).alias("predicted"))
    return got.withColumn("bias", F.col("actual") - F.col("predicted"))
