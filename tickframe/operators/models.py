"""Learners in the month protocol: residual models with frozen blends, ensembles, size gates, domain checks and ablations.  Learners are Spark ML estimators made by a
factory (features column, label column) -> Estimator; nothing is gathered on the driver but metrics."""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.protocol import NESTED, NESTED_MONTHS, splits, tag_roles
from ..session import scratch_path
from .blend import apply_alpha, fit_alpha, residual_view
from .checks import content_hash, name_hash
from .metrics import auc, cosine
from .order import quantiles

Factory = Callable[[str, str], Estimator]


def boosted(iterations: int = 5, depth: int = 3) -> Factory:
    return lambda features, label: GBTRegressor(featuresCol=features, labelCol=label, maxIter=iterations, maxDepth=depth, seed=7)


def linear(lam: float = 0.01) -> Factory:
    return lambda features, label: LinearRegression(featuresCol=features, labelCol=label, regParam=lam)


class CosineEvaluator(Evaluator):
    """Uncentred cosine of a prediction column with the label, for Spark ML tuning."""

    def __init__(self, prediction: str = "prediction", label: str = "target"):
        super().__init__()
        self.prediction, self.label = prediction, label

    def _evaluate(self, dataset: DataFrame) -> float:
        return float(dataset.agg(cosine(self.prediction, self.label)).head()[0])

    def isLargerBetter(self) -> bool:
        return True


def with_vector(df: DataFrame, features: list[str], name: str = "x") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=name, handleInvalid="keep").transform(df.fillna(0.0, features))


def fitted(train: DataFrame, apply: DataFrame, features: list[str], label: str, factory: Factory, name: str) -> DataFrame:
    """Rows of `apply` with the prediction of a learner fitted on `train`."""
    return predicted(factory("x", label).fit(with_vector(train, features)), apply, features, name)


def predicted(model: Model, rows: DataFrame, features: list[str], name: str) -> DataFrame:
    return model.transform(with_vector(rows, features)).withColumnRenamed("prediction", name).drop("x")


class Stopped:
    """Boosted trees whose number is found on held rows and then kept.  `choose` fits up to `most` trees; by "error" the fit itself stops at the first tree that does not lower the held rows' squared error
    (`validationIndicatorCol`); by "cosine" all are fitted and the number with the best cosine on the held rows wins (to nine digits, fewer trees first)."""

    def __init__(self, most: int = 20, depth: int = 3, step: float = 0.1, by: str = "error"):
        if by not in ("error", "cosine"):
            raise ValueError(f"unknown rule: {by}")
        self.most, self.depth, self.step, self.by = most, depth, step, by

    def __call__(self, features: str, label: str, trees: int | None = None) -> Estimator:
        return GBTRegressor(featuresCol=features, labelCol=label, maxIter=trees or self.most, maxDepth=self.depth, stepSize=self.step, seed=7)

    def choose(self, train: DataFrame, held: DataFrame, features: list[str], label: str) -> int:
        return self.chosen(train, held, features, label)[0]

    def chosen(self, train: DataFrame, held: DataFrame, features: list[str], label: str) -> tuple[int, Model | None]:
        """The number of trees, and the model of so many trees on `train` if the search has fitted it."""
        est = self("x", label)
        if self.by == "cosine":
            curve = staged_cosines(est.fit(with_vector(train, features)), with_vector(held, features), label)
            return max(range(len(curve)), key=lambda i: (round(curve[i], 9), -i)) + 1, None
        both = train.withColumn("__held", F.lit(False)).unionByName(held.withColumn("__held", F.lit(True)))
        est.setValidationIndicatorCol("__held").setParams(validationTol=0.0)
        model = est.fit(with_vector(both, features))
        return model.getNumTrees, model

    def fixed(self, trees: int) -> Factory:
        return lambda features, label: self(features, label, trees)


def staged_cosines(model, rows: DataFrame, y: str) -> list[float]:
    """Cosine with y of the first 1, 2, ... trees of a boosted model, all from one pass over the rows."""
    sums, total = [], F.lit(0.0)
    for i, (tree, weight) in enumerate(zip(model.trees, model.treeWeights, strict=True)):
        rows = tree.setFeaturesCol("x").setPredictionCol(f"__t{i}").transform(rows)
        total = total + F.lit(float(weight)) * F.col(f"__t{i}")
        sums.append(cosine(total, y).alias(f"c{i}"))
    return [float(c) for c in rows.agg(*sums).head()]


def residual_protocol(df: DataFrame, split: str, base: str, features: list[str], y: str, factory: Factory, alphas, table=NESTED, fits: dict | None = None) -> DataFrame:
    """One outer split: a learner of the residual fitted on the inner train months, alpha chosen on the tune months, refitted on all months before the outer ones, which come back with
    `residual_pred`, `blend` (frozen alpha and scales) and `alpha`.  A learner that is stopped (`Stopped`) finds its number of trees on the tune months' residuals (of the inner beta) and keeps it in
    the refit; the outer rows then have `trees` too.  Outer targets are looked at by nothing here.  Calls that differ in the split alone may share a dict `fits`: splits with the same months before
    the outer ones (T3 and T4) are then fitted once.  Rows are read once a fit, so store what is costly."""
    mine = [r for r in table if r[0] == split]
    splits(df.sparkSession, mine)
    ranges = {r[1]: (r[2], r[3]) for r in mine}
    rest = [c for c in df.columns if c != "month"]
    role = lambda name: df.where(F.col("month").between(*ranges[name])).select("month", *rest, F.lit(split).alias("split"))
    key = (tuple(features), *(ranges[k] for k in ("inner_train", "inner_tune", "refit_train")))
    fits = {} if fits is None else fits
    if key not in fits:
        fits[key] = _residual_fit(role, base, features, y, factory, alphas)
    model, state, trees = fits[key]
    outer = predicted(model, role("outer_valid"), features, "residual_pred")
    out = apply_alpha(outer, state, base, "residual_pred", [])
    return out if trees is None else out.withColumn("trees", F.lit(trees))


def _residual_fit(role, base: str, features: list[str], y: str, factory: Factory, alphas) -> tuple[Model, DataFrame, int | None]:
    """The refitted learner, a row of alpha and scales, and the number of trees."""
    target = lambda d: residual_view(d, base, y, F.lit(True))
    inner, held, trees, model = role("inner_train"), role("inner_tune"), None, None
    if isinstance(factory, Stopped):
        seen = residual_view(inner.withColumn("__fit", F.lit(True)).unionByName(held.withColumn("__fit", F.lit(False))), base, y, F.col("__fit"))
        trees, model = factory.chosen(seen.where("__fit").drop("__fit"), seen.where("not __fit").drop("__fit"), features, "residual")
        factory = factory.fixed(trees)
    model = model or factory("x", "residual").fit(with_vector(target(inner), features))
    best = fit_alpha(predicted(model, held, features, "residual_pred"), base, "residual_pred", y, [], alphas).select("alpha", "ka", "kb")
    found = best.head()
    state = inner.sparkSession.range(1).select(*[F.lit(found[c]).cast("double").alias(c) for c in best.columns]) if found else best
    return factory("x", "residual").fit(with_vector(target(role("refit_train")), features)), state, trees


def outer_summary(outers: dict[str, DataFrame], base: str, y: str) -> DataFrame:
    """(split, n, alpha, base, blend, delta) of each outer split's rows, and the number of trees of a stopped learner."""
    more = lambda d: [F.first("trees").alias("trees")] if "trees" in d.columns else []
    one = lambda k, d: d.agg(F.count("*").alias("n"), F.first("alpha").alias("alpha"), *more(d), cosine(base, y).alias("base"), cosine("blend", y).alias("blend")).select(F.lit(k).alias("split"), "*", (F.col("blend") - F.col("base")).alias("delta"))
    return reduce(DataFrame.unionByName, [one(k, d) for k, d in outers.items()])


def outer_gate(summary: DataFrame, least_mean: float = 0.0005) -> DataFrame:
    """Does no outer split lose, and is the mean gain enough?"""
    up, mean = F.min("delta") >= 0, F.avg("delta")
    return summary.agg(up.alias("none_degrades"), mean.alias("mean_delta"), (mean >= least_mean).alias("enough"), (up & (mean >= least_mean)).alias("passed"))


def domain_check(df: DataFrame, features: list[str], late: Column, held: Column, groups: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """Can early and late rows be told apart?  AUC on held rows of a logistic regression on standardised features fitted on the others, and each feature group's share of the
    absolute weights."""
    rows = with_vector(df.withColumns({"late": late.cast("double"), "held": held}), features, "raw")
    train = rows.where(~F.col("held"))
    scaler = StandardScaler(inputCol="raw", outputCol="x", withMean=True).fit(train)
    model = LogisticRegression(featuresCol="x", labelCol="late", regParam=0.01, maxIter=20).fit(scaler.transform(train))
    scored = model.transform(scaler.transform(rows.where("held"))).withColumn("score", F.round(vector_to_array("rawPrediction")[1], 9))
    weight = {f: abs(float(w)) for f, w in zip(features, model.coefficients, strict=True)}
    total = sum(weight.values()) or 1.0
    shares = df.sparkSession.createDataFrame([(g, sum(weight[f] for f in fs) / total) for g, fs in groups.items()], "name string, share double")
    return auc(scored, "score", F.col("late") > 0, []), shares


def ablations(run: Callable[[list[str]], DataFrame], groups: dict[str, list[str]], base: str, y: str) -> DataFrame:
    """(left_out, blend, delta): the run on all features, and without each group."""
    every = [f for fs in groups.values() for f in fs]
    runs = {"none": every, **{g: [f for f in every if f not in fs] for g, fs in groups.items()}}
    return outer_summary({k: run(f) for k, f in runs.items() if f}, base, y).withColumnRenamed("split", "left_out")


def ensemble(train: DataFrame, apply: DataFrame, features: list[str], y: str, members: dict[str, tuple[float, Factory]]) -> DataFrame:
    """Rows with the prediction of every learner and their fixed blend."""
    out = apply
    for name, (_, factory) in members.items():
        out = fitted(train, out, features, y, factory, name)
    return out.withColumn("blend", sum((w * F.col(k) for k, (w, _) in members.items()), F.lit(0.0)))


def ensemble_protocol(df: DataFrame, split: str, features: list[str], y: str, members: dict[str, tuple[float, Factory]], table=NESTED) -> tuple[DataFrame, dict[str, int]]:
    """One outer split of an ensemble: learners that are stopped find their number of trees on the tune months after a fit on the inner train months; all are refitted on the months before the
    outer ones, whose rows come back with every prediction and the blend.  Also the numbers found."""
    rows = tag_roles(df, splits(df.sparkSession, [r for r in table if r[0] == split]))
    role = lambda name: rows.where(F.col("role") == name).drop("role")
    found = {k: f.choose(role("inner_train"), role("inner_tune"), features, y) for k, (_, f) in members.items() if isinstance(f, Stopped)}
    fixed = {k: (w, f.fixed(found[k]) if k in found else f) for k, (w, f) in members.items()}
    return ensemble(role("refit_train"), role("outer_valid"), features, y, fixed), found


RUN = "frame string, split string, features int, feature_hash string, rows_hash string, n long, alpha double, base double, blend double, delta double"


def run_candidates(rows: DataFrame, frames: dict[str, DataFrame], base: str, y: str, factory: Factory, alphas, outers=tuple(NESTED_MONTHS), store: str | None = None) -> DataFrame:
    """The residual protocol over feature frames (sample_id and features; month and target are taken from `rows`) and outer splits: a row a run with the hash of the ordered feature names and of the rows that it
    saw.  With `store` each finished run is kept there, and a run with the same frame, split and hashes is read instead of repeated, so that a broken series goes on where it ended."""
    spark = rows.sparkSession
    done = {}
    if store is not None:
        try:
            done = {(r.frame, r.split, r.feature_hash, r.rows_hash): r for r in spark.read.schema(RUN).parquet(store).collect()}  # a row a run
        except AnalysisException:  # nothing there yet
            done = {}
    out = []
    for name, table in frames.items():
        features = [c for c in table.columns if c not in ("sample_id", "month", "target")]
        path = scratch_path(spark)
        rows.join(table.select("sample_id", *features), "sample_id").write.parquet(path)  # fits read it many times
        data = spark.read.parquet(path)
        fits: dict = {}
        key = name_hash(features), str(content_hash(data.select(*sorted(data.columns))).head().hash)
        for split in outers:
            if (name, split, *key) not in done:
                s = outer_summary({split: residual_protocol(data, split, base, features, y, factory, alphas, NESTED, fits)}, base, y).head()
                run = spark.createDataFrame([(name, split, len(features), *key, s.n, s.alpha, s.base, s.blend, s.delta)], RUN)
                if store is not None:
                    run.write.mode("append").parquet(store)
                done[name, split, *key] = run.head()
            out.append(done[name, split, *key])
    return spark.createDataFrame(out, RUN)


def importances(train: DataFrame, features: list[str], y: str, trees: int = 10) -> list[tuple[str, float]]:
    """Features with their share of a boosted fit's gain, largest first (ties by name)."""
    model = boosted(trees)("x", y).fit(with_vector(train, features))
    return sorted(zip(features, map(float, model.featureImportances.toArray()), strict=True), key=lambda x: (-round(x[1], 9), x[0]))


def count_curve(run: Callable[[list[str]], DataFrame], ranked: list[tuple[str, float]], counts, base: str, y: str) -> DataFrame:
    """(features, n, alpha, base, blend, delta): the run on the first k features by importance, for each k of `counts`; and under 0 on those with any importance at all (the pruned set)."""
    names = [f for f, _ in ranked]
    sets = {k: names[:k] for k in counts if 0 < k <= len(names)} | {0: [f for f, x in ranked if x > 0] or names[:1]}
    out = [outer_summary({str(len(f)): run(f)}, base, y).withColumns({"features": F.lit(k), "used": F.lit(len(f))}).drop("split") for k, f in sets.items()]
    return reduce(DataFrame.unionByName, out)


def size_gate(train: DataFrame, apply: DataFrame, pred: str, features: list[str], y: str, factory: Factory, power: float = 0.5) -> DataFrame:
    """Rows with `size` (a learner of log |y|, back on the scale of y) and `gated`: the prediction times (size / median size of the training rows) ^ power."""
    t = train.withColumn("log_size", F.ln(F.abs(y) + 1e-6))
    back = lambda d: d.withColumn("size", F.exp("log_size_pred"))
    mid = quantiles(back(fitted(t, t, features, "log_size", factory, "log_size_pred")), {"mid": ("size", 0.5)})
    out = back(fitted(t, apply, features, "log_size", factory, "log_size_pred")).join(F.broadcast(mid))
    return out.withColumn("gated", F.col(pred) * F.pow(F.col("size") / F.col("mid"), power)).drop("mid")
