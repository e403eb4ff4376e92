"""Fold-safe preprocessing: fit on training rows to a small state, apply to any rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.exprs import finite
from ..session import scratch_path
from .metrics import correlation
from .order import quantiles


def fit_robust(df: DataFrame, cols: list[str], half_range: bool = False) -> DataFrame:
    """One row: median and interquartile range of each column.  A zero range counts as 1, or with `half_range` as half of the whole range, if that is not 0."""
    q = quantiles(df, {c: (c, [0.0, 0.25, 0.5, 0.75, 1.0]) for c in cols})

    def width(c):
        iqr, half = F.col(c)[3] - F.col(c)[1], (F.col(c)[4] - F.col(c)[0]) / 2
        w = F.when(iqr > 0, iqr)
        return (w.when(half > 0, half) if half_range else w).otherwise(1.0)

    return q.select(*[x for c in cols for x in (F.col(c)[2].alias(f"{c}_med"), width(c).alias(f"{c}_iqr"))])


def apply_robust(df: DataFrame, state: DataFrame, cols: list[str], clip: float | None = None) -> DataFrame:
    """Centred and scaled columns; nulls take the median (0); `clip` bends them smoothly towards it."""
    z = {c: (F.coalesce(F.col(c), F.col(f"{c}_med")) - F.col(f"{c}_med")) / F.col(f"{c}_iqr") for c in cols}
    if clip:
        z = {c: v / F.sqrt(1 + (v / clip) * (v / clip)) for c, v in z.items()}
    return df.join(F.broadcast(state)).withColumns(z).select(*df.columns)


def fit_edges(df: DataFrame, cols: list[str], bins: int = 20) -> DataFrame:
    return quantiles(df, {f"{c}_edges": (c, [i / bins for i in range(1, bins)]) for c in cols})


def apply_edges(df: DataFrame, state: DataFrame, cols: list[str], bins: int = 20) -> DataFrame:
    """Bin of each value: interior edges not above it; nulls get bin `bins`."""

    def bin_of(c):
        return F.when(F.col(c).isNull(), bins).otherwise(F.size(F.filter(f"{c}_edges", lambda e: e <= F.col(c)))).cast("int")

    out = {c: bin_of(c) for c in cols}
    return df.join(F.broadcast(state)).withColumns(out).select(*df.columns)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Rows with their place 0, 1, 2, ... in an order without ties.  Rows go to sorted ranges; one row a range tells how many come before it."""
    spark = df.sparkSession
    path = scratch_path(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    before = rows.groupBy("__range").agg(F.count("*").alias("__n")).withColumn("__n", F.sum("__n").over(W.orderBy("__range")) - F.col("__n"))
    inside = F.row_number().over(W.partitionBy("__range").orderBy(*order)) - 1
    return rows.withColumn(name, inside).join(F.broadcast(before), "__range").withColumn(name, F.col(name) + F.col("__n")).drop("__range", "__n")


def fit_vocabulary(df: DataFrame, col: str, position: Column) -> DataFrame:
    """Codes in order of first appearance."""
    first = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.min(position).alias("p"))
    return numbered(first, ["p", col], "code").select(col, F.col("code").cast("int").alias("code"))


def apply_vocabulary(df: DataFrame, state: DataFrame, col: str) -> DataFrame:
    """Unknown values and nulls get the next code after the last."""
    n = state.agg(F.count("*").cast("int").alias("n"))
    return df.join(state, col, "left").join(F.broadcast(n)).withColumn("code", F.coalesce("code", "n")).drop("n")


def fit_standard(df: DataFrame, cols: list[str], bound: float = 1e6) -> DataFrame:
    x = lambda c: F.least(F.greatest(F.col(c), F.lit(-bound)), F.lit(bound))
    return df.agg(*[y for c in cols for y in (F.avg(x(c)).alias(f"{c}_mean"), (F.stddev_pop(x(c)) + 1e-6).alias(f"{c}_sd"))])


def apply_standard(df: DataFrame, state: DataFrame, cols: list[str], bound: float = 1e6, clip: float = 10.0) -> DataFrame:
    lim = lambda v, b: F.least(F.greatest(v, F.lit(-b)), F.lit(b))
    z = {c: lim((lim(F.col(c), bound) - F.col(f"{c}_mean")) / F.col(f"{c}_sd"), clip) for c in cols}
    return df.join(F.broadcast(state)).withColumns(z).select(*df.columns)


def correlated(df: DataFrame, cols: list[str], y: str, limit: float) -> DataFrame:
    """One row of flags: is the absolute correlation with y at least the limit (no correlation: no)?"""
    return df.agg(*[F.coalesce(F.abs(correlation(c, y)) >= limit, F.lit(False)).alias(f"{c}_high") for c in cols])


def fit_zscore(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean and population deviation (below 1e-10: 1) of each column."""
    sd = lambda c: F.when(F.stddev_pop(c) < 1e-10, 1.0).otherwise(F.stddev_pop(c))
    return df.agg(*[y for c in cols for y in (F.avg(c).alias(f"{c}_mean"), sd(c).alias(f"{c}_sd"))])


def apply_zscore(df: DataFrame, state: DataFrame, cols: list[str]) -> DataFrame:
    return df.join(F.broadcast(state)).withColumns({c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_sd") for c in cols}).select(*df.columns)


def unit_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """Each row divided by its norm over the columns (a zero row stays)."""
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0)))
    return df.withColumns({c: F.col(c) / F.when(norm > 0, norm).otherwise(1.0) for c in cols})


def fit_state(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column: 1 % and 99 % quantiles, and the median and interquartile range (1e-6 at least) of the values clipped to them."""
    q = quantiles(df, {f"{c}_q": (c, [0.01, 0.99]) for c in cols})
    clipped = df.join(F.broadcast(q)).select(*[f"{c}_q" for c in cols], *[F.least(F.greatest(F.col(c), F.col(f"{c}_q")[0]), F.col(f"{c}_q")[1]).alias(c) for c in cols])
    r = quantiles(clipped, {f"{c}_r": (c, [0.25, 0.5, 0.75]) for c in cols}).join(F.broadcast(q))
    out = lambda c: (F.col(f"{c}_q")[0].alias(f"{c}_lo"), F.col(f"{c}_q")[1].alias(f"{c}_hi"), F.col(f"{c}_r")[1].alias(f"{c}_med"), F.greatest(F.col(f"{c}_r")[2] - F.col(f"{c}_r")[0], F.lit(1e-6)).alias(f"{c}_iqr"))
    return r.select(*[y for c in cols for y in out(c)])


def apply_state(df: DataFrame, state: DataFrame, cols: list[str], bound: float = 5.0) -> DataFrame:
    """Clipped, centred, scaled, clipped again; what is not finite takes the median."""

    def z(c):
        v = F.when(finite(c), F.col(c)).otherwise(F.col(f"{c}_med"))
        v = (F.least(F.greatest(v, F.col(f"{c}_lo")), F.col(f"{c}_hi")) - F.col(f"{c}_med")) / F.col(f"{c}_iqr")
        return F.least(F.greatest(v, F.lit(-bound)), F.lit(bound))

    return df.join(F.broadcast(state)).withColumns({c: z(c) for c in cols}).select(*df.columns)


def scaling_choice(df: DataFrame, cols: list[str], limit: int = 100) -> DataFrame:
    """(name, values, kind): more than `limit` distinct values call for quantile bins, fewer for robust scaling."""
    wide = df.agg(*[F.countDistinct(c).alias(c) for c in cols])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("values")) for c in cols])).alias("r")
    return wide.select(rows).select("r.*").withColumn("kind", F.when(F.col("values") > limit, "quantile").otherwise("robust"))


def varying(df: DataFrame, cols: list[str]) -> DataFrame:
    """(name, kept): category columns with more than one value other than null."""
    wide = df.agg(*[(F.min(c) < F.max(c)).alias(c) for c in cols])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.coalesce(F.col(c), F.lit(False)).alias("kept")) for c in cols])).alias("r")).select("r.*")


def select_features(df: DataFrame, cols: list[str], y: str, low: float, high: float) -> DataFrame:
    """(name, corr, kept): columns whose absolute correlation with y reaches `low`; then, from the strongest pair of columns correlated by `high` or more down, the one that is
    weaker against y goes, unless one of the pair is gone already.  Nulls take the median between columns.  One pass for all correlations; only the table of
    pairs (columns squared) is looked at on the driver."""
    med = quantiles(df, {f"{c}__m": (c, 0.5) for c in cols})
    rows = df.join(F.broadcast(med)).select(y, *cols, *[F.coalesce(F.col(c), F.col(f"{c}__m")).alias(f"{c}__f") for c in cols])
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    zero = lambda c: F.abs(F.coalesce(c, F.lit(0.0)))
    got = rows.agg(*[zero(correlation(c, y)).alias(c) for c in cols], *[zero(correlation(f"{a}__f", f"{b}__f")).alias(f"{a}__{b}") for a, b in pairs]).head()
    keep = [c for c in cols if got[c] >= low]
    strong = sorted(((round(got[f"{a}__{b}"], 9), a, b) for a, b in pairs if a in keep and b in keep and got[f"{a}__{b}"] >= high), reverse=True)
    gone: set[str] = set()
    for _, a, b in strong:
        if a not in gone and b not in gone:
            gone.add(b if got[a] >= got[b] else a)
    return df.sparkSession.createDataFrame([(c, float(got[c]), c in keep and c not in gone) for c in cols], "name string, corr double, kept boolean")


def residual_codes(df: DataFrame, x: str, layers: int, k: int, rounds: int = 5) -> DataFrame:
    """Rows with code_0, code_1, ...: each layer's one-dimensional k-means code of what the layers before leave of x; centres start at exact quantiles, every round is
    one pass with k centres."""
    rest = df.withColumn("__rest", F.col(x).cast("double"))
    for layer in range(layers):
        start = quantiles(rest, {"m": ("__rest", [(i + 0.5) / k for i in range(k)])}).head().m
        mids = sorted(set(start))
        place = lambda mids: F.size(F.filter(F.array(*[F.lit((a + b) / 2) for a, b in zip(mids[:-1], mids[1:], strict=True)]).cast("array<double>"), lambda e: e <= F.col("__rest")))
        for _ in range(rounds):
            mids = sorted(r.m for r in rest.groupBy(place(mids).alias("c")).agg(F.avg("__rest").alias("m")).collect())  # k rows
        code = place(mids)
        rest = rest.withColumn(f"code_{layer}", code).withColumn("__rest", F.col("__rest") - F.get(F.array(*[F.lit(m) for m in mids]), F.col(f"code_{layer}")))
    return rest.withColumnRenamed("__rest", "left_over")
