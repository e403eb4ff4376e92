"""Out-of-fold predictions for production: frozen blends per rolling block, their assembly with leak checks, and what is frozen for production."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.protocol import ROLLING, splits, tag_roles
from .blend import apply_blend, sums
from .metrics import cosine, rms
from .order import quantiles

METHODS = ("raw", "std", "rms")


def production_state(fits: DataFrame, rows: DataFrame, a: str, b: str) -> DataFrame:
    """What is frozen for production: the most frequent method of the folds' fits (ties: METHODS order), their median weight, and the rms scales of both
    members over all out-of-fold rows."""
    order = F.array_position(F.array(*[F.lit(m) for m in METHODS]), F.col("method"))
    mode = fits.groupBy("method").agg(F.count("*").alias("k")).agg(F.min_by("method", F.struct(-F.col("k"), order)).alias("method"))
    weight = fits.agg(F.percentile("weight", 0.5).alias("weight"))
    return mode.join(weight).join(rows.agg(rms(a).alias("ka"), rms(b).alias("kb")))


def rolling_blocks(df: DataFrame, a: str, b: str, weight: float, table=ROLLING) -> DataFrame:
    """Every row of an outer block with `baseline_oof`: both members over their rms on the block's inner tune months, blended by a fixed weight, and the
    last month of its refit."""
    tagged = tag_roles(df, splits(df.sparkSession, table))
    safe = lambda c: F.when(c > 0, c).otherwise(1.0)
    scales = tagged.where("role = 'inner_tune'").groupBy("split").agg(safe(rms(a)).alias("ka"), safe(rms(b)).alias("kb"))
    ends = df.sparkSession.createDataFrame([(n, hi) for n, role, _, hi in table if role == "refit_train"], "split string, source_train_end int")
    state = scales.join(ends, "split").withColumn("weight", F.lit(float(weight)))
    out = apply_blend(tagged.where("role = 'outer_valid'"), state, a, b, ["split"])
    return out.withColumnRenamed("blend", "baseline_oof").drop("role")


def oof_checks(blocks: DataFrame, table=ROLLING) -> DataFrame:
    """(check, violations) of assembled blocks: rows not after their refit, repeated ids, non-finite values, months of the table without rows."""
    months = splits(blocks.sparkSession, [r for r in table if r[1] == "outer_valid"]).select(F.explode(F.sequence("lo", "hi")).alias("month"))
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = blocks.agg(F.count_if(F.col("month") <= F.col("source_train_end")).alias("leak"), F.count_if(bad("baseline_oof") | bad("target")).alias("not_finite"))
    twice = blocks.groupBy("sample_id").count().agg(F.count_if(F.col("count") > 1).alias("repeated"))
    gone = months.join(blocks.select("month").distinct(), "month", "left_anti").agg(F.count("*").alias("month_missing"))
    wide = rows.join(twice).join(gone)
    return wide.select(F.expr("stack(4, 'leak', leak, 'not_finite', not_finite, 'repeated', repeated, 'month_missing', month_missing) as (check, violations)"))


def frozen_step(df: DataFrame, anchor: str, member: str, y: str, block: str, alphas) -> DataFrame:
    """Weight of a member beside an anchor, tuned on each block and frozen on the next one; per block the change of the cosine."""
    from .blend import apply_alpha, fit_alpha

    state = fit_alpha(df, anchor, member, y, [block], alphas).withColumn(block, (F.col(block) + 1).cast("int")).select(block, "alpha", "ka", "kb")
    got = apply_alpha(df, state, anchor, member, [block])
    return got.groupBy(block).agg(F.first("alpha").alias("alpha"), (cosine("blend", y) - cosine(anchor, y)).alias("delta"))


def blend_report(df: DataFrame, anchor: str, member: str, weights) -> DataFrame:
    """Without labels: per weight the mean and deviation of (1 - w) anchor + w member, its rms distance from the anchor relative to the anchor's rms, and the factor
    and shift that bring it back to the anchor's mean and deviation; and the members' correlation."""
    s = sums(df.withColumn("__y", F.lit(0.0)), anchor, member, "__y", [])
    g = s.select("*", F.explode(F.array(*[F.lit(float(w)) for w in weights])).alias("w"))
    u, w, n = 1 - F.col("w"), F.col("w"), F.col("n")
    mean = (u * F.col("sa") + w * F.col("sb")) / n
    var = (u * u * F.col("aa") + 2 * u * w * F.col("ab") + w * w * F.col("bb")) / n - mean * mean
    ma, mb = F.col("sa") / n, F.col("sb") / n
    va, vb = F.col("aa") / n - ma * ma, F.col("bb") / n - mb * mb
    std = F.sqrt(F.greatest(var, F.lit(0.0)))
    moved = F.sqrt(w * w * F.greatest((F.col("aa") - 2 * F.col("ab") + F.col("bb")) / F.col("aa"), F.lit(0.0)))
    factor = F.when(std > 0, F.sqrt(va) / std).otherwise(1.0)
    corr = (F.col("ab") / n - ma * mb) / F.sqrt(va * vb)
    return g.select("w", mean.alias("mean"), std.alias("std"), moved.alias("moved"), factor.alias("factor"), (ma - factor * mean).alias("shift"), corr.alias("corr"))


def weight_scan(df: DataFrame, a: str, b: str, y: str, late: Column, weights) -> DataFrame:
    """Per weight of the blend (1 - w) a / rms(a) + w b / rms(b): cosine on rows that are not late, and how its mean and deviation differ on late rows.  Scales
    come from the rows that are not late."""
    s = sums(df.withColumn("__late", late), a, b, y, ["__late"])
    one = s.where(~F.col("__late")).select(*[F.col(c).alias(f"{c}0") for c in s.columns if c != "__late"])
    two = s.where("__late").select(*[F.col(c).alias(f"{c}1") for c in s.columns if c != "__late"])
    g = one.join(two).select("*", F.explode(F.array(*[F.lit(float(w)) for w in weights])).alias("w"))
    u = (1 - F.col("w")) / F.sqrt(F.col("aa0") / F.col("n0"))
    v = F.col("w") / F.sqrt(F.col("bb0") / F.col("n0"))
    square = lambda i: u * u * F.col(f"aa{i}") + 2 * u * v * F.col(f"ab{i}") + v * v * F.col(f"bb{i}")
    mean = lambda i: (u * F.col(f"sa{i}") + v * F.col(f"sb{i}")) / F.col(f"n{i}")
    std = lambda i: F.sqrt(F.greatest(square(i) / F.col(f"n{i}") - mean(i) * mean(i), F.lit(0.0)))
    score = (u * F.col("ay0") + v * F.col("by0")) / F.sqrt(square(0) * F.col("yy0"))
    return g.select("w", score.alias("score"), (mean(1) - mean(0)).alias("mean_shift"), F.try_divide(std(1), std(0)).alias("std_ratio"))


def fit_bin_gate(df: DataFrame, p: str, size: str, y: str, scales=(0.5, 0.75, 1.0, 1.25, 1.5), shrink: float = 0.01) -> DataFrame:
    """Scales g0..g3 of four quartile bins of a size estimate that maximise the cosine of the scaled prediction less shrink * sum (g - 1)^2, on a grid; the bins' sums
    are one pass.  One row: edges e, g0..g3, score."""
    edges = quantiles(df, {"e": (size, [0.25, 0.5, 0.75])})
    b = df.join(F.broadcast(edges)).select("e", F.size(F.filter("e", lambda v: v <= F.col(size))).alias("bin"), F.col(p).alias("p"), F.col(y).alias("y"))
    at = lambda i, v: F.coalesce(F.sum(F.when(F.col("bin") == i, v)), F.lit(0.0))
    s = b.groupBy("e").agg(*[at(i, F.col("p") * F.col("y")).alias(f"py{i}") for i in range(4)], *[at(i, F.col("p") * F.col("p")).alias(f"pp{i}") for i in range(4)], F.sum(F.col("y") * F.col("y")).alias("yy"))
    for i in range(4):
        s = s.withColumn(f"g{i}", F.explode(F.array(*[F.lit(x) for x in scales])))
    g = [F.col(f"g{i}") for i in range(4)]
    norm = sum((g[i] * g[i] * F.col(f"pp{i}") for i in range(4)), F.lit(0.0)) * F.col("yy")
    cos = F.when(norm > 0, sum((g[i] * F.col(f"py{i}") for i in range(4)), F.lit(0.0)) / F.sqrt(norm)).otherwise(0.0)
    s = s.withColumn("score", F.round(cos - shrink * sum(((x - 1) * (x - 1) for x in g), F.lit(0.0)), 9))
    best = F.min_by(F.struct("e", "g0", "g1", "g2", "g3", "score"), F.struct(-F.col("score"), "g0", "g1", "g2", "g3"))
    return s.agg(best.alias("r")).select("r.*")


def apply_bin_gate(df: DataFrame, state: DataFrame, p: str, size: str) -> DataFrame:
    """Rows with `gated`: the prediction times the scale of its bin."""
    scale = F.get(F.array("g0", "g1", "g2", "g3"), F.size(F.filter("e", lambda v: v <= F.col(size))))
    return df.join(F.broadcast(state.drop("score"))).withColumn("gated", F.col(p) * scale)


def power_gate(p: Column, size: Column, median: Column, alpha: float) -> Column:
    return p * F.pow(size / median, F.lit(alpha))


def softplus_gate(p: Column, share: Column, a: float, b: float) -> Column:
    """Scale softplus(a + b * share), share being the value's place (0 to 1) among the fitted ones."""
    return p * F.log1p(F.exp(a + b * share))


def place_among(edges: str, x: Column) -> Column:
    """Share of the sorted edges (an array column of quantiles) below x."""
    return F.size(F.filter(edges, lambda e: e < x)) / F.size(edges)


def top_shares(df: DataFrame, score: str, key: str, by: str, shares=(0.05, 0.1)) -> DataFrame:
    """Per group the rows of the highest and lowest shares by score: floor(n * share) rows (ties by key)."""
    n = F.count("*").over(W.partitionBy(by))
    up = F.row_number().over(W.partitionBy(by).orderBy(F.desc(score), key))
    down = F.row_number().over(W.partitionBy(by).orderBy(score, key))
    r = df.withColumns({"up": up, "down": down, "n": n})
    wide = F.explode(F.array(*[F.struct(F.lit(x).alias("share"), F.lit(side).alias("side")) for x in shares for side in ("top", "bottom")])).alias("k")
    r = r.select("*", wide).select(*r.columns, "k.*")
    inside = F.when(F.col("side") == "top", F.col("up")).otherwise(F.col("down")) <= F.floor(F.col("n") * F.col("share"))
    return r.where(inside).drop("up", "down", "n")
