"""Order statistics of whole tables, without one task or one state that holds all rows: ranks and running sums over sorted ranges, exact quantiles by refined histograms."""
from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import scratch_path

#: Cells that a histogram cuts an interval into, and rows left in the sought intervals that are looked at value by value.
CELLS, FEW = 4096, 50_000


def running(df: DataFrame, by: list[str], order: list[str], what: str, name: str) -> DataFrame:
    """Rows with the sum of column `what` over all rows before them in their group, in an order without ties.  Rows go to sorted ranges, which may split a group; one row a range
    and group tells what comes before it."""
    spark = df.sparkSession
    path = scratch_path(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order).withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("__range", F.shiftright("__at", 33))
    own = rows.groupBy("__range", *by).agg(F.sum(what).alias("__own"))
    before = own.select(F.col("__range").alias("__r"), *[F.col(c).alias(f"__{c}") for c in by], (F.sum("__own").over(W.partitionBy(*by).orderBy("__range")) - F.col("__own")).alias("__before"))
    inside = F.sum(what).over(W.partitionBy("__range", *by).orderBy("__at")) - F.col(what)
    on = F.col("__range") == F.col("__r")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.withColumn(name, inside).join(before, on).withColumn(name, F.col(name) + F.col("__before")).select(*df.columns, name)


def value_ranks(df: DataFrame, x: str, by: list[str], **sums: Column) -> DataFrame:
    """(by, x, n, sums, rank): the distinct values that are not null, how often each occurs, aggregates over its rows and its average rank from 1.  A run of ties is one row, so it never
    crosses a range's border."""
    v = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in sums.items()])
    return running(v, by, [x], "n", "rank").withColumn("rank", F.col("rank") + (F.col("n") + 1) / 2)


def rank_correlations(df: DataFrame, pairs: dict[str, tuple[str, str]], by: list[str]) -> DataFrame:
    """(by, a column a pair): Spearman's correlation with average ranks over the rows where all columns have values; null where a side does not vary."""
    cols = sorted({c for p in pairs.values() for c in p})
    rows = df.select(*by, *cols).dropna(subset=cols)
    ranks = {c: value_ranks(rows, c, by) for c in cols}
    out = None
    for name, (a, b) in pairs.items():
        met = rows.groupBy(*by, a, b).agg(F.count("*").alias("__n"))
        for c, r in ((a, "__ra"), (b, "__rb")):
            side = ranks[c].select(*[F.col(k).alias(f"__{k}") for k in by], F.col(c).alias("__v"), F.col("rank").alias(r))
            on = F.col(c) == F.col("__v")
            for k in by:
                on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
            met = met.join(side, on).drop("__v", *[f"__{k}" for k in by])
        # average ranks have the mean (N + 1) / 2, so their sums of squares need no second look and keep their digits
        total = ranks[a].groupBy(*by).agg(((F.sum("n") + 1) / 2).alias("__mid"))
        met = met.join(total, by) if by else met.join(F.broadcast(total))  # one row
        n, x, y = F.col("__n"), F.col("__ra") - F.col("__mid"), F.col("__rb") - F.col("__mid")
        one = met.groupBy(*by).agg(F.try_divide(F.sum(n * x * y), F.sqrt(F.sum(n * x * x)) * F.sqrt(F.sum(n * y * y))).alias(name))
        out = one if out is None else (out.join(one, by, "full") if by else out.join(F.broadcast(one)))
    return out


def _log_cell(v: Column) -> Column:
    """A cell of half a power of two; cells ascend with v, and infinities have their own."""
    up = F.floor((F.least(F.greatest(F.log2(F.abs(v)), F.lit(-1100.0)), F.lit(1100.0)) + 1101) * 2).cast("int")
    return F.when(v == 0, 0).when(v > 0, up).otherwise(-up)


def order_statistics(long: DataFrame, keys: list[str], wanted) -> dict[tuple, tuple[int, dict[int, float]]]:
    """long(keys, v: double without nulls and NaN) -> per key (n, value of each rank from 0 that wanted(n) names), exactly.  Every pass counts cells, with their least and largest values, inside the
    intervals that hold a sought rank; the cells with sought ranks are the next pass's intervals, until they hold one value or few rows.  The state is CELLS rows a sought rank, whatever the table's
    size; an interval shrinks by CELLS a pass, so doubles need at most six."""
    spark = long.sparkSession
    kinds = [long.schema[k] for k in keys]
    counted = [F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")]
    cells = defaultdict(list)
    for r in long.groupBy(*keys, _log_cell(F.col("v")).alias("cell")).agg(*counted).collect():
        cells[tuple(r[k] for k in keys), 0].append((r.cell, r.n, r.lo, r.hi))
    size = defaultdict(int)
    for (key, _), found in cells.items():
        size[key] += sum(n for _, n, _, _ in found)
    out = {key: (n, {}) for key, n in size.items()}
    open_ = {(key, 0): (0, sorted(set(wanted(n)))) for key, n in size.items()}
    while True:
        nexts, left = [], 0
        for at, (before, ranks) in open_.items():
            for _, n, lo, hi in sorted(cells[at]):
                mine = [r for r in ranks if before <= r < before + n]
                if mine and lo == hi:
                    out[at[0]][1].update(dict.fromkeys(mine, lo))
                elif mine:
                    nexts.append((at[0], before, mine, lo, hi))
                    left += n
                before += n
        if not nexts:
            return out
        table = spark.createDataFrame([(*key, i, lo, hi) for i, (key, _, _, lo, hi) in enumerate(nexts)], ", ".join([f"`__{k.name}` {k.dataType.simpleString()}" for k in kinds] + ["i int", "lo double", "hi double"]))
        on = (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
        met = long.join(F.broadcast(table), on)  # a row a sought rank at most
        if left <= FEW:
            seen = defaultdict(list)
            for r in met.groupBy("i", "v").count().collect():
                seen[r.i].append((r.v, r["count"]))
            for i, (key, before, ranks, _, _) in enumerate(nexts):
                for v, n in sorted(seen[i]):
                    out[key][1].update({r: v for r in ranks if before <= r < before + n})
                    before += n
            return out
        cell = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * CELLS).cast("int"), F.lit(CELLS - 1))
        cells = defaultdict(list)
        for r in met.groupBy("i", cell.alias("cell")).agg(*counted).collect():
            cells[nexts[r.i][0], r.i].append((r.cell, r.n, r.lo, r.hi))
        open_ = {(key, i): (before, ranks) for i, (key, before, ranks, _, _) in enumerate(nexts)}


def quantiles(df: DataFrame, wanted: dict[str, tuple], by: list[str] = ()) -> DataFrame:
    """Exact linear quantiles, like the aggregate `percentile`, of {name: (column, share or list of shares)}: one row, or a row a group of `by` (few groups, such as months) that has values.  A list gives an array.
    Nulls and NaN do not count; no values give null."""
    by, names = list(by), list(wanted)
    shares = {k: p if isinstance(p, (list, tuple)) else [p] for k, (_, p) in wanted.items()}
    column = lambda c: (F.col(c) if isinstance(c, str) else c).cast("double")
    flat = df.select(*by, F.explode(F.array(*[F.struct(F.lit(i).alias("__q"), column(c).alias("v")) for i, (c, _) in enumerate(wanted.values())])).alias("x")).select(*by, "x.*")
    flat = flat.where(F.col("v").isNotNull() & ~F.isnan("v"))
    every = sorted({p for ps in shares.values() for p in ps})
    ranks = lambda n: [f(p * (n - 1)) for p in every for f in (math.floor, math.ceil)]
    found = order_statistics(flat, [*by, "__q"], ranks)

    def value(key, p):
        if key not in found:
            return None
        n, v = found[key]
        at = p * (n - 1)
        lo, hi = math.floor(at), math.ceil(at)
        return v[lo] if lo == hi or v[lo] == v[hi] else (hi - at) * v[lo] + (at - lo) * v[hi]

    groups = sorted({k[:-1] for k in found}, key=str) if by else [()]
    rows = []
    for g in groups:
        got = [[value((*g, i), p) for p in shares[k]] for i, k in enumerate(names)]
        rows.append((*g, *[(x if x[0] is not None else None) if isinstance(wanted[k][1], (list, tuple)) else x[0] for x, k in zip(got, names, strict=True)]))
    schema = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by] + [f"`{k}` {'array<double>' if isinstance(wanted[k][1], (list, tuple)) else 'double'}" for k in names]
    return df.sparkSession.createDataFrame(rows, ", ".join(schema))
