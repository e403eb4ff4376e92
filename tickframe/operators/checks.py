"""Contract checks: each returns a small frame (check, violations); `enforce` raises on any."""
from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import finite


def _one(df: DataFrame, name: str, bad: Column) -> DataFrame:
    return df.agg(F.coalesce(F.sum(bad.cast("long")), F.lit(0)).cast("long").alias("violations")).select(F.lit(name).alias("check"), "violations")


def required_columns(df: DataFrame, names) -> list[str]:
    return sorted(set(names) - set(df.columns))


def unique_key(df: DataFrame, *key: str) -> DataFrame:
    return _one(df.groupBy(*key).count(), "unique_" + "_".join(key), F.col("count") > 1)


def finite_values(df: DataFrame, *cols: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [_one(df, f"finite_{c}", ~finite(c)) for c in cols])


def code_domain(df: DataFrame, col: str, codes=(0, 1)) -> DataFrame:
    return _one(df, f"domain_{col}", F.coalesce(~F.col(col).isin(*codes), F.lit(True)))


def contained(df: DataFrame, spine: DataFrame, key: str = "sample_id") -> DataFrame:
    """Ids that the spine does not have."""
    return _one(df.select(key).distinct().join(spine, key, "left_anti"), "contained", F.lit(True))


def month_coverage(df: DataFrame, lo: int, hi: int) -> DataFrame:
    """Months of the range that are missing, and months outside it."""
    want = df.sparkSession.range(lo, hi + 1).select(F.col("id").cast("int").alias("month"))
    have = df.select("month").distinct()
    gone = want.join(have, "month", "left_anti").select(F.lit("month_missing").alias("c"))
    extra = have.join(want, "month", "left_anti").select(F.lit("month_extra").alias("c"))
    both = gone.union(extra)
    return both.agg(*[F.count_if(F.col("c") == k).alias(k) for k in ("month_missing", "month_extra")]).select(F.expr("stack(2, 'month_missing', month_missing, 'month_extra', month_extra) as (check, violations)"))


def aligned(a: DataFrame, b: DataFrame, key: str, cols) -> DataFrame:
    """Rows that only one side has, and rows whose values differ."""
    x = a.select(key, *[F.col(c).alias(f"{c}_a") for c in cols], F.lit(True).alias("in_a"))
    y = b.select(key, *[F.col(c).alias(f"{c}_b") for c in cols], F.lit(True).alias("in_b"))
    differ = reduce(lambda p, q: p | q, [~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")) for c in cols])
    return _one(x.join(y, key, "full"), "aligned", F.col("in_a").isNull() | F.col("in_b").isNull() | differ)


def coverage(wanted: DataFrame, have: DataFrame, key: str = "sample_id") -> DataFrame:
    """Wanted rows whose id the other table does not have."""
    return _one(wanted.select(key).join(have.select(key).distinct(), key, "left_anti"), "coverage", F.lit(True))


def row_counts(df: DataFrame, by: str, expected: DataFrame) -> DataFrame:
    """Groups whose number of rows differs from `expected` (by, n), on either side."""
    got = df.groupBy(by).agg(F.count("*").alias("got"))
    return _one(expected.join(got, by, "full"), "rows", ~F.col("n").eqNullSafe(F.col("got")))


def unequal(a: DataFrame, b: DataFrame, key: str, cols, atol: float = 1e-8, rtol: float = 1e-5) -> DataFrame:
    """Per shared column the rows of both tables whose values are not close (two NaNs or two nulls are)."""
    y = b.select(key, *[F.col(c).alias(f"{c}__b") for c in cols])
    met = a.join(y, key)

    def far(c):
        p, q = F.col(c), F.col(f"{c}__b")
        same = p.eqNullSafe(q) | (F.isnan(p) & F.isnan(q))
        return ~(same | F.coalesce(F.abs(p - q) <= atol + rtol * F.abs(q), F.lit(False)))

    return reduce(DataFrame.unionByName, [_one(met, f"equal_{c}", far(c)) for c in cols])


def manifest(have: DataFrame, want: DataFrame) -> DataFrame:
    """A table of artifacts (name, status, lo, hi) against the wanted ones (name, lo, hi): not complete, other months, unknown, missing."""
    met = have.join(want.select("name", F.col("lo").alias("wlo"), F.col("hi").alias("whi"), F.lit(True).alias("known")), "name", "full")
    is_, known = F.col("status").isNotNull(), F.col("known").isNotNull()
    out = [("status", is_ & (F.col("status") != "complete")), ("months", is_ & known & ((F.col("lo") != F.col("wlo")) | (F.col("hi") != F.col("whi")))), ("unknown", ~known), ("missing", ~is_)]
    return reduce(DataFrame.unionByName, [_one(met, f"manifest_{n}", bad) for n, bad in out])


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that two sections of a data set share, which should share none."""
    return _one(a.select(key).intersect(b.select(key)), "shared_ids", F.lit(True))


def name_hash(names) -> str:
    """Hash of an ordered list of feature names, to be stored beside a state and replayed on load."""
    return hashlib.sha256("\n".join(names).encode()).hexdigest()


def require_names(names, expected: str) -> None:
    if name_hash(names) != expected:
        raise ValueError("feature names or their order differ from the stored ones")


def content_hash(df: DataFrame) -> DataFrame:
    """Row count and order-insensitive sum of row hashes."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("hash"))


def enforce(*checks: DataFrame) -> None:
    bad = reduce(DataFrame.unionByName, checks).where("violations > 0").collect()
    if bad:
        raise ValueError("; ".join(f"{r['check']}: {r.violations}" for r in bad))
