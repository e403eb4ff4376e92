"""Month-based evaluation protocol: split tables, role tags, sample weights, folds."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Month ranges of the outer splits, (name, role, first, last).
OUTER = [
    ("PSEUDO", "train", 0, 32), ("PSEUDO", "score", 33, 70), ("H2", "train", 0, 40), ("H2", "score", 51, 60),
    ("T3", "train", 0, 50), ("T3", "score", 51, 60), ("T4", "train", 0, 50), ("T4", "score", 61, 70)]
#: Nested splits, months of (inner train, inner tune, refit train, outer valid).
NESTED_MONTHS = {"PSEUDO": ((0, 20), (21, 32), (0, 32), (33, 70)), "H2": ((0, 30), (31, 40), (0, 40), (51, 60)), "T3": ((0, 40), (41, 50), (0, 50), (51, 60)), "T4": ((0, 40), (41, 50), (0, 50), (61, 70))}
ROLES = ("inner_train", "inner_tune", "refit_train", "outer_valid")
NESTED = [(name, role, lo, hi) for name, months in NESTED_MONTHS.items() for role, (lo, hi) in zip(ROLES, months, strict=True)]
#: Rolling blocks of ten months from month 21: each is scored by a refit on all months before it, tuned on the ten months before that.
ROLLING = [
    (f"R{m}_{m + 9}", role, lo, hi)
    for m in range(21, 71, 10)
    for role, lo, hi in (("inner_train", 0, m - 11), ("inner_tune", m - 10, m - 1), ("refit_train", 0, m - 1), ("outer_valid", m, m + 9))]
#: The last month whose out-of-fold rows an outer split may see.
VISIBLE_END = {name: months[2][1] for name, months in NESTED_MONTHS.items()}
#: Validation cuts, train up to the cut and score the rest up to month 70.
CUTS = [(f"CV{i + 1}", role, lo, hi) for i, cut in enumerate((50, 55, 60, 65)) for role, lo, hi in (("train", 0, cut), ("score", cut + 1, 70))]
#: The seven folds of the temporal matrix.
MATRIX_MONTHS = {"T1": (30, 31, 40), "T2": (40, 41, 50), "T3": (50, 51, 60), "T4": (50, 61, 70), "H1": (30, 41, 50), "H2": (40, 51, 60), "PSEUDO": (32, 33, 70)}
MATRIX = [(name, role, lo, hi) for name, (end, first, last) in MATRIX_MONTHS.items() for role, lo, hi in (("train", 0, end), ("score", first, last))]
#: Forward context folds: train from month 21 on, score the next ten months.
CONTEXT = [(f"C{m}_{m + 9}", role, lo, hi) for m in (31, 41, 51, 61) for role, lo, hi in (("train", 21, m - 1), ("score", m, m + 9))]


def visible_end(outer: str) -> int:
    if outer not in VISIBLE_END:
        raise KeyError(f"unknown outer split: {outer}")
    return VISIBLE_END[outer]


def splits(spark, rows=OUTER, before=(("train", "score"), ("inner_train", "inner_tune"), ("refit_train", "outer_valid"))) -> DataFrame:
    """Validated split table: ranges in order, and in each pair of roles of `before` no month of the first at or after one of the second."""
    for name, role, lo, hi in rows:
        if lo > hi:
            raise ValueError(f"{name} {role}: empty range")
    for name in {r[0] for r in rows}:
        ranges = {role: (lo, hi) for n, role, lo, hi in rows if n == name}
        for early, late in before:
            if early in ranges and late in ranges and ranges[early][1] >= ranges[late][0]:
                raise ValueError(f"{name}: {early} months reach into {late} ones")
    return spark.createDataFrame(rows, "split string, role string, lo int, hi int")


def tag_roles(df: DataFrame, table: DataFrame) -> DataFrame:
    """One row per (split, role, row of df).  The table is small: a handful of ranges exploded to months, so the join is on equality."""
    months = table.select("split", "role", F.explode(F.sequence("lo", "hi")).alias("month"))
    return df.join(F.broadcast(months), "month")


def block_fold(month: Column, size: int = 10) -> Column:
    return F.floor(month / size).cast("int")


def random_fold(key: str, k: int, seed: int = 0) -> Column:
    """Arithmetic hash fold, the same in any engine."""
    return ((F.col(key) * 7919 + seed * 104729 + 12345) % 1000003 % k).cast("int")


def recency_weight(month: Column, last: int, kind: str = "linear", rate: float = 0.02) -> Column:
    return (month + 1) / F.lit(last + 1) if kind == "linear" else F.exp(-rate * (F.lit(last) - month))
