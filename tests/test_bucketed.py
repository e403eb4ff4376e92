"""Bucketed event tables: same features, no shuffle, one file a bucket."""
import uuid

import pytest
from conftest import SF

from tickframe.operators import descriptors as D, families as E
from tickframe.sources.adapter import read_tables
from tickframe.sources.bucketed import bucket_sizes, bucket_tables, open_bucketed, write_bucketed


@pytest.fixture(scope="module")
def tables(spark):
    prefix = "t" + uuid.uuid4().hex[:8]
    plain = read_tables(spark, SF)
    yield plain, bucket_tables(plain, prefix, 3), open_bucketed(spark, prefix)
    for n in ("market", "order", "trade", "label"):
        spark.sql(f"DROP TABLE IF EXISTS {prefix}_{n}")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])


FAMILIES = {"event_flow": lambda t: E.event_flow(t.order, t.trade, t.label), "path": lambda t: D.path_descriptors(t.market), "forms": lambda t: D.flow_forms(t.market)}


@pytest.mark.parametrize("name", FAMILIES)
def test_same_rows_without_a_shuffle(tables, name):
    plain, _, kept = tables
    f = FAMILIES[name]
    got, want = rows(f(kept)), rows(f(plain))
    assert len(got) == len(want) and all(a == pytest.approx(b) for a, b in zip(got, want, strict=True))
    assert "Exchange hashpartitioning" in plan(f(plain))
    assert "Exchange hashpartitioning" not in plan(f(kept))


def test_sizes_and_rewriting(spark, tables):
    plain, written, kept = tables
    sizes = bucket_sizes(kept.market).collect()
    assert sum(r.rows for r in sizes) == plain.market.count() and len({r.bucket for r in sizes}) == len(sizes) <= 3
    assert sum(r.samples for r in sizes) == plain.market.select("sample_id").distinct().count()
    assert len(kept.market.inputFiles()) <= 3
    name = "t" + uuid.uuid4().hex[:8]
    write_bucketed(plain.label, name, 2)
    assert write_bucketed(plain.label.limit(0), name, 2).count() == 0
    spark.sql(f"DROP TABLE {name}")
    with pytest.raises(ValueError):
        write_bucketed(plain.label, name, 0)
