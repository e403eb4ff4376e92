"""Relativised sets and local regressions as queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import tidied, tidy
from ..operators import families as E, micro as M, retrieval as L
from ..sources.adapter import read_tables
from .features import KEEP, _official_sql
from .more import _micro_sql
from .sqltext import rnd

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


_WIDE = _official_sql().rsplit("\nSELECT", 1)[0]


@query(f"{_WIDE} SELECT sample_id, month, target, {', '.join(rnd(f'{c}::DOUBLE / ({s} + {o!r})', c, 3 if c == 'm_rv' else 6) for c, (s, o) in E.RELATIVE.items())} FROM k")
def relativised_features(spark, d):
    t = read_tables(spark, d)
    out = E.relativised(E.assembled(t.market, t.order, t.trade, t.label)).select("sample_id", "month", "target", *E.RELATIVE)
    return tidied(out, *KEEP, "m_rv").withColumn("m_rv", tidy(F.col("m_rv"), 3))


_V = lambda c: f"coalesce({c}, 0)"
_REL = {"o_arrival_rel": f"{_V('o_arrival_rate')} / ({_V('t_arrival_rate')} + 1e-4)", "o_iat_cv_diff": f"{_V('o_iat_cv')} - {_V('t_iat_cv')}", "o_large_share_rel": f"{_V('o_large_share')} / ({_V('t_large_share')} + 1e-4)", "o_burst_rel": f"{_V('o_burst_ratio')} / ({_V('t_iat_cv')} + 1e-4)", "t_arrival_rel": f"{_V('t_arrival_rate')} / ({_V('o_arrival_rate')} + 1e-4)", "o_ac_ratio_rel": f"{_V('o_add_cancel_ratio')} / ({_V('t_arrival_rate')} + 1e-4)"}


@query(f"{_micro_sql().rsplit(chr(10) + 'SELECT', 1)[0]} SELECT lab.sample_id, month, target, {', '.join(rnd(v, k, 3) for k, v in _REL.items())} FROM lab LEFT JOIN o USING (sample_id) LEFT JOIN t USING (sample_id) LEFT JOIN m USING (sample_id)")
def relative_streams(spark, d):
    t = read_tables(spark, d)
    return tidied(M.relative_streams(M.micro_structure(t.market, t.order, t.trade, t.label)), *KEEP, digits=3)


@query(f"""WITH e AS (SELECT vec_id, vec_id % 71 AS month, embedding::DOUBLE[] AS z, label FROM embeddings),
 p AS (SELECT q.vec_id AS q, b.vec_id AS b, b.z[1] AS x1, b.z[2] AS x2, b.label::DOUBLE AS y, round(sqrt(list_sum(list_transform(list_zip(q.z, b.z), lambda x: (x[1] - x[2]) * (x[1] - x[2])))), 9) AS dist FROM e q JOIN e b ON b.month < q.month WHERE q.vec_id % 50 = 0),
 k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY q ORDER BY dist, b) <= 20), w AS (SELECT *, exp(-0.5 * pow(dist / greatest(max(dist) OVER (PARTITION BY q), 1e-12), 2)) AS w FROM k),
 s AS (SELECT q, sum(w * x1 * x1) + 1 AS a, sum(w * x1 * x2) AS b, sum(w * x2 * x2) + 1 AS c, sum(w * x1 * y) AS u, sum(w * x2 * y) AS v FROM w GROUP BY q)
SELECT q, {rnd('(u * c - v * b) / (a * c - b * b)', 'x1')}, {rnd('(v * a - u * b) / (a * c - b * b)', 'x2')} FROM s""")
def local_ridge(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", (F.col("vec_id") % 71).alias("month"), F.col("embedding").alias("z"), F.col("label").cast("double").alias("y"))
    pairs = L.knn(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), "month", "z"), e.select(F.col("vec_id").alias("b"), "month", "z"), 20)
    values = e.select(F.col("vec_id").alias("b"), F.col("z")[0].cast("double").alias("x1"), F.col("z")[1].cast("double").alias("x2"), "y")
    return tidied(L.local_ridge(pairs, values, ["x1", "x2"], "y", 1.0))
