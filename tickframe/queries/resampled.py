"""Resampled and long-history families as queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import tidied
from ..operators import blend as J, resample as R, retrieval as L
from ..sources.adapter import duck, frame
from .evaluation import PRD
from .sqltext import rnd

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


_SECONDLY = f"""WITH {duck('trd')}, t AS (SELECT sample_id, floor(seconds_before_predict)::INT AS g, sum(CASE WHEN side = 0 THEN volume ELSE 0 END) AS buy, sum(CASE WHEN side = 1 THEN volume ELSE 0 END) AS sell, avg(price) AS price, count(*) AS rows FROM trd WHERE seconds_before_predict BETWEEN 0 AND 60 GROUP BY ALL),
 f AS (SELECT DISTINCT sample_id, r.g::INT AS g FROM t, range(0, 61) r(g)), s AS (SELECT sample_id, g, coalesce(buy, 0) AS buy, coalesce(sell, 0) AS sell, price, coalesce(rows, 0) AS rows FROM f LEFT JOIN t USING (sample_id, g))"""


@query(f"{_SECONDLY} SELECT sample_id, g, buy, sell, {rnd('price', 'price')}, rows FROM s")
def secondly_trades(spark, d):
    return tidied(R.secondly_trades(frame(spark, d, "trd")), "buy", "sell")


@query(f"""{_SECONDLY}, v AS (SELECT *, buy + sell AS v, lag(buy + sell, 1) OVER w AS v1, lag(buy + sell, 5) OVER w AS v5, avg(buy + sell) OVER (PARTITION BY sample_id) AS m FROM s WINDOW w AS (PARTITION BY sample_id ORDER BY g DESC))
SELECT sample_id, count(*) FILTER (WHERE rows > 0) AS busy, {rnd('avg(v)', 'mean')}, {rnd('stddev_samp(v)', 'std')}, {rnd('regr_slope(price, -g)', 'price_trend')}, {rnd('sum((v - m) * (v1 - m)) / nullif(sum((v - m) * (v - m)), 0)', 'autocov_1')}, {rnd('sum((v - m) * (v5 - m)) / nullif(sum((v - m) * (v - m)), 0)', 'autocov_5')},
 {rnd('sum(v) FILTER (WHERE g < 30) / (sum(v) FILTER (WHERE g >= 30) + 1)', 'near_far')}, {rnd('sum(exp(-g / 15.0) * (buy - sell)) / sum(exp(-g / 15.0))', 'weighted_flow')} FROM v GROUP BY sample_id""")
def secondly_statistics(spark, d):
    return tidied(R.secondly_statistics(R.secondly_trades(frame(spark, d, "trd"))))


@query(f"""WITH {duck('mkt')}, m AS (SELECT *, (bid_price_1 + ask_price_1) / 2 AS mid, row_number() OVER (PARTITION BY sample_id ORDER BY seconds_before_predict DESC, seq) AS k FROM mkt WHERE ask_price_1 > 0 AND seconds_before_predict BETWEEN 0 AND 600),
 b AS (SELECT sample_id, floor(seconds_before_predict / 10)::INT AS bar, arg_max(mid, k) AS last, avg(ask_price_1 - bid_price_1) AS spread, avg(bid_volume_1 + ask_volume_1) AS depth, coalesce(sum(transaction_volume), 0) AS volume, avg((bid_volume_1 - ask_volume_1) / (bid_volume_1 + ask_volume_1 + 1e-6)) AS imb, CAST(sum(transaction_count) AS BIGINT) AS trades, count(*) AS rows FROM m GROUP BY ALL)
SELECT sample_id, bar, trades, rows, {rnd('imb', 'imb')}, {rnd('last', 'last')}, {rnd('spread', 'spread')}, {rnd('depth', 'depth')}, {rnd('volume', 'volume')}, {rnd('coalesce(last / lag(last) OVER (PARTITION BY sample_id ORDER BY bar DESC) - 1, 0)', 'ret')} FROM b""")
def slow_bars(spark, d):
    return tidied(R.slow_bars(frame(spark, d, "mkt")))


_SEG = ((0, 60), (60, 180), (180, 300), (300, 600))


@query(f"""WITH {duck('mkt')}, m AS (SELECT *, (bid_price_1 + ask_price_1) / 2 AS mid, row_number() OVER (PARTITION BY sample_id ORDER BY seconds_before_predict DESC, seq) AS k FROM mkt WHERE ask_price_1 > 0)
SELECT sample_id, {rnd('avg(mid)', 'mean')}, {rnd('arg_min(mid, k)', 'oldest')}, {rnd('arg_max(mid, k)', 'newest')}, {rnd('arg_max(mid, k) / arg_min(mid, k) - 1', 'trend')}, """ + ", ".join(x for a, b in _SEG for f in [f"FILTER (WHERE seconds_before_predict >= {a} AND seconds_before_predict < {b})"] for x in (rnd(f"avg(mid) {f}", f"mean_{a}_{b}"), rnd(f"stddev_samp(mid) {f}", f"std_{a}_{b}"), rnd(f"coalesce(sum(transaction_volume) {f}, 0)", f"volume_{a}_{b}"), f"count(*) {f} AS rows_{a}_{b}")) + " FROM m GROUP BY sample_id")
def long_history(spark, d):
    return tidied(R.history(frame(spark, d, "mkt")))


def _raw_sql():
    f = lambda c: f"FILTER (WHERE {c})"
    v = lambda c: f"coalesce(sum(volume) {f(c)}, 0)"
    rec, bef = "seconds_before_predict <= 15", "seconds_before_predict > 15 AND seconds_before_predict <= 30"
    tail = lambda p: {**{f"{p}_size_p{round(100 * x)}": f"quantile_cont(volume, {x})" for x in (0.25, 0.5, 0.75, 0.95)}, f"{p}_size_max": "max(volume)", f"{p}_price_mean": "avg(price)", f"{p}_price_std": "stddev_samp(price)", f"{p}_recent": v(rec), f"{p}_before": v(bef), f"{p}_recent_ratio": f"{v(rec)} / ({v(bef)} + 1)"}
    k = {"bid_add": "side = 0 AND order_action = 0", "ask_add": "side = 1 AND order_action = 0", "bid_cancel": "side = 0 AND order_action = 1", "ask_cancel": "side = 1 AND order_action = 1"}
    t = {"buy": "side = 0", "sell": "side = 1"}
    counts = lambda m: {f"n_{x}": f"count(*) {f(c)}" for x, c in m.items()}
    vols = lambda m: {f"v_{x}": v(c) for x, c in m.items()}
    o_, t_ = {**vols(k), **tail("order")}, {**vols(t), **tail("trade")}
    sel = lambda n, x: ", ".join([*(f"{v} AS {k}" for k, v in n.items()), *(rnd(v, k) for k, v in x.items())])
    return f"WITH {duck('ord', 'trd')}, o AS (SELECT sample_id, {sel(counts(k), o_)} FROM ord GROUP BY 1), t AS (SELECT sample_id, {sel(counts(t), t_)} FROM trd GROUP BY 1) SELECT * FROM o FULL JOIN t USING (sample_id)"


@query(_raw_sql())
def raw_aggregates(spark, d):
    return tidied(R.raw_aggregates(frame(spark, d, "ord"), frame(spark, d, "trd")))


_GAPS = (1, 7, 14, 21, 30, 60, 120)
_GAP_SQL = {"change": "volume - lag(volume, {g}) OVER w", "time": "lag(seconds_before_predict, {g}) OVER w - seconds_before_predict", "price": "price - lag(price, {g}) OVER w",
            "second": "price - 2 * lag(price, {g}) OVER w + lag(price, 2 * {g}) OVER w", "ratio": "(price - lag(price, {g}) OVER w) / (lag(price, {g}) OVER w + 1e-8)"}


@query(f"""WITH {duck('ord')}, l AS (SELECT sample_id, {', '.join(f"{e.format(g=g)} AS {n}_{g}" for g in _GAPS for n, e in _GAP_SQL.items())} FROM ord WINDOW w AS (PARTITION BY sample_id ORDER BY seconds_before_predict DESC, seq))
SELECT sample_id, {', '.join(rnd(f'avg({n}_{g})', f'{n}_{g}') for g in _GAPS for n in _GAP_SQL)} FROM l GROUP BY sample_id""")
def gap_features(spark, d):
    return tidied(R.gap_features(frame(spark, d, "ord")))


@query(f"""{PRD}, x AS (SELECT *, month // 10 AS block, ((sample_id * 31337) % 2001 - 1000) / 1e3 AS pred_c FROM prd),
 g AS (SELECT block, sum(pred_a * pred_a) AS aa, sum(pred_b * pred_b) AS bb, sum(pred_c * pred_c) AS cc, sum(pred_a * pred_b) AS ab, sum(pred_a * pred_c) AS ac, sum(pred_b * pred_c) AS bc, sum(pred_a * target) AS ay, sum(pred_b * target) AS bz, sum(pred_c * target) AS cy, sum(target * target) AS yy FROM x GROUP BY block),
 w AS (SELECT i AS u, j AS v, 10 - i - j AS z FROM range(0, 11) p(i), range(0, 11) q(j) WHERE i + j <= 10),
 s AS (SELECT u, v, z, round(avg((u * ay + v * bz + z * cy) / sqrt((u * u * aa + v * v * bb + z * z * cc + 2 * (u * v * ab + u * z * ac + v * z * bc)) * yy)), 9) AS score FROM g, w GROUP BY ALL)
SELECT u / 10.0::DOUBLE AS pred_a, v / 10.0::DOUBLE AS pred_b, z / 10.0::DOUBLE AS pred_c, {rnd('score', 'score')} FROM s ORDER BY s.score DESC, u, v, z LIMIT 1""")
def simplex_blend(spark, d):
    p = frame(spark, d, "prd").withColumn("block", F.floor(F.col("month") / 10).cast("int")).withColumn("pred_c", ((F.col("sample_id") * 31337) % 2001 - 1000) / F.lit(1e3))
    return tidied(J.simplex_search(p, ["pred_a", "pred_b", "pred_c"], "target", "block"), "pred_a", "pred_b", "pred_c")


@query(f"""WITH e AS (SELECT vec_id, vec_id % 71 AS month, embedding::DOUBLE[] AS z FROM embeddings),
 p AS (SELECT q.vec_id AS q, b.month, round(sqrt(list_sum(list_transform(list_zip(q.z, b.z), lambda x: (x[1] - x[2]) * (x[1] - x[2])))), 9) AS dist, b.vec_id AS b FROM e q JOIN e b ON b.month < q.month WHERE q.vec_id % 50 = 0),
 k AS (SELECT q, month FROM p QUALIFY row_number() OVER (PARTITION BY q ORDER BY dist, b) <= 10), n AS (SELECT q, month, count(*) AS n FROM k GROUP BY ALL), r AS (SELECT q, n / sum(n) OVER (PARTITION BY q) AS p FROM n)
SELECT q, {rnd('-sum(p * ln(p))', 'entropy')}, count(*) AS months FROM r GROUP BY q""")
def neighbour_support(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", (F.col("vec_id") % 71).alias("month"), F.col("embedding").alias("z"))
    pairs = L.knn(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), "month", "z"), e.select(F.col("vec_id").alias("b"), "month", "z"), 10)
    return tidied(L.support(pairs, e.select(F.col("vec_id").alias("b"), "month")))
