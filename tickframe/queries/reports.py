"""Sources, sinks, reports and diagnostics as queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import blend as J, diagnostics as G, metrics as I
from ..plans import protocol as H
from ..session import scratch_path
from ..sources import artifacts as A
from ..sources.adapter import duck, frame, read_tables
from .production import PRD, cos
from .sqltext import rnd

QUERIES: dict = {}
ORACLES: dict = {}
D = "::DOUBLE"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"{PRD} SELECT sample_id, {rnd('pred_a', 'prediction')} FROM prd")
def submission_round_trip(spark, d):
    """Every prediction written as a submission and read back."""
    path = scratch_path(spark)
    A.write_submission(frame(spark, d, "prd"), path, "pred_a")
    return X.tidied(A.read_submission(spark, path))


@query(f"""{PRD} SELECT CASE WHEN month <= 50 THEN 'inner' ELSE 'outer' END AS split, count(*) AS rows, count(DISTINCT sample_id) AS ids, min(month) AS first_month, max(month) AS last_month,
 {rnd(cos('pred_a'), 'cosine')} FROM prd GROUP BY 1""")
def prediction_artifacts(spark, d):
    """Prediction artifacts of two splits, written, loaded and summarised."""
    p, path = frame(spark, d, "prd").withColumnRenamed("pred_a", "pred"), scratch_path(spark)
    for name, rows in (("inner", p.where("month <= 50")), ("outer", p.where("month > 50"))):
        A.save_predictions(rows, path, name)
    parts = [A.run_summary(A.load_predictions(spark, path, s), cosine=I.cosine("pred", "target")).withColumn("split", F.lit(s)) for s in ("inner", "outer")]
    return X.tidied(parts[0].unionByName(parts[1]).drop("content"))


def _column_sql(c, kind, number):
    stats = f"{rnd(f'avg({c})', 'mean')}, {rnd(f'stddev_samp({c})', 'std')}" if number else "NULL::DOUBLE AS mean, NULL::DOUBLE AS std"
    return f"SELECT '{c}' AS name, '{kind}' AS type, count(*) FILTER (WHERE {c} IS NULL) AS nulls, {rnd(f'count(*) FILTER (WHERE {c} IS NULL) / count(*)::DOUBLE', 'null_share')}, count(DISTINCT {c}) AS \"distinct\", min({c})::VARCHAR AS low, max({c})::VARCHAR AS high, {stats} FROM trd"


@query(f"WITH {duck('trd')} " + " UNION ALL ".join(_column_sql(c, t, True) for c, t in (("sample_id", "bigint"), ("seq", "bigint"), ("side", "int"), ("volume", "double"))))
def schema_report(spark, d):
    return X.tidied(A.schema_report(frame(spark, d, "trd").select("sample_id", "seq", "side", "volume")))


@query(f"""WITH {duck('ord')}, p AS (SELECT count(*) AS n FROM ord GROUP BY sample_id), q AS (SELECT min(volume) AS a, max(volume) AS b, quantile_cont(volume, [0.01, 0.5, 0.99]) AS v, min(price) AS c, max(price) AS e, quantile_cont(price, [0.01, 0.5, 0.99]) AS w FROM ord)
SELECT (SELECT string_agg(DISTINCT side::VARCHAR, ',' ORDER BY side::VARCHAR) FROM ord) AS side_codes, (SELECT string_agg(DISTINCT order_action::VARCHAR, ',' ORDER BY order_action::VARCHAR) FROM ord) AS order_action_codes,
 {', '.join(rnd(x, n) for x, n in (('a', 'volume_min'), ('b', 'volume_max'), ('v[1]', 'volume_p01'), ('v[2]', 'volume_p50'), ('v[3]', 'volume_p99'), ('c', 'price_min'), ('e', 'price_max'), ('w[1]', 'price_p01'), ('w[2]', 'price_p50'), ('w[3]', 'price_p99')))},
 (SELECT min(n) FROM p) AS rows_min, {rnd('(SELECT quantile_cont(n, 0.5) FROM p)', 'rows_median')}, (SELECT max(n) FROM p) AS rows_max FROM q""")
def value_preview(spark, d):
    return X.tidied(A.value_preview(frame(spark, d, "ord"), ["side", "order_action"], ["volume", "price"]))


@query(f"{PRD} SELECT sample_id, month FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY sample_id) AS r FROM prd) WHERE r <= 3")
def smoke_rows(spark, d):
    return A.first_per_month(frame(spark, d, "prd"), 3).select("sample_id", "month")


_REP = f"""WITH {duck('mkt')}, p AS (SELECT sample_id, count(*) AS n, max(bid_price_1) - min(bid_price_1) AS range FROM mkt GROUP BY 1), m AS (SELECT *, (SELECT quantile_cont(n, 0.5) FROM p) AS mid FROM p),
 k AS (SELECT (SELECT sample_id FROM m ORDER BY abs(n - mid), sample_id LIMIT 1) AS median_activity, (SELECT sample_id FROM m ORDER BY range DESC, sample_id LIMIT 1) AS widest, (SELECT sample_id FROM m ORDER BY n, sample_id LIMIT 1) AS fewest)"""


@query(f"""{_REP}, i AS (SELECT DISTINCT unnest([median_activity, widest, fewest]) AS sample_id FROM k),
 e AS (SELECT m.*, row_number() OVER (PARTITION BY sample_id ORDER BY seconds_before_predict DESC, seq) AS place, count(*) OVER (PARTITION BY sample_id) AS n FROM mkt m JOIN i USING (sample_id))
SELECT sample_id, seq, place, CASE WHEN sample_id = median_activity THEN 'median' WHEN sample_id = widest THEN 'widest' ELSE 'fewest' END AS kind FROM e, k WHERE place <= 5 OR place > n - 5""")
def representative_rows(spark, d):
    """First and last five quotes of a sample of median activity, one of the widest range and the one with fewest rows."""
    m = frame(spark, d, "mkt")
    k = A.representatives(m, "bid_price_1")
    ids = k.select(F.explode(F.array("median_activity", "widest", "fewest")).alias("sample_id")).distinct()
    rows = A.head_tail(m, ids, [F.desc("seconds_before_predict"), "seq"], 5)
    kind = F.when(F.col("sample_id") == F.col("median_activity"), "median").when(F.col("sample_id") == F.col("widest"), "widest").otherwise("fewest")
    return rows.join(F.broadcast(k)).select("sample_id", "seq", F.col("place").cast("long").alias("place"), kind.alias("kind"))


@query(f"""WITH {duck('mkt', 'trd', 'lab')}, a AS (SELECT sample_id, sum(transaction_count) AS bars, sum(transaction_volume) AS bar_volume FROM mkt WHERE seconds_before_predict BETWEEN 0 AND 60 GROUP BY 1),
 b AS (SELECT sample_id, count(*) AS trades, sum(volume) AS volume FROM trd WHERE seconds_before_predict BETWEEN 0 AND 60 GROUP BY 1)
SELECT lab.sample_id, CAST(coalesce(bars, 0) AS BIGINT) AS bars, coalesce(trades, 0) AS trades, {rnd('coalesce(bar_volume, 0)', 'bar_volume')}, {rnd('coalesce(volume, 0)', 'volume')}, coalesce(bars, 0) = coalesce(trades, 0) AND coalesce(bar_volume, 0) = coalesce(volume, 0) AS agree
FROM lab LEFT JOIN a USING (sample_id) LEFT JOIN b USING (sample_id)""")
def bars_against_trades(spark, d):
    """Trades counted in the bars of the last minute against the trade stream."""
    t = read_tables(spark, d)
    a = t.market.where(X.within(upto=60)).groupBy("sample_id").agg(F.sum("transaction_count").alias("bars"), F.sum("transaction_volume").alias("bar_volume"))
    b = t.trade.where(X.within(upto=60)).groupBy("sample_id").agg(F.count("*").alias("trades"), F.sum("volume").alias("volume"))
    out = t.label.select("sample_id").join(a, "sample_id", "left").join(b, "sample_id", "left").fillna(0)
    return X.tidied(out.withColumn("agree", (F.col("bars") == F.col("trades")) & (F.col("bar_volume") == F.col("volume"))))


@query(f"{PRD} SELECT month // 10 AS block, count(*) AS n, count(pred_b) AS finite, {rnd('avg(pred_b)', 'mean')}, {rnd('stddev_pop(pred_b)', 'std')}, {rnd('min(pred_b)', 'lo')}, {rnd('max(pred_b)', 'hi')}, " + ", ".join(rnd(f"quantile_cont(pred_b, {q})", f"q{round(100 * q):02d}") for q in I.QUANTILES) + f", {rnd('coalesce(corr(pred_b, pred_a), 0)', 'reference_corr')} FROM prd GROUP BY 1")
def prediction_report(spark, d):
    p = frame(spark, d, "prd").withColumn("block", H.block_fold(F.col("month")))
    return X.tidied(G.prediction_report(p, "pred_b", "pred_a", "block"))


_RANK = lambda c: f"rank() OVER (PARTITION BY block ORDER BY {c}) + (count(*) OVER (PARTITION BY block, {c}) - 1) / 2.0"


@query(f"""{PRD}, b AS (SELECT *, month // 10 AS block, abs(target) AS ay FROM prd), r AS (SELECT *, {_RANK('pred_a')} AS rx, {_RANK('target')} AS ry, {_RANK('ay')} AS ra FROM b)
SELECT block, {rnd('corr(pred_a, target)', 'pearson')}, {rnd('corr(rx, ry)', 'spearman')}, {rnd('corr(pred_a, ay)', 'pearson_abs')}, {rnd('corr(rx, ra)', 'spearman_abs')} FROM r GROUP BY block""")
def associations(spark, d):
    p = frame(spark, d, "prd").withColumn("block", H.block_fold(F.col("month")))
    return X.tidied(G.associations(p, "pred_a", "target", ["block"]))


@query(f"""{PRD}, x AS (SELECT *, pred_a * pred_b AS product, tanh(pred_b) AS squashed FROM prd),
 c AS (SELECT name, nearest, abs(c) AS overlap FROM (SELECT corr(product, pred_a) AS pa, corr(product, pred_b) AS pb, corr(squashed, pred_a) AS sa, corr(squashed, pred_b) AS sb FROM x),
  LATERAL (VALUES ('product', 'pred_a', pa), ('product', 'pred_b', pb), ('squashed', 'pred_a', sa), ('squashed', 'pred_b', sb)) v(name, nearest, c))
SELECT name, nearest, {rnd('overlap', 'overlap')} FROM c QUALIFY row_number() OVER (PARTITION BY name ORDER BY overlap DESC, nearest) = 1""")
def overlap_audit(spark, d):
    p = frame(spark, d, "prd").withColumns({"product": F.col("pred_a") * F.col("pred_b"), "squashed": F.tanh("pred_b")})
    return X.tidied(G.overlap_audit(p, ["product", "squashed"], ["pred_a", "pred_b"]))


@query(f"""{PRD}, a AS (SELECT *, (sample_id * 31) % 97 AS activity FROM prd), e AS (SELECT quantile_cont(activity, [0.5, 0.9]) AS e FROM a)
SELECT CAST((e[1] <= activity)::INT + (e[2] <= activity)::INT AS INT) AS stratum, count(*) AS n, {rnd(f"({cos('pred_b')}) - ({cos('pred_a')})", 'delta')} FROM a, e GROUP BY 1""")
def stratified_delta(spark, d):
    p = frame(spark, d, "prd").withColumn("activity", (F.col("sample_id") * 31) % 97)
    return X.tidied(G.stratified_delta(p, "activity", "pred_a", "pred_b", "target"))


@query(f"""{PRD}, s AS (SELECT sqrt(sum(pred_a * pred_a)) AS na, sqrt(sum(pred_b * pred_b)) AS nb, sqrt(avg(pred_a * pred_a)) AS ra, stddev_pop(pred_b) AS sb FROM prd)
SELECT month, {rnd('sqrt(avg(pow(1e3 * (pred_a / na - pred_b / nb), 2)))', 'rms')}, {rnd('avg(pred_a / ra)', 'unit_a')}, {rnd('avg(pred_b / sb)', 'unit_b')} FROM prd, s GROUP BY month""")
def unit_disagreement(spark, d):
    """Rms per month of the difference of two unit vectors (in thousandths), and the means of rms- and deviation-scaled members."""
    p = G.unit_disagreement(frame(spark, d, "prd"), "pred_a", "pred_b")
    p = G.normalised(G.normalised(p, ["pred_a"], "rms"), ["pred_b"], "std")
    return X.tidied(p.groupBy("month").agg(I.rms(F.col("disagreement") * 1e3).alias("rms"), F.avg("pred_a").alias("unit_a"), F.avg("pred_b").alias("unit_b")))


@query(f"""{PRD}, s AS (SELECT month // 10 AS block, var_pop(pred_a) AS a, var_pop(pred_b) AS b, covar_pop(pred_a, pred_b) AS c FROM prd GROUP BY 1),
 v AS (SELECT block, ((a + b) / 2 + sqrt(pow((a - b) / 2, 2) + c * c)) / (a + b) AS p FROM s), k AS (SELECT block, axis, CASE WHEN axis = 0 THEN p ELSE 1 - p END AS share, p FROM v, (VALUES (0), (1)) x(axis))
SELECT block, axis, {rnd('share', 'share')}, {rnd('exp(-(p * ln(greatest(p, 1e-12)) + (1 - p) * ln(greatest(1 - p, 1e-12))))', 'effective_rank')} FROM k""")
def principal_shares(spark, d):
    p = frame(spark, d, "prd").withColumn("block", H.block_fold(F.col("month")))
    return X.tidied(G.principal_shares(p, ["pred_a", "pred_b"], "block"))


_NULL = " UNION ALL ".join(f"SELECT {i} AS round, pow(corr(a.pred_a, b.target), 2) AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY sample_id) AS r FROM prd) a JOIN (SELECT *, row_number() OVER (PARTITION BY month ORDER BY (sample_id * 7919 + {i} * 104729 + 12345) % 1000003, sample_id) AS r FROM prd) b USING (month, r)" for i in range(1, 6))


@query(f"{PRD}, n AS (SELECT 0 AS round, pow(corr(pred_a, target), 2) AS r2 FROM prd UNION ALL {_NULL}) SELECT round, {rnd('r2', 'r2')} FROM n")
def permutation_null(spark, d):
    return X.tidied(G.permutation_null(frame(spark, d, "prd"), "pred_a", "target", "sample_id", "month", 5))


_GONE = lambda c: f"SELECT '{c}' AS name, avg(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0 END) FILTER (WHERE seconds_before_predict <= 60) AS a, avg(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0 END) FILTER (WHERE seconds_before_predict > 60) AS b FROM mkt"


@query(f"WITH {duck('mkt')}, g AS ({_GONE('transaction_avgprice')} UNION ALL {_GONE('bid_price_1')}) SELECT name, {rnd('a', 'inside')}, {rnd('b', 'outside')}, {rnd('a - b', 'difference')} FROM g")
def missingness(spark, d):
    return X.tidied(G.missingness(frame(spark, d, "mkt"), ["transaction_avgprice", "bid_price_1"], F.col("seconds_before_predict") <= 60))


_CAND = f"c AS (SELECT month, i AS weight, {cos('((10 - i) * pred_a + i * pred_b)')} AS score FROM prd, range(0, 11) r(i) GROUP BY month, i)"


def _candidates(spark, d):
    p = frame(spark, d, "prd").withColumn("weight", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(10).cast("long"))))
    return p.groupBy("month", "weight").agg(I.cosine((10 - F.col("weight")) * F.col("pred_a") + F.col("weight") * F.col("pred_b"), "target").alias("score"))


@query(f"""{PRD}, {_CAND}, r AS (SELECT month, weight, round(score, 9) AS score FROM c)
SELECT month, weight, row_number() OVER (PARTITION BY month ORDER BY score DESC, weight) AS rank, {rnd('first_value(score) OVER (PARTITION BY month ORDER BY score DESC, weight) - score', 'behind')} FROM r QUALIFY rank <= 3""")
def against_best(spark, d):
    """The three best blend weights of each month and how far they are behind the best."""
    c = _candidates(spark, d).withColumn("score", F.round("score", 9))
    return X.tidied(G.against_best(c, "month", "weight", "score", 3).select("month", "weight", F.col("rank").cast("long").alias("rank"), "behind"))


@query(f"""{PRD}, {_CAND}, m AS (SELECT weight, avg(score) AS mean, count(*) AS folds FROM c GROUP BY 1) SELECT weight, folds, {rnd('mean', 'mean')}, {rnd('mean - (SELECT mean FROM m WHERE weight = 0)', 'change')} FROM m""")
def ablation_summary(spark, d):
    return X.tidied(G.ablation(_candidates(spark, d), "weight", "score", 0))


@query(f"WITH {duck('ord')} SELECT CAST(floor(seconds_before_predict) AS INT) AS bin, count(*) AS n, {rnd('count(*) / (SELECT count(*) FROM ord)::DOUBLE', 'share')} FROM ord GROUP BY 1")
def event_density(spark, d):
    return X.tidied(G.event_density(frame(spark, d, "ord")))


@query(f"""WITH {duck('ord')}, g AS (SELECT side, lag(seconds_before_predict) OVER (PARTITION BY sample_id ORDER BY seconds_before_predict DESC, seq) - seconds_before_predict AS gap FROM ord)
SELECT side, count(*) AS n, {', '.join(rnd(f'quantile_cont(gap, {q})', f'p{round(100 * q)}') for q in (0.25, 0.5, 0.75, 0.95))} FROM g WHERE gap IS NOT NULL GROUP BY side""")
def interarrival_quantiles(spark, d):
    return X.tidied(G.interarrival(frame(spark, d, "ord"), "side"))


@query(f"""WITH {duck('ord', 'trd')}, o AS (SELECT count(*) FILTER (WHERE NOT (volume >= 0 AND price > 0 AND side IN (0, 1) AND order_action IN (0, 1) AND seconds_before_predict >= 0)) AS bad_orders, count(*) AS orders FROM ord)
SELECT bad_orders, orders, (SELECT count(*) FROM trd WHERE NOT (volume > 2000 AND price > 0 AND side IN (0, 1) AND seconds_before_predict BETWEEN 0 AND 30)) AS bad_trades, (SELECT count(*) FROM trd) AS trades FROM o""")
def invalid_rows(spark, d):
    """Rows that fail the validity predicates (trades against stricter bounds, so that some fail)."""
    t = read_tables(spark, d)
    o = t.order.agg(F.count_if(~X.valid_order()).alias("bad_orders"), F.count("*").alias("orders"))
    return o.join(t.trade.agg(F.count_if(~(X.valid_trade() & (F.col("volume") > 2000) & X.within(upto=30))).alias("bad_trades"), F.count("*").alias("trades")))
