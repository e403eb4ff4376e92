"""Contract checks, protocol, metrics, blends, preparation and retrieval as queries."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import exprs as X
from ..operators import blend as J, checks as B, diagnostics as G, metrics as I, prep as K, retrieval as L
from ..plans import protocol as H
from ..sources.adapter import duck, frame, read_tables
from .sqltext import rnd

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


PRD = f"WITH {duck('prd')}"
COS = lambda p, y: f"CASE WHEN sum({p} * {p}) * sum({y} * {y}) > 0 THEN sum({p} * {y}) / sqrt(sum({p} * {p}) * sum({y} * {y})) ELSE 0 END"


@query(f"""WITH {duck('mkt', 'ord', 'trd', 'lab')} SELECT * FROM (
 SELECT 'unique_sample_id' AS "check", (SELECT count(*) FROM (SELECT sample_id FROM lab GROUP BY 1 HAVING count(*) > 1)) AS violations
 UNION ALL SELECT 'finite_target', (SELECT count(*) FROM lab WHERE target IS NULL OR NOT isfinite(target))
 UNION ALL SELECT 'finite_transaction_avgprice', (SELECT count(*) FROM mkt WHERE transaction_avgprice IS NULL)
 UNION ALL SELECT 'domain_side', (SELECT count(*) FROM ord WHERE side NOT IN (0, 1))
 UNION ALL SELECT 'contained', (SELECT count(DISTINCT sample_id) FROM trd WHERE sample_id NOT IN (SELECT sample_id FROM lab))
 UNION ALL SELECT 'month_missing', (SELECT count(*) FROM range(0, 71) r(m) WHERE m NOT IN (SELECT month FROM lab))
 UNION ALL SELECT 'month_extra', (SELECT count(DISTINCT month) FROM lab WHERE month NOT BETWEEN 0 AND 70)
 UNION ALL SELECT 'aligned', (SELECT count(*) FROM lab a FULL JOIN (SELECT * FROM lab WHERE sample_id % 10 <> 3) b USING (sample_id) WHERE a.target IS DISTINCT FROM b.target))""")
def contract_checks(spark, d):
    t = read_tables(spark, d)
    part = t.label.where("sample_id % 10 <> 3")
    rows = [B.unique_key(t.label, "sample_id"), B.finite_values(t.label, "target"), B.finite_values(t.market, "transaction_avgprice"), B.code_domain(t.order, "side"), B.contained(t.trade, t.label), B.month_coverage(t.label, 0, 70), B.aligned(t.label, part, "sample_id", ["target"])]
    return reduce(DataFrame.unionByName, rows)


@query(f"""WITH {duck('mkt')}, r AS (SELECT sample_id, count(*) AS n, count(DISTINCT seconds_before_predict) AS u FROM mkt GROUP BY 1),
 a AS (SELECT count(*) AS rows, count(*) FILTER (WHERE transaction_avgprice IS NULL) AS null_avgprice, count(*) FILTER (WHERE ask_price_1 = 0) AS zero_ask,
   count(*) FILTER (WHERE bid_volume_1 % 100 = 0) AS lots, count(*) FILTER (WHERE seconds_before_predict < 0 OR seconds_before_predict > 600) AS out_of_range FROM mkt)
SELECT a.*, (SELECT count(*) FROM r) AS samples, (SELECT CAST(sum(n - u) AS BIGINT) FROM r) AS duplicate_seconds, (SELECT {rnd('quantile_cont(n, 0.5)', 'rows_p50').split(' AS ')[0]} FROM r) AS rows_p50,
 (SELECT min(n) FROM r) AS rows_min, (SELECT max(n) FROM r) AS rows_max FROM a""")
def integrity_audit(spark, d):
    m = frame(spark, d, "mkt")
    sec = F.col("seconds_before_predict")
    a = m.agg(F.count("*").alias("rows"), F.count_if(F.col("transaction_avgprice").isNull()).alias("null_avgprice"), F.count_if(F.col("ask_price_1") == 0).alias("zero_ask"), F.count_if(F.col("bid_volume_1") % 100 == 0).alias("lots"), F.count_if((sec < 0) | (sec > 600)).alias("out_of_range"))
    per = m.groupBy("sample_id").agg(F.count("*").alias("n"), F.countDistinct("seconds_before_predict").alias("u"))
    b = per.agg(F.count("*").alias("samples"), F.sum(F.col("n") - F.col("u")).alias("duplicate_seconds"), X.tidy(F.percentile("n", 0.5)).alias("rows_p50"), F.min("n").alias("rows_min"), F.max("n").alias("rows_max"))
    return a.join(F.broadcast(b))


_ROLES = ", ".join(f"('{n}', '{r}', {lo}, {hi})" for n, r, lo, hi in H.OUTER)


@query(f"""{PRD}, s(split, role, lo, hi) AS (VALUES {_ROLES})
SELECT split, role, count(*) AS n, {rnd(COS('pred_a', 'target'), 'cosine')}, {rnd('sum((month + 1) / 71.0)', 'linear_weight')}, {rnd('sum(exp(-0.02 * (70 - month)))', 'exp_weight')},
 count(DISTINCT month // 10) AS blocks, count(*) FILTER (WHERE (sample_id * 7919 + 12345) % 1000003 % 5 = 0) AS fold0
FROM prd JOIN s ON month BETWEEN lo AND hi GROUP BY ALL""")
def split_roles(spark, d):
    p = H.tag_roles(frame(spark, d, "prd"), H.splits(spark))
    m = F.col("month")
    out = p.groupBy("split", "role").agg(F.count("*").alias("n"), I.cosine("pred_a", "target").alias("cosine"), F.sum(H.recency_weight(m, 70)).alias("linear_weight"), F.sum(H.recency_weight(m, 70, "exp")).alias("exp_weight"), F.countDistinct(H.block_fold(m)).alias("blocks"), F.count_if(H.random_fold("sample_id", 5) == 0).alias("fold0"))
    return X.tidied(out)


@query(f"""{PRD} SELECT month, count(*) AS n, {rnd(COS('pred_a', 'target'), 'cosine_a')}, {rnd(COS('pred_b', 'target'), 'cosine_b')}, {rnd('coalesce(corr(pred_a, target), 0)', 'centred')}, {rnd('sqrt(avg(pred_a * pred_a))', 'rms_a')},
 {rnd('1 - sum((target - pred_a) * (target - pred_a)) / (sum(target * target) - sum(target) * sum(target) / count(*))', 'r2')}, {rnd('avg(abs(target - pred_a))', 'mae')},
 {rnd('avg(CASE WHEN sign(pred_a) = sign(target) THEN 1.0 ELSE 0.0 END)', 'sign_accuracy')} FROM prd GROUP BY month""")
def monthly_metrics(spark, d):
    p = frame(spark, d, "prd")
    same = F.when(F.signum("pred_a") == F.signum("target"), 1.0).otherwise(0.0)
    out = p.groupBy("month").agg(F.count("*").alias("n"), I.cosine("pred_a", "target").alias("cosine_a"), I.cosine("pred_b", "target").alias("cosine_b"), I.centred("pred_a", "target").alias("centred"), I.rms("pred_a").alias("rms_a"), I.r2("pred_a", "target").alias("r2"), F.avg(F.abs(F.col("target") - F.col("pred_a"))).alias("mae"), F.avg(same).alias("sign_accuracy"))
    return X.tidied(out.where("n > 2"))


@query(f"{PRD} SELECT month // 10 AS block, count(*) AS n, count(pred_b) AS finite, {rnd('avg(pred_b)', 'mean')}, {rnd('stddev_pop(pred_b)', 'std')}, {rnd('min(pred_b)', 'lo')}, {rnd('max(pred_b)', 'hi')}, " + ", ".join(rnd(f"quantile_cont(pred_b, {q})", f"q{round(100 * q):02d}") for q in I.QUANTILES) + " FROM prd GROUP BY 1")
def distribution_report(spark, d):
    p = frame(spark, d, "prd").withColumn("block", H.block_fold(F.col("month")))
    return X.tidied(I.distribution(p, "pred_b", "block").withColumn("block", F.col("block").cast("int")))


@query(f"""{PRD}, r AS (SELECT month, target, rank() OVER (PARTITION BY month ORDER BY pred_a) + (count(*) OVER (PARTITION BY month, pred_a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY month ORDER BY target) + (count(*) OVER (PARTITION BY month, target) - 1) / 2.0 AS rt FROM prd)
SELECT month, {rnd('corr(ra, rt)', 'spearman')}, {rnd("(sum(ra) FILTER (WHERE target > 0) - count(*) FILTER (WHERE target > 0) * (count(*) FILTER (WHERE target > 0) + 1) / 2.0) / (count(*) FILTER (WHERE target > 0) * (count(*) - count(*) FILTER (WHERE target > 0)))", 'auc')}
FROM r GROUP BY month HAVING count(*) > 20""")
def rank_metrics(spark, d):
    p = frame(spark, d, "prd")
    big = p.groupBy("month").count().where("count > 20").select("month")
    out = I.spearman(p, "pred_a", "target", ["month"]).join(I.auc(p, "pred_a", F.col("target") > 0, ["month"]), "month").join(F.broadcast(big), "month")
    return X.tidied(out)


_MONTHS = f"""{PRD}, m AS (SELECT month, sum(pred_a * target) AS bt, sum(pred_b * target) AS ct, sum(pred_a * pred_a) AS bb, sum(pred_b * pred_b) AS cc, sum(target * target) AS tt, {COS('pred_b', 'target')} - ({COS('pred_a', 'target')}) AS delta FROM prd GROUP BY month)"""


@query(f"""{_MONTHS}, k AS (SELECT *, row_number() OVER (ORDER BY delta DESC, month) AS k FROM m)
SELECT {rnd('avg(CASE WHEN delta > 0 THEN 1.0 ELSE 0.0 END)', 'positive')}, {rnd('min(delta)', 'worst')}, {rnd('quantile_cont(delta, 0.5)', 'median')}, {rnd('avg(delta)', 'mean')}, {rnd('regr_slope(delta, month)', 'slope')},
 {rnd('sum(greatest(delta, 0)) FILTER (WHERE k <= 3) / nullif(sum(greatest(delta, 0)), 0)', 'top3')} FROM k""")
def stability_summary(spark, d):
    return X.tidied(I.stability(I.monthly(frame(spark, d, "prd"), "pred_a", "pred_b", "target")))


@query(f"""{_MONTHS}, i AS (SELECT *, row_number() OVER (ORDER BY month) - 1 AS i, count(*) OVER () AS n FROM m),
 x AS (SELECT b, j, ((b * 1103515245 + j * 12345 + 7 * 2654435761) % 2147483647 * 48271 % 2147483647) % (SELECT max(n) FROM i) AS i FROM range(0, 5000) q(b), range(0, (SELECT max(n) FROM i)) r(j)),
 g AS (SELECT b, sum(bt) AS bt, sum(ct) AS ct, sum(bb) AS bb, sum(cc) AS cc, sum(tt) AS tt FROM x JOIN i USING (i) GROUP BY b),
 e AS (SELECT ct / sqrt(cc * tt) - bt / sqrt(bb * tt) AS d FROM g)
SELECT {rnd('avg(d)', 'mean')}, {rnd('quantile_cont(d, 0.025)', 'low')}, {rnd('quantile_cont(d, 0.975)', 'high')}, {rnd('avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END)', 'positive')} FROM e""")
def month_bootstrap(spark, d):
    return X.tidied(I.bootstrap(I.monthly(frame(spark, d, "prd"), "pred_a", "pred_b", "target")))


@query(f"""{PRD}, s AS (SELECT *, abs(pred_b) AS st FROM prd), e AS (SELECT quantile_cont(st, 0.25) AS a, quantile_cont(st, 0.5) AS b, quantile_cont(st, 0.75) AS c FROM s WHERE month <= 50)
SELECT CAST((a <= st)::INT + (b <= st)::INT + (c <= st)::INT AS INT) AS bucket, count(*) AS n, {rnd(f"({COS('pred_b', 'target')}) - ({COS('pred_a', 'target')})", 'delta')} FROM s, e WHERE month > 50 GROUP BY 1""")
def state_conditioned(spark, d):
    p = frame(spark, d, "prd").withColumn("st", F.abs("pred_b"))
    return X.tidied(I.state_conditioned(p, "st", "pred_a", "pred_b", "target", F.col("month") <= 50))


_SUMS = "count(*) AS n, sum(pred_a) AS sa, sum(pred_b) AS sb, sum(pred_a * pred_a) AS aa, sum(pred_b * pred_b) AS bb, sum(pred_a * pred_b) AS ab, sum(pred_a * target) AS ay, sum(pred_b * target) AS bz, sum(target * target) AS yy"
_FIT = f"""f AS (SELECT month // 10 AS block, {_SUMS} FROM prd GROUP BY 1),
 k AS (SELECT *, 0 AS m, 'raw' AS method, 1.0::DOUBLE AS ka, 1.0::DOUBLE AS kb FROM f UNION ALL SELECT *, 1, 'std', sqrt(greatest(aa / n - (sa / n) * (sa / n), 0)), sqrt(greatest(bb / n - (sb / n) * (sb / n), 0)) FROM f UNION ALL SELECT *, 2, 'rms', sqrt(aa / n), sqrt(bb / n) FROM f),
 g AS (SELECT *, (1 - i / 100.0::DOUBLE) / ka AS u, i / 100.0::DOUBLE / kb AS v FROM k, range(0, 101) r(i)),
 s AS (SELECT *, round((u * ay + v * bz) / sqrt((u * u * aa + 2 * u * v * ab + v * v * bb) * yy), 9) AS score FROM g),
 fit AS (SELECT block, method, i / 100.0::DOUBLE AS weight, score, ka, kb FROM s QUALIFY row_number() OVER (PARTITION BY block ORDER BY score DESC, m, i) = 1)"""


@query(f"{PRD}, {_FIT} SELECT block, method, {rnd('weight', 'weight')}, {rnd('score', 'score')}, {rnd('ka', 'ka')}, {rnd('kb', 'kb')} FROM fit")
def blend_calibration(spark, d):
    p = frame(spark, d, "prd").withColumn("block", F.floor(F.col("month") / 10).cast("int"))
    return X.tidied(J.fit_blend(p, "pred_a", "pred_b", "target", ["block"]))


@query(f"""{PRD}, {_FIT} SELECT p.month // 10 AS block, count(*) AS n, {rnd(COS('((1 - weight) * pred_a / ka + weight * pred_b / kb)', 'target'), 'cosine')}
FROM prd p JOIN fit ON fit.block = p.month // 10 - 1 GROUP BY 1""")
def nested_blend(spark, d):
    """Fitted on one block of months, frozen for the next."""
    p = frame(spark, d, "prd").withColumn("block", F.floor(F.col("month") / 10).cast("int"))
    state = J.fit_blend(p, "pred_a", "pred_b", "target", ["block"]).withColumn("block", (F.col("block") + 1).cast("int"))
    out = J.apply_blend(p, state, "pred_a", "pred_b", ["block"])
    return X.tidied(out.groupBy("block").agg(F.count("*").alias("n"), I.cosine("blend", "target").alias("cosine")))


@query(f"""{PRD}, b AS (SELECT sum(pred_a * target) / sum(pred_a * pred_a) AS beta FROM prd WHERE month <= 50)
SELECT month, {rnd('any_value(beta)', 'beta')}, {rnd('avg(target - beta * pred_a)', 'mean_residual')}, {rnd('stddev_pop(target - beta * pred_a)', 'sd_residual')} FROM prd, b GROUP BY month""")
def residual_view(spark, d):
    out = J.residual_view(frame(spark, d, "prd"), "pred_a", "target", F.col("month") <= 50)
    return X.tidied(out.groupBy("month").agg(F.first("beta").alias("beta"), F.avg("residual").alias("mean_residual"), F.stddev_pop("residual").alias("sd_residual")))


_TREND = """(sum(mean) OVER q - (n * sum(month * mean) OVER q - sum(month) OVER q * sum(mean) OVER q) / (CASE WHEN n >= 2 THEN n * sum(month * month) OVER q - sum(month) OVER q * sum(month) OVER q END) * sum(month) OVER q) / n
 + (n * sum(month * mean) OVER q - sum(month) OVER q * sum(mean) OVER q) / (CASE WHEN n >= 2 THEN n * sum(month * month) OVER q - sum(month) OVER q * sum(month) OVER q END) * month"""
_EW = ", ".join(rnd(f"sum(mean * exp({1 - 0.5 ** (1 / h)!r} * month)) OVER p / sum(exp({1 - 0.5 ** (1 / h)!r} * month)) OVER p", f"ewma_{h}") for h in (3, 6, 12))


@query(f"""{PRD}, m AS (SELECT month, avg(target) AS mean FROM prd GROUP BY month)
SELECT CAST(month AS INT) AS month, {rnd('mean', 'mean')}, {rnd('avg(mean) OVER p', 'expanding')}, {', '.join(rnd(f'avg(mean) OVER (ORDER BY month ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)', f'rolling_{n}') for n in (3, 6, 12))}, {_EW}, {rnd(_TREND.replace("n *", "count(*) OVER q *").replace("/ n", "/ count(*) OVER q").replace("n >=", "count(*) OVER q >="), 'trend_12')}
FROM (SELECT CAST(month AS DOUBLE) AS month, mean FROM m) m WINDOW p AS (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), q AS (ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)""")
def drift_estimators(spark, d):
    m = frame(spark, d, "prd").groupBy("month").agg(F.avg("target").alias("mean"))
    return X.tidied(J.drift_estimates(m))


@query(f"""{PRD}, q AS (SELECT quantile_cont(pred_a, [0.25, 0.5, 0.75]) AS a, quantile_cont(pred_b, [0.25, 0.5, 0.75]) AS b FROM prd WHERE month <= 50),
 z AS (SELECT sample_id, month, (pred_a - a[2]) / (CASE WHEN a[3] > a[1] THEN a[3] - a[1] ELSE 1 END) AS x, (pred_b - b[2]) / (CASE WHEN b[3] > b[1] THEN b[3] - b[1] ELSE 1 END) AS y FROM prd, q WHERE month > 50)
SELECT sample_id, month, {rnd('x / sqrt(1 + (x / 3) * (x / 3))', 'pred_a')}, {rnd('y / sqrt(1 + (y / 3) * (y / 3))', 'pred_b')} FROM z""")
def robust_scaling(spark, d):
    p = frame(spark, d, "prd").select("sample_id", "month", "pred_a", "pred_b")
    state = K.fit_robust(p.where("month <= 50"), ["pred_a", "pred_b"])
    return X.tidied(K.apply_robust(p.where("month > 50"), state, ["pred_a", "pred_b"], clip=3.0))


@query(f"""{PRD}, q AS (SELECT quantile_cont(pred_b, {[i / 20 for i in range(1, 20)]}) AS e FROM prd WHERE month <= 50)
SELECT CAST(len(list_filter(e, lambda x: x <= pred_b)) AS INT) AS bin, count(*) AS n, {rnd('avg(target)', 'mean')} FROM prd, q WHERE month > 50 GROUP BY 1""")
def quantile_bins(spark, d):
    p = frame(spark, d, "prd")
    out = K.apply_edges(p.where("month > 50"), K.fit_edges(p.where("month <= 50"), ["pred_b"]), ["pred_b"])
    return X.tidied(out.groupBy(F.col("pred_b").alias("bin")).agg(F.count("*").alias("n"), F.avg("target").alias("mean")))


@query("""WITH v AS (SELECT o_orderpriority AS word, row_number() OVER (ORDER BY min(o_orderkey), o_orderpriority) - 1 AS code FROM orders WHERE o_orderkey % 2 = 0 AND o_orderpriority <> '5-LOW' GROUP BY 1)
SELECT o_orderpriority AS word, CAST(coalesce(code, (SELECT count(*) FROM v)) AS INT) AS code, count(*) AS n FROM orders LEFT JOIN v ON word = o_orderpriority GROUP BY 1, 2""")
def vocabulary_codes(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.col("o_orderpriority").alias("word"))
    state = K.fit_vocabulary(o.where("o_orderkey % 2 = 0 and word != '5-LOW'"), "word", F.col("o_orderkey"))
    return K.apply_vocabulary(o, state, "word").groupBy("word", "code").agg(F.count("*").alias("n"))


@query(f"""{PRD}, s AS (SELECT avg(pred_b) AS m, stddev_pop(pred_b) + 1e-6 AS s FROM prd WHERE month <= 50)
SELECT sample_id, {rnd('least(greatest((pred_b - m) / s, -10), 10)', 'pred_b')} FROM prd, s WHERE month > 50""")
def standard_clip(spark, d):
    p = frame(spark, d, "prd").select("sample_id", "month", "pred_b")
    out = K.apply_standard(p.where("month > 50"), K.fit_standard(p.where("month <= 50"), ["pred_b"]), ["pred_b"])
    return X.tidied(out.select("sample_id", "pred_b"))


@query(f"""WITH e AS (SELECT vec_id, vec_id % 71 AS month, embedding::DOUBLE[] AS z, label FROM embeddings),
 p AS (SELECT q.vec_id AS q, b.vec_id AS b, b.label AS v, round(sqrt(list_sum(list_transform(list_zip(q.z, b.z), lambda x: (x[1] - x[2]) * (x[1] - x[2])))), 9) AS dist FROM e q JOIN e b ON b.month < q.month WHERE q.vec_id % 50 = 0),
 k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, b) AS rank FROM p QUALIFY rank <= 10),
 h AS (SELECT *, exp(-0.5 * pow(dist / greatest(max(dist) OVER (PARTITION BY q), 1e-12), 2)) AS w FROM k)
SELECT q, count(*) AS k, {rnd('sum(w * v) / sum(w)', 'estimate')}, {rnd('min(dist)', 'nearest')} FROM h GROUP BY q""")
def history_neighbours(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", (F.col("vec_id") % 71).alias("month"), F.col("embedding").alias("z"), "label")
    query_ = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), "month", "z")
    bank = e.select(F.col("vec_id").alias("b"), "month", "z")
    pairs = L.knn(query_, bank, 10)
    return X.tidied(L.neighbour_mean(pairs, e.select(F.col("vec_id").alias("b"), F.col("label").cast("double").alias("v"))))


@query(f"""{PRD}, s AS (SELECT month // 10 AS block, count(*)::DOUBLE AS n, sum(pred_a) AS sa, sum(pred_b) AS sb, sum(pred_a * pred_a) + 1 AS aa, sum(pred_b * pred_b) + 1 AS bb, sum(pred_a * pred_b) AS ab, sum(target) AS y, sum(pred_a * target) AS ay, sum(pred_b * target) AS bz FROM prd GROUP BY 1),
 c AS (SELECT block, aa - sa * sa / n AS p, bb - sb * sb / n AS q, ab - sa * sb / n AS r, ay - sa * y / n AS u, bz - sb * y / n AS v, n, sa, sb, y FROM s),
 w AS (SELECT block, (u * q - v * r) / (p * q - r * r) AS wa, (v * p - u * r) / (p * q - r * r) AS wb, n, sa, sb, y FROM c)
SELECT block, {rnd('(y - wa * sa - wb * sb) / n', 'intercept')}, {rnd('wa', 'pred_a')}, {rnd('wb', 'pred_b')} FROM w""")
def ridge_by_block(spark, d):
    p = frame(spark, d, "prd").withColumn("block", F.floor(F.col("month") / 10).cast("int"))
    return X.tidied(L.ridge(p, ["pred_a", "pred_b"], "target", 1.0, ["block"]))


_M = lambda k: f"avg(pow(target - m, {k}))"


@query(f"""{PRD}, y AS (SELECT month, target, avg(target) OVER (PARTITION BY month) AS m, quantile_cont(target, 0.5) OVER (PARTITION BY month) AS mid, quantile_cont(abs(target), 0.99) OVER (PARTITION BY month) AS top FROM prd)
SELECT month, count(*) AS n, {rnd('avg(target)', 'mean')}, {rnd('stddev_samp(target)', 'std')}, {rnd('avg(CASE WHEN target > 0 THEN 1.0 ELSE 0.0 END)', 'positive')},
 {', '.join(rnd(f'quantile_cont(abs(target), {q})', f'abs_p{round(100 * q)}') for q in (0.5, 0.9, 0.99))}, {rnd('avg(abs(target))', 'mean_abs')}, {rnd('quantile_cont(abs(target - mid), 0.5)', 'mad')},
 {rnd(f"{_M(3)} / nullif(pow(sqrt({_M(2)}), 3), 0)", 'skewness')}, {rnd(f"{_M(4)} / nullif(pow({_M(2)}, 2), 0) - 3", 'kurtosis')}, {rnd('sum(CASE WHEN abs(target) >= top THEN target * target ELSE 0 END) / nullif(sum(target * target), 0)', 'top_share')}
FROM y GROUP BY month""")
def label_statistics(spark, d):
    return X.tidied(G.label_statistics(frame(spark, d, "prd"), "target", "month"))


@query(f"""{PRD}, a AS (SELECT *, month >= 51 AS late FROM prd)
SELECT late, count(*) AS n, {rnd('avg(pred_b)', 'mean')}, {rnd('avg(pred_b) - any_value(m)', 'mean_shift')}, {rnd('stddev_pop(pred_b) / any_value(s)', 'std_ratio')}, {rnd('quantile_cont(abs(pred_b), 0.99) / any_value(q)', 'abs_p99_ratio')}
FROM a, (SELECT avg(pred_b) AS m, stddev_pop(pred_b) AS s, quantile_cont(abs(pred_b), 0.99) AS q FROM a WHERE NOT late) GROUP BY late""")
def drift_report(spark, d):
    return X.tidied(G.drift_report(frame(spark, d, "prd"), "pred_b", F.col("month") >= 51))
