"""Audits and diagnostics as queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import tidied
from ..operators import audit as A, families as E, prep as K
from ..plans import protocol as H
from ..sources.adapter import duck, frame
from .evaluation import COS, PRD
from .sqltext import rnd

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query(f"{PRD} " + " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", {rnd(f'corr({a}, {b})', 'corr')} FROM prd" for a, b in (("pred_a", "pred_b"), ("pred_a", "target"), ("pred_b", "target"))))
def correlation_pairs(spark, d):
    return tidied(A.correlation_pairs(frame(spark, d, "prd"), ["pred_a", "pred_b", "target"]))


@query(f"""{PRD}, f AS (SELECT target > 0 AS high, month // 10 AS fold, unnest(['pred_a', 'pred_b']) AS name, unnest([pred_a, pred_b]) AS v FROM prd),
 p AS (SELECT name, fold, avg(v) FILTER (WHERE high) - avg(v) FILTER (WHERE NOT high) AS gap FROM f GROUP BY ALL),
 c AS (SELECT name, greatest(avg(CASE WHEN gap > 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN gap < 0 THEN 1.0 ELSE 0.0 END)) AS consistency FROM p GROUP BY name),
 e AS (SELECT name, (avg(v) FILTER (WHERE high) - avg(v) FILTER (WHERE NOT high)) / sqrt((var_samp(v) FILTER (WHERE high) + var_samp(v) FILTER (WHERE NOT high)) / 2) AS d FROM f GROUP BY name)
SELECT name, {rnd('d', 'd')}, {rnd('consistency', 'consistency')} FROM e JOIN c USING (name)""")
def effect_size(spark, d):
    return tidied(A.effect_size(frame(spark, d, "prd"), F.col("target") > 0, ["pred_a", "pred_b"], H.block_fold(F.col("month"))))


@query(f"""{PRD}, q AS (SELECT target, CAST((row_number() OVER (PARTITION BY month ORDER BY pred_a, sample_id) - 1) * 5 // count(*) OVER (PARTITION BY month) + 1 AS INT) AS qa,
 CAST((row_number() OVER (PARTITION BY month ORDER BY pred_b, sample_id) - 1) * 5 // count(*) OVER (PARTITION BY month) + 1 AS INT) AS qb FROM prd)
SELECT qa, qb, count(*) AS n, {rnd('avg(target)', 'mean')} FROM q GROUP BY ALL""")
def conditional_grid(spark, d):
    return tidied(A.conditional_grid(frame(spark, d, "prd"), "pred_a", "pred_b", "target", "sample_id"))


@query(f"""{PRD}, e AS (SELECT quantile_cont(abs(target), [0.25, 0.5, 0.75, 0.9]) AS e FROM prd), b AS (SELECT *, CAST(len(list_filter(e, lambda v: v <= abs(target))) AS INT) AS bucket FROM prd, e)
SELECT bucket, count(*) AS n, {rnd('avg(CASE WHEN sign(pred_a) = sign(target) THEN 1.0 ELSE 0.0 END)', 'sign_accuracy')}, {rnd('corr(pred_a, target)', 'corr')}, {rnd('sum(pred_a * target) / sum(sum(pred_a * target)) OVER ()', 'share')} FROM b GROUP BY bucket""")
def magnitude_buckets(spark, d):
    return tidied(A.magnitude_buckets(frame(spark, d, "prd"), "pred_a", "target"))


@query(f"""{PRD}, m AS (SELECT month, avg(target) AS mean, stddev_samp(target) / sqrt(count(*)) AS se FROM prd GROUP BY month), l AS (SELECT *, {', '.join(f'lag(mean, {k}) OVER (ORDER BY month) AS l{k}' for k in range(1, 13))} FROM m)
SELECT {', '.join(rnd(f'corr(mean, l{k})', f'acf_{k}') for k in range(1, 13))}, {rnd('avg(abs(mean) / nullif(se, 0))', 'mean_abs_se')}, {rnd('regr_slope(mean, month)', 'slope')}, {rnd('avg(abs(mean))', 'mean_abs')}, {rnd('avg(CASE WHEN sign(mean) = sign(l1) THEN 1.0 ELSE 0.0 END) FILTER (WHERE l1 IS NOT NULL)', 'persistence')} FROM l""")
def monthly_mean_diagnostics(spark, d):
    return tidied(A.monthly_mean_diagnostics(frame(spark, d, "prd").groupBy("month").agg(F.avg("target").alias("mean"), (F.stddev_samp("target") / F.sqrt(F.count("*"))).alias("se"))))


@query(f"""{PRD}, m AS (SELECT month, ({COS('pred_a', 'target')}) - ({COS('pred_b', 'target')}) AS delta FROM prd GROUP BY month)
SELECT avg(delta) > 0 AS mean_up, quantile_cont(delta, 0.5) > 0 AS median_up, min(delta) > -1 AS no_bad_month, avg(CASE WHEN delta > 0 THEN 1.0 ELSE 0.0 END) >= 0.5 AS mostly_up FROM m""")
def stability_gate(spark, d):
    return A.gate(frame(spark, d, "prd"), "pred_b", "pred_a", "target")


@query(f"WITH {duck('mkt')} " + " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) FILTER (WHERE isnan({c}::DOUBLE)) AS nans, count(*) FILTER (WHERE isinf({c}::DOUBLE)) AS infinite, count(*) FILTER (WHERE abs({c}) > 1e6) AS extreme, min({c}) = max({c}) AS constant FROM mkt" for c in ("ask_price_1", "transaction_avgprice", "transaction_volume")))
def null_audit(spark, d):
    return A.null_audit(frame(spark, d, "mkt"), ["ask_price_1", "transaction_avgprice", "transaction_volume"])


@query(f"""WITH {duck('trd')}, u AS (SELECT DISTINCT sample_id, price FROM trd), g AS (SELECT round(price - lag(price) OVER (PARTITION BY sample_id ORDER BY price), 6) AS gap FROM u)
SELECT gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY gap""")
def price_spacing(spark, d):
    return A.spacing(frame(spark, d, "trd"), "price", "sample_id")


@query(f"""{PRD}, b AS (SELECT *, month // 10 AS block FROM prd)
SELECT CAST(block AS INT) AS block, count(*) AS n, {rnd('regr_slope(pred_b, pred_a)', 'slope')}, {rnd('regr_intercept(pred_b, pred_a)', 'intercept')}, {rnd('stddev_pop(pred_b) * sqrt(greatest(1 - coalesce(corr(pred_a, pred_b), 0) ** 2, 0))', 'residual_std')} FROM b GROUP BY block""")
def orthogonal_residual(spark, d):
    return tidied(A.orthogonal_residual(frame(spark, d, "prd").withColumn("block", H.block_fold(F.col("month"))), "pred_a", "pred_b", "block"))


_FORMS = (5, 10, 15, 30, 60, 120, 180, 300, 600)


@query(f"""WITH {duck('mkt')}, a AS (SELECT *, (bid_price_1 + ask_price_1) / 2 AS mid, bid_volume_1 - ask_volume_1 AS imb, row_number() OVER (PARTITION BY sample_id ORDER BY seconds_before_predict DESC, seq) AS k FROM mkt WHERE ask_price_1 > 0),
 b AS (SELECT *, coalesce(imb - lag(imb) OVER (PARTITION BY sample_id ORDER BY k), 0) AS step FROM a)
SELECT sample_id, {', '.join(x for w in _FORMS for x in (rnd(f'coalesce(sum(step) FILTER (WHERE seconds_before_predict < {w}), 0)', f'form_flow_{w}'), rnd(f'avg(imb) FILTER (WHERE seconds_before_predict < {w})', f'form_imb_{w}'), rnd(f'stddev_samp(mid) FILTER (WHERE seconds_before_predict < {w})', f'form_std_{w}'), rnd(f'arg_max(mid, k) FILTER (WHERE seconds_before_predict < {w})', f'form_last_{w}')))} FROM b GROUP BY sample_id""")
def market_forms(spark, d):
    return tidied(E.market_forms(frame(spark, d, "mkt"), _FORMS))


@query(f"""{PRD}, f AS (SELECT abs(corr(pred_a, target)) AS a, abs(corr(pred_b, target)) AS b FROM prd WHERE month <= 50), s AS (SELECT avg(pred_a) AS ma, stddev_pop(pred_a) AS sa FROM prd WHERE month <= 50)
SELECT sample_id, {rnd('(pred_a - ma) / (CASE WHEN sa < 1e-10 THEN 1 ELSE sa END)', 'pred_a')}, a >= 0.5 AS drop_a, b >= 0.5 AS drop_b FROM prd, f, s WHERE month > 50""")
def fold_safe_selection(spark, d):
    p = frame(spark, d, "prd")
    train = p.where("month <= 50")
    flags = K.correlated(train, ["pred_a", "pred_b"], "target", 0.5)
    state = train.agg(F.avg("pred_a").alias("m"), F.stddev_pop("pred_a").alias("s"))
    out = p.where("month > 50").join(F.broadcast(state)).join(F.broadcast(flags))
    z = (F.col("pred_a") - F.col("m")) / F.when(F.col("s") < 1e-10, 1.0).otherwise(F.col("s"))
    return tidied(out.select("sample_id", z.alias("pred_a"), F.col("pred_a_high").alias("drop_a"), F.col("pred_b_high").alias("drop_b")))
