"""Fold ridges, innovations, feature selection, scalers and retrieval experiments as queries."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import exprs as X
from ..operators import blend as J, linear as M, metrics as I, prep as K, retrieval as L
from ..plans import protocol as H
from ..sources.adapter import duck, frame
from .production import ALPHAS, PRD, cos, values
from .sqltext import rnd

QUERIES: dict = {}
ORACLES: dict = {}
D = "::DOUBLE"
LAM = 10.0


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _sums(group, x, y, where="true", src="prd"):
    """DuckDB text of the Gram sums of one or two columns."""
    a, b = (x + ["0e0"])[:2]
    return f"""SELECT {group} AS grp, count(*)::DOUBLE AS n, sum({a}) AS s1, sum({b}) AS s2, sum({a} * {a}) AS q11, sum({b} * {b}) AS q22, sum({a} * {b}) AS q12, sum({y}) AS h0, sum({a} * {y}) AS h1, sum({b} * {y}) AS h2,
 sum({y} * {y}) AS yy FROM {src} WHERE {where} GROUP BY 1"""


_NAMES = ("n", "s1", "s2", "q11", "q22", "q12", "h0", "h1", "h2", "yy")


def _coefs(sums: str, name: str, two: bool, lam=LAM) -> str:
    """CTEs that turn the Gram sums of a CTE into standardised ridge coefficients: name(grp, c, b1, b2)."""
    z = "(CASE WHEN true THEN 0e0 END)"
    return f"""{name}_s AS (SELECT *, s1 / n AS m1, s2 / n AS m2, sqrt(greatest(q11 / n - (s1 / n) * (s1 / n), 0)) + 1e-9 AS d1, sqrt(greatest(q22 / n - (s2 / n) * (s2 / n), 0)) + 1e-9 AS d2 FROM {sums}),
 {name}_t AS (SELECT *, (q11 - n * m1 * m1) / (d1 * d1) + {lam} AS p, (q22 - n * m2 * m2) / (d2 * d2) + {lam} AS q, (q12 - n * m1 * m2) / (d1 * d2) AS r, (h1 - m1 * h0) / d1 AS u, (h2 - m2 * h0) / d2 AS v FROM {name}_s),
 {name}_w AS (SELECT *, {'(u * q - v * r) / (p * q - r * r)' if two else 'u / p'} / d1 AS b1, {'(v * p - u * r) / (p * q - r * r) / d2' if two else z} AS b2 FROM {name}_t),
 {name} AS (SELECT grp, -(b1 * m1 + b2 * m2) AS c, b1, b2 FROM {name}_w)"""


def _others(name, x, y, where="true", src="prd", fold="month // 10"):
    """CTEs of the sums of all folds but one: name(grp, ...), and of all folds: grp -1."""
    rest = ", ".join(f"t.{c} - f.{c} AS {c}" for c in _NAMES)
    return f"""{name}_f AS ({_sums(fold, x, y, where, src)}), {name}_a AS (SELECT {', '.join(f'sum({c}) AS {c}' for c in _NAMES)} FROM {name}_f),
 {name} AS (SELECT f.grp, {rest} FROM {name}_f f, {name}_a t UNION ALL SELECT -1, {', '.join(_NAMES)} FROM {name}_a)"""


_MODELS = {"a": ["pred_a"], "b": ["pred_b"], "ab": ["pred_a", "pred_b"]}


def _oof_sql():
    parts, preds, joins = [], [], []
    for k, x in _MODELS.items():
        parts += [_others(f"g{k}", x, "target"), _coefs(f"g{k}", f"w{k}", len(x) == 2)]
        preds.append(f"w{k}.c + w{k}.b1 * {x[0]} + w{k}.b2 * {(x + ['0'])[1]} AS {k}")
        joins.append(f"JOIN w{k} ON w{k}.grp = month // 10")
    rows = " UNION ALL ".join(f"SELECT block, '{k}' AS model, target, {k} AS p, big, rank() OVER (PARTITION BY block ORDER BY round({k}, 12)) + (count(*) OVER (PARTITION BY block, round({k}, 12)) - 1) / 2.0 AS r FROM o" for k in _MODELS)
    n1 = "count(*) FILTER (WHERE big)"
    return f"""{PRD}, {', '.join(parts)}, p AS (SELECT month // 10 AS block, target, {', '.join(preds)} FROM prd {' '.join(joins)}),
 o AS (SELECT *, target >= quantile_cont(target, 0.9) OVER (PARTITION BY block) AS big FROM p), r AS ({rows})
SELECT block, model, count(*) AS n, {rnd('1 - sum((target - p) * (target - p)) / (sum(target * target) - sum(target) * sum(target) / count(*))', 'r2')}, {rnd('1e3 * avg(abs(target - p))', 'mae')},
 {rnd(f'(sum(r) FILTER (WHERE big) - {n1} * ({n1} + 1) / 2.0) / ({n1} * (count(*) - {n1}))', 'auc')} FROM r GROUP BY ALL"""


@query(_oof_sql())
def oof_ridge_models(spark, d):
    """Out-of-fold ridges on either member and on both: R2, mean absolute error (thousandths) and AUC of the top tenth, per block."""
    p = frame(spark, d, "prd").withColumn("block", H.block_fold(F.col("month")))
    o = M.oof_predictions(p, _MODELS, "target", "block", LAM)
    edge = o.groupBy("block").agg(F.percentile("target", 0.9).alias("edge"))
    o = o.join(F.broadcast(edge), "block").withColumn("big", F.col("target") >= F.col("edge"))
    flat = o.select("block", "target", "big", F.explode(F.array(*[F.struct(F.lit(k).alias("model"), F.col(k).alias("p")) for k in _MODELS])).alias("m")).select("block", "target", "big", "m.*")
    m = flat.groupBy("block", "model").agg(F.count("*").alias("n"), I.r2("p", "target").alias("r2"), (F.avg(F.abs(F.col("target") - F.col("p"))) * 1e3).alias("mae"))
    ranked = flat.withColumn("p", F.round("p", 12))  # equal to twelve digits is a tie, in any engine
    return X.tidied(m.join(I.auc(ranked, "p", F.col("big"), ["block", "model"]), ["block", "model"]))


@query(f"""{PRD}, {_others('g', ['pred_a'], 'pred_b', 'month <= 50')}, {_coefs('g', 'w', False)}, r AS (SELECT month, pred_b - w.c - w.b1 * pred_a AS r FROM prd JOIN w ON w.grp = CASE WHEN month <= 50 THEN month // 10 ELSE -1 END),
 m AS (SELECT quantile_cont(r, 0.5) AS mid FROM r WHERE month <= 50), s AS (SELECT quantile_cont(abs(r - mid), 0.5) AS mad FROM r, m WHERE month <= 50), z AS (SELECT month, least(greatest(r / mad, -6), 6) AS z FROM r, s)
SELECT month, count(*) AS n, {rnd('avg(z)', 'mean')}, {rnd('stddev_pop(z)', 'std')}, {rnd('avg(CASE WHEN abs(z) >= 6 THEN 1e0 ELSE 0 END)', 'clipped')} FROM z GROUP BY month""")
def innovations(spark, d):
    """What the first member does not explain of the second, in robust deviations, per month."""
    p = frame(spark, d, "prd").withColumn("block", H.block_fold(F.col("month")))
    z = M.innovations(p, ["pred_a"], "pred_b", "block", F.col("month") <= 50, LAM)
    return X.tidied(z.groupBy("month").agg(F.count("*").alias("n"), F.avg("innovation").alias("mean"), F.stddev_pop("innovation").alias("std"), F.avg((F.abs("innovation") >= 6).cast("double")).alias("clipped")))


@query(f"""{PRD}, c AS (SELECT corr(pred_a, target) AS a, corr(pred_b, target) AS b, corr(pred_a, pred_b) AS r FROM prd), k AS (SELECT a * a AS ra, b * b AS rb, (a * a + b * b - 2 * a * b * r) / (1 - r * r) AS rr FROM c)
SELECT 'a' AS name, {rnd('ra', 'r2')} FROM k UNION ALL SELECT 'b', {rnd('rb', 'r2')} FROM k UNION ALL SELECT 'ab', {rnd('rr', 'r2')} FROM k""")
def explained_shares(spark, d):
    return X.tidied(M.explained(frame(spark, d, "prd"), _MODELS, "target"))


@query(f"""{PRD}, f AS (SELECT month, target, 'pred_a' AS name, pred_a AS x FROM prd UNION ALL SELECT month, target, 'pred_b', pred_b FROM prd), w AS (SELECT name, sign(covar_pop(x, target)) AS s FROM f GROUP BY 1),
 p AS (SELECT name, month, sign(covar_pop(x, target)) AS own FROM f GROUP BY 1, 2) SELECT name, count(*) AS months, {rnd('avg(CASE WHEN own = s THEN 1e0 ELSE 0 END)', 'agree')} FROM p JOIN w USING (name) GROUP BY name""")
def sign_stability(spark, d):
    return X.tidied(M.sign_stability(frame(spark, d, "prd"), ["pred_a", "pred_b"], "target", "month"))


@query(f"""{PRD}, s(split, role, lo, hi) AS (VALUES {values(H.CONTEXT)}), t AS (SELECT prd.*, split, role FROM prd JOIN s ON month BETWEEN lo AND hi),
 g AS ({_sums('split', ['pred_a', 'pred_b'], 'target', "role = 'train'", 't')}), {_coefs('g', 'w', True)}
SELECT split, count(*) AS n, {rnd(cos('(w.c + w.b1 * pred_a + w.b2 * pred_b)'), 'cosine')}, {rnd('1e3 * avg(w.c + w.b1 * pred_a + w.b2 * pred_b - target)', 'bias')} FROM t JOIN w ON w.grp = split WHERE role = 'score' GROUP BY split""")
def context_shift(spark, d):
    """Ridges on months from 21 on, scored on the next ten months: cosine and bias (thousandths)."""
    out = M.forward_ridge(frame(spark, d, "prd"), H.CONTEXT, ["pred_a", "pred_b"], "target", LAM)
    return X.tidied(out.groupBy("split").agg(F.count("*").alias("n"), I.cosine("forward", "target").alias("cosine"), (F.avg(F.col("forward") - F.col("target")) * 1e3).alias("bias")))


_FEATURES = {"pred_a": "pred_a", "pred_b": "pred_b", "twice": "2 * pred_a + pred_b * 1e-3", "squashed": "tanh(pred_b)", "noise": "((sample_id * 7919) % 101) / 1e2"}
_PAIRS = [(a, b) for i, a in enumerate(_FEATURES) for b in list(_FEATURES)[i + 1 :]]


@query(f"""{PRD.replace('WITH', 'WITH RECURSIVE')}, x AS (SELECT target, {', '.join(f'{e} AS {n}' for n, e in _FEATURES.items())} FROM prd),
 c(name, c) AS (SELECT unnest([{', '.join(f"'{n}'" for n in _FEATURES)}]), unnest([{', '.join(f'abs(corr({n}, target))' for n in _FEATURES)}]) FROM x),
 p(a, b, v) AS (SELECT unnest([{', '.join(f"'{a}'" for a, _ in _PAIRS)}]), unnest([{', '.join(f"'{b}'" for _, b in _PAIRS)}]), unnest([{', '.join(f'round(abs(corr({a}, {b})), 9)' for a, b in _PAIRS)}]) FROM x),
 q AS (SELECT p.*, ca.c AS ca, cb.c AS cb, row_number() OVER (ORDER BY v DESC, a DESC, b DESC) AS i FROM p JOIN c ca ON ca.name = a JOIN c cb ON cb.name = b WHERE v >= 0.9 AND ca.c >= 0.05 AND cb.c >= 0.05),
 r AS (SELECT 0 AS i, []::VARCHAR[] AS gone UNION ALL SELECT q.i, CASE WHEN list_contains(gone, a) OR list_contains(gone, b) THEN gone ELSE list_append(gone, CASE WHEN ca >= cb THEN b ELSE a END) END FROM r JOIN q ON q.i = r.i + 1)
SELECT name, {rnd('c', 'corr')}, c >= 0.05 AND NOT list_contains((SELECT gone FROM r ORDER BY i DESC LIMIT 1), name) AS kept FROM c""")
def feature_selection(spark, d):
    p = frame(spark, d, "prd").select("target", *[F.expr(e).alias(n) for n, e in _FEATURES.items()])
    return X.tidied(K.select_features(p, list(_FEATURES), "target", 0.05, 0.9))


@query(f"""{PRD}, q AS (SELECT quantile_cont(pred_b, [0.01, 0.99]) AS q FROM prd WHERE month <= 50), c AS (SELECT quantile_cont(least(greatest(pred_b, q[1]), q[2]), [0.25, 0.5, 0.75]) AS r FROM prd, q WHERE month <= 50)
SELECT sample_id, {rnd('least(greatest((least(greatest(pred_b, q[1]), q[2]) - r[2]) / greatest(r[3] - r[1], 1e-6), -5), 5)', 'pred_b')} FROM prd, q, c WHERE month > 50""")
def state_scaling(spark, d):
    p = frame(spark, d, "prd").select("sample_id", "month", "pred_b")
    return X.tidied(K.apply_state(p.where("month > 50"), K.fit_state(p.where("month <= 50"), ["pred_b"]), ["pred_b"]).select("sample_id", "pred_b"))


@query(f"""{PRD}, s AS (SELECT avg(pred_a) AS ma, stddev_pop(pred_a) AS sa, avg(pred_b) AS mb, stddev_pop(pred_b) AS sb FROM prd WHERE month <= 50), z AS (SELECT sample_id, (pred_a - ma) / sa AS x, (pred_b - mb) / sb AS y FROM prd, s WHERE month > 50)
SELECT sample_id, {rnd('x / sqrt(x * x + y * y)', 'pred_a')}, {rnd('y / sqrt(x * x + y * y)', 'pred_b')} FROM z""")
def unit_states(spark, d):
    """Standardised members, each row brought to norm one."""
    p, c = frame(spark, d, "prd").select("sample_id", "month", "pred_a", "pred_b"), ["pred_a", "pred_b"]
    z = K.apply_zscore(p.where("month > 50"), K.fit_zscore(p.where("month <= 50"), c), c)
    return X.tidied(K.unit_rows(z, c).select("sample_id", *c))


@query(f"""{PRD}, x AS (SELECT sample_id, month, CASE WHEN sample_id % 5 = 0 THEN pred_b ELSE 0 END AS sparse FROM prd), q AS (SELECT quantile_cont(sparse, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM x WHERE month <= 50),
 z AS (SELECT sample_id, (sparse - q[3]) / (CASE WHEN q[4] > q[2] THEN q[4] - q[2] WHEN q[5] > q[1] THEN (q[5] - q[1]) / 2 ELSE 1 END) AS z FROM x, q WHERE month > 50)
SELECT sample_id, {rnd('z / sqrt(1 + (z / 3) * (z / 3))', 'sparse')} FROM z""")
def smooth_clip(spark, d):
    """Robust scaling with smooth clipping of a column that is mostly zero: half of its range stands in for its empty interquartile range."""
    p = frame(spark, d, "prd").select("sample_id", "month", F.when(F.col("sample_id") % 5 == 0, F.col("pred_b")).otherwise(0.0).alias("sparse"))
    return X.tidied(K.apply_robust(p.where("month > 50"), K.fit_robust(p.where("month <= 50"), ["sparse"], True), ["sparse"], 3.0).select("sample_id", "sparse"))


@query(f"""WITH {duck('ord')}, k AS (SELECT count(DISTINCT side) AS a, count(DISTINCT price) AS b, count(DISTINCT volume) AS c, count(DISTINCT CASE WHEN side < 5 THEN 1 END) AS e FROM ord)
SELECT name, values, CASE WHEN values > 100 THEN 'quantile' ELSE 'robust' END AS kind, values > 1 AS kept FROM k, LATERAL (VALUES ('side', a), ('price', b), ('volume', c), ('constant', e)) v(name, values)""")
def scaling_choice(spark, d):
    """Which scaling a column calls for by its number of values, and whether it varies at all."""
    o = frame(spark, d, "ord").select("side", "price", "volume", F.lit(1).alias("constant"))
    return K.scaling_choice(o, o.columns).join(K.varying(o, o.columns), "name")


@query(None)
def residual_codes(spark, d):
    """Two layers of four codes of a prediction: rows and mean left-over per code pair."""
    out = K.residual_codes(frame(spark, d, "prd"), "pred_a", 2, 4)
    return out.groupBy("code_0", "code_1").agg(F.count("*").alias("n"), F.avg("left_over").alias("left_over"))


def _states(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select("vec_id", (F.col("vec_id") % 71).alias("month"), F.col("embedding").alias("z"), F.col("label").cast("double").alias("v"))


@query(None)
def prototype_prediction(spark, d):
    """Value of every state from the nearest prototypes of earlier months, by inverse squared distance."""
    e = _states(spark, d)
    p = L.prototypes(e.withColumnRenamed("vec_id", "key"), 8, 64)
    pairs = L.knn(e.select(F.col("vec_id").alias("q"), "month", "z"), p.select("b", "month", "z"), 5)
    return L.inverse_square_mean(pairs, p.select("b", "v"))


@query(None)
def expert_mixture(spark, d):
    """Ridge experts at four state centres of the months up to 50, mixed by distance for all later states."""
    e = _states(spark, d).withColumns({"x1": F.get("z", F.lit(0)).cast("double"), "x2": F.get("z", F.lit(1)).cast("double")})
    train, query_ = e.where("month <= 50").withColumnRenamed("vec_id", "key"), e.where("month > 50").withColumnRenamed("vec_id", "q")
    return L.expert_mixture(train, query_, 4, 64, ["x1", "x2"], "v", 1.0, 1.0)


def _retrieval_sql():
    unit = "list_transform(z, lambda x: x / greatest(sqrt(list_sum(list_transform(z, lambda w: w * w))), 1e-12))"
    parts, rows = [], []
    for metric, z in (("euclidean", "z"), ("cosine", unit)):
        parts.append(f"""e_{metric} AS (SELECT vec_id, month, v, {z} AS z FROM e),
 p_{metric} AS (SELECT q.vec_id AS q, b.vec_id AS b, b.v, round(sqrt(list_sum(list_transform(list_zip(q.z, b.z), lambda x: (x[1] - x[2]) * (x[1] - x[2])))), 9) AS dist FROM e_{metric} q JOIN e_{metric} b ON b.month < q.month WHERE q.vec_id % 50 = 0)""")
        for k in (5, 10):
            n = f"{metric}_{k}"
            parts.append(f"""k_{n} AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, b) AS rank FROM p_{metric} QUALIFY rank <= {k}),
 h_{n} AS (SELECT q, sum(w * v) / sum(w) AS r FROM (SELECT *, exp(-0.5 * pow(dist / greatest(max(dist) OVER (PARTITION BY q), 1e-12), 2)) AS w FROM k_{n}) GROUP BY q)""")
            rows.append(f"SELECT '{metric}' AS metric, {k} AS k, (e.vec_id * 31) % 7 / 7e0 AS pred_a, r AS pred_b, e.v AS target FROM h_{n} JOIN e ON e.vec_id = q")
    return f"""WITH e AS (SELECT vec_id, vec_id % 71 AS month, embedding::DOUBLE[] AS z, label::DOUBLE AS v FROM embeddings), {', '.join(parts)}, prd AS ({' UNION ALL '.join(rows)}),
 af AS (SELECT metric, k, count(*) AS n, sum(pred_a * pred_a) AS aa, sum(pred_b * pred_b) AS bb, sum(pred_a * pred_b) AS ab, sum(pred_a * target) AS ay, sum(pred_b * target) AS bz, sum(target * target) AS yy FROM prd GROUP BY ALL),
 ak AS (SELECT *, sqrt(aa / n) AS ka, CASE WHEN bb > 0 THEN sqrt(bb / n) ELSE 1e0 END AS kb FROM af), ag AS (SELECT *, i, i / 100.0{D} AS alpha, 1 / ka AS u, i / 100.0{D} / kb AS w FROM ak, range(0, 31) r(i)),
 az AS (SELECT *, round((u * ay + w * bz) / sqrt((u * u * aa + 2 * u * w * ab + w * w * bb) * yy), 9) AS score FROM ag)
SELECT metric, k, {rnd('alpha', 'alpha')}, {rnd('score', 'score')}, {rnd('score - ay / sqrt(aa * yy)', 'gain')} FROM az QUALIFY row_number() OVER (PARTITION BY metric, k ORDER BY score DESC, i) = 1"""


@query(_retrieval_sql())
def retrieval_experiment(spark, d):
    """Neighbour estimates for two metrics and two neighbourhood sizes beside a base prediction: best alpha and its gain."""
    e = _states(spark, d)
    asked, bank = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), "month", "z"), e.select(F.col("vec_id").alias("b"), "month", "z")
    val = e.select(F.col("vec_id").alias("b"), "v")
    out = []
    for metric in ("euclidean", "cosine"):
        near = L.knn(asked, bank, 10, metric=metric)
        for k in (5, 10):
            est = L.neighbour_mean(near.where(F.col("rank") <= k), val).select(F.col("q").alias("vec_id"), F.col("estimate").alias("r"))
            rows = e.join(est, "vec_id").select(((F.col("vec_id") * 31) % 7 / 7.0).alias("p"), "r", "v").withColumns({"metric": F.lit(metric), "k": F.lit(k)})
            out.append(J.fit_alpha(rows, "p", "r", "v", ["metric", "k"], ALPHAS))
    got = reduce(DataFrame.unionByName, out)
    return X.tidied(got.select("metric", "k", "alpha", "score", (F.col("score") - F.col("base_score")).alias("gain")))
