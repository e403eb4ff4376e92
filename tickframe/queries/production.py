"""Out-of-fold assembly, production blends, gates and protocol tables as queries."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import exprs as X
from ..operators import blend as J, checks as B, metrics as I, oof as O
from ..plans import protocol as H
from ..sources.adapter import duck, frame
from .sqltext import rnd

QUERIES: dict = {}
ORACLES: dict = {}
ALPHAS = [round(0.01 * i, 2) for i in range(31)]
WEIGHT = 0.37


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


PRD = f"WITH {duck('prd')}"
D = "::DOUBLE"


def cos(p, y="target"):
    return f"CASE WHEN sum({p} * {p}) * sum({y} * {y}) > 0 THEN sum({p} * {y}) / sqrt(sum({p} * {p}) * sum({y} * {y})) ELSE 0 END"


def values(rows):
    return ", ".join(f"('{n}', '{r}', {lo}, {hi})" for n, r, lo, hi in rows)


_PROTOCOLS = {"nested": H.NESTED, "rolling": H.ROLLING, "cuts": H.CUTS, "matrix": H.MATRIX, "context": H.CONTEXT}


@query(f"""{PRD}, s(protocol, split, role, lo, hi) AS (VALUES {", ".join(f"('{k}', '{n}', '{r}', {lo}, {hi})" for k, t in _PROTOCOLS.items() for n, r, lo, hi in t)})
SELECT protocol, split, role, count(*) AS n, min(month) AS first, max(month) AS last, {rnd(cos('pred_a'), 'cosine')} FROM prd JOIN s ON month BETWEEN lo AND hi GROUP BY ALL""")
def protocol_tables(spark, d):
    """Rows and cosine of every role of the nested, rolling, cut, matrix and context protocols."""
    p = frame(spark, d, "prd")
    tables = reduce(DataFrame.unionByName, [H.splits(spark, t).withColumn("split", F.concat(F.lit(f"{k} "), "split")) for k, t in _PROTOCOLS.items()])
    out = H.tag_roles(p, tables).groupBy("split", "role").agg(F.count("*").alias("n"), F.min("month").alias("first"), F.max("month").alias("last"), I.cosine("pred_a", "target").alias("cosine"))
    name = F.split("split", " ")
    return X.tidied(out.select(name[0].alias("protocol"), name[1].alias("split"), "role", "n", "first", "last", "cosine"))


def fit_sql(group):
    """DuckDB text of the two-way calibration by a group: fit(group, method, weight)."""
    sums = "count(*) AS n, sum(pred_a) AS sa, sum(pred_b) AS sb, sum(pred_a * pred_a) AS aa, sum(pred_b * pred_b) AS bb, sum(pred_a * pred_b) AS ab, sum(pred_a * target) AS ay, sum(pred_b * target) AS bz, sum(target * target) AS yy"
    dev = lambda q, s: f"sqrt(greatest({q} / n - ({s} / n) * ({s} / n), 0))"
    return f"""f AS (SELECT {group} AS grp, {sums} FROM prd GROUP BY 1),
 k AS (SELECT *, 0 AS m, 'raw' AS method, 1e0 AS ka, 1e0 AS kb FROM f UNION ALL SELECT *, 1, 'std', {dev('aa', 'sa')}, {dev('bb', 'sb')} FROM f UNION ALL SELECT *, 2, 'rms', sqrt(aa / n), sqrt(bb / n) FROM f),
 g AS (SELECT *, (1 - i / 100.0{D}) / ka AS u, i / 100.0{D} / kb AS v FROM k, range(0, 101) r(i)),
 s AS (SELECT *, round((u * ay + v * bz) / sqrt((u * u * aa + 2 * u * v * ab + v * v * bb) * yy), 9) AS score FROM g),
 fit AS (SELECT grp, method, m, i / 100.0{D} AS weight FROM s QUALIFY row_number() OVER (PARTITION BY grp ORDER BY score DESC, m, i) = 1)"""


_BLOCK = "block AS month // 10"


@query(f"""{PRD}, {fit_sql('month // 10')}, q AS (SELECT method FROM fit GROUP BY method, m ORDER BY count(*) DESC, m LIMIT 1)
SELECT q.method, {rnd('(SELECT quantile_cont(weight, 0.5) FROM fit)', 'weight')}, {rnd('ka', 'ka')}, {rnd('kb', 'kb')}
FROM q, (SELECT sqrt(avg(pred_a * pred_a)) AS ka, sqrt(avg(pred_b * pred_b)) AS kb FROM prd WHERE month > 50)""")
def production_state(spark, d):
    """Method and weight that the folds agree on, scales from the last twenty months."""
    p = frame(spark, d, "prd").withColumn("block", H.block_fold(F.col("month")))
    return X.tidied(O.production_state(J.fit_blend(p, "pred_a", "pred_b", "target", ["block"]), p.where("month > 50"), "pred_a", "pred_b"))


_OOF = f"""s(split, role, lo, hi) AS (VALUES {values(H.ROLLING)}),
 t AS (SELECT prd.*, split, role FROM prd JOIN s ON month BETWEEN lo AND hi),
 k AS (SELECT split, sqrt(avg(pred_a * pred_a)) AS ka, sqrt(avg(pred_b * pred_b)) AS kb FROM t WHERE role = 'inner_tune' GROUP BY split),
 oof AS (SELECT t.sample_id, t.month, t.target, t.split, (1 - {WEIGHT}) * pred_a / ka + {WEIGHT} * pred_b / kb AS baseline_oof, s.hi AS source_train_end
   FROM t JOIN k USING (split) JOIN s ON s.split = t.split AND s.role = 'refit_train' WHERE t.role = 'outer_valid')"""


@query(f"{PRD}, {_OOF} SELECT sample_id, month, split, source_train_end, {rnd('baseline_oof', 'baseline_oof')} FROM oof")
def canonical_oof(spark, d):
    out = O.rolling_blocks(frame(spark, d, "prd"), "pred_a", "pred_b", WEIGHT)
    return X.tidied(out.select("sample_id", "month", "split", "source_train_end", "baseline_oof"))


@query(f"""{PRD}, {_OOF} SELECT 'leak' AS "check", (SELECT count(*) FROM oof WHERE month <= source_train_end) AS violations
 UNION ALL SELECT 'not_finite', (SELECT count(*) FROM oof WHERE baseline_oof IS NULL OR NOT isfinite(baseline_oof) OR target IS NULL OR NOT isfinite(target))
 UNION ALL SELECT 'repeated', (SELECT count(*) FROM (SELECT sample_id FROM oof GROUP BY 1 HAVING count(*) > 1))
 UNION ALL SELECT 'month_missing', (SELECT count(*) FROM range(21, 71) r(m) WHERE m NOT IN (SELECT month FROM oof))
 UNION ALL SELECT 'rows', (SELECT count(*) FROM (SELECT split, count(*) AS n FROM oof GROUP BY 1) a FULL JOIN
   (SELECT split, count(*) AS n FROM prd JOIN s ON month BETWEEN lo AND hi AND role = 'outer_valid' GROUP BY 1) b USING (split) WHERE a.n IS DISTINCT FROM b.n)""")
def canonical_oof_checks(spark, d):
    """Leaks, repeats, months and strict row counts of the assembled blocks."""
    p = frame(spark, d, "prd")
    out = O.rolling_blocks(p, "pred_a", "pred_b", WEIGHT)
    want = H.tag_roles(p, H.splits(spark, H.ROLLING)).where("role = 'outer_valid'").groupBy("split").agg(F.count("*").alias("n"))
    return O.oof_checks(out).unionByName(B.row_counts(out, "split", want))


@query(f"""{PRD}, {_OOF}, v(outer_split, last) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in H.VISIBLE_END.items())}),
 b AS (SELECT outer_split, count(*) AS n, sum(baseline_oof * target) / sum(baseline_oof * baseline_oof) AS beta, {cos('baseline_oof')} AS cosine FROM oof JOIN v ON month <= last GROUP BY 1)
SELECT outer_split, n, {rnd('beta', 'beta')}, {rnd('cosine', 'cosine')} FROM b""")
def visible_residual_views(spark, d):
    """Per outer split the out-of-fold rows it may see, their slope and cosine."""
    oof = O.rolling_blocks(frame(spark, d, "prd"), "pred_a", "pred_b", WEIGHT)
    ends = spark.createDataFrame([(k, H.visible_end(k)) for k in H.VISIBLE_END], "outer_split string, last int")
    rows = oof.join(F.broadcast(ends), F.col("month") <= F.col("last"))
    p, y = F.col("baseline_oof"), F.col("target")
    return X.tidied(rows.groupBy("outer_split").agg(F.count("*").alias("n"), F.try_divide(F.sum(p * y), F.sum(p * p)).alias("beta"), I.cosine(p, y).alias("cosine")))


def alpha_sql(group, where="true", b="pred_b", src="prd"):
    """DuckDB text of the alpha search: al(grp, alpha, score, base_score, ka, kb)."""
    return f"""af AS (SELECT {group} AS grp, count(*) AS n, sum(pred_a * pred_a) AS aa, sum({b} * {b}) AS bb, sum(pred_a * {b}) AS ab, sum(pred_a * target) AS ay, sum({b} * target) AS bz, sum(target * target) AS yy FROM {src} WHERE {where} GROUP BY 1),
 ak AS (SELECT *, CASE WHEN aa > 0 THEN sqrt(aa / n) ELSE 1e0 END AS ka, CASE WHEN bb > 0 THEN sqrt(bb / n) ELSE 1e0 END AS kb FROM af),
 ag AS (SELECT *, i, i / 100.0{D} AS alpha, 1 / ka AS u, i / 100.0{D} / kb AS v FROM ak, range(0, 31) r(i)),
 az AS (SELECT *, CASE WHEN (u * u * aa + 2 * u * v * ab + v * v * bb) * yy > 0 THEN round((u * ay + v * bz) / sqrt((u * u * aa + 2 * u * v * ab + v * v * bb) * yy), 9) ELSE 0 END AS score FROM ag),
 al AS (SELECT grp, alpha, score, CASE WHEN aa * yy > 0 THEN ay / sqrt(aa * yy) ELSE 0 END AS base_score, ka, kb FROM az QUALIFY row_number() OVER (PARTITION BY grp ORDER BY score DESC, i) = 1)"""


@query(f"{PRD}, {alpha_sql('month // 10')} SELECT grp AS block, {', '.join(rnd(c, c) for c in ('alpha', 'score', 'base_score', 'ka', 'kb'))} FROM al")
def alpha_selection(spark, d):
    p = frame(spark, d, "prd").withColumn("block", H.block_fold(F.col("month")))
    return X.tidied(J.fit_alpha(p, "pred_a", "pred_b", "target", ["block"], ALPHAS))


@query(f"""{PRD}, {alpha_sql('month // 10')} SELECT month // 10 AS block, {rnd('any_value(alpha)', 'alpha')}, {rnd(f"({cos('(pred_a / ka + alpha * pred_b / kb)')}) - ({cos('pred_a')})", 'delta')}
FROM prd JOIN al ON grp = month // 10 - 1 GROUP BY 1""")
def frozen_member(spark, d):
    """Weight of the second member tuned on one block, frozen on the next."""
    p = frame(spark, d, "prd").withColumn("block", H.block_fold(F.col("month")))
    return X.tidied(O.frozen_step(p, "pred_a", "pred_b", "target", "block", ALPHAS))


@query(f"""{PRD}, m AS (SELECT month, coalesce(avg(mean) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS drift FROM (SELECT month, avg(target) AS mean FROM prd GROUP BY month)),
 pd AS (SELECT prd.*, drift FROM prd JOIN m USING (month)), {alpha_sql('1', 'month <= 50', 'drift', 'pd')}
SELECT month, {rnd('any_value(alpha)', 'alpha')}, {rnd(f"({cos('(pred_a / ka + alpha * drift / kb)')}) - ({cos('pred_a')})", 'delta')} FROM pd, al WHERE month > 50 GROUP BY month""")
def drift_correction(spark, d):
    return X.tidied(J.drift_corrected(frame(spark, d, "prd"), "pred_a", "target", F.col("month") <= 50, ALPHAS))


@query(f"""{PRD} SELECT month, {rnd(cos('(0.2 * pred_a + 0.5 * pred_b + 0.3 * tanh(pred_b))'), 'three')}, {rnd(cos('(0.8 * pred_a + 0.2 * pred_b)'), 'two')} FROM prd GROUP BY month""")
def fixed_blends(spark, d):
    p = frame(spark, d, "prd").withColumn("pred_c", F.tanh("pred_b"))
    out = p.select("month", "target", J.fixed_blend({"pred_a": 0.2, "pred_b": 0.5, "pred_c": 0.3}).alias("three"), J.fixed_blend({"pred_a": 0.8, "pred_b": 0.2}).alias("two"))
    return X.tidied(out.groupBy("month").agg(I.cosine("three", "target").alias("three"), I.cosine("two", "target").alias("two")))


@query(f"""{PRD}, s AS (SELECT count(*) AS n, sum(pred_a) AS sa, sum(pred_b) AS sb, sum(pred_a * pred_a) AS aa, sum(pred_b * pred_b) AS bb, sum(pred_a * pred_b) AS ab FROM prd),
 g AS (SELECT *, i / 10.0{D} AS w, (1 - w) AS u, sa / n AS ma, aa / n - (sa / n) * (sa / n) AS va, bb / n - (sb / n) * (sb / n) AS vb FROM s, range(0, 11) r(i)),
 h AS (SELECT *, (u * sa + w * sb) / n AS mean, sqrt(greatest((u * u * aa + 2 * u * w * ab + w * w * bb) / n - mean * mean, 0)) AS std FROM g)
SELECT {rnd('w', 'w')}, {rnd('mean', 'mean')}, {rnd('std', 'std')}, {rnd('sqrt(w * w * greatest((aa - 2 * ab + bb) / aa, 0))', 'moved')}, {rnd('sqrt(va) / std', 'factor')},
 {rnd('ma - sqrt(va) / std * mean', 'shift')}, {rnd('(ab / n - ma * sb / n) / sqrt(va * vb)', 'corr')} FROM h""")
def blend_report(spark, d):
    return X.tidied(O.blend_report(frame(spark, d, "prd"), "pred_a", "pred_b", [i / 10 for i in range(11)]))


@query(f"""{PRD}, s AS (SELECT month > 50 AS late, count(*) AS n, sum(pred_a) AS sa, sum(pred_b) AS sb, sum(pred_a * pred_a) AS aa, sum(pred_b * pred_b) AS bb, sum(pred_a * pred_b) AS ab, sum(pred_a * target) AS ay, sum(pred_b * target) AS bz, sum(target * target) AS yy FROM prd GROUP BY 1),
 k AS (SELECT i / 100.0{D} AS w, (1 - w) / sqrt(aa / n) AS u, w / sqrt(bb / n) AS v, (u * ay + v * bz) / sqrt((u * u * aa + 2 * u * v * ab + v * v * bb) * yy) AS score FROM s, range(0, 31) r(i) WHERE NOT late),
 m AS (SELECT w, late, score, (u * sa + v * sb) / n AS mean, sqrt(greatest((u * u * aa + 2 * u * v * ab + v * v * bb) / n - mean * mean, 0)) AS std FROM k, s)
SELECT {rnd('a.w', 'w')}, {rnd('a.score', 'score')}, {rnd('b.mean - a.mean', 'mean_shift')}, {rnd('b.std / a.std', 'std_ratio')} FROM m a JOIN m b ON a.w = b.w AND NOT a.late AND b.late""")
def weight_scan(spark, d):
    """Every weight from 0 to 0.3: score before month 51, and how the blend's distribution moves after it."""
    return X.tidied(O.weight_scan(frame(spark, d, "prd"), "pred_a", "pred_b", "target", F.col("month") > 50, ALPHAS))


_W3 = "w AS (SELECT i AS w0, j AS w1, 10 - i - j AS w2 FROM range(0, 11) a(i), range(0, 11) b(j) WHERE i + j <= 10)"
_BL3 = "((w0 * pred_a + w1 * pred_b + w2 * tanh(pred_b)) / 10)"


@query(f"""{PRD}, {_W3}, s AS (SELECT month // 10 AS block, w0, w1, w2, round({cos(_BL3)}, 9) AS score FROM prd, w GROUP BY ALL)
SELECT block, w0 / 10.0{D} AS pred_a, w1 / 10.0{D} AS pred_b, w2 / 10.0{D} AS pred_c, {rnd('score', 'score', 5)} FROM s QUALIFY row_number() OVER (PARTITION BY block ORDER BY score DESC, w0, w1, w2) = 1""")
def simplex_by_fold(spark, d):
    """Best grid blend of three members inside each block of months."""
    p = frame(spark, d, "prd").withColumns({"pred_c": F.tanh("pred_b"), "block": H.block_fold(F.col("month"))})
    out = J.simplex_by_fold(p, ["pred_a", "pred_b", "pred_c"], "target", "block")
    return X.tidied(out, "pred_a", "pred_b", "pred_c", digits=5)


_BINS = "CAST((e[1] <= abs(pred_a))::INT + (e[2] <= abs(pred_a))::INT + (e[3] <= abs(pred_a))::INT AS INT)"
_PY = ", ".join(f"coalesce(sum(pred_b * target) FILTER (WHERE bin = {i}), 0) AS py{i}, coalesce(sum(pred_b * pred_b) FILTER (WHERE bin = {i}), 0) AS pp{i}" for i in range(4))


@query(f"""{PRD}, q AS (SELECT quantile_cont(abs(pred_a), [0.25, 0.5, 0.75]) AS e FROM prd WHERE month <= 50),
 b AS (SELECT *, {_BINS} AS bin FROM prd, q), s AS (SELECT {_PY}, sum(target * target) AS yy FROM b WHERE month <= 50),
 x(g) AS (VALUES (0.5e0), (0.75e0), (1e0), (1.25e0), (1.5e0)),
 f AS (SELECT a.g AS g0, b.g AS g1, c.g AS g2, d.g AS g3, round((g0 * py0 + g1 * py1 + g2 * py2 + g3 * py3) / sqrt((g0 * g0 * pp0 + g1 * g1 * pp1 + g2 * g2 * pp2 + g3 * g3 * pp3) * yy)
   - 0.01 * ((g0 - 1) * (g0 - 1) + (g1 - 1) * (g1 - 1) + (g2 - 1) * (g2 - 1) + (g3 - 1) * (g3 - 1)), 9) AS score FROM s, x a, x b, x c, x d),
 t AS (SELECT * FROM f ORDER BY score DESC, g0, g1, g2, g3 LIMIT 1),
 r AS (SELECT month, target, pred_b, pred_b * [g0, g1, g2, g3][bin + 1] AS gated, pred_b * pow(abs(pred_a) / e[2], 0.25) AS powered,
   pred_b * ln(1 + exp(-1 + 2 * (SELECT count(*) FILTER (WHERE z < abs(pred_a)) FROM (SELECT unnest(e) AS z)) / 3.0{D})) AS soft FROM b, t WHERE month > 50)
SELECT month, {rnd(cos('pred_b'), 'plain')}, {rnd(cos('gated'), 'gated')}, {rnd(cos('powered'), 'powered')}, {rnd(cos('soft'), 'soft')} FROM r GROUP BY month""")
def magnitude_gates(spark, d):
    """Four-bin, power and softplus gates of a prediction by a size estimate, fitted up to month 50, scored after it."""
    p = frame(spark, d, "prd").withColumn("size", F.abs("pred_a"))
    state = O.fit_bin_gate(p.where("month <= 50"), "pred_b", "size", "target")
    r = O.apply_bin_gate(p.where("month > 50"), state, "pred_b", "size")
    r = r.withColumn("powered", O.power_gate(F.col("pred_b"), F.col("size"), F.col("e")[1], 0.25))
    r = r.withColumn("soft", O.softplus_gate(F.col("pred_b"), O.place_among("e", F.col("size")), -1.0, 2.0))
    return X.tidied(r.groupBy("month").agg(*[I.cosine(c, "target").alias(n) for c, n in (("pred_b", "plain"), ("gated", "gated"), ("powered", "powered"), ("soft", "soft"))]))


@query(f"""{PRD}, r AS (SELECT *, count(*) OVER (PARTITION BY month) AS n, row_number() OVER (PARTITION BY month ORDER BY pred_b DESC, sample_id) AS up, row_number() OVER (PARTITION BY month ORDER BY pred_b, sample_id) AS down FROM prd),
 k(share, side) AS (VALUES (0.05e0, 'top'), (0.05e0, 'bottom'), (0.1e0, 'top'), (0.1e0, 'bottom'))
SELECT month, share, side, count(*) AS n, {rnd('avg(target)', 'mean')} FROM r, k WHERE (CASE WHEN side = 'top' THEN up ELSE down END) <= floor(n * share) GROUP BY ALL""")
def top_shares(spark, d):
    """Mean target of the highest and lowest 5 and 10 per cent of a score in each month."""
    out = O.top_shares(frame(spark, d, "prd"), "pred_b", "sample_id", "month")
    return X.tidied(out.groupBy("month", "share", "side").agg(F.count("*").alias("n"), F.avg("target").alias("mean")), "share")


@query(f"""WITH {duck('lab', 'prd', 'trd')}, m(name, status, lo, hi) AS (VALUES ('R21_30', 'complete', 21, 30), ('R31_40', 'smoke', 31, 40), ('R41_50', 'complete', 41, 51), ('R71_80', 'complete', 71, 80))
SELECT 'coverage' AS "check", (SELECT count(*) FROM trd WHERE sample_id NOT IN (SELECT sample_id FROM lab)) AS violations
 UNION ALL SELECT 'equal_pred_a', (SELECT count(*) FROM prd WHERE abs(pred_a - pred_b) > 1e-3 + 0.1 * abs(pred_b))
 UNION ALL SELECT 'manifest_status', (SELECT count(*) FROM m WHERE status <> 'complete')
 UNION ALL SELECT 'manifest_months', 1 UNION ALL SELECT 'manifest_unknown', 1 UNION ALL SELECT 'manifest_missing', 2
 UNION ALL SELECT 'shared_ids', (SELECT count(*) FROM (SELECT sample_id FROM lab WHERE month <= 50 INTERSECT SELECT sample_id FROM lab WHERE month > 50))""")
def artifact_checks(spark, d):
    """Coverage of requested ids, equality rate of shared columns, a manifest against the rolling blocks, ids shared by both sides of a split."""
    lab, p = frame(spark, d, "lab"), frame(spark, d, "prd")
    manifest = spark.createDataFrame([("R21_30", "complete", 21, 30), ("R31_40", "smoke", 31, 40), ("R41_50", "complete", 41, 51), ("R71_80", "complete", 71, 80)], "name string, status string, lo int, hi int")
    want = H.splits(spark, [r for r in H.ROLLING if r[1] == "outer_valid"]).select(F.col("split").alias("name"), "lo", "hi")
    far = B.unequal(p.select("sample_id", "pred_a"), p.select("sample_id", F.col("pred_b").alias("pred_a")), "sample_id", ["pred_a"], 1e-3, 0.1)
    rows = [B.coverage(frame(spark, d, "trd"), lab), far, B.manifest(manifest, want), B.shared_keys(lab.where("month <= 50"), lab.where("month > 50"), "sample_id")]
    return reduce(DataFrame.unionByName, rows)
