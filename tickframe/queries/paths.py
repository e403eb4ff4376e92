"""As-of paths, grids and live feeds as queries."""
from __future__ import annotations


from pyspark.sql import Window as W, functions as F

from ..functions.exprs import tidied
from ..operators import asof as A
from ..operators.families import path_window
from ..sources.adapter import duck, frame, read_tables
from ..streaming import live
from .features import KEEP, _ofi_case
from .sqltext import SIGNED_TRADE, rnd

QUERIES: dict = {}
ORACLES: dict = {}
WINDOWS = A.WINDOWS
VALID = "bid_price_2 <= bid_price_1 AND bid_price_1 < ask_price_1 AND ask_price_1 <= ask_price_2 AND least(bid_volume_1, ask_volume_1, bid_volume_2, ask_volume_2) >= 0 AND seconds_before_predict BETWEEN 0 AND 60"


def query(sql):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_Q = f"ok AS (SELECT * FROM mkt WHERE {VALID}), q AS (SELECT *, {_ofi_case(1)}, {_ofi_case(2)}, row_number() OVER w AS rn FROM ok WINDOW w AS (PARTITION BY sample_id ORDER BY seconds_before_predict DESC, seq))"
_GRID = "grid AS (SELECT q.sample_id, r.g, max(rn) AS rn FROM q JOIN range(0, 61) r(g) ON seconds_before_predict >= r.g GROUP BY ALL)"


def _corr_sql(x, y, cond):
    f = f"FILTER (WHERE {cond} AND {x} IS NOT NULL AND {y} IS NOT NULL)"
    n, norm = f"count(*) {f}", f"(count(*) {f} * sqrt(var_pop({x}) {f} * var_pop({y}) {f}))"
    return f"(CASE WHEN {n} >= 3 AND {norm} > 1e-8 THEN {n} * covar_pop({x}, {y}) {f} / {norm} ELSE 0 END)"


def _temporal_sql():
    ch = {"c0": "bid_volume_1 / t", "c1": "ask_volume_1 / t", "c2": "bid_volume_2 / t", "c3": "ask_volume_2 / t", "c4": "(bid_volume_1 - ask_volume_1) / l1", "c5": "(bid_volume_2 - ask_volume_2) / l2", "c6": "(bid_volume_1 + bid_volume_2 - ask_volume_1 - ask_volume_2) / t", "c7": "(l1 - l2) / t"}
    out, ups = {}, {}
    for w in WINDOWS:
        p, c = f"geom_t{w}", f"g <= {w}"
        out[f"{p}_coverage"] = f"count(*) FILTER (WHERE {c}) / {w + 1}.0"
        out |= {f"{p}_corr_{a}_{b}": _corr_sql(f"c{a}", f"c{b}", c) for a, b in A.PAIRS}
        out |= {f"{p}_leadlag_{a}_{b}": f"{_corr_sql(f'c{a}', f'n{b}', c)} - {_corr_sql(f'n{a}', f'c{b}', c)}" for a, b in A.PAIRS}
        for s in (6, 7):
            f = f"FILTER (WHERE {c})"
            out |= {f"{p}_c{s}_mean": f"avg(c{s}) {f}", f"{p}_c{s}_std": f"stddev_pop(c{s}) {f}", f"{p}_c{s}_change": f"arg_min(c{s}, g) {f} - arg_max(c{s}, g) {f}"}
        ups[f"{p}_log_updates"] = f"ln(1 + count(*) FILTER (WHERE seconds_before_predict <= {w}))"
    cols = ", ".join(rnd(f"coalesce({k}, 0)::DOUBLE", k) for k in [*out, *ups])
    return f"""WITH {duck('mkt', 'lab')}, {_Q}, {_GRID},
 p AS (SELECT grid.sample_id, g, {', '.join(f'{v} AS {k}' for k, v in ch.items())} FROM grid JOIN (SELECT *, greatest(bid_volume_1 + ask_volume_1, 1e-12) AS l1, greatest(bid_volume_2 + ask_volume_2, 1e-12) AS l2, greatest(l1 + l2, 1e-12) AS t FROM q) q USING (sample_id, rn)),
 n AS (SELECT *, {', '.join(f'lead(c{i}) OVER w AS n{i}' for i in range(8))} FROM p WINDOW w AS (PARTITION BY sample_id ORDER BY g DESC)),
 f AS (SELECT sample_id, {', '.join(f'{v} AS {k}' for k, v in out.items())} FROM n GROUP BY sample_id), u AS (SELECT sample_id, {', '.join(f'{v} AS {k}' for k, v in ups.items())} FROM ok GROUP BY sample_id)
SELECT lab.sample_id, month, target, {cols} FROM lab LEFT JOIN f USING (sample_id) LEFT JOIN u USING (sample_id)"""


@query(_temporal_sql())
def geometry_temporal(spark, d):
    t = read_tables(spark, d)
    return tidied(A.geometry_temporal(t.market, t.label), *KEEP)


def _signature_sql():
    x = {"x0": "ln(mid / first_value(mid) OVER k) * 1e4", "x1": "(ask_price_1 - bid_price_1) / greatest(abs(mid), 1e-12) * 1e4", "x2": "(bid_volume_1 - ask_volume_1) / (bid_volume_1 + ask_volume_1 + 1e-12)", "x3": "(bid_volume_2 - ask_volume_2) / (bid_volume_2 + ask_volume_2 + 1e-12)", "x4": "(cum - first_value(cum) OVER k) / greatest(coalesce(scale, 1e-12), 1e-12)", "x5": "coalesce(tc / greatest(tv, 1e-12), 0)", "x6": "(w - g) / w::DOUBLE"}
    names = {**{f"level1_{A.CHANNELS[i]}": f"arg_min(y{i}, g)" for i in range(7)}, **{f"area_{A.CHANNELS[i]}__{A.CHANNELS[j]}": f"0.5 * sum(y{i} * z{j} - y{j} * z{i})" for i in range(7) for j in range(i + 1, 7)}}
    cols = ", ".join(rnd(f"coalesce(max(CASE WHEN w = {w} THEN {k} END), 0)::DOUBLE", f"path_sig_t{w}_{k}") for w in WINDOWS for k in names)
    ws = "(VALUES (5), (15), (30), (60)) v(w)"
    return f"""WITH {duck('mkt', 'trd', 'lab')}, {_Q}, {_GRID},
 c AS (SELECT *, sum(q1 + q2) OVER (PARTITION BY sample_id ORDER BY rn) AS cum, (bid_price_1 + ask_price_1) / 2 AS mid FROM q),
 s AS (SELECT sample_id, w, avg(bid_volume_1 + ask_volume_1 + bid_volume_2 + ask_volume_2) AS scale FROM ok, {ws} WHERE seconds_before_predict <= w GROUP BY ALL),
 tr AS (SELECT sample_id, w, seconds_before_predict AS sec, volume, {SIGNED_TRADE} AS v FROM trd, {ws} WHERE seconds_before_predict BETWEEN 0 AND w),
 tw AS (SELECT sample_id, w, sum(abs(volume)) AS tv FROM tr GROUP BY ALL),
 b AS (SELECT grid.sample_id, w, g, c.* EXCLUDE (sample_id, seq) FROM grid JOIN c USING (sample_id, rn), {ws} WHERE g <= w),
 tg AS (SELECT b.sample_id, b.w, b.g, sum(v) AS tc FROM b JOIN tr ON tr.sample_id = b.sample_id AND tr.w = b.w AND tr.sec >= b.g GROUP BY ALL),
 p AS (SELECT b.*, scale, tv, tc FROM b LEFT JOIN s USING (sample_id, w) LEFT JOIN tw USING (sample_id, w) LEFT JOIN tg USING (sample_id, w, g)),
 e AS (SELECT sample_id, w, g, {', '.join(f'{v} AS {k}' for k, v in x.items())} FROM p WINDOW k AS (PARTITION BY sample_id, w ORDER BY g DESC)),
 y AS (SELECT sample_id, w, g, {', '.join(f'x{i} - first_value(x{i}) OVER k AS y{i}' for i in range(7))} FROM e WINDOW k AS (PARTITION BY sample_id, w ORDER BY g DESC)),
 z AS (SELECT *, {', '.join(f'lead(y{i}) OVER k AS z{i}' for i in range(7))} FROM y WINDOW k AS (PARTITION BY sample_id, w ORDER BY g DESC)),
 f AS (SELECT sample_id, w, {', '.join(f'CASE WHEN count(*) >= 3 THEN {v} ELSE 0 END AS {k}' for k, v in names.items())} FROM z GROUP BY ALL)
SELECT lab.sample_id, any_value(month) AS month, any_value(target) AS target, {cols} FROM lab LEFT JOIN f USING (sample_id) GROUP BY lab.sample_id"""


@query(_signature_sql())
def path_signature(spark, d):
    t = read_tables(spark, d)
    return tidied(A.path_signature(t.market, t.trade, t.label), *KEEP)


@query(f"""WITH {duck('ord', 'trd', 'lab')},
 o AS (SELECT sample_id, floor(seconds_before_predict)::INT AS g, {', '.join(f"coalesce(sum(volume) FILTER (WHERE side = {s} AND order_action = {a}), 0) AS {k}" for k, s, a in (('bid_add', 0, 0), ('ask_add', 1, 0), ('bid_cancel', 0, 1), ('ask_cancel', 1, 1)))} FROM ord GROUP BY ALL),
 t AS (SELECT sample_id, floor(seconds_before_predict)::INT AS g, coalesce(sum(volume) FILTER (WHERE side = 0), 0) AS buy, coalesce(sum(volume) FILTER (WHERE side = 1), 0) AS sell FROM trd GROUP BY ALL)
SELECT sample_id, g, {', '.join(f'coalesce({c}, 0)::DOUBLE AS {c}' for c in ('bid_add', 'ask_add', 'bid_cancel', 'ask_cancel', 'buy', 'sell'))} FROM o FULL JOIN t USING (sample_id, g)""")
def second_grid(spark, d):
    t = read_tables(spark, d)
    return A.second_grid(t.order, t.trade)


@query(f"""WITH {duck('trd')}, x AS (SELECT *, ln(price) AS lp FROM trd), e AS (SELECT quantile_cont(lp, {[i / 16 for i in range(1, 16)]}) AS e FROM x)
SELECT sample_id, CAST(len(list_filter(e, lambda z: z <= lp)) AS INT) AS bin, sum({SIGNED_TRADE})::DOUBLE AS signed, sum(volume) AS total, count(*) AS n FROM x, e GROUP BY ALL""")
def price_histogram(spark, d):
    return A.price_histogram(frame(spark, d, "trd"))


@query(f"""WITH {duck('ord')}, b AS (SELECT DISTINCT sample_id, floor(seconds_before_predict)::INT AS g FROM ord WHERE seconds_before_predict >= 0 AND seconds_before_predict < 60),
 r AS (SELECT sample_id, g, coalesce(lag(g) OVER (PARTITION BY sample_id ORDER BY g DESC), 60) - g - 1 AS gap FROM b)
SELECT sample_id, CAST(greatest(max(gap), min(g)) AS INT) AS longest_gap, count(*) AS busy_seconds FROM r GROUP BY sample_id""")
def longest_gap(spark, d):
    return A.longest_gap(frame(spark, d, "ord"))


@query(f"""WITH {duck('mkt')}, r AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY sample_id ORDER BY seconds_before_predict DESC, seq) AS k, (bid_price_1 + ask_price_1) / 2 AS mid FROM mkt WHERE ask_price_1 > 0 WINDOW w AS (PARTITION BY sample_id)),
 s AS (SELECT *, (k - 1) * 3 // n AS part, mid - lag(mid) OVER (PARTITION BY sample_id ORDER BY k) AS dm FROM r)
SELECT sample_id, CAST(part AS INT) AS part, count(*) AS n, {rnd('avg(mid)', 'mean')}, {rnd('stddev_pop(mid)', 'std')}, {rnd('arg_max(mid, k) - arg_min(mid, k)', 'trend')}, {rnd('coalesce(avg(abs(dm)), 0)', 'mean_step')}, {rnd('coalesce(sqrt(sum(dm * dm)), 0)', 'rv')} FROM s GROUP BY ALL""")
def path_segments(spark, d):
    """Terciles of each sample's quotes, oldest first."""
    m = frame(spark, d, "mkt").where("ask_price_1 > 0").withColumn("mid", (F.col("bid_price_1") + F.col("ask_price_1")) / 2)
    m = m.withColumns({"k": F.row_number().over(path_window()), "n": F.count("*").over(W.partitionBy("sample_id")), "dm": F.col("mid") - F.lag("mid").over(path_window())})
    part = F.floor((F.col("k") - 1) * 3 / F.col("n")).cast("int")
    out = m.groupBy("sample_id", part.alias("part")).agg(F.count("*").alias("n"), F.avg("mid").alias("mean"), F.stddev_pop("mid").alias("std"), (F.max_by("mid", "k") - F.min_by("mid", "k")).alias("trend"), F.coalesce(F.avg(F.abs("dm")), F.lit(0.0)).alias("mean_step"), F.coalesce(F.sqrt(F.sum(F.col("dm") * F.col("dm"))), F.lit(0.0)).alias("rv"))
    return tidied(out)
