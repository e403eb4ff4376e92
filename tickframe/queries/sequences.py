"""Sequences, their layers and surrogates, intensities, tensors, forensics and named subsets as queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import tidied
from ..operators import families, micro, sequences as Q, stack
from ..sources.adapter import duck, frame, read_tables
from . import features, more
from .production import PRD
from .stack import ORACLES as STACK
from .sqltext import rnd

QUERIES: dict = {}
ORACLES: dict = {}
STEPS, WIDTH = 200, 3.0
CHANNELS = ["mid", "spread1", "imb1", "imb2"]


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_IMB = lambda i: f"(bid_volume_{i} - ask_volume_{i}) / (bid_volume_{i} + ask_volume_{i} + 1e-6)"
_CH = {c: f"coalesce({c}, 0)" for c in Q.RAW} | {"mid": "(bid_price_1 + ask_price_1) / 2"}
for _i in (1, 2):
    _CH |= {f"spread{_i}": f"ask_price_{_i} - bid_price_{_i}", f"depth{_i}": f"bid_volume_{_i} + ask_volume_{_i}", f"imb{_i}": _IMB(_i)}


def _seq(steps=STEPS):
    cols = ", ".join(f"{e} AS {n}" for n, e in _CH.items())
    return f"""sq0 AS (SELECT *, lead(seconds_before_predict) OVER (PARTITION BY sample_id ORDER BY seconds_before_predict DESC, seq) AS nxt FROM mkt),
 sq AS (SELECT sample_id, {cols}, CAST(s AS INT) AS step FROM (SELECT * REPLACE (bid_price_1 AS bid_price_1) FROM sq0) q, range(0, {steps}) g(s)
  WHERE s <= floor(seconds_before_predict / {WIDTH}) AND s >= coalesce(floor(nxt / {WIDTH}) + 1, 0))"""


@query(f"WITH {duck('mkt')}, {_seq()} SELECT sample_id, step, {', '.join(rnd(c, c) for c in _CH)} FROM sq")
def quote_sequence(spark, d):
    """200 steps of three seconds, 18 channels."""
    return tidied(Q.sequence(frame(spark, d, "mkt"), STEPS, WIDTH))


_AGG, _OUT = Q.layer_texts(len(CHANNELS), 10)


@query(f"""WITH {duck('mkt')}, {_seq()}, p AS ({Q.prepared_text(CHANNELS, 10).format(events='sq')}), a AS (SELECT sample_id, {', '.join(f'{e} AS {n}' for n, e in _AGG.items())} FROM p GROUP BY sample_id),
 o AS (SELECT sample_id, rows, {', '.join(f'{e} AS f_{n}' for n, e in _OUT.items())} FROM a) SELECT sample_id, rows, {', '.join(rnd(f'f_{n}', f'f_{n}', 4) for n in _OUT)} FROM o""")
def sequence_layers(spark, d):
    """Moments, covariances, lagged correlations and cross-spectra of the newest ten steps of four channels."""
    return tidied(Q.sequence_layers(Q.sequence(frame(spark, d, "mkt"), STEPS, WIDTH), CHANNELS, 10), digits=4)


_H = "(sample_id * 7919 + {b} * 104729 + 15485863 + 12345) % 1000003"
_LAG = "coalesce(mid - lag(mid) OVER (PARTITION BY sample_id ORDER BY step DESC), 0)"


@query(f"""WITH {duck('mkt')}, {_seq()}, f AS (SELECT sample_id FROM sq GROUP BY 1 HAVING count(*) = {STEPS}), s AS (SELECT sample_id, step, mid, imb1 FROM sq JOIN f USING (sample_id)),
 k AS (SELECT 'reverse' AS kind, sample_id, {STEPS} - 1 - step AS step, mid, imb1 FROM s
  UNION ALL SELECT 'shuffle', sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY {_H.format(b='step')}, step) - 1, mid, imb1 FROM s
  UNION ALL SELECT 'block', sample_id, (dense_rank() OVER (PARTITION BY sample_id ORDER BY {_H.format(b='(step // 20)')}, step // 20) - 1) * 20 + step % 20, mid, imb1 FROM s
  UNION ALL SELECT 'desync', a.sample_id, (a.step + a.sample_id * 31 + 17) % {STEPS}, a.mid, b.imb1 FROM s a JOIN s b ON a.sample_id = b.sample_id AND (a.step + a.sample_id * 31 + 17) % {STEPS} = (b.step + b.sample_id * 31 + 34) % {STEPS}),
 x AS (SELECT *, {_LAG} AS dm FROM (SELECT * FROM k)), g AS (SELECT x.*, row_number() OVER (PARTITION BY kind, sample_id ORDER BY step) AS r FROM (SELECT kind, sample_id, step, mid, imb1, coalesce(mid - lag(mid) OVER (PARTITION BY kind, sample_id ORDER BY step DESC), 0) AS dm FROM k) x)
SELECT kind, sample_id, count(DISTINCT step) AS steps, {rnd('avg(mid)', 'mean')}, {rnd('1e3 * avg(abs(dm))', 'step_size')}, {rnd('1e3 * avg(dm * imb1)', 'together')} FROM g GROUP BY ALL""")
def surrogate_sequences(spark, d):
    """Full sequences and four surrogates of them: what stays (mean) and what goes (steps, what channels do together)."""
    kinds = [F.struct(F.lit(k).alias("kind"), Q.surrogate_path(k, ["mid", "imb1"], STEPS, 20).alias("path")) for k in ("reverse", "shuffle", "block", "desync")]
    rows = Q.full_sequences(frame(spark, d, "mkt"), ["mid", "imb1"], STEPS, WIDTH).select("sample_id", F.inline(F.array(*kinds)))
    g = rows.select("kind", "sample_id", Q.path_sums(F.col("path"), "mid", "imb1").alias("s"))
    return tidied(g.select("kind", "sample_id", F.col("s.steps").alias("steps"), F.try_divide("s.total", "s.n").alias("mean"), (F.try_divide("s.moved", "s.steps") * 1e3).alias("step_size"), (F.try_divide("s.together", "s.pairs") * 1e3).alias("together")))


@query(None)
def phase_randomised(spark, d):
    """Energy of each channel before and after its phases are drawn anew (it stays)."""
    seq = Q.sequence(frame(spark, d, "mkt"), STEPS, WIDTH)
    out = Q.phase_randomised(seq, ["imb1", "imb2"]).toDF("sample_id", "step", "r1", "r2").join(seq, ["sample_id", "step"])
    return out.groupBy("sample_id").agg(*[F.sum(F.col(c) * F.col(c)).alias(f"energy_{c}") for c in ("imb1", "r1", "imb2", "r2")])


@query(f"""{PRD}, q AS (SELECT quantile_cont(target, {[i / 20 for i in range(1, 20)]}) AS e, quantile_cont(abs(target), 0.9) AS p FROM prd WHERE month <= 50)
SELECT sample_id, CAST(sign(target) AS DOUBLE) AS sign, {rnd('abs(target)', 'size')}, {rnd('len(list_filter(e, lambda x: x <= target)) / 20e0', 'place')}, abs(target) > p AS large FROM prd, q WHERE month > 50""")
def target_probes(spark, d):
    p = frame(spark, d, "prd").select("sample_id", "month", "target")
    return tidied(Q.target_probes(p, "target", F.col("month") <= 50, 20).where("month > 50").select("sample_id", "sign", "size", "place", "large"))


_KIND = "CASE WHEN side = 0 THEN 'bid' ELSE 'ask' END || CASE WHEN order_action = 0 THEN '_add' ELSE '_cancel' END"
_EV = f"""ev AS (SELECT sample_id, CAST(floor(seconds_before_predict) AS INT) AS g, {_KIND} AS kind, volume, price FROM ord WHERE seconds_before_predict >= 0 AND seconds_before_predict < 60
 UNION ALL SELECT sample_id, CAST(floor(seconds_before_predict) AS INT), CASE WHEN side = 0 THEN 'buy' ELSE 'sell' END, volume, price FROM trd WHERE seconds_before_predict >= 0 AND seconds_before_predict < 60)"""
_INT = ", ".join(f"{rnd(f'sum({k}) / 60e0', f'{k}_rate')}, max({k}) AS {k}_peak, {rnd(f'(coalesce(sum({k}) FILTER (WHERE g < 30), 0) - coalesce(sum({k}) FILTER (WHERE g >= 30), 0)) / 30e0', f'{k}_trend')}" for k in Q.CLASSES)


@query(f"WITH {duck('ord', 'trd')}, {_EV}, p AS (SELECT sample_id, g, {', '.join(f'''count(*) FILTER (WHERE kind = '{k}') AS {k}''' for k in Q.CLASSES)} FROM ev GROUP BY ALL) SELECT sample_id, {_INT} FROM p GROUP BY sample_id")
def event_intensity(spark, d):
    t = read_tables(spark, d)
    return tidied(Q.intensity(t.order, t.trade))


_VOL = lambda k: f"coalesce(sum(volume) FILTER (WHERE kind = '{k}'), 0)"
_FLOW = f"{_VOL('bid_add')} - {_VOL('ask_add')} - {_VOL('bid_cancel')} + {_VOL('ask_cancel')}"


@query(f"""WITH {duck('ord', 'trd')}, {_EV} SELECT sample_id, g, {', '.join(rnd(_VOL(k), f'{k}_volume') for k in Q.CLASSES)}, {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}_count" for k in Q.CLASSES)}, {rnd(_FLOW, 'order_flow')},
 {rnd(f"{_VOL('buy')} - {_VOL('sell')}", 'trade_flow')}, {rnd("avg(price) FILTER (WHERE kind NOT IN ('buy', 'sell'))", 'order_price')}, {rnd("avg(price) FILTER (WHERE kind IN ('buy', 'sell'))", 'trade_price')} FROM ev GROUP BY ALL""")
def fast_tensor(spark, d):
    t = read_tables(spark, d)
    return tidied(Q.fast_tensor(t.order, t.trade))


@query(f"""WITH {duck('mkt')}, m AS (SELECT *, (bid_price_1 + ask_price_1) / 2 AS mid, row_number() OVER (PARTITION BY sample_id ORDER BY seconds_before_predict DESC, seq) AS k FROM mkt WHERE seconds_before_predict >= 0 AND seconds_before_predict < 60 AND ask_price_1 > 0)
SELECT sample_id, {rnd('(arg_max(mid, k) - arg_min(mid, k)) / (arg_min(mid, k) + 1e-12)', 'ret')}, {rnd('stddev_samp(mid)', 'std')}, {rnd('avg(ask_price_1 - bid_price_1)', 'spread')}, {rnd('avg(bid_volume_1 + ask_volume_1)', 'depth')},
 {rnd('coalesce(sum(transaction_volume), 0)', 'volume')}, CAST(sum(transaction_count) AS BIGINT) AS trades, count(*) AS rows FROM m GROUP BY sample_id""")
def window_proxies(spark, d):
    return tidied(Q.window_proxies(frame(spark, d, "mkt")))


@query(f"""WITH {duck('ord')}, e AS (SELECT sample_id, quantile_cont(price, 0.5) FILTER (WHERE seconds_before_predict >= 58) AS o, quantile_cont(price, 0.5) FILTER (WHERE seconds_before_predict <= 2) AS n FROM ord GROUP BY 1),
 f AS (SELECT *, row_number() OVER (ORDER BY sample_id) AS i, row_number() OVER (ORDER BY (sample_id * 7919 + 15485863 + 12345) % 1000003, sample_id) AS j FROM e WHERE o IS NOT NULL AND n IS NOT NULL)
SELECT count(*) AS pairs, {rnd('avg(abs(b.o - a.n))', 'jump')}, {rnd('avg(abs(c.o - a.n))', 'dealt')} FROM f a JOIN f b ON b.i = a.i + 1 JOIN f c ON c.j = a.i + 1""")
def adjacency(spark, d):
    return tidied(Q.adjacency(frame(spark, d, "ord")))


def _subset(sql: str, names) -> str:
    return f"SELECT {', '.join(names)} FROM ({sql}) x"


_OFI = features.ORACLES["full_ofi"]


@query(f"SELECT sample_id, month, target, COLUMNS('{'|'.join(Q.STAGES[k] for k in 'ABCD')}') FROM ({_OFI}) x")
def order_flow_stage_d(spark, d):
    """The order-flow family up to stage D."""
    t = read_tables(spark, d)
    return tidied(Q.staged(families.full_ofi(t.order, t.trade, t.market, t.label), "D"), "target")


@query(_subset(STACK["stack_assembled"], ["sample_id", *Q.STATE]))
def market_states(spark, d):
    t = read_tables(spark, d)
    return tidied(stack.stack(t.market, t.order, t.trade, Q.STATE))


@query(f"SELECT sample_id, COLUMNS('{Q.CONTEXT}') FROM ({more.ORACLES['normalised_windows']}) x")
def context_subset(spark, d):
    t = read_tables(spark, d)
    return tidied(Q.matching(micro.normalised_windows(t.market, t.order, t.trade, t.label), Q.CONTEXT))
