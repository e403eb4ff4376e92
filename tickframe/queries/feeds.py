"""Live feeds as queries: the given tables read as streams, drained once; windows that the watermark has closed."""
from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import functions as F

from ..functions.exprs import tidied
from ..operators import families as E
from ..streaming import live
from .features import GEO_CTE, GEO_NAMES
from .sqltext import SIGNED_ORDER, rnd

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _stream(spark, d, name, ts):
    path = f"{d}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", PurePosixPath(path).name).parquet(d)
    return source.withColumn("ts", F.col(ts).cast("timestamp"))


def _plain(df, *times):
    return df.withColumns({t: F.col(t).cast("timestamp_ntz") for t in times})


_HOUR, _DAY = 3_600_000_000, 86_400_000_000
_AT = lambda us: f"make_timestamp(CAST({us} AS BIGINT))"


@query(f"""WITH e AS (SELECT *, epoch_us(ts) AS t, (SELECT max(epoch_us(ts)) FROM events) - {2 * _HOUR} AS mark FROM events)
SELECT event_type, {_AT(f't // {_HOUR} * {_HOUR}')} AS start, count(*) AS n, {rnd('sum(value)', 'v')} FROM e WHERE t // {_HOUR} * {_HOUR} + {_HOUR} <= mark GROUP BY ALL""")
def live_event_counts(spark, d):
    return tidied(_plain(live.drained(live.live_counts(_stream(spark, d, "events", "ts"))), "start"))


_SLIDE = 30 * _DAY


@query(f"""WITH o AS (SELECT l_suppkey - 1 AS sample_id, l_quantity * 100 AS volume, CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS side, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS order_action, epoch_us(l_shipdate) AS t FROM lineitem),
 w AS (SELECT *, (t // {_SLIDE} - j) * {_SLIDE} AS start FROM o, range(0, 2) r(j))
SELECT sample_id, {_AT('start')} AS start, {_AT(f'start + {2 * _SLIDE}')} AS "end", {rnd(f'sum({SIGNED_ORDER})', 'signed_volume')}, count(*) AS n FROM w WHERE start + {2 * _SLIDE} <= (SELECT max(t) FROM o) - {_SLIDE} GROUP BY ALL""")
def live_order_flow(spark, d):
    """Order flow over sliding windows of 60 days, every 30 days."""
    s = _stream(spark, d, "lineitem", "l_shipdate")
    side, action = F.when(F.col("l_linestatus") == "O", 0).otherwise(1), F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    o = s.select((F.col("l_suppkey") - 1).alias("sample_id"), (F.col("l_quantity") * 100).alias("volume"), side.alias("side"), action.alias("order_action"), "ts")
    return tidied(_plain(live.drained(live.live_flow(o, "ts", "60 days", "30 days", "30 days")), "start", "end"))


@query(f"""WITH e AS (SELECT *, epoch_us(ts) AS t, (SELECT max(epoch_us(ts)) FROM events) - {_HOUR} AS mark FROM events), k AS (SELECT *, t // {_DAY} * {_DAY} AS start FROM e WHERE t // {_DAY} * {_DAY} + {_DAY} <= mark)
SELECT user_id, {_AT('start')} AS start, ts, event_id, {rnd('value', 'value')} FROM k QUALIFY row_number() OVER (PARTITION BY user_id, start ORDER BY ts DESC, event_id DESC, value DESC) = 1""")
def live_latest_rows(spark, d):
    """The latest event of every user and day."""
    s = _stream(spark, d, "events", "ts").select("user_id", "ts", "event_id", "value")
    return tidied(_plain(live.drained(live.live_latest(s, "user_id", "ts", "event_id", "value", size="1 day", late="1 hour")), "start", "ts"))


@query(f"""WITH e AS (SELECT *, epoch_us(ts) AS t, (SELECT max(epoch_us(ts)) FROM events) - {_HOUR} AS mark FROM events),
 g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= {6 * _HOUR} THEN 0 ELSE 1 END AS first FROM e), s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS i FROM g)
SELECT user_id, {_AT('min(t)')} AS start, {_AT(f'max(t) + {6 * _HOUR}')} AS "end", count(*) AS n, {rnd('sum(value)', 'value')} FROM s GROUP BY user_id, i HAVING max(t) + {6 * _HOUR} <= any_value(mark)""")
def live_user_groups(spark, d):
    """Events of a user until six silent hours, given out whole."""
    s = _stream(spark, d, "events", "ts").select("user_id", "ts", "event_id", "value")
    out = live.drained(live.live_groups(s, "user_id", "ts", "6 hours", "1 hour", F.sum("value").alias("value")))
    return tidied(_plain(out, "start", "end"))


#: Quotes of an event feed: the levels in terms of event_id, for both engines.
_LEVEL = {"bid_price_1": "(10000 + (event_id * 7919) % 41) / 1e4", "ask_price_1": "(10001 + (event_id * 7919) % 41 + event_id % 3) / 1e4", "bid_price_2": "(9990 + (event_id * 7919) % 41) / 1e4",
          "ask_price_2": "(10004 + (event_id * 7919) % 41 + event_id % 3) / 1e4", "bid_volume_1": "CAST(100 * (1 + (event_id * 37) % 53) AS DOUBLE)", "ask_volume_1": "CAST(100 * (1 + (event_id * 31) % 50) AS DOUBLE)",
          "bid_volume_2": "CAST(100 * (1 + (event_id * 41) % 59) AS DOUBLE)", "ask_volume_2": "CAST(100 * (1 + (event_id * 43) % 61) AS DOUBLE)"}
_LEVELS = [f"{v} AS {k}" for k, v in _LEVEL.items()]


@query(f"""WITH mkt AS (SELECT user_id AS sample_id, event_id AS seq, -epoch_us(ts) AS seconds_before_predict, {', '.join(_LEVELS)} FROM events WHERE user_id IS NOT NULL), {GEO_CTE}
SELECT sample_id, g.seq, {_AT('-g.seconds_before_predict')} AS ts, (-g.seconds_before_predict) // 1000 + {_DAY // 1000} <= (SELECT max(epoch_us(ts)) // 1000 FROM events) - {_HOUR // 1000} AS closed,
 {', '.join(rnd(f'{c}::DOUBLE', c) for c in GEO_NAMES)} FROM geo JOIN g0 g USING (sample_id)""")
def live_quote_geometry(spark, d):
    """Geometry of every user's latest quote, kept as state; users silent for a day are closed."""
    quotes = _stream(spark, d, "events", "ts").selectExpr("user_id AS sample_id", "event_id AS seq", "ts", *_LEVELS)
    now = live.current(live.drained(live.live_states(quotes, "sample_id", "ts", "seq", *_LEVEL, idle=86_400, late="1 hour"), rocks=True), "sample_id", "seq", *_LEVEL)
    shape = E.lob_geometry(now.withColumn("seconds_before_predict", F.lit(0.0)))
    seen = now.select("sample_id", "seq", F.timestamp_micros("at").alias("ts"), "closed")
    return tidied(_plain(seen.join(shape, "sample_id"), "ts"), "sample_id", "seq", "closed")
