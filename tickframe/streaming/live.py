"""The event-flow and geometry families on a live feed: event-time windows with watermarks, so that state is dropped once a window is closed."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions import exprs as X
from ..session import scratch_path

_STORE = "spark.sql.streaming.stateStore.providerClass"


def live_flow(orders: DataFrame, ts: str = "ts", size: str = "60 seconds", slide: str = "5 seconds", late: str = "30 seconds", key: str = "sample_id") -> DataFrame:
    """Signed volume and event count per key and sliding window; late rows within the watermark count."""
    flow = orders.withWatermark(ts, late).groupBy(F.window(ts, size, slide), key).agg(F.sum(X.signed_order_flow()).alias("signed_volume"), F.count("*").alias("n"))
    return flow.select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "signed_volume", "n")


def live_latest(events: DataFrame, key: str, ts: str, *cols: str, size: str = "1 minute", late: str = "30 seconds") -> DataFrame:
    """Latest row per key of each closed window (ties: the greatest row)."""
    last = F.max_by(F.struct(ts, *cols), F.struct(ts, *cols)).alias("r")
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), key).agg(last).select(key, F.col("window.start").alias("start"), "r.*")


def live_counts(events: DataFrame, ts: str = "ts", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their value per closed tumbling window and type."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v")).select("event_type", F.col("window.start").alias("start"), "n", "v")


def live_groups(events: DataFrame, key: str, ts: str, gap: str, late: str, *aggs: Column) -> DataFrame:
    """Groups that end when a key is silent for `gap`: each is given out once, complete, whatever batches its rows came in."""
    g = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), key).agg(F.count("*").alias("n"), *aggs)
    return g.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), *[c for c in g.columns if c not in ("s", key)])


class LatestRow(StatefulProcessor):
    """Keeps the greatest row (at, cols) of a key and the number of rows since the key opened.  A batch that brings a greater row gives it out; a key that is silent for `idle` milliseconds
    of event time is given out as closed, and its state is dropped."""

    def __init__(self, key: str, cols: tuple[str, ...], types: tuple[str, ...], idle: int):
        self.key, self.cols, self.idle = key, ("at", *cols), idle
        self.schema = ", ".join(["at bigint", *(f"{c} {t}" for c, t in zip(cols, types, strict=True)), "n bigint"])

    def init(self, handle):
        self.handle = handle
        self.kept = handle.getValueState("latest", self.schema)

    @staticmethod
    def _place(row):
        return [(v is not None, v) for v in row]  # nulls come before all values

    def _out(self, key, state, closed):
        return pd.DataFrame([(key[0], *state, closed)], columns=[self.key, *self.cols, "n", "closed"])

    def handleInputRows(self, key, rows, timerValues):
        old = self.kept.get() if self.kept.exists() else None
        best, n = (tuple(old[:-1]), old[-1]) if old else (None, 0)
        before = best
        for t in rows:
            t = t[list(self.cols)]
            n += len(t)
            top = t[t["at"] == t["at"].max()].astype(object)
            for r in top.where(top.notna(), None).itertuples(index=False, name=None):
                if best is None or self._place(r) > self._place(best):
                    best = r
        if best is None:
            return
        self.kept.update((*best, n))
        if before is None or best[0] != before[0]:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(best[0]) // 1000 + self.idle)
        if best != before:
            yield self._out(key, (*best, n), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.kept.exists():
            yield self._out(key, tuple(self.kept.get()), True)
            self.kept.clear()

    def close(self):
        pass


def live_states(events: DataFrame, key: str, ts: str, *cols: str, idle: int, late: str = "30 seconds") -> DataFrame:
    """(key, at, cols, n, closed): a change feed of the true latest row per key (by ts, then cols; nulls least), whatever batches its rows come in; rows later than the watermark are not seen.
    `at` is ts in microseconds, idle is in seconds.  Needs the RocksDB state store (`drained(..., rocks=True)`).  Rows without key or ts are left out.  State is one row a key that is not closed."""
    kind = dict(events.dtypes)
    rows = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("at", F.unix_micros(ts)).select(key, ts, "at", *cols).withWatermark(ts, late)
    out = ", ".join([f"{key} {kind[key]}", "at bigint", *(f"{c} {kind[c]}" for c in cols), "n bigint", "closed boolean"])
    return rows.groupBy(key).transformWithStateInPandas(LatestRow(key, cols, tuple(kind[c] for c in cols), idle * 1000), out, "Append", "EventTime")


def current(feed: DataFrame, key: str, *cols: str) -> DataFrame:
    """The state that a change feed has arrived at: its greatest row per key."""
    last = F.struct("at", *cols, "closed", "n")
    return feed.groupBy(key).agg(F.max(last).alias("r")).select(key, "r.*")


def drained(stream: DataFrame, path: str | None = None, rocks: bool = False) -> DataFrame:
    """Run until what the source holds now is used up, append closed windows to a table in the shared folder, and read it; `rocks` keeps state in RocksDB,
    which timers need."""
    spark = stream.sparkSession
    path = path or scratch_path(spark)
    before = spark.conf.get(_STORE, None)
    if rocks:
        spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = stream.writeStream.format("parquet").option("path", f"{path}/table").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")
