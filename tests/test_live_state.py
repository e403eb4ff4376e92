"""Latest rows as streaming state: whatever batches they come in, with ties, late rows, nulls and silent keys."""
import datetime as dt
import os
import tempfile

import pytest

from tickframe.streaming import live

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "key string, ts timestamp, v long"


def at(s):
    return T0 + dt.timedelta(seconds=s)


@pytest.fixture()
def fed(spark):
    def run(*batches):
        """One file a batch, read one file at a time in order."""
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/b{i}")
            for f in os.listdir(f"{folder}/b{i}"):
                if f.endswith(".parquet"):
                    os.utime(f"{folder}/b{i}/{f}", (1_700_000_000 + 10 * i,) * 2)
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/b*")
        return live.drained(live.live_states(source, "key", "ts", "v", idle=60, late="10 seconds"), rocks=True)

    return run


def state(feed):
    return {r.key: (r["at"] // 1_000_000 - int((T0 - dt.datetime(1970, 1, 1)).total_seconds()), r.v, r.closed) for r in live.current(feed, "key", "v").collect()}


def test_state_spans_batches(fed):
    feed = fed([("a", at(0), 1), ("b", at(5), 9)], [("a", at(8), 2), ("a", at(7), 3)], [("a", at(8), 1), ("b", at(4), 8)])
    assert state(feed) == {"a": (8, 2, False), "b": (5, 9, False)}
    assert feed.where("key = 'a'").orderBy("at").select("v").collect() == [(1,), (2,)]  # late and lesser rows change nothing


def test_silent_keys_close_and_open_again(fed):
    feed = fed([("a", at(0), 1), ("a", at(0), 1), ("b", at(0), 2)], [("b", at(100), 3)], [("b", at(101), 4)], [("a", at(150), 5), ("b", at(151), 6)])
    assert state(feed) == {"a": (150, 5, False), "b": (151, 6, False)}
    closed = feed.where("closed").select("key", "v", "n").collect()
    assert ("a", 1, 2) in closed and all(r.key == "a" or r.v == 2 for r in closed)
    assert feed.where("key = 'a' and v = 5").select("n").collect() == [(1,)]  # counts begin anew


def test_nulls_and_nothing(spark, fed):
    feed = fed([("a", at(1), None), (None, at(1), 1), ("c", None, 1)], [("a", at(1), -5)])
    assert state(feed) == {"a": (1, -5, False)}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
    assert fed([]).count() == 0
