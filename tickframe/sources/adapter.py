"""Order-book tables derived from the given star-schema tables, by one SQL text for both engines."""
from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_T = {
    "mkt": """WITH b AS (SELECT user_id, event_id, {US} AS t FROM {events}),
 c AS (SELECT *, (event_id * 7919) % 41 AS k, MAX(t) OVER (PARTITION BY user_id) AS t1, MIN(t) OVER (PARTITION BY user_id) AS t0 FROM b)
SELECT user_id AS sample_id, event_id AS seq,
 (((t1 - t) * 600000 - ((t1 - t) * 600000) % (t1 - t0)) / (t1 - t0)) / 1e3 AS seconds_before_predict,
 (10000 + k) / 1e4 AS bid_price_1, CASE WHEN event_id % 97 = 0 THEN 0e0 ELSE (10001 + k + event_id % 3) / 1e4 END AS ask_price_1,
 (9990 + k) / 1e4 AS bid_price_2, CASE WHEN event_id % 97 = 0 THEN 0e0 ELSE (10004 + k + event_id % 3) / 1e4 END AS ask_price_2,
 CAST(100 * (1 + (event_id * 37) % 53) AS DOUBLE) AS bid_volume_1,
 CASE WHEN event_id % 97 = 0 THEN 0e0 ELSE CAST(100 * (1 + (event_id * 31) % 50) AS DOUBLE) END AS ask_volume_1,
 CAST(100 * (1 + (event_id * 41) % 59) AS DOUBLE) AS bid_volume_2,
 CASE WHEN event_id % 97 = 0 THEN 0e0 ELSE CAST(100 * (1 + (event_id * 43) % 61) AS DOUBLE) END AS ask_volume_2,
 CASE WHEN event_id % 5 = 0 THEN NULL ELSE (10000 + k) / 1e4 END AS transaction_avgprice,
 CAST(event_id % 5 AS BIGINT) AS transaction_count, CAST((event_id % 5) * 100 * (1 + event_id % 7) AS DOUBLE) AS transaction_volume
FROM c WHERE t1 > t0""",
    "ord": """SELECT l_suppkey - 1 AS sample_id,
 CAST(ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice,
   l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS BIGINT) AS seq,
 ((l_orderkey * 131 + l_partkey * 17 + l_linenumber * 7) % 60000) / 1e3 AS seconds_before_predict,
 (10000 + l_partkey % 200 - 100) / 1e4 AS price, l_quantity * 100 AS volume,
 CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS side, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS order_action
FROM {lineitem}""",
    "trd": """SELECT (o_custkey * 3) % (SELECT MAX(user_id) + 1 FROM {events}) AS sample_id, o_orderkey AS seq, ((o_orderkey * 97) % 60000) / 1e3 AS seconds_before_predict,
 (10000 + (o_custkey * 13 + o_orderkey) % 220 - 110) / 1e4 AS price,
 CAST((o_orderkey % 20 + 1) * 100 AS DOUBLE) AS volume, CAST((o_orderkey * 31 % 7) % 2 AS INT) AS side
FROM {orders}""",
    "lab": """SELECT user_id AS sample_id, CAST(user_id % 71 AS INT) AS month, ((user_id * 7919) % 2001 - 1000) / 1e5 AS target
FROM (SELECT DISTINCT user_id FROM {events}) d""",
    "prd": """SELECT o_orderkey AS sample_id, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS INT) AS month,
 ((o_orderkey * 7919) % 2001 - 1000) / 1e5 AS target,
 ((o_orderkey * 7919) % 2001 - 1000) / 2e5 + ((o_custkey * 31) % 1001 - 500) / 1e5 AS pred_a,
 ((o_orderkey * 104729) % 1999 - 999) / 1e3 + ((o_orderkey * 7919) % 2001 - 1000) / 2e4 AS pred_b
FROM {orders} WHERE (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 <= 70""",
}
_SOURCES = ("events", "lineitem", "orders")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of mkt, ord, trd, lab, prd."""
    text = _T[name].replace("{US}", "unix_micros(CAST(ts AS TIMESTAMP))")
    used = {s: spark.read.parquet(f"{sf_dir}/{s}.parquet") for s in _SOURCES if "{" + s + "}" in text}
    return spark.sql(text, **used)


def ordered_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order table with `seq` as the struct of the columns that its numbers go by: it sorts the same way, and no sample needs a sort of its own to number its rows."""
    text = re.sub(r"CAST\(ROW_NUMBER\(\) OVER \(PARTITION BY l_suppkey ORDER BY (.*?)\) AS BIGINT\)", r"struct(\1)", _T["ord"], flags=re.DOTALL)
    return spark.sql(text, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


@dataclass
class Tables:
    """The four keyed event tables of a split."""

    market: DataFrame
    order: DataFrame
    trade: DataFrame
    label: DataFrame


def read_tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(*(frame(spark, sf_dir, n) for n in ("mkt", "ord", "trd", "lab")))


def duck(*names: str) -> str:
    """The same tables as DuckDB common table expressions, without the leading WITH."""
    out = []
    for n in names:
        text = _T[n].replace("{US}", "epoch_us(ts)")
        for s in _SOURCES:
            text = text.replace("{" + s + "}", s)
        out.append(f"{n} AS MATERIALIZED ({text})")
    return ",\n".join(out)
