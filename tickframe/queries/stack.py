"""The wide stack as queries: each family, and the assembled table."""
from __future__ import annotations

from ..functions.exprs import tidied
from ..operators import stack as S
from ..sources.adapter import duck, frame, ordered_orders, read_tables
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


_COUNTS = ("count(*)", "CAST(sum(n", "count(*) FILTER")


def _rounded(features: dict[str, str]) -> str:
    """Rounded columns; counts stay as they are (0 without events)."""
    return ", ".join(f'coalesce("{n}", 0) AS "{n}"' if e.startswith(_COUNTS) and "/" not in e else rnd(f'"{n}"', f'"{n}"') for n, e in features.items())


def _cte(name: str, prepared: str, features: dict[str, str]) -> str:
    return f"{name}_p AS ({prepared}), {name} AS (SELECT sample_id, {', '.join(f'{e} AS {n}' for n, e in features.items())} FROM {name}_p GROUP BY sample_id)"


_T = _cte("t", f"SELECT p.*, quantile_cont(p.volume, 0.9) OVER () AS q90, quantile_cont(p.volume, 0.95) OVER () AS q95 FROM ({S.PREPARED.format(events='trd')}) p", S.TRADES)
_O = _cte("o", S.PREPARED.format(events="ord"), S.ORDERS)
_M = _cte("m", S.QUOTES.format(events="(SELECT * FROM mkt WHERE ask_price_1 > 0)"), S.MARKET)


def _sec(name, table, kind, features):
    grid = f"(SELECT sample_id, CAST(g AS INT) AS g FROM (SELECT DISTINCT sample_id FROM {table} WHERE seconds_before_predict BETWEEN 0 AND 60) d, range(0, 61) r(g))"
    return _cte(name, S.SECONDS.format(grid=grid, events=f"(SELECT *, {kind} AS kind FROM {table})"), features)


_TS, _OS = _sec("ts", "trd", "side", S.TRADE_SECONDS), _sec("os", "ord", "order_action", S.ORDER_SECONDS)


@query(f"WITH {duck('trd')}, {_T} SELECT sample_id, {_rounded(S.TRADES)} FROM t")
def stack_trades(spark, d):
    return tidied(S.trades(frame(spark, d, "trd")))


@query(f"WITH {duck('ord')}, {_O} SELECT sample_id, {_rounded(S.ORDERS)} FROM o")
def stack_orders(spark, d):
    return tidied(S.orders(ordered_orders(spark, d)))


@query(f"WITH {duck('mkt')}, {_M} SELECT sample_id, {_rounded(S.MARKET)} FROM m")
def stack_quotes(spark, d):
    return tidied(S.quotes(frame(spark, d, "mkt")))


@query(f"WITH {duck('trd')}, {_TS} SELECT sample_id, {_rounded(S.TRADE_SECONDS)} FROM ts")
def stack_trade_seconds(spark, d):
    return tidied(S.seconds(frame(spark, d, "trd"), "side", S.TRADE_SECONDS))


@query(f"WITH {duck('ord')}, {_OS} SELECT sample_id, {_rounded(S.ORDER_SECONDS)} FROM os")
def stack_order_seconds(spark, d):
    return tidied(S.seconds(frame(spark, d, "ord"), "order_action", S.ORDER_SECONDS))


_ALL = {n: e for f in (S.TRADES, S.ORDERS, S.TRADE_SECONDS, S.ORDER_SECONDS, S.MARKET) for n, e in f.items() if n not in S.DROPPED}
_X = {n: e for n, e in S.CROSS.items() if n not in S.DROPPED}


@query(f"""WITH {duck('mkt', 'ord', 'trd')}, {_T}, {_O}, {_TS}, {_OS}, {_M}, j AS (SELECT * FROM t LEFT JOIN o USING (sample_id) LEFT JOIN ts USING (sample_id) LEFT JOIN os USING (sample_id) LEFT JOIN m USING (sample_id)),
 k AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _X.items())} FROM j) SELECT DISTINCT sample_id, {_rounded(_ALL)}, {', '.join(rnd(n, n) for n in _X)} FROM k""")
def stack_assembled(spark, d):
    t = read_tables(spark, d)
    return tidied(S.stack(t.market, ordered_orders(spark, d), t.trade))
