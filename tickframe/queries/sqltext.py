"""Small builders for the DuckDB texts."""
from __future__ import annotations

import re


def rnd(x: str, name: str, digits: int = 6) -> str:
    return f"round(({x}) + {3e-4 * 10.0**-digits!r}, {digits}) + 0.0 AS {name}"


def win(w, strict=False) -> str:
    return f"seconds_before_predict >= 0 AND seconds_before_predict {'<' if strict else '<='} {w}"


def flt(agg: str, cond: str) -> str:
    return f"{agg} FILTER (WHERE {cond})"


def zero(x: str) -> str:
    return f"coalesce({x}, 0)"


def ratio(n: str, d: str) -> str:
    return f"(CASE WHEN {d} > 0 THEN ({n}) / ({d}) ELSE 0 END)"


def one_line(s: str) -> str:
    return re.sub(r"\s+", " ", s).strip()


SIGNED_ORDER = "(volume * (CASE WHEN side = 0 THEN 1 ELSE -1 END) * (CASE WHEN order_action = 0 THEN 1 ELSE -1 END))"
SIGNED_TRADE = "(volume * (CASE WHEN side = 0 THEN 1 ELSE -1 END))"
