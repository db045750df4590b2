"""Queries by name, with the SQL that gives the same rows.

Means of values with two decimals often end in a five, which the last bit of a sum would
round either way.  So every rounding on both sides first adds a small fraction of its
last digit.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def offset(digits: int) -> float:
    return float(f"3.7e-{digits + 4}")


def rounded(value: Column | str, digits: int) -> Column:
    return F.round((F.col(value) if isinstance(value, str) else value) + offset(digits), digits)


def _sql_rounded(sql: str) -> str:
    out, at = "", 0
    for m in re.finditer(r"\bround\(", sql):
        if m.start() < at:
            continue
        depth, k = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inside, _, digits = sql[m.end() : k - 1].rpartition(",")
        out += sql[at : m.start()] + f"round(({_sql_rounded(inside)}) + {offset(int(digits))}, {digits.strip()})"
        at = k
    return out + sql[at:]


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = _sql_rounded(sql)
        return fn

    return keep
