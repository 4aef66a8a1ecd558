"""Registered queries: a callable (spark, sf_dir) each, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

import re
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def nudged(sql: str) -> str:
    """sql with 1e-9 added to what each round() rounds, as scalars.rounded() does, so that both engines send ties the same way."""
    out = []
    for m in re.finditer(r"\bround\(", sql):
        depth, i, comma = 1, m.end(), None
        while depth:
            c = sql[i]
            depth += (c in "([") - (c in ")]")
            if c == "," and depth == 1:
                comma = i
            i += 1
        out.append((comma, " + 1e-9::DOUBLE"))
    for at, text in sorted((x for x in out if x[0]), reverse=True):
        sql = sql[:at] + text + sql[at:]
    return sql


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = nudged(sql)
        return f

    return add
