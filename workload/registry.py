"""Registration of queries, and the named sub-queries their SQL twins are made of."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Named sub-queries; each may use the tables and the names above it.
PARTS: dict[str, str] = {}


def part(name: str, body: str) -> None:
    PARTS[name] = body.strip()


def with_parts(body: str) -> str:
    """Prefix ``body`` with the sub-queries it mentions, in order of definition."""
    needed: set[str] = set()
    pending = [body]
    while pending:
        text = pending.pop()
        for name in PARTS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                pending.append(PARTS[name])
    if not needed:
        return body.strip()
    ctes = ",\n".join(f"{n} AS (\n{PARTS[n]}\n)" for n in PARTS if n in needed)
    return f"WITH {ctes}\n{body.strip()}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_parts(sql)
        return fn

    return add
