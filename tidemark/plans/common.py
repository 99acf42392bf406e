"""Shared by the query modules."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def half_up(sql: str) -> str:
    """round(x, d) in SQL as floor(x * 10^d + 0.5) / 10^d: engines round ties of doubles in different ways, but agree on this."""
    out, at = [], 0
    for found in re.finditer(r"(?<![a-z_])round\(", sql):
        if found.start() < at:
            continue
        depth, comma, i = 1, None, found.end()
        while depth:
            depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(sql[i], 0)
            if depth == 1 and sql[i] == ",":
                comma = i
            i += 1
        if comma is None:
            continue
        inner, scale = half_up(sql[found.end() : comma]), f"1e{sql[comma + 1 : i - 1].strip()}"
        out += [sql[at : found.start()], f"(floor(({inner}) * {scale} + 0.5) / {scale})"]
        at = i
    return "".join([*out, sql[at:]])


class Queries(dict):
    """Queries by name, with their SQL where there is one."""

    def __init__(self) -> None:
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def put(query: Query) -> Query:
            self[name] = query
            if sql:
                self.sql[name] = half_up(sql)
            return query

        return put


def shown(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """The columns named, doubles rounded (half up, as half_up does in SQL) and booleans as 0 and 1."""
    kinds = dict(df.dtypes)
    out = []
    for c in columns or df.columns:
        out.append((F.floor(F.col(c) * 10.0**digits + 0.5) / 10.0**digits).alias(c) if kinds[c] == "double" else F.col(c).cast("int").alias(c) if kinds[c] == "boolean" else F.col(c))
    return df.select(*out)
