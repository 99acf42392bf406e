"""A small filter and sort program over any table: rows of conditions, as in a spreadsheet, to one Catalyst predicate.

Conditions joined by OR form a group; an AND condition closes the group before it and stands by itself;
groups and conditions all have to hold. Unknown columns and conditions are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    """action: filter or sort. condition: what CONDITIONS has, or the direction of a sort. logic: AND or OR."""

    action: str
    column: str
    condition: str = ""
    value: str = ""
    logic: str = "AND"
    order: int = 0


def _equal(c: Column, value: str) -> Column:
    if value.strip().upper() in ("TRUE", "FALSE"):
        return c.cast("boolean") == F.lit(value.strip().upper() == "TRUE")
    return c.cast("string") == F.lit(value)


def _number(compare: Callable[[Column, Column], Column]) -> Callable[[Column, str], Column]:
    return lambda c, value: compare(c.try_cast("double"), F.lit(value).try_cast("double"))


def _between(c: Column, value: str) -> Column:
    low, _, high = value.partition(",")
    return c.try_cast("double").between(F.lit(low).try_cast("double"), F.lit(high).try_cast("double"))


CONDITIONS: dict[str, Callable[[Column, str], Column]] = {
    "equals": _equal,
    "not_equals": lambda c, value: ~_equal(c, value),
    "greater_than": _number(lambda a, b: a > b),
    "less_than": _number(lambda a, b: a < b),
    "greater_equal": _number(lambda a, b: a >= b),
    "less_equal": _number(lambda a, b: a <= b),
    "between": _between,
    "contains": lambda c, value: c.cast("string").rlike(value),
    "icontains": lambda c, value: c.cast("string").rlike(f"(?i){value}"),
}


def predicate(columns: Sequence[str], steps: Sequence[Step]) -> Column:
    parts: list[Column] = []
    group: list[Column] = []
    for step in sorted((s for s in steps if s.action == "filter"), key=lambda s: s.order):
        if step.column not in columns or step.condition not in CONDITIONS:
            continue
        test = F.coalesce(CONDITIONS[step.condition](F.col(step.column), step.value), F.lit(False))
        if step.logic.upper() == "OR":
            group.append(test)
        else:
            if group:
                parts.append(reduce(Column.__or__, group))
                group = []
            parts.append(test)
    if group:
        parts.append(reduce(Column.__or__, group))
    return reduce(Column.__and__, parts, F.lit(True))


def applied(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """df filtered, then sorted by the sort steps that name its columns (ascending unless they say desc)."""
    out = df.where(predicate(df.columns, steps))
    sorts = [s for s in sorted(steps, key=lambda s: s.order) if s.action == "sort" and s.column in df.columns]
    keys = [F.col(s.column).desc_nulls_last() if s.condition.lower().startswith("desc") else F.col(s.column).asc_nulls_last() for s in sorts]
    return out.orderBy(*keys) if keys else out


def read_program(df: DataFrame) -> list[Step]:
    """Steps of a program table: Step, Action, Column, Condition, Value, Logic. Programs are a few rows."""
    rows = df.select(*(F.col(c).cast("string") for c in ("Step", "Action", "Column", "Condition", "Value", "Logic"))).collect()
    return [Step((r["Action"] or "").lower(), r["Column"] or "", (r["Condition"] or "").lower(), r["Value"] or "", r["Logic"] or "AND", int(float(r["Step"] or 0))) for r in rows]


def threshold(df: DataFrame, column: str, value: float, operator: str = ">=") -> DataFrame:
    c = F.col(column)
    return df.where({">=": c >= value, "<=": c <= value, ">": c > value, "<": c < value, "==": c == value}[operator])


def common_tickers(*tables: DataFrame) -> DataFrame:
    """Tickers that all tables have."""
    return reduce(DataFrame.intersect, (t.select("ticker") for t in tables))


def merged(tables: dict[str, DataFrame]) -> DataFrame:
    """Common tickers with the columns of all tables; a column that an earlier table has gets the table's name behind it, and source_{name} says who had it."""
    out = None
    for name, table in tables.items():
        seen = set(out.columns) - {"ticker"} if out else set()
        renamed = table.dropDuplicates(["ticker"]).withColumnsRenamed({c: f"{c}_{name}" for c in table.columns if c in seen}).withColumn(f"source_{name}", F.lit(1))
        out = out.join(renamed, "ticker") if out else renamed  # the join finds the common tickers, so that a table is made once
    return out


def outer(tables: dict[str, DataFrame]) -> DataFrame:
    """All tickers of any table, with each table's columns after its name."""
    prefixed = [t.withColumnsRenamed({c: f"{name}_{c}" for c in t.columns if c != "ticker"}) for name, t in tables.items()]
    return reduce(lambda a, b: a.join(b, "ticker", "full_outer"), prefixed)


def tornado(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """ticker, column, value and its deviation from the column's mean; rows without any value are dropped, missing ones count as 0."""
    kept = df.na.drop(how="all", subset=list(columns)).na.fill(0, list(columns))
    long = kept.unpivot(["ticker"], list(columns), "column", "value")
    means = long.groupBy("column").agg(F.avg("value").alias("mean"))
    return long.join(F.broadcast(means), "column").select("ticker", "column", "value", (F.col("value") - F.col("mean")).alias("deviation"))


def watchlist(signals: DataFrame, most: int | None = 1000) -> DataFrame:
    """timeframe, part and line: a section heading and up to `most` (None: all) of its EXCHANGE:TICKER, joined by commas, for each signal."""
    named = signals.select("timeframe", "signal", F.concat_ws(":", "exchange", "ticker").alias("symbol")).distinct()
    part = f"cast((row_number() over (partition by timeframe, signal order by symbol) - 1) div {most} as int)" if most else "0"
    numbered = named.withColumn("part", F.expr(part))
    lists = numbered.groupBy("timeframe", "signal", "part").agg(F.array_sort(F.collect_list("symbol")).alias("symbols"))
    return lists.select("timeframe", "signal", "part", F.concat(F.lit("###"), F.upper("signal"), F.lit(","), F.array_join("symbols", ",")).alias("line"))
