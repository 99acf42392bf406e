"""Recursive series over bars: moving averages that feed on themselves, and state machines.

All series of a plan are made in one pass over each ticker's bars in order, by one fold whose state holds
every series; the rows come back with the series beside them. This stays in the JVM, and a ticker's bars
are shuffled once, to where window functions need them as well. A ticker's bars are one row meanwhile, cut
into chunks of the square root of their number.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A series' input: of the bar and of the series before it, by name.
Input = Callable[[Column, dict[str, Column]], Column]


@dataclass(frozen=True)
class Series:
    """kind: ewm (recursive), ewm_adjusted (weights normalised) or wilder (mean of the first n, then smoothed by 1/n)."""

    name: str
    kind: str
    n: float
    input: Input = lambda bar, _: bar["close"]
    least: int = 1

    @property
    def alpha(self) -> float:
        return 2.0 / (self.n + 1)


@dataclass(frozen=True)
class Smoothed(Series):
    """An ewm whose weight is given by itself, not by a span."""

    weight: float = 0.0

    @property
    def alpha(self) -> float:
        return self.weight


def ema(name: str, span: int, input: Input = lambda bar, _: bar["close"], adjusted: bool = False) -> Series:
    return Series(name, "ewm_adjusted" if adjusted else "ewm", span, input)


def rma(name: str, n: int, input: Input, adjusted: bool = False, least: int = 1) -> Series:
    """Smoothing by 1/n from the first value on."""
    return Smoothed(name, "ewm_adjusted" if adjusted else "ewm", n, input, least, weight=1.0 / n)


def wilder(name: str, n: int, input: Input) -> Series:
    return Series(name, "wilder", n, input)


def _next(series: Series, acc: Column, value: Column) -> tuple[Column, Column, Column]:
    """Total, weight and result of a series after one more value; a null value changes nothing."""
    total, weight = acc[f"{series.name}_total"], acc[f"{series.name}_weight"]
    if series.kind == "ewm":
        new = F.when(weight == 0, value).otherwise(total + series.alpha * (value - total))
        grown, out = weight + 1.0, new
        enough = grown >= series.least
    elif series.kind == "ewm_adjusted":
        new = total * (1 - series.alpha) + value
        grown = weight * (1 - series.alpha) + 1.0
        out = new / grown
        # The weight after k values is (1 - (1 - alpha)^k) / alpha.
        enough = grown >= (1 - (1 - series.alpha) ** series.least) / series.alpha - 1e-9
    else:
        n = float(series.n)
        new = F.when(weight < n - 1, total + value).when(weight == n - 1, (total + value) / n).otherwise((total * (n - 1) + value) / n)
        grown, out = weight + 1.0, new
        enough = grown >= n
    kept = lambda now, before: F.when(value.isNull(), before).otherwise(now)
    return kept(new, total), kept(grown, weight), F.when(value.isNotNull() & enough, out).when(value.isNull() & (weight > 0), None)


def started(series: Sequence[Series]) -> dict[str, Column]:
    """The state of series before the first bar."""
    return {f"{s.name}_{part}": F.lit(0.0) for s in series for part in ("total", "weight")}


def advanced(series: Series, acc: Column, bar: Column, made: dict[str, Column]) -> tuple[list[Column], Column]:
    """The state and the value of a series after one more bar."""
    total, weight, value = _next(series, acc, series.input(bar, made).cast("double"))
    return [total.alias(f"{series.name}_total"), weight.alias(f"{series.name}_weight")], value


def folded(bars: DataFrame, state: dict[str, Column], made: str, step: Callable[[Column, Column], tuple[list[Column], list[Column]]], key: str, order: str, start: DataFrame | None = None) -> DataFrame:
    """bars with what step makes of each bar and the state so far: new state, and columns (of the types in `made`) beside the bar's own.

    start has states to begin with, a row a key; keys that it lacks, or whose columns are null, begin with `state`.

    A ticker's bars are folded in chunks of the square root of their number: rows are appended to their
    chunk, and chunks to the whole, so that no array is copied more often than that root.
    """
    own = [c for c in bars.columns if c != key]
    row_kind = ", ".join([f"`{c}`: {bars.schema[c].dataType.simpleString()}" for c in own] + [made])
    none = F.array().cast(f"array<struct<{row_kind}>>")
    listed = bars.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *(c for c in own if c != order)))).alias("bars"))
    if start is not None:
        listed = listed.join(start.select(key, F.struct(*state).alias("begun")), key, "left")
    length = F.greatest(F.ceil(F.sqrt(F.size("bars"))).cast("int"), F.lit(32))
    starts = F.sequence(F.lit(1), F.size("bars"), F.col("length"))
    begun = [] if start is None else ["begun"]
    chunked = listed.withColumn("length", length).select(key, *begun, F.transform(starts, lambda at: F.slice("bars", at, F.col("length"))).alias("chunks"))

    def one(acc: Column, bar: Column) -> Column:
        now, columns = step(acc, bar)
        row = F.struct(*(bar[c].alias(c) for c in own), *columns)
        return F.struct(*now, F.array_append(acc["out"], row).alias("out"))

    def chunk(acc: Column, some: Column) -> Column:
        start = F.struct(*(acc[k].alias(k) for k in state), none.alias("out"))
        return F.aggregate(some, start, one, lambda end: F.struct(*(end[k].alias(k) for k in state), F.array_append(acc["done"], end["out"]).alias("done")))

    first = F.struct(*((v if start is None else F.coalesce(F.col("begun")[k], v)).alias(k) for k, v in state.items()), F.array().cast(f"array<array<struct<{row_kind}>>>").alias("done"))
    return chunked.select(key, F.inline(F.flatten(F.aggregate("chunks", first, chunk, lambda acc: acc["done"]))))


def with_series(bars: DataFrame, series: Sequence[Series], key: str = "ticker", order: str = "date") -> DataFrame:
    """bars with a column for each series. Null inputs give null and leave a series as it is."""

    def step(acc: Column, bar: Column) -> tuple[list[Column], list[Column]]:
        state, made = [], {}
        for s in series:
            now, made[s.name] = advanced(s, acc, bar, made)
            state += now
        return state, [made[s.name].alias(s.name) for s in series]

    return folded(bars, started(series), ", ".join(f"{s.name}: double" for s in series), step, key, order)


def with_states(bars: DataFrame, start: dict[str, Column], step: Callable[[dict[str, Column], Column], dict[str, Column]], key: str = "ticker", order: str = "date") -> DataFrame:
    """bars with the columns of a state machine: start gives each state column before the first bar, step after each."""
    probe = bars.sparkSession.range(1).select(*(v.alias(k) for k, v in start.items())).schema

    def fold(acc: Column, bar: Column) -> tuple[list[Column], list[Column]]:
        now = {k: v.cast(probe[k].dataType) for k, v in step({k: acc[k] for k in start}, bar).items()}
        return [now[k].alias(k) for k in start], [now[k].alias(k) for k in start]

    first = {k: v.cast(probe[k].dataType) for k, v in start.items()}
    return folded(bars, first, ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in probe), fold, key, order)
