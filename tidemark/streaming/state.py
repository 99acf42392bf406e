"""Series that go on between runs: each ticker's state is kept, so that a day's bars fold onto it.

A Plan holds what a row takes from the rows before it: carried values (the close before, a running total, a
state machine) and recursive averages. A folder has two tables of batches with one log of commits: rows (the
bars and the results, and what a state adds to them where one is kept) and states (each ticker's state after
its last bar of each quarter). A batch reads the states alone, one row a ticker, and its own bars, once. Only
tickers with a bar that is no later than one they had (a late bar, or a correction) go back to the last state
before it and replay their bars from there; what comes out replaces the rows from that bar on, so that a row
stands unless a later batch begins its ticker no later: only rows that might be replaced are looked up for it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.folds import Series, advanced, ema, folded, started, wilder
from ..sources import commits
from ..sources.bars import PRICES

#: The columns of a bar that are kept.
BAR = ["ticker", "date", *PRICES, "volume"]


@dataclass(frozen=True)
class Carried:
    """A value that a row hands on: its type and start, and the next one from the values before (by name), the bar, and what the row has so far."""

    name: str
    kind: str
    start: object
    next: Callable[[dict[str, Column], Column, dict[str, Column]], Column]


@dataclass(frozen=True)
class Plan:
    """Carried values first, each row's in order; then series, whose inputs may use them."""

    carried: Sequence[Carried] = field(default_factory=tuple)
    series: Sequence[Series] = field(default_factory=tuple)

    @property
    def columns(self) -> list[str]:
        return [c.name for c in self.carried] + [s.name for s in self.series]

    @property
    def state(self) -> dict[str, Column]:
        """Columns of a state, as they start."""
        return {f"{c.name}_before": F.lit(c.start).cast(c.kind) for c in self.carried} | started(self.series)


def ran(plan: Plan, bars: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """bars (ticker, date, ...) in order of date, with the plan's columns and the state after each bar, from states (ticker and the state's columns) or from the start."""

    def step(acc: Column, bar: Column) -> tuple[list[Column], list[Column]]:
        before, made = {c.name: acc[f"{c.name}_before"] for c in plan.carried}, {}
        for c in plan.carried:
            made[c.name] = c.next(before, bar, made).cast(c.kind)
        now = [made[c.name].alias(f"{c.name}_before") for c in plan.carried]
        for s in plan.series:
            state, made[s.name] = advanced(s, acc, bar, made)
            now += state
        return now, [made[name].alias(name) for name in plan.columns] + now

    kinds = [f"{c.name}: {c.kind}" for c in plan.carried] + [f"{s.name}: double" for s in plan.series]
    kinds += [f"{c.name}_before: {c.kind}" for c in plan.carried] + [f"{k}: double" for k in started(plan.series)]
    return folded(bars, plan.state, ", ".join(kinds), step, "ticker", "date", states)


def add(path: str, plan: Plan, bars: DataFrame, batch: int) -> bool:
    """Folds a batch of bars onto the states; False if that batch is there already. Of bars with equal ticker and date in a batch the greatest stays; null tickers and dates go."""
    spark = bars.sparkSession
    if commits.committed(spark, path, batch):
        return False
    rest = [c for c in BAR if c not in ("ticker", "date")]
    new = bars.where("ticker is not null and date is not null").select(*BAR, F.lit(True).alias("fresh"))
    known = commits.current(spark, path, ["ticker", "quarter"], "states")
    own, again = None, new
    if known is not None:
        # Of each ticker in the batch: the last state before its first bar, and whether it had later bars.
        first = new.groupBy("ticker").agg(F.min("date").alias("first"))
        state = F.struct("last", *plan.state)
        own = known.join(first, "ticker").groupBy("ticker", "first").agg(F.max_by(F.when(F.col("last") < F.col("first"), state), F.when(F.col("last") < F.col("first"), F.col("last"))).alias("s"), F.max("last").alias("latest"))
        own = own.select("ticker", "first", "s.*", (F.col("latest") >= F.col("first")).alias("late")).persist()
        late = own.where("late").select("ticker", "last")
        since = late.agg(F.count("*").alias("n"), F.min(F.coalesce("last", F.lit("0001-01-01").cast("date"))).alias("since")).first()
        if since["n"]:
            stored = _standing(spark, path, BAR).where(F.col("date") > F.lit(since["since"]))
            again = new.unionByName(stored.join(late, "ticker").where("last is null or date > last").select(*BAR, F.lit(False).alias("fresh")))
    again = again.groupBy("ticker", "date").agg(F.max(F.struct("fresh", *rest)).alias("r")).select("ticker", "date", "r.*")
    quarter = lambda date: F.date_trunc("quarter", date).cast("date")
    order = W.partitionBy("ticker").orderBy("date")
    ends = F.coalesce(quarter(F.lead("date").over(order)) != quarter("date"), F.lit(True))
    first = F.min(F.when(F.col("fresh"), F.col("date"))).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    again = again.select(*BAR, ends.alias("ends"), first.alias("first"))
    out = (ran(plan, again) if own is None else ran(plan, again, own.select("ticker", *plan.state))).where(F.col("date") >= F.col("first"))
    held = F.when(F.col("ends"), F.struct(F.col("date").alias("last"), *started(plan.series))).alias("held")
    carried = [F.col(c.name).alias(f"{c.name}_before") for c in plan.carried]
    states = lambda made: made["rows"].where("held is not null").select("ticker", quarter("date").alias("quarter"), *carried, "held.*")
    try:
        return commits.append({"rows": out.select(*BAR, *plan.columns, held), "states": states}, path, batch)
    finally:
        if own is not None:
            own.unpersist()


def _standing(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame | None:
    """The rows that no later batch has replaced."""
    rows = commits.read(spark, path)
    if rows is None:
        return None
    wanted = list(columns or (c for c in rows.columns if c not in ("batch", "held")))
    # When a later batch begins: of all tickers, a row a batch, and of each.
    after = W.orderBy("batch").rowsBetween(1, W.unboundedFollowing)
    every = F.broadcast(rows.groupBy("batch").agg(F.min("date").alias("since")).select("batch", F.min("since").over(after).alias("until")))
    each = rows.groupBy("ticker", "batch").agg(F.min("date").alias("since"))
    each = each.select("ticker", "batch", F.min("since").over(after.partitionBy("ticker")).alias("replaced"))
    marked = rows.select(*{*wanted, "ticker", "date", "batch"}).join(every, "batch")
    doubtful = marked.where("date >= until").join(each, ["ticker", "batch"]).where("replaced is null or date < replaced")
    return marked.where("until is null or date < until").select(*wanted).unionByName(doubtful.select(*wanted))


def results(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame | None:
    """ticker, date, the bar and the plan's columns, as they are after the last batch; or those named."""
    return _standing(spark, path, columns)


def follow(stream: DataFrame, path: str, plan: Plan, checkpoint: str):
    """Adds what arrives in a stream of bars, batch by batch; returns the query, which handles what is there and stops."""
    return stream.writeStream.foreachBatch(lambda rows, batch: add(path, plan, rows, batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_plan(fast: int = 12, slow: int = 26, smooth: int = 9, atr: int = 14, channel: float = 2.0) -> Plan:
    """Averages, MACD, ATR, volume on balance, the highest high so far, and a trend that turns when the close leaves a channel of some ATR around the last turn."""
    highest = F.greatest
    carried = (
        Carried("close_so_far", "double", None, lambda before, bar, _: F.coalesce(bar["close"], before["close_so_far"])),
        Carried("bar", "long", 0, lambda before, bar, _: before["bar"] + 1),
        Carried("range", "double", None, lambda before, bar, _: highest(bar["high"] - bar["low"], F.abs(bar["high"] - before["close_so_far"]), F.abs(bar["low"] - before["close_so_far"]))),
        Carried("on_balance", "double", 0.0, lambda before, bar, _: before["on_balance"] + F.coalesce(F.signum(bar["close"] - before["close_so_far"]) * bar["volume"], F.lit(0.0))),
        Carried("top", "double", None, lambda before, bar, _: highest(before["top"], bar["high"])),
        Carried("turned_at", "double", None, lambda before, bar, made: F.when(before["turned_at"].isNull() | (F.abs(bar["close"] - before["turned_at"]) > channel * made["range"]), bar["close"]).otherwise(before["turned_at"])),
        Carried("trend", "int", 0, lambda before, bar, made: F.when(made["turned_at"] > before["turned_at"], 1).when(made["turned_at"] < before["turned_at"], -1).otherwise(before["trend"])),
    )
    series = (
        ema("ema_fast", fast), ema("ema_slow", slow), ema("ema_fast_adjusted", fast, adjusted=True),
        ema("signal", smooth, lambda bar, made: made["ema_fast"] - made["ema_slow"]), wilder("atr", atr, lambda bar, made: made["range"]),
    )
    return Plan(carried, series)
