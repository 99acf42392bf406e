"""Tables behind a dashboard: sums by day for all, sector, industry, exchange and universe in one pass, and what is made of them.

Sums are kept, not means, so that new days, or more tickers of a day, are added to what there is
(commits.append, then added()) without reading the old bars again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import change, lag, sma
from ..sources.bars import latest

KINDS = ("sector", "industry", "exchange")
SUMS = ("tickers", "advances", "declines", "above_average", "change_sum", "change_squares", "cap_sum", "cap_change_sum", "volume_sum")


def daily_sums(bars: DataFrame, dimension: DataFrame, universes: DataFrame | None = None, kinds: Sequence[str] = KINDS, average: int = 20) -> DataFrame:
    """date, kind, name and SUMS: of all tickers, of each value of the kinds, and of each universe (universes: ticker, universe), in one pass.

    Changes are in percent from the close before; a ticker's first bar counts without one. A ticker without a row in the dimension counts among all; a null group is none.
    """
    rows = bars.withColumns({"move": F.expr(f"{change('close')} * 100"), "mean": F.expr(sma("close", average))})
    own = dimension.dropDuplicates(["ticker"]).select("ticker", *kinds, "market_cap")
    rows = rows.join(own, "ticker", "left")
    if universes is not None:
        rows = rows.join(universes.groupBy("ticker").agg(F.collect_set("universe").alias("universes")), "ticker", "left")
    group = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    groups = F.array(group("all", F.lit("all")), *(group(k, F.col(k)) for k in kinds))
    if universes is not None:
        groups = F.concat(groups, F.coalesce(F.transform("universes", lambda u: group("universe", u)), F.array().cast("array<struct<kind: string, name: string>>")))
    cap = F.when(F.col("move").isNotNull(), F.greatest(F.coalesce("market_cap", F.lit(0.0)), F.lit(0.0)))
    dealt = rows.select("date", "close", "move", "mean", "volume", cap.alias("cap"), F.explode(groups).alias("g")).where("g.name is not null")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return dealt.groupBy("date", F.col("g.kind").alias("kind"), F.col("g.name").alias("name")).agg(
        F.count("*").alias("tickers"), F.count_if(F.col("move") > 0).alias("advances"), F.count_if(F.col("move") < 0).alias("declines"), F.count_if(F.col("close") > F.col("mean")).alias("above_average"),
        total("move").alias("change_sum"), total(F.col("move") * F.col("move")).alias("change_squares"), total("cap").alias("cap_sum"), total(F.col("cap") * F.col("move")).alias("cap_change_sum"), total("volume").alias("volume_sum"),
    )


def added(*sums: DataFrame) -> DataFrame:
    """The sums of sums, by date, kind and name."""
    every = sums[0]
    for one in sums[1:]:
        every = every.unionByName(one)
    return every.groupBy("date", "kind", "name").agg(*(F.sum(c).alias(c) for c in SUMS))


def overview(sums: DataFrame) -> DataFrame:
    """date, kind, name, tickers, advances, declines, ratio (of them), above_pct, change (mean, percent), cap_change (weighted by market cap) and volume."""
    moved = F.col("tickers").cast("double")
    return sums.select(
        "date", "kind", "name", "tickers", "advances", "declines", F.try_divide("advances", "declines").alias("ratio"), (F.col("above_average") * 100 / moved).alias("above_pct"),
        (F.col("change_sum") / moved).alias("change"), F.try_divide("cap_change_sum", "cap_sum").alias("cap_change"), F.col("volume_sum").alias("volume"),
    )


def performance(series: DataFrame, week: int = 6, month: int = 29, average: int = 20, band: float = 0.02) -> DataFrame:
    """ticker, date, close, changes in percent over a day, a week and a month of bars (0 where there are too few), trend and position of each series' last bar.

    trend: DARK_GREEN above the average by more than the band, LIGHT_GREEN above it, YELLOW below by less than
    the band, else RED; a series shorter than the average is compared with itself. One with a single bar is left out.
    """
    made = {"day_pct": f"{change('close')} * 100", "week_pct": f"coalesce({change('close', week)} * 100, 0)", "month_pct": f"coalesce({change('close', month)} * 100, 0)", "mean": f"coalesce({sma('close', average)}, close)", "before": lag("close")}
    last = latest(series.withColumns({k: F.expr(v) for k, v in made.items()})).where("before is not null")
    trend = f"case when close > mean * {1 + band} then 'DARK_GREEN' when close > mean then 'LIGHT_GREEN' when close > mean * {1 - band} then 'YELLOW' else 'RED' end"
    return last.select("ticker", "date", "close", "day_pct", "week_pct", "month_pct", F.expr(trend).alias("trend"), F.expr("case when close > mean then 'above' else 'below' end").alias("position"))


#: Screens that open a position, and that are watched; other ones are monitored. Fixed values.
ENTRY, WATCH = ("nine_million", "volume_breakout", "momentum", "breakout"), ("launch_pad", "rti", "qullamaggie")


def opportunities(signals: DataFrame, strong: float = 7.5, moderate: float = 5.0) -> DataFrame:
    """signals (ticker, screen, score 0 to 10 or null) with strength, stage, and place by falling score within a stage (then by ticker and screen)."""
    named = lambda names: F.greatest(*(F.contains("screen", F.lit(n)) for n in names), F.lit(False))
    strength = F.when(F.col("score").isNull(), "MODERATE").when(F.col("score") >= strong, "STRONG").when(F.col("score") >= moderate, "MODERATE").otherwise("WEAK")
    return signals.select("ticker", "screen", "score", strength.alias("strength"), F.when(named(ENTRY), "Entry").when(named(WATCH), "Watch").otherwise("Monitor").alias("stage"))


def alerts(scores: DataFrame, days: DataFrame, signals: DataFrame, sectors: DataFrame, severe: int = 6, caution: int = 4, strong: float = 8.0, most: int = 5, top: float = 4.0, weak: float = 1.0, moved: float = 2.0) -> DataFrame:
    """priority, kind, subject, value and urgency (0 to 100) of what a day calls for.

    scores: ticker (an index), score; days: ticker, distribution_days, follow_through (a date or null); signals: ticker, screen, score; sectors: of
    performance(). Of strong signals the `most` best count, by score, then ticker and screen.
    """
    def told(rows: DataFrame, priority: str, kind: str, subject, value, urgency: int) -> DataFrame:
        return rows.select(F.lit(priority).alias("priority"), F.lit(kind).alias("kind"), subject.alias("subject"), value.cast("double").alias("value"), F.lit(urgency).alias("urgency"))

    ticker = F.col("ticker")
    best = signals.where(F.col("score") >= strong).orderBy(F.desc("score"), "ticker", "screen").limit(most)
    parts = [
        told(days.where(F.col("distribution_days") >= severe), "CRITICAL", "DISTRIBUTION", ticker, F.col("distribution_days"), 95),
        told(days.where((F.col("distribution_days") >= caution) & (F.col("distribution_days") < severe)), "HIGH", "DISTRIBUTION", ticker, F.col("distribution_days"), 75),
        told(days.where("follow_through is not null"), "HIGH", "FOLLOW_THROUGH", F.concat_ws(" ", "ticker", "follow_through"), F.lit(1), 85),
        told(scores.where(F.col("score") >= top), "HIGH", "BULLISH", ticker, F.col("score"), 80), told(scores.where(F.col("score") <= weak), "MEDIUM", "BEARISH", ticker, F.col("score"), 60),
        told(best, "HIGH", "SETUP", F.concat_ws(":", "ticker", "screen"), F.col("score"), 85),
        told(sectors.where(F.abs("day_pct") >= moved), "MEDIUM", "SECTOR", ticker, F.col("day_pct"), 50),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every
