"""Trend stages of a ticker from its moving averages and range."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.folds import ema, with_series
from ..functions.windows import sma, true_range
from ..sources.bars import latest

#: Ranges in percent of the slow average from which they are normal and wide; closeness of averages.
QUIET, WIDE, CLOSE = 4.0, 7.0, 0.01
STAGES = {
    "LP": "Launch pad", "4C": "Decline, late", "4B": "Decline", "4A": "Decline, early", "3C": "Top, late", "3B": "Top", "3A": "Top, early",
    "2C": "Advance, late", "2B": "Advance", "2A": "Advance, early", "1C": "Base, late", "1B": "Base", "1A": "Base, early", "??": "Unknown",
}


@dataclass(frozen=True)
class Rules:
    """What a timeframe's stages go by: bars of the averages and of the range, and the limits above."""

    fast: int = 10
    middle: int = 20
    slow: int = 50
    atr: int = 14
    quiet: float = QUIET
    wide: float = WIDE
    close: float = CLOSE


def inputs(bars: DataFrame, ema_span: int = 10, middle: int = 20, slow: int = 50, atr: int = 14) -> DataFrame:
    """bars with ema10 (adjusted), sma20, sma50, atr (a simple mean) and atr_ratio in percent of sma50."""
    out = with_series(bars.withColumn("tr", F.expr(true_range())), [ema("ema10", ema_span, adjusted=True)])
    out = out.withColumns({"sma20": F.expr(sma("close", middle)), "sma50": F.expr(sma("close", slow)), "atr": F.expr(sma("tr", atr))})
    return out.withColumn("atr_ratio", F.expr("atr / nullif(sma50, 0) * 100")).drop("tr")


def stage_code(close: float = CLOSE, quiet: float = QUIET, wide: float = WIDE) -> str:
    """The stage of a row of inputs(): the first that fits, in order of precedence; unknown if anything is missing."""
    apart = lambda a, b: f"abs({a} - {b}) / nullif({b}, 0) <= {close}"
    over = "close >= ema10 and close >= sma20 and close >= sma50"
    under = "close <= ema10 and close <= sma20 and close <= sma50"
    dipped = "close <= ema10 and close <= sma20 and close >= sma50"
    normal = f"atr_ratio >= {quiet} and atr_ratio < {wide}"
    return (
        "case when close is null or ema10 is null or sma20 is null or sma50 is null or atr_ratio is null then '??'"
        f" when {apart('ema10', 'sma20')} and {apart('sma20', 'sma50')} and {apart('ema10', 'sma50')} then 'LP'"
        f" when {under} and atr_ratio >= {wide} then '4C' when {under} and ema10 < sma20 and sma20 < sma50 and {normal} then '4B' when {under} and atr_ratio < {quiet} then '4A'"
        f" when {dipped} and atr_ratio >= {quiet} then '3C' when {under} then '3B' when {dipped} then '3A'"
        f" when {over} and atr_ratio >= {wide} then '2C' when {over} and ema10 > sma20 and sma20 > sma50 and {normal} then '2B' when {over} and atr_ratio < {quiet} then '2A'"
        " when close < ema10 and close >= sma20 and close >= sma50 then '1C'"
        " when close >= ema10 and close >= sma20 and close <= sma50 then '1B' when close >= ema10 and close <= sma20 and close <= sma50 then '1A' else '??' end"
    )


def staged(rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """rows of inputs() with stage, alignment of the averages and the close against each in percent."""
    alignment = "case when ema10 is null or sma20 is null or sma50 is null then 'Unknown' when ema10 > sma20 and sma20 > sma50 then 'Bullish' when ema10 < sma20 and sma20 < sma50 then 'Bearish' else 'Mixed' end"
    out = rows.withColumns({"stage": F.expr(stage_code(rules.close, rules.quiet, rules.wide)), "alignment": F.expr(alignment)})
    return out.withColumns({f"from_{c}_pct": F.expr(f"(close / nullif({c}, 0) - 1) * 100") for c in ("ema10", "sma20", "sma50")})


def overview(bars: DataFrame, least_price: float = 0.0, least_volume: float = 0.0) -> DataFrame:
    """The stage of each ticker at its last bar, for those with at least the price and mean volume over 20 bars."""
    rows = inputs(bars).withColumn("avg_volume", F.expr(sma("volume", 20)))
    return staged(latest(rows).where((F.col("close") >= least_price) & (F.coalesce("avg_volume", F.lit(0.0)) >= least_volume)))


def by_timeframe(bars: Mapping[str, DataFrame], rules: Mapping[str, Rules] | None = None) -> DataFrame:
    """timeframe and the stage of each ticker at its last bar, for the bars of each timeframe by its own rules (those of days where it has none).

    The averages keep the names ema10, sma20 and sma50 whatever their bars.
    """
    out = None
    for name, table in bars.items():
        r = (rules or {}).get(name, Rules())
        last = staged(latest(inputs(table, r.fast, r.middle, r.slow, r.atr)), r).select(F.lit(name).alias("timeframe"), "*")
        out = last if out is None else out.unionByName(last)
    return out


def distribution(stages: DataFrame) -> DataFrame:
    """stage, tickers and their share in percent."""
    counted = stages.groupBy("stage").agg(F.count("*").alias("tickers"))
    return counted.crossJoin(F.broadcast(stages.agg(F.count("*").alias("total")))).select("stage", "tickers", (F.col("tickers") * 100.0 / F.col("total")).alias("share_pct"))
