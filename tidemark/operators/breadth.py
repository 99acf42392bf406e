"""Market breadth: for each universe and date, how many tickers rise, make new extremes and stand above their averages.

Two steps: per-ticker windows, then counts by universe and date. What follows are windows over dates of a
universe, which are few. A universe is a set of tickers; a ticker may be in many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import island, lag, rolling, rows, sma

DATES = "partition by universe order by date"
#: Bars of long, medium and short extremes; averages; extremes that count as many, in absolute numbers.
EXTREMES, AVERAGES, MANY = {"long": 252, "medium": 63, "short": 20}, (20, 50, 200), 100
#: Success: the share (percent) of a period looked back on, and of those days on which there must be many new highs.
SUCCESS = {"long": (25, 30), "medium": (50, 30), "short": (50, 50)}
STRONG_RATIO, WEAK_RATIO, STRONG_ADVANCE, WEAK_ADVANCE, STRONG_MA, WEAK_MA, EXPANSION = 2.0, 0.5, 70.0, 30.0, 80.0, 20.0, 50


def _flag(condition: str) -> str:
    return f"case when {condition} then 1 else 0 end"


#: Of each ticker's bars.
TICKER_COLUMNS = (
    {"moved": f"close - {lag('close')}", "moved_pct": f"(close / nullif({lag('close')}, 0) - 1) * 100"}
    | {f"high_{k}": _flag(f"high >= {rolling('max', 'high', n, max(1, n // 4))}") for k, n in EXTREMES.items()}
    | {f"low_{k}": _flag(f"low <= {rolling('min', 'low', n, max(1, n // 4))}") for k, n in EXTREMES.items()}
    | {f"above_{n}": _flag(f"close > {sma('close', n, n // 2)}") for n in AVERAGES}
)
#: Sums by universe and date.
SUMS = (
    {
        "total_stocks": "count(*)", "advancing": f"sum({_flag('moved > 0')})", "declining": f"sum({_flag('moved < 0')})", "unchanged": f"sum({_flag('moved = 0')})",
        "avg_pct_change": "avg(moved_pct)", "pct_change_std": "stddev_samp(moved_pct)",
    }
    | {f"{k}_new_{x}s": f"sum({x}_{k})" for k in EXTREMES for x in ("high", "low")}
    | {f"above_ma_{n}": f"sum(above_{n})" for n in AVERAGES}
)
RATIOS = (
    {
        "net_advances": "advancing - declining", "ad_ratio": "advancing * 1e0 / nullif(declining, 0)", "ad_line": f"sum(advancing - declining) over {rows(None, by=DATES)}",
        "advance_pct": "advancing * 100e0 / total_stocks", "decline_pct": "declining * 100e0 / total_stocks",
    }
    | {f"net_{k}_new_highs": f"{k}_new_highs - {k}_new_lows" for k in EXTREMES}
    | {f"hl_ratio_{k}": f"{k}_new_highs * 1e0 / nullif({k}_new_lows, 0)" for k in EXTREMES}
    | {f"{k}_new_highs_pct": f"{k}_new_highs * 100e0 / total_stocks" for k in EXTREMES}
    | {f"net_hl_line_{k}": f"sum({k}_new_highs - {k}_new_lows) over {rows(None, by=DATES)}" for k in EXTREMES}
    | {f"pct_above_ma_{n}": f"above_ma_{n} * 100e0 / total_stocks" for n in AVERAGES}
)


def _success(k: str, many: int) -> str:
    window, share = SUCCESS[k]
    n = max(1, EXTREMES[k] * window // 100)
    frame = rows(n - 1, by=DATES)
    return _flag(f"count(*) over {frame} >= {max(1, n // 2)} and sum({_flag(f'{k}_new_highs > {many}')}) over {frame} >= {max(1, n * share // 100)} and count(*) over (partition by universe) >= {n}")


def thresholds(many: int = MANY) -> dict[str, str]:
    return (
        {f"{k}_many_highs": _flag(f"{k}_new_highs > {many}") for k in EXTREMES}
        | {f"{k}_success": _success(k, many) for k in EXTREMES}
        | {"strong_ratio": _flag(f"ad_ratio > {STRONG_RATIO}"), "weak_ratio": _flag(f"ad_ratio < {WEAK_RATIO}")}
        | {"strong_advance": _flag(f"advance_pct > {STRONG_ADVANCE}"), "weak_advance": _flag(f"advance_pct < {WEAK_ADVANCE}")}
        | {f"strong_ma_{n}": _flag(f"pct_above_ma_{n} > {STRONG_MA}") for n in AVERAGES}
        | {f"weak_ma_{n}": _flag(f"pct_above_ma_{n} < {WEAK_MA}") for n in AVERAGES}
    )


_MEAN = " + ".join(f"pct_above_ma_{n}" for n in AVERAGES)
_STRONG, _WEAK = (" + ".join(f"{x}_ma_{n}" for n in AVERAGES) for x in ("strong", "weak"))
SIGNALS = {
    "breadth_thrust": _flag(f"({_MEAN}) / 3 > {STRONG_MA}"), "breadth_deterioration": _flag(f"({_MEAN}) / 3 < {WEAK_MA}"), "ad_thrust": _flag(f"ad_ratio > {STRONG_RATIO}"),
    "highs_expansion": _flag(f"long_new_highs > {EXPANSION}"), "lows_expansion": _flag(f"long_new_lows > {EXPANSION}"),
    "bullish_base": f"strong_advance + {_STRONG} + long_success + medium_success", "bearish_base": f"weak_advance + {_WEAK}",
    "score": " + ".join(f"pct_above_ma_{n} * {w}" for n, w in zip(AVERAGES, (0.3, 0.25, 0.25))) + " + advance_pct * 0.2",
}
TOTALS = {
    "bullish_signals": "breadth_thrust + ad_thrust + highs_expansion + strong_advance + long_success + medium_success",
    "bearish_signals": f"breadth_deterioration + lows_expansion + weak_advance + {_WEAK}",
    "bull_flags": f"{_STRONG} + strong_ratio + long_many_highs", "bear_flags": f"{_WEAK} + weak_ratio",
    "rating": "case when score >= 80 then 'Excellent' when score >= 60 then 'Good' when score >= 40 then 'Fair' when score >= 20 then 'Poor' else 'Very Poor' end",
} | {f"{x}_momentum_{n}d": f"case when count(*) over {rows(n - 1, by=DATES)} >= {n // 2} then avg({x}_base) over {rows(n - 1, by=DATES)} end" for n in (5, 10, 20) for x in ("bullish", "bearish")}
RATINGS = {
    "net_signals": "bullish_signals - bearish_signals",
    "strength": "case when bull_flags >= 3 and bull_flags - bear_flags >= 2 then 'Strong Bullish' when bear_flags >= 3 and bull_flags - bear_flags <= -2 then 'Strong Bearish'"
    " when bull_flags >= 2 and bull_flags - bear_flags >= 1 then 'Moderate Bullish' when bear_flags >= 2 and bull_flags - bear_flags <= -1 then 'Moderate Bearish'"
    " when bull_flags > 0 or bear_flags > 0 then case when bull_flags > bear_flags then 'Weak Signal (Bullish)' else 'Weak Signal (Bearish)' end else 'Neutral' end",
    "classification": "coalesce(nullif(concat_ws('; ', "
    f"case when {_STRONG} > 0 then 'Breadth Thrust (Bullish)' end, case when strong_ratio = 1 then 'Advance/Decline Thrust (Bullish)' end, "
    f"case when long_many_highs = 1 then 'New Highs Expansion (Bullish)' end, case when {_WEAK} > 0 then 'Breadth Deterioration (Bearish)' end), ''), 'Neutral')",
    "bull_island": island("bullish_signals > bearish_signals", DATES), "bear_island": island("bearish_signals > bullish_signals", DATES),
}
RUNS = {
    "bullish_days": f"sum({_flag('bullish_signals > bearish_signals')}) over (partition by universe, bull_island order by date)",
    "bearish_days": f"sum({_flag('bearish_signals > bullish_signals')}) over (partition by universe, bear_island order by date)",
}


def _with(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.withColumns({name: F.expr(text) for name, text in columns.items()})


def counts(bars: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """SUMS and RATIOS by universe and date. members: ticker, universe; without it all tickers are one universe."""
    marked = _with(bars, TICKER_COLUMNS)
    marked = marked.withColumn("universe", F.lit("all")) if members is None else marked.join(members.select("ticker", "universe").distinct(), "ticker")
    return _with(marked.groupBy("universe", "date").agg(*(F.expr(text).alias(name) for name, text in SUMS.items())), RATIOS)


def breadth(bars: DataFrame, members: DataFrame | None = None, many: int = MANY) -> DataFrame:
    """counts() with thresholds, signals, momentum, ratings and run lengths."""
    out = counts(bars, members)
    for columns in (thresholds(many), SIGNALS, TOTALS, RATINGS, RUNS):
        out = _with(out, columns)
    return out.drop("bull_island", "bear_island")


#: Dates of the trend's means.
TREND = (5, 10, 20)
LADDER = (
    "case when bullish_signals >= 3 and net_signals >= 2 then 'Strong Bullish' when bearish_signals >= 3 and net_signals <= -2 then 'Strong Bearish'"
    " when bullish_signals >= 2 and net_signals >= 1 then 'Moderate Bullish' when bearish_signals >= 2 and net_signals <= -1 then 'Moderate Bearish'"
    " when bullish_signals > 0 or bearish_signals > 0 then 'Weak Signal' else 'Neutral' end"
)


def trends(signals: DataFrame) -> DataFrame:
    """universe, date, totals and net of breadth()'s signals, their means over 5, 10 and 20 dates (of half as many at least), how long one side has led, and a ladder of strength."""
    kinds = {"bullish": "bullish_signals", "bearish": "bearish_signals", "net": "net_signals"}
    means = {f"{name}_mean_{n}": rolling("avg", column, n, n // 2, by=DATES) for n in TREND for name, column in kinds.items()}
    out = _with(signals, means | {"trend": LADDER})
    return out.select("universe", "date", *kinds.values(), *means, "bullish_days", "bearish_days", "trend")


def combined(bars: DataFrame, members: DataFrame, name: str, universes: list[str]) -> DataFrame:
    """counts() of the union of some universes, each ticker once."""
    union = members.where(F.col("universe").isin(universes)).select("ticker").distinct().withColumn("universe", F.lit(name))
    return counts(bars, union)


#: Weights of the first universes in a weighted breadth; the others weigh the last.
WEIGHTS = (0.5, 0.3, 0.2, 0.1)


def weighted(by_universe: DataFrame, order: list[str], column: str) -> DataFrame:
    """date and the mean of a column over the universes that have the date, weighted by their place in order."""
    weight = F.lit(WEIGHTS[-1])
    for name, w in zip(order, WEIGHTS):
        weight = F.when(F.col("universe") == name, w).otherwise(weight)
    known = by_universe.where(F.col("universe").isin(order) & F.col(column).isNotNull()).withColumn("weight", weight)
    return known.groupBy("date").agg((F.sum(F.col(column) * F.col("weight")) / F.sum("weight")).alias(column))
