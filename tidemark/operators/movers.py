"""Movers, ratios between tickers, gaps and changes for overviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.folds import ema, with_series
from ..functions.windows import change, lag, rows, sma
from ..sources.bars import latest
from . import correlation

PAIR = "partition by pair order by date"


def percentage_movers(bars: DataFrame, threshold: float = 0.0, volume: float = 0.0) -> DataFrame:
    """The last bar of each ticker whose change in percent is at least the threshold either way, on at least the volume."""
    last = latest(bars.withColumns({"before": F.expr(lag("close")), "change_pct": F.expr(f"{change('close')} * 100")}))
    return last.where((F.abs("change_pct") >= threshold) & (F.col("volume") >= volume)).select("ticker", "date", "close", "before", "change_pct", "volume")


def ratios(bars: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """pair ("A/B"), date and ratio of the closes of A and B on their common dates; a zero divisor gives null."""
    spark = bars.sparkSession
    table = spark.createDataFrame([(f"{a}/{b}", a, b) for a, b in pairs], "pair string, a string, b string")
    over = bars.select(F.col("ticker").alias("a"), "date", F.col("close").alias("x")).join(F.broadcast(table), "a")
    under = bars.select(F.col("ticker").alias("b"), "date", F.col("close").alias("y"))
    return over.join(under, ["b", "date"]).select("pair", "date", F.try_divide("x", "y").alias("ratio"))


RATIO_COLUMNS = (
    {f"sma_{n}": sma("ratio", n, by=PAIR) for n in (20, 50)}
    | {f"change_{k}": f"{change('ratio', k, PAIR)} * 100" for k in (1, 5, 20)}
    | {"z": f"case when count(ratio) over {rows(49, by=PAIR)} >= 50 then (ratio - avg(ratio) over {rows(49, by=PAIR)}) / nullif(stddev_samp(ratio) over {rows(49, by=PAIR)}, 0) end"}
)
RATIO_TREND = "case when ratio > sma_20 and sma_20 > sma_50 then 'up' when ratio < sma_20 and sma_20 < sma_50 then 'down' else 'flat' end"
RATIO_SIGNAL = "case when z > 1.5 and trend = 'up' then 'strong risk on' when z > 0.5 and trend = 'up' then 'risk on' when z < -1.5 and trend = 'down' then 'strong risk off' when z < -0.5 and trend = 'down' then 'risk off' else 'neutral' end"


def ratio_signals(series: DataFrame) -> DataFrame:
    """ratios() with averages, changes, z, trend and signal."""
    out = series.withColumns({k: F.expr(v) for k, v in RATIO_COLUMNS.items()})
    return out.withColumn("trend", F.expr(RATIO_TREND)).withColumn("signal", F.expr(RATIO_SIGNAL))


def normalised(series: DataFrame, base: str) -> DataFrame:
    """ratios() as 100 on the date nearest to base (the earlier of two as near)."""
    day = F.abs(F.datediff("date", F.lit(base).cast("date")))
    bases = series.groupBy("pair").agg(F.min_by("ratio", F.struct(day, F.col("date"))).alias("base"))
    return series.join(F.broadcast(bases), "pair").select("pair", "date", (F.try_divide("ratio", "base") * 100).alias("ratio"))


def rotation(bars: DataFrame, market: DataFrame, n: int = 20) -> DataFrame:
    """The last bar's mean excess return over the market and momentum, both over n bars. market: date, close."""
    both = bars.join(market.select("date", F.col("close").alias("base")), "date")
    out = both.withColumns({"excess": F.expr(f"{change('close')} - {change('base')}"), "momentum_pct": F.expr(f"{change('close', n)} * 100")})
    return latest(out.withColumn("mean_excess", F.expr(sma("excess", n)))).select("ticker", "date", "mean_excess", "momentum_pct")


GAP_COLUMNS = {"before": lag("close"), "gap": f"open - {lag('close')}", "gap_pct": f"(open / nullif({lag('close')}, 0) - 1) * 100"}


def gaps(bars: DataFrame) -> DataFrame:
    """bars with the gap from the close before, in price and percent, and the close with all gaps so far taken out."""
    out = bars.withColumns({k: F.expr(v) for k, v in GAP_COLUMNS.items()})
    return out.withColumn("adjusted_close", F.expr(f"close - sum(coalesce(gap, 0)) over {rows(None)}"))


def weekday_change(bars: DataFrame, weekday: int) -> DataFrame:
    """ticker, the last two bars on a weekday (0 is Monday) and the change between them in percent."""
    days = bars.where(F.weekday("date") == weekday)
    pair = days.withColumns({"before": F.expr(lag("close")), "date_before": F.expr(lag("date"))})
    return latest(pair).select("ticker", "date", "date_before", ((F.try_divide("close", "before") - 1) * 100).alias("change_pct"))


def correlations(bars: DataFrame, groups: DataFrame) -> DataFrame:
    """grp, a, b (a < b), n and the correlation of their returns on common dates, for every two tickers of a group.

    groups: ticker, grp. The result has a row for each pair, so groups are what bounds it: an industry, a
    watchlist, or all tickers under one name where their number squared can be had.
    """
    return correlation.grouped(bars, groups)


def mcclellan(bars: DataFrame) -> DataFrame:
    """date, advances less declines, and the difference of their adjusted EMAs over 19 and 39 dates."""
    moved = bars.withColumn("moved", F.expr(f"close - {lag('close')}")).groupBy("date").agg((F.count_if(F.col("moved") > 0) - F.count_if(F.col("moved") < 0)).cast("double").alias("net"))
    one = moved.withColumn("ticker", F.lit("all"))
    value = lambda bar, _: bar["net"]
    out = with_series(one, [ema("fast", 19, value, adjusted=True), ema("slow", 39, value, adjusted=True)])
    return out.select("date", "net", (F.col("fast") - F.col("slow")).alias("oscillator"))


