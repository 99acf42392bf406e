"""The indicator library: one function for each, bars in, bars with columns out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import crossed_down, crossed_up, deviation, highest, lag, lowest, rows, sma
from .adl import LINE
from .screens import NUMBER, Layer, Recursive, layered
from .volume import mfi_columns


def _flag(c: str) -> str:
    return f"case when {c} then 1 else 0 end"


def ema_layers(n: int, column: str = "close") -> tuple[Layer, ...]:
    return ((Recursive(f"ema_{n}", column, n),),)


def sma_layers(n: int, column: str = "close") -> tuple[Layer, ...]:
    return ({f"sma_{n}": sma(column, n)},)


def rsi_layers(n: int = 14, high: float = 70, low: float = 30) -> tuple[Layer, ...]:
    """Wilder's RSI from the first bar on, and 1 where it crosses the low level upwards, -1 where it crosses the high one downwards."""
    return (
        {"gain": f"greatest(coalesce(close - {lag('close')}, 0), 0)", "loss": f"greatest(coalesce({lag('close')} - close, 0), 0)"},
        (Recursive("gain_mean", "gain", n, weight=1.0 / n), Recursive("loss_mean", "loss", n, weight=1.0 / n)),
        {"rsi": "case when loss_mean = 0 then case when gain_mean > 0 then 100.0 end else 100 - 100 / (1 + gain_mean / loss_mean) end"},
        {"rsi_signal": f"case when rsi > {low} and {lag('rsi')} <= {low} then 1 when rsi < {high} and {lag('rsi')} >= {high} then -1 else 0 end"},
    )


def macd_layers(fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[Layer, ...]:
    return (
        (Recursive("macd_fast", "close", fast), Recursive("macd_slow", "close", slow)),
        {"macd": "macd_fast - macd_slow"},
        (Recursive("macd_signal", "macd", signal),),
        {"macd_histogram": "macd - macd_signal"},
    )


def ppo_layers(fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[Layer, ...]:
    return (
        (Recursive("ppo_fast", "close", fast), Recursive("ppo_slow", "close", slow)),
        {"ppo": "(ppo_fast - ppo_slow) / nullif(ppo_slow, 0) * 100"},
        (Recursive("ppo_signal", "ppo", signal),),
        {"ppo_histogram": "ppo - ppo_signal"},
    )


def tsi_layers(fast: int = 13, slow: int = 25, signal: int = 13) -> tuple[Layer, ...]:
    """True strength: a doubly smoothed change over a doubly smoothed absolute change."""
    return (
        {"change": f"close - {lag('close')}", "distance": f"abs(close - {lag('close')})"},
        (Recursive("change_slow", "change", slow), Recursive("distance_slow", "distance", slow)),
        (Recursive("change_fast", "change_slow", fast), Recursive("distance_fast", "distance_slow", fast)),
        {"tsi": "100 * change_fast / nullif(distance_fast, 0)"},
        (Recursive("tsi_signal", "tsi", signal),),
    )


def kurutoga_layers(n: int = 14) -> tuple[Layer, ...]:
    return ({f"kurutoga_{n * k}": f"close - ({highest('high', n * k)} + {lowest('low', n * k)}) / 2" for k in (1, 2, 4)},)


def mfi_layers(n: int = 14, signal: int = 9) -> tuple[Layer, ...]:
    return (*mfi_columns(n), (Recursive("mfi_signal", "mfi", signal),))


def momentum_layers(n: int = 20) -> tuple[Layer, ...]:
    """The change over n bars, and its place between the extremes so far in percent."""
    return ({"momentum": f"close - {lag('close', n)}"}, {"momentum_place": f"(momentum - min(momentum) over {rows(None)}) / nullif(max(momentum) over {rows(None)} - min(momentum) over {rows(None)}, 0) * 100"})


def gravity_layers(n: int = 10) -> tuple[Layer, ...]:
    """Centre of gravity: minus the weighted mean place of the last n closes, the newest first."""
    terms = " + ".join(f"{k + 1} * {lag('close', k) if k else 'close'}" for k in range(n))
    return ({"cog": f"-({terms}) / nullif(sum(close) over {rows(n - 1)}, 0)"}, {"cog_mean": sma("cog", 3)})


def crosses_layers(fast: int = 50, slow: int = 200) -> tuple[Layer, ...]:
    return ({"cross_fast": sma("close", fast), "cross_slow": sma("close", slow)}, {"golden_cross": _flag(crossed_up("cross_fast", "cross_slow")), "death_cross": _flag(crossed_down("cross_fast", "cross_slow"))})


def easy_trade_layers(n: int = 10, width: float = 1.0) -> tuple[Layer, ...]:
    """MACD against bands around its own mean."""
    return (
        *macd_layers(),
        {"band_middle": sma("macd", n), "band_sd": deviation("macd", n)},
        {"band_upper": f"band_middle + {width} * band_sd", "band_lower": f"band_middle - {width} * band_sd"},
        {"easy_trend": "case when macd > band_upper then 'up' when macd < band_lower then 'down' else 'flat' end", "easy_up": _flag(crossed_up("macd", "band_upper")), "easy_down": _flag(crossed_down("macd", "band_lower"))},
    )


def ribbon_layers(periods: Sequence[int] = (10, 20, 50)) -> tuple[Layer, ...]:
    """1 if every faster average is above every slower one, -1 if below, else 0."""
    names = [f"ribbon_{n}" for n in periods]
    rising = " and ".join(f"{a} > {b}" for a, b in zip(names, names[1:]))
    falling = " and ".join(f"{a} < {b}" for a, b in zip(names, names[1:]))
    return ({name: sma("close", n) for name, n in zip(names, periods)}, {"ribbon": f"case when {rising} then 1 when {falling} then -1 else 0 end"})


def envelope_layers(n: int = 20, pct: float = 2.5) -> tuple[Layer, ...]:
    return (
        {"envelope_middle": sma("close", n)},
        {"envelope_upper": f"envelope_middle * {1 + pct / 100}", "envelope_lower": f"envelope_middle * {1 - pct / 100}"},
        {"envelope": "case when close >= envelope_upper then 1 when close <= envelope_lower then -1 else 0 end"},
    )


def adline_layers(n: int = 50) -> tuple[Layer, ...]:
    """The accumulation line and the sign of its slope over n + 1 bars."""
    frame = rows(n)
    return (*LINE, {"adl_trend": f"case when count(adl) over {frame} > {n} then cast(sign(regr_slope(adl, bar) over {frame}) as int) end"})


def divergence_layers(column: str, n: int = 20) -> tuple[Layer, ...]:
    """1 where the price's newest centred low is under the one before and the column's isn't, -1 for highs the other way round."""
    around = f"(partition by ticker order by date rows between {n // 2} preceding and {n // 2 - 1} following)"
    before = rows(n, -1)
    return (
        {f"{x}_{k}": f"case when {c} = {agg}({c}) over {around} then {c} end" for x, c in (("price", "close"), ("line", column)) for k, agg in (("low", "min"), ("high", "max"))} | NUMBER,
        {f"{x}_{k}_before": f"max_by({x}_{k}, case when {x}_{k} is not null then bar end) over {before}" for x in ("price", "line") for k in ("low", "high")},
        {"divergence": f"case when price_low < price_low_before and {column} > line_low_before then 1 when price_high > price_high_before and {column} < line_high_before then -1 else 0 end"},
    )


def line_divergence_layers(column: str, n: int = 20) -> tuple[Layer, ...]:
    """1 where both price and column have a centred low, each with one in the n bars before, and the price's is lower and the column's higher; -1 for highs the other way round.

    The first and last n bars of a ticker have none.
    """
    around = f"(partition by ticker order by date rows between {n // 2} preceding and {n // 2 - 1} following)"
    before = rows(n, -1)
    marks = [(x, c, k, agg) for x, c in (("price", "close"), ("line", column)) for k, agg in (("low", "min"), ("high", "max"))]
    return (
        NUMBER | {"bars": "count(*) over (partition by ticker)"} | {f"{x}_{k}": f"case when count({c}) over {around} = {n} and {c} = {agg}({c}) over {around} then {c} end" for x, c, k, agg in marks},
        {f"{x}_{k}_before": f"max_by({x}_{k}, case when {x}_{k} is not null then bar end) over {before}" for x, _, k, _ in marks},
        {"divergence": f"case when bar <= {n} or bar > bars - {n} then 0 when line_low is not null and price_low < price_low_before and {column} > line_low_before then 1 when line_high is not null and price_high > price_high_before and {column} < line_high_before then -1 else 0 end"},
    )


def anchored_vwap(bars: DataFrame, anchors: Sequence[str], price: str = "(high + low + close) / 3") -> DataFrame:
    """ticker, anchor, start (the first bar on or after it), date, close and vwap from there on, for every anchor date."""
    dates = F.explode(F.array(*(F.lit(a).cast("date") for a in anchors))).alias("anchor")
    rows_ = bars.select("*", dates).where("date >= anchor")
    frame = "(partition by ticker, anchor order by date rows unbounded preceding)"
    out = rows_.withColumns({"start": F.expr("min(date) over (partition by ticker, anchor)"), "vwap": F.expr(f"sum({price} * volume) over {frame} / nullif(sum(volume) over {frame}, 0)")})
    return out.select("ticker", "anchor", "start", "date", "close", "vwap")


def vwap_statistics(vwaps: DataFrame) -> DataFrame:
    """ticker, anchor, start, days since, the last vwap and the close's distance from it."""
    last = vwaps.groupBy("ticker", "anchor").agg(F.min("start").alias("start"), F.max("date").alias("date"), F.max_by("close", "date").alias("close"), F.max_by("vwap", "date").alias("vwap"))
    return last.select("ticker", "anchor", "start", F.datediff("date", "start").alias("days"), "vwap", ((F.try_divide("close", "vwap") - 1) * 100).alias("distance_pct"), (F.col("close") > F.col("vwap")).cast("int").alias("above"))


def rolling_correlation(a: DataFrame, b: DataFrame, n: int = 20) -> DataFrame:
    """date, correlation of the returns of two bar series on their common dates over n of them, and its strength."""
    day = "(order by date)"
    both = a.select("date", F.col("close").alias("x")).join(b.select("date", F.col("close").alias("y")), "date")
    moves = both.withColumns({"rx": F.expr(f"x / nullif(lag(x) over {day}, 0) - 1"), "ry": F.expr(f"y / nullif(lag(y) over {day}, 0) - 1")})
    frame = f"(order by date rows between {n - 1} preceding and current row)"
    out = moves.withColumn("correlation", F.expr(f"case when count(rx) over {frame} >= {n} then corr(rx, ry) over {frame} end"))
    kind = "case when correlation >= 0.7 then 'strong positive' when correlation >= 0.3 then 'moderate positive' when correlation > -0.3 then 'weak' when correlation > -0.7 then 'moderate negative' when correlation is not null then 'strong negative' end"
    return out.select("date", "correlation", F.expr(kind).alias("strength"))


def price_statistics(bars: DataFrame) -> DataFrame:
    """ticker, n, mean, median, quartiles, deviation, extremes, total return in percent and greatest drawdown."""
    rows_ = bars.withColumn("peak", F.expr(f"max(close) over {rows(None)}"))
    quartile = lambda q: F.percentile("close", F.lit(q))
    return rows_.groupBy("ticker").agg(
        F.count("close").alias("n"), F.avg("close").alias("mean"), quartile(0.5).alias("median"), quartile(0.25).alias("q25"), quartile(0.75).alias("q75"), F.stddev_samp("close").alias("sd"), F.min("close").alias("least"), F.max("close").alias("most"),
        ((F.try_divide(F.max_by("close", "date"), F.min_by("close", "date")) - 1) * 100).alias("return_pct"), (F.min(F.try_divide("close", "peak") - 1) * 100).alias("drawdown_pct"),
    )


#: Indicators by the names of the small language: builder of layers, names of their parameters, main column.
BUILDERS = {
    "RSI": (rsi_layers, "rsi"), "PPO": (ppo_layers, "ppo"), "MACD": (macd_layers, "macd"), "EMA": (ema_layers, None), "SMA": (sma_layers, None), "TSI": (tsi_layers, "tsi"), "MFI": (mfi_layers, "mfi"),
    "MOM": (momentum_layers, "momentum"), "COG": (gravity_layers, "cog"), "ADLINE": (adline_layers, "adl"), "ENVELOPE": (envelope_layers, "envelope"), "KURUTOGA": (kurutoga_layers, None), "RIBBON": (ribbon_layers, "ribbon"),
}


def register(name: str, builder, column: str | None = None) -> None:
    """Adds an indicator to the language: builder takes its numbers and gives layers."""
    BUILDERS[name.upper()] = (builder, column)


def combined(bars: DataFrame) -> DataFrame:
    """bars with momentum, money flow and RSI and whether they agree."""
    out = layered(bars, (*momentum_layers(), *mfi_layers(), *rsi_layers()))
    bull = "case when momentum > 0 then 1 else 0 end + case when mfi > 50 then 1 else 0 end + case when rsi > 50 then 1 else 0 end"
    return out.withColumn("agree", F.expr(f"case when {bull} = 3 then 'bullish' when {bull} = 0 then 'bearish' else 'mixed' end"))
