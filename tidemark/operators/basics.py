"""Basic calculations for each ticker: returns and risk, candles, averages, moves, extremes and volume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.folds import Series, ema, rma, wilder, with_series
from ..functions.windows import TICKER, change, clamp, deviation, highest, lag, lowest, rolling, rows, sma, true_range
from ..sources.bars import latest, numbered
from .screens import BACK, at_last, with_back

#: Body, doji and wick bands of a candle; the averages' slope looks back so many bars.
BANDS, SLOPE_BARS = (0.7, 0.4, 0.1), 5


def returns(bars: DataFrame, risk_free: float = 0.02, year: int = 252) -> DataFrame:
    """ticker, days, total_return, volatility, sharpe and max_drawdown; the first bar has no return and counts in no peak."""
    daily = bars.withColumns({"ret": F.expr(change("close")), "base": F.expr(f"first_value(close) over ({TICKER})")})
    grown = daily.withColumn("grown", F.expr("case when ret is not null then close / nullif(base, 0) end"))
    peak = grown.withColumn("peak", F.expr(f"max(grown) over {rows(None)}"))
    out = peak.groupBy("ticker").agg(
        F.count("ret").alias("days"),
        (F.max_by("grown", "date") - 1).alias("total_return"),
        (F.stddev_samp("ret") * year**0.5).alias("volatility"),
        F.try_divide(F.avg("ret") * year - risk_free, F.stddev_samp("ret") * year**0.5).alias("sharpe"),
        F.min(F.try_divide(F.col("grown"), F.col("peak")) - 1).alias("max_drawdown"),
    )
    return out


def candles(bars: DataFrame) -> DataFrame:
    """bars with the shares of body and wicks in the range, the wick that opposes the body, strength, type and mean strength of five bars.

    A bar without range has shares and strength 0, is a Doji and doesn't count in the mean.
    """
    span, (strong, medium, weak) = "nullif(high - low, 0)", BANDS
    out = bars.withColumns(
        {
            "body_ratio": F.expr(f"abs(close - open) / {span}"),
            "upper_wick_ratio": F.expr(f"(high - greatest(open, close)) / {span}"),
            "lower_wick_ratio": F.expr(f"(least(open, close) - low) / {span}"),
        }
    )
    out = out.withColumn("oppression", F.expr("case when close > open then lower_wick_ratio else upper_wick_ratio end"))
    out = out.withColumn("strength", F.expr("body_ratio * (1 - oppression)"))
    out = out.withColumn("strength_5", F.expr(f"avg(strength) over {rows(4)}"))
    kind = f"case when body_ratio > {strong} then 'Strong Body' when body_ratio > {medium} then 'Moderate Body' when body_ratio > {weak} then 'Weak Body' else 'Doji' end"
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("body_ratio", "upper_wick_ratio", "lower_wick_ratio", "strength")}
    return out.withColumn("candle", F.expr(kind)).withColumns(zero)


def averages(bars: DataFrame, spans: Sequence[int] = (10, 20), windows: Sequence[int] = (20, 50)) -> DataFrame:
    """bars with adjusted EMAs and SMAs, their slopes over five bars and the close against each SMA in percent."""
    out = with_series(bars, [ema(f"ema_{n}", n, adjusted=True) for n in spans])
    out = out.withColumns({f"sma_{n}": F.expr(sma("close", n)) for n in windows})
    names = [f"ema_{n}" for n in spans] + [f"sma_{n}" for n in windows]
    out = out.withColumns({f"{c}_slope": F.expr(f"({c} - {lag(c, SLOPE_BARS)}) / {SLOPE_BARS}.0") for c in names})
    return out.withColumns({f"price_to_sma_{n}": F.expr(f"(close / nullif(sma_{n}, 0) - 1) * 100") for n in windows})


def rsi_simple(column: str = "close", n: int = 14) -> str:
    """RSI of simple means: 50 where there is neither gain nor loss or no gain, 100 without loss. Needs diff, the change over a bar (0 on the first)."""
    up, down = sma("greatest(diff, 0)", n), sma("greatest(-diff, 0)", n)
    return f"case when {up} is null then 50.0 when {up} = 0 then 50.0 when {down} = 0 then 100.0 else 100 - 100 / (1 + {up} / nullif({down}, 0)) end"


def technicals(bars: DataFrame, last: bool = False) -> DataFrame:
    """bars (with `last`, values on each ticker's last row only, and rows_back) with rsi_14, the position in the 52-week range (all history until 52 bars, 0.5 if flat) and MACD of adjusted EMAs from bar 35 on."""
    out = bars.withColumn("diff", F.expr(f"coalesce(close - {lag('close')}, 0)"))
    out = with_series(
        out,
        [
            ema("fast", 12, adjusted=True),
            ema("slow", 26, adjusted=True),
            ema("macd_signal", 9, lambda _, made: made["fast"] - made["slow"], adjusted=True),
        ],
    )
    out = numbered(with_back(out) if last else out)
    text = at_last if last else str
    high, low = text(f"max(close) over {rows(251)}"), text(f"min(close) over {rows(251)}")
    out = out.withColumns(
        {
            "rsi_14": F.expr(text(rsi_simple())),
            "position_52w": F.expr(f"case when {high} = {low} then 0.5 else (close - {low}) / nullif({high} - {low}, 0) end"),
            "macd": F.expr("case when bar >= 35 then fast - slow end"),
            "macd_signal": F.expr("case when bar >= 35 then macd_signal end"),
        }
    )
    return out.withColumn("macd_histogram", F.expr("macd - macd_signal")).drop("diff", "fast", "slow")


def atr(bars: DataFrame, n: int = 14, base: int = 50, share_rows: int = 100, last: bool = False) -> DataFrame:
    """bars (with `last`, values on each ticker's last row only, and rows_back) with Wilder's atr, atr_pct, the distance from the average in ATRs, and the share of the last rows with a smaller ATR."""
    out = with_series(bars.withColumn("tr", F.expr(true_range())), [wilder("atr", n, lambda bar, _: bar["tr"])])
    out, text = with_back(out) if last else out, at_last if last else str
    out = out.withColumns({"atr_pct": F.expr("atr / nullif(close, 0) * 100"), "atr_ext": F.expr(text(f"(close - {sma('close', base)}) / nullif(atr, 0)"))})
    past = out.withColumn("past", F.expr(text(f"collect_list(atr) over {rows(share_rows - 1)}")))
    share = F.try_divide(F.size(F.filter("past", lambda x: x < F.col("atr"))), F.lit(share_rows))
    return past.withColumn("atr_percentile", F.when(F.expr(text(f"count(*) over {rows(share_rows - 1)}")) >= share_rows, share)).drop("past", "tr")


def moves(bars: DataFrame, periods: Sequence[int] = (5, 10, 22, 66, 132, 252)) -> DataFrame:
    """bars with percentage moves. intraday_pct is open to close; a move over p bars counts this bar as the first, so it looks p-1 back."""
    out = bars.withColumn("intraday_pct", F.expr("(close / nullif(open, 0) - 1) * 100"))
    out = out.withColumns({f"pct_{p}": F.expr(f"{change('close', p - 1)} * 100") for p in periods})
    recent, before = f"avg(close) over {rows(4)}", f"avg(close) over {rows(19, -15)}"
    enough = f"count(close) over {rows(19)} >= 20"
    return out.withColumn("momentum_20", F.expr(f"case when {enough} then ({recent} / nullif({before}, 0) - 1) * 100 end"))


def extremes(bars: DataFrame) -> DataFrame:
    """ticker, ath, ath_date, atl, atl_date, new_ath, new_atl, distance of the last close from both in percent and its position between them."""
    out = bars.groupBy("ticker").agg(
        F.max("close").alias("ath"), F.min("close").alias("atl"), F.max_by("close", "date").alias("close"), F.max_by("date", F.struct("close", F.expr("-datediff(date, date'1970-01-01')"))).alias("ath_date"),
        F.min_by("date", F.struct("close", "date")).alias("atl_date"),
    )
    return out.select(
        "ticker", "close", "ath", "ath_date", "atl", "atl_date",
        (F.col("close") >= F.col("ath")).cast("int").alias("new_ath"), (F.col("close") <= F.col("atl")).cast("int").alias("new_atl"),
        (F.try_divide("close", "ath") * 100 - 100).alias("from_ath_pct"), (F.try_divide("close", "atl") * 100 - 100).alias("from_atl_pct"),
        F.coalesce(F.try_divide(F.col("close") - F.col("atl"), F.col("ath") - F.col("atl")) * 100, F.lit(50.0)).alias("position_pct"),
    )


def volume_metrics(bars: DataFrame) -> DataFrame:
    """bars with avg_volume_20, the last five bars' volume against the five before, on-balance volume and its slope over 20 bars."""
    out = bars.withColumn("signed", F.expr(f"coalesce(sign(close - {lag('close')}) * volume, 0)"))
    out = out.withColumns(
        {
            "avg_volume_20": F.expr(sma("volume", 20, least=1)),
            "volume_trend": F.expr(f"case when count(volume) over {rows(9)} >= 10 then coalesce(avg(volume) over {rows(4)} / nullif(avg(volume) over {rows(9, -5)}, 0) - 1, 0) end"),
            "obv": F.expr(f"sum(signed) over {rows(None)}"),
        }
    )
    return out.withColumn("obv_slope", F.expr(f"(obv - {lag('obv', 19)}) / 20.0")).drop("signed")


#: Weights of the three horizons; spans of the long EMA, long ROC, short EMA, short ROC and RSI; bounds of the labels.
SCOOTER = {"st": ((0.6, 0.3, 0.1), (200, 125, 50, 20, 14), (90, 70, 40)), "fast": ((0.1, 0.3, 0.6), (50, 20, 21, 5, 7), (85, 65, 30))}


def scooter(bars: DataFrame, variant: str = "st") -> DataFrame:
    """bars with scooter, a score of 0 to 99.9 from distances to EMAs, rates of change, the slope of the PPO histogram and Wilder's RSI; null until there are enough bars."""
    (long, middle, short), (long_ema, long_roc, short_ema, short_roc, rsi), (top, strong, average) = SCOOTER[variant]
    out = numbered(bars.withColumn("diff", F.expr(f"close - {lag('close')}")))
    ppo = lambda _, made: F.try_divide(made["ppo_fast"] - made["ppo_slow"], made["ppo_slow"]) * 100
    part = lambda sign: lambda bar, _: F.when(bar["diff"].isNotNull(), F.greatest(sign * bar["diff"], F.lit(0.0)))
    series = [ema("long_ema", long_ema), ema("short_ema", short_ema), ema("ppo_fast", 12), ema("ppo_slow", 26), ema("ppo_signal", 9, ppo)]
    out = with_series(out, [*series, rma("gain", rsi, part(1)), rma("loss", rsi, part(-1))])
    out = out.withColumns(
        {
            "histogram": F.expr("(ppo_fast - ppo_slow) / nullif(ppo_slow, 0) * 100 - ppo_signal"),
            "rsi_centred": F.expr("coalesce(100 - 100 / nullif(1 + gain / nullif(loss, 0), 0) - 50, 0)"),
            "long_pct": F.expr("(close / nullif(long_ema, 0) - 1) * 100"),
            "long_roc": F.expr(f"coalesce({change('close', long_roc)} * 100, 0)"),
            "short_pct": F.expr("(close / nullif(short_ema, 0) - 1) * 100"),
            "short_roc": F.expr(f"coalesce({change('close', short_roc)} * 100, 0)"),
        }
    )
    out = out.withColumn("ppo_slope", F.expr(clamp(f"coalesce((histogram - {lag('histogram', 3)}) / 3, 0)", -50, 50)))
    total = f"(long_pct + long_roc) / 2 * {long} + (short_pct + short_roc) / 2 * {middle} + (ppo_slope + rsi_centred) / 2 * {short}"
    score = f"case when bar >= {max(long_ema, long_roc, 35)} then {clamp(f'50 + 2.5 * ({total})', 0, 99.9)} end"
    label = f"case when scooter >= {top} then 'leader' when scooter >= {strong} then 'strong' when scooter >= {average} then 'average' when scooter is not null then 'weak' end"
    out = out.withColumn("scooter", F.expr(score)).withColumn("scooter_label", F.expr(label))
    return out.select(*bars.columns, "long_pct", "long_roc", "short_pct", "short_roc", "ppo_slope", "rsi_centred", "scooter", "scooter_label")


def matrix(bars: DataFrame) -> DataFrame:
    """The last row of each ticker with all blocks beside each other, numbers to two digits. Blocks by bars are made one after another on the same bars."""
    last = {"candles": candles, "averages": averages, "technicals": lambda b: technicals(b, last=True), "atr": lambda b: atr(b, last=True), "moves": moves, "volume_metrics": volume_metrics, "scooter": scooter}
    made = {k: [c for c in block(bars).columns if c not in {*bars.columns, BACK}] for k, block in last.items()}
    rows_ = bars
    for k in ("averages", "technicals", "atr", "scooter", "candles", "moves", "volume_metrics"):  # first those with series, on narrower rows
        rows_ = last[k](rows_)
    out = latest(rows_.where(F.col(BACK) == 0)).select(*bars.columns, *(c for columns in made.values() for c in columns))
    whole = returns(bars)
    out = out.join(whole, "ticker", "left").select(*bars.columns, *whole.columns[1:], *out.columns[len(bars.columns) :]).join(extremes(bars).drop("close"), "ticker", "left")
    return out.select(*(F.round(c, 2).alias(c) if kind == "double" else c for c, kind in out.dtypes))


PLAIN = ["open", "high", "low", "close", "volume"]
