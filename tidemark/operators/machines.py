"""State machines over bars: volatility stops, breakout positions and smoothed cycles. Each is one fold over a ticker's bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folds import rma, with_series, with_states
from ..functions.windows import crossed_down, crossed_up, lag, rolling, sma, true_range
from ..sources.bars import latest, numbered


def volatility_stop(bars: DataFrame, length: int = 20, factor: float = 3.0, stop: str = "stop", trend: str = "uptrend") -> DataFrame:
    """bars with a trailing stop at `factor` ranges and whether the trend is up.

    The range is an adjusted mean with weight 1/length, and the true range itself until there are
    `length` bars. The stop follows the extreme of the trend; when the close passes it, the trend turns
    and extremes start anew from the close. Before the second bar the stop is 0 and the trend up.
    """
    own = bars.columns
    out = with_series(bars.withColumn("tr", F.expr(true_range())), [rma("atr", length, lambda bar, _: bar["tr"], adjusted=True, least=length)])

    def step(s: dict[str, Column], bar: Column) -> dict[str, Column]:
        first = s["n"] == 0
        away = F.coalesce(bar["atr"] * factor, bar["tr"])
        close = bar["close"]
        top, bottom = F.greatest(s["top"], close), F.least(s["bottom"], close)
        moved = F.when(s["up"], F.greatest(s["level"], top - away)).otherwise(F.least(s["level"], bottom + away))
        up = close - moved >= 0
        turned = up != s["up"]
        reset = F.when(up, close - away).otherwise(close + away)
        pick = lambda at_first, later: F.when(first, at_first).otherwise(later)
        return {
            "n": s["n"] + 1,
            "top": pick(close, F.when(turned, close).otherwise(top)),
            "bottom": pick(close, F.when(turned, close).otherwise(bottom)),
            "level": pick(F.lit(0.0), F.when(turned, reset).otherwise(moved)),
            "up": pick(F.lit(True), up),
        }

    start = {"n": F.lit(0), "top": F.lit(0.0), "bottom": F.lit(0.0), "level": F.lit(0.0), "up": F.lit(True)}
    out = with_states(out, start, step)
    return out.select(*own, F.col("level").alias(stop), F.col("up").alias(trend))


def atr_cloud(bars: DataFrame, slow: tuple[int, float] = (20, 3.0), fast: tuple[int, float] = (20, 1.5)) -> DataFrame:
    """bars with two volatility stops, their middle, and crossings of the fast one over the slow one."""
    out = volatility_stop(bars, *slow, "stop", "uptrend")
    out = volatility_stop(out, *fast, "stop_fast", "uptrend_fast")
    return out.withColumns({"cloud": F.expr("(stop + stop_fast) / 2"), "cross_up": F.expr(crossed_up("stop_fast", "stop")), "cross_down": F.expr(crossed_down("stop_fast", "stop"))})


def atr_signals(bars: DataFrame, length: int = 20, price: float = 1.0, volume: float = 10_000) -> DataFrame:
    """The last crossing of each ticker's cloud, with what has happened since and a score."""
    rows = numbered(atr_cloud(bars)).withColumn("avg_volume", F.expr(sma("volume", 20, 1)))
    crossing = F.col("cross_up") | F.col("cross_down")
    signal = F.struct("date", "close", "bar", F.when(F.col("cross_up"), "Long").otherwise("Short").alias("signal"))
    last = rows.groupBy("ticker").agg(
        F.max_by(signal, F.when(crossing, F.col("date"))).alias("s"), F.max("date").alias("date"), F.max("bar").alias("bars"),
        *(F.max_by(c, "date").alias(c) for c in ("close", "volume", "avg_volume", "stop", "stop_fast", "cloud", "uptrend")),
    )
    last = last.where((F.col("bars") >= length + 10) & (F.col("close") >= price) & (F.col("avg_volume") >= volume) & F.col("s").isNotNull())
    last = last.select("ticker", "date", "close", "volume", "stop", "stop_fast", "cloud", F.col("uptrend").cast("int").alias("uptrend"), F.col("s.signal").alias("signal"), F.col("s.date").alias("signal_date"),
                       (F.col("bars") - F.col("s.bar")).alias("bars_since"), ((F.try_divide("close", "s.close") - 1) * 100).alias("change_pct"))
    score = (
        "greatest(0, 20 + case when bars_since <= 5 then 15 - bars_since * 2 when bars_since <= 10 then 10 - bars_since else 0 end"
        " + case when signal = 'Long' and change_pct > 0 then least(change_pct, 10) when signal = 'Short' and change_pct < 0 then least(-change_pct, 10)"
        " when signal = 'Long' and change_pct < -5 then -5 when signal = 'Short' and change_pct > 5 then -5 else 0 end"
        " + case when (signal = 'Long') = (uptrend = 1) then 5 else 0 end)"
    )
    return last.withColumn("score", F.expr(score))


def breakout_positions(bars: DataFrame, price_bars: int = 20, volume_bars: int = 20, trend_bars: int = 50, close_after: int = 5, long: bool = True, short: bool = True) -> DataFrame:
    """bars with a position: Buy or Sell on a break of the range on record volume with the trend, closed after so many closes in a row beyond the trend."""
    out = bars.withColumns({"top": F.expr(rolling("max", "high", price_bars)), "bottom": F.expr(rolling("min", "low", price_bars)), "record": F.expr(rolling("max", "volume", volume_bars)), "trend": F.expr(sma("close", trend_bars))})
    out = out.withColumns({f"{c}_before": F.expr(lag(c)) for c in ("top", "bottom", "record")})

    def step(s: dict[str, Column], bar: Column) -> dict[str, Column]:
        known = bar["trend"].isNotNull() & bar["top_before"].isNotNull()
        loud = bar["volume"] > bar["record_before"]
        buy = F.lit(long) & (bar["close"] > bar["top_before"]) & loud & (bar["close"] > bar["trend"]) & (s["position"] != "Buy")
        sell = F.lit(short) & (bar["close"] < bar["bottom_before"]) & loud & (bar["close"] < bar["trend"]) & (s["position"] != "Sell")
        opened = F.when(buy, "Buy").when(sell, "Sell").otherwise(s["position"])
        against = ((opened == "Buy") & (bar["close"] < bar["trend"])) | ((opened == "Sell") & (bar["close"] > bar["trend"]))
        held = (opened == "Buy") | (opened == "Sell")
        run = F.when(held & against, F.when(buy | sell, 0).otherwise(s["run"]) + 1).otherwise(0)
        closed = held & (run >= close_after)
        position = F.when(closed, F.concat(F.lit("Close "), opened)).otherwise(opened)
        keep = lambda now, before: F.when(known, now).otherwise(before)
        return {"position": keep(position, s["position"]), "run": keep(F.when(closed, 0).otherwise(run), s["run"])}

    out = with_states(out, {"position": F.lit("No Signal"), "run": F.lit(0)}, step)
    return out.withColumn("changed", F.expr(f"case when position <> coalesce({lag('position')}, 'No Signal') then 1 else 0 end"))


def breakout_signals(bars: DataFrame, price: float = 1.0, volume: float = 10_000, **settings) -> DataFrame:
    """The last change of position of each ticker, with its score."""
    rows = numbered(breakout_positions(bars, **settings)).withColumn("avg_volume", F.expr(sma("volume", 20, 1)))
    signal = F.struct("date", "close", "bar", "volume", "trend", "top_before", "record_before", "position")
    last = rows.groupBy("ticker").agg(F.max_by(signal, F.when(F.col("changed") == 1, F.col("date"))).alias("s"), F.max("date").alias("date"), F.max("bar").alias("bars"), F.max_by("close", "date").alias("close"), F.max_by("avg_volume", "date").alias("avg_volume"))
    last = last.where(F.col("s").isNotNull() & (F.col("close") >= price) & (F.col("avg_volume") >= volume))
    broke = F.when(F.col("s.position") == "Buy", F.try_divide("s.close", "s.top_before") - 1).otherwise(F.try_divide("s.top_before", "s.close") - 1) * 100
    surge, apart = (F.try_divide("s.volume", "s.record_before") - 1) * 100, F.abs(F.try_divide("s.close", "s.trend") - 1) * 100
    since = F.datediff("date", "s.date")
    score = (broke * 2 + surge + F.least(apart, F.lit(10.0))) * (0.7 + 0.3 * F.greatest(F.lit(0.0), (10 - since) / 10))
    score = F.when(F.col("s.position").isin("Buy", "Sell"), F.greatest(score, F.lit(0.0))).otherwise(0.0)
    return last.select("ticker", "date", "close", F.col("s.position").alias("signal"), F.col("s.date").alias("signal_date"), F.col("s.close").alias("signal_price"), since.alias("days_since"), score.alias("score"))


def smoothed_cycles(bars: DataFrame, average: int = 20, confirm: int = 3) -> DataFrame:
    """bars with cycle, Bull or Bear, which turns only once the close has been on the other side for confirm + 1 bars."""
    out = bars.withColumn("sma", F.expr(sma("close", average)))
    out = out.withColumn("raw", F.expr("case when sma is null then null when close >= sma then 'Bull' else 'Bear' end"))

    def step(s: dict[str, Column], bar: Column) -> dict[str, Column]:
        same = bar["raw"] == s["last"]
        run = F.when(bar["raw"].isNull(), 0).when(same, s["run"] + 1).otherwise(1)
        cycle = F.when(bar["raw"].isNull(), s["cycle"]).when(s["cycle"].isNull() | (run > confirm), bar["raw"]).otherwise(s["cycle"])
        return {"last": F.coalesce(bar["raw"], s["last"]), "run": run, "cycle": cycle}

    none = F.lit(None).cast("string")
    return with_states(out, {"last": none, "run": F.lit(0), "cycle": none}, step).drop("last", "run", "raw")


def stops(bars: DataFrame, length: int = 20, factor: float = 3.0) -> DataFrame:
    """The last stop of each ticker and the close's distance from it in percent."""
    out = latest(volatility_stop(bars, length, factor))
    return out.withColumn("distance_pct", (F.try_divide("close", "stop") - 1) * 100)
