"""Price and trend screeners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import change, clamp, crossed_down, crossed_up, deviation, highest, lag, lowest, rank_share, rolling, rows, slope, sma, true_range
from ..sources.bars import latest, numbered
from .basics import atr, rsi_simple
from .screens import NUMBER, Recursive, Screen, ranked

SINCE = {"diff": f"coalesce(close - {lag('close')}, 0)"}
VOLUME_RATIO = f"volume / nullif(avg(volume) over {rows(19)}, 0)"


def momentum(month: float = 0.05, quarter: float = 0.10, volume: float = 1.2, most_rsi: float = 70, price: float = 5.0) -> Screen:
    return Screen(
        "momentum",
        (
            NUMBER | SINCE | {"return_1m": change("close", 21), "return_3m": change("close", 65), "volume_ratio": f"coalesce({VOLUME_RATIO}, 1)"},
            {"rsi": rsi_simple()},
            {"score": "return_1m + return_3m + (volume_ratio - 1) - (rsi - 50) / 100"},
        ),
        f"bar >= 66 and close >= {price} and return_1m >= {month} and return_3m >= {quarter} and volume_ratio >= {volume} and rsi <= {most_rsi}",
        ("close", "return_1m", "return_3m", "volume_ratio", "rsi", "score"),
    )


def breakout(days: int = 20, most_range: float = 0.15, above: float = 0.02, surge: float = 1.5, price: float = 5.0) -> Screen:
    base = rows(days + 4, -5)
    return Screen(
        "breakout",
        (
            NUMBER | {"base_high": f"max(close) over {base}", "base_low": f"min(close) over {base}", "volume_surge": f"coalesce(avg(volume) over {rows(4)} / nullif(avg(volume) over {rows(days + 9, -10)}, 0), 1)"},
            {"base_range": "(base_high - base_low) / nullif(base_low, 0)", "level": f"base_high * {1 + above}", "above_pct": "close / nullif(base_high, 0) - 1"},
            {"score": "(close / nullif(level, 0) - 1) * 100 + (volume_surge - 1) * 10"},
        ),
        f"bar >= 50 and close >= {price} and base_range <= {most_range} and close >= level and volume_surge >= {surge}",
        ("close", "base_range", "level", "above_pct", "volume_surge", "score"),
    )


def value_momentum(half_year: float = 0.15, most_volatility: float = 0.6, strength: float = 1.1, price: float = 10.0) -> Screen:
    """Bars must have the benchmark's close as market, on dates that both have."""
    return Screen(
        "value_momentum",
        (
            NUMBER | {"ret": change("close"), "return_6m": change("close", 131), "market_6m": change("market", 131)},
            {"volatility": f"stddev_samp(ret) over {rows(None)} * sqrt(252)", "strength": "coalesce(return_6m / nullif(market_6m, 0), 1)"},
            {"score": f"return_6m * 100 + greatest(0, {most_volatility} - volatility) * 100 + (strength - 1) * 100"},
        ),
        f"bar >= 132 and close >= {price} and return_6m >= {half_year} and volatility <= {most_volatility} and strength >= {strength}",
        ("close", "return_6m", "volatility", "strength", "score"),
    )


def minervini(least_rs: float = 70, volume: float = 100_000, price: float = 5.0, needed: int = 8) -> Screen:
    """Eight trend rules; rs_rating must be among the columns of bars."""
    flag = lambda c: f"case when {c} then 1 else 0 end"
    rules = {
        "c1": "close > sma_150 and close > sma_200", "c2": "sma_150 > sma_200", "c3": f"sma_200 > {lag('sma_200', 21)}", "c4": "ema_50 > sma_150 and ema_50 > sma_200",
        "c5": "close > ema_50", "c6": "close >= low_52w * 1.3", "c7": "close >= high_52w * 0.75", "c8": f"rs_rating > {least_rs}",
    }
    return Screen(
        "minervini",
        (
            (Recursive("ema_50", "close", 50),),
            NUMBER | {"sma_150": sma("close", 150), "sma_200": sma("close", 200), "low_52w": lowest("low", 252), "high_52w": highest("high", 252), "avg_volume": f"avg(volume) over {rows(19)}"},
            {k: flag(v) for k, v in rules.items()},
            {"passed": " + ".join(rules), "score": "close / nullif(high_52w, 0) * 100"},
        ),
        f"bar >= 252 and close >= {price} and avg_volume >= {volume} and passed >= {needed}",
        ("close", "sma_150", "sma_200", "ema_50", "passed", *rules, "score"),
    )


def rti(period: int = 50, short: int = 5, swing: int = 15, zones: tuple = (5, 10, 15), low: float = 20, expansion: float = 2.0, bars: int = 2, volume: float = 100_000, price: float = 5.0) -> Screen:
    """Range tightening: zones of quiet, runs of it, and a widening after it."""
    spread = "(high - low)"
    typical = "nullif((high + low + close) / 3, 0)"
    return Screen(
        "rti",
        (
            NUMBER | {"span": spread},
            {f"rti{k}_pct": f"{sma('span', n)} / {typical} * 100" for k, n in (("", period), ("_short", short), ("_swing", swing))} | {"avg_volume": f"avg(volume) over {rows(19)}"},
            {"quiet": f"coalesce(rti_pct < {low}, false)", "wider": f"coalesce({sma('rti_pct', 3)} > {sma('rti_pct', period)} * {expansion}, false)"},
            {"quiet_run": f"sum(case when quiet then 0 else 1 end) over {rows(None)}", "was_quiet": f"coalesce({lag('quiet')}, false)"},
            {"run": "case when quiet then row_number() over (partition by ticker, quiet_run, quiet order by date) else 0 end"},
            {
                "zone": f"case when rti_pct <= {zones[0]} then 'Extremely tight' when rti_pct <= {zones[1]} then 'Low' when rti_pct <= {zones[2]} then 'Moderately low' else 'Normal' end",
                "dot": f"case when run >= {bars} then 1 else 0 end", "expanded": "case when wider and was_quiet then 1 else 0 end",
            },
        ),
        f"bar >= 60 and close >= {price} and avg_volume >= {volume} and (rti_pct <= {zones[2]} or dot = 1 or expanded = 1)",
        ("close", "rti_pct", "rti_short_pct", "rti_swing_pct", "run", "dot", "expanded"),
        labels=("zone",),
    )


def launch_pad(periods: tuple = (10, 20, 50), window: int = 50, most_spread: float = 1.0, look_back: float = 0.3, least_slope: float = 1e-4, near: tuple = (2.0, 20), volume: float = 100_000, price: float = 5.0) -> Screen:
    """Averages close together, stacked and rising, with the price just above: five conditions on the last bar."""
    names = [f"ma_{n}" for n in periods]
    z = {f"z_{n}": f"case when bar > {window} then (ma_{n} - avg(ma_{n}) over {rows(window)}) / greatest(stddev_pop(ma_{n}) over {rows(window)}, 1e-8) end" for n in periods}
    slopes = {f"slope_{n}": slope(f"ma_{n}", max(1, int(n * look_back)) + 1) for n in periods}
    zs = ", ".join(z)
    flag = lambda c: f"case when {c} then 1 else 0 end"
    return Screen(
        "launch_pad",
        (
            tuple(Recursive(f"ma_{n}", "close", n, "ewm_adjusted") for n in periods),
            NUMBER,
            z | slopes | {"avg_volume": f"avg(volume) over {rows(19)}", "apart": f"abs(close - ({' + '.join(names)}) / {len(names)}.0)", "deviation": deviation("close", near[1])},
            {
                "spread": f"greatest({zs}) - least({zs})", "stacked": flag(" and ".join(f"{a} > {b}" for a, b in zip(names, names[1:]))),
                "rising": flag(" and ".join(f"slope_{n} > {least_slope}" for n in periods)), "above": flag(f"close > ma_{periods[0]}"), "clustered": flag(f"apart <= deviation * {near[0]}"),
            },
            {"tight": flag(f"spread <= {most_spread}")},
            {"met": "tight + stacked + rising + above + clustered"},
        ),
        f"bar >= {max(*periods, window) + 10} and close >= {price} and avg_volume >= {volume} and met = 5",
        ("close", "spread", "stacked", "rising", "above", "clustered", "tight", "met"),
    )


SHORT, LONG = (3, 5, 8, 10, 12, 15), (30, 35, 40, 45, 50, 60)
G_SHORT, G_LONG = [f"ema_{n}" for n in SHORT], [f"ema_{n}" for n in LONG]


def guppy(kind: str, compression: float = 0.02, expansion: float = 0.05, confirm: int = 3, convergence: tuple = (0.02, 30), volume: float = 100_000, price: float = 5.0) -> Screen:
    """Signals of two groups of averages: alignment, compression, expansion, crossover or convergence."""
    s, g, both = ", ".join(G_SHORT), ", ".join(G_LONG), ", ".join(G_SHORT + G_LONG)
    conditions = {
        "alignment": f"least({s}) > greatest({g}) or greatest({s}) < least({g})",
        "compression": f"tightest_5 <= {compression} and spread > tightest_5 * 1.5",
        "expansion": f"spread >= {expansion} and (short_mean > long_mean * 1.02 or short_mean < long_mean * 0.98)",
        "crossover": "(ups > 0 and downs = 0) or (downs > 0 and ups = 0)",
        "convergence": f"tightest <= {convergence[0]}",
    }
    return Screen(
        f"guppy_{kind}",
        (
            tuple(Recursive(name, "close", n) for name, n in zip(G_SHORT + G_LONG, SHORT + LONG)),
            NUMBER
            | {
                "short_mean": f"({' + '.join(G_SHORT)}) / {len(SHORT)}.0", "long_mean": f"({' + '.join(G_LONG)}) / {len(LONG)}.0",
                "short_spread": f"greatest({s}) / nullif(least({s}), 0) - 1", "long_spread": f"greatest({g}) / nullif(least({g}), 0) - 1", "band": f"greatest({both}) / nullif(least({both}), 0) - 1",
                "avg_volume": f"avg(volume) over {rows(19)}",
            },
            {"spread": "short_spread + long_spread", "separation_pct": "abs((short_mean - long_mean) / nullif(long_mean, 0)) * 100", "up": f"case when {crossed_up('short_mean', 'long_mean')} then 1 else 0 end", "down": f"case when {crossed_down('short_mean', 'long_mean')} then 1 else 0 end"},
            {"tightest_5": f"min(spread) over {rows(4)}", "tightest": f"min(band) over {rows(convergence[1] - 1)}", "ups": f"sum(up) over {rows(confirm - 1)}", "downs": f"sum(down) over {rows(confirm - 1)}"},
            {"direction": "case when short_mean > long_mean then 'bullish' else 'bearish' end", "confirmed": "case when volume >= avg_volume * 1.2 then 1 else 0 end"},
        ),
        f"bar >= 65 and close >= {price} and avg_volume >= {volume} and ({conditions[kind]})",
        ("close", "separation_pct", "spread", "tightest_5", "tightest", "confirmed"),
        labels=("direction",),
    )


def nine_million(volume: float = 9e6, ratio: float = 1.25) -> Screen:
    return Screen(
        "nine_million",
        (NUMBER | {"relative_volume": f"coalesce({VOLUME_RATIO}, 0)", "gain_pct": "(close / nullif(open, 0) - 1) * 100"},),
        f"bar >= 20 and volume >= {volume} and relative_volume >= {ratio} and close > open",
        ("close", "volume", "relative_volume", "gain_pct"), order="relative_volume",
    )


def weekly_movers(gain: float = 20.0, ratio: float = 1.25, volume: float = 100_000) -> Screen:
    week = rows(4)
    return Screen(
        "weekly_movers",
        (
            NUMBER | {"start": f"first_value(open) over {week}", "week_volume": f"avg(volume) over {week}", "week_high": f"max(high) over {week}", "week_low": f"min(low) over {week}", "month_volume": f"avg(volume) over {rows(19)}"},
            {"gain_pct": "(close / nullif(start, 0) - 1) * 100", "relative_volume": "coalesce(week_volume / nullif(month_volume, 0), 0)", "above_sma50": f"case when close > {sma('close', 50)} then 1 else 0 end"},
        ),
        f"bar >= 20 and gain_pct >= {gain} and week_volume >= {volume} and relative_volume >= {ratio} and close > start",
        ("close", "gain_pct", "week_volume", "relative_volume", "week_high", "week_low", "above_sma50"), order="gain_pct",
    )


def daily_gainers(gain: float = 4.0, ratio: float = 1.5, volume: float = 100_000) -> Screen:
    return Screen(
        "daily_gainers",
        (NUMBER | {"gain_pct": f"{change('close')} * 100", "relative_volume": f"coalesce({VOLUME_RATIO}, 0)", "sma_50": sma("close", 50)},),
        f"bar >= 50 and gain_pct >= {gain} and volume >= {volume} and relative_volume >= {ratio} and close > open and close > sma_50",
        ("close", "volume", "gain_pct", "relative_volume", "sma_50"), order="gain_pct",
    )


def stock_metrics() -> Screen:
    """Changes, position and momentum of each ticker with 50 bars, for group rankings."""
    return Screen(
        "stock_metrics",
        (
            NUMBER | {f"change_{k}d": f"coalesce({change('close', k)} * 100, 0)" for k in (1, 5, 20)} | {"relative_volume": f"coalesce({VOLUME_RATIO}, 0)", "sma_50": f"avg(close) over {rows(49)}"},
            {"momentum": "change_1d * 0.3 + change_5d * 0.4 + change_20d * 0.3", "above_sma50": "case when close > sma_50 then 1 else 0 end"},
        ),
        "bar >= 50",
        ("close", "change_1d", "change_5d", "change_20d", "relative_volume", "above_sma50", "momentum"), order="momentum",
    )


def qullamaggie(position: float = 0.5) -> Screen:
    """Averages in line, and the price in the upper part of its 20-bar range. Short histories use their longest average for the ones they lack."""
    mean = lambda n, other: f"case when bar >= {n} then avg(close) over {rows(n - 1)} else {other} end"
    return Screen(
        "qullamaggie",
        (
            NUMBER | {"tr": true_range()},
            (Recursive("ema10", "close", 10, "ewm_adjusted"),),
            {"sma20": f"avg(close) over {rows(19)}", "atr": rolling("avg", "tr", 14), "high_20": f"max(high) over {rows(19)}", "low_20": f"min(low) over {rows(19)}"},
            {"sma50": mean(50, "sma20")}, {"sma100": mean(100, "sma50")}, {"sma200": mean(200, "sma100")},
            {
                "aligned": " + ".join(f"case when {a} >= {b} then 1 else 0 end" for a, b in zip(("close", "ema10", "sma20", "sma50", "sma100"), ("ema10", "sma20", "sma50", "sma100", "sma200"))),
                "range_position": "coalesce((close - low_20) / nullif(high_20 - low_20, 0), 1)", "extension": "greatest(0, coalesce((close - sma50) / nullif(atr, 0), 0))",
            },
        ),
        f"bar >= 20 and aligned = 5 and range_position >= {position}",
        ("close", "ema10", "sma20", "sma50", "sma100", "sma200", "aligned", "atr", "extension", "range_position"), order="extension",
    )


def recent_listing(full: int = 200, least: int = 50, position: float = 0.5) -> Screen:
    """Tickers with `least` bars but fewer than `full`: the averages that there are in line, and the price in the upper part of its 20-bar range."""
    return Screen(
        "recent_listing",
        (
            NUMBER,
            (Recursive("ema10", "close", 10, "ewm_adjusted"),),
            {"sma20": f"avg(close) over {rows(19)}", "sma50": f"avg(close) over {rows(49)}", "high_20": f"max(high) over {rows(19)}", "low_20": f"min(low) over {rows(19)}"},
            {"range_position": "coalesce((close - low_20) / nullif(high_20 - low_20, 0), 1)"},
        ),
        f"bar >= {least} and bar < {full} and close >= ema10 and ema10 >= sma20 and sma20 >= sma50 and range_position >= {position}",
        ("close", "ema10", "sma20", "sma50", "bar", "range_position"), order="range_position",
    )


def tradable(bars: DataFrame, dimension: DataFrame, price: float = 5.0, cap: float = 1e9, exchanges: tuple = ("NASDAQ", "NYSE", "AMEX"), funds: tuple = ("ETF", "FUND", "TRUST"), least: int = 50) -> DataFrame:
    """ticker, bars and close of those with enough bars and price that the dimension doesn't rule out.

    A market cap below the least, another exchange or the name of a fund does; what the dimension lacks, or a ticker that isn't in it, doesn't.
    """
    last = bars.groupBy("ticker").agg(F.count("*").alias("bars"), F.max_by("close", "date").alias("close")).where((F.col("bars") >= least) & (F.col("close") >= price))
    fund = F.upper("description").rlike("|".join(funds))
    out = dimension.where(F.coalesce(F.col("market_cap") < cap, F.lit(False)) | F.coalesce(~F.col("exchange").isin(*exchanges), F.lit(False)) | F.coalesce(fund, F.lit(False)))
    return last.join(out.select("ticker"), "ticker", "left_anti")


STOCH = "coalesce(100 * (close - {low}) / nullif({high} - {low}, 0), 0)"


def _stochastic(n: int) -> str:
    return STOCH.format(low=lowest("low", n), high=highest("high", n))


def blue_dot(n: int = 10, level: float = 20, trend: int = 50) -> Screen:
    """The stochastic crosses a low level upwards while the average rises; all dates."""
    return Screen(
        "blue_dot",
        (NUMBER | {"k": _stochastic(n), "average": sma("close", trend)}, {"before": f"coalesce({lag('k')}, 0)", "rising": f"coalesce(average > {lag('average')}, false)"}, {"score": f"60 + ({level} - before)"}),
        f"bar >= 2 and before < {level} and k > {level} and rising",
        ("close", "volume", "before", "k", "average", "score"), last_only=False,
    )


def black_dot(n: int = 10, level: float = 25, look_back: int = 3, trend: int = 30, fast: int = 21) -> Screen:
    """An up close above an average soon after an oversold stochastic; all dates."""
    return Screen(
        "black_dot",
        (
            (Recursive("fast", "close", fast, "ewm_adjusted"),),
            NUMBER | {"k": _stochastic(n), "average": sma("close", trend)},
            {"least_k": f"min(k) over {rows(look_back, -1)}", "before": lag("close")},
            {"score": f"65 + ({level} - least_k)"},
        ),
        f"bar > {look_back} and least_k <= {level} and close > before and (coalesce(close > average, false) or close > fast)",
        ("close", "volume", "least_k", "average", "fast", "score"), last_only=False,
    )


def pivot_high(strength: int) -> str:
    """Above all of the bars before it and no lower than those after it, with as many bars on each side."""
    before, after = rows(strength, -1), "(partition by ticker order by date rows between 1 following and {} following)".format(strength)
    return f"case when count(high) over {before} = {strength} and count(high) over {after} = {strength} and high > max(high) over {before} and high >= max(high) over {after} then 1 else 0 end"


#: Highest pivot first, then the earliest: a pair, so that neither can blur the other.
PIVOT_ORDER = "case when pivot_bar is not null then struct(-pivot_level, pivot_bar) end"


def green_line(strength: int = 10, look_back: int = 63, confirmation: int = 10) -> Screen:
    """The high breaks the highest confirmed pivot of the look-back; all dates. A pivot is known only `strength` bars later."""
    window = rows(look_back, -1)
    return Screen(
        "green_line",
        (
            NUMBER | {"is_pivot": pivot_high(strength)},
            {"pivot_level": "case when is_pivot = 1 then high end", "pivot_bar": "case when is_pivot = 1 then bar end"},
            {"level": f"max(pivot_level) over {window}"},
            {"level_bar": f"min_by(pivot_bar, {PIVOT_ORDER}) over {window}"},
            {"bars_since": "bar - level_bar", "strength_pct": "(high - level) / nullif(level, 0) * 100"},
            {"score": "70 + least(strength_pct, 30)"},
        ),
        f"bar > {look_back} and high > level and bars_since >= {confirmation}",
        ("close", "volume", "level", "high", "strength_pct", "score"), last_only=False,
    )


def trend_model() -> Screen:
    """Where the close stands to three averages and how they slope, a projection over five bars, and how steady the side of the middle average has been."""
    return Screen(
        "trend_model",
        (
            NUMBER | {f"sma_{n}": sma("close", n) for n in (10, 20, 50)},
            {f"slope_{n}": f"case when bar >= {least} then (sma_{n} - {lag(f'sma_{n}', k)}) / {k}e0 else 0 end" for n, k, least in ((10, 5, 15), (20, 10, 30), (50, 20, 70))}
            | {"side": "case when close > sma_20 then 1 else 0 end", "signals": " + ".join(f"case when close > sma_{n} then 1 else 0 end" for n in (10, 20, 50)), "recent": change("close", 5)},
            {"steady": f"sum(side) over {rows(18, -4)}", "projected": "(recent * 0.3 + slope_20 / nullif(close, 0) * 0.7) * 5"},
            {"score": f"signals / 3e0 * 50 + {clamp('(slope_10 + slope_20 + slope_50) * 1000', -50, 50)}", "confidence": "case when side = 1 then steady else 15 - steady end / 15e0", "price_5": "close * (1 + projected)"},
        ),
        "bar >= 50",
        ("close", "slope_10", "slope_20", "slope_50", "signals", "score", "projected", "price_5", "confidence"),
    )


def mean_reversion(n: int = 20, width: float = 2.0) -> Screen:
    return Screen(
        "mean_reversion",
        (
            NUMBER | SINCE | {"middle": sma("close", n), "sd": deviation("close", n)},
            {"upper": f"middle + {width} * sd", "lower": f"middle - {width} * sd", "rsi": rsi_simple()},
            {"position": "(close - lower) / nullif(upper - lower, 0)", "potential": "middle / nullif(close, 0) - 1"},
            {"score": "case when rsi < 30 and position < 0.2 then 100 - rsi when rsi > 70 and position > 0.8 then rsi - 100 else 0 end", "direction": "case when rsi < 30 and position < 0.2 then 'up' when rsi > 70 and position > 0.8 then 'down' else 'neutral' end"},
        ),
        "bar >= 30",
        ("close", "middle", "upper", "lower", "position", "rsi", "score", "potential"), labels=("direction",),
    )


def volatility_model(n: int = 20, year: int = 252) -> Screen:
    """Volatility now against all of the ticker's history."""
    every = "(partition by ticker)"
    return Screen(
        "volatility_model",
        (
            NUMBER | {"ret": change("close")},
            {"vol_20": deviation("ret", n), "vol_50": deviation("ret", 50), "recent": deviation("ret", 5)},
            {
                "volatility": f"stddev_samp(ret) over {every} * sqrt({year})", "current_20": f"vol_20 * sqrt({year})", "mean_50": f"avg(vol_50) over {every} * sqrt({year})",
                "percentile": f"count(vol_20) over (partition by ticker order by vol_20 range unbounded preceding) * 100e0 / nullif(count(ret) over {every}, 0)",
                "clustering": f"recent / nullif(percentile(vol_20, 0.5) over {every}, 0)", "var_95": f"case when count(ret) over {every} >= {year} then percentile(ret, 0.05) over {every} end",
                "downside": f"case when count(case when ret < 0 then 1 end) over {every} > 5 then stddev_samp(case when ret < 0 then ret end) over {every} else stddev_samp(ret) over {every} end * sqrt({year})",
            },
            {"regime": "case when percentile > 80 then 'high' when percentile < 20 then 'low' else 'normal' end"},
        ),
        "bar >= 30",
        ("close", "volatility", "current_20", "mean_50", "percentile", "clustering", "var_95", "downside"), labels=("regime",), order="volatility",
    )


def momentum_volume(bars: int = 15, volume_bars: int = 15, trend: int = 50, multiple: float = 1.5, long: bool = True) -> Screen:
    """Momentum, volume ratio and trend of every ticker, with a signal."""
    loud, quiet = f"volume_ratio > {multiple}", f"volume_ratio < {1 / multiple}"
    buy, sell = (f"{loud} and momentum > 0", f"{quiet} and momentum < 0") if long else (f"{quiet} and momentum > 0", f"{loud} and momentum < 0")
    return Screen(
        "momentum_volume",
        (
            NUMBER | {"momentum": f"coalesce({change('close', bars - 1)}, 0)", "volume_ratio": f"coalesce(volume / nullif({sma('volume', volume_bars)}, 0), 1)", "trend_score": f"coalesce({change('close', trend - 1)}, 0)"},
            {"score": "(momentum * 0.4 + (volume_ratio - 1) * 0.4 + trend_score * 0.2) * 100", "signal": f"case when {buy} then 'BUY' when {sell} then 'SELL' else 'HOLD' end"},
        ),
        f"bar > {bars}",
        ("close", "momentum", "volume_ratio", "trend_score", "score"), labels=("signal",),
    )


#: Conditions and scores of the types of the range screener.
ATR_TYPES = {
    "high_volatility": ("atr_percentile > 0.8", "(atr_percentile - 0.8) * 100 + atr_pct * 2"),
    "low_volatility": ("atr_percentile < 0.2", "(0.2 - atr_percentile) * 100 + (5 - atr_pct)"),
    "extended_above": ("atr_ext > 2", "atr_ext * 10 + atr_percentile * 20"),
    "extended_below": ("atr_ext < -2", "-atr_ext * 10 + atr_percentile * 20"),
    "optimal_entry": ("abs(atr_ext) <= 1", "(1 - abs(atr_ext)) * 50 + atr_percentile * 20"),
}


def atr_types(bars: DataFrame, price: float = 1.0, volume: float = 10_000) -> DataFrame:
    """ticker, date, kind, close, atr, atr_pct, atr_ext, atr_percentile and score: a row for each type that the last bar of a ticker with 110 bars fits."""
    last = latest(numbered(atr(bars))).where((F.col("bar") >= 110) & (F.col("close") >= price) & (F.col("volume") >= volume))
    fits = [F.when(F.expr(c), F.struct(F.lit(k).alias("kind"), F.expr(s).alias("score"))) for k, (c, s) in ATR_TYPES.items()]
    out = last.withColumn("fit", F.explode(F.filter(F.array(*fits), lambda x: x.isNotNull()))).where("fit.score > 0")
    return out.select("ticker", "date", "fit.kind", "close", "atr", "atr_pct", "atr_ext", "atr_percentile", "fit.score")


def green_line_levels(bars: DataFrame, strength: int = 10, look_back: int = 63, confirmation: int = 10, confirmed_only: bool = False) -> DataFrame:
    """ticker, bar, date, level, confirmed, breakout_bar and breakout_date: a row for each pivot that is the highest high of its look-back.

    It breaks out at the first close above it from `confirmation` bars later on, and is confirmed if no high
    before that passes it. The breakout is found with one pass over a ticker's closes and a join on bars
    within the ticker: levels are few, and each meets only the running maximum's steps.
    """
    flagged = numbered(bars).withColumns({"is_pivot": F.expr(pivot_high(strength)), "highest": F.expr(f"max(high) over {rows(look_back)}"), "soon": F.expr(f"max(high) over {rows(-1, confirmation - 1)}")})
    levels = flagged.where("is_pivot = 1 and high >= highest").select("ticker", "bar", "date", F.col("high").alias("level"), F.coalesce(F.col("soon") <= F.col("high"), F.lit(True)).alias("confirmed"))
    later = numbered(bars).select("ticker", F.col("bar").alias("later"), F.col("date").alias("later_date"), "close")
    broken = levels.select("ticker", "bar", "level").join(later, "ticker").where((F.col("later") >= F.col("bar") + confirmation) & (F.col("close") > F.col("level")))
    broken = broken.groupBy("ticker", "bar").agg(F.min("later").alias("breakout_bar"), F.min_by("later_date", "later").alias("breakout_date"))
    out = levels.join(broken, ["ticker", "bar"], "left")
    return out.where("confirmed") if confirmed_only else out


def cascade(monthly: DataFrame, tops: tuple = ((12, 50), (6, 30), (3, 10))) -> DataFrame:
    """The best of the last month by twelve, six and three months in turn, with perf_{n}m in percent. monthly: a row a ticker and month."""
    perf = {f"perf_{n}m": F.expr(f"(close / nullif(lag(close, {n}) over (partition by ticker order by date), 0) - 1) * 100") for n, _ in tops}
    out = latest(monthly.withColumns(perf)).where(f"perf_{tops[0][0]}m is not null")
    for n, top in tops:
        out = ranked(out, f"perf_{n}m", top)
    return out


def cascade_performance(monthly: DataFrame, tops: tuple = ((12, 50), (6, 30), (3, 10)), least: int = 10) -> DataFrame:
    """month, tickers (sorted) and performance: each month's best by twelve, six and three months in turn, and 1 plus their mean return of the month after.

    monthly: ticker, date (a row a month), close. A month with fewer than `least` tickers that have twelve
    months gives nothing; the last month's performance is 1.
    """
    by = "partition by ticker order by date"
    out = monthly.withColumns({f"perf_{n}": F.expr(f"close / nullif(lag(close, {n}) over ({by}), 0) - 1") for n, _ in tops})
    out = out.withColumn("after", F.expr(f"lead(close) over ({by}) / nullif(close, 0) - 1")).where(f"perf_{tops[0][0]} is not null")
    out = out.withColumn("known", F.expr("count(*) over (partition by date)")).where(F.col("known") >= least)
    for n, top in tops:
        out = out.withColumn("place", F.expr(f"row_number() over (partition by date order by perf_{n} desc, ticker)")).where(F.col("place") <= top)
    return out.groupBy(F.col("date").alias("month")).agg(F.array_join(F.array_sort(F.collect_list("ticker")), ",").alias("tickers"), (1 + F.coalesce(F.avg("after"), F.lit(0.0))).alias("performance"))


#: Weights of a day, a week and a month in the strength of an industry.
LEADER_WEIGHTS = {"rs_1": 1.0, "rs_5": 2.0, "rs_22": 4.0}


def leaders(strengths: DataFrame, dimension: DataFrame, weights: dict[str, float] | None = None, least: int = 3, share: float = 0.2, each: int = 4) -> DataFrame:
    """ticker, industry, strength, industry_strength, industry_place and place: the best `each` tickers of the best share of industries.

    A ticker's strength is the weighted mean of those that it has; an industry's is the mean over its tickers, if it has `least` of them.
    """
    weights = weights or LEADER_WEIGHTS
    total = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    weight = sum((F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    own = strengths.join(dimension.select("ticker", "industry"), "ticker").select("ticker", "industry", F.try_divide(total, weight).alias("strength")).where("strength is not null and industry is not null")
    industries = own.groupBy("industry").agg(F.avg("strength").alias("industry_strength"), F.count("*").alias("members")).where(F.col("members") >= least)
    placed = industries.withColumns({"industry_place": F.expr("row_number() over (order by industry_strength desc, industry)").cast("long"), "top": F.expr(f"greatest(1, cast(floor(count(*) over () * {share}) as int))")})  # a row an industry
    best = own.join(F.broadcast(placed.where("industry_place <= top").drop("top", "members")), "industry")
    best = best.withColumn("place", F.expr("row_number() over (partition by industry order by strength desc, ticker)").cast("long")).where(F.col("place") <= each)
    return best.select("ticker", "industry", "strength", "industry_strength", "industry_place", "place")


def range_rank(bars: DataFrame, n: int = 14, within: DataFrame | None = None) -> DataFrame:
    """ticker, date, atr and atr_rank: the last mean true range of n bars, and its rank among all tickers (or those of `within`) as 0 to 100, ties sharing the mean rank."""
    out = latest(bars.withColumn("tr", F.expr(true_range())).withColumn("atr", F.expr(rolling("avg", "tr", n)))).select("ticker", "date", "atr")
    out = out if within is None else out.join(within.select("ticker").distinct(), "ticker", "left_semi")
    return out.withColumn("atr_rank", F.expr(f"{rank_share('atr')} * 100"))


def scored(table: DataFrame, score: str, least: float, strong: float, top: float, price: float = 5.0) -> DataFrame:
    """Rows of a table of scores (ticker, close, score) that reach `least`, with their tier."""
    tier = F.when(F.col(score) >= top, "leader").when(F.col(score) >= strong, "strong").otherwise("average")
    return table.where((F.col(score) >= least) & (F.col("close") >= price)).select("ticker", "close", score, tier.alias(f"{score}_tier"))


def scored_twice(slow: DataFrame, fast: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Tickers in both results of scored(), with the mean of their scores."""
    return slow.join(fast.drop("close"), "ticker").withColumn("mean_score", (F.col(names[0]) + F.col(names[1])) / 2)
