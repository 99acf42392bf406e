"""The accumulation/distribution line: its divergences from price, breakouts, monthly consistency, short-term momentum and averages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import clamp, lag, rows, slope, sma
from .screens import NUMBER, Screen, ranked, screened

FLOW = "coalesce((2 * close - high - low) / nullif(high - low, 0), 0) * volume"
LINE = (NUMBER | {"flow": FLOW}, {"adl": f"round(sum(flow) over {rows(None)}, 6)"})  # equal levels stay equal, whatever the order of sums
#: Bars on each side of an extreme, and bars in which a divergence is looked for.
SIDE, SPAN = 5, 20


def _extreme(column: str, low: bool) -> str:
    before, after = rows(SIDE, -1), f"(partition by ticker order by date rows between 1 following and {SIDE} following)"
    op, agg = ("<=", "min") if low else (">=", "max")
    return f"case when count({column}) over {before} = {SIDE} and count({column}) over {after} = {SIDE} and {column} {op} {agg}({column}) over {before} and {column} {op} {agg}({column}) over {after} then {column} end"


def _latest_of(value: str, mark: str, frame: str) -> str:
    """The value on the last row of a frame where mark isn't null."""
    return f"max_by({value}, case when {mark} is not null then bar end) over {frame}"


def divergence(bullish: bool = True, least: float = 0.7, volume: float = 100_000, price: float = 5.0) -> Screen:
    """The last two extremes of the price and of the line within the last bars point apart."""
    frame, earlier = rows(SPAN - SIDE - 1, -SIDE), rows(None, -1)
    marks = {"p": _extreme("close", bullish), "a": _extreme("adl", bullish)}
    before = {f"{m}_{k}": _latest_of(v, m, earlier) for m in marks for k, v in (("before", m), ("bar_before", "bar"))}
    last = {f"{m}{i}": _latest_of(v, m, frame) for m in marks for i, v in ((1, m), (2, f"{m}_before"), (3, f"{m}_bar_before"))}
    down, up = "(p2 - p1) / nullif(p2, 0) * 100", "(a1 - a2) / nullif(abs(a2), 0) * 100"
    price_pct, line_pct = (down, up) if bullish else (f"-({down})", f"-({up})")
    return Screen(
        "adl_bullish_divergence" if bullish else "adl_bearish_divergence",
        (*LINE, marks, before, last, {"price_pct": price_pct, "line_pct": line_pct, "avg_volume": f"avg(volume) over {rows(19)}"}, {"score": "(price_pct + line_pct) / 2"}),
        f"bar >= {SPAN} and p3 >= bar - {SPAN - SIDE - 1} and a3 >= bar - {SPAN - SIDE - 1} and price_pct > 0 and line_pct > 0 and score >= {least} and close >= {price} and avg_volume >= {volume}",
        ("close", "volume", "adl", "price_pct", "line_pct", "score"),
    )


def breakout(up: bool = True, bars: int = 30, least: float = 1.2, volume: float = 100_000, price: float = 5.0) -> Screen:
    """The line leaves the range of the bars before by so many times the old extreme, on at least average volume."""
    agg, sign = ("max", 1) if up else ("min", -1)
    return Screen(
        "adl_breakout" if up else "adl_breakdown",
        (*LINE, {"old": f"{agg}(adl) over {rows(bars - 1, -1)}", "avg_volume": f"avg(volume) over {rows(19)}", "volume_10": f"avg(volume) over {rows(9)}"}, {"score": f"{sign} * (adl - old) / nullif(abs(old), 0)"}),
        f"bar >= {bars} and score > 0 and score >= {least} and volume >= volume_10 and close >= {price} and avg_volume >= {volume}",
        ("close", "volume", "adl", "old", "score"),
    )


def monthly(period: int = 22, low: float = 15, high: float = 30, months: int = 3, look_back: int = 6, least: float = 60) -> Screen:
    """How evenly the line has grown from month to month, and for how many months in a row up to now within the band."""
    at = lambda k: f"coalesce({lag('adl', k * period)}, adl)" if k == 0 else lag("adl", k * period)
    changes = {f"m{k}": f"case when {lag('adl', (k + 1) * period)} is null then null when {lag('adl', (k + 1) * period)} = 0 then 0.0 else ({at(k)} - {lag('adl', (k + 1) * period)}) / abs({lag('adl', (k + 1) * period)}) * 100 end" for k in range(look_back)}
    total = lambda term: " + ".join(term(f"m{k}") for k in range(look_back))
    streak = "case " + " ".join(f"when not coalesce(m{k} between {low} and {high}, false) then {k}" for k in range(look_back)) + f" else {look_back} end"
    return Screen(
        "adl_monthly",
        (
            *LINE, changes,
            {"n": total(lambda m: f"case when {m} is not null then 1 else 0 end"), "inside": total(lambda m: f"case when {m} between {low} and {high} then 1 else 0 end"), "positive": total(lambda m: f"case when {m} > 1e-9 then 1 else 0 end"),
             "mean": f"({total(lambda m: f'coalesce({m}, 0)')}) / nullif({total(lambda m: f'case when {m} is not null then 1e0 else 0e0 end')}, 0)"},
            {"sd": f"sqrt(({total(lambda m: f'coalesce(({m} - mean) * ({m} - mean), 0)')}) / nullif(n, 0))", "streak": streak},
            {"score": "least(100, inside * 70e0 / nullif(n, 0) + (positive - inside) * 20e0 / nullif(n, 0) + case when n >= 2 then greatest(0, 10 - sd / 2) else 0 end)"},
        ),
        f"bar > {period * look_back} and score >= {least} and streak >= {months}",
        ("close", "volume", "adl", "mean", "inside", "streak", "score"),
    )


def short_term(periods: tuple = (5, 10, 20), threshold: float = 5.0, least: float = 50) -> Screen:
    """Changes of the line over a few spans, their pattern and a score."""
    a, b, c = (f"adl_{p}d" for p in periods)
    normal = lambda x: clamp(f"({x} + 20) / 40 * 100", 0, 100)
    return Screen(
        "adl_short_term",
        (
            *LINE,
            {f"adl_{p}d": f"coalesce((adl - {lag('adl', p)}) / nullif(abs({lag('adl', p)}), 0) * 100, 0)" for p in periods},
            {
                "signal": f"case when {a} = 0 and {b} = 0 and {c} = 0 then 'neutral' when {a} > {b} and {b} > {c} and {a} > {threshold} then 'acceleration' when {a} < {b} and {b} < {c} then 'deceleration'"
                f" when case when {a} > 0 then 1 else 0 end + case when {b} > 0 then 1 else 0 end + case when {c} > 0 then 1 else 0 end >= 2 and greatest({a}, {b}, {c}) > {threshold} then 'momentum' else 'neutral' end",
                "base": f"({normal(f'({a} + {b} + {c}) / 3')}) * 0.4 + ({normal(f'({a} * 3 + {b} * 2 + {c}) / 6')}) * 0.6",
            },
            {"score": "case signal when 'acceleration' then least(100, base + 15) when 'momentum' then least(100, base + 10) when 'deceleration' then greatest(0, base - 10) else base end"},
        ),
        f"bar > {max(periods)} and score >= {least}",
        ("close", "volume", "adl", a, b, c, "score"), labels=("signal",),
    )


def averages(periods: tuple = (20, 50, 100), look_back: int = 10, least: float = 70) -> Screen:
    """Alignment of the line's averages with a score, their slopes and a recent crossing of the first two."""
    s, m, g = (f"ma_{p}" for p in periods)
    return Screen(
        "adl_averages",
        (
            *LINE,
            {f"ma_{p}": sma("adl", p) for p in periods},
            {f"slope_{p}": slope(f"ma_{p}", p, 2) for p in periods}
            | {
                "alignment": f"case when {s} > {m} and {m} > {g} then 'bullish' when {s} < {m} and {m} < {g} then 'bearish' else 'neutral' end",
                "apart": f"(abs(({s} - {m}) / nullif({m}, 0)) + abs(({m} - {g}) / nullif({g}, 0))) / 2 * 100",
                "golden": f"case when {s} > {m} and {lag(s)} <= {lag(m)} then 1 else 0 end", "death": f"case when {s} < {m} and {lag(s)} >= {lag(m)} then 1 else 0 end",
            },
            {"score": "least(100, case alignment when 'bullish' then 60 when 'bearish' then 20 else 40 end + least(30, apart * 6) + case when apart > 1 and apart < 5 then 10 else 0 end)", "goldens": f"sum(golden) over {rows(look_back - 2)}", "deaths": f"sum(death) over {rows(look_back - 2)}"},
        ),
        f"bar >= {max(periods) + look_back} and score >= {least} and alignment = 'bullish'",
        ("close", "volume", "adl", s, m, g, *(f"slope_{p}" for p in periods), "goldens", "deaths", "score"), labels=("alignment",), settled=(s, m, g),
    )


#: Weights of the three parts of the composite, and the score and number that it keeps.
WEIGHTS, LEAST, TOP = (0.4, 0.3, 0.3), 70.0, 50


def strength_layers(n: int = 20) -> tuple[dict[str, str], ...]:
    """Layers that give strength, 0 to 100: how far the line (adl) confirms the close over n bars; 50 before that."""
    return (
        {"line_change": f"round(adl - {lag('adl', n)}, 6)", "price_change": f"round(close - {lag('close', n)}, 6)"},
        {
            "strength": "case when line_change is null or price_change is null then 50e0 when line_change * price_change > 0"
            " then 50 + least(abs(line_change), abs(price_change)) / greatest(abs(line_change), abs(price_change), 1e0) * 50"
            " else 50 - abs(line_change - price_change) / (abs(line_change) + abs(price_change) + 1) * 50 end"
        },
    )


def composite(bars: DataFrame, parts: Sequence[Screen]) -> DataFrame:
    """ticker, score and place of the TOP tickers by the weighted sum of the scores of three screens that they all pass."""
    scores = [screened(bars, p).select("ticker", F.col("score").alias(f"s{i}")) for i, p in enumerate(parts)]
    joined = scores[0].join(scores[1], "ticker").join(scores[2], "ticker")
    total = sum((F.col(f"s{i}") * w for i, w in enumerate(WEIGHTS)), F.lit(0.0))
    top = ranked(joined.select("ticker", total.alias("score")), "score", TOP)
    return top.withColumn("place", F.expr("row_number() over (order by score desc, ticker)").cast("long"))  # TOP rows
