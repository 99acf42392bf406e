"""Volume screeners: unusual volume by several measures."""

from __future__ import annotations

from ..functions.windows import change, deviation, lag, rolling, rows, sma
from .screens import NUMBER, Screen

TYPICAL = "(high + low + close) / 3"


def vroc(n: int = 25, threshold: float = 50, look_back: int = 20) -> Screen:
    return Screen(
        "vroc",
        (NUMBER | {"vroc": f"{change('volume', n)} * 100"}, {"mean": sma("vroc", look_back), "sd": deviation("vroc", look_back)}, {"z": "coalesce((vroc - mean) / nullif(sd, 0), 0)", "direction": "case when vroc > 0 then 'Positive' else 'Negative' end"}),
        f"abs(vroc) > {threshold}",
        ("close", "volume", "vroc", "z"), last_only=False, labels=("direction",), order="z",
    )


def rvol(n: int = 20, threshold: float = 2.0, extreme: float = 5.0, volume: float = 1e6) -> Screen:
    return Screen(
        "rvol",
        (NUMBER | {"rvol": f"volume / nullif({sma('volume', n)}, 0)"}, {"strength": f"case when rvol > {extreme} then 'Extreme' else 'Strong' end", "category": "case when rvol > 10 then 'Exceptional' when rvol > 5 then 'Very High' when rvol > 2 then 'High' else 'Moderate' end"}),
        f"rvol > {threshold} and volume > {volume}",
        ("close", "volume", "rvol"), last_only=False, labels=("strength", "category"), order="rvol",
    )


def adtv(n: int = 50, spans: tuple = (63, 126, 252), threshold: float = 2.0, volume: float = 1e6, since: str = "1900-01-01") -> Screen:
    names = ("ratio_3m", "ratio_6m", "ratio_1y")
    most = f"greatest({', '.join(f'coalesce({c}, 0)' for c in names)})"
    return Screen(
        "adtv",
        (
            NUMBER | {"adtv": sma("volume", n)},
            {c: f"adtv / nullif({lag('adtv', k)}, 0)" for c, k in zip(names, spans)},
            {"most": most},
            {"timeframe": "case when ratio_3m = most then '3M' when ratio_6m = most then '6M' else '1Y' end", "strength": "case when most >= 5 then 'Extreme' when most >= 3 then 'Strong' else 'Moderate' end"},
        ),
        f"most >= {threshold} and volume > {volume} and date >= date '{since}'",
        ("close", "volume", "adtv", *names, "most"), last_only=False, labels=("timeframe", "strength"), order="most",
    )


def mfi_columns(n: int = 14) -> tuple[dict, ...]:
    up = f"{rolling('sum', 'inflow', n)}"
    down = f"{rolling('sum', 'outflow', n)}"
    return (
        NUMBER | {"typical": TYPICAL},
        {"inflow": f"case when typical > {lag('typical')} then typical * volume else 0.0 end", "outflow": f"case when typical < {lag('typical')} then typical * volume else 0.0 end"},
        {"mfi": f"case when {down} = 0 and {up} > 0 then 100.0 else 100 - 100 / (1 + {up} / nullif({down}, 0)) end"},
    )


def mfi(n: int = 14, high: float = 80, low: float = 20) -> Screen:
    return Screen(
        "mfi",
        (*mfi_columns(n), {"signal": f"case when mfi > {high} then 'Overbought' else 'Oversold' end", "strength": "case when mfi > 90 or mfi < 10 then 'Extreme' else 'Strong' end"}),
        f"mfi > {high} or mfi < {low}",
        ("close", "volume", "mfi", "typical"), last_only=False, labels=("signal", "strength"), order="mfi",
    )


def vpt(threshold: float = 0.05, n: int = 20) -> Screen:
    return Screen(
        "vpt",
        (
            NUMBER | {"step": f"volume * {change('close')}"},
            {"vpt": f"sum(step) over {rows(None)}"},
            {"vpt_change": change("vpt"), "vpt_mean": sma("vpt", n)},
            {"direction": "case when vpt_change > 0 then 'Positive' else 'Negative' end", "strength": f"case when abs(vpt_change) > {2 * threshold} then 'Strong' else 'Moderate' end"},
        ),
        f"abs(vpt_change) > {threshold}",
        ("close", "volume", "vpt", "vpt_change"), last_only=False, labels=("direction", "strength"), order="vpt_change",
    )


def sigma(cutoff: float = 12, volume: float = 10_000) -> Screen:
    """Volume beyond the ticker's mean by so many population deviations; all dates."""
    every = "(partition by ticker)"
    return Screen(
        "sigma",
        ({"mean": f"avg(volume) over {every}", "sd": f"stddev_pop(volume) over {every}"}, {"sigmas": "(volume - mean) / nullif(sd, 0)"}),
        f"sigmas > {cutoff} and volume >= {volume}",
        ("close", "volume", "sigmas"), last_only=False, order="sigmas",
    )


def absolute(months: int = 15, days: int = 3, cutoff: float = 10, volume: float = 100_000, price: float = 20, as_of: str | None = None) -> Screen:
    """The largest volume of the last months, if it is of the last days before as_of (the last date of all bars unless given) and stands out."""
    today = f"date '{as_of}'" if as_of else "max(date) over ()"
    return Screen(
        "absolute",
        (
            {"today": today},
            {"age": "unix_date(today) - unix_date(date)"},
            {"recent": f"case when age <= {months} * 30.4375 then volume end"},
            {"top": "max(recent) over (partition by ticker)", "mean": "avg(recent) over (partition by ticker)", "sd": "stddev_pop(recent) over (partition by ticker)"},
            {"sigmas": "(volume - mean) / nullif(sd, 0)"},
        ),
        f"recent = top and age <= {days} and close >= {price} and volume >= {volume} and sigmas >= {cutoff}",
        ("close", "volume", "age", "sigmas"), last_only=False, order="sigmas",
    )


def statistical(n: int = 50, cutoff: float = 3.0, volume: float = 100_000, relative: float = 1.5) -> Screen:
    return Screen(
        "statistical",
        (NUMBER | {"mean": sma("volume", n), "sd": deviation("volume", n)}, {"z": "(volume - mean) / nullif(sd, 0)", "relative": "volume / nullif(mean, 0)"}),
        f"z > {cutoff} and volume >= {volume} and relative >= {relative}",
        ("close", "volume", "z", "relative"), last_only=False, order="z",
    )


def surge(short: int = 5, long: int = 20, lift: float = 2.0, spike: float = 3.0) -> Screen:
    """Volume that surges after a quiet time: its short mean is more than `lift` times the long one, and it is itself more than `spike` times that."""
    return Screen(
        "volume_surge",
        (NUMBER | {"mean_short": sma("volume", short), "mean_long": sma("volume", long)}, {"relative": "mean_short / nullif(mean_long, 0)"}),
        f"relative > {lift} and volume > {spike} * mean_long",
        ("close", "volume", "relative"), last_only=False, order="relative",
    )


def breakout(n: int = 30, ratio: float = 1.5) -> Screen:
    return Screen(
        "volume_breakout",
        (NUMBER | {"top_before": f"max(high) over {rows(n, -1)}", "volume_before": f"avg(volume) over {rows(n, -1)}"}, {"relative": "volume / nullif(volume_before, 0)"}),
        f"bar > {n} and close > top_before and relative >= {ratio}",
        ("close", "volume", "top_before", "relative"), last_only=False, order="relative",
    )


def top_share(n: int = 252, share: float = 0.95, relative: float = 1.5) -> Screen:
    """Volume above the quantile of its last n bars and so many times their mean; all dates."""
    return Screen(
        "top_share",
        (NUMBER | {"mean": sma("volume", n), "edge": f"percentile(volume, {share}) over {rows(n - 1)}"}, {"relative": "volume / nullif(mean, 0)"}),
        f"bar >= {n} and volume > edge and relative >= {relative}",
        ("close", "volume", "edge", "relative"), last_only=False, order="relative",
    )
