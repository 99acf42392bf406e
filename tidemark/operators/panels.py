"""The panel language: short texts that name a ticker and what to show of it, to a table of values by date.

RSI(14), PPO(QQQ,12,26,9), SPY + EMA(20), QQQ:SPY, A_PPO(12,26,9)_for_(SPY), B_CORR(20)_for_(SPY,QQQ), SPY.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .indicators import BUILDERS, rolling_correlation
from .movers import ratios
from .screens import layered

CALL = re.compile(r"^([A-Za-z_]+)\((.*)\)$")


@dataclass(frozen=True)
class Panel:
    """kind: price, indicator, ratio, correlation or bundle. place: main, above or below."""

    kind: str
    tickers: tuple[str, ...] = ()
    indicator: str = ""
    numbers: tuple[float, ...] = ()
    place: str = "main"
    parts: tuple[Panel, ...] = field(default=())


def _arguments(text: str) -> tuple[tuple[str, ...], tuple[float, ...]]:
    tickers, numbers = [], []
    for part in filter(None, (x.strip() for x in text.split(","))):
        try:
            numbers.append(float(part))
        except ValueError:
            tickers.append(part.upper())
    return tuple(tickers), tuple(numbers)


def parsed(entry: str, main: str = "SPY") -> Panel:
    """The first form that fits, in order: a bundle (+), a target (_for_), a place (A_, B_), a ratio (:), a call, a ticker."""
    entry = entry.strip()
    if "+" in entry:
        first, *rest = [x.strip() for x in entry.split("+")]
        head = parsed(first, main)
        base = head.tickers[0] if head.tickers else main
        return Panel("bundle", head.tickers, parts=(head, *(parsed(x, base) for x in rest)))
    place = "main"
    if "_for_(" in entry or re.match(r"^[AB]_", entry):
        if re.match(r"^[AB]_", entry):
            place, entry = ("above" if entry[0] == "A" else "below"), entry[2:]
        call, _, target = entry.partition("_for_(")
        names, _ = _arguments(target.rstrip(")"))
        inner = parsed(call, names[0] if names else main)
        kind = "correlation" if inner.indicator == "CORR" else inner.kind
        return Panel(kind, names or inner.tickers, inner.indicator, inner.numbers, place)
    if ":" in entry and "(" not in entry:
        return Panel("ratio", tuple(x.strip().upper() for x in entry.split(":")))
    if found := CALL.match(entry):
        tickers, numbers = _arguments(found[2])
        name = found[1].upper()
        return Panel("correlation" if name == "CORR" else "indicator", tickers or (main,), name, numbers)
    return Panel("price", (entry.upper(),))


def values(bars: DataFrame, panel: Panel) -> DataFrame:
    """date, series and value of what a panel shows. Unknown indicators are an error."""
    if panel.kind == "bundle":
        return reduce(DataFrame.unionByName, (values(bars, p) for p in panel.parts))
    if panel.kind == "ratio":
        return ratios(bars, [panel.tickers[:2]]).select("date", F.col("pair").alias("series"), F.col("ratio").alias("value"))
    if panel.kind == "correlation":
        a, b = (bars.where(F.col("ticker") == t) for t in panel.tickers[:2])
        out = rolling_correlation(a, b, int(panel.numbers[0]) if panel.numbers else 20)
        return out.select("date", F.lit(f"CORR({','.join(panel.tickers)})").alias("series"), F.col("correlation").alias("value"))
    own = bars.where(F.col("ticker") == panel.tickers[0])
    if panel.kind == "price":
        return own.select("date", F.lit(panel.tickers[0]).alias("series"), F.col("close").alias("value"))
    build, column = BUILDERS[panel.indicator]
    numbers = [int(n) if n == int(n) else n for n in panel.numbers]
    column = column or f"{panel.indicator.lower()}_{numbers[0]}"
    return layered(own, build(*numbers)).select("date", F.lit(f"{panel.indicator}({panel.tickers[0]})").alias("series"), F.col(column).cast("double").alias("value"))
