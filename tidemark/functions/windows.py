"""Guarded window expressions over bars, as SQL text for F.expr and DataFrame.selectExpr.

Frames count rows of a ticker in order of date. A window gives a value only if it holds enough values;
a zero divisor gives null.
"""

from __future__ import annotations

TICKER = "partition by ticker order by date"


def rows(before: int | None, after: int = 0, by: str = TICKER) -> str:
    """A frame from `before` rows back (None: the first row) to `after` rows ahead (negative: back)."""
    end = lambda k: "current row" if k == 0 else f"{abs(k)} {'following' if k > 0 else 'preceding'}"
    start = "unbounded preceding" if before is None else end(-before)
    return f"({by} rows between {start} and {end(after)})"


def rolling(agg: str, column: str, n: int, least: int | None = None, by: str = TICKER) -> str:
    """agg of the last n values, null for fewer than least (n unless given) of them."""
    frame = rows(n - 1, by=by)
    return f"case when count({column}) over {frame} >= {n if least is None else least} then {agg}({column}) over {frame} end"


def sma(column: str, n: int, least: int | None = None, by: str = TICKER) -> str:
    return rolling("avg", column, n, least, by)


def deviation(column: str, n: int, least: int | None = None) -> str:
    return rolling("stddev_samp", column, n, least)


def highest(column: str, n: int, least: int | None = None) -> str:
    return rolling("max", column, n, least)


def lowest(column: str, n: int, least: int | None = None) -> str:
    return rolling("min", column, n, least)


def lag(column: str, k: int = 1, by: str = TICKER) -> str:
    return f"lag({column}, {k}) over ({by})"


def change(column: str, k: int = 1, by: str = TICKER) -> str:
    """Relative change over k rows."""
    return f"({column} / nullif({lag(column, k, by)}, 0) - 1)"


def slope(column: str, n: int, least: int | None = None) -> str:
    """Least-squares slope over the last n rows, per row. bar is the row's number within its ticker."""
    frame = rows(n - 1)
    return f"case when count({column}) over {frame} >= {least or n} then regr_slope({column}, bar) over {frame} end"


def crossed_up(a: str, b: str, by: str = TICKER) -> str:
    return f"coalesce({a} > {b} and {lag(a, 1, by)} <= {lag(b, 1, by)}, false)"


def crossed_down(a: str, b: str, by: str = TICKER) -> str:
    return f"coalesce({a} < {b} and {lag(a, 1, by)} >= {lag(b, 1, by)}, false)"


def true_range() -> str:
    """Against the close before; the first bar's is its own range."""
    return f"greatest(high - low, coalesce(abs(high - {lag('close')}), 0), coalesce(abs(low - {lag('close')}), 0))"


def clamp(x: str, low: float, high: float) -> str:
    return f"least(greatest({x}, {low}), {high})"


def rank_share(column: str, ties: str = "average", within: str | None = None) -> str:
    """Rank among the non-null values as a share of their number, ascending; equal values share the average or the least rank."""
    part = ", ".join(x for x in (within, f"{column} is null") if x)
    rank = f"rank() over (partition by {part} order by {column})"
    if ties == "average":
        rank = f"({rank} + (count(*) over (partition by {part}, {column}) - 1) / 2.0)"
    return f"case when {column} is not null then cast({rank} as double) / count(*) over (partition by {part}) end"


def island(condition: str, by: str = TICKER) -> str:
    """A number that stays the same while the condition holds (or while it doesn't): rows since it last failed share it."""
    return f"sum(case when {condition} then 0 else 1 end) over ({by} rows unbounded preceding)"


def weighted_average(column: str, n: int, by: str = TICKER) -> str:
    """Linearly weighted mean of the last n values, the newest weighing n; null with fewer rows or a null among them."""
    terms = " + ".join(f"{column if k == n else lag(column, n - k, by)} * {k}e0" for k in range(1, n + 1))
    return f"({terms}) / {n * (n + 1) // 2}e0"
