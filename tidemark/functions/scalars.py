"""Scalar helpers as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bars of a duration's unit, by timeframe.
UNITS = {"daily": {"w": 5, "m": 21, "y": 252}, "weekly": {"w": 1, "m": 4, "y": 52}, "monthly": {"w": 1, "m": 1, "y": 12}}


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(default))


def normalised(x: Column, low: float, high: float, reverse: bool = False) -> Column:
    """0 to 100 between two bounds."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (x - low) / (high - low) * 100)) if high != low else F.lit(50.0)
    return 100 - share if reverse else share


def percentage_change(now: Column, before: Column) -> Column:
    return F.coalesce(F.try_divide(now - before, F.abs(before)) * 100, F.lit(0.0))


def score_category(score: Column) -> Column:
    return F.when(score >= 80, "Excellent").when(score >= 60, "Good").when(score >= 40, "Fair").when(score >= 20, "Poor").otherwise("Very Poor")


def weighted_score(scores: dict[str, float]) -> Column:
    """Weighted mean of columns; weights needn't add up to 1."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in scores.items()), F.lit(0.0))
    return total / sum(scores.values())


def trend_of(values: Column) -> Column:
    """increasing, decreasing or mixed, of an array in order."""
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.size(values) - 1, F.lit(1))), lambda i: F.element_at(values, i + 1) - F.element_at(values, i))
    up, down = F.forall(steps, lambda x: x > 0), F.forall(steps, lambda x: x < 0)
    return F.when(F.size(values) < 2, "mixed").when(up, "increasing").when(down, "decreasing").otherwise("mixed")


def date_in_name(name: Column) -> Column:
    """The last YYYYMMDD in a file name."""
    return F.to_date(F.try_to_timestamp(F.regexp_extract(name, r"(\d{8})(?!.*\d{8})", 1), F.lit("yyyyMMdd")))


def sheet_date(text: Column) -> Column:
    """The date of a script's date text such as "Mon Jan 06 2025 16:00:00 GMT-0500"."""
    return F.to_date(F.try_to_timestamp(F.regexp_extract(text, r"([A-Z][a-z]{2} [0-9]{1,2} [0-9]{4})", 1), F.lit("MMM d yyyy")))


def bars_of_duration(text: str, timeframe: str = "daily", total: int | None = None) -> int:
    """Bars of 2w, 3m, 1y or complete."""
    if text == "complete":
        return total or 0
    found = re.fullmatch(r"(\d+)([wmy])", text.strip().lower())
    if not found:
        raise ValueError(f"no duration: {text}")
    return max(1, int(found[1]) * UNITS[timeframe][found[2]])


def periods(text: str) -> list[int]:
    """1;3;5 as numbers."""
    return [int(x) for x in text.split(";") if x.strip().isdigit()]
