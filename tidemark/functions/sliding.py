"""Aggregates over the last rows of a ticker and recursive averages, made in Arrow batches.

Spark's windows add each row's frame up anew, a value and an aggregate at a time. Here a batch's frames are
added up beside each other, value by value in the same order and by the same steps, so that the numbers are
the same as a window's. Recursive averages of a batch's tickers go on beside each other, bar by bar, by the
steps of folds; a ticker that goes on in the next batch takes its state with it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .folds import Series
from .windows import TICKER

#: An aggregate, its column of doubles, the rows that it looks at besides the current one, and the column of numbers that a slope is along.
Slide = tuple[str, str, int, str | None]
AGGREGATES, PLACE = ("avg", "count", "stddev_pop", "stddev_samp", "regr_slope"), "row_in_ticker"


class Rows:
    """A batch's rows, their places in their tickers, and columns that begin with values of earlier rows."""

    def __init__(self, place: np.ndarray, values: dict[str, np.ndarray], known: dict[str, np.ndarray]) -> None:
        self.place, self.values, self.known = place, values, known

    def frame(self, before: int, *columns: str) -> Iterator[tuple[np.ndarray, ...]]:
        """Row by row of all frames, the earliest first: where all columns are known there, and their values."""
        for back in range(before, -1, -1):
            at = lambda x: x[len(x) - len(self.place) - back : len(x) - back]  # noqa: B023, E731
            seen = self.place > back
            for c in columns:
                seen = seen & at(self.known[c])
            yield seen, *(at(self.values[c]) for c in columns)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that have rows, and their rows' places in their tickers; each ticker's rows must follow each other in order."""
    last = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        place = batch.column(batch.schema.get_field_index(PLACE)).to_numpy()
        if np.any((place != 1) & (place != np.concatenate([[last], place[:-1]]) + 1)):
            raise ValueError("bars aren't in order of ticker and date")
        last = place[-1]
        yield batch, place


def _added(rows: Rows, column: str, before: int, spread: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, sum and, with spread, squared deviations of each row's frame."""
    number, total, mean, squares = (np.zeros(len(rows.place)) for _ in range(4))
    for seen, value in rows.frame(before, column):
        number += seen
        total += np.where(seen, value, 0.0)
        if spread:
            delta = np.where(seen, value - mean, 0.0)
            share = delta / np.maximum(number, 1.0)
            mean += share
            squares += delta * (delta - share)
    return number, total, squares


def _slope(rows: Rows, column: str, before: int, along: str) -> pa.Array:
    number, mean_x, mean_y, both, squares = (np.zeros(len(rows.place)) for _ in range(5))
    for seen, x, y in rows.frame(before, along, column):
        number += seen
        n = np.maximum(number, 1.0)
        dx = np.where(seen, x - mean_x, 0.0)
        mean_y += np.where(seen, y - mean_y, 0.0) / n
        both += np.where(seen, dx * (y - mean_y), 0.0)
        mean_x += dx / n
        squares += dx * (dx - dx / n)
    return pa.array(both / squares, mask=squares == 0)


def _figure(kind: str, number: np.ndarray, total: np.ndarray, squares: np.ndarray) -> pa.Array:
    if kind == "count":
        return pa.array(number)
    least = 2 if kind == "stddev_samp" else 1
    return pa.array(total / number if kind == "avg" else np.sqrt(squares / (number - (least - 1))), mask=number < least)


def with_place(bars: DataFrame) -> DataFrame:
    """bars with each row's place in its ticker. The window leaves a partition's rows in the order that is needed, each ticker's one after another."""
    return bars.withColumn(PLACE, F.expr(f"row_number() over ({TICKER})"))


def slid(bars: DataFrame, made: dict[str, Slide]) -> DataFrame:
    """bars with a column of doubles for each slide. Aggregates pass over nulls, as windows do."""
    spreads: dict[tuple[str, int], bool] = {}
    for kind, column, before, along in made.values():
        if along is None:
            spreads[column, before] = spreads.get((column, before), False) or kind.startswith("stddev")
    columns = sorted({c for _, column, _, along in made.values() for c in (column, along) if c})
    most = max(before for _, _, before, _ in made.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, known = {c: np.zeros(most) for c in columns}, {c: np.zeros(most, bool) for c in columns}
        for batch, place in _placed(batches):
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            for c in columns:
                values[c] = np.concatenate([values[c][len(values[c]) - most :], column(c).to_numpy(zero_copy_only=False).astype("f8")])
                known[c] = np.concatenate([known[c][len(known[c]) - most :], column(c).is_valid().to_numpy(zero_copy_only=False)])
            rows = Rows(place, values, known)
            with np.errstate(all="ignore"):
                frames = {at: _added(rows, *at, spread) for at, spread in spreads.items()}
                figures = [_slope(rows, c, before, along) if along else _figure(kind, *frames[c, before]) for kind, c, before, along in made.values()]
            own = [name for name in batch.schema.names if name != PLACE]
            yield pa.RecordBatch.from_arrays([*map(column, own), *figures], names=[*own, *made])

    return with_place(bars).mapInArrow(run, StructType([*bars.schema.fields, *(StructField(name, DoubleType()) for name in made)]))


def _followed(values: np.ndarray, known: np.ndarray, place: np.ndarray, weights: np.ndarray, least: np.ndarray, before: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Averages of a batch, where they are known, and the state of its last ticker: totals and numbers of values. A row of `values` is a series."""
    starts = np.flatnonzero(np.concatenate([[True], place[1:] == 1]))
    lengths = np.diff(np.append(starts, len(place)))
    longest = np.argsort(-lengths, kind="stable")  # tickers that still have bars are the first ones, at every step
    starts, lengths = starts[longest], lengths[longest]
    total, number = np.zeros((len(values), len(starts))), np.zeros((len(values), len(starts)))
    if place[0] != 1:
        at = np.flatnonzero(starts == 0)[0]
        total[:, at], number[:, at] = before
    # Rows of one step lie beside each other.
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")
    ends = np.cumsum(active)
    order = np.repeat(np.arange(lengths[0]), active) + starts[np.arange(ends[-1]) - np.repeat(ends - active, active)]
    values, known = values[:, order], known[:, order]
    out, there = np.empty_like(values), np.empty_like(known)
    whole = np.logical_and.reduceat(known.all(axis=0), ends - active)
    plain, weights, least = False, weights[:, None], least[:, None]
    for step, (n, end) in enumerate(zip(active.tolist(), ends.tolist())):
        at = slice(end - n, end)
        value, t, w = values[:, at], total[:, :n], number[:, :n]
        plain = plain and whole[step] or bool(whole[step] and w.min() > 0)
        if plain:
            t += weights * (value - t)
            w += 1.0
            there[:, at] = w >= least
        else:
            seen = known[:, at]
            t[:] = np.where(seen, np.where(w == 0, value, t + weights * (value - t)), t)
            w += seen
            there[:, at] = seen & (w >= least)
        out[:, at] = t
    final = int(np.flatnonzero(starts + lengths == len(place))[0])
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return out[:, back], there[:, back], (total[:, final], number[:, final])


def followed(bars: DataFrame, series: dict[str, Sequence[Series]], kept: Sequence[str], last: tuple[str, int] | None = None) -> DataFrame:
    """with_series(bars, ...) for series of kind ewm, by their column of doubles, with those columns of bars that are kept.

    bars are with_place() and still in its order, and stay so if PLACE is kept and all rows are; with `last` only rows whose
    number in that column is under a limit come back. Rows come back without a partitioning that Spark knows of: a window after this shuffles them.
    """
    dealt = [(s, column) for column, some in series.items() for s in some]
    weights, least = np.array([s.alpha for s, _ in dealt]), np.array([float(s.least) for s, _ in dealt])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = np.zeros(len(dealt)), np.zeros(len(dealt))
        for batch, place in _placed(batches):
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            values = {c: (column(c).to_numpy(zero_copy_only=False).astype("f8"), column(c).is_valid().to_numpy(zero_copy_only=False)) for c in series}
            with np.errstate(all="ignore"):
                out, there, before = _followed(np.stack([values[c][0] for _, c in dealt]), np.stack([values[c][1] for _, c in dealt]), place, weights, least, before)
            made = [pa.array(v, mask=~k) for v, k in zip(out, there)]
            result = pa.RecordBatch.from_arrays([*map(column, kept), *made], names=[*kept, *(s.name for s, _ in dealt)])
            yield result if last is None else result.filter(pa.array(column(last[0]).to_numpy() < last[1]))

    names = [*kept, PLACE, *series, *([last[0]] if last else [])]
    fields = [bars.schema[c] for c in kept] + [StructField(s.name, DoubleType()) for s, _ in dealt]
    return bars.select(*dict.fromkeys(names)).mapInArrow(run, StructType(fields))
