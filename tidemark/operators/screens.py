"""What a screener is made of, and how it runs.

A screener adds columns to bars in layers of window expressions, with recursive series between them, and
keeps the rows that meet its condition: the last of each ticker or all. Thresholds are parameters of the
functions that make screeners; the columns that a screener returns are always computed, so that a near
miss can be looked at by relaxing the condition.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.folds import Series, Smoothed, with_series
from ..functions.sliding import AGGREGATES, PLACE, Slide, followed, slid, with_place
from ..functions.windows import TICKER
from ..sources.bars import latest

NUMBER = {"bar": f"row_number() over ({TICKER})"}


@dataclass(frozen=True)
class Recursive:
    """A recursive series over a column: ewm, ewm_adjusted or wilder over n bars, or an ewm of a given weight."""

    name: str
    column: str
    n: int = 0
    kind: str = "ewm"
    weight: float | None = None
    least: int = 1

    def series(self) -> Series:
        value = lambda bar, _: bar[self.column]
        if self.weight is not None:
            return Smoothed(self.name, self.kind, self.n, value, self.least, weight=self.weight)
        return Series(self.name, self.kind, self.n, value, self.least)


Layer = dict[str, str] | tuple[Recursive, ...]


@dataclass(frozen=True)
class Screen:
    name: str
    layers: tuple[Layer, ...]
    keep: str
    columns: tuple[str, ...]
    last_only: bool = True
    order: str = "score"
    labels: tuple[str, ...] = field(default=())
    #: Columns without the last digits of their sums, so that means of equal values are equal over any number of rows.
    settled: tuple[str, ...] = ()

    def every(self) -> Screen:
        """On all dates, not only on each ticker's last."""
        return replace(self, last_only=False)

    def relaxed(self, keep: str = "true") -> Screen:
        return replace(self, keep=keep)


WHOLE = " over ()"


def layered(bars: DataFrame, layers: tuple[Layer, ...]) -> DataFrame:
    for layer in layers:
        if isinstance(layer, dict):
            # A figure of all bars is one row that goes to all tasks; as a window it would bring all bars to one.
            if whole := {name: text for name, text in layer.items() if text.endswith(WHOLE)}:
                bars = bars.crossJoin(F.broadcast(bars.agg(*(F.expr(text.removesuffix(WHOLE)).alias(name) for name, text in whole.items()))))
                layer = {name: text for name, text in layer.items() if name not in whole}
            bars = bars.withColumns({name: F.expr(text) for name, text in layer.items()})
        else:
            bars = with_series(bars, [r.series() for r in layer])
    return bars


#: How far a row is before its ticker's last, and a frame of all rows of a ticker in order.
BACK, ALL = "rows_back", f"over ({TICKER} rows between unbounded preceding and unbounded following)"
ARGUMENT = r"(?:[^(),]|\([^()]*\))+"
LAG = re.compile(rf"\blag\({ARGUMENT}, (\d+)\) over \({TICKER}\)")
FRAME = re.compile(rf"\bover \({TICKER} rows between (\d+) preceding and (?:current row|\d+ preceding)\)")
#: Aggregates that pass over nulls, in a frame of so many rows.
ADDED = re.compile(rf"\b(avg|sum|min|max|count|stddev_samp|stddev_pop|regr_slope|collect_list)\(({ARGUMENT})((?:, \w+)?)\) over \({TICKER} rows between (\d+) preceding and (?:current row|(\d+) preceding)\)")


def depth(text: str) -> float:
    """How many rows before its own an expression looks at; infinite where that isn't known."""
    known = [int(n) for kind in (LAG, FRAME) for n in kind.findall(text)]
    return max(known, default=0) if len(known) == len(re.findall(r"\bover\b", text)) else float("inf")


def at_last(text: str) -> str:
    """An expression on each ticker's last row alone: what a frame there holds is added up in the same order, but once a ticker and not once a row."""
    kept = lambda m: f"{m[1]}(case when {BACK} between {m[5] or 0} and {m[4]} then {'1' if m[2] == '*' else m[2]} end{m[3]}) {ALL}"
    return ADDED.sub(kept, text)


def with_back(rows: DataFrame) -> DataFrame:
    return rows.withColumn(BACK, F.expr(f"count(1) {ALL} - row_number() over ({TICKER})"))


def _parted(layers: Sequence[Layer]) -> list[Layer]:
    """layers, what looks at all rows before what looks at some."""
    out: list[Layer] = []
    for layer in layers:
        if isinstance(layer, dict):
            far = {name: text for name, text in layer.items() if depth(text) == float("inf")}
            near = {name: text for name, text in layer.items() if name not in far}
            if far and near and not any(re.search(rf"\b{name}\b", text) for name in far for text in near.values()):
                out += [far, near]
                continue
        out.append(layer)
    return out


def _followable(parts: Sequence[Layer], reads: Sequence[float]) -> bool:
    """Whether series can be made in batches: none but ewm, no window between them, and few rows are looked at after them."""
    folds = [i for i, part in enumerate(parts) if not isinstance(part, dict)]
    between = [text for part in parts[folds[0] : folds[-1]] if isinstance(part, dict) for text in part.values()] if folds else []
    return bool(folds) and all(r.kind == "ewm" for i in folds for r in parts[i]) and reads[folds[-1] + 1] < float("inf") and not any(re.search(r"\bover\b", text) for text in between)


def last_layered(bars: DataFrame, layers: Sequence[Layer], wanted: Sequence[str] | None = None) -> DataFrame:
    """latest(layered(bars, layers)), but windows of a known length see no more of the last rows than the last one's values come from.

    With the columns that are wanted, series are made in batches where that pays, and rows carry only what is read later.
    """
    parts = _parted(layers)
    needs: list[dict[str, float]] = [{} for _ in parts]  # how many of the last rows of each column are looked at
    reads = [0.0] * (len(parts) + 1)  # and of all rows, by this part and those after it
    reads[-1] = 1
    for i in reversed(range(len(parts))):
        part = parts[i]
        if not isinstance(part, dict):
            reads[i] = float("inf")
            continue
        for name in part:
            users = [n + depth(parts[j][other]) for j in range(i + 1, len(parts)) if isinstance(parts[j], dict) for other, n in needs[j].items() if re.search(rf"\b{name}\b", parts[j][other])]
            folds = [float("inf") for later in parts[i + 1 :] if not isinstance(later, dict) for r in later if r.column == name]
            needs[i][name] = max([1, *users, *folds])
        reads[i] = max([reads[i + 1], *(n + depth(part[name]) for name, n in needs[i].items())])
    seen, batches = float("inf"), wanted is not None and _followable(parts, reads)
    for i, (part, need, read) in enumerate(zip(parts, needs, reads)):
        if isinstance(part, dict) and any(FRAME.search(text) for text in part.values()):
            if BACK not in bars.columns:
                bars = with_back(bars)
            part = {name: at_last(text) if need[name] == 1 else text for name, text in part.items()}
        if read < seen and BACK in bars.columns:
            bars, seen = bars.where(F.col(BACK) < int(read)), read
        if batches and not isinstance(part, dict):
            if PLACE not in bars.columns:
                bars = with_place(bars if BACK in bars.columns else with_back(bars))
            later = " ".join([*wanted, *(x for other in parts[i + 1 :] for x in (other.values() if isinstance(other, dict) else (r.column for r in other)))])
            ended = reads[i + 1] < float("inf")  # the last of the series: rows are few from here on
            kept = [c for c in bars.columns if c in ("ticker", "date", BACK) or c == PLACE and not ended or _names(later, [c])]
            bars = followed(bars, {c: [r.series() for r in part if r.column == c] for c in dict.fromkeys(r.column for r in part)}, kept, (BACK, int(reads[i + 1])) if ended else None)
            seen = reads[i + 1]
            continue
        bars = layered(bars, (part,))
    return latest(bars.where(F.col(BACK) == 0) if BACK in bars.columns else bars).drop(BACK, PLACE)


#: Frames of a column that can be slid in batches, and from how many rows in all that is worth the way to Python and back.
SLIDES, LONG = re.compile(rf"\b({'|'.join(AGGREGATES)})\((\w+)(?:, (\w+))?\) over \({TICKER} rows between (\d+) preceding and current row\)"), 200


def every_layered(bars: DataFrame, layers: Sequence[Layer]) -> DataFrame:
    """layered(bars, layers), but where the last layer with windows has long frames, they are slid in batches."""
    at = max((i for i, layer in enumerate(layers) if not isinstance(layer, dict) or any(re.search(r"\bover\b", text) for text in layer.values())), default=None)
    if at is None or not isinstance(layers[at], dict) or sum(int(n) + 1 for _, n in {(m[0], m[4]) for text in layers[at].values() for m in SLIDES.finditer(text)}) < LONG:
        return layered(bars, layers)
    rows, layer, slides = layered(bars, layers[:at]), layers[at], {}
    kinds = dict(rows.dtypes)
    for m in (m for text in layer.values() for m in SLIDES.finditer(text)):
        if kinds.get(m[2]) == "double" and (kinds.get(m[3]) in ("int", "double")) == (m[1] == "regr_slope"):
            slides.setdefault(m[0], f"slid_{len(slides)}")
    put = {name: SLIDES.sub(lambda m: slides.get(m[0], m[0]), text) for name, text in layer.items()}
    # What needs a window besides is made first, as it is written.
    windows = {name: layer[name] for name, text in put.items() if re.search(r"\bover\b", text)}
    rest = {name: text for name, text in put.items() if name not in windows}
    made: dict[str, Slide] = {}
    for text, name in slides.items():
        if any(re.search(rf"\b{name}\b", other) for other in rest.values()):
            kind, column, along, before = SLIDES.fullmatch(text).groups()
            made[name] = kind, column, int(before), along
    if not made or any(name in rows.columns or re.search(rf"\b{name}\b", text) for name in windows for text in layer.values()):
        return layered(bars, layers)
    rows = layered(slid(layered(rows, (windows,)), made), (rest,))
    return layered(rows.drop(*made), layers[at + 1 :])


def _names(text: str, among: Iterable[str]) -> set[str]:
    return set(re.findall(r"\w+", text)) & set(among)


def merged(blocks: Sequence[Sequence[Layer]], wanted: Sequence[str]) -> list[Layer] | None:
    """Layers that make `wanted` with all that blocks make of the same bars, each column once; None where blocks give a name to different things.

    What recursive series and frames of all rows come from is made first, series of all blocks beside each other, and the rest last.
    """
    made: dict[str, str | Recursive] = {}
    for layers in blocks:
        for name, step in ((k, v) for layer in layers for k, v in (layer.items() if isinstance(layer, dict) else ((r.name, r) for r in layer))):
            if made.setdefault(name, step) != step:
                return None
    reads = {name: _names(step.column if isinstance(step, Recursive) else step, made) - {name} for name, step in made.items()}

    def sources(names: Iterable[str]) -> set[str]:
        found, new = set(), set(names)
        while new:
            found |= new
            new = {x for name in new for x in reads[name]} - found
        return found

    used = sources(_names(" ".join(wanted), made))
    early = sources(name for name in used if isinstance(made[name], Recursive) or depth(made[name]) == float("inf"))
    out: list[Layer] = []
    for part in (early, used - early):
        left = [name for name in made if name in part]
        while left:
            done = {name for name in made if name in used and name not in left and (name in early or part is not early)}
            ready = [name for name in left if reads[name] <= done]
            if not ready:
                return None  # a name that is made anew from itself
            now = [name for name in ready if not isinstance(made[name], Recursive)] or ready
            out.append({name: made[name] for name in now} if isinstance(made[now[0]], str) else tuple(made[name] for name in now))
            left = [name for name in left if name not in now]
    return out


def side_by_side(bars: DataFrame, blocks: Sequence[tuple[Sequence[Layer], Sequence[str]]]) -> DataFrame:
    """ticker, date and columns of each block's layers on the last row of each ticker, all made on the same rows; of equal names the first block's counts.

    Blocks that give a name to different things, or to a column of bars, are made one after another, the others as one.
    """
    parts, names = [], []
    for layers, columns in blocks:
        new = [c for c in columns if c not in names]
        names += new
        parts.append((layers, new))
    rows, kept, together = bars.where("ticker is not null"), [], []
    for layers, new in parts:
        own = {name for layer in layers for name in (layer if isinstance(layer, dict) else (r.name for r in layer))}
        if not own & set(bars.columns) and merged([*(some for some, _ in together), layers], [*own]) is not None:
            together += [(layers, new)]
            continue
        lost = own & set(bars.columns)  # what a block makes of a column of bars is its own
        rows = layered(rows.select("*", *(F.col(c).alias(f"bars_{c}") for c in lost)), layers)
        rows = rows.select(*(F.col(f"bars_{c}" if c in lost else c).alias(c) for c in bars.columns), *kept, *(F.col(c).alias(f"kept_{c}") for c in new))
        kept += [f"kept_{c}" for c in new]
    own = [c for _, new in together for c in new]
    rows = last_layered(rows, merged([layers for layers, _ in together], own), [*own, *kept])
    return rows.select("ticker", "date", *(F.col(c if c in own else f"kept_{c}").alias(c) for c in names))


def screened(bars: DataFrame, screen: Screen) -> DataFrame:
    """ticker, date and the screen's columns and labels, for rows that meet its condition (null counts as not met)."""
    layers = [{name: f"round({text}, 9)" if name in screen.settled else text for name, text in layer.items()} if isinstance(layer, dict) else layer for layer in screen.layers]
    if screen.last_only:
        rows = last_layered(bars, layers)
    else:
        # A fold carries whole bars: it gets the columns that the screen names.
        named = " ".join([screen.keep, *screen.columns, *screen.labels, *(x for layer in layers for x in (layer.values() if isinstance(layer, dict) else (r.column for r in layer)))])
        rows = every_layered(bars.select(*(c for c in bars.columns if c in ("ticker", "date") or re.search(rf"\b{c}\b", named))), layers)
    return rows.where(F.coalesce(F.expr(screen.keep), F.lit(False))).select("ticker", "date", *screen.columns, *screen.labels)


def ranked(signals: DataFrame, by: str, n: int | None = None) -> DataFrame:
    """By a column, highest first, then ticker; the first n if given."""
    out = signals.orderBy(F.col(by).desc_nulls_last(), "ticker")
    return out.limit(n) if n else out


def united(*signals: DataFrame) -> DataFrame:
    """Rows of several screeners under each other; columns that one lacks are null."""
    first, *rest = signals
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
