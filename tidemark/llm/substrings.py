"""Substring dedup by level-wise doubling.

A window of `min_words` words can repeat only if every shorter window inside it does. So short windows
are tried first: each long window names one short window inside it, the one with the smallest hash, so
that equal long windows name equal short ones, and neighbours mostly name the same one. Long windows
whose short window occurs once alone in the corpus are out; the others are tried at twice the length,
until the length is `min_words` itself and what survives are repeats. (Longer repeats are unions of
these windows, so no candidate is left to extend for removal.)

The rows that are shuffled are the named windows, about two in every (min_words - length + 2) words at
the first level and only survivors after it. Groups of up to `few` rows with an equal short window are
told apart in order within a sorted partition; larger ones by aggregation and a join on the long
windows, which neither gather a group in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written
from .words import WordHashes, split, window_hashes

LAST = 2**63 - 1


def _named(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every `width` neighbours the leftmost smallest: where it is, and the first window that names it."""
    at = np.lib.stride_tricks.sliding_window_view(hashes, width).argmin(axis=1) + np.arange(len(hashes) - width + 1)
    first = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1))
    return at[first], first


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts) if parts else [], kind))


def _short_windows(length: int, min_words: int):
    """(key, text[, alive]) -> (short, key, at): the short windows that long windows name, each once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            keys, shorts, ats = [], [], []
            alive = batch.column("alive").to_pylist() if "alive" in batch.schema.names else None
            for i, (key, text) in enumerate(zip(batch.column("key").to_pylist(), batch.column("text"))):
                words = split(text.as_py())
                if len(words) < min_words:
                    continue
                x = hashes.of(words)
                short = window_hashes(x, length)
                at, first = _named(short, min_words - length + 1)
                if alive is not None:
                    at = at[_living(x, alive[i], length // 2, min_words, first)]
                keys.append(np.full(len(at), key))
                shorts.append(short[at].view(np.int64))
                ats.append(at.astype(np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (shorts, keys, ats)], ["short", "key", "at"])

    return run


def _living(x: np.ndarray, alive: list[int], length: int, min_words: int, first: np.ndarray) -> np.ndarray:
    """Which runs of long windows, from `first` each, hold one that survived at the level before."""
    windows = np.zeros(len(x) - min_words + 1, np.int64)
    at, before = _named(window_hashes(x, length), min_words - length + 1)
    ends = np.append(before[1:], len(windows))
    for i in np.flatnonzero(np.isin(at, np.asarray(alive) >> 1)):
        windows[before[i] : ends[i]] = 1
    return np.add.reduceat(windows, first) > 0


def _long_windows(length: int, min_words: int):
    """(key, tie, text, alive) -> (short, common, key, tie, start, longs): the long windows that name each surviving short one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            shorts, common, keys, ties, starts, longs = [], [], [], [], [], []
            for key, tie, text, alive in zip(*(batch.column(c) for c in ("key", "tie", "text", "alive"))):
                x = hashes.of(split(text.as_py()))
                if len(x) < min_words:  # another row with this doc_id has the windows
                    continue
                short = window_hashes(x, length)
                at, first = _named(short, min_words - length + 1)
                whole = window_hashes(x, min_words).view(np.int64)
                ends = np.append(first[1:], len(whole))
                marks = np.asarray(alive.as_py())
                order = np.argsort(marks)
                found = np.searchsorted(marks[order] >> 1, at)
                found[found == len(marks)] = 0
                here = np.flatnonzero(marks[order][found] >> 1 == at)
                shorts.append(short[at[here]].view(np.int64))
                common.append((marks[order][found[here]] & 1).astype(bool))
                keys.append(np.full(len(here), key.as_py()))
                ties.append(np.full(len(here), tie.as_py()))
                starts.append(first[here].astype(np.int32))
                longs += [whole[first[i] : ends[i]] for i in here]
            if shorts:
                flat = [pa.array(np.concatenate(c)) for c in (shorts, common, keys, ties, starts)]
                yield pa.RecordBatch.from_arrays([*flat, _lists(longs, pa.int64())], ["short", "common", "key", "tie", "start", "longs"])

    return run


def _later_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (short, key, tie, start) -> (key, tie, starts) of long windows seen before."""
    short, seen, last = None, set(), None
    for batch in batches:
        keys, ties, starts = [], [], []
        longs = batch.column("longs")
        flat, offsets = longs.flatten().to_numpy(), longs.offsets.to_numpy() - longs.offsets[0].as_py()
        columns = [batch.column(c).to_numpy() for c in ("short", "key", "tie", "start")]
        for i, (s, *place) in enumerate(zip(*(c.tolist() for c in columns))):
            if s != short:
                short, seen, last = s, set(), None
            elif place == last:  # the same document in another row
                continue
            last = place
            mine = flat[offsets[i] : offsets[i + 1]].tolist()
            before = [j for j, h in enumerate(mine) if h in seen or h in mine[:j]]
            seen.update(mine)
            if before:
                keys.append(place[0])
                ties.append(place[1])
                starts.append(np.asarray(before, np.int32) + np.int32(place[2]))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ties, pa.int64()), _lists(starts, pa.int32())], ["key", "tie", "starts"])


def _without(min_words: int):
    """(doc_id, text, starts) -> (doc_id, n_words, n_removed, kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, kept = [], [], []
            for text, starts in zip(batch.column("text"), batch.column("starts")):
                words = split(text.as_py())
                n.append(len(words))
                if starts.as_py():
                    edges = np.zeros(len(words) + 1, np.int32)
                    at = np.unique(starts.values.to_numpy())
                    edges[at] += 1
                    edges[at + min_words] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]
                removed.append(n[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def without_repeats(docs: DataFrame, min_words: int = 20, first_length: int = 10, few: int = 20_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept (the kept words, joined by one space) of every row of docs.

    A word goes if a window of min_words words over it also starts earlier: in a document with a
    smaller doc_id, or earlier in the same one. Windows are judged on the input. min_words is
    first_length times a power of two. A null text has no words and keeps an empty string; a null
    doc_id comes after all others; different texts with one doc_id stand in the order of a hash; rows
    equal in doc_id and text are one document and fare alike. Other columns are not read.
    """
    lengths = [first_length]
    while lengths[-1] < min_words:
        lengths.append(2 * lengths[-1])
    if lengths.pop() != min_words or not lengths:
        raise ValueError("min_words must be first_length times a power of two, at least two")
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    docs = docs.withColumns({"key": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "tie": F.xxhash64("text")})
    alive = None
    for length in lengths:
        source = docs.select("key", "text") if alive is None else docs.join(alive, "key").select("key", "text", "alive")
        named = written(source.mapInArrow(_short_windows(length, min_words), "short long, key long, at int"), "repeats-short")
        # As a table of its own, so that Spark can split the join where one short window is very common.
        counts = written(named.groupBy("short").agg(F.count("*").alias("n")).where("n > 1"), "repeats-counts")
        spent = [named, counts, *([alive] if alive is not None else [])]
        mark = F.col("at").cast("long") * 2 + (F.col("n") > few).cast("long")
        alive = written(named.join(counts, "short").groupBy("key").agg(F.collect_list(mark).alias("alive")), "repeats-alive")
        dropped(*spent)
    rows = docs.select("key", "tie", "text").join(alive, "key").mapInArrow(_long_windows(lengths[-1], min_words), "short long, common boolean, key long, tie long, start int, longs array<long>")
    rows = written(rows, "repeats-long")
    dropped(alive)
    rare = rows.where("not common").repartition("short").sortWithinPartitions("short", "key", "tie", "start")
    later = rare.mapInArrow(_later_ones, "key long, tie long, starts array<int>")
    often = rows.where("common").select("short", "key", "tie", "start", F.posexplode("longs").alias("i", "long"))
    often = often.select("short", "long", F.struct("key", "tie", (F.col("start") + F.col("i")).alias("start")).alias("place"))
    firsts = often.groupBy("short", "long").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = often.join(firsts, ["short", "long"]).where("place > first").select("place.key", "place.tie", F.array("place.start").alias("starts"))
    gone = later.unionByName(again).groupBy("key", "tie").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    return docs.join(written(gone, "repeats-gone"), ["key", "tie"], "left").select("doc_id", "text", "starts").mapInArrow(_without(min_words), "doc_id long, n_words long, n_removed long, kept string")
