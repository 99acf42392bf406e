"""Sharding by minimax contiguous partition.

Documents with equal texts form one atomic group. The groups stand in the order of their text's
digest, and every group ends at a point on one long line of bytes. The best partition into
contiguous shards is found by binary search of the smallest capacity for which greedy filling needs
no more than the shards there are, and the line is cut there.

The line itself stays in Spark. The driver holds a bounded set of known points of it. Greedy filling
over the known points alone gives a capacity that surely suffices; greedy filling that assumes a point
wherever one may be gives a capacity below which none does. While the two differ, the stretches of
line that could hold a cut are looked at again with finer bins, by one aggregation a round.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import dropped, written

#: Digest prefixes by which the line is summed up (16 ** 3), bins of a round, salts of a group.
PREFIX, BINS, SALTS = 3, 2048, 64


class Line:
    """Known points of the line, and for each gap between neighbours whether it may hold others."""

    def __init__(self, total: int) -> None:
        self.points, self.open = [0, total], [True]

    def learn(self, regions: list[tuple[int, int]], bins: list[tuple[int, int, int]]) -> None:
        """bins: first point, last point and number of points of each bin of the regions that has any."""
        old, was_open = self.points, self.open
        self.points = sorted({*old, *(p for first, last, _ in bins for p in (first, last))})
        upto = lambda p: bisect_right(self.points, p)
        unknown = sorted((first, last) for first, last, n in bins if n > upto(last) - upto(first - 1))
        self.open = []
        for p, q in zip(self.points, self.points[1:]):
            still = was_open[bisect_right(old, p) - 1]
            if still and any(a <= p and q <= b for a, b in regions):
                i = bisect_right(unknown, (p, self.points[-1])) - 1
                still = i >= 0 and q <= unknown[i][1]
            self.open.append(still)

    def sure(self, capacity: int, shards: int) -> list[int]:
        """Ends of greedily filled shards, at known points alone."""
        ends, at = [], 0
        for _ in range(shards):
            at = self.points[bisect_right(self.points, at + capacity) - 1]
            ends.append(at)
        return ends

    def hoped(self, capacity: int, shards: int) -> list[int]:
        """Ends of greedily filled shards if there is a point wherever one may be."""
        ends, at = [], 0
        for _ in range(shards):
            x = at + capacity
            i = bisect_right(self.points, x) - 1
            if i + 1 >= len(self.points):
                at = self.points[-1]
            else:
                at = x if self.open[i] else self.points[i]
            ends.append(at)
        return ends


def _least(ok, low: int, high: int) -> int:
    """The smallest of low..high for which ok holds; it holds for high."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if ok(mid) else (mid + 1, high)
    return low


def smallest_capacity(ends: DataFrame, end: str, total: int, largest: int, shards: int) -> tuple[int, list[int]]:
    """The least capacity of the fullest shard, and where shards end; ends: a row for each group with its end on the line."""
    if total == 0:
        return 0, [0] * shards
    line = Line(total)
    low = max(largest, -(-total // shards))
    high = -(-total // shards) + largest
    regions = [(0, total)]
    while True:
        pick, width = F.lit(None).cast("int"), F.lit(None).cast("long")
        start = F.lit(None).cast("long")
        for i, (a, b) in enumerate(regions):
            here = (F.col(end) > a) & (F.col(end) <= b)
            pick, start = F.when(here, i).otherwise(pick), F.when(here, a).otherwise(start)
            width = F.when(here, max(1, -(-(b - a) // (BINS // len(regions))))).otherwise(width)
        bins = (
            ends.select(F.col(end).alias("e"), pick.alias("i"), start.alias("a"), width.alias("w"))
            .where("i is not null")
            .groupBy("i", F.expr("(e - a - 1) div w").alias("bin"))
            .agg(F.min("e").alias("first"), F.max("e").alias("last"), F.count("*").alias("n"))
            .collect()  # at most BINS rows
        )
        line.learn(regions, [(r["first"], r["last"], r["n"]) for r in bins])
        sure = _least(lambda c: line.sure(c, shards)[-1] == total, low, max(high, total))
        hope = _least(lambda c: line.hoped(c, shards)[-1] == total, low, sure)
        if sure == hope:
            return sure, line.sure(sure, shards)
        low, high = hope, sure
        regions = []
        for a, b in zip(line.sure(hope, shards), line.hoped(sure, shards)):
            i, j = bisect_right(line.points, a) - 1, bisect_left(line.points, b)
            a, b = line.points[i], line.points[min(j, len(line.points) - 1)]
            if a < b and (not regions or b > regions[-1][1]):
                regions.append((max(a, regions[-1][1]) if regions else a, b))


def shard(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, text_digest, shard, slot.

    size is the UTF-8 bytes of the text plus 1. Rows with equal texts share a shard; a null text
    counts as an empty one and shares its group. slot numbers a shard's rows from 0 without gaps,
    groups in the order of their digest, a group's rows by salt and then doc_id (nulls first; equal
    rows in any order, which can't be told apart). With fewer groups than shards the last shards stay
    empty; an empty table gives an empty result. Other columns of docs are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = written(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.sha2(body, 256).alias("text_digest"),
            F.pmod(F.xxhash64(F.col(doc_id)), F.lit(SALTS)).cast("int").alias("salt"),
        ),
        "shard-rows",
    )
    cells = rows.groupBy("text_digest", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    groups = cells.groupBy("text_digest").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    groups = groups.withColumn("prefix", F.substring("text_digest", 1, PREFIX))
    before = W.orderBy("prefix").rowsBetween(W.unboundedPreceding, -1)
    offsets = groups.groupBy("prefix").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    offsets = offsets.select("prefix", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "bytes")))
    upto = W.partitionBy("prefix").orderBy("text_digest").rowsBetween(W.unboundedPreceding, 0)
    ends = written(
        groups.withColumns({"n_upto": F.sum("n").over(upto), "bytes_upto": F.sum("bytes").over(upto)})
        .join(offsets, "prefix")
        .select("text_digest", "n", "bytes", (F.col("n_upto") + F.col("n_before") - F.col("n")).alias("first_row"), (F.col("bytes_upto") + F.col("bytes_before")).alias("end")),
        "shard-groups",
    )
    whole = ends.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total"), F.coalesce(F.max("bytes"), F.lit(0)).alias("largest")).first()
    _, cuts = smallest_capacity(ends, "end", whole["total"], whole["largest"], shards)
    number: Column = F.lit(0)
    for cut in cuts[:-1]:
        number = number + F.when(F.col("end") > cut, 1).otherwise(0)
    ends = ends.withColumn("shard", number.cast("int"))
    starts = ends.groupBy("shard").agg(F.min("first_row").alias("shard_start"))  # a row for each shard
    in_group = W.partitionBy("text_digest").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    placed = (
        cells.withColumn("cell_start", F.coalesce(F.sum("n").over(in_group), F.lit(0)))
        .join(ends.join(F.broadcast(starts), "shard").select("text_digest", "shard", (F.col("first_row") - F.col("shard_start")).alias("group_start")), "text_digest")
        .select("text_digest", "salt", "shard", (F.col("group_start") + F.col("cell_start")).alias("start"))
    )
    in_cell = W.partitionBy("text_digest", "salt").orderBy("doc_id")
    return (
        rows.withColumn("rank", F.row_number().over(in_cell) - 1)
        .join(placed, ["text_digest", "salt"])
        .select("doc_id", "size", "text_crc32", "text_digest", "shard", (F.col("start") + F.col("rank")).cast("long").alias("slot"))
    )
