"""Ranks over a whole table, or over groups of any size, without a task that holds one.

Values are counted first, so that ties, however many, are one row. Quantiles cut the values into ranges; a
range's counts are summed in order, and a prefix of the ranges' totals (a few numbers a group) is added. Equal values
are always in one range, so ties never cross an edge.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Ranges of values.
RANGES = 128


def _ranges(values: DataFrame, ranges: int) -> Column:
    """The number of a value's range, from quantiles of the values."""
    cuts = values.agg(F.percentile_approx("rank_value", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] or []
    cuts = sorted({float(c) for c in cuts})
    # A cut's place among few others is found by halves, as an expression that stays in generated code.
    def place(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col("rank_value") <= cuts[middle], place(low, middle)).otherwise(place(middle + 1, high))

    return place(0, len(cuts))


@dataclass(frozen=True)
class Rank:
    """name: of the rank's column. by: columns of the groups, none for the whole table. ties: equal values share their mean rank (average), the least, the greatest (most), or count as one (dense)."""

    name: str
    column: str
    by: Sequence[str] = ()
    ties: str = "average"


def _value(column: str) -> Column:
    value = F.col(column).cast("double")
    return F.when(value == 0, F.lit(0.0)).otherwise(value)  # -0.0 is 0.0


def _ranks(table: DataFrame, rank: Rank, ranges: int) -> DataFrame:
    """rank_key_{i} of the group, rank_value, rank_made and rank_of, a row for each value of a group."""
    keys = [f"rank_key_{i}" for i in range(len(rank.by))]
    plain = table.where(F.col(rank.column).isNotNull()).select(*(F.col(c).alias(k) for c, k in zip(rank.by, keys)), _value(rank.column).alias("rank_value"))
    counts = plain.groupBy(*keys, "rank_value").agg(F.count("*").alias("rank_n"))
    placed = counts.withColumn("rank_range", _ranges(plain, ranges))
    totals = placed.groupBy(*keys, "rank_range").agg(F.sum("rank_n").alias("n"), F.count("*").alias("distinct"))
    listed = totals.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank_range", "n", "distinct"))).alias("parts"))  # up to `ranges` a group
    earlier = lambda field: F.aggregate(F.filter("parts", lambda p: p["rank_range"] < F.col("part.rank_range")), F.lit(0).cast("long"), lambda a, p: a + p[field])
    before = listed.withColumn("part", F.explode("parts")).select(
        *(F.col(k).alias(f"{k}_own") for k in keys), F.col("part.rank_range").alias("range_own"), earlier("n").alias("before"), earlier("distinct").alias("before_distinct"),
        F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["n"]).alias("rank_of"),
    )
    within = W.partitionBy(*keys, "rank_range").orderBy("rank_value")
    summed = placed.withColumns({"here": F.sum("rank_n").over(within.rowsBetween(W.unboundedPreceding, W.currentRow)), "here_distinct": F.row_number().over(within)})
    joined = summed.join(before, [F.col("rank_range") == F.col("range_own"), *(F.col(k).eqNullSafe(F.col(f"{k}_own")) for k in keys)], "left")
    upto = F.col("before") + F.col("here")
    made = {
        "average": upto - (F.col("rank_n") - 1) / 2.0, "least": upto - F.col("rank_n") + 1, "most": upto, "dense": F.col("before_distinct") + F.col("here_distinct"),
    }[rank.ties]
    return joined.select(*keys, "rank_value", made.cast("double").alias("rank_made"), "rank_of")


def with_ranks(table: DataFrame, wanted: Sequence[Rank], ranges: int = RANGES) -> DataFrame:
    """table with {name} and {name}_of for each Rank: the rank of a value among the non-null ones of its group in rising order, and their number.

    NaN comes after all numbers. A null value has neither. The group's columns may be null, which is a group too. table is read twice
    for each rank and once more, so it should be a stored one or cheap to make.
    """
    rows = table.select(F.struct("*").alias("rank_row"))
    names = []
    for n, rank in enumerate(wanted):
        found = _ranks(table, rank, ranges)
        found = found.select(*(F.col(c).alias(f"{c}_{n}") for c in found.columns))
        own = {f"rank_own_{n}": _value(f"rank_row.{rank.column}"), **{f"rank_by_{n}_{i}": F.col("rank_row")[c] for i, c in enumerate(rank.by)}}
        match = [F.col(f"rank_own_{n}") == F.col(f"rank_value_{n}"), *(F.col(f"rank_by_{n}_{i}").eqNullSafe(F.col(f"rank_key_{i}_{n}")) for i in range(len(rank.by)))]
        rows = rows.withColumns(own).join(found, match, "left").select("rank_row", *names, F.col(f"rank_made_{n}").alias(rank.name), F.col(f"rank_of_{n}").alias(f"{rank.name}_of"))
        names += [rank.name, f"{rank.name}_of"]
    return rows.select(*(F.col("rank_row")[c].alias(c) for c in table.columns), *names)


def ranked(table: DataFrame, column: str, by: Sequence[str] = (), ties: str = "average", name: str = "rank", ranges: int = RANGES) -> DataFrame:
    """table with one rank, see with_ranks."""
    return with_ranks(table, [Rank(name, column, by, ties)], ranges)


def scaled(rank: Column, of: Column, scale: str = "ibd") -> Column:
    """A rank as a share of the group's values, on a scale of 1 to 99 (ibd), 0 to 100 (standard), 0 to 99.9 to one digit (fine) or 0 to 1 (share)."""
    share = rank / of
    return {"ibd": F.bround(share * 98 + 1).cast("int"), "standard": F.bround(share * 100).cast("int"), "fine": F.round(F.when(share * 100 > 99.9, 99.9).otherwise(share * 100), 1), "share": share}[scale]


def percentile(table: DataFrame, column: str, by: Sequence[str] = (), scale: str = "ibd", ties: str = "average", name: str = "percentile") -> DataFrame:
    """table with {name}, a scaled rank."""
    out = ranked(table, column, by, ties, "rank_out")
    return out.select(*table.columns, scaled(F.col("rank_out"), F.col("rank_out_of"), scale).alias(name))


def trailing_percentile(bars: DataFrame, column: str, years: int | None = None, name: str = "percentile") -> DataFrame:
    """bars with {name}: the rank of each value among all of its ticker's (of its last `years` calendar years, if given), as a share, however long the history is."""
    rows = bars
    if years is not None:
        last = bars.groupBy("ticker").agg(F.max("date").alias("rank_last"))
        rows = bars.join(last, "ticker").where(F.col("date") > F.add_months("rank_last", -12 * years)).drop("rank_last")
    return percentile(rows, column, ["ticker"], "share", name=name)
