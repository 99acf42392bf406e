"""As-of joins: to each row the last row of another table on or before its time, by key.

Time is cut into buckets. A row's match is in its own bucket or is the last one of an earlier bucket, and
what each bucket takes from the earlier ones comes from a pass over one row a key and bucket. So a key's
rows are never together in a task: they meet their candidates by key and bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Days of a bucket.
DAYS = 32


def _bucket(at: Column, days: int) -> Column:
    return F.floor(F.unix_timestamp(at.cast("timestamp")) / (days * 86_400)).cast("long")


def _carried(firsts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bucket and what the last earlier bucket with a value has. firsts: keys, bucket, last (null where a bucket has none), one row each.

    Without keys the buckets of the calendar are one list, so that no window spans the table.
    """
    if keys:
        earlier = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        return firsts.select(*keys, "bucket", F.last("last", ignorenulls=True).over(earlier).alias("last"))
    rows = firsts.agg(F.sort_array(F.collect_list(F.struct("bucket", "last"))).alias("rows"))
    kind = firsts.schema["last"].dataType
    start = F.struct(F.lit(None).cast(kind).alias("seen"), F.array().cast(f"array<struct<bucket: bigint, last: {kind.simpleString()}>>").alias("out"))
    step = lambda acc, row: F.struct(F.coalesce(row["last"], acc["seen"]).alias("seen"), F.array_append(acc["out"], F.struct(row["bucket"].alias("bucket"), acc["seen"].alias("last"))).alias("out"))
    return rows.select(F.inline(F.aggregate("rows", start, step, lambda acc: acc["out"])))


def as_of(left: DataFrame, right: DataFrame, columns: Sequence[str], by: Sequence[str] = (), date: str = "date", exact: bool = True, within_days: int | None = None, days: int = DAYS) -> DataFrame:
    """left with the columns of right's last row of equal keys on or before each date (before it, unless exact; no further back than within_days).

    The last row counts as it is, nulls too; of several on its date the greatest by the columns named, in their order. A
    null key or date matches nothing. Rows of left without a match have nulls. columns mustn't be
    columns of left; other columns of right are not read.
    """
    keys = list(by)
    if clash := set(columns) & set(left.columns):
        raise ValueError(f"left has {', '.join(sorted(clash))}")
    named = [f"asof_{i}" for i in range(len(keys))]
    own = [F.col(k).alias(n) for k, n in zip(keys, named)]
    theirs = right.where(" and ".join(f"`{k}` is not null" for k in [*keys, date])).select(*own, F.col(date).cast("timestamp").alias("asof_at"), F.struct(F.col(date).alias("asof_date"), *columns).alias("asof_value"))
    theirs = theirs.groupBy(*named, "asof_at").agg(F.max("asof_value").alias("asof_value")).withColumn("bucket", _bucket(F.col("asof_at"), days))
    kind = theirs.schema["asof_value"].dataType
    mine = left.select(*own, F.col(date).cast("timestamp").alias("asof_at"), F.struct("*").alias("asof_row")).withColumn("bucket", _bucket(F.col("asof_at"), days))
    lasts = theirs.groupBy(*named, "bucket").agg(F.max_by("asof_value", "asof_at").alias("last"))
    firsts = mine.select(*named, "bucket").distinct().withColumn("last", F.lit(None).cast(kind)).unionByName(lasts).groupBy(*named, "bucket").agg(F.max("last").alias("last"))
    seeds = _carried(firsts.where(" and ".join(f"{k} is not null" for k in [*named, "bucket"])), named).where("last is not null")
    row, none = mine.schema["asof_row"].dataType, F.lit(None)
    # Seeds stand before all rows of their bucket; at equal times left's rows come after right's if they may meet.
    lines = mine.select(*named, "bucket", "asof_at", F.lit(2 if exact else 0).alias("asof_order"), none.cast(kind).alias("asof_value"), "asof_row")
    lines = lines.unionByName(theirs.select(*named, "bucket", "asof_at", F.lit(1).alias("asof_order"), "asof_value", none.cast(row).alias("asof_row")))
    lines = lines.unionByName(seeds.select(*named, "bucket", none.cast("timestamp").alias("asof_at"), F.lit(-1).alias("asof_order"), F.col("last").alias("asof_value"), none.cast(row).alias("asof_row")))
    order = W.partitionBy(*named, "bucket").orderBy(F.asc_nulls_first("asof_at"), "asof_order").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = lines.withColumn("asof_found", F.last("asof_value", ignorenulls=True).over(order)).where("asof_row is not null")
    if within_days is not None:
        age = F.unix_timestamp(F.col("asof_at")) - F.unix_timestamp(F.col("asof_found.asof_date").cast("timestamp"))
        found = found.withColumn("asof_found", F.when(age <= within_days * 86_400, F.col("asof_found")))
    return found.select(*(F.col("asof_row")[c].alias(c) for c in left.columns), *(F.col("asof_found")[c].alias(c) for c in columns))
