"""Master tables: the columns of many period files side by side, a row a key, whatever columns each file has.

Files of one header are read together, all are turned to rows of key, column and value, and one pivot puts
them back: that is a full outer join of all files in a single shuffle. A column is named after its file's
period and timeframe; where two files give a name, the earlier one's value stays and the later one fills gaps.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters behind a column of each timeframe.
LETTERS = {"daily": "d", "weekly": "w", "monthly": "m"}
#: Parts of a file's name: what it ranks, timeframe, period and date.
NAME = r"(?P<kind>\w+?)_(?P<level>stocks|sectors|industries)_(?P<timeframe>daily|weekly|monthly)_(?P<period>\d+)period_(?P<date>\d{8})"


@dataclass(frozen=True, order=True)
class PeriodFile:
    level: str
    timeframe: str
    period: int
    date: str
    path: str


def period_files(paths: Sequence[str], pattern: str = NAME) -> list[PeriodFile]:
    """Files whose names fit, the last date of each level, timeframe and period, in order of these (daily before weekly)."""
    found: dict[tuple, PeriodFile] = {}
    for path in paths:
        if m := re.search(pattern, path.rstrip("/").rpartition("/")[2]):
            one = PeriodFile(m["level"], m["timeframe"], int(m["period"]), m["date"], path)
            key = one.level, one.timeframe, one.period
            found[key] = max(found.get(key, one), one, key=lambda f: f.date)
    return sorted(found.values(), key=lambda f: (f.level, list(LETTERS).index(f.timeframe), f.period))


def long(spark: SparkSession, files: Sequence[PeriodFile], key: str = "ticker", shared: Sequence[str] = ("date",)) -> DataFrame | None:
    """key, column, place (of the file) and value (text) of all files; blank values and those without a key go. `shared` columns keep their name, others get {period}{letter} behind it.

    A file whose name ends in a number of the period already keeps it: rs_5 of a 5-period file is rs_5d.
    """
    headers: dict[tuple, list[tuple[int, PeriodFile]]] = {}
    for place, file in enumerate(files):
        columns = tuple(spark.read.option("header", True).csv(file.path).columns)  # a header each
        headers.setdefault(columns, []).append((place, file))
    parts = []
    for columns, own in headers.items():
        if key not in columns:
            raise ValueError(f"{own[0][1].path} has no column {key}")
        values = [c for c in columns if c != key]
        kind = ", ".join(f"`{c}` string" for c in columns)
        rows = spark.read.schema(kind).option("header", True).csv([f.path for _, f in own])
        where = F.regexp_replace(F.col("_metadata.file_path"), r"^file:/+", "/")
        which = reduce(lambda out, f: F.when(where.contains(re.sub(r"^file:/+", "/", f[1].path)), f[0]).otherwise(out), own, F.lit(None).cast("int"))
        placed = rows.select(*columns, which.alias("place"))
        cells = placed.select(F.col(key).alias("key"), "place", F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in values))).alias("c"))
        parts.append(cells.select("key", "place", "c.name", "c.value"))
    if not parts:
        return None
    every = reduce(DataFrame.unionByName, parts).where("trim(key) <> '' and trim(value) <> ''")
    ends = F.create_map(*(x for place, f in enumerate(files) for x in (F.lit(place), F.lit(f"{f.period}{LETTERS[f.timeframe]}"))))
    letters = F.create_map(*(x for place, f in enumerate(files) for x in (F.lit(place), F.lit(LETTERS[f.timeframe]))))
    period = F.create_map(*(x for place, f in enumerate(files) for x in (F.lit(place), F.lit(f"_{f.period}"))))
    at = F.col("place")
    ended = F.when(F.col("name").isin(*shared), F.col("name")).when(F.endswith("name", period[at]), F.concat("name", letters[at])).otherwise(F.concat_ws("_", "name", ends[at]))
    return every.select("key", "place", ended.alias("column"), F.trim("value").alias("value"))


def master(spark: SparkSession, files: Sequence[PeriodFile], key: str = "ticker", shared: Sequence[str] = ("date",)) -> DataFrame | None:
    """A row a key with the columns of all files (found from them, in order of files and names); columns whose values are all numbers are doubles. None without files."""
    cells = long(spark, files, key, shared)
    if cells is None:
        return None
    found = cells.groupBy("column").agg(F.min("place").alias("place"), F.every(F.expr("try_cast(value as double) is not null")).alias("number")).collect()  # a row a column
    ordered = sorted(found, key=lambda r: (r["column"] not in shared, r["place"], r["column"]))
    wide = cells.groupBy("key").pivot("column", [r["column"] for r in ordered]).agg(F.min_by("value", "place"))
    return wide.select(F.col("key").alias(key), *(F.col(f"`{r['column']}`").cast("double").alias(r["column"]) if r["number"] else F.col(f"`{r['column']}`") for r in ordered))
