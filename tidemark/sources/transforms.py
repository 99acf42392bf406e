"""Exports of different forms to canonical bars, by rules on files' paths.

All files are read in one scan, each as one row with its path (a ticker's file is small); the first rule
that fits a path says the form, the timeframe and how the ticker stands in the name. What can't be read is
told per file. The result goes to one canonical CSV folder a ticker.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bars import PRICES

#: How a ticker stands in a file's name, by form, the first that fits; names are matched in either case. Fixed values.
TICKERS = {
    "chart": (r"^([A-Z0-9_.-]+),\s*[0-9]+[DWMY]\.csv$", r"^([A-Z0-9_.-]+)_[0-9]+[DWMY]\.csv$", r"^([A-Z0-9_.-]+)\.csv$"),
    "sheet": (r"^([\^A-Z0-9_.-]+?)_(?:daily|weekly|monthly)\.csv$", r"^([\^A-Z0-9_.-]+)\.csv$"),
    "plain": (r"^([\^A-Z0-9_.-]+)\.csv$",),
}


@dataclass(frozen=True)
class Rule:
    """form: chart (time, open, ... by header), sheet (date as month/day/year first, then open, ... by place), or plain (Date, Open, ... by header). pattern: a glob on the file's name."""

    folder: str
    pattern: str
    form: str
    timeframe: str


def rules(lines: Sequence[str]) -> list[Rule]:
    """Rules from lines of flag,folder,pattern,form,timeframe; those whose flag isn't TRUE, comments and blank lines are passed over."""
    found = []
    for number, line in enumerate(lines, 1):
        parts = [x.strip() for x in line.split(",")]
        if not line.strip() or line.lstrip().startswith("#") or parts[0].upper() != "TRUE":
            continue
        if len(parts) != 5 or parts[3] not in TICKERS:
            raise ValueError(f"line {number}: {line!r} isn't flag,folder,pattern,form,timeframe")
        found.append(Rule(parts[1].rstrip("/"), parts[2], parts[3], parts[4]))
    return found


def _plain(path: Column) -> Column:
    return F.url_decode(F.regexp_replace(path, "^file:/+", "/"))


def files(spark: SparkSession, found: Sequence[Rule]) -> DataFrame:
    """path, form, timeframe, ticker and lines of each file that a rule fits, in one scan of the rules' folders."""
    folders = sorted({r.folder for r in found})
    raw = spark.read.option("pathGlobFilter", "*.csv").text(folders, wholetext=True).select(_plain(F.col("_metadata.file_path")).alias("path"), "value")
    name = F.substring_index("path", "/", -1)

    def fits(rule: Rule) -> Column:
        folder = re.sub("^file:/+", "/", rule.folder)
        return F.startswith("path", F.lit(f"{folder}/")) & ~F.contains(F.substring("path", len(folder) + 2, 10_000), F.lit("/")) & name.rlike(fnmatch.translate(rule.pattern).replace(r"\Z", "$").replace(r"\z", "$"))

    rule = reduce(lambda out, r: F.when(fits(r), F.struct(F.lit(r.form).alias("form"), F.lit(r.timeframe).alias("timeframe"))).otherwise(out), reversed(found), F.lit(None).cast("struct<form:string,timeframe:string>"))
    ruled = raw.withColumn("rule", rule).where("rule is not null").select("path", "rule.form", "rule.timeframe", name.alias("name"), "value")
    first = lambda patterns: reduce(lambda out, p: F.when(F.col("name").rlike(f"(?i){p}"), F.upper(F.regexp_extract("name", f"(?i){p}", 1))).otherwise(out), reversed(patterns), F.lit(None).cast("string"))
    ticker = reduce(lambda out, f: F.when(F.col("form") == f, first(TICKERS[f])).otherwise(out), TICKERS, F.lit(None).cast("string"))
    lines = F.filter(F.split(F.regexp_replace("value", "^﻿", ""), r"\r?\n"), lambda x: F.trim(x) != "")
    return ruled.select("path", "form", "timeframe", ticker.alias("ticker"), lines.alias("lines"))


def transformed(table: DataFrame) -> DataFrame:
    """ticker, timeframe, date, open, high, low, close, volume and path of files(). What isn't a number is null, a lacking volume 0, a row without a date goes; fields hold no quoted commas.

    Of rows with equal ticker, timeframe and date that of the last path and line stays.
    """
    fields = lambda line: F.transform(F.split(line, ","), lambda x: F.trim(F.replace(x, F.lit('"'), F.lit(""))))
    named = ["time", "date", *PRICES, "volume"]
    places = F.struct(*(F.expr(f"cast(nullif(array_position(header, '{n}'), 0) as int)").alias(n) for n in named))
    rows = table.where("ticker is not null and size(lines) > 1").withColumn("header", F.transform(fields(F.col("lines")[0]), F.lower)).withColumn("at", places)
    sheet, nothing = F.col("form") == "sheet", F.lit(None).cast("double")
    number = lambda c: F.nanvl(c.try_cast("double"), nothing)

    def read(f: Column) -> Column:
        at = lambda *names: F.coalesce(*(F.try_element_at(f, F.col("at")[n]) for n in names))
        nth = lambda i: F.try_element_at(f, F.lit(i))
        text = F.when(sheet, nth(1)).otherwise(at("time", "date"))
        us = F.to_date(F.try_to_timestamp(F.split_part(text, F.lit(" "), F.lit(1)), F.lit("M/d/yyyy")))
        seconds = F.when(text.rlike(r"^[\x00-\x20]*[+-]?[0-9]+[\x00-\x20]*$"), text.try_cast("bigint"))  # a cast that fails costs an exception a line
        iso = F.coalesce(F.to_date(F.timestamp_seconds(seconds)), F.substring(text, 1, 10).try_cast("date"))
        made = [number(F.when(sheet, nth(i)).otherwise(at(p))).alias(p) for i, p in enumerate(PRICES, 2)]
        return F.struct(F.when(sheet, us).otherwise(iso).alias("date"), *made, F.coalesce(number(F.when(sheet, nth(6)).otherwise(at("volume"))), F.lit(0.0)).alias("volume"))

    # A line's fields are a variable of the second function, so that they are split once, whatever is read from them.
    lines = F.transform(F.transform(F.slice("lines", 2, F.size("lines")), fields), read)
    out = rows.select("ticker", "timeframe", "path", F.posexplode(lines).alias("place", "bar")).where("bar.date is not null").select("ticker", "timeframe", "bar.*", "path", "place")
    last = out.groupBy("ticker", "timeframe", "date").agg(F.max_by(F.struct(*PRICES, "volume", "path"), F.struct("path", "place")).alias("r"))
    return last.select("ticker", "timeframe", "date", "r.*")


def report(table: DataFrame, bars: DataFrame) -> DataFrame:
    """path, form, ticker, rows and problem (null if there is none) of each file."""
    n = bars.groupBy(F.col("path").alias("of")).agg(F.count("*").alias("n"))
    needed = {"chart": ["time", *PRICES], "plain": ["date", *PRICES]}
    header = F.transform(F.split(F.col("lines")[0], ","), lambda x: F.lower(F.trim(F.replace(x, F.lit('"'), F.lit("")))))
    lacking = reduce(lambda out, f: F.when(F.col("form") == f, F.array_except(F.array(*map(F.lit, needed[f])), header)).otherwise(out), needed, F.array().cast("array<string>"))
    problem = (
        F.when(F.col("ticker").isNull(), "no ticker in the name").when(F.size("lines") < 2, "no rows")
        .when(F.size(lacking) > 0, F.concat(F.lit("no "), F.array_join(lacking, ", "))).when(F.coalesce("n", F.lit(0)) == 0, "no dates, or other files have them")
    )
    return table.join(n, F.col("path") == F.col("of"), "left").select("path", "form", "ticker", F.coalesce("n", F.lit(0)).cast("long").alias("rows"), problem.alias("problem"))


def canonical(bars: DataFrame, folder: str) -> None:
    """Date, Open, High, Low, Close, Volume as CSV in folder/timeframe=/ticker=, one part a ticker, in order of date; the tickers that bars has are replaced, others stay."""
    named = bars.select("timeframe", "ticker", F.col("date").alias("Date"), *(F.col(c).alias(c.title()) for c in [*PRICES, "volume"]))
    (
        named.repartition("timeframe", "ticker").sortWithinPartitions("timeframe", "ticker", "Date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True)
        .partitionBy("timeframe", "ticker").csv(folder)
    )


def read_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """Bars with their timeframe, from what canonical() wrote; a filter on ticker or timeframe reads only their folders."""
    kinds = "Date date, Open double, High double, Low double, Close double, Volume double, timeframe string, ticker string"
    rows = spark.read.schema(kinds).option("header", True).csv(folder)
    return rows.select("ticker", "timeframe", F.col("Date").alias("date"), *(F.col(c.title()).alias(c) for c in [*PRICES, "volume"]))


def canonical_files(bars: DataFrame, folder: str) -> DataFrame:
    """Writes {folder}/{ticker}.csv with Date, Open, High, Low, Close, Volume, one file a ticker; returns path and rows of each.

    The result has to be used for the files to be written. A file is written under another name and then moved, so that a
    task that runs twice, or dies, leaves no half of one.
    """
    columns = ["date", *PRICES, "volume"]
    text = lambda c: F.coalesce((F.nanvl(F.col(c), F.lit(None).cast("double")) if kinds[c] == "double" else F.col(c)).cast("string"), F.lit(""))
    kinds = dict(bars.dtypes)

    def write(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        store.create_dir(top, recursive=True)
        for batch in batches:
            paths = []
            for ticker, lines in zip(batch.column("ticker").to_pylist(), batch.column("lines")):
                paths.append(f"{top}/{ticker}.csv")
                draft = f"{top}/.{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as out:
                    out.write(lines.as_buffer())
                store.move(draft, paths[-1])
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), batch.column("rows")], ["path", "rows"])

    lines = bars.select("ticker", F.struct("date", F.concat_ws(",", *map(text, columns)).alias("line")).alias("r")).groupBy("ticker").agg(F.sort_array(F.collect_list("r")).alias("all"))
    header = F.lit(",".join(columns).title() + "\n")
    whole = lines.select("ticker", F.concat(header, F.array_join("all.line", "\n"), F.lit("\n")).alias("lines"), F.size("all").cast("long").alias("rows"))
    return whole.mapInArrow(write, "path string, rows long")
