"""Tiers of CSV files, a file for each ticker, as a Spark data source that opens only the files it needs.

`spark.read.format("tidemark_bars").load(folder)` reads folder/archive/*.csv and folder/current/*.csv;
current wins where both have a date. Where spark.sql.python.filterPushdown.enabled is
set, a filter on ticker (equal or in) is pushed down to the planning of partitions, so that a query of ten
tickers opens their files alone; elsewhere the option `only` names tickers, with commas between.
A partition is a few tickers with the files of both tiers, so that nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .bars import PRICES

FORMAT, TIERS = "tidemark_bars", ("archive", "current")
SCHEMA = "ticker string, date date, open double, high double, low double, close double, volume double"
#: Tickers of a partition.
TICKERS = 64


@dataclass
class Tickers(InputPartition):
    """ticker and its paths, from the oldest tier on, for each of some tickers."""

    files: list[tuple[str, list[str]]]


def _number(text) -> float | None:
    """The number that a text is, to the last digit; None for what isn't one, and for NaN."""
    try:
        found = float(text)
    except (TypeError, ValueError):
        return None
    return None if found != found else found


def _numbers(texts: pa.Array) -> pa.Array:
    """_number of each text; all at once where all are plain numbers."""
    try:
        found = pc.cast(pc.utf8_trim_whitespace(texts), pa.float64())
    except pa.ArrowInvalid:
        return pa.array([_number(x) for x in texts.to_pylist()], pa.float64())
    return pc.if_else(pc.is_nan(found), pa.scalar(None, pa.float64()), found)


def _dates(texts: pa.Array) -> pa.Array:
    """The date that a text begins with, up to a blank; null for what isn't one."""
    try:
        return pc.cast(pc.utf8_trim_whitespace(texts), pa.date32())
    except pa.ArrowInvalid:
        days = pd.to_datetime(texts.to_pandas().astype("string").str.strip().str.split(" ").str[0], format="%Y-%m-%d", errors="coerce")
        return pa.array(days.dt.date, pa.date32())


def _bars(ticker: str, tables: Sequence[pa.Table], weekdays: bool) -> pa.RecordBatch:
    names = ["date", *PRICES, "volume"]
    columns: dict[str, list[pa.Array]] = {name: [] for name in names}
    for table in tables:
        own = {c.strip().lower(): table.column(i).combine_chunks() for i, c in enumerate(table.column_names)}
        for name in names:
            texts = own.get(name, pa.nulls(len(table), pa.string())).cast(pa.string())
            columns[name].append(_dates(texts) if name == "date" else _numbers(texts))
    whole = pa.RecordBatch.from_arrays([pa.concat_arrays(parts) for parts in columns.values()], names)
    whole = whole.filter(pc.is_valid(whole.column("date")))
    days = whole.column("date").cast(pa.int32()).to_numpy()
    order = np.argsort(days, kind="stable")  # of equal dates that of the last tier and line is last
    days = days[order]
    kept = np.append(days[1:] != days[:-1], [True] * (len(days) > 0)).astype(bool)
    if weekdays:
        kept &= (days + 3) % 7 < 5  # day 0 is a Thursday
    rows = whole.take(pa.array(order[kept]))
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(ticker, pa.string()), len(rows)), *rows.columns], ["ticker", *names])


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.weekdays = options["path"].rstrip("/"), options.get("weekdays", "true").lower() == "true"
        self.most = int(options.get("tickers", TICKERS))
        self.wanted = {t.strip() for t in options["only"].split(",")} if "only" in options else None

    def partitions(self) -> list[Tickers]:
        store, top = fs.FileSystem.from_uri(self.folder if "://" in self.folder or self.folder.startswith("file:") else f"file://{self.folder}")
        found: dict[str, list[str]] = {}
        for tier in TIERS:
            for one in sorted(store.get_file_info(fs.FileSelector(f"{top}/{tier}", allow_not_found=True)), key=lambda f: f.path):
                if one.type == fs.FileType.File and one.base_name.endswith(".csv"):
                    name = one.base_name.removesuffix(".csv").strip().upper().replace(".", "-")
                    if self.wanted is None or name in self.wanted:
                        found.setdefault(name, []).append(one.path)
        items = sorted(found.items())
        return [Tickers(items[i : i + self.most]) for i in range(0, len(items), self.most)] or [Tickers([])]

    def read(self, partition: Tickers) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.folder if "://" in self.folder or self.folder.startswith("file:") else f"file://{self.folder}")
        text = csv.ConvertOptions(column_types={c: pa.string() for name in ["date", *PRICES, "volume"] for c in (name, name.title())}, strings_can_be_null=True)
        for ticker, paths in partition.files:
            tables = []
            for path in paths:
                with store.open_input_stream(path) as stream:
                    tables.append(csv.read_csv(stream, convert_options=text))
            yield _bars(ticker, tables, self.weekdays)


class PushedReader(Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("ticker",):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = named if self.wanted is None else self.wanted & named
            else:
                yield f  # Spark's own


class TieredBars(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return (PushedReader if self.options.get("pushed") == "true" else Reader)(self.options)


def tiered(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Bars of both tiers; options: weekdays (true: weekends go), tickers (of a partition) and only."""
    spark.dataSource.register(TieredBars)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(FORMAT).options(**options, pushed=pushed).load(folder)
