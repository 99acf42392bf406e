"""Sinks: tables by timeframe and date, matrices with fixed columns, watchlists and JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def partitioned(df: DataFrame, path: str, by: Sequence[str] = ("timeframe", "data_date"), mode: str = "overwrite") -> None:
    """Parquet by partition; with mode overwrite only the partitions that df has are replaced."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def dated(df: DataFrame, timeframe: str, date: str = "date") -> DataFrame:
    """df with timeframe and data_date, the last date that it has."""
    last = df.agg(F.max(date).alias("data_date"))
    return df.withColumn("timeframe", F.lit(timeframe)).crossJoin(F.broadcast(last))


def matrix_csv(df: DataFrame, path: str, columns: Sequence[str], digits: int = 2) -> None:
    """CSV with a header, the columns in the order given, numbers rounded."""
    kinds = dict(df.dtypes)
    df.select(*(F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in columns)).write.mode("overwrite").option("header", True).csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def text_lines(df: DataFrame, path: str, column: str = "line") -> None:
    df.select(column).write.mode("overwrite").text(path)


def latest_partition(df: DataFrame, by: str = "data_date") -> DataFrame:
    """Rows of the last partition."""
    last = df.agg(F.max(by)).first()[0]
    return df.where(F.col(by) == F.lit(last))
