"""Universes: named sets of tickers from the dimension's columns, and joins with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least market cap of each bucket, largest first.
BUCKETS = (("mega", 200e9), ("large", 10e9), ("mid", 2e9), ("small", 300e6), ("micro", 50e6))


def clean_name(name: str) -> str:
    """SQL for a name without blanks and marks."""
    return f"regexp_replace({name}, '[ &./()-]', '')"


def with_bucket(dimension: DataFrame) -> DataFrame:
    bucket = F.when(F.col("market_cap") >= BUCKETS[0][1], BUCKETS[0][0])
    for name, least in BUCKETS[1:]:
        bucket = bucket.when(F.col("market_cap") >= least, name)
    return dimension.withColumn("bucket", F.when(F.col("market_cap").isNotNull(), bucket.otherwise("nano")))


def members(dimension: DataFrame) -> DataFrame:
    """ticker and universe: a row for each set that a ticker is in, by sector, industry, exchange and market cap, and for all."""
    kinds = with_bucket(dimension)
    names = [F.lit("all"), *(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}_"), F.expr(clean_name(c)))) for c in ("sector", "industry", "exchange", "bucket"))]
    return kinds.select("ticker", F.explode(F.array(*names)).alias("universe")).where("universe is not null").distinct()


def listed(dimension: DataFrame, column: str = "index") -> DataFrame:
    """ticker and universe from a column with names separated by commas."""
    each = F.explode(F.split(F.col(column), ",")).alias("name")
    return dimension.select("ticker", each).select("ticker", F.expr(clean_name("trim(name)")).alias("universe")).where("universe <> ''").distinct()


def flagged(dimension: DataFrame, table: DataFrame, names: Sequence[str]) -> DataFrame:
    """dimension with a boolean column for each universe named."""
    wide = table.where(F.col("universe").isin(list(names))).groupBy("ticker").pivot("universe", list(names)).agg(F.lit(True))
    return dimension.join(wide, "ticker", "left").fillna(False, list(names))


def within(df: DataFrame, table: DataFrame, universe: str) -> DataFrame:
    """Rows of df whose ticker is in a universe; none if there is no such universe."""
    return df.join(table.where(F.col("universe") == universe), "ticker", "left_semi")


def by_universe(df: DataFrame, table: DataFrame, universes: Sequence[str]) -> DataFrame:
    """df once for each of the universes that its ticker is in, with universe."""
    return df.join(table.where(F.col("universe").isin(list(universes))), "ticker")


def parsed(text: str) -> list[tuple[str, list[str]]]:
    """Universe sets of a setting: A;B are two, A+B is one of both."""
    return [(part.strip(), [x.strip() for x in part.split("+") if x.strip()]) for part in text.split(";") if part.strip()]


def summary(table: DataFrame) -> DataFrame:
    """universe, tickers and a digest of their names, to tell whether a set has changed."""
    return table.groupBy("universe").agg(F.count("*").alias("tickers"), F.md5(F.array_join(F.array_sort(F.collect_list("ticker")), ",")).alias("digest"))


def rated(dimension: DataFrame, column: str = "rating") -> DataFrame:
    """ticker and universe, rating_{name}, for each rating that analysts have given."""
    return dimension.where(F.col(column).isNotNull() & (F.trim(column) != "")).select("ticker", F.concat(F.lit("rating_"), F.expr(clean_name(f"trim({column})"))).alias("universe")).distinct()


def of_flags(dimension: DataFrame, flags: Sequence[str]) -> DataFrame:
    """ticker and universe: a row for each of the boolean columns that is true."""
    each = F.filter(F.array(*(F.when(F.col(c), F.lit(c)) for c in flags)), lambda x: x.isNotNull())
    return dimension.select("ticker", F.explode(each).alias("universe"))


def together(*lists: DataFrame) -> DataFrame:
    """Tickers of several lists, each once, with the columns of the first list that has it."""
    numbered = [x.withColumn("list_number", F.lit(i)) for i, x in enumerate(lists)]
    out = numbered[0]
    for other in numbered[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    columns = [c for c in out.columns if c not in ("ticker", "list_number")]
    return out.groupBy("ticker").agg(F.min_by(F.struct(*columns), "list_number").alias("r")).select("ticker", "r.*")


def chosen(dimension: DataFrame, choice: str, sets: dict[int, str], table: DataFrame) -> DataFrame:
    """Rows of dimension in the universes of a choice such as "1-3": numbers in `sets`, joined by "-"; number 0 is all tickers. Unknown numbers are an error."""
    numbers = [int(x) for x in str(choice).split("-")]
    if 0 in numbers:
        return dimension
    names = [sets[n] for n in numbers]
    return dimension.join(table.where(F.col("universe").isin(names)).select("ticker").distinct(), "ticker", "left_semi")
