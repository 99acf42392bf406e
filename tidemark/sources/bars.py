"""Bars: where they come from, how they are cleaned, and coarser timeframes.

A bar has ticker, date, open, high, low, close and volume (doubles); values are null rather than NaN.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

PRICES = ["open", "high", "low", "close"]
#: Rows that a ticker needs, by timeframe.
LEAST_ROWS = {"daily": 252, "weekly": 52, "monthly": 12, "intraday": 100}
#: Rows that are kept, by mode and timeframe; mode 0 keeps all.
HISTORY = {1: {"daily": 252, "weekly": 52, "monthly": 12}, 2: {"daily": 252, "weekly": 104, "monthly": 36}}


def bars_of(lineitem: DataFrame) -> DataFrame:
    """Daily bars from order lines: a supplier is a ticker, price per unit the price, quantity the volume."""
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]
    price = F.col("l_extendedprice") / F.col("l_quantity")
    lines = lineitem.select(F.concat(F.lit("S"), F.col("l_suppkey")).alias("ticker"), F.to_date("l_shipdate").alias("date"), *key)
    # Dealt by ticker once: grouping by ticker and date and all windows by ticker are met by that. What a line's own columns give is made after it.
    return (
        lines.repartition("ticker")
        .select("ticker", "date", price.alias("px"), F.struct(*key).alias("k"), F.col("l_quantity").alias("q"))
        .groupBy("ticker", "date")
        .agg(F.min_by("px", "k").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "k").alias("close"), F.sum("q").alias("volume"))
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_of(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, description, market_cap, sector, industry, exchange: suppliers with their nation and region."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    places = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return read("supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("S"), F.col("s_suppkey")).alias("ticker"),
        F.col("s_name").alias("description"),
        (F.greatest(F.col("s_acctbal"), F.lit(0.0)) * 3e7).alias("market_cap"),
        F.col("r_name").alias("sector"),
        F.col("n_name").alias("industry"),
        F.when(F.col("s_suppkey") % 2 == 0, "NYSE").otherwise("NASDAQ").alias("exchange"),
    )


def numbered(bars: DataFrame) -> DataFrame:
    """bars with bar, the row's number in its ticker from 1."""
    return bars.withColumn("bar", F.row_number().over(W.partitionBy("ticker").orderBy("date")))


def rolled_up(bars: DataFrame, timeframe: str) -> DataFrame:
    """Weekly, monthly, quarterly or yearly bars, dated by the first day of their period."""
    unit = {"weekly": "week", "monthly": "month", "quarterly": "quarter", "yearly": "year"}[timeframe]
    grouped = bars.groupBy("ticker", F.to_date(F.date_trunc(unit, "date")).alias("period"))
    out = grouped.agg(F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"))
    return out.withColumnRenamed("period", "date")


def latest(rows: DataFrame) -> DataFrame:
    """The last row of each ticker."""
    rest = [c for c in rows.columns if c != "ticker"]
    return rows.groupBy("ticker").agg(F.max_by(F.struct(*rest), "date").alias("r")).select("ticker", "r.*")


def last_rows(bars: DataFrame, n: int) -> DataFrame:
    back = W.partitionBy("ticker").orderBy(F.col("date").desc())
    return bars.withColumn("back", F.row_number().over(back)).where(F.col("back") <= n).drop("back")


def capped(bars: DataFrame, timeframe: str, mode: int) -> DataFrame:
    """The last bars of each ticker that a history mode keeps."""
    n = HISTORY.get(mode, {}).get(timeframe)
    return last_rows(bars, n) if n else bars


def latest_dates(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ticker").agg(F.max("date").alias("latest"))


def canonical(symbol: Column) -> Column:
    """Upper case, with a dash for the dot of share classes; null for names with a slash."""
    clean = F.upper(F.trim(symbol))
    return F.when(clean.contains("/") | (clean == ""), None).otherwise(F.replace(clean, F.lit("."), F.lit("-")))


def parsed_date(text: Column) -> Column:
    """The date of a timestamp text with or without time and offset."""
    return F.to_date(F.try_to_timestamp(F.split_part(F.trim(text), F.lit(" "), F.lit(1)), F.lit("yyyy-MM-dd")))


def cleaned(raw: DataFrame, weekdays_only: bool = True) -> DataFrame:
    """Text bars as bars: dates parsed, numbers cast (null if they can't be), NaN as null, weekends and undated rows dropped."""
    number = lambda c: F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double")).alias(c)
    out = raw.select(canonical(F.col("ticker")).alias("ticker"), parsed_date(F.col("date").cast("string")).alias("date"), *(number(c) for c in [*PRICES, "volume"]))
    out = out.where("ticker is not null and date is not null")
    return out.where(F.weekday("date") < 5) if weekdays_only else out


def tiered(spark: SparkSession, folder: str) -> DataFrame:
    """Bars of folder/archive/*.csv and folder/current/*.csv, a file for each ticker; current wins where both have a date."""
    schema = "date string, open string, high string, low string, close string, volume string"
    read = spark.read.schema(schema).option("header", True).csv([f"{folder}/archive", f"{folder}/current"])
    path = F.col("_metadata.file_path")
    raw = read.select("*", F.regexp_extract(path, r"([^/]+)\.csv$", 1).alias("ticker"), path.contains("/current/").cast("int").alias("tier"))
    day = parsed_date(F.col("date"))
    rank = F.row_number().over(W.partitionBy("ticker", day).orderBy(F.col("tier").desc()))
    return cleaned(raw.withColumn("rank", rank).where("rank = 1"))


def dated_files(spark: SparkSession, folder: str, prefix: str, after: str | None = None) -> DataFrame:
    """Rows of folder/{prefix}*YYYY-MM-DD.csv or YYYYMMDD.csv whose date in the name is after `after`; files without one are skipped."""
    read = spark.read.option("header", True).option("pathGlobFilter", f"{prefix}*.csv").csv(folder)
    digits = F.regexp_replace(F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4}-?\d{2}-?\d{2})\.csv$", 1), "-", "")
    rows = read.withColumn("file_date", F.to_date(F.try_to_timestamp(digits, F.lit("yyyyMMdd")))).where("file_date is not null")
    return rows.where(F.col("file_date") > F.lit(after).cast("date")) if after else rows


def supplement(spark: SparkSession, folder: str, prefix: str, after: str | None = None) -> DataFrame:
    """Bars of batch files with a Symbol column; a null volume counts as 0, and of repeated rows the newest file's stays."""
    rows = dated_files(spark, folder, prefix, after)
    raw = rows.select(F.col("Symbol").alias("ticker"), F.col("Date").alias("date"), *(F.col(c.title()).alias(c) for c in PRICES), F.coalesce("Volume", F.lit("0")).alias("volume"), "file_date")
    rank = F.row_number().over(W.partitionBy(canonical(F.col("ticker")), parsed_date(F.col("date"))).orderBy(F.col("file_date").desc()))
    return cleaned(raw.withColumn("rank", rank).where("rank = 1"))


def extended(bars: DataFrame, more: DataFrame) -> DataFrame:
    """bars and those of `more` that are later than their ticker's last; tickers that only `more` has are left out."""
    newer = more.join(latest_dates(bars), "ticker").where("date > latest").select(*bars.columns)
    return bars.unionByName(newer)


def quality(bars: DataFrame, timeframe: str = "daily", least: int | None = None) -> DataFrame:
    """ticker, rows, null_share, least_close, jump_share and valid."""
    least = least or LEAST_ROWS.get(timeframe, 50)
    moved = F.abs(F.try_divide(F.col("close"), F.lag("close").over(W.partitionBy("ticker").orderBy("date"))) - 1) > 0.5
    stats = bars.withColumn("moved", F.coalesce(moved, F.lit(False)).cast("int")).groupBy("ticker").agg(
        F.count("*").alias("rows"), F.avg(F.col("close").isNull().cast("int")).alias("null_share"), F.min("close").alias("least_close"), F.avg("moved").alias("jump_share")
    )
    valid = (F.col("rows") >= least) & (F.col("null_share") <= 0.1) & (F.col("least_close") > 0) & (F.col("jump_share") <= 0.01)
    return stats.withColumn("valid", F.coalesce(valid, F.lit(False)))


def valid_only(bars: DataFrame, timeframe: str = "daily") -> DataFrame:
    return bars.join(quality(bars, timeframe).where("valid"), "ticker", "left_semi")


def filled(bars: DataFrame, dates: int | None = None) -> DataFrame:
    """A row for each ticker and date on which any ticker has a bar, from the ticker's first on, with the last close.

    With `dates` only the last so many of these dates are made. The calendar of dates is one small row, so that
    the grid is made by exploding it, not by a join.
    """
    calendar = bars.agg(F.sort_array(F.collect_set("date")).alias("dates"))
    spans = bars.groupBy("ticker").agg(F.min("date").alias("first"))
    if dates:
        calendar = calendar.select(F.slice("dates", F.greatest(F.size("dates") - (dates - 1), F.lit(1)), dates).alias("dates"))
        # What a ticker had before the first date made counts as that date's.
        shifted = bars.crossJoin(F.broadcast(calendar.select(F.col("dates")[0].alias("start"))))
        last = F.max_by("close", F.when(F.col("close").isNotNull(), F.col("date")))
        bars = shifted.groupBy("ticker", F.greatest("date", "start").alias("at")).agg(last.alias("close")).withColumnRenamed("at", "date")
    spans = spans.crossJoin(F.broadcast(calendar))
    grid = spans.select("ticker", F.explode(F.filter("dates", lambda d: d >= F.col("first"))).alias("date"))
    last = F.last("close", ignorenulls=True).over(W.partitionBy("ticker").orderBy("date"))
    return grid.join(bars.select("ticker", "date", "close"), ["ticker", "date"], "left").select("ticker", "date", last.alias("close"))


def wide(bars: DataFrame, tickers: Sequence[str], column: str = "close") -> DataFrame:
    """A row for each date and a column for each of the tickers named."""
    return bars.where(F.col("ticker").isin(list(tickers))).groupBy("date").pivot("ticker", list(tickers)).agg(F.first(column))


def summary(bars: DataFrame) -> DataFrame:
    per = bars.groupBy("ticker").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))
    return per.agg(F.count("*").alias("tickers"), F.sum("n").alias("bars"), F.min("first").alias("first_date"), F.max("last").alias("last_date"), F.avg("n").alias("bars_per_ticker"))


#: Names of the ticker column in lists, in the order in which they are looked for.
TICKER_NAMES = ("ticker", "symbol", "Ticker", "Symbol")


def ticker_list(table: DataFrame) -> DataFrame:
    """The distinct tickers of a list, from the first of TICKER_NAMES that it has; null and empty ones go. A list with none is an error."""
    name = next((c for c in TICKER_NAMES if c in table.columns), None)
    if name is None:
        raise ValueError(f"none of {', '.join(TICKER_NAMES)} among {', '.join(table.columns)}")
    return table.select(F.trim(F.col(name)).alias("ticker")).where("ticker is not null and ticker <> ''").distinct()


def first_table(spark: SparkSession, *paths: str) -> DataFrame | None:
    """The first of some CSV files that exists, with its header; None if none does."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            return spark.read.option("header", True).csv(path)
    return None


def snapshots(rows: DataFrame) -> DataFrame:
    """ticker, date, open, high, low, close, volume of dated exports with Symbol and prices as text.

    rows: Symbol, date, place (of the row among those of its date; the first of a symbol counts), Open,
    High, Low, Price, Volume. Rows without a symbol or a positive close go.
    """
    names = {"open": "Open", "high": "High", "low": "Low", "close": "Price", "volume": "Volume"}
    out = rows.select(F.trim("Symbol").alias("ticker"), "date", "place", *(F.expr(f"try_cast({v} as double)").alias(k) for k, v in names.items()))
    out = out.where("ticker is not null and ticker <> '' and close > 0")
    return out.groupBy("ticker", "date").agg(F.min_by(F.struct(*names), "place").alias("r")).select("ticker", "date", "r.*")


def add_snapshots(new: DataFrame, table: str) -> None:
    """Adds those dates of new that the table (Parquet by date) lacks; the others are left as they are, so that a second run changes nothing."""
    spark = new.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(table)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        new = new.join(spark.read.parquet(table).select("date").distinct(), "date", "left_anti")
    new.repartition("date").write.mode("append").partitionBy("date").parquet(table)


def from_chart(rows: DataFrame, ticker: str) -> DataFrame:
    """Bars of a chart export with time (seconds or a date), open, high, low, close as text and maybe Volume; what isn't a number is null, a lacking volume 0."""
    date = F.coalesce(F.to_date(F.timestamp_seconds(F.expr("try_cast(time as bigint)"))), F.expr("try_cast(substr(time, 1, 10) as date)"))
    volume = next((F.expr(f"coalesce(try_cast(`{c}` as double), 0)") for c in rows.columns if c.lower() == "volume"), F.lit(0.0))
    return rows.select(F.lit(ticker).alias("ticker"), date.alias("date"), *(F.expr(f"try_cast({c} as double)").alias(c) for c in PRICES), volume.alias("volume")).where("date is not null")


def from_sheet(rows: DataFrame, ticker: str) -> DataFrame:
    """Bars of a sheet export: the first six columns are date and time as month/day/year, open, high, low, close, volume, whatever their names."""
    date, *values = rows.columns[:6]
    day = F.to_date(F.expr(f"try_to_timestamp(split(`{date}`, ' ')[0], 'M/d/yyyy')"))
    return rows.select(F.lit(ticker).alias("ticker"), day.alias("date"), *(F.expr(f"try_cast(`{c}` as double)").alias(n) for c, n in zip(values, [*PRICES, "volume"]))).where("date is not null")
