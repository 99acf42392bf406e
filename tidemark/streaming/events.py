"""Structured Streaming over an event stream and over arriving bars.

Events have event_id, ts, user_id, event_type, value and props (JSON). Late events count until the
watermark has passed them; repeated event_ids within it count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "10 minutes"


def source(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """The event table as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return timed(spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder))


def timed(events: DataFrame) -> DataFrame:
    """events with ts as a timestamp, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def once(events: DataFrame, late: str = LATE) -> DataFrame:
    """Each event_id once, as far as the watermark reaches; for a table, each once."""
    if not events.isStreaming:
        return events.dropDuplicates(["event_id"])
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def tumbling(events: DataFrame, length: str = "1 hour", late: str = LATE) -> DataFrame:
    """window start and end, event_type, events and value in windows beside each other."""
    return _windowed(events, F.window("ts", length), late)


def sliding(events: DataFrame, length: str = "1 hour", step: str = "15 minutes", late: str = LATE) -> DataFrame:
    return _windowed(events, F.window("ts", length, step), late)


def _windowed(events: DataFrame, window, late: str) -> DataFrame:
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    out = marked.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "events", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """user_id, start, end, events and value of runs of a user's events no further apart than the gap."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    out = marked.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "value")


def event_bars(events: DataFrame, unit: str = "hour") -> DataFrame:
    """ticker (the event type), time, open, high, low, close and volume (events) by hour or day."""
    order = F.struct("ts", "event_id")
    return events.groupBy(F.col("event_type").alias("ticker"), F.date_trunc(unit, "ts").alias("time")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").cast("double").alias("volume")
    )


def with_properties(events: DataFrame) -> DataFrame:
    """events with k, the number in the props."""
    return events.withColumn("k", F.from_json("props", "k int")["k"])


def accumulate(bars: DataFrame, path: str, checkpoint: str):
    """Appends arriving bars to a table partitioned by month, each (ticker, date) once and only if later than what the table has.

    Returns the query, which handles what is there and stops. A batch that is run again adds nothing.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(["ticker", "date"]).withColumn("month", F.date_format("date", "yyyy-MM"))
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            known = spark.read.parquet(path).groupBy("ticker").agg(F.max("date").alias("latest"))
            rows = rows.join(known, "ticker", "left").where("latest is null or date > latest").drop("latest")
        rows.write.mode("append").partitionBy("month").parquet(path)

    return bars.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """The result of a stream after all that is there now, as a table in memory; for tests and small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
