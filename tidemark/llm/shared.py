"""Tables and folders that every executor and the driver can see."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch on its way to a Python worker, where the session sets none: whole texts vary too much for a number of rows.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: Seconds between requests to collect garbage, and when the last was.
COLLECT_S, _collected = 1.0, [0.0]


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where none is set and all runs in one process, as in tests, one of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or _own_dir()).rstrip("/")


@cache
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='tidemark-')}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Parquet's writer with these looks at the size of what it holds after each row, for tables of few very large rows.
LARGE_ROWS = {"parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and lost executors don't matter.

    Shuffle files of the steps before it aren't needed any more; Spark's cleaner removes them once
    the driver has collected its garbage, so that is asked for here every few seconds. Batches for Python
    workers get a bound in bytes, unless the session has one.
    """
    spark = df.sparkSession
    if BATCH not in spark.conf.getAll:
        spark.conf.set(BATCH, BATCH_BYTES)
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    del df
    if time.monotonic() - _collected[0] > COLLECT_S:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _collected[0] = time.monotonic()
    table = spark.read.parquet(path)
    table._tidemark_path = path
    return table


def filtered(docs: DataFrame, function) -> DataFrame:
    """docs.mapInArrow for functions that keep or leave out rows: columns may have any names, dots too, as functions see them by their places."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(function, plain.schema).toDF(*docs.columns)


def small(table: DataFrame, rows: int = 100_000) -> DataFrame:
    """A written table, to be broadcast if it has few rows, else as it is, for Spark to join as it likes."""
    return F.broadcast(table) if table.count() <= rows else table


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by written() that no later result reads."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._tidemark_path)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
