"""Tables that grow by batches, with a log of commits.

A batch is one or more tables, written to a folder of its own and then committed by one small file, which is
renamed into place. Readers see committed batches only, so that a run that dies between write and commit
leaves nothing behind: the next run with that batch writes its folder again. A batch that is committed
already adds nothing. Columns that come later are null before; whole numbers widen to fractional ones.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DIGITS = 12


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder named in spark.checkpoint.dir; where none is set and all runs in one process, in one of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(found or _own_folder()).rstrip('/')}/{uuid.uuid4().hex}"


@cache
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='tidemark-')}"


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _entries(spark: SparkSession, path: str) -> list[dict]:
    """What the log has: an entry for each batch after the last compaction, which is one too, in order."""
    fs, where = _at(spark, f"{path}/commits")
    if not fs.exists(where):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(where) if s.getPath().getName().endswith(".json"))
    compact = max((n for n in names if n.startswith("upto-")), default=None)
    last = int(compact[5:-5]) if compact else -1
    read = lambda name: json.loads("".join(r.value for r in spark.read.text(f"{path}/commits/{name}").collect()))  # noqa: E731  one small file
    return [read(n) for n in ([compact] if compact else []) + [n for n in names if n[0].isdigit() and int(n[:-5]) > last]]


def committed(spark: SparkSession, path: str, batch: int) -> bool:
    fs, where = _at(spark, f"{path}/commits/{batch:0{DIGITS}d}.json")
    return fs.exists(where) or any(e["upto"] >= batch for e in _entries(spark, path) if "upto" in e)


def _commit(spark: SparkSession, path: str, name: str, entry: dict) -> None:
    fs, where = _at(spark, f"{path}/commits/{name}.json")
    _, draft = _at(spark, f"{path}/commits/.{name}-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    if not fs.rename(draft, where):
        raise OSError(f"{where.toString()} can't be written")


def append(tables: Mapping[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]] | DataFrame, path: str, batch: int) -> bool:
    """Adds the tables of a batch, all or none; False, and nothing added, if the batch is committed already. Batches are whole numbers from 0; one writer adds them.

    A table may be a function of those before it, by name, as they were written: they aren't made again for it.
    """
    tables = {"rows": tables} if isinstance(tables, DataFrame) else tables
    spark = next(iter(tables.values())).sparkSession
    if any("batch" in t.columns for t in tables.values() if isinstance(t, DataFrame)):
        raise ValueError("batch is the name of a column of the log's own")
    if committed(spark, path, batch):
        return False
    made: dict[str, DataFrame] = {}
    for name, table in tables.items():
        folder = f"{path}/{name}/batch={batch:0{DIGITS}d}"
        table = table if isinstance(table, DataFrame) else table(made)
        table.write.mode("overwrite").option("compression", "zstd").parquet(folder)
        made[name] = spark.read.parquet(folder)
    schemas = {name: table.schema.jsonValue() for name, table in made.items()}
    _commit(spark, path, f"{batch:0{DIGITS}d}", {"batch": batch, "schemas": schemas})
    return True


def read(spark: SparkSession, path: str, name: str = "rows") -> DataFrame | None:
    """The rows of all committed batches, with `batch`; None before the first. Batches of one schema are read together."""
    groups: dict[str, list[dict]] = {}
    for entry in _entries(spark, path):
        if name in entry["schemas"]:
            groups.setdefault(json.dumps([entry["schemas"][name], "upto" in entry]), []).append(entry)
    parts = []
    for key, entries in groups.items():
        schema, whole = json.loads(key)
        kind = StructType.fromJson(schema)
        if whole:
            parts.append(spark.read.schema(kind).parquet(*(f"{path}/{name}/upto={e['upto']:0{DIGITS}d}" for e in entries)).select(*kind.names))
        else:
            folders = [f"{path}/{name}/batch={e['batch']:0{DIGITS}d}" for e in entries]
            rows = spark.read.schema(kind.add("batch", "long")).option("basePath", f"{path}/{name}").parquet(*folders)
            parts.append(rows)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


def current(spark: SparkSession, path: str, keys: Sequence[str], name: str = "rows") -> DataFrame | None:
    """Of each key the row of its last batch, without `batch`."""
    rows = read(spark, path, name)
    if rows is None:
        return None
    rest = [c for c in rows.columns if c not in {*keys, "batch"}]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def compacted(spark: SparkSession, path: str) -> int:
    """Writes all committed batches as one and returns the last one's number; readers take that from then on, and batches up to it stay committed."""
    entries = _entries(spark, path)
    last = max((e.get("batch", e.get("upto")) for e in entries), default=-1)
    if last < 0 or entries == [e for e in entries if "upto" in e]:
        return last
    schemas = {}
    for name in {n for e in entries for n in e["schemas"]}:
        folder = f"{path}/{name}/upto={last:0{DIGITS}d}"
        read(spark, path, name).write.mode("overwrite").option("compression", "zstd").parquet(folder)
        schemas[name] = spark.read.parquet(folder).schema.jsonValue()
    _commit(spark, path, f"upto-{last:0{DIGITS}d}", {"upto": last, "schemas": schemas})
    return last
