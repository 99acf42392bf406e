"""Programs of many outputs: rows of a table say from which file, by which steps, and under which name each is made.

A program is read into outputs with their sources, put in order (an output may be the source of another),
and run: a source that several outputs read is made once, as a table that their filters are pushed down to.
An output that can't be made is told with its reason and stops those that read it, and no others.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import shared_folder
from .filters import CONDITIONS, Step, applied, merged

NEEDED = ("Filename", "Step", "Action", "Column")
Source = DataFrame | Callable[[], DataFrame]


@dataclass(frozen=True)
class Output:
    """name; the steps for each source, by its name; a merge of several sources keeps the tickers that all have after their steps."""

    name: str
    steps: Mapping[str, Sequence[Step]]


@dataclass
class Made:
    """Tables by output, and the reason of each that couldn't be made."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    failed: dict[str, str] = field(default_factory=dict)


def _enabled(flags: Sequence[str]) -> bool:
    said = {f.strip().upper() for f in flags}
    return "TRUE" in said or "FALSE" not in said


def read(program: DataFrame) -> list[Output]:
    """The outputs of a program table, in its order. Programs are a few rows.

    Rows without a Filename, or with one that starts with #, are passed over. Rows of a File_id belong
    together; a File_id with several Filenames merges them, and where there is no File_id each Filename is
    an output. A File_id none of whose rows has a Generation of TRUE, and one has FALSE, is left out. The
    name is the first Output_id, else the Filename (or merged) with the File_id behind it.
    """
    if lacking := [c for c in NEEDED if c not in program.columns]:
        raise ValueError(f"a program needs {', '.join(lacking)}")
    names = [*NEEDED, *(c for c in ("File_id", "Generation", "Condition", "Value", "Logic", "Output_id") if c in program.columns)]
    rows = [{c: (r[c] or "").strip() for c in names} for r in program.select(*(F.col(c).cast("string") for c in names)).collect()]
    rows = [r for r in rows if r["Filename"] and not r["Filename"].startswith("#")]
    groups: dict[tuple, list[dict]] = {}
    for r in rows:
        file_id = r.get("File_id", "").removesuffix(".0")
        groups.setdefault((file_id, "" if file_id else r["Filename"]), []).append(r)
    outputs = []
    for (file_id, _), own in groups.items():
        if not _enabled([r.get("Generation", "") for r in own]):
            continue
        steps: dict[str, list[Step]] = {}
        for r in own:
            order = int(float(r["Step"])) if r["Step"] else 0
            steps.setdefault(r["Filename"], []).append(Step(r["Action"].lower(), r["Column"], r.get("Condition", "").lower(), r.get("Value", ""), r.get("Logic") or "AND", order))
        name = next((r["Output_id"] for r in own if r.get("Output_id")), None)
        base = next(iter(steps)) if len(steps) == 1 else "merged"
        outputs.append(Output(name or (f"{base}_f{file_id}" if file_id else base), steps))
    return outputs


def in_order(outputs: Sequence[Output]) -> list[Output]:
    """Outputs after those that they read; a circle of outputs is an error, as is a name that two have."""
    by_name = {o.name: o for o in outputs}
    if len(by_name) < len(outputs):
        raise ValueError("two outputs have one name")
    try:
        order = list(TopologicalSorter({o.name: [s for s in o.steps if s in by_name and s != o.name] for o in outputs}).static_order())
    except CycleError as e:
        raise ValueError(f"outputs read each other: {' -> '.join(e.args[1])}") from e
    return [by_name[n] for n in order]


def _checked(table: DataFrame, steps: Sequence[Step], name: str) -> DataFrame:
    """The steps' result; a step that names what the table lacks, or an unknown condition, is an error here."""
    for step in steps:
        if step.column not in table.columns:
            raise ValueError(f"{name} has no column {step.column}")
        if step.action == "filter" and step.condition not in CONDITIONS:
            raise ValueError(f"{step.condition or 'no condition'} for {step.column} of {name}")
    return applied(table, steps)


def run(spark: SparkSession, outputs: Sequence[Output], sources: Mapping[str, Source]) -> Made:
    """The outputs' tables. sources: tables by Filename, or how to get them; those that several outputs read are written once to the shared folder."""
    made, known = Made(), {}
    readers: dict[str, int] = {}
    for o in outputs:
        for s in o.steps:
            readers[s] = readers.get(s, 0) + 1

    def source(name: str) -> DataFrame:
        if name in made.failed:
            raise ValueError(f"{name} failed")
        if name not in known:
            if name in made.tables:
                table = made.tables[name]
            elif name in sources:
                table = sources[name] if isinstance(sources[name], DataFrame) else sources[name]()
            else:
                raise ValueError(f"there is no {name}")
            if readers[name] > 1:
                path = f"{shared_folder(spark)}-{len(known)}"
                table.write.parquet(path)
                table = spark.read.parquet(path)
            known[name] = table
        return known[name]

    for o in in_order(outputs):
        try:
            parts = {name: _checked(source(name), steps, name) for name, steps in o.steps.items()}
            table = merged(parts) if len(parts) > 1 else next(iter(parts.values()))
            table.schema  # noqa: B018  what can't be analysed fails here
            made.tables[o.name] = table
        except Exception as e:  # whatever an output's source raises is that output's failure, and told
            made.failed[o.name] = str(e)
    return made


def written(made: Made, folder: str) -> Made:
    """Each table as CSV with a header in folder/{output}, sorted as it is; one that fails while it is written joins the failed ones."""
    done = Made(failed=dict(made.failed))
    for name, table in made.tables.items():
        try:
            table.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
            done.tables[name] = table
        except Exception as e:
            done.failed[name] = str(e)
    return done


def listed(made: Made, columns: Sequence[str]) -> DataFrame | None:
    """output and the columns named of all tables, in one; a table's missing ones are null. None without tables."""
    every = None
    for name, table in made.tables.items():
        one = table.select(F.lit(name).alias("output"), *(F.col(c) if c in table.columns else F.lit(None).alias(c) for c in columns))
        every = one if every is None else every.unionByName(one)
    return every
