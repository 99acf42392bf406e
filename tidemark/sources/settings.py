"""Settings and files: run settings from text, and the latest or matching files of a folder."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import SparkSession

YES, NO = {"true", "yes", "1", "on"}, {"false", "no", "0", "off"}


def yes(text: str) -> bool:
    if text.strip().lower() not in YES | NO:
        raise ValueError(f"{text!r} is neither yes nor no")
    return text.strip().lower() in YES


def settings(lines: Iterable[str], kinds: Mapping[str, Callable[[str], object]] | None = None) -> dict[str, object]:
    """Values by name from lines of name,value,description.

    Lines that start with # and empty ones are passed over. Of a line with more than two commas the parts
    between the first and the last are the value, joined by semicolons. kinds has how to read some names;
    others stay text. A line without a value, and a value that can't be read, is an error with its number.
    """
    found: dict[str, object] = {}
    for number, line in enumerate(lines, 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        name, *parts = (x.strip() for x in line.rstrip("\n").split(","))
        if not parts:
            raise ValueError(f"line {number}: {name!r} has no value")
        value = ";".join(x for x in parts[:-1] if x) if len(parts) > 2 else parts[0]
        if name.lower() == "variable" and not found:
            continue  # the header
        try:
            found[name] = (kinds or {}).get(name, str)(value)
        except ValueError as e:
            raise ValueError(f"line {number}: {name}: {e}") from e
    return found


def files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the files in a folder, in order."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return sorted(s.getPath().toString() for s in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where) if s.isFile())


def latest_file(paths: Iterable[str], name: str, routes: Mapping[str, str] | None = None) -> str | None:
    """The path of a logical name with the last date (eight digits before the ending); routes has patterns, with * for the date, of names that aren't their file's start."""
    pattern = (routes or {}).get(name, f"{name}_*")
    dated = [(m[1], p) for p in paths if fnmatch.fnmatch(p.rpartition("/")[2], f"{pattern}*" if "*" not in pattern else f"{pattern}") and (m := re.search(r"(\d{8})(?=\.\w+$)", p))]
    return max(dated, default=(None, None))[1]


def discovered(paths: Iterable[str], rules: Mapping[str, Iterable[str]]) -> dict[str, str]:
    """Rule by path: the first rule one of whose patterns fits the file's name; files that fit none are left out."""
    found = {}
    for path in paths:
        for rule, patterns in rules.items():
            if any(fnmatch.fnmatch(path.rpartition("/")[2], p) for p in patterns):
                found[path] = rule
                break
    return found
