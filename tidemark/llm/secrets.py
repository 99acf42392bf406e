r"""Secret scans with an incremental ledger of blobs.

Every text that a path ever had is a blob, named by the SHA-256 of its bytes. A ledger keeps, for each
blob, which versions of which rules have seen it and what they found. A scan takes the pairs of blob and
rule version that aren't in the ledger, reads each blob once however many paths have it, adds a row for
each to the ledger, and joins the findings of the rules as they are now back to all paths.

All of it is DataFrame operations. Places of matches come from the pieces that a pattern splits a text
into, and the matches between them, by running sums of their lengths.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import written


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches count if the given group has `least` characters; may_match is a cheap test that all texts with a match pass."""

    name: str
    pattern: str
    may_match: Callable[[Column], Column]
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


def _any_of(*words: str) -> Callable[[Column], Column]:
    def test(text: Column) -> Column:
        lowered, found = F.lower(text), F.lit(False)
        for word in words:
            found = found | F.contains(lowered, F.lit(word))
        return found

    return test


def _has(*words: str) -> Callable[[Column], Column]:
    def test(text: Column) -> Column:
        found = F.lit(True)
        for word in words:
            found = found & F.contains(text, F.lit(word))
        return found

    return test


NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _any_of(*NAMES), group=2, least=6),
    # Greedy runs with a bound match just where runs that are measured afterwards would be kept.
    Rule("access", r"AKIA[A-Z0-9]{16,}", _has("AKIA")),
    Rule("hex", r"[0-9a-f]{24,}", lambda text: text.rlike("[0-9a-f]{24}")),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", _has("PRIVATE KEY-----")),
    Rule("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}", _has("gh", "_")),
    Rule("slack", r"\bxox[abeoprs]-[A-Za-z0-9-]{10,}", _has("xox")),
    Rule("web_token", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*", _has("eyJ", ".")),
    Rule("url_login", r"://[^\s/:@]{1,256}:[^\s/:@]{1,256}@", _has("://", "@")),
)
RULES = BASE + MORE
SPANS = "array<struct<start: bigint, rank: int, rule: string, end: bigint>>"


def _matches(rule: Rule, rank: int, wanted: Column, text: Column) -> Column:
    """The pieces, matches and measured groups of a rule in a text; null if it isn't wanted or can't match."""
    pattern = F.lit(rule.pattern)
    found = F.struct(
        F.lit(rule.name).alias("rule"),
        F.lit(rank).alias("rank"),
        F.lit(rule.least).alias("least"),
        F.arrays_zip(
            F.split(text, rule.pattern, -1).alias("gap"),
            F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"),
            F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("measured"),
        ).alias("parts"),
    )
    return F.when(F.array_contains(wanted, rule.key) & rule.may_match(text), found)


def _spans(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """blob, spans: what the wanted rules find. blobs: blob, text, unseen (keys of wanted rules)."""
    each = F.array(*(_matches(rule, i, F.col("unseen"), F.col("text")) for i, rule in enumerate(rules)))
    rows = blobs.select("blob", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("m"))
    rows = rows.select("blob", "m.rule", "m.rank", "m.least", F.posexplode("m.parts").alias("i", "part")).where("part.hit is not null")
    rows = rows.select("blob", "rule", "rank", "least", "i", F.length("part.gap").alias("gap"), F.length("part.hit").alias("hit"), F.length("part.measured").alias("measured"))
    upto = W.partitionBy("blob", "rank").orderBy("i").rowsBetween(W.unboundedPreceding, 0)  # the matches of one rule in one text
    end = F.sum(F.col("gap") + F.col("hit")).over(upto)
    rows = rows.withColumn("end", end).where("measured >= least")
    span = F.struct((F.col("end") - F.col("hit")).alias("start"), "rank", "rule", "end")
    return rows.groupBy("blob").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Findings of every row of versions, and the rows that the ledger gains.

    versions: a row for each version of each path, with its text; a null text is an empty blob. The
    first result has the columns of versions but the text, and blob and spans: (start, rank, rule, end),
    in code points, end exclusive, by start and then the order of rules; each rule's matches are the
    leftmost that don't overlap, less those too short. Columns of versions named blob or spans are
    replaced. The second result has blob, scanned (keys of rules) and spans; append it to the ledger.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rest = [c for c in versions.columns if c not in (text, "blob", "spans")]
    paths = written(versions.select(*rest, F.sha2(body, 256).alias("blob")), "secrets-paths")
    keys = F.array(*(F.lit(rule.key) for rule in rules))
    blobs = paths.select("blob").distinct()
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.flatten(F.collect_list("scanned")).alias("scanned"))
        blobs = blobs.join(seen, "blob", "left").select("blob", F.array_except(keys, F.coalesce("scanned", F.array().cast("array<string>"))).alias("unseen"))
        blobs = blobs.where(F.size("unseen") > 0)
    else:
        blobs = blobs.withColumn("unseen", keys)
    may = F.lit(False)
    for rule in rules:
        may = may | rule.may_match(F.col("text"))
    texts = versions.select(body.alias("text")).where(may).select(F.sha2("text", 256).alias("blob"), "text").dropDuplicates(["blob"])
    blobs = written(blobs, "secrets-unseen")
    found = _spans(texts.join(blobs, "blob"), rules)
    none = F.array().cast(SPANS)
    gained = written(blobs.join(found, "blob", "left").select("blob", F.col("unseen").alias("scanned"), F.coalesce(F.col("spans").cast(SPANS), none).alias("spans")), "secrets-ledger")
    if ledger is None:
        current = gained.where(F.size("spans") > 0).select("blob", "spans")
    else:
        valid = F.array(*(F.lit(rule.key) for rule in rules))
        every = ledger.select("blob", "scanned", "spans").unionByName(gained).where(F.size("spans") > 0)
        names = F.transform(F.array_intersect("scanned", valid), lambda k: F.substring_index(k, "@", 1))
        every = every.withColumn("spans", F.filter("spans", lambda s: F.array_contains(names, s["rule"])))
        current = written(every.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans")), "secrets-current")
    return paths.join(current, "blob", "left").select(*rest, "blob", F.coalesce("spans", none).alias("spans")), gained
