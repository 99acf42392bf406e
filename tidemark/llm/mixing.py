"""Mixing sources to target weights.

Tokens are summed up per source, a target per source gives a repetition rate, and each document is
emitted floor(rate) times, plus once more if a number in [0, 1) hashed from its doc_id and a seed is
below the rate's fraction. The mix is the same in every run and on every cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import written

WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of the hash that make a number in [0, 1), which a double holds exactly.
DIGITS = 13


def hashed(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) for each doc_id; a null doc_id has one as well."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """source, source_size, target. sizes: source, source_size, a row for each source.

    Sources by code point, null last, weigh weights, repeating. They share `share` times all sizes by
    weight; a target stops at `most` times its source's size, and the excess is shared again by weight
    among the others until none is above.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())  # a row for each source, not for each document
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    table = written(sizes.select("source", "source_size", weight.cast("double").alias("weight"), (F.col("source_size") * most).alias("ceiling")), "mix-sources")
    budget = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        above = F.col("ceiling") <= F.col("weight") * level
        got = table.agg(
            F.count_if(above).alias("full"),
            F.coalesce(F.sum(F.when(above, F.col("ceiling"))), F.lit(0.0)).alias("taken"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("weight"),
        ).first()
        if got["full"] == full or not got["weight"]:
            break
        full, level = got["full"], (budget - got["taken"]) / got["weight"]
    return table.select("source", "source_size", F.least("ceiling", F.col("weight") * level).alias("target"))


def mixed(docs: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0, seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with five more columns: mix_size, mix_source_size, mix_target, mix_rate and mix_copies.

    mix_size is the number of words (a null text has none), mix_copies how often the mix takes the
    document. A source without words has target and rate 0. Rows with equal doc_ids share a hash and
    so a decision. Columns of docs with these names are replaced; other columns, whatever their names,
    stay. An empty table gives an empty result.
    """
    own = ["mix_size", "mix_source_size", "mix_target", "mix_rate", "mix_copies"]
    rated = _rated(docs, weights, share, most, seed, doc_id, text, source)
    return rated.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in own), *own)


def _rated(docs: DataFrame, weights: list[float], share: float, most: float, seed: int, doc_id: str, text: str, source: str) -> DataFrame:
    """row (all columns of docs), mix_size, mix_source_size, mix_target, mix_rate, mix_copies."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = docs.select(F.col(source).alias("source"), size.alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, most).select(F.col("source").alias("mix_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("mix_doc_id"), F.col(source).alias("mix_own_source"), size.alias("mix_size"))
    rate = F.coalesce(F.try_divide("mix_target", "mix_source_size"), F.lit(0.0))
    whole = F.floor("mix_rate")
    once_more = (hashed(F.col("mix_doc_id"), seed) < F.col("mix_rate") - whole).cast("long")
    rows = rows.join(targets, rows["mix_own_source"].eqNullSafe(targets["mix_source"])).withColumn("mix_rate", rate).withColumn("mix_copies", whole + once_more)
    return rows.select("row", "mix_size", "mix_source_size", "mix_target", "mix_rate", "mix_copies")


def mix(docs: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0, seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs, whatever their names."""
    rated = _rated(docs, weights, share, most, seed, doc_id, text, source)
    return rated.select("row", F.explode(F.array_repeat(F.lit(1), F.col("mix_copies").cast("int")))).select(*(F.col("row")[c].alias(c) for c in docs.columns))
