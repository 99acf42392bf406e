"""Ranked lexical search over dual-sorted wavelet trees, a tree a shard.

A shard is the index of the documents that one task reads in a row. Its postings stand in one sequence:
term by term, each term's by falling impact. A wavelet tree over that sequence splits it level by level
by the documents' ordinals (in order of doc_id), each time keeping the order within. So a term's postings
are a range in every node of the tree, the node's documents are a range of doc_ids, and the first posting
of a term's range has the term's largest impact among these documents.

A query walks the tree from the best node on: the sum of its terms' first impacts bounds the score of every
document below a node, and at a leaf it is the score. Nodes that can't reach the k-th best leaf are never
opened, which makes the result exact. Nodes are opened many at a time, as arrays.

The score is that of op12's contract (whole numbers throughout): an impact depends on the document and on
the corpus, a weight on the term, so impacts are stored and weights are applied to a query's terms.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import LARGE_ROWS, dropped, written
from .words import WordHashes, folded, given_back, sliced

#: Bytes of text and documents of a shard, at most (a longer text is a shard alone); bytes of queries that tasks hold at once.
SHARD_BYTES, SHARD_DOCS, QUERY_BYTES = 4 << 20, 1 << 14, 4 << 20
#: Nodes that are opened together.
NODES = 128
INDEX = "doc_ids binary, nulls binary, terms binary, starts binary, bits binary, impacts binary"


@dataclass(frozen=True)
class Index:
    """Shards in a table, with the number of documents that have terms and of all their terms."""

    shards: DataFrame
    documents: int
    terms: int


def impact(tf: np.ndarray, length_norm: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * length_norm)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (documents, terms): how many texts of a task have terms, and how many terms."""
    documents = terms = 0
    for batch in sliced(batches):
        for text in batch.column("text"):
            n = len(folded(text.as_py()))
            documents += n > 0
            terms += n
    yield pa.RecordBatch.from_arrays([pa.array([documents], pa.int64()), pa.array([terms], pa.int64())], ["documents", "terms"])


def _shard(ids: list[int | None], terms: list[np.ndarray], counts: list[np.ndarray], lengths: list[int], documents: int, all_terms: int) -> dict[str, bytes]:
    """The index of some documents: terms and counts of each, and their lengths."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    owner = np.repeat(np.arange(len(ids)), [len(terms[i]) for i in order])
    norm = np.array([25 + 75 * lengths[i] * documents // all_terms for i in order], np.int64)
    term, count = (np.concatenate([x[i] for i in order]) for x in (terms, counts))
    of = impact(count, norm[owner])
    by = np.lexsort((owner, -of, term))
    term, owner, of = term[by], owner[by], of[by].astype(np.int32)
    starts = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    bits, here = [], owner
    for level in reversed(range(max(1, (len(ids) - 1).bit_length()))):
        one = (here >> level & 1).astype(bool)
        bits.append(np.packbits(one).tobytes())
        here = np.concatenate((here[~one], here[one]))
    return {
        "doc_ids": np.array([ids[i] or 0 for i in order], np.int64).tobytes(), "nulls": np.array([ids[i] is None for i in order]).tobytes(),
        "terms": term[starts].tobytes(), "starts": starts.astype(np.int32).tobytes(), "bits": b"".join(bits), "impacts": of.tobytes(),
    }


def _indexed(documents: int, all_terms: int, most_bytes: int, most_docs: int):
    """(doc_id, text) -> shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        ids, terms, counts, lengths, size = [], [], [], [], 0

        def shard() -> pa.RecordBatch:
            made = _shard(ids, terms, counts, lengths, documents, all_terms)
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in made.values()], list(made))

        for batch in sliced(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = folded(text.as_py())
                if not words:
                    continue
                own = sum(map(len, words)) + len(words)
                if ids and (size + own > most_bytes or len(ids) == most_docs):
                    yield shard()
                    ids, terms, counts, lengths, size = [], [], [], [], 0
                term, count = np.unique(hashes.of(words), return_counts=True)
                ids.append(doc_id)
                terms.append(term)
                counts.append(count)
                lengths.append(len(words))
                size += own
        if ids:
            yield shard()

    return run


def indexed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> Index:
    """The index of all docs, as a table in the shared folder. Texts without terms are in no shard; repeated rows are documents of their own."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    documents, terms = rows.select("text").mapInArrow(_lengths, "documents long, terms long").agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    return Index(written(rows.mapInArrow(_indexed(documents, terms, shard_bytes, shard_docs), INDEX), "search-shards", **LARGE_ROWS), documents, terms)


class Tree:
    """A shard, opened for queries."""

    def __init__(self, row: dict[str, bytes]) -> None:
        self.doc_ids, self.nulls = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["nulls"], bool)
        self.terms, starts = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["starts"], np.int32)
        impacts = np.frombuffer(row["impacts"], np.int32)
        n = len(impacts)
        self.starts = np.append(starts, n).astype(np.int32)
        self.levels = max(1, (len(self.doc_ids) - 1).bit_length())
        # zeros[level, i]: postings before i that go to the left child. impacts[level, i]: the impact of the i-th posting of a level.
        self.zeros = np.zeros((self.levels, n + 1), np.int32)
        self.impacts = np.zeros((self.levels + 1, n + 1), np.int32)
        self.impacts[0, :n] = impacts
        packed = np.frombuffer(row["bits"], np.uint8).reshape(self.levels, -1)
        for level in range(self.levels):
            one = np.unpackbits(packed[level], count=n).astype(bool)
            np.cumsum(~one, out=self.zeros[level, 1:])
            impacts = np.concatenate((impacts[~one], impacts[one]))
            self.impacts[level + 1, :n] = impacts

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, ordinal) of the k best documents for distinct terms and their weights, best first, equal scores by ordinal."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        here = (self.terms[at] == terms) & (weights > 0)
        at, weights = at[here], weights[here]
        if not len(at):
            return []
        levels, firsts = np.zeros(1, np.int64), np.zeros(1, np.int64)  # of each open node: its level, and its first document
        low, high = self.starts[at][None].astype(np.int64), self.starts[at + 1][None].astype(np.int64)
        bounds = self._bounds(levels, low, high, weights)
        found: list[tuple[int, int]] = []
        while len(levels):
            if len(bounds) > NODES:
                order = np.argpartition(-bounds, NODES)
                now, later = order[:NODES], order[NODES:]
            else:
                now, later = np.arange(len(bounds)), np.empty(0, np.int64)
            level, first, lo, hi = levels[now], firsts[now], low[now], high[now]
            left_lo, left_hi = self.zeros[level[:, None], lo], self.zeros[level[:, None], hi]
            ones = self.zeros[level, -1][:, None]
            children = np.concatenate((left_lo, lo - left_lo + ones)), np.concatenate((left_hi, hi - left_hi + ones))
            level = np.tile(level + 1, 2)
            first = np.concatenate((first, first + (1 << (self.levels - level[: len(now)]))))
            bound = self._bounds(level, *children, weights)
            leaf = level == self.levels
            found += zip(bound[leaf & (bound > 0)].tolist(), first[leaf & (bound > 0)].tolist())
            found = sorted(found, key=lambda f: (-f[0], f[1]))[:k]
            keep = np.flatnonzero(~leaf & (bound > 0))
            levels, firsts, bounds = (np.concatenate((x[later], y[keep])) for x, y in ((levels, level), (firsts, first), (bounds, bound)))
            low, high = (np.concatenate((x[later], y[keep])) for x, y in ((low, children[0]), (high, children[1])))
            if len(found) == k:
                score, ordinal = found[-1]
                keep = (bounds > score) | (bounds == score) & (firsts < ordinal)
                levels, firsts, bounds, low, high = (x[keep] for x in (levels, firsts, bounds, low, high))
        return found

    def _bounds(self, levels: np.ndarray, low: np.ndarray, high: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return np.where(high > low, self.impacts[levels[:, None], low], 0).astype(np.int64) @ weights


def _frequencies(vocabulary):
    """(terms, starts, n) -> (term, df) of the terms of the vocabulary in a task's shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = vocabulary.value
        df = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for terms, starts, n in zip(batch.column("terms"), batch.column("starts"), batch.column("n").to_pylist()):
                terms = np.frombuffer(terms.as_py(), np.uint64)
                sizes = np.diff(np.append(np.frombuffer(starts.as_py(), np.int32), n))
                at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
                df += np.where(terms[at] == wanted, sizes[at], 0)
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[there].view(np.int64)), pa.array(df[there])], ["term", "df"])

    return run


def _answered(queries, k: int):
    """Shards -> (query, doc_id, score): each shard's k best documents of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                tree = Tree({c: batch.column(c)[i].as_py() for c in batch.schema.names})
                query, ids, scores = [], [], []
                for number, terms, weights in queries.value:
                    for score, ordinal in tree.best(terms, weights, k):
                        query.append(number)
                        ids.append(None if tree.nulls[ordinal] else int(tree.doc_ids[ordinal]))
                        scores.append(score)
                del tree
                yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], ["query", "doc_id", "score"])
            given_back()

    return run


def searched(index: Index, items: DataFrame, k: int = 10, item_id: str = "item_id", item_text: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best documents of each item, of those with a score above 0.

    Equal scores stand by doc_id, a null one last. Items are a stated set of queries: up to query_bytes of
    them are searched at once, each time over all shards. A null or empty item finds nothing; items with
    equal ids are searched each by itself. item_ids keep their type.
    """
    spark = items.sparkSession
    own = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = -(-size * 5 // (4 * query_bytes)) if size > query_bytes else 1
    every = None
    for part in range(parts):
        rows = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()  # up to some query_bytes
        hashes = WordHashes()
        asked = [np.unique(hashes.of(folded(r.text)), return_counts=True) for r in rows]
        wanted = np.unique(np.concatenate([np.empty(0, np.uint64), *(terms for terms, _ in asked)]))
        shared = spark.sparkContext.broadcast(wanted)
        counted = index.shards.select("terms", "starts", F.expr("cast(octet_length(impacts) / 4 as int)").alias("n"))
        df = {r.term: r.df for r in counted.mapInArrow(_frequencies(shared), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}  # terms of the queries
        weights = {t: weight(index.documents, df[t]) for t in df}
        queries = []
        for number, (terms, counts) in enumerate(asked):
            there = np.array([t in weights for t in terms.view(np.int64).tolist()], bool)
            own_weights = np.array([weights[t] for t in terms[there].view(np.int64).tolist()], np.int64)
            queries.append((number, terms[there], own_weights * counts[there]))
        found = index.shards.mapInArrow(_answered(spark.sparkContext.broadcast(queries), k), "query long, doc_id long, score long")
        numbers = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"query long, item_id {own.schema['item_id'].dataType.simpleString()}")
        best = found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= k)
        named = best.join(F.broadcast(numbers), "query").select("item_id", "rank", "doc_id", "score")
        every = named if every is None else every.unionByName(named)
    return every


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """item_id, rank, doc_id and score: docs are indexed, then searched for the items. Null and empty texts are found by nothing; doc_ids are cast to long; other columns are not read."""
    index = indexed(docs, doc_id, text)
    found = written(searched(index, items, k, **settings), "search-found")
    dropped(index.shards)
    return found
