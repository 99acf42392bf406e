"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into segments of up to BLOCK words, texts into blocks of BLOCK words; two
neighbouring blocks are a passage, so that each place that a segment may stand is within one. A passage
is a vector of TF-IDF weights of the terms that segments use, without those that are in many blocks. A
randomised SVD of all blocks gives a latent space of few dimensions: each round multiplies the matrix,
its transpose and a thin matrix, as sums by term over all partitions, of which only a matrix with a row
for each benchmark term reaches the driver. Passages whose cosine with a segment is high are candidates; so
are those that hold GRAM words of a segment in a row, which finds copies that the space represents badly.
A candidate counts if the longest common subsequence of words covers most of the segment, or half of it and of its
terms of weight, or, for paraphrases, a good part of it and the item's answer as well.

The benchmark is a stated set of queries. Every task holds up to MAX_BYTES of it; a larger one is searched
in parts, each with a space of its own. For each part the corpus is read twice and not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, filtered, written
from .words import STEP, folded, sliced

#: Words of a block and most of a segment; latent dimensions (as many as segments, within bounds), with some more while they are sought.
BLOCK, LEAST_RANK, RANK, SPARE, ROUNDS = 64, 64, 192, 16, 2
#: Words in a row that make a passage a candidate.
GRAM = 4
#: Bytes of benchmark texts that a task holds; passages and queries compared at a time.
MAX_BYTES, PASSAGES, AT_A_TIME = 4 << 20, 4096, 2048


@dataclass(frozen=True)
class Limits:
    """max_share: a term in more of all blocks than this says nothing, but for the `rarest` terms of each
    segment, so that one that is copied very often or has only common words can be found too. cosine: of
    candidates. copied: share of a segment in the common subsequence that counts by itself. reworded: share of
    it, and of its terms of weight alone, that counts if it is `fewest` words or all of a shorter segment: common words, of
    which any long text has many in order, don't make a find. paraphrased: share that counts if `answered` of the answer is there as well."""

    max_share: float = 0.002
    rarest: int = 8
    cosine: float = 0.25
    copied: float = 0.75
    reworded: float = 0.5
    fewest: int = 8
    paraphrased: float = 0.4
    answered: float = 0.7


class Terms(dict):
    """Numbers of terms; other words are -1."""

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.get, words, repeat(-1)), np.int32, len(words))


@dataclass
class Benchmark:
    items: list[int]  # of each segment
    words: list[list[bytes]]
    answers: list[list[bytes]]  # words of the item's answer, if it has one
    terms: Terms
    places: list[dict[bytes, int]]  # bits_of() each segment
    telling: list[list[bytes]]  # each segment's terms of weight, in order


def segments(rows: list[tuple]) -> Benchmark:
    """rows: item_id, text, answer (or None)."""
    found = Benchmark([], [], [], Terms(), [], [])
    for item, text, answer in rows:
        words = folded(text)
        n = -(-len(words) // BLOCK)
        for i in range(n):
            part = words[i * len(words) // n : (i + 1) * len(words) // n]
            found.items.append(item)
            found.words.append(part)
            found.places.append(bits_of(part))
            found.answers.append(folded(answer))
    for word in sorted({w for words in found.words for w in words}):
        found.terms[word] = len(found.terms)
    return found


def _occurrences(shared):
    """(text) -> (blocks, block, term): each text's number of blocks, and the benchmark terms in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value.terms
        for batch in sliced(batches):
            n, blocks, ids = [], [], []
            for text in batch.column("text").cast(pa.binary()):
                found = terms.of(folded(text.as_py()))
                at = np.flatnonzero(found >= 0)
                n.append(-(-len(found) // BLOCK))
                blocks.append(at // BLOCK)
                ids.append(found[at])
            offsets = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else [], pa.int32())) for x in (blocks, ids)]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), *lists], ["blocks", "block", "term"])

    return run


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Block numbers that differ between texts, and terms."""
    terms = batch.column("term")
    lengths = pa.compute.list_value_length(terms).to_numpy()
    first = np.cumsum(batch.column("blocks").to_numpy()) - batch.column("blocks").to_numpy()
    return batch.column("block").flatten().to_numpy() + np.repeat(first, lengths), terms.flatten().to_numpy().astype(np.int64)


def _block_counts(size: int):
    """-> (term, n): blocks with each term; term -1: all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(size, np.int64), 0
        for batch in batches:
            block, term = _flat(batch)
            n += np.bincount(np.unique(block * size + term) % size, minlength=size)
            total += int(batch.column("blocks").to_numpy().sum())
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some]), pa.array([total, *n[some]])], ["term", "n"])

    return run


def _gram(block: np.ndarray, term: np.ndarray, weights: np.ndarray, thin: np.ndarray, total: np.ndarray) -> None:
    """Adds a block matrix, transposed, times itself, times thin, to total, but for the last weights. block (in order) and term: of each occurrence."""
    heavy = weights[term] > 0
    block, term = block[heavy], term[heavy]
    if len(block):
        starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        rows = np.add.reduceat(thin[term] * weights[term][:, None], starts, axis=0)
        row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(block))))
        order = np.argsort(term, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(term[order]) > 0))
        total[term[order][first]] += np.add.reduceat(rows[row[order]], first, axis=0)


def _times(shared):
    """-> (term, z): rows of this partition's share of the product."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thin = shared.value
        total = np.zeros(thin.shape)
        for batch in sliced(batches):
            _gram(*_flat(batch), weights, thin, total)
        total *= weights[:, None]
        some = np.flatnonzero(np.abs(total).sum(axis=1))
        width = pa.array(np.arange(len(some) + 1) * total.shape[1], pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.ListArray.from_arrays(width, pa.array(total[some].ravel()))], ["term", "z"])

    return run


def _product(occurrences: DataFrame, own: tuple[np.ndarray, np.ndarray], weights: np.ndarray, thin: np.ndarray) -> np.ndarray:
    """The block matrix, transposed, times itself, times thin; own: occurrences in the benchmark's segments, which count as blocks."""
    shared = occurrences.sparkSession.sparkContext.broadcast((weights, thin))
    parts = occurrences.mapInArrow(_times(shared), "term long, z array<double>")
    sums = parts.groupBy("term").agg(F.array(*(F.sum(F.col("z")[k]) for k in range(thin.shape[1]))).alias("z")).toArrow()  # a row for each benchmark term, as arrays
    total = np.zeros(thin.shape)
    _gram(*own, weights, thin, total)
    total *= weights[:, None]
    if len(sums):
        total[sums.column("term").to_numpy()] += pa.compute.list_flatten(sums.column("z")).to_numpy().reshape(-1, total.shape[1])
    return total


@dataclass
class Space:
    benchmark: Benchmark
    latent: np.ndarray  # latent vector of each term, times its weight
    heavy: np.ndarray  # which terms have weight
    queries: np.ndarray  # of each segment, of length 1; 0 for those without a term of weight
    limits: Limits
    grams: np.ndarray  # hashes of GRAM terms in a row, in order, and the segment of each
    gram_segments: np.ndarray


def _gram_hashes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where GRAM terms stand in a row, and a hash of them."""
    if len(ids) < GRAM:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    broken = np.cumsum(np.append(0, ids < 0))
    at = np.flatnonzero(broken[GRAM:] == broken[:-GRAM])
    hashes = np.zeros(len(at), np.uint64)
    for i in range(GRAM):
        hashes = hashes * STEP + ids[at + i].astype(np.uint64) + np.uint64(1)
    return at, hashes


def latent_space(docs: DataFrame, benchmark: Benchmark, limits: Limits, text: str = "text") -> Space:
    size = len(benchmark.terms)
    shared = docs.sparkSession.sparkContext.broadcast(benchmark)
    occurrences = written(docs.select(F.col(text).alias("text")).mapInArrow(_occurrences(shared), "blocks long, block array<int>, term array<int>"), "leaks-terms")
    counted = dict(occurrences.mapInArrow(_block_counts(size), "term long, n long").groupBy("term").agg(F.sum("n")).collect())  # a row for each benchmark term
    total = counted.pop(-1, 0) + len(benchmark.words)
    segment = np.repeat(np.arange(len(benchmark.words)), list(map(len, benchmark.words)))
    own = segment, np.concatenate(list(map(benchmark.terms.of, benchmark.words)))
    n = np.bincount(np.unique(own[0] * size + own[1]) % size, minlength=size).astype(float)
    n[list(counted)] += list(counted.values())
    telling = n <= max(limits.max_share * total, 50)
    for words in benchmark.words:
        mine = np.unique(benchmark.terms.of(words))
        telling[mine[np.argsort(n[mine], kind="stable")[: limits.rarest]]] = True
    weights = np.where(telling, np.log((total + 1) / n), 0.0)
    benchmark.telling = [[w for w in words if weights[benchmark.terms[w]]] for words in benchmark.words]
    wanted = min(max(len(benchmark.words), LEAST_RANK), RANK)
    rank = min(wanted + SPARE, size)
    thin = np.linalg.qr(np.random.default_rng(0).standard_normal((size, rank)))[0]
    for _ in range(ROUNDS):
        product = _product(occurrences, own, weights, thin)
        before, within = thin, thin.T @ product  # the space so far, and the squared matrix on it
        thin = np.linalg.qr(product)[0]
    dropped(occurrences)
    _, turn = np.linalg.eigh((within + within.T) / 2)  # in rising order
    basis = (before @ turn)[:, -min(wanted, rank) :]
    latent = (basis * weights[:, None]).astype(np.float32)
    queries = np.add.reduceat(latent[own[1]], np.flatnonzero(np.append(True, np.diff(segment))), axis=0)
    length = np.linalg.norm(queries, axis=1, keepdims=True)
    grams = [_gram_hashes(benchmark.terms.of(words))[1] for words in benchmark.words]
    hashes, of = np.concatenate(grams), np.repeat(np.arange(len(grams)), list(map(len, grams)))
    order = np.argsort(hashes, kind="stable")
    return Space(benchmark, latent, latent.any(axis=1), np.divide(queries, length, out=np.zeros_like(queries), where=length > 1e-9), limits, hashes[order], of[order])


def bits_of(words: list[bytes]) -> dict[bytes, int]:
    """Where each word stands, as bits of one integer."""
    places: dict[bytes, int] = {}
    for i, word in enumerate(words):
        places[word] = places.get(word, 0) | 1 << i
    return places


def common_subsequence(a: list[bytes], b: list[bytes], places: dict[bytes, int] | None = None) -> int:
    """Length of the longest common subsequence, by bits of one integer; places: bits_of(a), if they are known."""
    whole = (1 << len(a)) - 1
    row = whole
    for at in map((bits_of(a) if places is None else places).get, b):
        if at:  # a word that a lacks changes nothing
            hit = row & at
            row = ((row + hit) | (row - hit)) & whole
    return len(a) - row.bit_count()


def _checked(space: Space, segment: int, words: list[bytes], distinct: set[bytes]) -> float | None:
    """The share of a segment in the common subsequence with a passage, if that is a leak."""
    own, limits, answer = space.benchmark.words[segment], space.limits, space.benchmark.answers[segment]
    least = min(limits.copied, limits.reworded, limits.paraphrased if answer else 1.0)
    if sum(map(distinct.__contains__, own)) < least * len(own):
        return None  # no subsequence has more than the words that they share
    common = common_subsequence(own, words, space.benchmark.places[segment])
    share = common / len(own)
    if share >= limits.copied:
        return share
    if share >= limits.reworded and common >= min(limits.fewest, len(own)):
        telling = space.benchmark.telling[segment]
        if common_subsequence(telling, words) >= limits.reworded * len(telling):
            return share
    if answer and share >= limits.paraphrased and common_subsequence(answer, words) >= limits.answered * len(answer):
        return share
    return None


def _candidates(space: Space, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """passage, segment and cosine of candidates, by passages at a time. ids: terms of whole blocks; passage i is the blocks i and i + 1."""
    dimensions, blocks_there = space.latent.shape[1], len(ids) // BLOCK
    heavy = np.flatnonzero(space.heavy[ids] & (ids >= 0))
    at, hashes = _gram_hashes(ids)
    low, high = (np.searchsorted(space.grams, hashes, side) for side in ("left", "right"))
    hits = np.repeat(at // BLOCK, high - low)
    of = space.gram_segments[np.repeat(low, high - low) + np.arange(len(hits)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)]
    for first in range(0, blocks_there - 1, PASSAGES):
        last = min(first + PASSAGES, blocks_there - 1)
        mine = heavy[np.searchsorted(heavy, first * BLOCK) : np.searchsorted(heavy, (last + 1) * BLOCK)]
        blocks = np.zeros((last - first + 1, dimensions), np.float32)
        if len(mine):
            block = mine // BLOCK - first
            starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            blocks[block[starts]] = np.add.reduceat(space.latent[ids[mine]], starts, axis=0)
        passages = blocks[:-1] + blocks[1:]
        length = np.linalg.norm(passages, axis=1)
        some = np.flatnonzero(length > 1e-9)
        length[length <= 1e-9] = 1.0
        found = []
        for j in range(0, len(space.queries), AT_A_TIME):
            i, k = np.nonzero(passages[some] @ space.queries[j : j + AT_A_TIME].T >= space.limits.cosine * length[some][:, None])
            found.append(some[i] * len(space.queries) + k + j)
        for back in (0, 1):  # what stands in a block is in two passages
            here = (hits - back >= first) & (hits - back < last)
            found.append((hits[here] - back - first) * len(space.queries) + of[here])
        both = np.unique(np.concatenate(found))
        i, k = both // len(space.queries), both % len(space.queries)
        yield i + first, k, np.einsum("ij,ij->i", passages[i], space.queries[k]) / length[i]


def leaks_of(space: Space, texts: list[str | bytes | None]) -> list[list[tuple[int, int, float, float]]]:
    """Of each text item, first word of the passage, cosine and share of each leaked item; the best passage of each."""
    words = [folded(text) for text in texts]
    blocks = np.array([-(-len(w) // BLOCK) + 1 for w in words], np.int64)  # each text's last block is empty, so none runs into the next
    first = np.cumsum(blocks) - blocks
    ids = np.full(int(blocks.sum()) * BLOCK + BLOCK, -1, np.int32)
    for w, start in zip(words, first.tolist()):
        ids[start * BLOCK : start * BLOCK + len(w)] = space.benchmark.terms.of(w)
    best: list[dict[int, tuple[int, float, float]]] = [{} for _ in texts]
    here = -1
    for passages, segments_, cosines in _candidates(space, ids):
        owners = np.searchsorted(first, passages, "right") - 1
        for i, segment, cosine, owner in zip(passages.tolist(), segments_.tolist(), cosines.tolist(), owners.tolist()):
            if i != here:
                here, start = i, (i - int(first[owner])) * BLOCK
                passage = words[owner][start : start + 2 * BLOCK]
                distinct = set(passage)
            share = _checked(space, segment, passage, distinct)
            item = space.benchmark.items[segment]
            if share is not None and (item not in best[owner] or share > best[owner][item][2]):
                best[owner][item] = (start, cosine, share)
    return [[(item, *found) for item, found in sorted(x.items(), key=lambda f: (f[0] is None, f[0] or 0))] for x in best]


def _searched(shared):
    kind = pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("cosine", pa.float64()), ("share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = leaks_of(shared.value, batch.column("text").cast(pa.binary()).to_pylist())
            hit = pa.array([bool(x) for x in found], pa.bool_())
            rows = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(kind))], ["doc_id", "leaks"])
            yield rows.filter(hit)

    return run


def fitted(docs: DataFrame, items: DataFrame, limits: Limits | None = None, text: str = "text", item_id: str = "item_id", item_text: str = "text", answer: str = "answer") -> Iterator[Space]:
    """The latent spaces of docs and the items, one for each part of the benchmark; items without words can't leak. item_ids are cast to long."""
    size = items.agg(F.coalesce(F.sum(F.octet_length(item_text)), F.lit(0))).first()[0]
    parts = 1 if size <= MAX_BYTES else -(-size * 5 // (4 * MAX_BYTES))
    answers = F.col(answer).cast("string") if answer in items.columns else F.lit(None).cast("string")
    own = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text"), answers.alias("answer"), F.pmod(F.xxhash64(item_id, item_text), F.lit(parts)).alias("part"))
    for part in range(parts):
        rows = own.where(F.col("part") == part).select("id", "text", "answer").collect()  # up to some MAX_BYTES
        benchmark = segments([tuple(r) for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))])
        if benchmark.words:
            yield latent_space(docs, benchmark, limits or Limits(), text)


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """doc_id, item_id, start, cosine and share of every leaked item of every row of docs.

    start is the first word of the passage that holds it best. Null, empty and short texts are handled
    like others; a text shorter than a segment can hold at most a share of it. Repeated rows of docs
    give repeated rows. Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    every = None
    for space in fitted(docs, items, text=text, **settings):
        shared = docs.sparkSession.sparkContext.broadcast(space)
        found = rows.mapInArrow(_searched(shared), f"doc_id {kind}, leaks array<struct<item_id: long, start: long, cosine: double, share: double>>")
        found = found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
        every = found if every is None else every.unionByName(found)
    if every is None:
        return rows.where(F.lit(False)).select("doc_id", *(F.lit(None).cast(k).alias(c) for c, k in (("item_id", "long"), ("start", "long"), ("cosine", "double"), ("share", "double"))))
    return every


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", **settings) -> DataFrame:
    """The rows of docs without a leaked item, with all columns."""
    place = docs.columns.index(text)

    def clean(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                yield batch.filter(pa.array([not x for x in leaks_of(shared.value, batch.column(place).cast(pa.binary()).to_pylist())], pa.bool_()))

        return run

    kept = docs
    for space in fitted(docs, items, text=text, **settings):
        kept = filtered(kept, clean(docs.sparkSession.sparkContext.broadcast(space)))
    return kept
