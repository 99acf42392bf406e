"""SimHash near-dedup: pigeonhole blocks, a join on blocks, and a check of the Hamming distance.

Two forms stand here.

`linked` takes the classic fingerprint of 64 bits over word shingles and links fingerprints at two or
fewer differing bits, exactly. Of four blocks two are untouched by two differing bits, so close
fingerprints meet under one of the six pairs of blocks. Blocks with few fingerprints are joined with
themselves. For crowded blocks the pairs within would grow with the square, so their fingerprints meet
at what one flipped bit makes of them: two fingerprints are at most two bits apart if and only if they
share such a neighbour, and a neighbour has at most 65 of them.

`near_duplicates` is for a similarity of shingle sets, 0.8 and more, where 64 bits say too little: the
share of differing bits is arccos(cosine) / pi, with a standard deviation of four of 64. It sketches
each set of shingles as signed counts, draws the bits from them by two rounds of sign flips and Hadamard
transforms, and compares 2,000 bits, which measure a similarity with a standard deviation of some 0.02.
At 0.8 two fingerprints share one of the 100 blocks of 20 bits with a probability of 98%, at 0.9 of over
99.9%. What the bits join from 0.75 on are candidates; within them the sets of shingles themselves decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .components import components
from .shared import dropped, written
from .words import WordHashes, sliced, split, window_hashes

SEED = 42
#: Blocks of a fingerprint of 64 bits, and how many of them close fingerprints share.
BLOCKS, SHARED = 4, 2
#: Blocks of a long fingerprint, bits of a block, counts in a sketch.
WIDE_BLOCKS, WIDE_BITS, SKETCH = 100, 20, 4096
#: Bits of a long fingerprint that go with its blocks, and how many of them may differ at first sight.
SIGHT, SIGHT_MOST = 128, 36
#: Rows of a block of 64-bit fingerprints, or of a long one's block, that give their pairs one by one.
NEAR = 32
#: Rows of a long fingerprint's block that give pairs if no more look close to another, that are compared at first sight, and that one task compares.
FEW, MANY, PIECE = 4, 1024, 20_000
#: Blocks of a long fingerprint whose links are found first, so that the others needn't join what these have.
EARLY = 10
#: How far below the limit bits make candidates, and bits alone rule a pair out; rows and bytes of shingles that one task compares.
CANDIDATE, RULED_OUT = 0.05, 0.08
ROWS, BYTES = 4096, 64 << 20
#: Hash buckets by which rows are sifted before their sets or texts are shuffled: at most so many numbers are broadcast.
BUCKETS = 1 << 21


def fingerprint(text: str | None, shingle: int) -> int:
    """64 bits, each set if it is in over half of the shingles' hashes; 0 for a text without words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) < shingle:
        starts, ends = [0], [len(joined)]
    else:
        starts, ends = [0, *(ends[:-shingle] + 1).tolist()], ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends)]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[at : at + 8192], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py(), shingle) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fingerprint"])

    return run


def close_pairs(nodes: DataFrame, few: int = NEAR) -> DataFrame:
    """Links (a, b) between fingerprints of 64 bits at two or fewer differing bits, enough to join all that are linked.

    nodes: fingerprint, a row for each that there is. Fingerprints of blocks with up to `few` are
    compared with each other; those of larger ones are linked by the neighbours that they share.
    """
    size = 64 // BLOCKS
    block = lambda i: F.shiftrightunsigned("fingerprint", size * i).bitwiseAND(F.lit((1 << size) - 1))
    keys = [F.shiftleft(block(i), size).bitwiseOR(block(j)) + F.lit(n << (2 * size)) for n, (i, j) in enumerate(combinations(range(BLOCKS), SHARED))]
    keyed = nodes.select("fingerprint", F.explode(F.array(*keys)).alias("block"))
    shared = written(keyed.groupBy("block").agg(F.count("*").alias("n")).where("n > 1"), "simhash-shared")
    keyed = written(keyed.join(shared, "block"), "simhash-blocks")
    sparse = keyed.where(F.col("n") <= few)
    left, right = sparse.select("block", F.col("fingerprint").alias("a")), sparse.select("block", F.col("fingerprint").alias("b"))
    pairs = left.join(right, "block").where("a < b and bit_count(a ^ b) <= 2").select("a", "b")
    crowded = keyed.where(F.col("n") > few).select("fingerprint").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)))
    near = crowded.select("fingerprint", F.explode(F.transform(flips, lambda x: F.col("fingerprint").bitwiseXOR(x))).alias("neighbour"))
    hubs = near.select(F.col("fingerprint").alias("a"), F.min("fingerprint").over(W.partitionBy("neighbour")).alias("b")).where("a <> b")  # at most 65 rows for a neighbour
    return pairs.unionByName(hubs).distinct()


def linked(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (long) and component_id of each row of docs.

    component_id is the smallest doc_id reachable by links of two or fewer differing bits. A-Z are
    lower-cased; fewer words than a shingle has are one shingle; a null, empty or blank text has
    fingerprint 0, which is linked like any other. Null doc_ids are never smallest. Repeated rows stay.
    Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = written(rows.mapInArrow(_fingerprints(shingle), "doc_id long, fingerprint long"), "simhash-rows")
    nodes = written(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    found = components(written(close_pairs(nodes.select("fingerprint")), "simhash-links"), "simhash-components")
    known = nodes.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint")
    smallest = known.groupBy("component").agg(F.min("least").alias("component_id"))
    of = known.select("fingerprint", "component").join(smallest, "component").select(F.col("fingerprint").alias("linked"), "component_id")
    ids = nodes.join(of, nodes["fingerprint"] == of["linked"], "left").select("fingerprint", F.coalesce("component_id", "least").alias("component_id"))
    ids = written(ids, "simhash-ids")
    return rows.join(ids, "fingerprint").select("doc_id", "fingerprint", "component_id")


def _signs(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), SKETCH)


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Of each row, in place."""
    step = 1
    while step < SKETCH:
        pairs = x.reshape(len(x), -1, 2, step)
        a, b = pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]
        pairs[:, :, 0], pairs[:, :, 1] = a, b
        step *= 2
    return x


def _wide_fingerprints(shingle: int):
    """(doc_id, tie, text) -> (doc_id, tie, node, bits, shingles): each text's set of shingles in order, by 32 bits of a hash, a hash of the set, and WIDE_BLOCKS * WIDE_BITS bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, first, second = WordHashes(), _signs(1), _signs(2)
        for batch in sliced(batches, 1024):
            texts, bits, sets = batch.column("text"), [], []
            for start in range(0, len(texts), 128):
                some = texts[start : start + 128]
                sketches = np.zeros((len(some), SKETCH), np.float32)
                for i, text in enumerate(some):
                    x = hashes.of(split((text.as_py() or "").lower()))
                    sets.append(b"")
                    if len(x):
                        h = np.unique(window_hashes(x, min(shingle, len(x))))
                        sets[-1] = np.unique((h >> np.uint64(32)).astype(np.uint32)).tobytes()
                        sketches[i] = np.bincount((h % np.uint64(SKETCH)).astype(np.int64), 1.0 - 2.0 * ((h >> np.uint64(40)) & np.uint64(1)), SKETCH)
                mixed = _hadamard(_hadamard(sketches * first) * second)
                bits += [row.tobytes() for row in np.packbits(mixed[:, : WIDE_BLOCKS * WIDE_BITS] > 0, axis=1)]
            nodes = np.array([xxhash.xxh3_64_intdigest(x) for x in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(nodes), pa.array(bits, pa.binary()), pa.array(sets, pa.binary())], ["doc_id", "tie", "node", "bits", "shingles"])

    return run


def block_bits(rows: int) -> np.ndarray:
    """Which bits of a long fingerprint each block has, for a corpus of so many rows: blocks x bits.

    A block is wide enough that unrelated rows meet in it about once, whatever their number. Wider blocks than
    WIDE_BITS are drawn from all bits, and as many more as keep the chance that a pair at a similarity of
    0.8 meets in one.
    """
    every, wide = WIDE_BLOCKS * WIDE_BITS, max(WIDE_BITS, (max(rows, 1) - 1).bit_length())
    if wide == WIDE_BITS:
        return np.arange(every).reshape(WIDE_BLOCKS, WIDE_BITS)
    same = 1 - most_differing(0.8) / every
    blocks = math.ceil(WIDE_BLOCKS * math.log1p(-(same**WIDE_BITS)) / math.log1p(-(same**wide)))
    rng = np.random.default_rng(wide)
    return np.stack([rng.choice(every, wide, replace=False) for _ in range(blocks)])


def _blocks(bits_of: np.ndarray, first: int):
    """(node, part, bits) -> (block, node, part, sight_a, sight_b), a row for each block, numbered from first; a block's number is in the upper bits."""
    blocks_here, wide = bits_of.shape
    weights = (1 << np.arange(wide)[::-1]).astype(np.int64)
    numbers = np.arange(first, first + blocks_here, dtype=np.int64) << wide

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 512):
            bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint8).reshape(len(batch), -1)
            sight = np.ascontiguousarray(bits[:, : SIGHT // 8]).view(np.int64)
            blocks = np.take(np.unpackbits(bits, axis=1), bits_of, axis=1) @ weights
            columns = [(blocks + numbers).ravel(), *(np.repeat(x, blocks_here) for x in (batch.column("node").to_numpy(), batch.column("part").to_numpy(), sight[:, 0], sight[:, 1]))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["block", "node", "part", "sight_a", "sight_b"])

    return run


def _met(many: int):
    """Rows in order of block -> (block, a, b, part, large): pairs (a, b) that look close, without a block, and rows a of crowded blocks.

    A block's rows of different parts are compared at first sight. Where few look close to another, their
    pairs are given, else the rows that do; of a block with more than `many` rows, which is large, all
    rows. Rows of one part are linked already and give nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # rows of the last block, which may go on,
        over = None  # and a block that has proved large
        for batch in chain(batches, [None]):
            if batch is None:
                columns = held
            elif not len(batch):
                continue
            else:
                columns = [batch.column(c).to_numpy() for c in ("block", "node", "part")]
                columns += [batch.column(c).to_numpy().view(np.uint64) for c in ("sight_a", "sight_b")]  # bits of a negative number aren't counted as such
                if held is not None:
                    columns = [np.concatenate(x) for x in zip(held, columns)]
            if columns is None or not len(columns[0]):
                continue
            start = np.flatnonzero(np.append(True, columns[0][1:] != columns[0][:-1]))
            end = len(columns[0])
            if end - start[-1] > many:
                over = columns[0][-1]
            if batch is not None and columns[0][-1] != over:
                end = start[-1]
            held = [c[end:] for c in columns]
            block, node, part, sight_a, sight_b = (c[:end] for c in columns)
            start = start[start < end]
            if not end:
                continue
            sizes = np.diff(np.append(start, end))
            size, rank = np.repeat(sizes, sizes), np.arange(end) - np.repeat(start, sizes)
            large = (size > many) if over is None else (size > many) | (block == over)
            crowded, ones, others = large.copy(), [], []
            i, o = np.flatnonzero((rank >= 1) & ~large), 1
            while len(i):
                d = np.bitwise_count(sight_a[i] ^ sight_a[i - o]).astype(int) + np.bitwise_count(sight_b[i] ^ sight_b[i - o])
                hit = i[(d <= SIGHT_MOST) & (part[i] != part[i - o])]
                crowded[hit] = crowded[hit - o] = True
                hit = hit[size[hit] <= NEAR]
                ones.append(hit)
                others.append(hit - o)
                o += 1
                i = i[rank[i] >= o]
            few = (size <= NEAR) & (np.repeat(np.add.reduceat(crowded, start, dtype=int), sizes) <= FEW)
            one, other = (np.concatenate(x) if x else np.empty(0, int) for x in (ones, others))
            one, other = one[few[one]], other[few[one]]
            rows = np.flatnonzero(crowded & ~few)
            if len(one) + len(rows):
                nothing = lambda n: pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([nothing(len(one)), pa.array(block[rows])]), pa.array(np.concatenate((np.maximum(node[one], node[other]), node[rows]))),
                        pa.concat_arrays([pa.array(np.minimum(node[one], node[other])), nothing(len(rows))]), pa.concat_arrays([nothing(len(one)), pa.array(part[rows])]),
                        pa.array(np.concatenate((np.zeros(len(one), bool), large[rows]))),
                    ],
                    ["block", "a", "b", "part", "large"],
                )

    return run


def _spanning(node: np.ndarray, part: np.ndarray, bits: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links that join all rows which links of up to `most` differing bits join; every pair is compared unless it is joined already."""
    label = np.unique(part, return_inverse=True)[1]
    order = np.argsort(np.bincount(label)[label], kind="stable")  # a large part comes last, when the others may have joined it
    node, label, bits = node[order], label[order], bits[order]
    found: list[tuple[int, int]] = []
    parts = len(np.unique(label))
    for i in range(len(node) - 1):
        if parts == 1:
            break
        rest = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        near = [x[np.bitwise_count(bits[x] ^ bits[i]).sum(axis=1, dtype=np.int64) <= most] for x in (rest[at : at + 4096] for at in range(0, len(rest), 4096))]
        near = np.concatenate(near) if near else rest
        if len(near):
            joined, at = np.unique(label[near], return_index=True)
            found += [(int(node[i]), int(node[j])) for j in near[at]]
            label[np.isin(label, joined)] = label[i]
            parts -= len(joined)
    return found


def _within(most: int):
    """(block, low, high, node, part, bits) in order of the first three -> links (a, b) that span each group of these."""

    def group(held: list[tuple]) -> pa.RecordBatch:
        node, part, bits = (np.concatenate(x) for x in zip(*held))
        found = np.array(_spanning(node, part, bits, most), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(found.max(axis=1)), pa.array(found.min(axis=1))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None
        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("block", "low", "high")], axis=1)
            flat = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint8).reshape(len(batch), -1)
            bits = np.pad(flat, ((0, 0), (0, -flat.shape[1] % 8))).view(np.uint64)
            node, part = (batch.column(c).to_numpy() for c in ("node", "part"))
            bounds = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
            for a, b in zip(bounds, bounds[1:]):
                if held and tuple(keys[a]) != last:
                    yield group(held)
                    held = []
                last = tuple(keys[a])
                held.append((node[a:b], part[a:b], bits[a:b].copy()))
        if held:
            yield group(held)

    return run


def most_differing(similarity: float) -> int:
    """Differing bits of a long fingerprint at a Jaccard similarity of sets of equal size."""
    cosine = 2 * similarity / (1 + similarity)
    return math.floor(WIDE_BLOCKS * WIDE_BITS * math.acos(cosine) / math.pi)


def _wide_links(nodes: DataFrame, bits_of: np.ndarray, first: int, most: int, many: int = MANY, piece: int = PIECE) -> DataFrame:
    """Links (a, b) that join what meets in blocks of these bits, numbered from first, and differs in at most `most` bits, among nodes (node, bits, part) of different parts.

    Rows of crowded blocks are compared on all bits, every pair that isn't joined yet; blocks of more than
    `piece` rows by pairs of pieces. What goes on is at most a link for each row and piece.
    """
    blocks = nodes.select("node", "part", "bits").mapInArrow(_blocks(bits_of, first), "block long, node long, part long, sight_a long, sight_b long")
    met = blocks.repartition("block").sortWithinPartitions("block", "node").mapInArrow(_met(many), "block long, a long, b long, part long, large boolean")
    met = written(met, "near-met")
    left, right = (nodes.select(F.col("node").alias(x), F.col("bits").alias(f"{x}_bits")) for x in "ab")
    pairs = met.where("block is null and a <> b").select("a", "b").distinct()
    links = pairs.join(left, "a").join(right, "b").mapInArrow(_close(most), "a long, b long")
    rows = met.where("block is not null").select("block", F.col("a").alias("node"), "part", "large")
    sizes = rows.where("large").groupBy("block").agg(F.ceil(F.count("*") / piece).cast("int").alias("pieces"), (F.min("part") != F.max("part")).alias("mixed")).where("mixed").select("block", "pieces")
    dealt = rows.where("large").join(sizes, "block").withColumn("own", F.expr("cast(pmod(xxhash64(node), pieces) as int)")).withColumn("other", F.explode(F.expr("sequence(0, pieces - 1)")))
    dealt = dealt.select("block", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "part")
    dealt = rows.where("not large").select("block", F.lit(0).alias("low"), F.lit(0).alias("high"), "node", "part").unionByName(dealt)
    places = dealt.groupBy("node", "part").agg(F.collect_list(F.struct("block", "low", "high")).alias("places"))
    placed = places.join(nodes.select("node", "bits"), "node").select(F.explode("places").alias("at"), "node", "part", "bits").select("at.block", "at.low", "at.high", "node", "part", "bits")
    within = placed.repartition("block", "low", "high").sortWithinPartitions("block", "low", "high", "node").mapInArrow(_within(most), "a long, b long")
    links = written(links.unionByName(within).distinct(), "near-links")
    dropped(met)
    return links


def _alike(node: np.ndarray, label: np.ndarray, left: np.ndarray, bits: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join what links of the least similarity join; every pair with a row of the left is compared unless it is joined already."""
    label = np.unique(label, return_inverse=True)[1]
    order = np.lexsort((np.bincount(label)[label], ~left))  # a large group comes last, when the others may have joined it
    node, label, bits, sets = node[order], label[order], bits[order], [sets[i] for i in order]
    sizes, most = np.array(list(map(len, sets))), most_differing(similarity - RULED_OUT)
    found: list[tuple[int, int]] = []
    parts = len(np.unique(label))
    for i in range(int(left.sum())):
        if parts == 1:
            break
        rest = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        rest = rest[(np.minimum(sizes[rest], sizes[i]) >= similarity * np.maximum(sizes[rest], sizes[i])) & (sizes[rest] > 0)]
        for at in range(0, len(rest), 512):
            near = rest[at : at + 512]
            near = near[label[near] != label[i]]
            near = near[np.bitwise_count(bits[near] ^ bits[i]).sum(axis=1, dtype=np.int64) <= most]
            if not len(near):
                continue
            flat = np.concatenate([sets[j] for j in near])
            hit = sets[i][np.minimum(np.searchsorted(sets[i], flat), sizes[i] - 1)] == flat
            common = np.add.reduceat(hit, np.cumsum(sizes[near]) - sizes[near], dtype=np.int64)
            near = near[common >= similarity * (sizes[near] + sizes[i] - common)]
            joined, first = np.unique(label[near], return_index=True)
            found += [(int(node[i]), int(node[j])) for j in near[first]]
            label[np.isin(label, joined)] = label[i]
            parts -= len(joined)
    return found


def _checked(similarity: float):
    """(component, low, high, node, label, at_left, bits, shingles) in order of the first four -> links (a, b) that span each group of the first three."""

    def group(held: list[tuple]) -> pa.RecordBatch:
        node, label, left = (np.concatenate([x[k] for x in held]) for k in range(3))
        once = np.flatnonzero(np.append(True, node[1:] != node[:-1]))  # repeated rows of one document
        bits = np.concatenate([x[3] for x in held])[once]
        sets = [s for x in held for s in x[4]]
        found = np.array(_alike(node[once], label[once], left[once], bits, [sets[i] for i in once], similarity), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(found.max(axis=1)), pa.array(found.min(axis=1))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None
        for batch in sliced(batches, 2048):
            if not len(batch):
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("component", "low", "high")], axis=1)
            flat = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint8).reshape(len(batch), -1)
            bits = np.pad(flat, ((0, 0), (0, -flat.shape[1] % 8))).view(np.uint64)
            node, label = (batch.column(c).to_numpy() for c in ("node", "label"))
            left = batch.column("at_left").to_numpy(zero_copy_only=False)
            sets = [np.frombuffer(x, np.uint32) for x in batch.column("shingles").to_pylist()]
            bounds = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
            for a, b in zip(bounds, bounds[1:]):
                if held and tuple(keys[a]) != last:
                    yield group(held)
                    held = []
                last = tuple(keys[a])
                held.append((node[a:b], label[a:b], left[a:b], bits[a:b].copy(), sets[a:b]))
        if held:
            yield group(held)

    return run


def _similar_links(rows: DataFrame, nodes: DataFrame, candidates: DataFrame, similarity: float, most_rows: int = ROWS, most_bytes: int = BYTES) -> DataFrame:
    """Links (a, b) that join, within each component of candidates (node, component), all nodes which pairs of at least the similarity join.

    A component of up to most_rows rows is compared by one task. A larger one is dealt in pieces: each
    piece is compared by itself, then a row of each piece's largest group with those of the others; then
    rows outside the component's largest group are compared with all rows, by pairs of pieces. Rows of
    that group are joined, so no pair of them needs a look, and a crowd costs its size times its exceptions.
    """
    members = written(candidates.join(nodes.select("node", "least", "size"), "node"), "near-members")
    pieces = lambda n, size: F.greatest(F.ceil(F.col(n) / most_rows), F.ceil(F.col(size) * 4 / most_bytes), F.lit(1)).cast("int")
    sizes = written(members.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")).select("component", pieces("n", "shingles").alias("pieces")), "near-sizes")
    piece = F.expr("cast(pmod(xxhash64(node), pieces) as int)")
    members_in = written(members.join(sizes, "component").withColumn("piece", piece), "near-pieces")
    bucket = F.expr(f"pmod(xxhash64(node), {BUCKETS}L)").alias("bucket")
    buckets = F.broadcast(members.select(bucket).distinct())  # BUCKETS rows at most
    own = written(rows.select("node", "doc_id", "tie", "bits", "shingles", bucket).join(buckets, "bucket", "left_semi").drop("bucket"), "near-sets")

    def compared(dealt: DataFrame) -> DataFrame:
        """dealt: component, low, high, node, least, label, at_left."""
        dealt = dealt.select("component", "low", "high", "node", "label", "at_left", F.col("least.doc_id").alias("doc_id"), F.col("least.tie").alias("tie"))
        full = dealt.join(own, ["node", "doc_id", "tie"]).select("component", "low", "high", "node", "label", "at_left", "bits", "shingles")
        return written(full.repartition("component", "low", "high").sortWithinPartitions("component", "low", "high", "node").mapInArrow(_checked(similarity), "a long, b long"), "near-similar")

    links = compared(members_in.withColumns({"low": F.col("piece"), "high": F.col("piece"), "label": F.col("node"), "at_left": F.lit(True)}))
    large = members_in.where("pieces > 1")
    if not large.isEmpty():
        def labelled(found: DataFrame) -> DataFrame:
            known = components(found, "near-components")
            return written(large.join(known.select("node", F.col("component").alias("known")), "node", "left").withColumn("label", F.coalesce("known", "node")).drop("known"), "near-labels")

        first = labelled(links)
        groups = first.groupBy("component", "piece", "label").agg(F.count("*").alias("n"), F.min(F.struct("node", "least")).alias("one"))
        leaders = groups.groupBy("component", "piece").agg(F.max_by(F.struct("label", "one"), F.struct("n", "label")).alias("g"))
        leaders = leaders.join(sizes.where(F.col("pieces") <= most_rows), "component").select("component", F.lit(-1).alias("low"), F.lit(-1).alias("high"), "g.one.node", "g.one.least", "g.label", F.lit(True).alias("at_left"))
        links = written(links.unionByName(compared(leaders)), "near-similar")
        second = labelled(links)
        main = second.groupBy("component", "label").agg(F.count("*").alias("n")).groupBy("component").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
        second = written(second.join(written(main, "near-main"), "component").withColumn("odd", F.col("label") != F.col("main")), "near-labels")
        odd = second.where("odd").groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")).select("component", pieces("n", "shingles").alias("odd_pieces"))
        dealt = second.join(written(odd, "near-odd"), "component")
        lefts = dealt.where("odd").withColumns({"low": F.expr("cast(pmod(xxhash64(node, 1), odd_pieces) as int)"), "high": F.explode(F.expr("sequence(0, pieces - 1)")), "at_left": F.lit(True)})
        rights = dealt.withColumns({"low": F.explode(F.expr("sequence(0, odd_pieces - 1)")), "high": F.col("piece"), "at_left": F.lit(False)})
        rights = rights.where("not odd or low <> cast(pmod(xxhash64(node, 1), odd_pieces) as int)")  # those are on the left there
        links = links.unionByName(compared(lefts.unionByName(rights)))
        dropped(first, second)
    dropped(members, sizes, members_in, own)
    return links


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, tie, copies, component_id, component_tie of each distinct (doc_id, text) of docs.

    tie is a hash of the text, copies the number of its rows. The component is that of links between sets of shingles with at least the
    similarity, among candidates from 0.05 below it by their fingerprints; it is named by its smallest
    doc_id and tie. Texts with fewer words than a shingle are one shingle; texts without words are equal to
    each other. A null doc_id comes after all others; doc_ids are cast to long.
    """
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1)).alias("doc_id"), F.xxhash64(text).alias("tie"), F.col(text).alias("text"))
    rows = written(rows.mapInArrow(_wide_fingerprints(shingle), "doc_id long, tie long, node long, bits binary, shingles binary"), "near-rows")
    size = F.expr("cast(octet_length(shingles) / 4 as int)")
    nodes = written(rows.select("node", "doc_id", "tie", "bits", size.alias("size")).groupBy("node").agg(F.min(F.struct("doc_id", "tie")).alias("least"), F.first("bits").alias("bits"), F.first("size").alias("size")), "near-nodes")
    most = most_differing(similarity - CANDIDATE)
    bits_of = block_bits(nodes.count())
    late_ones = len(bits_of) - EARLY
    early = _wide_links(nodes.select("node", "bits", F.col("node").alias("part")), bits_of[late_ones:], late_ones, most)
    parts = written(components(early, "near-components"), "near-parts")
    parted = written(nodes.join(parts, "node", "left").select("node", "bits", F.coalesce("component", "node").alias("part")), "near-parted")
    late = _wide_links(parted, bits_of[:late_ones], 0, most)
    candidates = written(components(late.unionByName(parts.select(F.col("node").alias("a"), F.col("component").alias("b"))), "near-components"), "near-candidates")
    found = components(_similar_links(rows, nodes, candidates, similarity), "near-components")
    known = nodes.select("node", "least").join(found, "node")
    smallest = known.groupBy("component").agg(F.min("least").alias("smallest"))
    of = known.select("node", "component").join(smallest, "component").select("node", "smallest")
    named = nodes.select("node", "least").join(of, "node", "left").select("node", F.coalesce("smallest", "least").alias("c"))
    named = written(named, "near-named")
    ids = written(rows.groupBy("doc_id", "tie", "node").agg(F.count("*").alias("copies")), "near-ids")
    dropped(rows, nodes, parts, parted, early, late, candidates)
    return ids.join(named, "node").select("doc_id", "tie", "copies", F.col("c.doc_id").alias("component_id"), F.col("c.tie").alias("component_tie"))


def _close(most: int):
    """(a, a_bits, b, b_bits) -> (a, b) with up to `most` differing bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2048):
            one, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(len(batch), -1) for c in ("a_bits", "b_bits"))
            keep = pa.array(np.bitwise_count(one ^ other).sum(axis=1, dtype=np.int64) <= most)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of docs that are the first of their near duplicates, with all columns; rows repeated in doc_id and text once."""
    found = near_duplicates(docs, doc_id=doc_id, text=text, **settings)
    stays = (F.col("doc_id") == F.col("component_id")) & (F.col("tie") == F.col("component_tie"))
    found = written(found.select(F.col("doc_id").alias("row_id"), F.col("tie").alias("row_tie"), "copies", stays.alias("stays")), "near-verdicts")
    bucket = F.expr(f"pmod(xxhash64(row_id, row_tie), {BUCKETS}L)").alias("bucket")
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1)).alias("row_id"), F.xxhash64(text).alias("row_tie")).select("*", bucket)
    # Rows in a bucket where all stay and none is repeated need no shuffle.
    mixed = F.broadcast(found.where("not stays or copies > 1").select(bucket).distinct())  # BUCKETS rows at most
    checked = keyed.join(mixed, "bucket", "left_semi").join(found.where("stays"), ["row_id", "row_tie"], "left_semi").dropDuplicates(["row_id", "row_tie"])
    kept = keyed.join(mixed, "bucket", "left_anti").select("row").unionByName(checked.select("row"))
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))
