"""N-gram Jaccard join: the sparse product of the document by n-gram incidence with itself, in blocks.

Rows of the incidence matrix are distinct sets of n-grams, in blocks of documents that one task reads in a
row; columns are hashes of n-grams, in blocks of hash ranges. What blocks of rows and columns have in common
goes to a task as one slice (sorted arrays), and comes back as one.

1. A fixed share of all columns is multiplied out to find which n-grams more than one set has. Sets that are
   alike to a similarity s share all but (1 - s) of their n-grams with another, so a set with more than that
   of its n-grams to itself is out, and for most texts the share of the columns shows it.
2. What is left is multiplied out in full: each n-gram gets its number of sets. In order of that number,
   two alike sets share n-grams among the first (1 - s) of each. The product over these columns
   accumulates overlap counts of pairs; a pair below the least count that its sizes allow is discarded.
   A column of very many sets gives no pairs, but links its sets to the first of them.
3. Pairs and links make groups. Within each, blocks of rows are multiplied on all columns, and exact
   overlaps against sizes decide. Rows that are joined already needn't be compared with each other, so
   a crowd costs its size times its exceptions; a large group is dealt by pairs of pieces.

No step gathers a column, group or crowd in one task: columns reach a task once for each block of rows, and
groups by pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import LARGE_ROWS, dropped, written
from .words import WordHashes, given_back, sliced, split, window_hashes

#: Of 65,536 parts of all hashes, those whose n-grams the first step looks at: 0.3.
SHARE = 19_661
#: Bytes of a block of rows, and n-grams of a block of columns, on average.
BLOCK_BYTES, COLUMN_GRAMS = 2 << 20, 1 << 20
#: Numbers of sets are counted up to here.
MANY = 255
#: Sets of a column that give pairs; beyond, they are linked to the first.
MOST = 32
#: Rows and bytes of n-grams that one task compares, and hash buckets by which texts are sifted before a shuffle.
ROWS, BYTES, BUCKETS = 2048, 32 << 20, 1 << 21
BLOCKS = "block long, doc_ids array<long>, ties array<long>, nodes array<long>, sizes array<int>, set_nodes array<long>, set_sizes array<int>, lengths array<int>, grams binary"


def grams_of(words: list[bytes], shingle: int, hashes: WordHashes) -> np.ndarray:
    """The set of n-grams of a text, as sorted hashes; fewer words than an n-gram has are one; none have none."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(hashes.of(words), min(shingle, len(words))))


def _blocks(shingle: int, share: int, block_bytes: int):
    """(doc_id, tie, text) -> blocks of rows: all documents, and each distinct set once, with those of its n-grams that belong to the share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hashes, number = WordHashes(), TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        sets: dict[int, tuple[int, np.ndarray]] = {}
        held = 0

        def block() -> pa.RecordBatch:
            doc_ids, ties, nodes, sizes = zip(*rows)
            columns = [
                pa.array([number]), *(pa.array([x], pa.list_(k)) for x, k in ((doc_ids, pa.int64()), (ties, pa.int64()), (nodes, pa.int64()), (sizes, pa.int32()))),
                pa.array([list(sets)], pa.list_(pa.int64())), pa.array([[n for n, _ in sets.values()]], pa.list_(pa.int32())), pa.array([[len(g) for _, g in sets.values()]], pa.list_(pa.int32())),
                pa.array([np.concatenate([g for _, g in sets.values()]).tobytes() if sets else b""], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["block", "doc_ids", "ties", "nodes", "sizes", "set_nodes", "set_sizes", "lengths", "grams"])

        for batch in sliced(batches):
            for doc_id, tie, text in zip(batch.column("doc_id").to_pylist(), batch.column("tie").to_pylist(), batch.column("text")):
                grams = grams_of(split(text.as_py()), shingle, hashes)
                node = int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes())).view(np.int64)) if len(grams) else None
                rows.append((doc_id, tie, node, len(grams)))
                held += 32
                if node is not None and node not in sets:
                    sets[node] = len(grams), grams[(grams & np.uint64(0xFFFF)) < share]
                    held += 16 + sets[node][1].nbytes
                if held >= block_bytes:
                    yield block()
                    number += 1
                    rows, sets, held = [], {}, 0
        if rows:
            yield block()

    return run


def _ragged(binary: bytes, lengths: np.ndarray) -> list[np.ndarray]:
    return np.split(np.frombuffer(binary, np.uint64), np.cumsum(lengths)[:-1]) if len(lengths) else []


def _column(grams: np.ndarray, columns: int) -> np.ndarray:
    """The block of columns that each n-gram is in: ranges of the upper half of its bits."""
    return ((grams >> np.uint64(32)) * np.uint64(columns) >> np.uint64(32)).astype(np.int64)


def _slices(columns: int):
    """Blocks of rows -> (column, block, grams, counts): of each block of columns, the n-grams there and how many sets have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, grams in zip(batch.column("block").to_pylist(), batch.column("grams")):
                grams, counts = np.unique(np.frombuffer(grams.as_py(), np.uint64), return_counts=True)
                if not len(grams):
                    continue
                at, first = np.unique(_column(grams, columns), return_index=True)
                parts = list(zip(first, [*first[1:], len(grams)]))
                slices = (pa.array([x[a:b].tobytes() for a, b in parts], pa.binary()) for x in (grams, np.minimum(counts, MANY).astype(np.uint8)))
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), block)), *slices], ["column", "block", "grams", "counts"])

    return run


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, dict[str, list]]]:
    """Rows in order of a key, by key."""
    last, held = None, {}
    for batch in batches:
        for row in batch.to_pylist():
            if row[key] != last and held:
                yield last, held
                held = {}
            last = row[key]
            for name, value in row.items():
                held.setdefault(name, []).append(value)
    if held:
        yield last, held


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices in order of column -> (block, column, counts): how many sets have each n-gram of each slice, in the slice's order."""
    for column, held in _grouped(batches, "column"):
        grams, counts = np.concatenate([np.frombuffer(x, np.uint64) for x in held["grams"]]), np.concatenate([np.frombuffer(x, np.uint8) for x in held["counts"]])
        distinct, of = np.unique(grams, return_inverse=True)
        total = np.minimum(np.bincount(of, counts, len(distinct)), MANY).astype(np.uint8)[of]
        ends = np.cumsum([len(x) // 8 for x in held["grams"]])
        parts = [x.tobytes() for x in np.split(total, ends[:-1])]
        yield pa.RecordBatch.from_arrays([pa.array(held["block"], pa.int64()), pa.array([column] * len(parts), pa.int64()), pa.array(parts, pa.binary())], ["block", "column", "counts"])


def _counted(blocks: DataFrame, columns: int) -> DataFrame:
    """blocks with `counts`: how many sets have each n-gram of the block's, distinct and in order."""
    slices = blocks.select("block", "grams").mapInArrow(_slices(columns), "column long, block long, grams binary, counts binary")
    counts = slices.repartition("column").sortWithinPartitions("column", "block").mapInArrow(_frequencies, "block long, column long, counts binary")
    counts = written(counts, "ngrams-counts", **LARGE_ROWS)
    by_block = counts.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("column", "counts"))).alias("slices")).select("block", "slices.counts")  # the slices of a block, which is bounded
    return blocks.join(by_block, "block", "left")


def _with_counts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each block: nodes, sizes, lengths, n-grams, and each n-gram's number of sets."""
    for nodes, sizes, lengths, grams, counts in zip(*(batch.column(c) for c in ("set_nodes", "set_sizes", "lengths", "grams", "counts"))):
        grams, parts = np.frombuffer(grams.as_py(), np.uint64), counts.as_py()
        of = np.frombuffer(b"".join(parts), np.uint8)[np.unique(grams, return_inverse=True)[1]] if parts else np.empty(0, np.uint8)
        yield *(np.array(x.as_py(), k) for x, k in ((nodes, np.int64), (sizes, np.int64), (lengths, np.int64))), grams, of


def _alive(percent: int):
    """Counted blocks -> (node) of the sets that can have a partner: of all n-grams that were looked at, not too many are theirs alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nodes, sizes, lengths, _, counts in _with_counts(batch):
                owner = np.repeat(np.arange(len(nodes)), lengths)
                alone = np.bincount(owner, counts == 1, len(nodes))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[alone <= sizes - _least(sizes, percent)])], ["node"])
            given_back()

    return run


def _least(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Shared n-grams that a set needs with any partner: percent of its own."""
    return -(-sizes * percent // 100)


def _prefixes(percent: int, most: int, columns: int):
    """Counted blocks -> (column, grams, nodes, sizes, spare, links): the first n-grams of each set, in order of (count, hash), and links within the block.

    Of n-grams of more than `most` sets the block's sets are linked to the smallest of them, and only that one
    goes on, with a size of 0. spare: how many of a set's first n-grams are such.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nodes, sizes, lengths, grams, counts in _with_counts(batch):
                owner = np.repeat(np.arange(len(nodes)), lengths)
                order = np.lexsort((grams, counts, owner))
                grams, counts = grams[order], counts[order]
                rank = np.arange(len(grams)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                first = (rank <= (sizes - _least(sizes, percent))[owner]) & (counts > 1)
                common = counts > most
                spare = np.bincount(owner, first & common, len(nodes)).astype(np.int64)
                rare, often = np.flatnonzero(first & ~common), np.flatnonzero(first & common)
                by = np.lexsort((nodes[owner[often]], grams[often]))
                often = often[by]
                starts = np.flatnonzero(np.append(True, grams[often][1:] != grams[often][:-1])) if len(often) else np.empty(0, np.int64)
                leader = np.repeat(often[starts], np.diff(np.append(starts, len(often))))
                links = np.unique(np.stack((nodes[owner[often]], nodes[owner[leader]]), axis=1), axis=0)
                links = links[links[:, 0] != links[:, 1]]
                out = np.concatenate((rare, often[starts]))
                kept, size = owner[out], np.where(common[out], 0, sizes[owner[out]])
                by = np.lexsort((nodes[kept], grams[out]))
                out, kept, size = out[by], kept[by], size[by]
                at, start = np.unique(_column(grams[out], columns), return_index=True)
                parts = list(zip(start, [*start[1:], len(out)]))
                if not len(parts) and not len(links):
                    continue
                values = (grams[out], nodes[kept], size.astype(np.int32), spare[kept].astype(np.int32))
                rows = [pa.array(at), *(pa.array([x[a:b].tobytes() for a, b in parts], pa.binary()) for x in values), pa.nulls(len(at), pa.binary())]
                yield pa.RecordBatch.from_arrays(rows, ["column", "grams", "nodes", "sizes", "spare", "links"])
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), *(pa.nulls(1, pa.binary()) for _ in range(4)), pa.array([links.tobytes()], pa.binary())], ["column", "grams", "nodes", "sizes", "spare", "links"])
            given_back()

    return run


def _multiplied(percent: int):
    """Slices of prefixes in order of column -> (a, b, overlap, least): overlap counts of pairs in this block of columns, and the least count that the pair needs in all; links of common n-grams need none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _grouped(batches, "column"):
            grams, nodes = (np.concatenate([np.frombuffer(x, k) for x in held[c]]) for c, k in (("grams", np.uint64), ("nodes", np.int64)))
            sizes, spare = (np.concatenate([np.frombuffer(x, np.int32) for x in held[c]]).astype(np.int64) for c in ("sizes", "spare"))
            order = np.lexsort((nodes, grams))
            grams, nodes, sizes, spare = grams[order], nodes[order], sizes[order], spare[order]
            first = np.append(True, grams[1:] != grams[:-1])
            rank = np.arange(len(grams)) - np.maximum.accumulate(np.where(first, np.arange(len(grams)), 0))
            leader = np.arange(len(grams)) - rank
            common = np.flatnonzero((sizes == 0) & (rank > 0))
            found = [(nodes[leader[common]], nodes[common], np.zeros(len(common), np.int64), np.zeros(len(common), np.int64))]
            i, o = np.flatnonzero((rank >= 1) & (sizes > 0)), 1
            while len(i):
                a, b = i - o, i
                fits = (np.minimum(sizes[a], sizes[b]) * 100 >= np.maximum(sizes[a], sizes[b]) * percent) & (nodes[a] != nodes[b])
                a, b = a[fits], b[fits]
                needed = -(-(sizes[a] + sizes[b]) * percent // (100 + percent))  # n-grams that an alike pair shares
                least = np.minimum(*(needed - _least(sizes[x], percent) + 1 - spare[x] for x in (a, b)))
                found.append((nodes[a], nodes[b], np.ones(len(a), np.int64), least))
                o += 1
                i = i[rank[i] >= o]
            a, b, overlap, least = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((b, a))
            a, b, overlap, least = a[order], b[order], overlap[order], least[order]
            if len(a):
                starts = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
                columns = [a[starts], b[starts], np.add.reduceat(overlap, starts), np.minimum.reduceat(least, starts)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["a", "b", "overlap", "least"])
            given_back()

    return run


def _joined(node: np.ndarray, label: np.ndarray, left: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join all rows which alike pairs with a row of the left join: the rows' sparse product, row by row, without products of rows that are joined already."""
    label = np.unique(label, return_inverse=True)[1]
    order = np.lexsort((np.bincount(label)[label], ~left))  # a large group comes last, when the others may have joined it
    node, label, sets = node[order], label[order], [sets[i] for i in order]
    sizes = np.array(list(map(len, sets)), np.int64)
    column = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    by = np.argsort(column, kind="stable")
    rows = np.repeat(np.arange(len(sets)), sizes)[by]  # of each column, one after another
    many = np.bincount(column)
    starts = np.cumsum(many) - many
    found: list[tuple[int, int]] = []
    parts = len(np.unique(label))
    for i in range(int(left.sum())):
        if parts == 1:
            break
        rest = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        rest = rest[np.minimum(sizes[rest], sizes[i]) * 100 >= np.maximum(sizes[rest], sizes[i]) * percent]
        if not len(rest):
            continue
        own = column[ends[i] - sizes[i] : ends[i]]
        if many[own].sum() <= 2 * sizes[rest].sum():
            n = many[own]
            at = np.repeat(starts[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
            overlap = np.bincount(rows[at], minlength=len(sets))[rest]
        else:
            flat = np.concatenate([sets[j] for j in rest])
            hit = sets[i][np.minimum(np.searchsorted(sets[i], flat), sizes[i] - 1)] == flat
            overlap = np.add.reduceat(hit, np.cumsum(sizes[rest]) - sizes[rest], dtype=np.int64)
        alike = rest[overlap * (100 + percent) >= percent * (sizes[rest] + sizes[i])]
        joined, first = np.unique(label[alike], return_index=True)
        found += [(int(node[i]), int(node[j])) for j in alike[first]]
        label[np.isin(label, joined)] = label[i]
        parts -= len(joined)
    return found


def _compared(percent: int):
    """(component, low, high, node, label, at_left, grams) in order of the first four -> links (a, b) that span each group of the first three."""

    def links(held: dict[str, list]) -> pa.RecordBatch:
        node = np.array(held["node"], np.int64)
        once = np.flatnonzero(np.append(True, node[1:] != node[:-1]))  # a set may stand in two blocks
        sets = [np.frombuffer(held["grams"][i], np.uint64) for i in once]
        found = _joined(node[once], np.array(held["label"], np.int64)[once], np.array(held["at_left"], bool)[once], sets, percent)
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs.max(axis=1)), pa.array(pairs.min(axis=1))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, {}
        for batch in sliced(batches, 1024):
            for row in batch.to_pylist():
                key = row["component"], row["low"], row["high"]
                if held and key != last:
                    yield links(held)
                    held = {}
                last = key
                for name in ("node", "label", "at_left", "grams"):
                    held.setdefault(name, []).append(row[name])
        if held:
            yield links(held)

    return run


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks -> (node, grams) of their sets."""
    for batch in batches:
        for nodes, lengths, grams in zip(*(batch.column(c) for c in ("set_nodes", "lengths", "grams"))):
            sets = _ragged(grams.as_py(), np.array(lengths.as_py(), np.int64))
            for at in range(0, len(sets), 256):
                yield pa.RecordBatch.from_arrays([nodes.values.slice(at, 256), pa.array([x.tobytes() for x in sets[at : at + 256]], pa.binary())], ["node", "grams"])
        given_back()


def _group_links(blocks: DataFrame, groups: DataFrame, percent: int, most_rows: int = ROWS, most_bytes: int = BYTES) -> DataFrame:
    """Links (a, b) that join, within each group (node, component), all sets which alike pairs join.

    A group of up to most_rows rows is multiplied by one task. A larger one is dealt in pieces: each piece by
    itself, then a row of each piece's largest part with those of the others, then the rows outside the
    group's largest part with all rows, by pairs of pieces. Rows of that part are joined, so no pair of
    them needs a look.
    """
    sizes_of = F.expr("explode(arrays_zip(set_nodes, set_sizes))")
    sizes = blocks.select(sizes_of.alias("s")).select(F.col("s.set_nodes").alias("node"), F.col("s.set_sizes").alias("size")).distinct()
    members = written(groups.join(sizes, "node"), "ngrams-members")
    pieces = lambda n, size: F.greatest(F.ceil(F.col(n) / most_rows), F.ceil(F.col(size) * 8 / most_bytes), F.lit(1)).cast("int")
    dealt = written(members.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("grams")).select("component", pieces("n", "grams").alias("pieces")), "ngrams-pieces")
    piece = lambda n, seed: F.expr(f"cast(pmod(xxhash64(node, {seed}), {n}) as int)")
    rows = written(members.join(dealt, "component").withColumn("piece", piece("pieces", 0)), "ngrams-rows")
    sets = blocks.select("set_nodes", "lengths", "grams").mapInArrow(_opened, "node long, grams binary")
    sets = written(sets.join(groups.select("node"), "node", "left_semi"), "ngrams-sets")

    def compared(some: DataFrame) -> DataFrame:
        full = some.select("component", "low", "high", "node", "label", "at_left").join(sets, "node")
        full = full.repartition("component", "low", "high").sortWithinPartitions("component", "low", "high", "node")
        return written(full.select("component", "low", "high", "node", "label", "at_left", "grams").mapInArrow(_compared(percent), "a long, b long"), "ngrams-alike")

    links = compared(rows.withColumns({"low": F.col("piece"), "high": F.col("piece"), "label": F.col("node"), "at_left": F.lit(True)}))
    large = rows.where("pieces > 1")
    spent = [members, dealt, rows, sets]
    if not large.isEmpty():

        def labelled(found: DataFrame) -> DataFrame:
            known = components(found, "ngrams-components").select("node", F.col("component").alias("known"))
            return written(large.join(known, "node", "left").withColumn("label", F.coalesce("known", "node")).drop("known"), "ngrams-labels")

        first = labelled(links)
        parts = first.groupBy("component", "piece", "label").agg(F.count("*").alias("n"), F.min("node").alias("node"))
        leaders = parts.groupBy("component", "piece").agg(F.max_by(F.struct("label", "node"), F.struct("n", "label")).alias("p"))
        # Leaders of up to most_rows pieces meet in one task; those of more by hash, which joins less of them but loses nothing.
        leaders = leaders.join(dealt, "component").select("component", F.lit(-1).alias("low"), (-1 - F.expr(f"cast(pmod(xxhash64(piece), ceil(pieces / {most_rows})) as int)")).alias("high"), "p.node", "p.label", F.lit(True).alias("at_left"))
        links = written(links.unionByName(compared(leaders)), "ngrams-alike")
        second = labelled(links)
        main = second.groupBy("component", "label").agg(F.count("*").alias("n")).groupBy("component").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
        second = second.join(written(main, "ngrams-main"), "component").withColumn("odd", F.col("label") != F.col("main"))
        second = written(second, "ngrams-odd")
        odd = second.where("odd").groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("grams")).select("component", pieces("n", "grams").alias("odd_pieces"))
        dealt_out = second.join(written(odd, "ngrams-odd-pieces"), "component")
        lefts = dealt_out.where("odd").withColumns({"low": piece("odd_pieces", 1), "high": F.explode(F.expr("sequence(0, pieces - 1)")), "at_left": F.lit(True)})
        rights = dealt_out.withColumns({"low": F.explode(F.expr("sequence(0, odd_pieces - 1)")), "high": F.col("piece"), "at_left": F.lit(False)})
        rights = rights.where(~F.col("odd") | (F.col("low") != piece("odd_pieces", 1)))  # those are on the left there
        links = written(links.unionByName(compared(lefts.unionByName(rights))), "ngrams-alike")
        spent += [first, second]
    dropped(*spent)
    return links


def _columns(blocks: DataFrame, column_grams: int) -> int:
    n = blocks.agg(F.coalesce(F.sum(F.octet_length("grams")), F.lit(0))).first()[0] // 8
    return max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // column_grams))


def linked(docs: DataFrame, shingle: int = 5, similarity: Fraction = Fraction(4, 5), most: int = MOST, block_bytes: int = BLOCK_BYTES, column_grams: int = COLUMN_GRAMS, doc_id: str = "doc_id", text: str = "text", **group) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs: component_id is the smallest doc_id reachable by links of at least the similarity.

    Two documents link when the Jaccard similarity of their sets of n-grams (of 64-bit hashes) is that much
    or more, exactly; it must be a whole percentage over 50. A-Z are lower-cased. A text with fewer words than an n-gram has
    is one n-gram; a null, empty or blank one has none and links with nothing, so that its component is its
    own doc_id. Equal sets link. Null doc_ids are never smallest, and a component of them alone has a null
    one. Repeated rows stay; doc_ids are cast to long. Other columns are not read.
    """
    percent = int(similarity * 100)
    if percent != similarity * 100 or not 50 < percent <= 100:
        raise ValueError("similarity must be a whole percentage over 50")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("text"))
    seen = written(rows.mapInArrow(_blocks(shingle, SHARE, block_bytes), BLOCKS), "ngrams-seen", **LARGE_ROWS)
    alive = _counted(seen, _columns(seen, column_grams)).mapInArrow(_alive(percent), "node long")
    alive = written(alive.distinct(), "ngrams-alive")
    own = seen.select(F.explode(F.arrays_zip("doc_ids", "ties", "nodes", "sizes")).alias("r")).select(F.col("r.doc_ids").alias("doc_id"), F.col("r.ties").alias("tie"), F.col("r.nodes").alias("node"), F.col("r.sizes").alias("n"))
    own = written(own, "ngrams-own")
    dropped(seen)
    # Of each living set one document is read again; texts are shuffled only if they fall in its bucket.
    one = own.join(alive, "node", "left_semi").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie")).alias("d")).select(F.col("d.doc_id").alias("one_id"), F.col("d.tie").alias("one_tie"))
    one = written(one, "ngrams-one")
    bucket = lambda d, t: F.expr(f"pmod(xxhash64({d}, {t}), {BUCKETS}L)").alias("bucket")
    some = rows.withColumn("bucket", bucket("doc_id", "tie")).join(F.broadcast(one.select(bucket("one_id", "one_tie")).distinct()), "bucket", "left_semi")  # BUCKETS rows at most
    again = some.join(one, F.col("doc_id").eqNullSafe(F.col("one_id")) & (F.col("tie") == F.col("one_tie")), "left_semi").select("doc_id", "tie", "text")
    blocks = written(again.mapInArrow(_blocks(shingle, 1 << 16, block_bytes), BLOCKS), "ngrams-blocks", **LARGE_ROWS)
    columns = _columns(blocks, column_grams)
    first = written(_counted(blocks, columns).mapInArrow(_prefixes(percent, most, columns), "column long, grams binary, nodes binary, sizes binary, spare binary, links binary"), "ngrams-first", **LARGE_ROWS)
    pairs = first.where("column is not null").drop("links").repartition("column").sortWithinPartitions("column").mapInArrow(_multiplied(percent), "a long, b long, overlap long, least long")
    pairs = pairs.groupBy("a", "b").agg(F.sum("overlap").alias("overlap"), F.min("least").alias("least")).where("overlap >= least").select("a", "b")
    within = first.where("links is not null").select("links").mapInArrow(_pairs, "a long, b long")
    groups = written(components(written(pairs.unionByName(within), "ngrams-candidates"), "ngrams-components"), "ngrams-groups")
    found = components(_group_links(blocks, groups, percent, **group), "ngrams-components")
    dropped(alive, one, blocks, first, groups)
    nodes = own.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    nodes = written(nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "ngrams-nodes")
    smallest = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = written(nodes.join(smallest, "component").select("node", "component_id"), "ngrams-named")
    linked_ = own.join(named, "node", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return linked_


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for links in batch.column("links"):
            flat = np.frombuffer(links.as_py(), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["a", "b"])
