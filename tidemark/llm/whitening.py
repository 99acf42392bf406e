"""Whitening of embeddings by LOBPCG.

The leading eigenvectors of the covariance are found without the covariance itself: each step multiplies
it with a thin block of directions, as sums of products over centred rows that every task makes of its
own rows, and solves a small eigenproblem (Rayleigh-Ritz) on what the iterate, its residuals and the
previous directions span. A step is one pass over the rows and moves dimensions x directions numbers a
task. The pass that a step makes gives the true residuals of its result, so the iteration ends when these
certify the eigenvectors, and never returns any that are not certified.

Vectors are kept as whole numbers, floor(scale * entry), so that means, deviations and the trace are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .words import sliced

#: Directions beyond those asked for, which speed the last ones up; steps before giving up.
GUARD, STEPS = 8, 500
#: Residuals that certify, as a share of the largest eigenvalue, and the share below which an eigenvalue counts as 0.
CERTIFIED, RANK = 1e-12, 1e-12
#: Rows that a task turns to doubles at once.
ROWS = 2048


@dataclass(frozen=True)
class Whitening:
    """A fit: n vectors with sums of `dimensions` whole numbers (without the shift), components (a column each), their eigenvalues, the trace."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float
    residual: float
    steps: int


def whole_vectors(rows: DataFrame, scale: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and y, floor(scale * entry) of each entry as double, of the rows whose vector and entries are there and finite."""
    entry = "cast(c as double)"
    rows = rows.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("v"))
    rows = rows.where(f"v is not null and forall(v, c -> c is not null and abs({entry}) < double('infinity'))")
    return rows.select("vec_id", F.expr(f"transform(v, c -> cast(floor({scale} * {entry}) as bigint))").alias("y"))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    """Lists of whole numbers as rows; shorter ones end in zeros."""
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dimensions).all():
        return flat.reshape(len(column), dimensions)
    out = np.zeros((len(column), dimensions), np.int64)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y) -> (i, total, squares) for each dimension, as text; i = -1 has the number of rows."""
    rows, totals, squares = 0, [], []
    for batch in batches:
        sizes = np.diff(batch.column("y").offsets.to_numpy())
        rows += len(batch)
        if not len(batch) or not sizes.max():
            continue
        y = _matrix(batch.column("y"), int(sizes.max()))
        y = y if np.abs(y).max() < 1 << 20 and len(y) < 1 << 20 else y.astype(object)
        totals += [0] * (y.shape[1] - len(totals))
        squares += [0] * (y.shape[1] - len(squares))
        for i, (a, b) in enumerate(zip(y.sum(axis=0).tolist(), (y * y).sum(axis=0).tolist())):
            totals[i] += a
            squares[i] += b
    if rows:
        columns = [[-1, *range(len(totals))], [str(rows), *map(str, totals)], ["0", *map(str, squares)]]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1]), pa.array(columns[2])], ["i", "total", "squares"])


def _centred(y: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * y - sums, exactly."""
    fits = (int(np.abs(y).max(initial=0)) + 1) * n < 1 << 61 and all(abs(int(s)) < 1 << 61 for s in sums)
    return y * n - sums.astype(np.int64) if fits else y.astype(object) * n - sums


def _squared(z: np.ndarray) -> list[int | None]:
    """Sums of squares by row, exactly; None where a long can't hold one."""
    if z.dtype != object and int(np.abs(z).max(initial=0)) ** 2 * max(1, z.shape[1]) < 1 << 63:
        return (z * z).sum(axis=1).tolist()
    return [s if s < 1 << 63 else None for s in (sum(int(v) ** 2 for v in row) for row in z)]


def _summed(rows: DataFrame, run) -> dict[tuple[int, int], float]:
    """Sums by (i, j) of what run makes of each task's rows; their number doesn't depend on that of the rows."""
    found = rows.select("y").mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    return {(r.i, r.j): r.value for r in found.collect()}


def _cells(matrix: np.ndarray) -> pa.RecordBatch:
    i, j = np.indices(matrix.shape, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(matrix.ravel())], ["i", "j", "value"])


def _array(cells: dict[tuple[int, int], float], *shape: int) -> np.ndarray:
    out = np.zeros(shape)
    for at, value in cells.items():
        out[at] = value
    return out


def _product(rows: DataFrame, n: int, sums: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """The covariance of the rows times the directions, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in sliced(batches, ROWS):
            z = _centred(_matrix(batch.column("y"), len(sums)), n, sums).astype(np.float64) / n
            own = z.T @ (z @ directions)
            out = own if out is None else out + own
        if out is not None:
            yield _cells(out / n)

    return _array(_summed(rows, run), *directions.shape)


def _span(blocks: list[np.ndarray]) -> np.ndarray:
    """An orthonormal basis of what the blocks span; the first is orthonormal and comes first, as it is."""
    basis = blocks[0]
    for block in blocks[1:]:
        norms = np.linalg.norm(block, axis=0)
        block = block[:, norms > 0] / norms[norms > 0]
        for _ in range(2):
            block = block - basis @ (basis.T @ block)
            left, sizes, _ = np.linalg.svd(block, full_matrices=False)
            block = left[:, sizes > 1e-8]
        basis = np.hstack((basis, block[:, : len(basis) - basis.shape[1]]))
    return basis


def fitted(rows: DataFrame, components: int = 32, certified: float = CERTIFIED, steps: int = STEPS, seed: int = 3) -> Whitening:
    """The leading components of the covariance (divisor n) of rows (y), numbered by falling eigenvalue.

    No more components are returned than there are dimensions, and none whose eigenvalue is 0 (to
    rounding), as nothing can be whitened along it. rows should be a stored table: each step reads it once.
    """
    found = {r.i: (int(r.total), int(r.squares)) for r in rows.select("y").mapInArrow(_totals, "i int, total string, squares string").groupBy("i").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("total", "squares"))).collect()}
    n = found.pop(-1, (0, 0))[0]
    sums = tuple(found[i][0] for i in range(len(found)))
    d = len(sums)
    trace = sum(n * squares - total * total for total, squares in found.values()) / n / n if n else 0.0
    k = min(components, d)
    if not trace or not k:
        return Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), trace, 0.0, 0)
    x = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, min(d, k + GUARD))))[0]
    blocks, centre = [x], np.array(sums, object)
    for step in range(1, steps + 1):
        basis = _span(blocks)
        product = _product(rows, n, centre, basis)
        small = basis.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][: x.shape[1]], turn[:, ::-1][:, : x.shape[1]]
        before, x = x, basis @ turn
        residuals = product @ turn - x * values
        sizes = np.linalg.norm(residuals, axis=0)
        if (sizes[:k] <= certified * values[0]).all():
            keep = np.flatnonzero(values[:k] > RANK * values[0])
            return Whitening(n, sums, x[:, keep], values[keep], trace, float(sizes[:k].max()), step)
        blocks = [np.linalg.qr(x)[0], residuals[:, sizes > certified * values[0]], basis[:, before.shape[1] :] @ turn[before.shape[1] :]]
    raise RuntimeError(f"residuals of {sizes[:k].max()} after {steps} steps aren't below {certified * values[0]}")


def _whitened(fit: Whitening, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n * y - sums, and its projections."""
    z = _centred(y, fit.n, np.array(fit.sums, object))
    return z, (z.astype(np.float64) / fit.n) @ (fit.components / np.sqrt(fit.values))


def identity_error(rows: DataFrame, fit: Whitening) -> float:
    """The largest entry, in absolute value, of the covariance of rows' whitened vectors minus the identity: measured on the rows."""
    k = len(fit.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((k + 1, k))
        for batch in sliced(batches, ROWS):
            w = _whitened(fit, _matrix(batch.column("y"), len(fit.sums)))[1]
            out += np.vstack((w.T @ w, w.sum(axis=0)))
        yield _cells(out)

    if not k:
        return 0.0
    moments = _array(_summed(rows, run), k + 1, k) / fit.n
    return float(np.abs(moments[:k] - np.outer(moments[k], moments[k]) - np.eye(k)).max())


def projected(rows: DataFrame, fit: Whitening) -> DataFrame:
    """vec_id, component (from 1), deviation and whitened of each row (vec_id, y) along each component."""
    k = len(fit.values)
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, ROWS):
            if k and len(batch):
                z, w = _whitened(fit, _matrix(batch.column("y"), len(fit.sums)))
                at = np.repeat(np.arange(len(batch)), k)
                columns = [batch.column("vec_id").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(batch))), pa.array(_squared(z), pa.int64()).take(pa.array(at)), pa.array(w.ravel())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "deviation", "whitened"])

    return rows.select("vec_id", "y").mapInArrow(run, f"vec_id {kind}, component int, deviation long, whitened double")


def whitened(rows: DataFrame, components: int = 32, scale: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each vector along each component.

    All vectors that aren't dropped (null, or with entries that are null or not finite) are fitted and
    projected. Vectors shorter than the longest end in zeros. Equal vectors, and rows repeated or with a
    null vec_id, stay rows of their own. deviation is null where a long can't hold it. Components with an
    eigenvalue of 0 are left out, so that equal vectors alone, empty vectors and an empty table give no
    rows. Other columns are not read.
    """
    table = written(whole_vectors(rows, scale, vec_id, embedding), "whitening-vectors")
    fit = fitted(table, components)
    error = identity_error(table, fit)
    shares = F.array(*(F.lit(float(v) / fit.trace) for v in fit.values)) if len(fit.values) else F.array(F.lit(0.0))
    found = projected(table, fit)
    return found.select("vec_id", "component", F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(shares, F.col("component")).alias("explained"), F.lit(error).alias("identity_error"))
