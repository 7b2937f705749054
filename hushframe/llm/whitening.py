"""Whitening of vectors: centred coordinates along the main directions, each of unit variance.

Entries become integers, so sums, means and deviations are exact. The directions are fitted to each distinct vector
once. Tasks reduce their centred rows to a triangle, batch by batch, and triangles are reduced to one in a tree; its
singular values and right vectors (`bidiagonal`) are those of the whole table. Nothing but sums, the triangle (both of
the size of the dimensions) and the final directions passes the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .bidiagonal import block_qr, decompose
from .negatives import matrix

SCALE, SHIFT, MOST = 64, 1_000_000, 16
#: Triangles that one task reduces to one.
FAN = 16
#: Directions with less deviation than this share of the largest are rounding, not variance.
FLOOR = 1e-11
LONG_MAX = (1 << 63) - 1
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def clean(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``vec_id`` and ``x`` (whole numbers, all of one length) of the rows that take part, written out.

    Rows with a null vector, or one with null or non-finite entries, drop out. A shorter vector counts as zeros beyond its
    end; entries beyond 2**53 / ``scale`` count as that.
    """
    vector, most = F.col(vector_col).cast("array<double>"), F.lit(float(1 << 53))
    usable = vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(vector, lambda c: F.floor(F.greatest(-most, F.least(most, c * scale))) + F.lit(shift))
    rows = stage(table.where(usable).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("x")), "vectors")
    dims = rows.agg(F.max(F.size("x")), F.min(F.size("x"))).first()
    if dims[0] == dims[1]:
        return rows
    return rows.select("vec_id", F.concat("x", F.array_repeat(F.lit(shift).cast("long"), F.lit(dims[0]) - F.size("x"))).alias("x"))


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S, exact: as longs where they fit, else as Python integers."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) <= LONG_MAX:
        return n * x - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _rows(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of a size that bounds the memory of a task, with their vectors."""
    step = max(1, min(8192, (1 << 22) // dims))
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            yield part, matrix(pa.chunked_array([part["x"]]), dims)


def triangle(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The triangular factor of the centred rows of ``fit``: tasks reduce their rows, then FAN triangles at a time."""
    dims = len(sums)
    schema = pa.schema([("part", pa.int64()), ("i", pa.int64()), ("r", pa.list_(pa.float64()))])
    names = "part long, i long, r array<double>"

    def rows_of(part: int, r: np.ndarray) -> dict:
        return {"part": pa.array([part] * len(r), pa.int64()), "i": pa.array(range(len(r)), pa.int64()), "r": pa.array(r.tolist(), pa.list_(pa.float64()))}

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for _, x in _rows(batches, dims):
            r = block_qr(r, _centred(x, n, sums).astype(float) / n)
        if r is not None:
            yield pa.RecordBatch.from_pydict(rows_of(TaskContext.get().partitionId(), r), schema=schema)

    def merge(key: tuple, held: pa.Table) -> pa.Table:
        rows = held.sort_by([("part", "ascending"), ("i", "ascending")])["r"].to_pylist()
        return pa.table(rows_of(key[0].as_py(), block_qr(None, np.array(rows))), schema=schema)

    found = stage(fit.select("x").mapInArrow(first, names), "triangles")
    parts = (found.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        found = stage(found.select(F.expr(f"part div {FAN}").alias("key"), "part", "i", "r").groupBy("key").applyInArrow(merge, names), "triangles")
        parts = -(-parts // FAN)
    r = np.zeros((dims, dims))
    # At most as many rows as dimensions.
    for row in found.collect():
        r[row.i] = row.r
    return r


def directions(fit: DataFrame, n: int, sums: list[int], most: int = MOST) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling), unit eigenvectors as columns, and the trace, of the covariance of ``fit``."""
    r = triangle(fit, n, sums)
    squares, vectors = decompose(r, most)
    kept = squares > squares[:1] * FLOOR**2
    return squares[kept] / n, vectors[:, kept], float(np.sum(r * r)) / n


def _whitened(x: np.ndarray, n: int, sums: list[int], axes: np.ndarray) -> np.ndarray:
    return (_centred(x, n, sums).astype(float) / n) @ axes


def identity_error(fit: DataFrame, n: int, sums: list[int], axes: np.ndarray) -> float:
    """Largest absolute entry of the whitened covariance of ``fit`` less the identity."""
    k = axes.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for _, x in _rows(batches, len(sums)):
            w = _whitened(x, n, sums, axes)
            total += np.vstack([w.T @ w, w.sum(0)])
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(total.size), pa.int32()), "total": pa.array(total.ravel())})

    found = fit.select("x").mapInArrow(add, "at int, total double").groupBy("at").agg(F.sum("total").alias("total"))
    total = np.zeros((k + 1) * k)
    for row in found.collect():  # (k + 1) * k rows
        total[row["at"]] = row["total"]
    total = total.reshape(k + 1, k) / n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max(initial=0))


def mark(table: DataFrame, most: int = MOST, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row that takes part (see ``clean``) and component: RESULT.

    Repeated rows are whitened each but fitted once. Directions without variance are left out, so vectors that are all
    equal, a single vector, empty vectors and an empty table give no rows. A null id stays null. A deviation beyond a
    long's range becomes the largest long.
    """
    rows = clean(table, id_col, vector_col)
    fit = stage(rows.select("x").distinct(), "fit")
    n = fit.count()
    exact = fit.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(19,0)")).alias("total"))
    sums = [int(r.total) for r in exact.orderBy("at").collect()]  # one row per dimension
    values, vectors, trace = directions(fit, n, sums, most) if n and sums else (np.zeros(0), np.zeros((0, 0)), 0.0)
    if not len(values):
        return table.sparkSession.createDataFrame([], RESULT)
    axes = vectors / np.sqrt(values)
    error, k, explained = identity_error(fit, n, sums, axes), len(values), values / trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _rows(batches, len(sums)):
            away = _centred(x, n, sums)
            large = int(np.abs(away).max(initial=0)) ** 2 * len(sums) > LONG_MAX
            deviation = [min(int(d), LONG_MAX) for d in (away.astype(object) if large else away).__pow__(2).sum(1)]
            count = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    part["vec_id"].take(pa.array(np.repeat(np.arange(count), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)),
                    pa.array(np.full(count * k, n, np.int64)),
                    pa.array(np.repeat(np.array(deviation, np.int64), k)),
                    pa.array(((away.astype(float) / n) @ axes).ravel()),
                    pa.array(np.tile(explained, count)),
                    pa.array(np.full(count * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, RESULT)
