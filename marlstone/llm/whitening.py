"""PCA whitening of embeddings by a tiled covariance.

1. Entries become whole numbers x; each distinct vector counts once in the fit.
2. The fit list is cut into row-blocks (an Arrow batch each) and column blocks of ``TILE`` dimensions. Column blocks are
   shuffled by row-block, where each pair of them that a tile (I, J) with I <= J needs is multiplied.
3. Products are summed per tile in the task and then by rows of tiles over all tasks; the driver assembles the matrix, whose
   size is that of the dimensions, and decomposes it.

Vectors are centred before they are multiplied, on the whole number nearest to each mean. So all products and their sums are
whole numbers, exact in doubles below 2^53, and the same whatever the partitioning; what is left of the means (at
most a half) is taken off exactly at the end. Data that aren't whole numbers go the same way with common rounding.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

TILE = 32
COMPONENTS = 16
#: 64 times an entry is cut to this size, so that x stays a long.
LARGEST = float(1 << 56)
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def whole_numbers(embedding: Column) -> Column:
    """floor(64 * c) + 1000000 of each entry."""
    scaled = lambda c: F.least(F.greatest(c.cast("double") * 64, F.lit(-LARGEST)), F.lit(LARGEST))
    return F.transform(embedding, lambda c: F.floor(scaled(c)).cast("long") + F.lit(1000000).cast("long"))


def usable(embedding: Column) -> Column:
    """Whether a vector is there and all its entries are finite; an empty one isn't usable."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != F.lit(float("inf")))
    return F.coalesce((F.size(embedding) > 0) & F.forall(embedding, finite), F.lit(False))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def column_sums(vectors: DataFrame, dims: int) -> tuple[int, list[int]]:
    """(number of rows, exact sums per dimension) of whole-number vectors ``x``."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dims
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"), dims)
                high, low = x >> 32, x & 0xFFFFFFFF  # no sum of a batch leaves 64 bits
                n += len(x)
                sums = [s + (int(h) << 32) + int(r) for s, h, r in zip(sums, high.sum(axis=0), low.sum(axis=0), strict=True)]
        rows = [Decimal(n), *map(Decimal, sums)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dims + 1), pa.int32()), pa.array(rows, pa.decimal128(38, 0))], names=["at", "total"])

    rows = vectors.select("x").mapInArrow(partial, "at int, total decimal(38,0)").groupBy("at").agg(F.sum("total").cast("decimal(38,0)").alias("total")).collect()  # a row per dimension
    totals = {r["at"]: int(r["total"]) for r in rows}
    return totals.get(0, 0), [totals.get(d + 1, 0) for d in range(dims)]


def tiled_products(vectors: DataFrame, dims: int, prepare, tile: int = TILE) -> np.ndarray:
    """The sum over rows of v v' as a matrix, where ``prepare`` makes the rows v (as doubles) of a batch of ``vectors``.

    ``vectors`` has to be a written table: both sides of the join of column blocks number its row-blocks by their place.
    """
    starts = range(0, dims, tile)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(b for b in batches if b.num_rows):
            v, name = prepare(batch), (TaskContext.get().partitionId() << 32) + number
            cells = [np.ascontiguousarray(v[:, s : s + tile]).tobytes() for s in starts]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(cells), pa.int64()), pa.array(range(len(cells)), pa.int32()), pa.array(cells, pa.binary())], names=["row_block", "column_block", "cells"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, j, left, right in zip(*[batch.column(c) for c in ("i", "j", "left_cells", "right_cells")], strict=True):
                i, j = i.as_py(), j.as_py()
                a, b = (np.frombuffer(c.as_buffer(), np.float64).reshape(-1, min(tile, dims - tile * k)) for k, c in ((i, left), (j, right)))
                product = a.T @ b
                sums[i, j] = sums[i, j] + product if (i, j) in sums else product
        for (i, j), product in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(product), pa.int32()), pa.array([j] * len(product), pa.int32()), pa.array(range(len(product)), pa.int32()), pa.array(list(product), pa.list_(pa.float64()))], names=["i", "j", "row", "products"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            for i, j, row, products in zip(*[batch.column(c).to_pylist() for c in ("i", "j", "row")], batch.column("products"), strict=True):
                more = products.values.to_numpy()
                sums[i, j, row] = sums[i, j, row] + more if (i, j, row) in sums else more
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([*[pa.array([k[c] for k in keys], pa.int32()) for c in range(3)], pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["i", "j", "row", "products"])

    cut = vectors.mapInArrow(blocks, "row_block long, column_block int, cells binary")
    left, right = cut.select("row_block", F.col("column_block").alias("i"), F.col("cells").alias("left_cells")), cut.select("row_block", F.col("column_block").alias("j"), F.col("cells").alias("right_cells"))
    pairs = left.join(right.hint("merge"), "row_block").filter("i <= j")
    rows = "i int, j int, row int, products array<double>"
    strips = pairs.select("i", "j", "left_cells", "right_cells").mapInArrow(multiply, rows)
    out = np.zeros((dims, dims))
    for r in strips.repartition("i", "j", "row").mapInArrow(add, rows).collect():  # a row per dimension and tile column
        at, first = tile * r.i + r.row, tile * r.j
        out[at, first : first + len(r.products)] = r.products
    return np.triu(out) + np.triu(out, 1).T


def eigen_components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) by falling eigenvalue, ``most`` of them. Each vector's largest entry is positive; values that are zero to rounding are 0."""
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values, kind="stable")[::-1][:most]
    values, vectors = values[order], vectors[:, order]
    values = np.where(values > len(covariance) * np.finfo(float).eps * max(values.max(initial=0.0), 0.0), values, 0.0)
    largest = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.where(vectors[largest, np.arange(len(order))] < 0, -1.0, 1.0)


def whiten(vectors: DataFrame, components: int = COMPONENTS, tile: int = TILE) -> DataFrame:
    """Of each usable row of (vec_id, embedding) and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    n is the number of distinct whole-number vectors x and S their sums; deviation is the sum of (n*x - S)^2 (null where
    that exceeds a long), whitened the projection of x - S/n over the square root of the eigenvalue, explained the
    eigenvalue's share of the trace, identity_error the largest absolute entry of the whitened fit list's covariance minus the identity.

    Rows whose vector is null, empty, or holds null or non-finite entries are dropped, and so are those of another length than
    most rows have (of equally frequent lengths the largest counts). Null and repeated vec_ids stay. Components of eigenvalue
    zero (constant data, fewer vectors than dimensions) have null whitened, and explained is null if all are; identity_error
    covers the others and is null if there is none. With fewer dimensions than ``components`` there are as many components as dimensions.
    Other columns are ignored. A table without usable rows gives no rows.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "whiten")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("embedding")).filter(usable(F.col("embedding")))
    lengths = rows.groupBy(F.size("embedding").alias("dims")).agg(F.count(F.lit(1)).alias("rows"))
    dims = lengths.agg(F.max(F.struct("rows", "dims"))["dims"]).first()[0]
    if dims is None:
        return spark.createDataFrame([], f"{WHITENED}, identity_error double")
    rows = rows.filter(F.size("embedding") == dims).select("vec_id", whole_numbers(F.col("embedding")).alias("x"))
    fit = scratch.keep(rows.select("x").distinct())
    n, sums = column_sums(fit, dims)

    near = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)  # the whole number nearest to each mean
    left = np.array([s - n * int(c) for s, c in zip(sums, near, strict=True)], float) / n
    centred = lambda batch: (_matrix(batch.column("x"), dims) - near).astype(float)
    covariance = tiled_products(fit, dims, centred, tile) / n - np.outer(left, left)
    values, directions = eigen_components(covariance, components)
    scales = np.where(values > 0, 1 / np.sqrt(np.where(values > 0, values, 1.0)), np.nan)
    project = lambda batch: (centred(batch) - left) @ directions * scales

    good = int((values > 0).sum())
    error = None
    if good:
        of_whitened = tiled_products(fit, good, lambda batch: project(batch)[:, :good], tile) / n
        error = float(np.abs(of_whitened - np.eye(good)).max())
    trace, k = float(np.trace(covariance)), len(values)
    explained = [float(v) / trace if trace > 0 else None for v in values]
    sums_of = np.array([s - n * int(c) for s, c in zip(sums, near, strict=True)], object)

    def deviations(x: np.ndarray) -> list[int | None]:
        """Exact: in 64 bits where they surely suffice, else by Python's whole numbers."""
        away = x - near
        if dims * (n * int(np.abs(away).max(initial=0)) + max(map(abs, sums_of))) ** 2 < 1 << 62:
            return ((n * away - sums_of.astype(np.int64)) ** 2).sum(axis=1).tolist()
        exact = [int(((n * row - sums_of) ** 2).sum()) for row in away.astype(object)]
        return [d if d < 1 << 63 else None for d in exact]

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = batch.num_rows
                out = project(batch).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, n)),
                        pa.array(deviations(_matrix(batch.column("x"), dims)), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(out, mask=np.isnan(out)),
                        pa.array(explained * m, pa.float64()),
                    ],
                    names=[c.split()[0] for c in WHITENED.split(", ")],
                )

    return rows.mapInArrow(whitened, WHITENED).withColumn("identity_error", F.lit(error).cast("double"))
