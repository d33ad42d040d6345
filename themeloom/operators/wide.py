"""Eigenvectors of ``A'A`` for matrices too wide for a Gram matrix.

``A`` is a table with one row per article. A block of a few random vectors is
multiplied with ``A'A`` in one pass over the rows, the product gives the next
block, and so on (randomised block Krylov, after Musco and Musco, 2015). The
driver keeps the blocks, ``width`` by block by passes numbers, and never a
matrix of ``width`` by ``width``.

A pass broadcasts one block. Each task adds up its rows' share of the product
and sends one row per column that it met, so the shuffle is bounded by tasks
times ``width`` and the result by ``width`` rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.operators import products
from themeloom.operators.kmeans import pack, unpacked
from themeloom.operators.sizes import BROADCAST_NUMBERS
from themeloom.plans.staging import staged

# Vectors of a block beyond those asked for, passes at most, and when to stop.
OVERSAMPLE = 10
PASSES = 12
TOLERANCE = 1e-9
SEED = 0


def add_by_column(
    at: np.ndarray, values: np.ndarray, lengths: np.ndarray, rows: np.ndarray, total: np.ndarray
) -> None:
    """Add to ``total`` the transpose of rows given by their entries, times ``rows``."""
    ends = np.cumsum(lengths)
    # Numbers of two bytes are sorted by digits.
    kind = np.uint16 if len(total) <= 1 << 16 else at.dtype
    for begin, end in products.pieces(lengths, rows.shape[1]):
        first, last = ends[begin] - lengths[begin], ends[end - 1]
        if first == last:
            continue
        columns = at[first:last].astype(kind, copy=False)
        order = np.argsort(columns, kind="stable")
        owner = np.repeat(np.arange(begin, end), lengths[begin:end])[order]
        laid_out = rows[owner] * values[first:last][order, None]
        met, starts = np.unique(columns[order], return_index=True)
        total[met] += np.add.reduceat(laid_out, starts, axis=0)


def gram_times(
    table: DataFrame, block: np.ndarray, features: str | tuple[Column, Column] = "features"
) -> np.ndarray:
    """``A'A`` times ``block`` in one pass over the rows of ``A``."""
    return _packed_gram_times(_packed(table, features), block)


def _packed(table: DataFrame, features: str | tuple[Column, Column]) -> DataFrame:
    at, values = products.entries_of(features)
    return pack(table.select(at.alias("at"), values.alias("values")))


def _packed_gram_times(packed: DataFrame, block: np.ndarray) -> np.ndarray:
    width, size = block.shape
    shared = packed.sparkSession.sparkContext.broadcast(np.ascontiguousarray(block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, size))
        for lengths, at, values in unpacked(batches):
            rows = products.sums_by_row(at, values, lengths, shared.value)
            add_by_column(at, values, lengths, rows, total)
        met = np.flatnonzero(total.any(axis=1))
        sums = products.as_lists(total[met])
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), sums], ["pos", "sums"])

    parts = packed.mapInArrow(run, "pos int, sums array<double>")
    whole = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(size)]
    summed = parts.groupBy("pos").agg(*whole)
    summed = summed.select("pos", F.array(*[f"s{i}" for i in range(size)]).alias("sums"))
    # One row per column of the matrix at most.
    return products.matrix_of(summed.collect(), "pos", "sums", (width, size))


def _orthonormal(block: np.ndarray, known: np.ndarray | None, scale: float) -> np.ndarray:
    """Directions of ``block`` that ``known`` does not span, as orthonormal columns."""
    if known is not None:
        for _ in range(2):
            block = block - known @ (known.T @ block)
    left, sizes, _ = np.linalg.svd(block, full_matrices=False)
    fresh = left[:, sizes > 1e-11 * scale]
    if known is not None and fresh.shape[1]:
        fresh = np.linalg.qr(fresh - known @ (known.T @ fresh))[0]
    return fresh


def leading_eigenvectors(
    table: DataFrame,
    width: int,
    k: int,
    features: str | tuple[Column, Column] = "features",
    oversample: int = OVERSAMPLE,
    passes: int = PASSES,
    tolerance: float = TOLERANCE,
    seed: int = SEED,
) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``k`` largest eigenvalues of ``A'A``, their vectors, and the largest residual.

    The residual is the length of ``A'A v - s v`` over the largest eigenvalue.
    Passes end when it is at most ``tolerance``, when there is no direction
    left, which makes the result exact, or after ``passes``; the residual
    tells which. The table is read once; every pass reads its entries as
    packed bytes.
    """
    size = min(k + oversample, width)
    if 2 * width * size * passes > BROADCAST_NUMBERS:
        raise ValueError(f"{width} columns by {size} vectors are too many for the driver")
    start = np.random.default_rng(seed).standard_normal((width, size))
    block = _orthonormal(start, None, 1.0)
    basis = np.zeros((width, 0))
    images = np.zeros((width, 0))
    values, vectors, residual = np.zeros(0), basis, 0.0
    packed = staged(_packed(table, features), "packed-rows")
    for _ in range(passes):
        image = _packed_gram_times(packed, block)
        basis, images = np.hstack([basis, block]), np.hstack([images, image])
        small = basis.T @ images
        found, turns = np.linalg.eigh((small + small.T) / 2)
        top = np.argsort(found)[::-1][:k]
        values, turns = found[top], turns[:, top]
        vectors = basis @ turns
        largest = values[0] if len(values) else 0.0
        if largest <= 0:
            return values, vectors, 0.0
        off = images @ turns - vectors * values
        residual = float(np.linalg.norm(off, axis=0).max() / largest)
        block = _orthonormal(image, basis, largest)
        if residual <= tolerance or not block.shape[1]:
            break
    return values, vectors, residual
