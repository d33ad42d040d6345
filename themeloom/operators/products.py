"""Products and distances of article rows with a small dense matrix.

An article is one row of a table, as an ML vector or an array. Rows go to
Python in Arrow batches, each batch is worked on as flat arrays, and every
article comes back as one row: nothing is laid out entry by entry and nothing
is shuffled. The dense matrix is broadcast; ``fits`` says when it may be.

The result of a row depends on that row alone, not on its batch.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.operators.batches import in_pieces
from themeloom.operators.sizes import BROADCAST_NUMBERS

# Numbers of a product that are laid out at once (4 MiB of doubles).
AT_ONCE = 500_000


def fits(rows: int, columns: int) -> bool:
    """Whether a matrix of that size may be sent to every executor."""
    return rows * max(columns, 1) <= BROADCAST_NUMBERS


def stored_entries(vector: Column) -> tuple[Column, Column]:
    """Positions and values of an ML vector, sparse or dense, as two arrays."""
    raw = F.unwrap_udt(vector)
    values = raw.getField("values")
    every = F.transform(values, lambda _, i: i)
    return F.when(raw.getField("type") == 0, raw.getField("indices")).otherwise(every), values


def entries_of(vector: str | tuple[Column, Column]) -> tuple[Column, Column]:
    """Positions and values of an ML vector column, or as they are given."""
    return stored_entries(F.col(vector)) if isinstance(vector, str) else vector


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and the length of each row; a null row is empty."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), lengths.astype(np.int64)


def as_lists(rows: np.ndarray) -> pa.Array:
    """A list column of the rows of a matrix."""
    n, width = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))


def pieces(lengths: np.ndarray, numbers_per_entry: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose entries, laid out, are about AT_ONCE numbers."""
    most = max(AT_ONCE // max(numbers_per_entry, 1), 1)
    ends = np.cumsum(lengths)
    begin = 0
    while begin < len(lengths):
        before = ends[begin - 1] if begin else 0
        end = max(int(np.searchsorted(ends, before + most, side="right")), begin + 1)
        yield begin, end
        begin = end


def sums_by_row(
    at: np.ndarray, values: np.ndarray, lengths: np.ndarray, dense: np.ndarray
) -> np.ndarray:
    """Rows given by their entries times ``dense``."""
    out = np.zeros((len(lengths), dense.shape[1]))
    ends = np.cumsum(lengths)
    for begin, end in pieces(lengths, dense.shape[1]):
        first, last = (ends[begin] - lengths[begin], ends[end - 1])
        laid_out = dense[at[first:last]] * values[first:last, None]
        filled = begin + np.flatnonzero(lengths[begin:end])
        if len(filled):
            starts = ends[filled] - lengths[filled] - first
            out[filled] = np.add.reduceat(laid_out, starts, axis=0)
    return out


def distances_by_row(values: np.ndarray, lengths: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of arrays to the rows of ``centres``; a missing position is zero."""
    width = max(int(lengths.max(initial=0)), centres.shape[1])
    padded = np.pad(centres, ((0, 0), (0, width - centres.shape[1])))
    out = np.empty((len(lengths), len(centres)))
    ends = np.cumsum(lengths)
    for begin, end in pieces(np.full(len(lengths), width), 1):
        rows = np.zeros((end - begin, width))
        own = lengths[begin:end]
        rows[np.arange(width) < own[:, None]] = values[ends[begin] - lengths[begin] : ends[end - 1]]
        for nth, centre in enumerate(padded):
            offsets = rows - centre
            out[begin:end, nth] = (offsets * offsets).sum(axis=1)
    return out


def _by_batch(
    table: DataFrame,
    columns: list[Column],
    carried: list[str],
    out: str,
    work: Callable[[list[pa.Array]], np.ndarray],
) -> DataFrame:
    """The carried columns, and ``out``, an array of doubles made from ``columns``."""
    n = len(carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            made = as_lists(work(batch.columns[n:]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], made], names=[*carried, out])

    schema = T.StructType(
        [*(table.schema[name] for name in carried), T.StructField(out, T.ArrayType(T.DoubleType()))]
    )
    named = [column.alias(f"column_{i}") for i, column in enumerate(columns)]
    return table.select(*carried, *named).mapInArrow(run, schema)


def times(
    table: DataFrame,
    dense: np.ndarray,
    vector: str | tuple[Column, Column] = "features",
    out: str = "product",
    carried: tuple[str, ...] = ("docid",),
    before: Callable[[np.ndarray], np.ndarray] | None = None,
    after: Callable[[np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """Every row's ML vector times ``dense``: the carried columns and ``out``.

    Instead of a vector there may be two columns, its positions and values.
    ``before`` changes the stored values of a batch, ``after`` its products.
    """
    shared = table.sparkSession.sparkContext.broadcast(np.ascontiguousarray(dense, dtype=float))

    def work(columns: list[pa.Array]) -> np.ndarray:
        at, lengths = flat(columns[0])
        values, _ = flat(columns[1])
        values = before(values) if before else values
        products = sums_by_row(at, values, lengths, shared.value)
        return after(products) if after else products

    return _by_batch(table, list(entries_of(vector)), list(carried), out, work)


def distances(
    table: DataFrame,
    centres: np.ndarray,
    vector: str = "vec",
    out: str = "far",
    carried: tuple[str, ...] = ("docid",),
) -> DataFrame:
    """Every row's array against each centre: the carried columns and ``out``.

    A row without an array is left out.
    """
    shared = table.sparkSession.sparkContext.broadcast(np.ascontiguousarray(centres, dtype=float))

    def work(columns: list[pa.Array]) -> np.ndarray:
        return distances_by_row(*flat(columns[0]), shared.value)

    known = table.where(F.col(vector).isNotNull())
    return _by_batch(known, [F.col(vector).cast("array<double>")], list(carried), out, work)


def matrix_of(rows: list, key: str, values: str, shape: tuple[int, int]) -> np.ndarray:
    """A dense matrix from collected rows of a number and an array; absent rows are zero."""
    dense = np.zeros(shape)
    for row in rows:
        dense[row[key]] = row[values]
    return dense
