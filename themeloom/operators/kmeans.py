"""K-means whose result depends on the rows alone.

Rows are chosen as first centres by hashes of their ids, and what is added up
over rows is added in whole numbers: a value counts in units of a power of
two, so small that the sum of all rows still fits 64 bits. Whole numbers add
up to the same in any order, so a fit gives equal centres however the rows are
cut into tasks, on however many cores, and after the loss of an executor.

An iteration is one pass: tasks send a sum per centre and position, which are
added in groups if there are many tasks. The passes read the rows' entries out
of packed bytes, many rows in one, so that no entry is turned into a value of
a table again and again.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.operators.batches import in_pieces
from themeloom.operators.products import flat, stored_entries, sums_by_row
from themeloom.plans.staging import staged

# Passes that choose candidates, candidates of a pass per cluster, and local refinements of them.
ROUNDS = 2
CANDIDATES = 2
LOCAL_ITERATIONS = 30

# A fit ends when no centre moves further than this.
TOLERANCE = 1e-4

# Bytes of rows that are packed into one.
PACKED_BYTES = 1 << 20

# Sums of tasks that reach the driver.
GROUPS = 64


@dataclass(frozen=True)
class Units:
    """How values and squared distances are turned into whole numbers."""

    value_bits: int
    distance_bits: int

    def of_values(self, values: np.ndarray) -> np.ndarray:
        return np.rint(np.ldexp(values, self.value_bits)).astype(np.int64)

    def of_distances(self, distances: np.ndarray) -> np.ndarray:
        return np.rint(np.ldexp(distances, self.distance_bits)).astype(np.int64)


@dataclass(frozen=True)
class Rows:
    """``docid, at, values`` of the rows to be clustered, the same packed, and what bounds them."""

    table: DataFrame
    packed: DataFrame
    n: int
    width: int
    units: Units
    parts: int


def rows_of(table: DataFrame, features: str) -> Rows:
    """Read the bounds of a table of ML vectors; give a table that is cheap to read."""
    at, values = stored_entries(F.col(features))
    entries = table.select("docid", at.alias("at"), values.alias("values"))
    largest = F.array_max(F.transform("values", F.abs))
    bounds = table.select(F.unwrap_udt(features).alias("raw"), values.alias("values")).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.coalesce(F.col("raw.size"), F.size("raw.values"))).alias("width"),
        F.max(largest).alias("largest"),
    )
    found = bounds.first()
    if not found.n:
        raise ValueError("there are no rows to cluster")
    largest = found.largest or 1.0

    def bits(most: float) -> int:
        return 61 - math.ceil(math.log2(most))

    units = Units(bits(found.n * largest), bits(found.n * 4 * found.width * largest**2))
    packed = staged(pack(entries), "packed-rows")
    return Rows(entries, packed, found.n, found.width, units, packed.rdd.getNumPartitions())


def pack(entries: DataFrame) -> DataFrame:
    """``lengths, at, values`` of many rows as bytes, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, PACKED_BYTES):
            at, lengths = flat(batch.column(0))
            values, _ = flat(batch.column(1))
            parts = {"lengths": lengths, "at": at.astype(np.int32), "values": values.astype(np.float64)}
            yield pa.RecordBatch.from_pydict({name: [part.tobytes()] for name, part in parts.items()})

    return entries.select("at", "values").mapInArrow(run, "lengths binary, at binary, values binary")


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Lengths, positions and values of each packed row."""
    for batch in batches:
        lists = [column.cast(pa.binary()) for column in batch.columns]
        for row in zip(*lists):
            yield tuple(
                np.frombuffer(part.as_buffer(), kind) for part, kind in zip(row, (np.int64, np.int32, np.float64))
            )


def nearest(
    at: np.ndarray, values: np.ndarray, lengths: np.ndarray, centres: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, ties to the smaller number, and its squared distance."""
    near = (centres * centres).sum(axis=1) - 2 * sums_by_row(at, values, lengths, centres.T)
    labels = near.argmin(axis=1)
    squares = np.bincount(np.repeat(np.arange(len(lengths)), lengths), values * values, len(lengths))
    return labels, np.maximum(squares + near[np.arange(len(lengths)), labels], 0.0)


def _whole_sum(whole: np.ndarray) -> int:
    return int(whole.sum(dtype=np.int64))


def _totals(rows: Rows, centres: np.ndarray, with_sums: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Per centre the sums of its rows by position and their number, and the cost in units."""
    k, width, units = len(centres), rows.width, rows.units
    shared = rows.table.sparkSession.sparkContext.broadcast(centres)
    size = k * width if with_sums else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, cost = np.zeros(size + k, np.int64), 0
        for lengths, at, values in unpacked(batches):
            labels, far = nearest(at, values, lengths, shared.value)
            total[size:] += np.bincount(labels, minlength=k)
            cost += _whole_sum(units.of_distances(far))
            if with_sums:
                places = np.repeat(labels, lengths) * width + at
                np.add.at(total, places, units.of_values(values))
        yield pa.RecordBatch.from_pydict({"total": [total.tobytes()], "cost": [cost]})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, cost = np.zeros(size + k, np.int64), 0
        for batch in batches:
            for own, its_cost in zip(*(column.to_pylist() for column in batch.columns)):
                total, cost = total + np.frombuffer(own, np.int64), cost + its_cost
        yield pa.RecordBatch.from_pydict({"total": [total.tobytes()], "cost": [cost]})

    schema = "total binary, cost long"
    sums = rows.packed.select("lengths", "at", "values").mapInArrow(run, schema)
    if rows.parts > GROUPS:
        sums = sums.repartition(GROUPS).mapInArrow(added, schema)
    found = sums.collect()
    shared.unpersist()
    total = sum((np.frombuffer(row.total, np.int64) for row in found), np.zeros(size + k, np.int64))
    by_position = total[:size].reshape(k, width) if with_sums else np.zeros((k, 0), np.int64)
    return by_position, total[size:], sum(row.cost for row in found)


def _chance(docid: str, *names: int) -> F.Column:
    """A number from 0 to 1 that follows from the row's id."""
    mixed = F.xxhash64(*[F.lit(name) for name in names], F.col(docid))
    return F.shiftrightunsigned(mixed, 11) / F.lit(float(1 << 53))


def _dense(rows: list, width: int) -> np.ndarray:
    """Collected rows as a matrix, in the order of their ids."""
    out = np.zeros((len(rows), width))
    for i, row in enumerate(sorted(rows, key=lambda r: r.docid)):
        out[i, row["at"]] = row["values"]
    return out


def _candidates(rows: Rows, k: int, seed: int) -> np.ndarray:
    """Rows far from each other: one by its hash, then some by hash and distance in each round."""
    chance = _chance("docid", seed, 0).alias("chance")
    first = rows.table.select(F.min(F.struct(chance, "docid", "at", "values")).alias("row"))
    chosen = _dense([first.first().row], rows.width)
    for turn in range(1, ROUNDS + 1):
        _, _, cost = _totals(rows, chosen, with_sums=False)
        if not cost:
            break
        share = CANDIDATES * k / math.ldexp(cost, -rows.units.distance_bits)
        shared = rows.table.sparkSession.sparkContext.broadcast(chosen)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in in_pieces(batches):
                at, lengths = flat(batch.column(1))
                values, _ = flat(batch.column(2))
                _, far = nearest(at, values, lengths, shared.value)
                picked = batch.column(3).to_numpy() < share * far
                yield batch.filter(pa.array(picked)).select([0, 1, 2])

        asked = rows.table.select("docid", "at", "values", _chance("docid", seed, turn).alias("chance"))
        schema = asked.drop("chance").schema
        more = asked.mapInArrow(run, schema).collect()
        if more:
            chosen = np.concatenate([chosen, _dense(more, rows.width)])
        shared.unpersist()
    return np.unique(chosen, axis=0)


def _first_centres(candidates: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``k`` of the weighted candidates: each next one by chance and distance, then refined."""
    rng = np.random.default_rng(seed)

    def far(centres: np.ndarray) -> np.ndarray:
        return ((candidates[:, None, :] - centres[None]) ** 2).sum(axis=2)

    chosen = [int(rng.choice(len(candidates), p=weights / weights.sum()))]
    while len(chosen) < min(k, len(candidates)):
        odds = weights * far(candidates[chosen]).min(axis=1)
        if not odds.any():
            break
        chosen.append(int(rng.choice(len(candidates), p=odds / odds.sum())))
    centres = candidates[chosen].copy()
    labels = None
    for _ in range(LOCAL_ITERATIONS):
        found = far(centres).argmin(axis=1)
        if labels is not None and (found == labels).all():
            break
        labels = found
        for c in range(len(centres)):
            own = (labels == c) & (weights > 0)
            if own.any():
                centres[c] = np.average(candidates[own], axis=0, weights=weights[own])
    return centres


def fit(rows: Rows, k: int, max_iterations: int, seed: int) -> tuple[np.ndarray, float]:
    """Centres and their cost; fewer than ``k`` if there are fewer different rows."""
    candidates = _candidates(rows, k, seed)
    _, weights, _ = _totals(rows, candidates, with_sums=False)
    # Candidates that no row is nearest to are copies of others up to rounding.
    centres = _first_centres(candidates, weights.astype(float), k, seed)
    for _ in range(max_iterations):
        sums, counts, _ = _totals(rows, centres, with_sums=True)
        means = np.ldexp(sums.astype(float), -rows.units.value_bits)
        means = means / np.maximum(counts, 1)[:, None]
        moved = np.where(counts[:, None] > 0, means, centres)
        step = np.sqrt(((moved - centres) ** 2).sum(axis=1)).max()
        centres = moved
        if step <= TOLERANCE:
            break
    _, _, cost = _totals(rows, centres, with_sums=False)
    return centres, math.ldexp(cost, -rows.units.distance_bits)
