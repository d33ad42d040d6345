"""Best-fit packing of documents into sequences by bin completion.

Pieces have whole lengths of at most ``capacity`` tokens, so an input of any
size is described by one count per length. Only those counts (at most
``capacity`` numbers) go to the search, whose outcome is a list of fillings,
each used many times. Documents then find their places by their rank among
the pieces of the same length, in parallel.

The search (after Korf, 2002) takes the largest piece left and enumerates the
undominated fillings of the room beside it, fullest first. It prunes where
the waste so far, or the pieces left, cannot lead to fewer sequences than the
best packing known. Those incumbents come from best fit on what is left. A
filling is first used as often as the counts allow, so the depth follows from
the lengths and not from the number of documents, and then once. The search
ends when the bound is met or nothing is left to try, which proves the packing
optimal, or after ``most_steps`` fillings and parts of fillings. Only then may
it be beaten, by ``_bins(packing) - lower_bound(...)`` sequences at most; every
piece has its place either way.

Defined results: a null or empty text is one piece of one token; repeated
rows are packed each on their own; pieces with the same length are ranked by
doc_id (nulls first) and place; an empty table gives an empty table; other
columns are not read.
"""

import itertools
import math
import sys
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from themeloom.llm.bpe import encoder_of, read_vocabulary, vocabulary_path
from themeloom.llm.rows import map_batches
from themeloom.plans.staging import staged

CAPACITY = 2048
SEPARATOR = 0

# Steps of the search, and fillings that are put in order at a time.
MOST_STEPS = 400_000
SORTED = 16

# Steps for the fillings of one room in the first of two rounds.
PATIENCE = 100

# With so few different lengths left, states are bounded one by one and met only once.
FEW_LENGTHS = 64

# Pieces of one length are ranked in this many parts.
BUCKETS = 1024

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Filling:
    """Lengths in one sequence, longest first, and how many sequences are so."""

    lengths: tuple[int, ...]
    times: int


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences (bound L2 of Martello and Toth)."""
    lengths = np.array(sorted(counts), np.int64)
    numbers = np.array([counts[n] for n in lengths.tolist()], np.int64)
    if not len(lengths):
        return 0
    # Of all lengths below the place: how many pieces, and how many tokens.
    pieces_below = np.concatenate([[0], np.cumsum(numbers)])
    tokens_below = np.concatenate([[0], np.cumsum(numbers * lengths)])
    half = np.searchsorted(lengths, capacity // 2, side="right")
    limits = np.concatenate([[0], lengths[:half]])
    wide = np.searchsorted(lengths, capacity - limits, side="right")
    large = pieces_below[-1] - pieces_below[wide]
    n_middle = pieces_below[wide] - pieces_below[half]
    room = n_middle * capacity - (tokens_below[wide] - tokens_below[half])
    rest = tokens_below[half] - tokens_below[np.searchsorted(lengths, limits)]
    bounds = large + n_middle + np.maximum(0, -((room - rest) // capacity))
    return max(math.ceil(int(tokens_below[-1]) / capacity), int(bounds.max()))


def best_fit(counts: dict[int, int], capacity: int) -> list[Filling]:
    """Best fit decreasing, with equal sequences moved together."""
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    open_rooms = 0  # bit r is set if there is a sequence with room r

    def put(room: int, lengths: tuple[int, ...], times: int) -> None:
        nonlocal open_rooms
        rooms.setdefault(room, []).append((lengths, times))
        open_rooms |= 1 << room

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fitting = open_rooms >> length
            if not fitting:
                fits = capacity // length
                if left >= fits:
                    put(capacity - length * fits, (length,) * fits, left // fits)
                if left % fits:
                    put(capacity - length * (left % fits), (length,) * (left % fits), 1)
                break
            room = length + (fitting & -fitting).bit_length() - 1
            lengths, times = rooms[room].pop()
            if not rooms[room]:
                open_rooms ^= 1 << room
            fits = min(room // length, max(1, left // times))
            moved = min(times, left // fits)
            if moved < times:
                put(room, lengths, times - moved)
            put(room - fits * length, lengths + (length,) * fits, moved)
            left -= fits * moved
    return [Filling(lengths, times) for groups in rooms.values() for lengths, times in groups]


class Steps:
    """How many fillings and parts of fillings the search may still look at."""

    def __init__(self, most: int, whole: "Steps | None" = None) -> None:
        self.left = most
        self.whole = whole

    def take(self) -> bool:
        self.left -= 1
        return self.left >= 0 and (self.whole is None or self.whole.take())


def _is_dominated(way: tuple[int, ...], waste: int, ascending: list[int], free: Counter) -> bool:
    """Whether one free length could take the place of none, one or two of the way.

    The pieces it replaces fit where it was, so the way with it is no worse.
    """
    parts = {0} | set(way) | {a + b for a, b in itertools.combinations(way, 2)}
    for replaced in parts:
        # One piece is only replaced by a longer one.
        least = replaced + 1 if replaced == 0 or replaced in way else replaced
        for i in range(bisect_left(ascending, least), len(ascending)):
            if ascending[i] > replaced + waste:
                break
            if free[ascending[i]] > 0:
                return True
    return False


def _in_order(
    room: int, counts: dict[int, int], at_least: int, steps: Steps
) -> Iterator[tuple[int, ...]]:
    ascending = sorted(n for n, c in counts.items() if c > 0 and n <= room)
    if not ascending:
        if at_least <= 0:
            yield ()
        return
    if ascending[-1] == room:
        # All that fits in the room would fit in the place of this one piece.
        yield (room,)
        return
    lengths = np.array(ascending, np.int64)
    # Two pieces that fill the room exactly come first.
    pairs = set()
    for n in lengths[np.isin(room - lengths, lengths)][::-1].tolist():
        m = room - n
        if (n > m or (n == m and counts[n] > 1)) and steps.take():
            pairs.add((n, m))
            yield (n, m)
    descending = ascending[::-1]
    free = Counter({n: counts[n] for n in ascending})
    # What all lengths from a place on add up to.
    rest = list(itertools.accumulate((n * counts[n] for n in ascending)))[::-1]
    chosen: list[int] = []
    # Places in ``descending`` that are still to be tried, for each piece chosen.
    places = [0]
    space = room
    extended = [False]
    while places and steps.take():
        at = max(places[-1], bisect_left(descending, -space, key=lambda n: -n))
        while at < len(descending) and not free[descending[at]]:
            at += 1
        if at < len(descending) and room - space + min(space, rest[at]) >= at_least:
            n = descending[at]
            places[-1], extended[-1] = at + 1, True
            chosen.append(n)
            free[n] -= 1
            space -= n
            places.append(at)
            extended.append(False)
            continue
        if not extended[-1] and room - space >= at_least:
            way = tuple(chosen)
            if way not in pairs and not _is_dominated(way, space, ascending, free):
                yield way
        places.pop()
        extended.pop()
        if chosen:
            n = chosen.pop()
            free[n] += 1
            space += n


def fillings(
    room: int, counts: dict[int, int], at_least: int = 0, steps: Steps | None = None
) -> Iterator[tuple[int, ...]]:
    """Undominated ways to fill the room with a total of ``at_least``.

    All of them, unless ``steps`` come to an end: the longest pieces first, and
    the fullest first among every SORTED of them.
    """
    ways = _in_order(room, counts, at_least, steps or Steps(sys.maxsize))
    while some := list(itertools.islice(ways, SORTED)):
        yield from sorted(some, key=lambda way: (-sum(way), len(way), [-n for n in way]))


def _bins(packing: list[Filling]) -> int:
    return sum(f.times for f in packing)


def complete(counts: dict[int, int], capacity: int, most_steps: int = MOST_STEPS) -> list[Filling]:
    """The best packing found; see the module's text.

    A first round soon gives up on a room, which finds good packings of many
    lengths; the second tries every filling, so that its end proves the best.
    """
    counts = {n: c for n, c in counts.items() if c > 0}
    best = best_fit(counts, capacity)
    for steps, patience in ((most_steps // 2, PATIENCE), (most_steps - most_steps // 2, None)):
        if _bins(best) > lower_bound(counts, capacity):
            best = search(counts, capacity, best, Steps(steps), patience)
    return best


def search(
    counts: dict[int, int],
    capacity: int,
    best: list[Filling],
    steps: Steps,
    patience: int | None = None,
) -> list[Filling]:
    """A packing better than ``best`` if one is found; ``patience`` limits each room's fillings."""
    bound, n_best = lower_bound(counts, capacity), _bins(best)
    seen: set[tuple] = set()
    tried = 0

    def children(left: dict[int, int], tokens: int, used: int) -> Iterator[tuple]:
        """Counts and tokens left after each filling around the largest piece."""
        top = max(left)
        # Room that may be wasted in all if the best is to be improved on.
        spare = (n_best - 1 - used) * capacity - tokens
        beside = dict(left)
        beside[top] -= 1
        own_steps = steps if patience is None else Steps(patience, steps)
        for way in fillings(capacity - top, beside, capacity - top - spare, own_steps):
            lengths = (top, *way)
            need = Counter(lengths)
            waste = capacity - sum(lengths)
            most = min(left[n] // k for n, k in need.items())
            if waste:
                most = min(most, spare // waste)
            # As often as it can be, then once, after which it may come again.
            for times in sorted({most, min(most, 1)}, reverse=True):
                if times < 1:
                    continue
                after = dict(left)
                for n, k in need.items():
                    after[n] -= k * times
                    if not after[n]:
                        del after[n]
                yield after, tokens - sum(lengths) * times, Filling(lengths, times)

    # Each entry: its children, its fillings as a linked list, its sequences.
    total = sum(n * c for n, c in counts.items())
    stack = [(children(counts, total, 0), None, 0)] if counts else []
    while stack and n_best > bound and steps.left > 0:
        ways, chain, used = stack[-1]
        found = next(ways, None)
        if found is None:
            stack.pop()
            continue
        left, tokens, filling = found
        own, used = (filling, chain), used + filling.times
        if used + math.ceil(tokens / capacity) >= n_best:
            continue
        if not left:
            best, n_best = _unchained(own), used
            continue
        if len(left) <= FEW_LENGTHS:
            state = (used, *sorted(left.items()))
            if state in seen or used + lower_bound(left, capacity) >= n_best:
                continue
            seen.add(state)
        tried += 1
        if tried % 64 == 0 or len(left) <= FEW_LENGTHS:
            rest = best_fit(left, capacity)
            if used + _bins(rest) < n_best:
                best, n_best = _unchained(own) + rest, used + _bins(rest)
        stack.append((children(left, tokens, used), own, used))
    return best


def _unchained(chain: tuple | None) -> list[Filling]:
    found = []
    while chain:
        found.append(chain[0])
        chain = chain[1]
    return found


class Places:
    """Sequence and offset of the piece of a given length and rank."""

    def __init__(self, packing: list[Filling]) -> None:
        rows = []
        taken: dict[int, int] = {}
        first = 0
        for filling in packing:
            offsets: dict[int, list[int]] = {}
            at = 0
            for n in filling.lengths:
                offsets.setdefault(n, []).append(at)
                at += n
            for n, places in offsets.items():
                begin = taken.get(n, 0)
                rows.append((n, begin, first, places))
                taken[n] = begin + len(places) * filling.times
            first += filling.times
        rows.sort(key=lambda r: (r[0], r[1]))
        self.keys = np.array([(n << 44) + begin for n, begin, _, _ in rows], np.int64)
        self.begins = np.array([r[1] for r in rows], np.int64)
        self.firsts = np.array([r[2] for r in rows], np.int64)
        self.each = np.array([len(r[3]) for r in rows], np.int64)
        self.where = np.cumsum([0, *[len(r[3]) for r in rows]])[:-1].astype(np.int64)
        self.offsets = np.array([at for r in rows for at in r[3]], np.int64)

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.searchsorted(self.keys, (lengths << 44) + ranks, side="right") - 1
        within = ranks - self.begins[row]
        each = self.each[row]
        return self.firsts[row] + within // each, self.offsets[self.where[row] + within % each]


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, bytes]]:
    """Number, start and ids of each piece."""
    step = 4 * capacity
    for number, begin in enumerate(range(0, len(ids), step)):
        yield number, begin // 4, ids[begin : begin + step]


def pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """Pieces of the tokens of ``doc_id, text``, each document ended by the separator."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    end = np.uint32(SEPARATOR).tobytes()

    def make():
        encoder = encoder_of(shared.value)

        def work(batch: pa.RecordBatch) -> dict:
            encoded = encoder.encode_many(batch.column(1).to_pylist())
            rows = [
                (doc_id, number, start, len(ids) // 4, zlib.crc32(ids), ids if with_ids else None)
                for doc_id, whole in zip(batch.column(0).to_pylist(), encoded)
                for number, start, ids in cut(whole + end, capacity)
            ]
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            made = dict(zip(names, (pa.array(c, k) for c, k in zip(columns, kinds))))
            if not with_ids:
                del made["ids"]
            return made

        return work

    return map_batches(
        docs.select("doc_id", "text"), PIECES + (", ids binary" if with_ids else ""), make
    )


def pack(
    cut_pieces: DataFrame, capacity: int = CAPACITY, most_steps: int = MOST_STEPS
) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``.

    ``cut_pieces`` must give the same rows each time it is read; stage it.
    """
    spark = cut_pieces.sparkSession
    by_length = cut_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    packing = complete({row.length: row.n for row in by_length}, capacity, most_steps)
    places = spark.sparkContext.broadcast(Places(packing))

    order = ["doc_id", "piece", "start", "ids_crc32"]
    bucket = F.pmod(F.xxhash64(*order), F.lit(BUCKETS)).cast("int")
    dealt = cut_pieces.withColumn("_bucket", bucket)
    # At most capacity x BUCKETS counts, whatever the number of pieces.
    sizes = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(
        W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    )
    begins = sizes.select("length", "_bucket", F.coalesce(before, F.lit(0)).alias("_begin"))
    own = F.row_number().over(W.partitionBy("length", "_bucket").orderBy(*order))
    ranked = dealt.withColumn("_own", own).join(begins, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_begin") + F.col("_own") - 1)
    names = cut_pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_pieces.schema.fields)

    def make():
        plan = places.value

        def work(batch: pa.RecordBatch) -> dict:
            columns = {name: batch.column(i) for i, name in enumerate(names)}
            lengths = columns["length"].to_numpy().astype(np.int64)
            ranks = batch.column(len(names)).to_numpy().astype(np.int64)
            sequences, offsets = plan.find(lengths, ranks)
            columns["sequence_id"] = pa.array(sequences, pa.int64())
            columns["offset"] = pa.array(offsets, pa.int64())
            return columns

        return work

    return map_batches(
        ranked.select(*names, "_rank"), f"{schema}, sequence_id long, offset long", make
    )


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids array<int>``: whole sequences of pieces with ``ids``.

    A group holds at most ``capacity`` tokens.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = packed.groupBy("sequence_id").agg(parts.alias("parts"))

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            rows = [
                np.frombuffer(b"".join(part["ids"] for part in parts), "<u4").astype(np.int32)
                for parts in batch.column(1).to_pylist()
            ]
            return {
                "sequence_id": batch.column(0),
                "ids": pa.array(rows, pa.list_(pa.int32())),
            }

        return work

    return map_batches(joined, "sequence_id long, ids array<int>", make)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    return pack(staged(pieces(docs, path, capacity), "pieces"), capacity)


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, vocabulary_path("word_bpe_49k.json"))
