"""Exact deduplication by counting quotient filters.

1. Every text, with A-Z lower-cased, gets a 64-bit fingerprint. Each slice of
   the documents puts its fingerprints in a counting quotient filter, cut into
   segments by their highest bits: a segment holds a bit for each quotient
   that occurs, the remainders of a quotient as a run in ascending order, a
   bit where a run ends, and a count for each remainder.
2. The filters of all slices merge segment by segment. Runs are sorted by
   remainder, so merging keeps them sorted, equal remainders add their
   counts, and nothing is lost.
3. Fingerprints with a count above one are marked in a bitmap of quotients of
   ``2 ** mark_bits`` bits whatever the input (16 MiB by default), which is
   broadcast. Texts whose quotient is marked are compared byte by byte: they
   are grouped by the text itself, combined in their task first. When the
   bitmap fills up, more texts are compared; the result stays exact.
4. Documents find the class of their text by fingerprint and SHA-256. That one
   digest never stands for two texts is checked against the groups of step 3.

A class with very many copies is one row per slice wherever it is shuffled.

Defined results: a null text is empty. A null doc_id is smaller than any
other. Repeated rows are copies like any others: of rows that share the
largest doc_id one stays. An empty table gives an empty table; other columns
are not read.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.lookup import looked_up, sliced
from themeloom.llm.rows import map_batches, utf8
from themeloom.plans.staging import staged

FINGERPRINT_BITS = 64
MARK_BITS = 27

# Quotients of one segment, documents that a segment is made for, and bits of the bitmap sent at once.
QUOTIENT_BITS = 10
SEGMENT_ROWS = 200_000
BLOCK_BITS = 18


def normal_bytes(text: bytes | None) -> bytes:
    """UTF-8 with A-Z in lower case; other letters stay."""
    return (text or b"").lower()


def fingerprint(key: bytes, bits: int) -> int:
    return xxhash.xxh64_intdigest(key) >> (64 - bits) << (64 - bits)


def segment_bits_for(n_rows: int) -> int:
    """Bits that name a segment, so that one holds about SEGMENT_ROWS fingerprints."""
    return max(6, (n_rows // SEGMENT_ROWS).bit_length())


def filter_of(fingerprints: np.ndarray, counts: np.ndarray, segment_bits: int) -> dict[str, bytes]:
    """The filter of one segment, from its sorted, different fingerprints."""
    inside = fingerprints << np.uint64(segment_bits)
    quotients = (inside >> np.uint64(64 - QUOTIENT_BITS)).astype(np.int64)
    occupied = np.zeros(1 << QUOTIENT_BITS, bool)
    occupied[quotients] = True
    run_ends = np.append(quotients[1:] != quotients[:-1], True)
    remainders = inside << np.uint64(QUOTIENT_BITS)
    return {
        "occupied": np.packbits(occupied, bitorder="little").tobytes(),
        "run_ends": np.packbits(run_ends, bitorder="little").tobytes(),
        "remainders": remainders.astype("<u8").tobytes(),
        "counts": counts.astype("<i8").tobytes(),
    }


def fingerprints_of(own: dict[str, bytes], segment: int, segment_bits: int) -> np.ndarray:
    """The sorted fingerprints of a filter: quotients by their runs, and remainders."""
    remainders = np.frombuffer(own["remainders"], "<u8").astype(np.uint64)
    bits = np.frombuffer(own["occupied"], np.uint8)
    quotients = np.flatnonzero(np.unpackbits(bits, bitorder="little"))
    ends = np.unpackbits(np.frombuffer(own["run_ends"], np.uint8), bitorder="little")
    run_of = np.cumsum(np.append(0, ends[: len(remainders) - 1]))
    high = np.uint64(segment) << np.uint64(QUOTIENT_BITS) | quotients[run_of].astype(np.uint64)
    low_bits = segment_bits + QUOTIENT_BITS
    return high << np.uint64(64 - low_bits) | remainders >> np.uint64(low_bits)


def merged(filters: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted fingerprints of all filters, and the sums of their counts."""
    every = np.concatenate([own for own, _ in filters])
    counts = np.concatenate([n for _, n in filters])
    # A stable sort merges runs that are sorted already.
    order = np.argsort(every, kind="stable")
    every, counts = every[order], counts[order]
    first = np.append(True, every[1:] != every[:-1])
    return every[first], np.add.reduceat(counts, np.flatnonzero(first))


FILTER = "segment long, slice int, occupied binary, run_ends binary, remainders binary, counts binary"


def _filters(rows: DataFrame, segment_bits: int) -> DataFrame:
    """One row per slice and segment that has fingerprints of it."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            prints = batch.column(0).to_numpy().view(np.uint64)
            slices = batch.column(1).to_numpy()
            found = {name.split(" ")[0]: [] for name in FILTER.split(", ")}
            for own_slice in np.unique(slices).tolist():
                own, counts = np.unique(prints[slices == own_slice], return_counts=True)
                segments = (own >> np.uint64(64 - segment_bits)).astype(np.int64)
                starts = np.flatnonzero(np.append(True, segments[1:] != segments[:-1]))
                for a, b in zip(starts, np.append(starts[1:], len(own))):
                    found["segment"].append(int(segments[a]))
                    found["slice"].append(own_slice)
                    for name, value in filter_of(own[a:b], counts[a:b], segment_bits).items():
                        found[name].append(value)
            types = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
            return {name: pa.array(found[name], kind) for name, kind in zip(found, types)}

        return work

    return map_batches(rows.select("fp", "slice"), FILTER, make)


def _repeated(filters: DataFrame, segment_bits: int) -> DataFrame:
    """``fp, slice`` of the fingerprints that the merged filter counts more than once.

    Filters come sorted by segment, so a task merges one segment at a time.
    """

    def answer(segment: int, parts: list[dict]) -> pa.RecordBatch:
        own = [
            (fingerprints_of(p, segment, segment_bits), np.frombuffer(p["counts"], "<i8"))
            for p in parts
        ]
        every, counts = merged(own)
        again = every[counts > 1]
        prints, slices = [], []
        for part, (mine, _) in zip(parts, own):
            if len(again):
                at = np.minimum(np.searchsorted(again, mine), len(again) - 1)
                hit = mine[again[at] == mine]
                prints.append(hit)
                slices.append(np.full(len(hit), part["slice"], np.int32))
        fp = np.concatenate(prints).view(np.int64) if prints else np.empty(0, np.int64)
        of = np.concatenate(slices) if slices else np.empty(0, np.int32)
        return pa.RecordBatch.from_pydict({"fp": pa.array(fp), "slice": pa.array(of)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, []
        for batch in batches:
            for part in batch.to_pylist():
                if part["segment"] != current:
                    if parts:
                        yield answer(current, parts)
                    current, parts = part["segment"], []
                parts.append(part)
        if parts:
            yield answer(current, parts)

    dealt = filters.repartition("segment").sortWithinPartitions("segment")
    # A slice that was read by two tasks has two filters.
    return dealt.mapInArrow(run, "fp long, slice int").distinct()


def _marks(again: DataFrame, mark_bits: int) -> np.ndarray:
    """The bitmap of quotients of repeated fingerprints, ``2 ** mark_bits`` bits."""
    inside = min(BLOCK_BITS, mark_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, bits = None, np.zeros(1 << inside, bool)

        def packed() -> pa.RecordBatch:
            own = np.packbits(bits, bitorder="little").tobytes()
            return pa.RecordBatch.from_pydict({"block": [current], "bits": [own]})

        for batch in batches:
            blocks, marks = (column.to_numpy() for column in batch.columns)
            for block in np.unique(blocks).tolist():
                if block != current:
                    if current is not None:
                        yield packed()
                    current, bits = block, np.zeros(1 << inside, bool)
                bits[marks[blocks == block] & ((1 << inside) - 1)] = True
        if current is not None:
            yield packed()

    mark = F.shiftrightunsigned("fp", 64 - mark_bits).alias("mark")
    marks = again.select(mark).distinct()
    marks = marks.select(F.shiftright("mark", inside).alias("block"), "mark")
    dealt = marks.repartition("block").sortWithinPartitions("block")
    bitmap = np.zeros(max(1, (1 << mark_bits) // 8), np.uint8)
    size = max(1, (1 << inside) // 8)
    for row in dealt.mapInArrow(run, "block long, bits binary").collect():
        bitmap[row.block * size : (row.block + 1) * size] = np.frombuffer(row.bits, np.uint8)
    return bitmap


def _compared(docs: DataFrame, bitmap: np.ndarray, mark_bits: int, bits: int) -> DataFrame:
    """``fp, sha, n_same``: groups of equal texts among those whose quotient is marked."""
    marks = docs.sparkSession.sparkContext.broadcast(bitmap)

    def make():
        marked = marks.value

        def work(batch: pa.RecordBatch) -> dict:
            prints, texts = [], []
            for text in utf8(batch.column(0)):
                key = normal_bytes(text)
                fp = fingerprint(key, bits)
                mark = fp >> (64 - mark_bits)
                if marked[mark >> 3] >> (mark & 7) & 1:
                    prints.append(fp)
                    texts.append(key)
            return {
                "fp": pa.array(np.array(prints, np.uint64).view(np.int64)),
                "key": pa.array(texts, pa.binary()),
            }

        return work

    suspected = map_batches(docs.select("text"), "fp long, key binary", make)
    same = suspected.groupBy("fp", "key").agg(F.count(F.lit(1)).alias("n_same"))
    return same.select("fp", F.unhex(F.sha2("key", 256)).alias("sha"), "n_same")


def exact_groups(
    docs: DataFrame, mark_bits: int = MARK_BITS, fingerprint_bits: int = FINGERPRINT_BITS
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, sha`` of ``doc_id, text``, a row per document.

    Fewer ``fingerprint_bits`` make different texts share fingerprints; the
    comparison of bytes tells them apart.
    """

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            keys = [normal_bytes(text) for text in utf8(batch.column(1))]
            prints = [fingerprint(key, fingerprint_bits) for key in keys]
            return {
                "doc_id": batch.column(0),
                "fp": pa.array(np.array(prints, np.uint64).view(np.int64)),
                "sha": pa.array([hashlib.sha256(key).digest() for key in keys], pa.binary()),
            }

        return work

    texts = docs.select(F.col("doc_id").cast("long"), "text")
    rows = sliced(map_batches(texts, "doc_id long, fp long, sha binary", make), "fingerprints")
    segment_bits = segment_bits_for(rows.count())
    again = staged(_repeated(_filters(rows, segment_bits), segment_bits), "repeated-fingerprints")
    same = _compared(docs, _marks(again, mark_bits), mark_bits, fingerprint_bits)

    suspected = rows.join(again, ["fp", "slice"], "left_semi")
    top = F.max(F.struct("doc_id", "row")).alias("top")
    local = suspected.groupBy("fp", "sha", "slice").agg(top, F.count(F.lit(1)).alias("n"))
    local = staged(local, "classes-by-slice")
    classes = local.groupBy("fp", "sha").agg(F.max("top").alias("top"), F.sum("n").alias("n"))
    confirmed = F.when(F.col("n") == F.col("n_same"), F.col("n")).otherwise(
        F.raise_error(F.lit("documents changed between two passes, or a digest has two texts"))
    )
    checked = classes.join(same, ["fp", "sha"], "left").select(
        "fp", "sha", "top", confirmed.alias("group_size")
    )
    found = looked_up(rows, checked, ["fp", "sha"])
    alone = F.col("top").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("top.row") == F.col("row"))).alias("kept"),
        "sha",
    )


def op13_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_groups(docs).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")
    )


OP13_SQL = r"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY key ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(key) AS text_sha256
FROM (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                             'abcdefghijklmnopqrstuvwxyz') AS key
    FROM documents
)
WINDOW same AS (PARTITION BY key)
"""
