"""Importance resampling towards a target distribution.

1. Words are runs of digits, lower-case letters and characters beyond ASCII; a
   feature is a run of one to three words, hashed by the CRC-32 of its bytes
   into buckets. Tasks count buckets in arrays, which are added up. A bucket's
   gain is the scaled logarithm of its share in the target texts against that
   in the documents.
2. A document's weight is the sum of an array of gains over its features; the
   score adds Gumbel noise from a hash of its doc_id.
3. Of the documents with enough words the highest scores are drawn. A quantile
   sketch of the scores gives a bracket around the cutoff. Exact counts of the
   scores above and inside validate the bracket or widen it. Only the bracket
   is sorted to find the row at the cutoff; the drawn rows are then ranked.

CRC-32 is linear, so that of joined words follows from the words' own: the
first is shifted by the length of the second by table, for whole arrays.

Defined results: a null or empty text has no features, weight 0, and is never
drawn. A null doc_id hashes as no digits and is smaller than any other; rows
that share score and doc_id are told apart by their place, so that exactly
the asked number is drawn. Without target texts every bucket's target count is
zero. An empty table gives an empty table; other columns are not read.
"""

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.llm.rows import map_batches, utf8
from themeloom.plans.staging import staged

BUCKETS = 10_000
LONGEST_RUN = 3
SEED = 42
LEAST_WORDS = 20
PERCENT = 5

# Size of the quantile sketch, and half of the bracket's first width as a share of all rows.
SKETCH_K = 4096
MARGIN = 0.005

# Bytes worked on at once, and arrays of counts that reach the driver.
AT_ONCE = 1 << 20
COUNT_GROUPS = 32

# Bytes that words are made of, with A-Z lower-cased; all others part them.
_PARTED = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_MAP = bytes(0x20 if b in _PARTED else b for b in range(256)).lower()

# CRC-32 of one byte, and shifts of a CRC by up to 63 zero bytes, by the CRC's four bytes.
_SHORT = 64
_STEP = np.array([crc32(bytes([b ^ 0xFF])) for b in range(256)], np.uint32) ^ np.uint32(0xFF000000)
_SPACE = np.uint32(crc32(b" "))


def _next(crcs: np.ndarray) -> np.ndarray:
    """The CRCs shifted by one zero byte."""
    return (crcs >> np.uint32(8)) ^ _STEP[crcs & np.uint32(0xFF)]


def _shift_tables() -> np.ndarray:
    """A table for each number of zero bytes: for each byte of a CRC, its 256 images."""
    table = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    found = [table]
    for _ in range(_SHORT):
        found.append(_next(found[-1]))
    return np.stack(found)


_TABLES = _shift_tables()
_FLAT = _TABLES.ravel()


def _by_table(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    base = lengths.astype(np.int64) << 10
    out = _FLAT[base + (crcs & np.uint32(0xFF))]
    for byte in (1, 2, 3):
        part = (crcs >> np.uint32(8 * byte)) & np.uint32(0xFF)
        out = out ^ _FLAT[base + (byte << 8) + part]
    return out


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs of the same bytes with ``lengths`` zero bytes behind them, without the final turn."""
    out = _by_table(crcs, lengths & (_SHORT - 1))
    long = np.flatnonzero(lengths >= _SHORT)
    if len(long):
        # A table of _SHORT bytes, doubled for each higher bit of the length.
        table, times = _TABLES[_SHORT], lengths[long] // _SHORT
        while times.any():
            odd = long[times & 1 == 1]
            out[odd] = _images(table, out[odd])
            table, times = _images(table, table), times >> 1
    return out


def _images(table: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    out = np.zeros_like(crcs)
    for byte in range(4):
        out ^= table[byte][(crcs >> np.uint32(8 * byte)) & np.uint32(0xFF)]
    return out


def features(words: list[bytes], of: np.ndarray, led: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """CRC and text of all features that end behind the first ``led`` words.

    ``of`` is the number of each word's text; no feature spans two texts.
    """
    ends = np.fromiter(map(crc32, words), np.uint32, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    run, first = ends, of
    for n in range(LONGEST_RUN):
        if n:
            # The run that ended a word earlier, a space, and the word.
            run = shifted(_next(run[:-1]) ^ _SPACE, lengths[n:]) ^ ends[n:]
            first = first[:-1]
        whole = first == of[n:]
        whole[: max(led - n, 0)] = False
        yield run[whole], first[whole]


def _blocks(texts: list[bytes | None]) -> Iterator[tuple[list[bytes], np.ndarray, int]]:
    """Words, the numbers of their texts, and how many of them were there before.

    A long text comes in blocks, each led by the last words of the one before.
    """
    words, numbers, counts, size = [], [], [], 0

    def block():
        return words, np.repeat(np.array(numbers, np.int64), counts), 0

    for i, text in enumerate(texts):
        if not text:
            continue
        plain = text.translate(_MAP)
        if len(plain) <= AT_ONCE:
            own = plain.split()
            words += own
            numbers.append(i)
            counts.append(len(own))
            size += len(plain)
            if size >= AT_ONCE:
                yield block()
                words, numbers, counts, size = [], [], [], 0
            continue
        lead, begin = [], 0
        while begin < len(plain):
            space = plain.find(b" ", begin + AT_ONCE)
            end = len(plain) if space < 0 else space
            own = lead + plain[begin:end].split()
            yield own, np.full(len(own), i, np.int64), len(lead)
            lead, begin = own[-(LONGEST_RUN - 1) :], end
    if words:
        yield block()


def _bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in a column ``text``.

    Tasks send one array each; those are added in groups, and the driver gets
    ``COUNT_GROUPS`` arrays.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in _blocks(utf8(batch.column(0))):
                for crcs, _ in features(*block):
                    total += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        yield pa.RecordBatch.from_pydict({"counts": [total.tobytes()]})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for own in batch.column(0).to_pylist():
                total += np.frombuffer(own, np.int64)
        yield pa.RecordBatch.from_pydict({"counts": [total.tobytes()]})

    by_task = texts.select("text").mapInArrow(counted, "counts binary")
    grouped = by_task.repartition(COUNT_GROUPS).mapInArrow(added, "counts binary")
    arrays = [np.frombuffer(row.counts, np.int64) for row in grouped.collect()]
    return sum(arrays, np.zeros(buckets, np.int64))


def gains(target: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The gain of each bucket, from its counts in the target and in the documents."""
    all_target, all_own, n = float(target.sum()), float(own.sum()), float(len(own))
    pairs = zip(target.tolist(), own.tolist())
    return np.array(
        [
            math.floor(1000 * math.log((t + 1) * (all_own + n) / ((s + 1) * (all_target + n))))
            for t, s in pairs
        ],
        np.int64,
    )


def noise(doc_id: int | None, seed: int) -> int:
    """Scaled Gumbel noise from a hash of the doc_id."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score_documents(
    docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, seed: int = SEED
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of ``doc_id, text``.

    ``target`` has a column ``text``.
    """
    of_bucket = gains(_bucket_counts(target, buckets), _bucket_counts(docs, buckets))
    shared = docs.sparkSession.sparkContext.broadcast(of_bucket)

    def make():
        gain = shared.value

        def work(batch: pa.RecordBatch) -> dict:
            n = batch.num_rows
            n_words, n_features, weight = (np.zeros(n, np.int64) for _ in range(3))
            for words, of, led in _blocks(utf8(batch.column(1))):
                n_words += np.bincount(of[led:], minlength=n)
                for crcs, owner in features(words, of, led):
                    n_features += np.bincount(owner, minlength=n)
                    own = gain[crcs % np.uint32(buckets)]
                    # Sums of whole numbers far below 2 ** 53 are exact in doubles.
                    weight += np.bincount(owner, own, minlength=n).astype(np.int64)
            by_chance = [noise(doc_id, seed) for doc_id in batch.column(0).to_pylist()]
            return {
                "doc_id": batch.column(0),
                "n_words": pa.array(n_words),
                "n_features": pa.array(n_features),
                "weight": pa.array(weight),
                "score": pa.array(weight + np.array(by_chance, np.int64)),
            }

        return work

    schema = "doc_id long, n_words long, n_features long, weight long, score long"
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    return map_batches(texts, schema, make)


# Rows in the order in which they are drawn: score from the top, then doc_id, then place.
ORDER = ("falling", "doc_id", "row")

# Rows that one partition can hold, by the numbers Spark gives them.
_PLACES = 33


@dataclass(frozen=True)
class Sorted:
    """A table sorted by ORDER, with ``bin, place``, and where each bin begins."""

    table: DataFrame
    starts: dict[int, int]

    def ranked(self) -> DataFrame:
        """The table with ``rank`` from 1; there are as many bins as shuffle partitions."""
        spark = self.table.sparkSession
        starts = spark.createDataFrame(list(self.starts.items()), "bin int, start long")
        joined = self.table.join(F.broadcast(starts), "bin")
        return joined.withColumn("rank", F.col("start") + F.col("place") + 1).drop(
            "bin", "start", "place"
        )

    def at(self, rank: int):
        """The row of a rank."""
        own = max((b for b, s in self.starts.items() if s < rank), key=self.starts.get)
        place = rank - 1 - self.starts[own]
        return self.table.where((F.col("bin") == own) & (F.col("place") == place)).first()


def _sorted(rows: DataFrame, name: str) -> Sorted:
    """Sort by ranges; the ranges split rows that tie in all but their place."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.repartitionByRange(n, *ORDER).sortWithinPartitions(*ORDER)
    numbered = ranges.withColumn("_at", F.monotonically_increasing_id())
    table = staged(
        numbered.select(
            *rows.columns,
            F.shiftright("_at", _PLACES).cast("int").alias("bin"),
            F.col("_at").bitwiseAND(F.lit((1 << _PLACES) - 1)).alias("place"),
        ),
        name,
    )
    sizes = {row.bin: row.n for row in table.groupBy("bin").agg(F.count("*").alias("n")).collect()}
    starts, before = {}, 0
    for own in sorted(sizes):
        starts[own], before = before, before + sizes[own]
    return Sorted(table, starts)


def bracket(rows: DataFrame, wanted: int, n: int, margin: float = MARGIN) -> tuple[int, int, int]:
    """Scores between which the cutoff lies, and the exact count of rows above.

    ``wanted`` of ``n`` rows are to be drawn. The sketch proposes the bracket
    and the counts decide: it is widened until the cutoff is inside.
    """
    sketch = rows.agg(F.kll_sketch_agg_bigint("score", F.lit(SKETCH_K)).alias("s")).first().s
    one = rows.sparkSession.range(1)
    while True:
        at = 1 - wanted / n
        ranks = [min(max(at + side * margin, 0.0), 1.0) for side in (-1, 1)]
        quantile = [F.kll_sketch_get_quantile_bigint(F.lit(sketch), F.lit(r)) for r in ranks]
        low, high = one.select(*quantile).first()
        score = F.col("score")
        above, inside = rows.agg(
            F.count(F.when(score > high, 1)), F.count(F.when(score.between(low, high), 1))
        ).first()
        if above < wanted <= above + inside:
            return low, high, above
        if ranks == [0.0, 1.0]:
            raise ValueError("the counts and the sketch are not of the same rows")
        margin *= 4


def _not_behind(cutoff) -> Column:
    """Whether a row comes no later than the row at the cutoff."""
    last = [F.lit(cutoff[name]).cast("long").alias(name) for name in ORDER]
    return F.struct(*ORDER) <= F.struct(*last)


def draw(
    scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, margin: float = MARGIN
) -> DataFrame:
    """The scored documents with ``rank``, null where a document is not drawn."""
    numbered = scored.withColumns({"row": F.monotonically_increasing_id(), "falling": -F.col("score")})
    rows = staged(numbered, "scored")
    longs = rows.where(F.col("n_words") >= least_words)
    n = longs.count()
    wanted = percent * n // 100
    none = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return rows.select(*scored.columns, none)
    low, high, above = bracket(longs, wanted, n, margin)
    inside = longs.where(F.col("score").between(low, high)).select(*ORDER)
    cutoff = _sorted(inside, "bracket").at(wanted - above)
    is_drawn = (F.col("n_words") >= least_words) & _not_behind(cutoff)
    ranked = _sorted(rows.where(is_drawn), "drawn").ranked()
    return rows.where(~is_drawn).select(*scored.columns, none).unionByName(
        ranked.select(*scored.columns, "rank")
    )


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    drawn = draw(score_documents(docs, target))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
