"""Interaction of filters by wide packed counters.

The filters that a document fails are a mask of five bits. Whatever the
order, the mask alone settles at which step a document is removed, so each of
the 32 masks has one big integer: a field for the document itself, and one for
each of the 120 x 5 steps, 1 where the step removes it. The integers of a
part's documents are added up; there is one sum for all of them, one for those
of good quality and one for toxic ones. A field has 64 bits and a sum at most
one per row in each, so no field runs over into the next. The other figures of
a step follow from the removals.

Tasks add up what they read, then groups of tasks, then a part's groups. A task
that meets very many parts sends its sums on and starts anew, so its memory is
bounded.

Defined results: a null text is empty, a null source counts as the empty
string, and a row is a document. A null doc_id is neither smaller nor larger
than any other, and has no label. A label that is repeated counts if one of
its rows does. An empty table has no parts and gives no rows.
"""

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.lookup import looked_up, sliced
from themeloom.llm.rows import WHITE, map_batches, utf8

FILTERS = "ABCDE"
ORDERS = ["".join(order) for order in permutations(FILTERS)]
STEPS = len(FILTERS)

# Bits of a field, fields of an integer, and groups of tasks whose sums are added first.
FIELD_BITS = 64
FIELDS = 1 + len(ORDERS) * STEPS
GROUPS = 64
MOST_PARTS = 1000

# Fixed values of the filters.
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITALS_PERCENT = 2
MARKS = b"#$%&*|"
CAPITALS = bytes(range(65, 91))
CONTINUED = bytes(range(0x80, 0xC0))

# Bytes of a very long text that are cut into words at once.
AT_ONCE = 1 << 20
_SPACE = re.compile(b"[" + WHITE + b"]")


def word_counts(text: bytes) -> tuple[int, int]:
    """Words and different words."""
    if len(text) <= AT_ONCE:
        words = text.split()
        return len(words), len(set(words))
    n, known, begin = 0, set(), 0
    while begin < len(text):
        space = _SPACE.search(text, begin + AT_ONCE)
        end = space.end() if space else len(text)
        words = text[begin:end].split()
        n += len(words)
        known.update(words)
        begin = end
    return n, len(known)


def failures(text: bytes) -> int:
    """Mask of the filters A to D that a text fails."""
    n, distinct = word_counts(text)
    points = len(text.translate(None, CONTINUED))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    return (
        (n < LEAST_WORDS)
        | (100 * distinct < LEAST_DISTINCT_PERCENT * n) << 1
        | (100 * capitals > MOST_CAPITALS_PERCENT * points) << 2
        | (len(text.translate(None, MARKS)) < len(text)) << 3
    )


def packed_outcomes() -> list[int]:
    """The big integer of each mask."""
    found = []
    for mask in range(1 << STEPS):
        fails = {name for i, name in enumerate(FILTERS) if mask >> i & 1}
        total = 1
        for nth, order in enumerate(ORDERS):
            step = next((i for i, name in enumerate(order) if name in fails), None)
            if step is not None:
                total |= 1 << FIELD_BITS * (1 + nth * STEPS + step)
        found.append(total)
    return found


def _to_bytes(sums: list[int]) -> bytes:
    return b"".join(x.to_bytes(FIELDS * FIELD_BITS // 8, "little") for x in sums)


def _from_bytes(packed: bytes) -> list[int]:
    size = FIELDS * FIELD_BITS // 8
    return [int.from_bytes(packed[i : i + size], "little") for i in range(0, len(packed), size)]


def step_rows(sums: list[int]) -> dict[str, np.ndarray]:
    """The figures of all steps of all orders, from a part's three sums."""
    everyone, good, toxic = (np.frombuffer(_to_bytes([x]), "<i8") for x in sums)
    n, removed = int(everyone[0]), everyone[1:].reshape(len(ORDERS), STEPS)
    filter_at = np.array([[FILTERS.index(name) for name in order] for order in ORDERS])
    fails, alone, shapley = (np.zeros(STEPS, np.int64) for _ in range(3))
    # The first filter removes all that fail it, the last one those that fail nothing else.
    fails[filter_at[:, 0]] = removed[:, 0]
    alone[filter_at[:, -1]] = removed[:, -1]
    np.add.at(shapley, filter_at, removed)
    return {
        "kept": n - removed.cumsum(axis=1),
        "removed": removed,
        "redundant": fails[filter_at] - removed,
        "unique_fails": alone[filter_at],
        "good_lost": good[1:].reshape(removed.shape),
        "toxic_lost": toxic[1:].reshape(removed.shape),
        "shapley": shapley[filter_at],
    }


SUMS = "part string, task_group int, sums binary"


def _sums(masks: DataFrame) -> DataFrame:
    """Packed sums of ``part, mask, good, toxic, task_group`` by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outcomes = packed_outcomes()
        parts: dict[tuple[str, int], list[int]] = {}

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part for part, _ in parts], pa.string()),
                    "task_group": pa.array([group for _, group in parts], pa.int32()),
                    "sums": pa.array(list(map(_to_bytes, parts.values())), pa.binary()),
                }
            )

        for batch in batches:
            rows = zip(*(column.to_pylist() for column in batch.columns))
            for (part, mask, good, toxic, group), times in Counter(rows).items():
                sums = parts.setdefault((part, group), [0, 0, 0])
                outcome = times * outcomes[mask]
                sums[0] += outcome
                sums[1] += outcome if good else 0
                sums[2] += outcome if toxic else 0
                if len(parts) >= MOST_PARTS:
                    yield sent()
                    parts.clear()
        if parts:
            yield sent()

    return masks.mapInArrow(run, SUMS)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[int]]]:
    """Sums of rows in a row that share all but the last column."""
    current, sums = None, []
    for batch in batches:
        for *key, packed in zip(*(column.to_pylist() for column in batch.columns)):
            own = _from_bytes(packed)
            if key == current:
                sums = [a + b for a, b in zip(sums, own)]
            else:
                if current is not None:
                    yield tuple(current), sums
                current, sums = key, own
    if current is not None:
        yield tuple(current), sums


def _in_groups(sums: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part, _), own in _added(batches):
            yield pa.RecordBatch.from_pydict({"part": [part], "sums": [_to_bytes(own)]})

    dealt = sums.repartition("part", "task_group").sortWithinPartitions("part", "task_group")
    return dealt.mapInArrow(run, "part string, sums binary")


REPORT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def _unpacked(sums: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(ORDERS) * STEPS
        for (part,), own in _added(batches):
            columns = {
                "part": pa.array([part] * n, pa.string()),
                "filter_order": pa.array([order for order in ORDERS for _ in order]),
                "step": pa.array(list(range(1, STEPS + 1)) * len(ORDERS), pa.int32()),
            }
            figures = {name: pa.array(x.ravel()) for name, x in step_rows(own).items()}
            yield pa.RecordBatch.from_pydict(columns | figures)

    return sums.repartition("part").sortWithinPartitions("part").mapInArrow(run, REPORT)


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, good, toxic, slice`` of every document; bit 4 of the mask is E."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            texts = [text or b"" for text in utf8(batch.column(1))]
            return {
                "doc_id": batch.column(0),
                "part": batch.column(2),
                "mask": pa.array(list(map(failures, texts)), pa.int32()),
                "digest": pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
            }

        return work

    part = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part")
    texts = docs.select(F.col("doc_id").cast("long"), "text", part)
    schema = "doc_id long, part string, mask int, digest binary"
    rows = sliced(map_batches(texts, schema, make), "failures")
    lowest = rows.groupBy("digest").agg(
        F.min("doc_id").alias("lowest"), F.count(F.lit(1)).alias("n")
    )
    lowest = lowest.where("n > 1").select("digest", "lowest")
    again = F.coalesce(F.col("doc_id") > F.col("lowest"), F.lit(False))
    marked = looked_up(rows, lowest, ["digest"]).select(
        "doc_id", "part", "slice", (F.col("mask") + F.when(again, 16).otherwise(0)).alias("mask")
    )
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")
    )
    known = known.agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    return looked_up(marked, known, ["doc_id"]).select(
        "part",
        "mask",
        F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"),
        "slice",
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The report of every part: ``doc_id, text, source`` and ``doc_id, quality, toxic``."""
    group = F.pmod(F.spark_partition_id(), F.lit(GROUPS)).alias("task_group")
    masks = failure_masks(docs, labels).select("part", "mask", "good", "toxic", group)
    return _unpacked(_in_groups(_sums(masks)))


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return audit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP12_SQL = r"""
WITH cut AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), known AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic
    FROM labels GROUP BY doc_id
), failed AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
           CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
           || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
           || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))
                        > 2 * length(text) THEN 'C' ELSE '' END
           || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
           || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
    FROM cut LEFT JOIN known USING (doc_id)
), counted AS (
    SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS n_good,
           count(*) FILTER (WHERE toxic) AS n_toxic
    FROM failed GROUP BY part, fails
), letters(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
    SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (
    SELECT filter_order, CAST(s AS INTEGER) AS step, substr(filter_order, CAST(s AS INTEGER), 1) AS f,
           substr(filter_order, 1, CAST(s AS INTEGER) - 1) AS earlier
    FROM orders, range(1, 6) AS r(s)
), met AS (
    SELECT part, filter_order, step, f, n, n_good, n_toxic, fails = f AS only_f,
           contains(fails, f) AS hit,
           length(translate(fails, earlier, '')) < length(fails) AS gone
    FROM counted, steps
), summed AS (
    SELECT part, filter_order, step, f,
           CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND NOT hit), 0) AS BIGINT) AS kept,
           CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND hit), 0) AS BIGINT) AS removed,
           CAST(coalesce(sum(n) FILTER (WHERE gone AND hit), 0) AS BIGINT) AS redundant,
           CAST(coalesce(sum(n) FILTER (WHERE only_f), 0) AS BIGINT) AS unique_fails,
           CAST(coalesce(sum(n_good) FILTER (WHERE NOT gone AND hit), 0) AS BIGINT) AS good_lost,
           CAST(coalesce(sum(n_toxic) FILTER (WHERE NOT gone AND hit), 0) AS BIGINT) AS toxic_lost
    FROM met GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM summed
"""
