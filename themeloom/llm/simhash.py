"""Near-duplicates by SimHash and covering locality-sensitive hashing.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's word
shingles. Two fingerprints are linked when at most ``radius`` bits differ.

Covering (Pagh, 2016): every bit position gets a nonzero vector of
``radius + 1`` bits. For each nonzero vector v there is a mask of the
positions whose vector has an odd product with v. Any ``radius`` differing
positions span less than the whole space, so some v is orthogonal to all of
them and its mask leaves them all out: the pair agrees under that mask and
meets in that table, always. With radius 3 there are 15 tables of about 34
bits.

Equal fingerprints are put together first, so copies cost nothing. In a
bucket the links are found by search and only a forest of them is written,
never all pairs. A bucket of more than ``most_in_bucket`` fingerprints is not
searched; its members go through an exact second way, whose groups are
bounded by the radius alone (``ball_links``).

Defined results: a null, empty or white text has fingerprint zero and is
linked like any other; rows with one doc_id are separate documents; null ids
are passed over when the smallest id is chosen; an empty table gives an empty
table; other columns are not read.
"""

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from themeloom.llm.links import components
from themeloom.llm.rows import map_batches, text_bytes
from themeloom.plans.staging import staged

WORDS = 3
RADIUS = 3
SEED = 42
BITS = 64

# Largest bucket that is searched, and hashes whose bits are counted at a time.
MOST_IN_BUCKET = 2048
CHUNK = 1 << 15


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """XXH64 of each shingle, repeats included."""
    tokens = text_bytes(text).lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(tokens) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    found = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())]
    return np.array(found, np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half the hashes."""
    counts = np.zeros(BITS, np.int64)
    for begin in range(0, len(hashes), CHUNK):
        part = hashes[begin : begin + CHUNK].astype("<u8").view(np.uint8).reshape(-1, BITS // 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist())


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, text_key, fingerprint`` with the bits of the fingerprint as a long.

    ``text_key`` tells texts with one doc_id apart.
    """

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            prints = [fingerprint(shingle_hashes(t, words)) for t in batch.column(2).to_pylist()]
            return {
                "doc_id": batch.column(0),
                "text_key": batch.column(1),
                "fingerprint": pa.array(np.array(prints, np.uint64).view(np.int64), pa.int64()),
            }

        return work

    read = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    return map_batches(read, "doc_id long, text_key long, fingerprint long", make)


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """``2 ** (radius + 1) - 1`` masks; see the module's text."""
    vectors = (1 << (radius + 1)) - 1
    of_bit = [1 + i % vectors for i in range(bits)]
    return [
        sum(1 << i for i, m in enumerate(of_bit) if (m & v).bit_count() % 2)
        for v in range(1, vectors + 1)
    ]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def forest(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what pairs within the radius connect.

    A breadth-first search: each member looks once at those not yet reached.
    """
    links, rest = [], members
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            near = np.bitwise_count(rest ^ at) <= radius
            if near.any():
                reached = rest[near]
                links += [(int(at), int(x)) for x in reached]
                frontier += list(reached)
                rest = rest[~near]
    return links


def bucket_links(
    prints: DataFrame, radius: int = RADIUS, most_in_bucket: int = MOST_IN_BUCKET
) -> DataFrame:
    """``a, b, crowded`` of different fingerprints: links found in buckets.

    Buckets come sorted, and a task holds one of at most ``most_in_bucket``
    at a time. A member of a larger one comes back as ``crowded`` with
    itself.
    """
    masks = F.array(*[F.lit(_signed(mask)) for mask in covering_masks(radius)])
    keyed = prints.select("fingerprint", F.posexplode(masks).alias("table", "mask")).select(
        "table", F.col("fingerprint").bitwiseAND(F.col("mask")).alias("bucket"), "fingerprint"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept, crowded = None, [], False

        def found(part: np.ndarray, last: bool) -> tuple[list, bool]:
            """Links of what is held with ``part``, and whether the bucket is crowded."""
            nonlocal kept, crowded
            if not crowded and sum(map(len, kept)) + len(part) > most_in_bucket:
                crowded = True
            if crowded:
                rows = [(int(x), int(x), True) for p in (*kept, part) for x in p]
                kept = []
                return rows, True
            kept.append(part)
            if not last:
                return [], False
            members = np.concatenate(kept)
            kept = []
            return [(*link, False) for link in forest(members, radius)], False

        def output(rows: list) -> pa.RecordBatch:
            a, b, c = zip(*rows) if rows else ((), (), ())
            return pa.RecordBatch.from_pydict(
                {
                    "a": pa.array(np.array(a, np.uint64).view(np.int64), pa.int64()),
                    "b": pa.array(np.array(b, np.uint64).view(np.int64), pa.int64()),
                    "crowded": pa.array(c, pa.bool_()),
                }
            )

        for batch in batches:
            tables = batch.column(0).to_numpy()
            buckets = batch.column(1).to_numpy()
            members = batch.column(2).to_numpy().view(np.uint64)
            if not len(members):
                continue
            new = np.flatnonzero((np.diff(tables) != 0) | (np.diff(buckets) != 0)) + 1
            starts, rows = np.concatenate([[0], new]), []
            ends = np.append(new, len(members))
            first = (tables[0], buckets[0])
            if key is not None and key != first:
                rows += found(members[:0], True)[0]
                crowded = False
            for i in np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(members))):
                a, b = starts[i], ends[i]
                last = b < len(members)
                rows += found(members[a:b], last)[0]
                if last:
                    crowded = False
            key = (tables[-1], buckets[-1])
            yield output(rows)
        if key is not None:
            yield output(found(np.empty(0, np.uint64), True)[0])

    dealt = keyed.repartition("table", "bucket").sortWithinPartitions("table", "bucket")
    return dealt.mapInArrow(run, "a long, b long, crowded boolean")


def ball_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: links between the given fingerprints, through points between them.

    Two fingerprints within the radius have a point within ``radius // 2`` of
    one and within the rest of the radius of the other. Every fingerprint is
    put at all its points of either kind, and at a point all are linked to the
    smallest one of the nearer kind. Those are all within the radius of it. A
    group holds at most the points of one ball (2,081 for radius 3), however
    many fingerprints there are.
    """
    near = radius // 2
    flips = [
        _signed(sum(1 << i for i in chosen))
        for k in range(radius - near + 1)
        for chosen in combinations(range(BITS), k)
    ]
    n_near = sum(comb(BITS, k) for k in range(near + 1))
    placed = prints.select("fingerprint", F.posexplode(F.lit(flips)).alias("at", "flip")).select(
        F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("point"),
        "fingerprint",
        (F.col("at") < n_near).alias("is_near"),
    )
    at_point = W.partitionBy("point")
    hub = F.min(F.when(F.col("is_near"), F.col("fingerprint"))).over(at_point)
    linked = placed.withColumn("hub", hub).where("hub IS NOT NULL AND hub <> fingerprint")
    return linked.select(F.col("hub").alias("a"), F.col("fingerprint").alias("b"))


def near_duplicates(
    docs: DataFrame,
    words: int = WORDS,
    radius: int = RADIUS,
    most_in_bucket: int = MOST_IN_BUCKET,
) -> DataFrame:
    """``doc_id, text_key, fingerprint, group_id, component_id``, a row per document.

    ``group_id`` names the component, ``component_id`` is its smallest doc_id.
    """
    marked = staged(fingerprints(docs, words), "fingerprints")
    prints = staged(
        marked.groupBy("fingerprint").agg(
            F.min("doc_id").alias("smallest"), F.count(F.lit(1)).alias("n")
        ),
        "distinct-fingerprints",
    )
    found = staged(bucket_links(prints, radius, most_in_bucket).distinct(), "bucket-links")
    crowded = found.where("crowded").select(F.col("a").alias("fingerprint")).distinct()
    links = found.where("NOT crowded").select("a", "b").union(ball_links(crowded, radius))
    labels = components(links)

    joined = prints.join(labels, prints["fingerprint"] == labels["node"], "left")
    # A fingerprint of one document without a link is its own group.
    shared = joined.where("n > 1 OR node IS NOT NULL").select(
        "fingerprint", "smallest", F.coalesce("label", "fingerprint").alias("group_id")
    )
    smallest = shared.groupBy("group_id").agg(F.min("smallest").alias("component_id"))
    groups = shared.select("fingerprint", "group_id").join(smallest, "group_id")
    return marked.join(groups, "fingerprint", "left").select(
        "doc_id",
        "text_key",
        "fingerprint",
        F.coalesce("group_id", "fingerprint").alias("group_id"),
        F.when(F.col("group_id").isNull(), F.col("doc_id"))
        .otherwise(F.col("component_id"))
        .alias("component_id"),
    )


def _same_row(text_key: Column) -> Column:
    """One number for an id, null or not, and a text."""
    id_ = F.col("doc_id").cast("long")
    return F.xxhash64(F.coalesce(id_, F.lit(0).cast("long")), id_.isNull(), text_key)


def keep_first(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One document of each group: the smallest doc_id, ties by text."""
    own = near_duplicates(docs, words, radius)
    in_group = W.partitionBy("group_id").orderBy(F.col("doc_id").asc_nulls_last(), "text_key")
    first = own.withColumn("_rank", F.row_number().over(in_group)).where("_rank = 1")
    # One number for id and text: texts are then dealt out once, to meet and to be told apart.
    first = first.select(
        _same_row(F.col("text_key")).alias("_same"),
        F.col("doc_id").alias("_id"),
        F.col("text_key").alias("_key"),
    )
    met = docs.withColumn("_same", _same_row(F.xxhash64("text"))).join(first, "_same")
    met = met.where(F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key")))
    # Repeated rows with one doc_id and text: one of them.
    copies = W.partitionBy("_same", "_id", "_key").orderBy("_id")
    one = met.withColumn("_copy", F.row_number().over(copies)).where("_copy = 1")
    return one.select(*docs.columns)


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, WORDS, RADIUS).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
