"""Line deduplication with a once-seen and a twice-seen Bloom filter.

1. Every task puts the line keys of its documents in two Bloom filters, one
   of hashes seen once and one of hashes seen twice. A filter is cut into
   segments; a task sends the bits it set, and filters of two tasks add up as
   ``once = a | b`` and ``twice = ta | tb | (a & b)``.
2. Only lines whose bits are all in the twice-seen filter are suspected
   repeats. They alone are shuffled, as digests, to be counted exactly.
3. Confirmed repeats with the doc_id that keeps each go to the documents, and
   all others lose them. Up to ``MOST_SENT`` of them (some 20 MB) are
   broadcast, so texts stay where they are; more are joined to the documents.

The broadcast twice-seen filter has ``2 ** filter_bits`` bits whatever the
input (16 MiB by default). When it fills up, more lines are suspected and
shuffled; the result stays exact.

Defined results: a null or empty text is one empty line. A row is a document,
so repeated rows with one doc_id count as several documents, and all of them
keep what their doc_id keeps. A null doc_id is smaller than any other. Lines
shorter than ``min_chars`` code points are never dropped. Other columns stay
as they are, and an empty table gives an empty table.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.llm.rows import WHITE, map_batches, text_bytes
from themeloom.plans.staging import staged

MIN_CHARS = 40
MIN_DOCUMENTS = 5
FILTER_BITS = 27

# Bits of one segment, and bits that a key sets, all in one segment.
SEGMENT_BITS = 18
PROBES = 3

# Confirmed repeats that are sent to every executor, at most.
MOST_SENT = 200_000

# A hot line is joined in this many parts.
SALTS = 64

DROPPED = "_dropped_lines"


def lines_of(text: str | None) -> list[bytes]:
    return text_bytes(text).split(b"\n")


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The stripped, lower-cased line, or None if it is too short to count."""
    key = line.strip(WHITE).lower()
    if len(key) < min_chars or len(key.decode()) < min_chars:
        return None
    return key


def keys_of(text: str | None, min_chars: int) -> set[bytes]:
    """The different keys of a document."""
    found = (line_key(line, min_chars) for line in lines_of(text))
    return {key for key in found if key is not None}


def probes(hashes: np.ndarray, filter_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment of each hash, and its bits there as an array of PROBES columns."""
    inside = min(SEGMENT_BITS, filter_bits)
    outside = filter_bits - inside
    segments = hashes >> np.uint64(64 - outside) if outside else np.zeros_like(hashes)
    step = (hashes >> np.uint64(20)) | np.uint64(1)
    with np.errstate(over="ignore"):
        places = [hashes + np.uint64(i) * step for i in range(PROBES)]
    bits = [place & np.uint64((1 << inside) - 1) for place in places]
    return segments.astype(np.int64), np.stack(bits, axis=1).astype(np.int64)


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(key) for key in keys], dtype=np.uint64)


def key_mark(key: bytes) -> int:
    """A hash that costs little, as a signed number."""
    return xxhash.xxh3_64_intdigest(key) - (1 << 63)


def _filter_parts(docs: DataFrame, min_chars: int, filter_bits: int) -> DataFrame:
    """``segment, once, twice``: the bits that one task has set, as int32 positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [k for t in batch.column(0).to_pylist() for k in keys_of(t, min_chars)]
            if not keys:
                continue
            hashes, times = np.unique(_hashes(keys), return_counts=True)
            segments, bits = probes(hashes, filter_bits)
            order = np.argsort(segments, kind="stable")
            segments, bits, again = segments[order], bits[order], times[order] > 1
            names, starts = np.unique(segments, return_index=True)
            ends = np.append(starts[1:], len(segments))
            once, twice = [], []
            for a, b in zip(starts, ends):
                # Within a task two keys that share a bit count as one seeing;
                # only sharing it with another task, or a repeat, counts twice.
                once.append(np.unique(bits[a:b]).astype("<i4").tobytes())
                twice.append(np.unique(bits[a:b][again[a:b]]).astype("<i4").tobytes())
            yield pa.RecordBatch.from_pydict(
                {
                    "segment": pa.array(names, pa.int64()),
                    "once": pa.array(once, pa.binary()),
                    "twice": pa.array(twice, pa.binary()),
                }
            )

    return docs.select("text").mapInArrow(run, "segment long, once binary, twice binary")


def _merged_twice(parts: DataFrame, filter_bits: int) -> DataFrame:
    """``segment, bits``: the twice-seen filter, merged segment by segment.

    Parts come sorted by segment, so a task holds two segments of bits at a
    time, however many tasks sent parts.
    """
    inside = min(SEGMENT_BITS, filter_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, once, twice = None, None, None

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {
                    "segment": pa.array([current], pa.int64()),
                    "bits": pa.array(
                        [np.packbits(twice, bitorder="little").tobytes()], pa.binary()
                    ),
                }
            )

        for batch in batches:
            for segment, seen, repeated in zip(*(c.to_pylist() for c in batch.columns)):
                if segment != current:
                    if current is not None and twice.any():
                        yield packed()
                    current = segment
                    once, twice = np.zeros(1 << inside, bool), np.zeros(1 << inside, bool)
                new = np.frombuffer(seen, "<i4")
                twice[new[once[new]]] = True
                once[new] = True
                twice[np.frombuffer(repeated, "<i4")] = True
        if current is not None and twice.any():
            yield packed()

    dealt = parts.repartition("segment").sortWithinPartitions("segment")
    return dealt.mapInArrow(run, "segment long, bits binary")


def twice_seen(docs: DataFrame, min_chars: int = MIN_CHARS, filter_bits: int = FILTER_BITS) -> dict:
    """Segments of the twice-seen filter: at most ``2 ** filter_bits`` bits in all."""
    merged = _merged_twice(_filter_parts(docs, min_chars, filter_bits), filter_bits)
    return {row.segment: bytes(row.bits) for row in merged.collect()}


def suspected(keys: list[bytes], twice: dict, filter_bits: int) -> list[bytes]:
    """The keys whose bits are all in the twice-seen filter."""
    if not keys or not twice:
        return []
    segments, bits = probes(_hashes(keys), filter_bits)
    kept = []
    for key, segment, own in zip(keys, segments.tolist(), bits.tolist()):
        known = twice.get(segment)
        if known is not None and all(known[bit >> 3] >> (bit & 7) & 1 for bit in own):
            kept.append(key)
    return kept


def repeats(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_documents: int = MIN_DOCUMENTS,
    filter_bits: int = FILTER_BITS,
) -> tuple[DataFrame, DataFrame]:
    """Suspected repeats ``doc_id, digest, mark``, and confirmed ones.

    The confirmed table is ``digest, n_documents, keeper, mark``. Digests are
    SHA-256, so that equal ones are equal lines; marks are quick hashes.
    """
    spark = docs.sparkSession
    filters = spark.sparkContext.broadcast(twice_seen(docs, min_chars, filter_bits))

    def make():
        twice = filters.value

        def work(batch: pa.RecordBatch) -> dict:
            ids, digests, marks = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for key in suspected(list(keys_of(text, min_chars)), twice, filter_bits):
                    ids.append(doc_id)
                    digests.append(hashlib.sha256(key).digest())
                    marks.append(key_mark(key))
            return {
                "doc_id": pa.array(ids, pa.int64()),
                "digest": pa.array(digests, pa.binary()),
                "mark": pa.array(marks, pa.int64()),
            }

        return work

    schema = "doc_id long, digest binary, mark long"
    seen = staged(map_batches(docs.select("doc_id", "text"), schema, make), "suspected-lines")
    counted = seen.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.max("doc_id").alias("keeper"),
        F.min("mark").alias("mark"),
    )
    return seen, counted.where(F.col("n_documents") >= min_documents)


def dedup_lines(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_documents: int = MIN_DOCUMENTS,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """The documents with repeated lines gone, ``n_lines`` and ``n_dropped``.

    ``docs`` has ``doc_id, text`` and any other columns.
    """
    seen, confirmed = repeats(docs, min_chars, min_documents, filter_bits)
    confirmed = staged(confirmed, "confirmed-lines")
    sent = confirmed.select("mark", "digest", "keeper").limit(MOST_SENT + 1).collect()
    if len(sent) <= MOST_SENT:
        keepers: dict[int, list[tuple[bytes, int | None]]] = {}
        for row in sent:
            keepers.setdefault(row.mark, []).append((bytes(row.digest), row.keeper))
        return _without_sent(docs, keepers, min_chars)
    return _without_joined(docs, seen, confirmed, min_chars)


def _without_sent(docs: DataFrame, keepers: dict, min_chars: int) -> DataFrame:
    """The documents without confirmed repeats, looked up where the texts are."""
    shared = docs.sparkSession.sparkContext.broadcast(keepers)

    def make():
        known = shared.value

        def loses(doc_id: int | None, key: bytes | None) -> bool:
            found = known.get(key_mark(key)) if key else None
            if not found:
                return False
            digest = hashlib.sha256(key).digest()
            return any(digest == own and doc_id != keeper for own, keeper in found)

        return loses

    ids = F.col("doc_id").cast("long")
    return _without(docs, docs.select("*", ids.alias(DROPPED)), min_chars, make)


def _without_joined(
    docs: DataFrame, seen: DataFrame, confirmed: DataFrame, min_chars: int
) -> DataFrame:
    """The same for any number of confirmed repeats: each document meets those it loses."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    copies = confirmed.select("digest", "keeper", salts)
    own_salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")
    losing = (
        seen.select("doc_id", "digest", own_salt)
        .join(copies, ["digest", "salt"])
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    )
    # A document loses at most its own lines, so the group is bounded by it.
    lost = losing.groupBy(F.col("doc_id").alias("_loser")).agg(
        F.collect_set("digest").alias(DROPPED)
    )
    marked = docs.join(lost, docs["doc_id"].eqNullSafe(lost["_loser"]), "left").drop("_loser")

    def make():
        def loses(gone: list[bytes] | None, key: bytes | None) -> bool:
            return bool(gone and key) and hashlib.sha256(key).digest() in gone

        return loses

    return _without(docs, marked, min_chars, make)


def _without(docs: DataFrame, marked: DataFrame, min_chars: int, make_loses) -> DataFrame:
    """Drop the lines for which ``loses(value of DROPPED, key)`` holds."""
    fields = [f for f in docs.schema.fields if f.name not in ("n_lines", "n_dropped")]
    added = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    names = [f.name for f in fields]

    def make():
        loses = make_loses()

        def work(batch: pa.RecordBatch) -> dict:
            columns = {name: batch.column(i) for i, name in enumerate(names)}
            texts, n_lines, n_dropped = [], [], []
            own_of = batch.column(len(names)).to_pylist()
            for text, own in zip(columns["text"].to_pylist(), own_of):
                lines = lines_of(text)
                kept = [line for line in lines if not loses(own, line_key(line, min_chars))]
                texts.append(b"\n".join(kept).decode())
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            columns["text"] = pa.array(texts, pa.string())
            columns["n_lines"] = pa.array(n_lines, pa.int64())
            columns["n_dropped"] = pa.array(n_dropped, pa.int64())
            return columns

        return work

    return map_batches(marked.select(*names, DROPPED), T.StructType(fields + added), make)


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


OP4_SQL = r"""
WITH lines AS (
    SELECT doc_id, pos, line, lower_ascii AS key
    FROM (
        SELECT doc_id, pos, line,
               translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii
        FROM (
            SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
        )
    )
), repeated AS (
    SELECT key, max(doc_id) AS keeper
    FROM lines WHERE length(key) >= 40
    GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
    SELECT l.doc_id, l.pos, l.line, r.key IS NOT NULL AND l.doc_id <> r.keeper AS dropped
    FROM lines l LEFT JOIN repeated r ON l.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), ''))
           AS kept_sha256
FROM marked GROUP BY doc_id
"""
