"""Document fingerprints by winnowing, in DataFrame functions only.

A text is lower-cased and cut into words. Hashes of ``2 ** GRAM_STEPS`` words
are rolled together by doubling: two hashes of n words, n apart, make one of
2n words. Of every ``2 ** WINDOW_STEPS`` neighbouring hashes the smallest is
kept, of equal ones the rightmost, with its position. So two texts that share
a run of ``2 ** GRAM_STEPS + 2 ** WINDOW_STEPS - 1`` words share a fingerprint
hash, always (Schleimer, Wilkerson and Aiken, 2003).

A hash and its position are one whole number, 32 bits of hash above 31 bits of
``LAST - position``: the least of them is the smallest hash, and the rightmost
of equals. A position is a place in an array, so it always fits.

Defined results: a null, empty or white text has an empty fingerprint; a text
of fewer words than a gram has one hash of all its words; one of fewer hashes
than a window keeps the smallest. Two empty fingerprints are alike (1.0), an
empty and another are not (0.0). Documents follow each other by descending
doc_id, null ids last, ties by text; the first follows the last. Repeated rows
stay; an empty table gives an empty table; other columns are not read.
"""

from collections.abc import Callable
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GRAM_STEPS = 2
WINDOW_STEPS = 4

# The largest position, and the factor that rolls hashes together.
LAST = (1 << 31) - 1
FACTOR = 0x1000193

WHITE = " \t\n\x0b\x0c\r"

# Rows of one chunk of neighbouring documents, roughly.
CHUNK_ROWS = 250
MOST_CHUNKS = 10_000


def words_of(text: Column) -> Column:
    """Lower-cased words; none for a null, empty or white text."""
    trimmed = F.lower(F.btrim(text, F.lit(WHITE)))
    words = F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+")
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) > 0, words).otherwise(
        F.array().cast("array<string>")
    )


def _from(array: Column, start: int) -> Column:
    """The array without its first ``start`` elements."""
    return F.slice(array, start + 1, F.greatest(F.size(array) - start, F.lit(0)))


def _hash(word: Column) -> Column:
    return F.xxhash64(word).bitwiseAND(F.lit(0xFFFFFFFF))


def _rolling(width: int) -> Callable[[Column, Column], Column]:
    """Roll the hash of ``width`` words and that of the next ones together."""
    factor = F.lit(pow(FACTOR, width, 1 << 32))

    def rolled(left: Column, right: Column) -> Column:
        # At most 2**30 times 2**32, and 2**32: no overflow.
        low = left.bitwiseAND(F.lit(0x3FFFFFFF)) * factor
        mixed = low + right.bitwiseXOR(F.shiftrightunsigned(left, 15))
        return mixed.bitwiseXOR(F.shiftrightunsigned(mixed, 29)).bitwiseAND(F.lit(0xFFFFFFFF))

    return rolled


def with_selection(table: DataFrame, text: str, selected: str) -> DataFrame:
    """Add the kept hashes with their positions, as whole numbers in text order.

    Every step is a column of its own, so that each is computed once.
    """
    fresh = [f"_{selected}_{i}" for i in range(GRAM_STEPS + WINDOW_STEPS + 4)]
    names = iter(fresh)
    at = next(names)
    table = table.withColumn(at, F.transform(words_of(F.col(text)), _hash))
    for step in range(GRAM_STEPS):
        width, last, at = 1 << step, at, next(names)
        pairs = F.zip_with(
            F.slice(F.col(last), 1, F.greatest(F.size(last) - width, F.lit(0))),
            _from(F.col(last), width),
            _rolling(width),
        )
        # Too short for a gram: one hash of all that there is.
        whole = F.slice(F.array(_hash(F.col(last))), 1, F.least(F.size(last), F.lit(1)))
        table = table.withColumn(at, F.when(F.size(last) > width, pairs).otherwise(whole))
    last, at = at, next(names)
    placed = F.transform(
        F.col(last), lambda h, i: F.shiftleft(h, 31) + (F.lit(LAST) - i.cast("long"))
    )
    table = table.withColumn(at, placed)
    for step in range(WINDOW_STEPS):
        width, last, at = 1 << step, at, next(names)
        # Beside nothing, a value stays; what is beyond the end is cut below.
        smaller = F.zip_with(F.col(last), _from(F.col(last), width), lambda a, b: F.least(a, b))
        table = table.withColumn(at, smaller)
    window = 1 << WINDOW_STEPS
    n_windows = F.greatest(F.size(at) - window + 1, F.least(F.size(at), F.lit(1)))
    whole_windows = F.slice(F.col(at), 1, n_windows)
    return table.withColumn(selected, F.array_distinct(whole_windows)).drop(*fresh)


def hashes_of(selected: Column) -> Column:
    return F.array_distinct(F.transform(selected, lambda s: F.shiftright(s, 31)))


def as_text(selected: Column) -> Column:
    """``hash:position`` of what is kept, in hexadecimal and decimal."""
    shown = F.transform(
        selected,
        lambda s: F.concat_ws(
            ":",
            F.lower(F.hex(F.shiftright(s, 31))),
            (F.lit(LAST) - s.bitwiseAND(F.lit(LAST))).cast("string"),
        ),
    )
    return F.array_join(shown, " ")


def likeness(a: Column, b: Column) -> Column:
    """Share of common hashes in all hashes of two fingerprints."""
    common = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - common
    return F.when(every == 0, F.lit(1.0)).otherwise(common / every)


def _cuts_below(cuts: list[int], value: Column) -> Column:
    """How many cuts are below the value, looked up in two steps."""
    if not cuts:
        return F.lit(0)
    step = isqrt(len(cuts)) + 1
    below = lambda array: F.size(F.filter(array, lambda cut: cut < value))
    coarse = below(F.lit(cuts[step - 1 :: step] or [cuts[-1]]).cast("array<long>"))
    return coarse * step + below(F.slice(F.lit(cuts).cast("array<long>"), coarse * step + 1, step))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``next_<column>`` of the next document by descending doc_id.

    Documents are dealt by their id into chunks of neighbours. The cut points
    are ids that occur, so the first row of a chunk is known: it is also sent,
    as a copy, to the end of the chunk before it, and the first row of all to
    the end of the last chunk. One shuffle brings neighbours together.
    """
    known = docs.agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("first")).first()
    chunks = max(1, min(MOST_CHUNKS, known.n // CHUNK_ROWS))
    cuts: list[int] = []
    if known.first is not None and chunks > 1:
        shares = [i / chunks for i in range(1, chunks)]
        found = docs.agg(F.percentile_approx("doc_id", shares, 10 * MOST_CHUNKS).alias("cuts"))
        cuts = sorted(set(found.first().cuts))
    # Chunk k has the ids above cut k - 1 up to cut k; null ids are in chunk 0.
    chunk = F.coalesce(_cuts_below(cuts, F.col("doc_id")), F.lit(0))
    bounds = F.lit(cuts).cast("array<long>") if cuts else F.array().cast("array<long>")
    is_top = F.get(bounds, chunk) == F.col("doc_id")
    is_first = F.col("doc_id").eqNullSafe(F.lit(known.first).cast("long"))
    # Chunks run down: after chunk k + 1 comes k, and chunk 0 is the last.
    homes = F.array_compact(
        F.array(chunk * 2, F.when(is_top, (chunk + 1) * 2 + 1), F.when(is_first, F.lit(1)))
    )
    dealt = docs.withColumn("_home", F.explode(homes)).withColumn(
        "_is_copy", F.pmod(F.col("_home"), F.lit(2)) == 1
    )
    dealt = dealt.withColumn("_chunk", F.floor(F.col("_home") / 2))
    order = [F.col("_is_copy"), F.col("doc_id").desc_nulls_last(), F.col("text")]
    down = W.partitionBy("_chunk").orderBy(*order)
    followed = dealt
    for column in columns:
        followed = followed.withColumn(f"next_{column}", F.lead(column).over(down))
    return followed.where(~F.col("_is_copy")).drop("_home", "_is_copy", "_chunk")


def edited_text(text: Column, following: Column) -> Column:
    """The text with its last third replaced by as much of the next one's beginning."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(following, F.lit(1), third))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited, kept, edited_kept, next_kept`` of ``doc_id, text``."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    beside = with_next(with_selection(texts, "text", "kept"), ["text", "kept"])
    edited = beside.select(
        "doc_id",
        F.length("text").alias("n_chars"),
        "kept",
        "next_kept",
        edited_text(F.col("text"), F.col("next_text")).alias("edited"),
    )
    return with_selection(edited, "edited", "edited_kept")


def op10_winnowing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = fingerprint_documents(docs).withColumn("hashes", hashes_of(F.col("kept")))
    return made.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("kept")).alias("fingerprint"),
        as_text(F.col("edited_kept")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), hashes_of(F.col("edited_kept"))).alias("near_edited"),
        likeness(F.col("hashes"), hashes_of(F.col("next_kept"))).alias("near_next"),
    )
