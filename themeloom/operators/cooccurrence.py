"""Word vectors from counts of words that stand near each other.

Pairs are counted in Arrow batches, inside the article's row, and added up
over tasks. Their shifted positive mutual information is a sparse square
matrix, one row per word, and its leading singular vectors give the word
vectors (Levy and Goldberg, 2014). The driver holds what the SVD needs, which
follows from the number of words and the length of a vector. Counts are whole
numbers, so the vectors do not depend on the number of cores, except for
rounding in the sums of the SVD.
"""

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.operators import matrix, products, wide
from themeloom.operators.batches import in_pieces
from themeloom.operators.sizes import small

# Kept lemmas to either side that count as near, and vectors' usual length.
WINDOW = 5
VECTOR_SIZE = 100

# What the SVD of word vectors is held to; they need no more.
PASSES = 6
TOLERANCE = 1e-6


def _pairs(ids: np.ndarray, owner: np.ndarray, window: int, n_words: int) -> np.ndarray:
    """All pairs of one batch as ``smaller id * n_words + larger id``."""
    found = []
    for far in range(1, min(window, len(ids) - 1) + 1):
        a, b = ids[:-far], ids[far:]
        near = (owner[:-far] == owner[far:]) & (a >= 0) & (b >= 0)
        a, b = a[near], b[near]
        found.append(np.minimum(a, b) * n_words + np.maximum(a, b))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def cooccurrences(lemmas: DataFrame, words: Sequence[str], window: int = WINDOW) -> DataFrame:
    """``word_id, context_id, n``: how often two words are at most ``window`` lemmas apart.

    A word's id is its place in ``words``. Both orders of a pair are rows, and
    a word beside itself counts for both. Other lemmas keep their place but
    are not counted; null lists and null lemmas are no words.
    """
    known = pa.array(words, pa.string())
    if len(known) != len(pc.unique(known)):
        raise ValueError("a word is listed twice")
    n_words = len(words)
    shared = lemmas.sparkSession.sparkContext.broadcast(list(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = pa.array(shared.value, pa.string())
        # Near lemmas are laid out as pairs, many times the bytes of the lemmas.
        for batch in in_pieces(batches):
            lists = batch.column(0)
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            at = pc.index_in(lists.flatten(), value_set=listed, skip_nulls=True)
            ids = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            codes, n = np.unique(_pairs(ids, owner, window, n_words), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((codes // max(n_words, 1)).astype(np.int32)),
                    pa.array((codes % max(n_words, 1)).astype(np.int32)),
                    pa.array(n.astype(np.int64)),
                ],
                ["a", "b", "n"],
            )

    parts = lemmas.select("lemmas").mapInArrow(run, "a int, b int, n long")
    counted = parts.groupBy("a", "b").agg(F.sum("n").alias("n"))
    one_way = F.struct(F.col("a").alias("word_id"), F.col("b").alias("context_id"), "n")
    other_way = F.struct(F.col("b").alias("word_id"), F.col("a").alias("context_id"), "n")
    twice = F.struct(
        F.col("a").alias("word_id"), F.col("a").alias("context_id"), (F.col("n") * 2).alias("n")
    )
    ways = F.when(F.col("a") == F.col("b"), F.array(twice)).otherwise(F.array(one_way, other_way))
    return counted.select(F.explode(ways).alias("pair")).select("pair.*")


def positive_pmi(counts: DataFrame, n_words: int, shift: float = 1.0) -> DataFrame:
    """``word_id, context_id, pmi`` of the pairs whose information exceeds ``ln shift``."""
    sums = counts.groupBy("word_id").agg(F.sum("n").cast("double").alias("own"))
    total = sums.agg(F.sum("own").alias("total"))
    sides = small(sums, n_words)
    others = sides.select(F.col("word_id").alias("context_id"), F.col("own").alias("other"))
    # The total is one row.
    met = counts.join(sides, "word_id").join(others, "context_id").join(F.broadcast(total))
    ratio = F.col("n") * F.col("total") / (F.col("own") * F.col("other"))
    pmi = F.log(ratio) - math.log(shift)
    return met.select("word_id", "context_id", pmi.alias("pmi")).where("pmi > 0")


def rows_of(pairs: DataFrame) -> DataFrame:
    """``word_id, at, entries``: one sparse row per word, by ascending context."""
    listed = F.array_sort(F.collect_list(F.struct("context_id", "pmi")))
    rows = pairs.groupBy("word_id").agg(listed.alias("row"))
    return rows.select(
        "word_id",
        F.col("row.context_id").alias("at"),
        F.col("row.pmi").alias("entries"),
    )


def factorised(
    rows: DataFrame,
    n_words: int,
    vector_size: int = VECTOR_SIZE,
    passes: int = PASSES,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """``word_id, vector``: left singular vectors times the roots of the singular values.

    Rows, ``word_id, at, entries``, are read twice, so stage them. A matrix of
    lower rank gives zeros at the end of the vectors.
    """
    features = (F.col("at"), F.col("entries"))
    squares, basis, _ = wide.leading_eigenvectors(
        rows, n_words, vector_size, features, passes=passes, tolerance=tolerance
    )
    noise = n_words * np.finfo(float).eps * max(squares, default=0.0)
    roots = np.where(squares > noise, np.maximum(squares, noise), np.inf) ** 0.25
    dense = np.zeros((n_words, vector_size))
    dense[:, : len(squares)] = matrix.orient(basis) / roots
    return products.times(rows, dense, features, "vector", ("word_id",))
