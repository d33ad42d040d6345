"""The most frequent terms without a shuffle of every term there is.

Every task keeps a bounded number of counters (Misra and Gries; summaries add
up as in Agarwal et al., 2012). A counter is never above the true number of
articles, and all tasks together tell by how much it can be below. So the
n-th largest counter bounds the n-th largest frequency, and only terms that
can reach it are counted exactly, in a second pass. Where the counters are too
few to rule out the terms that no task kept, all terms are counted.
"""

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.operators.batches import in_pieces
from themeloom.operators.sizes import small
from themeloom.plans.staging import release, staged

# Counters of a task for each term that is asked for.
COUNTERS_PER_TERM = 20


def cut_back(held: Counter, counters: int) -> int:
    """Leave at most ``counters`` counters; gives what every one has lost by it."""
    if len(held) <= counters:
        return 0
    cut = sorted(held.values(), reverse=True)[counters]
    for term in [term for term, n in held.items() if n <= cut]:
        del held[term]
    for term in held:
        held[term] -= cut
    return cut


def summaries(lemmas: DataFrame, counters: int) -> DataFrame:
    """``term, n, lost``: added-up counters of all tasks.

    The null term has the number of articles as ``n``, and in ``lost`` by how
    much any other ``n`` may be below the truth.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        n_rows = lost = 0
        for batch in in_pieces(batches):
            n_rows += batch.num_rows
            met = pc.value_counts(batch.column(0).flatten().drop_null())
            met = zip(met.field("values").to_pylist(), met.field("counts").to_pylist())
            held.update(dict(met))
            if len(held) > 2 * counters:
                lost += cut_back(held, counters)
        lost += cut_back(held, counters)
        terms = [None, *held]
        yield pa.RecordBatch.from_pydict(
            {
                "term": pa.array(terms, pa.string()),
                "n": pa.array([n_rows, *held.values()], pa.int64()),
                "lost": pa.array([lost] + [0] * len(held), pa.int64()),
            }
        )

    once = lemmas.select(F.array_distinct("lemmas").alias("terms"))
    parts = once.mapInArrow(run, "term string, n long, lost long")
    return parts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("lost").alias("lost"))


def most_frequent(
    lemmas: DataFrame, num_terms: int, counters: int | None = None
) -> tuple[int, list[tuple[str, int]]]:
    """The number of articles, and the ``num_terms`` terms in most of them with their counts.

    Exact, ties by term, whatever the number of ``counters``; it only decides
    how many rows are shuffled. Null lemmas are passed over.
    """
    counters = num_terms * COUNTERS_PER_TERM if counters is None else counters
    merged = staged(summaries(lemmas, counters), "heavy-terms")
    is_term = F.col("term").isNotNull()
    head = merged.orderBy(is_term, F.desc("n"), "term").limit(num_terms + 1).collect()
    if not head:
        return 0, []
    n_docs, lost, top = head[0].n, head[0].lost, head[1:]
    if lost == 0:
        release(merged)
        return n_docs, [(row.term, row.n) for row in top]
    least = top[-1].n if len(top) == num_terms else 0
    every = lemmas.select(F.explode_outer(F.array_distinct("lemmas")).alias("term")).where(is_term)
    if lost < least:
        possible = merged.where(is_term & (F.col("n") + lost >= least)).select("term")
        every = every.join(small(possible, possible.count()), "term", "left_semi")
    counted = every.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = counted.orderBy(F.desc("df"), "term").limit(num_terms).collect()
    release(merged)
    return n_docs, [(row.term, row.df) for row in rows]
