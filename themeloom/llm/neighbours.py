"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in two halves, and each half is quantised with its own
centroids (Babenko and Lempitsky, 2012). A cell is a pair of centroids, so a
few centroids make many cells. A query goes through cells by the sum of its
halves' nearness to the two centroids, with a heap over the two sorted lists,
until the cells hold enough entries; those are ranked again by the inner
product of the original vectors.

- Only the centroids are fitted on a sample: ``SAMPLE`` vectors with the
  smallest hash. Every vector is indexed. The number of centroids grows slowly
  with the number of entries.
- Equal vectors are one entry with the smallest of their ids, as many as a
  query can return; the rest of the ids cannot be among the nearest, as ties
  go to smaller ids. A vector that fills the table is thus one entry.
- Cells are dealt into blocks of some ``BLOCK`` entries (a crowded row of cells
  is split), queries into blocks as well, and a task ranks one block of
  entries for one block of queries. The best of each block are merged in
  rounds of ``FAN_IN`` blocks.

How many entries a query must rank depends on the vectors. Vectors spread
evenly over the sphere have no near cells: to find 19 in 20 of the nearest,
half of some 50,000 entries are ranked, and a falling share of more
(``share_for``). Pass a lower share where vectors gather.

Defined results: vectors that are null, zero, hold null or a value that is not
finite, or have another length than most, take no part; neither do null ids.
A repeated row counts once; one id with several vectors has several entries.
Fewer candidates than asked for give fewer rows; an empty table gives none.
"""

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from themeloom.plans.staging import staged

NEAREST = 20
SAMPLE = 20_000
ITERATIONS = 12
SEED = 11

# Centroids of a half for one entry, and how they grow with the number of entries.
CENTROIDS = 24
GROWTH = 0.1

# Share of the entries that a query ranks, and how it falls with their number.
SHARE = 0.95
FALL = 0.06

# Entries or queries of a block, queries of a block ranked at once and probed by a task, and
# blocks merged at a time.
BLOCK = 8192
RANKED_AT_ONCE = 256
PROBED = 128
FAN_IN = 64


def centroids_for(n: int) -> int:
    """Centroids of each half of ``n`` entries."""
    return max(1, round(CENTROIDS * n**GROWTH))


def share_for(n: int) -> float:
    """Share of ``n`` entries that a query ranks."""
    return min(1.0, SHARE * n**-FALL)


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, vec array<double>`` of the rows that take part."""
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("vec", lambda x: x != 0)
    clean = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("vec"),
    ).where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & ~bad & some)
    sizes = clean.groupBy(F.size("vec").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    most = sizes.orderBy(F.desc("rows"), "n").first()
    # -0.0 and 0.0 are one number, also as part of a key.
    plain = clean.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))
    return plain.where(F.size("vec") == (most.n if most else 0))


def entries(rows: DataFrame, nearest: int) -> DataFrame:
    """``entry, vec, ids``: different vectors, each with its smallest ids."""
    at_vector = W.partitionBy("vec").orderBy("vec_id")
    ranked = rows.distinct().withColumn("_rank", F.row_number().over(at_vector))
    kept = ranked.where(F.col("_rank") <= nearest + 1)
    grouped = kept.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return grouped.select(F.xxhash64("vec").alias("entry"), "vec", "ids")


def centroids(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """K-means of a bounded sample, started from points far from each other."""
    rng = np.random.default_rng(seed)
    k = min(k, len(points))
    chosen = [points[rng.integers(len(points))]]
    away = ((points - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < k:
        total = away.sum()
        odds = away / total if total > 0 else None
        chosen.append(points[rng.choice(len(points), p=odds)])
        away = np.minimum(away, ((points - chosen[-1]) ** 2).sum(axis=1))
    found = np.array(chosen)
    for _ in range(ITERATIONS):
        of = _nearest(points, found)
        sums = np.zeros_like(found)
        np.add.at(sums, of, points)
        counts = np.bincount(of, minlength=len(found))
        found = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], found)
    return found


def _nearest(points: np.ndarray, found: np.ndarray) -> np.ndarray:
    away = (found**2).sum(axis=1) - 2 * points @ found.T
    return away.argmin(axis=1)


class Index:
    """Centroids of both halves, and how many entries each cell holds."""

    def __init__(self, left: np.ndarray, right: np.ndarray) -> None:
        self.left, self.right = left, right
        self.sizes = np.zeros((len(left), len(right)), np.int64)
        self.first_block = np.zeros(len(left), np.int64)
        self.n_blocks = np.ones(len(left), np.int64)
        self.lefts: list[list[int]] = []

    @property
    def half(self) -> int:
        return self.left.shape[1]

    def cells(self, vecs: np.ndarray) -> np.ndarray:
        a = _nearest(vecs[:, : self.half], self.left)
        b = _nearest(vecs[:, self.half :], self.right)
        return a * len(self.right) + b

    def deal(self) -> None:
        """Deal the rows of cells into blocks: small ones together, large ones split.

        ``lefts`` has the left centroids of each block.
        """
        self.lefts, held = [], 0
        for i, n in enumerate(self.sizes.sum(axis=1).tolist()):
            parts = max(1, -(-n // BLOCK))
            if self.lefts and parts == 1 and held + n <= BLOCK:
                self.lefts[-1].append(i)
                held += n
            else:
                self.lefts += [[i] for _ in range(parts)]
                held = n if parts == 1 else BLOCK
            self.first_block[i] = len(self.lefts) - parts
            self.n_blocks[i] = parts

    def block(self, cells: np.ndarray, entries_: np.ndarray) -> np.ndarray:
        left = cells // len(self.right)
        return self.first_block[left] + entries_ % self.n_blocks[left]

    def probe(self, vec: np.ndarray, candidates: float) -> np.ndarray:
        """Which cells to rank, as a matrix of left by right centroids.

        Cells come by summed nearness, until they hold ``candidates`` entries.
        """
        a, b = self.left @ vec[: self.half], self.right @ vec[self.half :]
        by_a, by_b = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        # Farness from the nearest pair, which stands first.
        a, b = (a[by_a[0]] - a[by_a]).tolist(), (b[by_b[0]] - b[by_b]).tolist()
        sizes = self.sizes[by_a][:, by_b].ravel().tolist()
        rows, columns = len(a), len(b)
        heap, held, ranked = [(0.0, 0)], 0, []
        pop, push = heapq.heappop, heapq.heappush
        while heap and held < candidates:
            _, pair = pop(heap)
            ranked.append(pair)
            held += sizes[pair]
            i, j = divmod(pair, columns)
            # Each pair has one parent: down a column from its top, else along a row.
            if not j and i + 1 < rows:
                push(heap, (a[i + 1], pair + columns))
            if j + 1 < columns:
                push(heap, (a[i] + b[j + 1], pair + 1))
        wanted = np.zeros(self.sizes.shape, bool)
        found = np.array(ranked, np.int64)
        wanted[by_a[found // columns], by_b[found % columns]] = True
        return wanted


def build_index(table: DataFrame, n: int) -> Index:
    """Fit the centroids for ``n`` entries on the bounded sample."""
    rows = table.orderBy("entry").select("vec").limit(SAMPLE).collect()
    points = np.array([row.vec for row in rows], np.float64)
    half = points.shape[1] // 2
    k = centroids_for(n)
    return Index(
        centroids(points[:, :half], k, SEED), centroids(points[:, half:], k, SEED + 1)
    )


def exact_products(query: np.ndarray, vecs: np.ndarray) -> np.ndarray:
    """Inner products, added up from the first component to the last."""
    return np.cumsum(vecs * query, axis=1)[:, -1]


def _best(
    queries: np.ndarray, vecs: np.ndarray, bits: np.ndarray, place: np.ndarray, firsts: np.ndarray, n: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Scores and places of the best ``n`` wanted entries of each query.

    ``bits`` has the wanted cells of each query, ``place`` the cell of each entry.
    """
    for begin in range(0, len(queries), RANKED_AT_ONCE):
        some = queries[begin : begin + RANKED_AT_ONCE]
        cells = np.unpackbits(bits[begin : begin + RANKED_AT_ONCE], axis=1)
        rough = np.where(cells[:, place].astype(bool), some @ vecs.T, -np.inf)
        # A few more than asked for, as the last digits may differ from the exact ones.
        most = min(n + 4, rough.shape[1])
        places = np.argpartition(-rough, most - 1, axis=1)[:, :most]
        for query, own, row in zip(some, places, rough):
            own = own[row[own] > -np.inf]
            scores = exact_products(query, vecs[own]) if len(own) else np.empty(0)
            order = np.lexsort((firsts[own], -scores))[:n]
            yield scores[order], own[order]


def search(
    vectors: DataFrame, every: int = 20, nearest: int = NEAREST, share: float | None = None
) -> DataFrame:
    """``query_id, rank, vec_id, score`` for ids divisible by ``every``."""
    spark = vectors.sparkSession
    most = nearest + 1  # one of them may be the query itself
    rows = staged(usable(vectors), "vectors")
    table = staged(entries(rows, nearest), "vector-entries")
    n = table.count()
    if n == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = build_index(table, n)
    # Never fewer than can be returned.
    candidates = max(most, (share_for(n) if share is None else share) * n)
    fitted = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(cell=fitted.value.cells(np.array(batch.vec.tolist())))

    entry_schema = "entry long, vec array<double>, ids array<long>, cell long"
    placed = staged(table.mapInPandas(assign, entry_schema), "placed-entries")
    # One count per cell that is not empty.
    for row in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
        index.sizes[row.cell // len(index.right), row.cell % len(index.right)] = row.n
    index.deal()
    dealt = spark.sparkContext.broadcast(index)

    asked = rows.where(F.col("vec_id") % every == 0).distinct()
    asking = staged(asked.select(F.xxhash64("vec").alias("query"), "vec").distinct(), "queries")
    n_queries = asking.count()
    query_blocks = -(-n_queries // BLOCK)
    asking = asking.repartition(-(-n_queries // PROBED) or 1, "query")

    def to_block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                block = dealt.value.block(batch.cell.to_numpy(), batch.entry.to_numpy())
                yield batch.assign(block=block)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan = dealt.value
        for batch in batches:
            for query, vec in zip(batch["query"], batch.vec):
                wanted = plan.probe(np.array(vec), candidates)
                cells = [np.packbits(wanted[own]).tobytes() for own in plan.lefts]
                met = [b for b, own in enumerate(plan.lefts) if wanted[own].any()]
                yield pd.DataFrame(
                    {
                        "block": met,
                        "query_block": query % query_blocks,
                        "query": query,
                        "vec": [vec] * len(met),
                        "cells": [cells[b] for b in met],
                    }
                )

    # Entries go to each block of queries; there are few of those.
    numbers = [F.lit(i).cast("long") for i in (0, max(query_blocks, 1) - 1)]
    copies = F.explode(F.sequence(*numbers))
    left = placed.mapInPandas(to_block, f"{entry_schema}, block long")
    left = left.withColumn("query_block", copies)
    probe_schema = "block long, query_block long, query long, vec array<double>, cells binary"
    right = asking.mapInPandas(probe, probe_schema)

    def rank(key: tuple, some: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = {"block": [], "query": [], "found": []}
        if len(some) and len(queries):
            plan = dealt.value
            own, width = plan.lefts[key[0]], len(plan.right)
            vecs, firsts = np.array(some.vec.tolist()), np.array([ids[0] for ids in some.ids])
            cells = some.cell.to_numpy()
            place = np.searchsorted(own, cells // width) * width + cells % width
            bits = np.frombuffer(b"".join(queries.cells), np.uint8).reshape(len(queries), -1)
            lists = _best(np.array(queries.vec.tolist()), vecs, bits, place, firsts, most)
            for query, (scores, at) in zip(queries["query"], lists):
                found["block"].append(key[0])
                found["query"].append(query)
                found["found"].append(
                    [
                        {"minus": -float(score), "first_id": firsts[i], "ids": some.ids.iloc[i]}
                        for score, i in zip(scores, at)
                    ]
                )
        return pd.DataFrame(found)

    element = "struct<minus: double, first_id: bigint, ids: array<bigint>>"
    lists = (
        left.groupBy("block", "query_block")
        .cogroup(right.groupBy("block", "query_block"))
        .applyInPandas(rank, f"block long, query long, found array<{element}>")
    )
    left_over = len(index.lefts)
    while left_over > 0:
        left_over = 0 if left_over <= FAN_IN else -(-left_over // FAN_IN)
        lists = lists.groupBy("query", F.floor(F.col("block") / FAN_IN).alias("block")).agg(
            F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, most).alias("found")
        )
    # All ids of the best entries, nearest first: at most ``most`` squared.
    each = F.flatten(
        F.transform(
            "found",
            lambda f: F.transform(
                f["ids"], lambda i: F.struct(f["minus"].alias("minus"), i.alias("id"))
            ),
        )
    )
    lists = lists.select("query", F.slice(F.array_sort(each), 1, most).alias("found"))
    queries = asked.select(F.col("vec_id").alias("query_id"), F.xxhash64("vec").alias("query"))
    others = F.filter("found", lambda f: f["id"] != F.col("query_id"))
    out = queries.join(lists, "query").select(
        "query_id", F.posexplode(F.slice(others, 1, nearest)).alias("_at", "f")
    )
    return out.select(
        "query_id",
        (F.col("_at") + 1).cast("int").alias("rank"),
        F.col("f.id").alias("vec_id"),
        (-F.col("f.minus")).alias("score"),
    )


def op2_inverted_multi_index(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
