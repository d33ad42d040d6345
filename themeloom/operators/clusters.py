"""K-means themes, and what describes them."""

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import Normalizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from themeloom import schemas, sinks
from themeloom.functions import arrays
from themeloom.operators import kmeans, products
from themeloom.operators.sizes import small
from themeloom.plans.staging import release, staged

# Settings of the fit and lengths of the lists.
CLUSTERS = 10
MAX_ITERATIONS = 1000
SEED = 0
TOP_TERMS = 10
NEAREST_ARTICLES = 10
TERMS_PER_ARTICLE = 5


@dataclass(frozen=True)
class Themes:
    """Centres of a K-means fit as rows, with stable numbers, and the cost of the fit.

    Cluster 0 is the largest; equal sizes are ordered by smallest docid.
    """

    matrix: np.ndarray
    cost: float = 0.0

    def assign(
        self, table: DataFrame, keep_features: bool = False, features: str = "features"
    ) -> DataFrame:
        """The table with ``cluster``, the nearest centre, in place of its features."""
        norms = (self.matrix * self.matrix).sum(axis=1)
        carried = [c for c in table.columns if keep_features or c != features]
        found = products.times(
            table, self.matrix.T, features, "_near", carried, after=lambda p: norms - 2 * p
        )
        cluster = F.array_position("_near", F.array_min("_near")) - 1
        return found.select(*carried, cluster.cast("int").alias("cluster"))

    def centres(self, spark: SparkSession) -> DataFrame:
        """``cluster, pos, value``, clusters times columns rows."""
        rows = [
            (cluster, pos, float(x))
            for cluster, own in enumerate(self.matrix)
            for pos, x in enumerate(own)
        ]
        return spark.createDataFrame(rows, schemas.CENTRES)

    def save(self, spark: SparkSession, path: str) -> None:
        """One row per cluster, over whatever is there."""
        rows = [(c, [float(x) for x in own], self.cost) for c, own in enumerate(self.matrix)]
        sinks.write_table(spark.createDataFrame(rows, schemas.SAVED_THEMES), path)


def load_themes(spark: SparkSession, path: str) -> Themes:
    rows = spark.read.schema(schemas.SAVED_THEMES).parquet(path).orderBy("cluster").collect()
    return Themes(np.array([row.centre for row in rows]), rows[0].cost)


def fit_themes(
    table: DataFrame,
    k: int = CLUSTERS,
    max_iterations: int = MAX_ITERATIONS,
    seed: int = SEED,
    runs: int = 1,
    features: str = "features",
    normalise: bool = False,
) -> Themes:
    """K-means on an ML vector column of a table keyed by docid.

    One run is the default; with more, the cheapest of several seeds is kept.
    The rows are written out once and read by every pass. Equal rows give
    equal themes, in whatever order and number of partitions they come.
    """
    rows = table.select("docid", features)
    if normalise:
        rows = unit_length(rows, features)
    rows = staged(rows, "rows-to-cluster")
    prepared = kmeans.rows_of(rows, features)
    fits = [kmeans.fit(prepared, k, max_iterations, s) for s in range(seed, seed + runs)]
    centres, cost = min(fits, key=lambda fit: fit[1])
    sizes = (
        Themes(centres)
        .assign(rows, features=features)
        .groupBy("cluster")
        .agg(F.count(F.lit(1)).alias("n"), F.min("docid").alias("first"))
        .collect()
    )
    release(rows)
    release(prepared.packed)
    seen = [r.cluster for r in sorted(sizes, key=lambda r: (-r.n, r.first))]
    unseen = [i for i in range(len(centres)) if i not in seen]
    return Themes(centres[seen + unseen], cost)


def unit_length(table: DataFrame, features: str) -> DataFrame:
    scaled = Normalizer(p=2.0, inputCol=features, outputCol="unit").transform(table)
    return scaled.drop(features).withColumnRenamed("unit", features)


def mean_centres(table: DataFrame, labels: DataFrame, numbered: Column) -> DataFrame:
    """Centres of given labels: ``cluster, pos, value``.

    ``numbered`` holds an article's entries as ``array<struct<pos, value>>``;
    an absent entry counts as zero. An article meets its label before its
    entries are laid out, and these are then added up per task first, so a
    large cluster is no large group.
    """
    labelled = table.select("docid", numbered.alias("entries")).join(labels, "docid")
    rows = labelled.select("cluster", F.explode_outer("entries").alias("entry"))
    rows = rows.where(F.col("entry").isNotNull()).select("cluster", "entry.*")
    sums = rows.toDF("cluster", "pos", "value").groupBy("cluster", "pos")
    sizes = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return sums.agg(F.sum("value").alias("total")).join(sizes, "cluster").select(
        "cluster", "pos", (F.col("total") / F.col("n")).alias("value")
    )


def squared_distances(
    vectors: DataFrame,
    centres: DataFrame,
    clusters: Sequence[int],
    vector: str = "vec",
    width: int | None = None,
) -> DataFrame:
    """``docid, distances``: one squared distance per cluster, in one pass.

    ``clusters`` names the clusters, as a pivot names its values; one without
    a centre lies at zero. Centres of ``width`` positions, which is read from
    the first vector if it is not given, are held against batches of articles,
    so nothing is shuffled. Centres too large to send to every executor are
    joined instead.
    """
    if width is None:
        first = vectors.select(F.size(vector).alias("n")).first()
        width = first.n if first else 0
    if not products.fits(len(clusters), width):
        return squared_distances_by_join(vectors, centres, clusters, vector)
    given = centres.where(F.col("cluster").isin(list(clusters)) & (F.col("pos") < width))
    at = {cluster: nth for nth, cluster in enumerate(clusters)}
    dense = np.zeros((len(clusters), width))
    for row in given.collect():
        dense[at[row.cluster], row.pos] = row.value
    found = products.distances(vectors, dense, vector)
    pairs = [
        F.struct(F.lit(c).cast("int").alias("cluster"), F.get("far", i).alias("distance"))
        for i, c in enumerate(clusters)
    ]
    return found.select("docid", F.array(*pairs).alias("distances"))


def squared_distances_by_join(
    vectors: DataFrame, centres: DataFrame, clusters: Sequence[int], vector: str = "vec"
) -> DataFrame:
    """The same for centres of any size.

    The centres are turned so that one row holds a position's value in every
    cluster; each position of an article meets one row, and each cluster has
    its own sum.
    """
    value_in = [
        F.coalesce(F.max(F.when(F.col("cluster") == c, F.col("value"))), F.lit(0.0))
        for c in clusters
    ]
    turned = centres.groupBy("pos").agg(F.array(*value_in).alias("at"))
    points = vectors.select("docid", F.posexplode(vector).alias("pos", "x"))
    met = points.join(turned, "pos", "left").select(
        "docid", "x", F.coalesce("at", arrays.zeros(len(clusters))).alias("at")
    )

    offsets = [f"(x - get(at, {i}))" for i in range(len(clusters))]
    sums = [F.expr(f"sum({offset} * {offset}) AS d{i}") for i, offset in enumerate(offsets)]
    summed = met.groupBy("docid").agg(*sums)
    pairs = [
        F.struct(F.lit(c).cast("int").alias("cluster"), F.col(f"d{i}").alias("distance"))
        for i, c in enumerate(clusters)
    ]
    return summed.select("docid", F.array(*pairs).alias("distances"))


def assign(distances: DataFrame, digits: int | None = None) -> DataFrame:
    """``docid, cluster, distance`` of the nearest centre, ties by cluster.

    With ``digits``, distances are compared after rounding, so that ties do not
    depend on the order in which an engine sums.
    """
    keyed = F.transform(
        "distances",
        lambda d: F.struct(
            arrays.rounded(d.getField("distance"), digits).alias("key"),
            d.getField("cluster").alias("cluster"),
            d.getField("distance").alias("distance"),
        ),
    )
    nearest = distances.select("docid", F.array_min(keyed).alias("nearest"))
    return nearest.select("docid", "nearest.cluster", "nearest.distance")


def labelled_by_date(articles: DataFrame, labels: DataFrame) -> DataFrame:
    """``docid, date, cluster`` by date, undated articles first."""
    joined = articles.select("docid", "date").join(labels.select("docid", "cluster"), "docid")
    return by_date(joined)


def by_date(labelled: DataFrame) -> DataFrame:
    """The id splits days that hold very many articles."""
    return labelled.select("docid", "date", "cluster").orderBy(
        F.col("date").asc_nulls_first(), "docid"
    )


def top_terms(
    centres: DataFrame, terms: DataFrame, n: int = TOP_TERMS, digits: int | None = None
) -> DataFrame:
    """``cluster, rank, term, value``: highest terms of each centre.

    ``terms`` is a vocabulary's table. A cluster's window holds one row per
    term, and the join only the terms that were picked.
    """
    order = W.partitionBy("cluster").orderBy(arrays.rounded(F.col("value"), digits).desc(), "pos")
    ranked = centres.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    named = ranked.join(terms, F.col("pos") == F.col("term_id"))
    return named.select("cluster", "rank", "term", "value")


def nearest_articles(
    distances: DataFrame, n: int = NEAREST_ARTICLES, digits: int | None = None
) -> DataFrame:
    """``cluster, rank, docid, distance``: nearest articles of each centre.

    Every task keeps its own ``n`` best per cluster before anything is
    shuffled, so a cluster's window never sees all articles.
    """
    pairs = distances.select("docid", F.explode_outer("distances").alias("pair"))
    pairs = pairs.select("docid", "pair.cluster", "pair.distance")
    order = W.partitionBy("cluster").orderBy(
        arrays.rounded(F.col("distance"), digits), "docid"
    )
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return ranked.select("cluster", "rank", "docid", "distance")


def terms_of_articles(
    weighted: DataFrame,
    chosen: DataFrame,
    terms: DataFrame,
    most: int,
    n: int = TERMS_PER_ARTICLE,
    digits: int | None = None,
) -> DataFrame:
    """``docid, rank, term, weight``: highest terms of the chosen articles.

    ``weighted`` has one row per article with its ``features``; ``chosen``
    holds at most ``most`` rows (clusters times nearest articles). The terms
    are ranked inside the article's row.
    """
    ids = chosen.select("docid").distinct()
    best = arrays.largest(arrays.entries(F.col("features")), n, digits)
    rows = (
        weighted.join(small(ids, most), "docid", "left_semi")
        .select("docid", F.posexplode_outer(best).alias("at", "entry"))
        .where(F.col("entry").isNotNull())
    )
    return rows.select(
        "docid",
        (F.col("at") + 1).alias("rank"),
        F.col("entry.term_id").alias("term_id"),
        F.col("entry.value").alias("weight"),
    ).join(terms.select("term_id", "term"), "term_id").select(
        "docid", "rank", "term", "weight"
    )
