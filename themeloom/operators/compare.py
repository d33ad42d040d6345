"""How far two groupings of the same articles agree."""

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    """``cluster_a, cluster_b, n``, articles in both; inputs are ``docid, cluster``."""
    left = a.select("docid", F.col("cluster").alias("cluster_a"))
    right = b.select("docid", F.col("cluster").alias("cluster_b"))
    return (
        left.join(right, "docid")
        .groupBy("cluster_a", "cluster_b")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _pairs(n: Column) -> Column:
    n = n.cast("double")
    return n * (n - 1) / 2


def agreement(table: DataFrame) -> DataFrame:
    """One row out of a contingency table.

    ``n``, ``purity_a`` (articles of each cluster of a that share its most
    common cluster of b), ``purity_b``, and ``adjusted_rand``. The sums work
    on counts of cluster pairs; no pair of articles is formed. The windows run
    over the table's few rows, not over articles.
    """
    of_a, of_b = W.partitionBy("cluster_a"), W.partitionBy("cluster_b")
    once_a = F.row_number().over(of_a.orderBy("cluster_b")) == 1
    once_b = F.row_number().over(of_b.orderBy("cluster_a")) == 1
    rows = table.select(
        "n",
        F.when(once_a, F.sum("n").over(of_a)).alias("size_a"),
        F.when(once_b, F.sum("n").over(of_b)).alias("size_b"),
        F.when(once_a, F.max("n").over(of_a)).alias("top_a"),
        F.when(once_b, F.max("n").over(of_b)).alias("top_b"),
    )
    sums = rows.agg(
        F.sum("n").alias("n"),
        F.sum(_pairs(F.col("n"))).alias("both"),
        F.sum(_pairs(F.col("size_a"))).alias("pa"),
        F.sum(_pairs(F.col("size_b"))).alias("pb"),
        F.sum("top_a").alias("ta"),
        F.sum("top_b").alias("tb"),
    )
    n, both, pa, pb = (F.col(c) for c in ("n", "both", "pa", "pb"))
    expected = F.try_divide(pa * pb, _pairs(n))
    most = (pa + pb) / 2
    rand = F.coalesce(F.try_divide(both - expected, most - expected), F.lit(1.0))
    return sums.select(
        "n",
        F.try_divide(F.col("ta"), n).alias("purity_a"),
        F.try_divide(F.col("tb"), n).alias("purity_b"),
        rand.alias("adjusted_rand"),
    )


def silhouette(labelled: DataFrame, features: str = "features") -> float:
    """Mean silhouette of a table with an ML vector and ``cluster``."""
    scorer = ClusteringEvaluator(featuresCol=features, predictionCol="cluster")
    return scorer.evaluate(labelled)
