"""Connected components of a table of links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.plans.staging import release, staged


def _hooked(links: DataFrame) -> DataFrame:
    """``node, parent``: each node hooks to its smallest neighbour or itself, then twice up."""
    both = links.union(links.select("b", "a"))
    parents = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("nearest"))
    parents = staged(parents.select("node", F.least("node", "nearest").alias("parent")), "parents")
    up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("higher"))
    return parents.join(up, "parent").select("node", F.col("higher").alias("parent"))


def components(links: DataFrame) -> DataFrame:
    """``node, label`` of every linked node of ``a, b``; the label is a node of the component.

    Each round hooks nodes to their smallest neighbours, moves links up to the
    parents, and drops those that have become loops. The links shrink from
    round to round until none is left; every round is written to the shared
    folder, so a lost executor costs one round at most. All of it stays in
    tables.
    """
    edges = staged(links.where("a <> b").distinct(), "links")
    labels = None
    while not edges.isEmpty():
        parents = staged(_hooked(edges), "hooked")
        if labels is None:
            labels = parents.select("node", F.col("parent").alias("label"))
        else:
            up = parents.select(F.col("node").alias("label"), "parent")
            labels = labels.join(up, "label", "left").select(
                "node", F.coalesce("parent", "label").alias("label")
            )
            labels = staged(labels, "labels")
        ups = parents.select(F.col("node").alias("a"), F.col("parent").alias("top_a"))
        downs = parents.select(F.col("node").alias("b"), F.col("parent").alias("top_b"))
        moved = edges.join(ups, "a").join(downs, "b").where("top_a <> top_b")
        moved = moved.select(F.col("top_a").alias("a"), F.col("top_b").alias("b")).distinct()
        before, edges = edges, staged(moved, "links")
        release(before)
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
