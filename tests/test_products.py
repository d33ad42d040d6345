"""Batch products against brute force, and against the joins for large matrices."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from themeloom.operators import clusters, docvectors, matrix, products, weights
from themeloom.plans import catalogue


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    dense = rng.normal(size=(60, 9)) * (rng.random((60, 9)) < 0.4)
    dense[[3, 17]] = 0
    return dense


@pytest.fixture(scope="module")
def table(spark, rows):
    def vector(i, row):
        at = np.flatnonzero(row)
        return Vectors.dense(row) if i % 3 == 0 else Vectors.sparse(9, at.tolist(), row[at].tolist())

    made = [(i, vector(i, row), row.tolist()) for i, row in enumerate(rows)]
    return spark.createDataFrame(made, ["docid", "features", "vec"]).repartition(4)


def by_id(table, column):
    return {r.docid: r[column] for r in table.collect()}


def test_rows_times_a_matrix(table, rows):
    basis = np.random.default_rng(5).normal(size=(9, 4))
    got = by_id(products.times(table, basis), "product")
    assert np.allclose([got[i] for i in range(60)], rows @ basis)
    halved = products.times(table, basis, before=lambda x: x / 2, after=lambda p: p[:, :2])
    assert np.allclose([by_id(halved, "product")[i] for i in range(60)], (rows @ basis)[:, :2] / 2)


def test_a_row_does_not_depend_on_its_batch(monkeypatch, rows):
    basis = np.random.default_rng(6).normal(size=(9, 4))
    at, lengths = np.nonzero(rows)[1], (rows != 0).sum(axis=1)
    values = rows[rows != 0]
    whole = products.sums_by_row(at, values, lengths, basis)
    far = products.distances_by_row(rows.ravel(), np.full(60, 9), basis.T)
    monkeypatch.setattr(products, "AT_ONCE", 20)
    assert (products.sums_by_row(at, values, lengths, basis) == whole).all()
    assert (products.distances_by_row(rows.ravel(), np.full(60, 9), basis.T) == far).all()


def test_distances_of_arrays_of_any_length(spark):
    made = [(1, [3.0]), (2, []), (3, [1.0, 2.0, 2.0]), (4, None)]
    table = spark.createDataFrame(made, "docid long, vec array<double>")
    got = by_id(products.distances(table, np.array([[1.0, 2.0]])), "far")
    assert got == {1: [8.0], 2: [5.0], 3: [4.0]}


def test_empty_tables(spark, table):
    nothing = table.limit(0)
    assert products.times(nothing, np.ones((9, 2))).count() == 0
    assert products.distances(nothing, np.ones((1, 9))).count() == 0


def test_large_matrices_are_joined(spark, table, rows, monkeypatch):
    basis = np.random.default_rng(7).normal(size=(9, 3))
    loadings = matrix.basis_table(spark, basis)
    centres = clusters.mean_centres(
        table, table.select("docid", (F.col("docid") % 3).cast("int").alias("cluster")),
        F.transform("vec", lambda x, i: F.struct(i.alias("pos"), x.alias("value"))),
    )
    sent = (
        by_id(matrix.project(table, loadings, 9, 3), "projection"),
        by_id(clusters.squared_distances(table, centres, range(4)), "distances"),
    )
    monkeypatch.setattr(products, "BROADCAST_NUMBERS", 5)
    joined = (
        by_id(matrix.project(table, loadings, 9, 3), "projection"),
        by_id(clusters.squared_distances(table, centres, range(4)), "distances"),
    )
    for i in range(60):
        assert sent[0][i] == pytest.approx(joined[0][i])
        assert [d.distance for d in sent[1][i]] == pytest.approx([d.distance for d in joined[1][i]])


@pytest.mark.parametrize("weighting", ["tfidf", "binary"])
def test_article_vectors_both_ways(spark, three, weighting):
    cut = three.select("docid", F.split(F.lower("text"), r"\W+").alias("lemmas"))
    cut = cut.withColumn("lemmas", F.filter("lemmas", lambda w: w != ""))
    vocabulary = weights.build_vocabulary(cut, 10)
    counts = weights.term_matrix(cut, vocabulary)
    vectors = spark.createDataFrame(
        [(t, [float(t), 1.0]) for t in range(0, len(vocabulary.terms), 2)], "term_id int, vector array<double>"
    )
    ways = [
        by_id(way(counts, vocabulary, vectors, 2, weighting), "vec")
        for way in (docvectors.article_vectors, docvectors.article_vectors_by_join)
    ]
    assert ways[0].keys() == ways[1].keys()
    for i in ways[0]:
        assert ways[0][i] == pytest.approx(ways[1][i])
    with pytest.raises(ValueError):
        docvectors.article_vectors(counts, vocabulary, vectors, 2, "other")


@pytest.mark.parametrize("name", ["doc_vectors", "project_on_basis"])
def test_nothing_is_shuffled_after_the_matrix(spark, tables, name):
    """The one exchange spreads the small input over the cores."""
    plan = catalogue.__dict__[name](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and plan.count("Exchange") == 1


def test_distances_are_not_shuffled(spark, table):
    centres = spark.createDataFrame([(0, 0, 1.0)], "cluster int, pos int, value double")
    found = clusters.squared_distances(table, centres, range(1), width=9)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "RoundRobin" in plan
