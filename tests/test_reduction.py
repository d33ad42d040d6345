import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from themeloom.functions import arrays
from themeloom.operators import matrix, reduce


def _table(spark, rows, column="vec"):
    data = [(i, [float(x) for x in row]) for i, row in enumerate(rows)]
    return spark.createDataFrame(data, f"docid int, {column} array<double>").repartition(3)


def _features(table):
    return table.select("docid", matrix.as_features("vec").alias("features"))


@pytest.fixture
def noise():
    rng = np.random.default_rng(5)
    return rng.normal(size=(60, 12)) @ rng.normal(size=(12, 12))


def _rows(table, column="projection"):
    return np.array([r[column] for r in table.orderBy("docid").collect()])


def test_known_singular_values(spark):
    rows = [(1, 2, 0), (0, 1, 3), (2, 0, 1), (1, 1, 1)]
    svd = matrix.truncated_svd(_features(_table(spark, rows)), 3, 2)
    assert svd.values == pytest.approx([3.882602, 2.246506], abs=1e-6)
    assert svd.basis.T @ svd.basis == pytest.approx(np.eye(2), abs=1e-12)


def test_both_solvers_agree_with_numpy(spark, noise):
    table = _features(_table(spark, noise))
    one = matrix.truncated_svd(table, 12, 4)
    other = matrix.truncated_svd(table, 12, 4, solver="iterative")
    u, s, vt = np.linalg.svd(noise, full_matrices=False)
    for svd in (one, other):
        assert svd.values == pytest.approx(s[:4], rel=1e-9)
        assert svd.basis == pytest.approx(matrix.orient(vt[:4].T), abs=1e-8)


@pytest.mark.parametrize("solver", ["gram", "iterative"])
def test_no_component_is_made_of_noise(spark, solver):
    rng = np.random.default_rng(5)
    low = rng.normal(size=(120, 3)) @ rng.normal(size=(3, 50))
    svd = matrix.truncated_svd(_features(_table(spark, low.tolist())), 50, 10, solver)
    assert len(svd.values) == 3


def test_rank_is_no_more_than_there_is(spark):
    svd = matrix.truncated_svd(_features(_table(spark, [(1, 1), (2, 2)])), 2, 2)
    assert len(svd.values) == 1 and svd.basis.shape == (2, 1)


def test_projection_keeps_ids_and_empty_rows(spark, noise):
    rows = [(i, Vectors.dense(row)) for i, row in enumerate(noise)] + [(60, Vectors.sparse(12, [], []))]
    table = spark.createDataFrame(rows, ["docid", "features"]).repartition(4)
    basis = np.linalg.svd(noise, full_matrices=False)[2][:3].T
    got = matrix.project(table, matrix.basis_table(spark, basis), 12, 3)
    values = _rows(got)
    assert values[:60] == pytest.approx(noise @ basis, abs=1e-9)
    assert list(values[60]) == [0.0, 0.0, 0.0]
    norms = (values**2).sum(axis=0)
    assert norms == pytest.approx(np.linalg.svd(noise)[1][:3] ** 2)


def test_standardise_uses_the_sample_deviation(spark):
    table = _table(spark, [(1, 10, 7), (2, 20, 7), (4, 25, 7)])
    scaler = reduce.fit_scaler(table)
    assert list(scaler.std) == pytest.approx([1.527525, 7.637626, 0.0], abs=1e-6)
    z = reduce.standardise(table).select("docid", vector_to_array("features").alias("z"))
    values = _rows(z, "z")
    assert values[:, :2].std(axis=0, ddof=1) == pytest.approx([1, 1])
    assert list(values[:, 2]) == [0.0, 0.0, 0.0]


def test_principal_components_agree_with_numpy(spark, noise):
    z = (noise - noise.mean(axis=0)) / noise.std(axis=0, ddof=1)
    table = reduce.standardise(_table(spark, noise))
    components = reduce.principal_components(table, 4)
    wanted = matrix.orient(np.linalg.svd(z, full_matrices=False)[2][:4].T)
    assert components.loadings == pytest.approx(wanted, abs=1e-8)
    values = _rows(components.project(table))
    assert values == pytest.approx(z @ wanted, abs=1e-8)
    cov = np.cov(values.T)
    assert cov - np.diag(np.diag(cov)) == pytest.approx(np.zeros((4, 4)), abs=1e-8)


def test_covariance(spark, noise):
    cov = np.cov(noise.T)
    got = {(r.i, r.j): r.cov for r in reduce.covariance(_table(spark, noise)).collect()}
    assert len(got) == 12 * 13 // 2
    assert all(x == pytest.approx(cov[i, j], abs=1e-9) for (i, j), x in got.items())


def test_column_summary(spark, noise):
    got = matrix.summarise(_table(spark, noise), "vec").orderBy("component").collect()
    assert [r["count"] for r in got] == [60] * 12
    assert [r["mean"] for r in got] == pytest.approx(noise.mean(axis=0))
    assert [r.variance for r in got] == pytest.approx(noise.var(axis=0, ddof=1))
    assert [r.norm_l1 for r in got] == pytest.approx(np.abs(noise).sum(axis=0))
    assert [r.norm_l2 for r in got] == pytest.approx(np.sqrt((noise**2).sum(axis=0)))


def test_array_arithmetic(spark):
    table = spark.createDataFrame([([1.0, -2.0], [3.0, 5.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    row = table.select(
        arrays.add(a, b).alias("add"),
        arrays.scale(F.lit(3.0), a).alias("scale"),
        arrays.stack(a, b).alias("stack"),
        arrays.zeros(3).alias("zeros"),
        arrays.l1_norm(a).alias("l1"),
        arrays.squared_distance(a, b).alias("far"),
        arrays.is_nonzero(arrays.zeros(2)).alias("some"),
    ).first()
    assert tuple(row) == (
        [4.0, 3.0], [3.0, -6.0], [1.0, -2.0, 3.0, 5.0], [0.0] * 3, 3.0, 53.0, False,
    )


def test_entries_of_dense_and_sparse_vectors(spark):
    rows = [(1, Vectors.sparse(4, [1, 3], [2.0, 0.0])), (2, Vectors.dense(0.0, 5.0)), (3, Vectors.sparse(2, [], []))]
    table = spark.createDataFrame(rows, ["docid", "v"])
    got = {r.docid: [tuple(e) for e in r.e] for r in table.select("docid", arrays.entries(F.col("v")).alias("e")).collect()}
    assert got == {1: [(1, 2.0), (3, 0.0)], 2: [(1, 5.0)], 3: []}


def test_only_small_tables_are_broadcast(spark):
    table, other = spark.range(10), spark.range(20)
    from themeloom.operators import sizes

    def plan(rows, per_row):
        return other.join(sizes.small(table, rows, per_row), "id")._jdf.queryExecution().logical().toString()

    assert "broadcast" in plan(1000, 100)
    assert "broadcast" not in plan(sizes.BROADCAST_NUMBERS, 2)
