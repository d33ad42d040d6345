"""Projections, the truncated SVD, and the conversions they need."""

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.functions import arrays
from themeloom.operators import products, wide

# Fixed value: how many singular values or components are kept.
RANK = 10


def row_matrix(table: DataFrame, width: int = 0, features: str = "features") -> RowMatrix:
    """A distributed matrix of an ML vector column; a known width saves a job.

    It sums one partial matrix per partition, so the partitions are joined
    down to one per core first: half a million partial results of a few MB
    would be a shuffle, and a driver load, of their own.
    """
    rows = MLUtils.convertVectorColumnsFromML(table.select(features), features)
    cores = table.sparkSession.sparkContext.defaultParallelism
    return RowMatrix(rows.coalesce(cores), numCols=width)


def orient(columns: np.ndarray) -> np.ndarray:
    """Flip columns so that the entry of largest magnitude is positive."""
    largest = np.abs(columns).argmax(axis=0)
    signs = np.sign(columns[largest, np.arange(columns.shape[1])])
    return columns * np.where(signs == 0, 1.0, signs)


@dataclass(frozen=True)
class TruncatedSVD:
    """Singular values, largest first, and right singular vectors as columns.

    ``residual`` is what the solver ``randomised`` leaves open.
    """

    values: np.ndarray
    basis: np.ndarray
    residual: float = 0.0

    def values_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, float(s)) for i, s in enumerate(self.values)]
        return spark.createDataFrame(rows, "component int, singular_value double")


def truncated_svd(
    table: DataFrame, width: int, k: int = RANK, solver: str = "gram"
) -> TruncatedSVD:
    """Rank ``k`` SVD of the ``features`` of all rows, ``width`` columns wide.

    The solver ``gram`` adds up the Gram matrix in one pass, whose eigenvectors
    are the basis; the driver holds width times width numbers. ``iterative``
    is Spark's own, for wide matrices: it passes over the data many times and
    never holds the Gram matrix. ``randomised`` takes whole blocks of vectors
    at a time and so a few passes; see ``wide``. All square the values, so that
    those below the root of ``width`` rounding errors are noise and left out.
    """
    residual = 0.0
    if solver == "randomised":
        squares, basis, residual = wide.leading_eigenvectors(table, width, k)
        values = np.sqrt(np.maximum(squares, 0.0))
    elif solver == "iterative":
        svd = row_matrix(table, width).computeSVD(k)
        values, basis = svd.s.toArray(), svd.V.toArray()
    elif solver == "gram":
        gram = row_matrix(table, width).computeGramianMatrix()
        squares, vectors = np.linalg.eigh(gram.toArray())
        top = np.argsort(squares)[::-1][:k]
        values, basis = np.sqrt(np.maximum(squares[top], 0.0)), vectors[:, top]
    else:
        raise ValueError(f"no such solver: {solver}")
    noise = np.sqrt(width * np.finfo(float).eps)
    rank = int((values > values[0] * noise).sum()) if len(values) and values[0] > 0 else 0
    return TruncatedSVD(values[:rank], orient(basis[:, :rank]), residual)


def basis_table(spark: SparkSession, basis: np.ndarray) -> DataFrame:
    """``term_id, loadings``: one row per row of the basis."""
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(basis)]
    return spark.createDataFrame(rows, "term_id int, loadings array<double>")


def project(weighted: DataFrame, basis: DataFrame, width: int, k: int) -> DataFrame:
    """Project the ``features`` of all rows on a basis: ``docid, projection array<double>``.

    The basis, ``term_id, loadings``, has at most ``width`` rows of ``k``
    loadings; terms it lacks count as zero. It is multiplied with batches of
    articles, so nothing is shuffled. A basis too large to send to every
    executor is joined instead.
    """
    if not products.fits(width, k):
        return project_by_join(weighted, basis, k)
    dense = products.matrix_of(basis.collect(), "term_id", "loadings", (width, k))
    return products.times(weighted, dense, out="projection")


def project_by_join(weighted: DataFrame, basis: DataFrame, k: int) -> DataFrame:
    """The same for a basis of any size: one row per entry of an article."""
    entry = F.explode_outer(arrays.entries(F.col("features"))).alias("entry")
    rows = weighted.select("docid", entry).select("docid", "entry.*")
    found = rows.join(basis, "term_id", "left")
    sums = [F.expr(f"coalesce(sum(value * get(loadings, {i})), 0D) AS c{i}") for i in range(k)]
    projected = found.groupBy("docid").agg(*sums)
    return projected.select("docid", F.array(*[f"c{i}" for i in range(k)]).alias("projection"))


def long_form(table: DataFrame, vector: str, pos: str = "pos", value: str = "value") -> DataFrame:
    """``docid, pos, value`` of an array column."""
    return table.select("docid", F.posexplode(vector).alias(pos, value))


def as_features(vector: str | Column) -> Column:
    """ML vector of an array column."""
    return array_to_vector(vector)


def summarise(table: DataFrame, vector: str) -> DataFrame:
    """Statistics of each column of an array column, one row per column."""
    x = F.col("value")
    return (
        long_form(table, vector, "component")
        .groupBy("component")
        .agg(
            F.count(x).alias("count"),
            F.avg(x).alias("mean"),
            F.var_samp(x).alias("variance"),
            F.min(x).alias("min"),
            F.max(x).alias("max"),
            F.sum((x != 0).cast("long")).alias("nonzeros"),
            F.sum(F.abs(x)).alias("norm_l1"),
            F.sqrt(F.sum(x * x)).alias("norm_l2"),
        )
    )


def nonzero_rows(table: DataFrame, vector: str = "vec") -> DataFrame:
    return table.where(arrays.is_nonzero(F.col(vector)))
