"""Standardised article vectors, their covariance and principal components."""

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler, StandardScalerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.operators.matrix import RANK, as_features, basis_table, orient, row_matrix


def fit_scaler(table: DataFrame, vector: str = "vec") -> StandardScalerModel:
    """Mean 0 and sample deviation 1 per column."""
    scaler = StandardScaler(
        withMean=True, withStd=True, inputCol="raw_features", outputCol="features"
    )
    return scaler.fit(table.select(as_features(vector).alias("raw_features")))


def standardise(
    table: DataFrame, vector: str = "vec", scaler: StandardScalerModel | None = None
) -> DataFrame:
    """The table with ``features``, the standardised vector.

    A column without any spread becomes 0.
    """
    scaler = scaler or fit_scaler(table, vector)
    raw = table.withColumn("raw_features", as_features(vector))
    return scaler.transform(raw).drop("raw_features")


def covariance(table: DataFrame, vector: str = "vec") -> DataFrame:
    """``i, j, cov`` for i <= j, over all rows of an array column.

    The matrix is as wide as one vector, so it fits the driver. The table is
    read more than once.
    """
    features = table.select(as_features(vector).alias("features"))
    cov = row_matrix(features).computeCovariance().toArray()
    n = cov.shape[0]
    rows = [(i, j, float(cov[i, j])) for i in range(n) for j in range(i, n)]
    return table.sparkSession.createDataFrame(rows, "i int, j int, cov double")


@dataclass(frozen=True)
class PrincipalComponents:
    """Loadings (columns) of standardised vectors and their shares of variance."""

    loadings: np.ndarray
    explained: np.ndarray
    fitted: object
    signs: np.ndarray

    def project(self, standardised: DataFrame) -> DataFrame:
        """``docid, projection``, computed inside the row."""
        signs = F.array(*[F.lit(float(s)) for s in self.signs])
        projected = vector_to_array("raw_projection")
        return self.fitted.transform(standardised).select(
            "docid", F.zip_with(projected, signs, lambda x, s: x * s).alias("projection")
        )

    def table(self, spark) -> DataFrame:
        return basis_table(spark, self.loadings)


def principal_components(standardised: DataFrame, k: int = RANK) -> PrincipalComponents:
    """First ``k`` principal components of standardised vectors."""
    fitted = PCA(k=k, inputCol="features", outputCol="raw_projection").fit(
        standardised.select("features")
    )
    raw = fitted.pc.toArray()
    loadings = orient(raw)
    signs = np.where((loadings * raw).sum(axis=0) < 0, -1.0, 1.0)
    return PrincipalComponents(loadings, fitted.explainedVariance.toArray(), fitted, signs)
