"""Stop words and word vectors."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom import schemas


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """One word per line, each once."""
    return spark.read.text(path).select(F.col("value").alias("word")).distinct()


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Word vectors out of a saved Word2Vec model, widened to doubles."""
    saved = spark.read.schema(schemas.WORD_VECTORS).parquet(path.rstrip("/") + "/data")
    return saved.select("word", F.col("vector").cast("array<double>").alias("vector"))
