"""Declared schemas. Nothing in this package infers a schema from the data."""

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType(), True) for name in names])


# Fields of one article record, all text until they are cast.
DECLARED_ARTICLE = _strings("docid", "source", "url", "title", "summary", "text", "date")

LEMMA_TABLE = _strings("form", "lemma")

WORD_VECTORS = T.StructType(
    [
        T.StructField("word", T.StringType(), True),
        T.StructField("vector", T.ArrayType(T.FloatType(), True), True),
    ]
)

TERM_TABLE = T.StructType(
    [
        T.StructField("term_id", T.IntegerType(), False),
        T.StructField("term", T.StringType(), False),
        T.StructField("df", T.LongType(), False),
        T.StructField("idf", T.DoubleType(), False),
    ]
)

CENTRES = T.StructType(
    [
        T.StructField("cluster", T.IntegerType(), False),
        T.StructField("pos", T.IntegerType(), False),
        T.StructField("value", T.DoubleType(), False),
    ]
)

SAVED_THEMES = T.StructType(
    [
        T.StructField("cluster", T.IntegerType(), False),
        T.StructField("centre", T.ArrayType(T.DoubleType()), False),
        T.StructField("cost", T.DoubleType(), False),
    ]
)
