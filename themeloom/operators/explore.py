"""Simple questions about a table of articles."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def publications_in_month(articles: DataFrame, month: int) -> DataFrame:
    """One row per article of that month, in any year."""
    return articles.where(F.col("month") == month).select("publication")


def articles_of_year(articles: DataFrame, year: int) -> DataFrame:
    return articles.where(F.col("year") == year)


def counts_by_publication(articles: DataFrame) -> DataFrame:
    return articles.groupBy("publication").agg(F.count(F.lit(1)).alias("n"))


def row_count(table: DataFrame) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("n"))


def describe(table: DataFrame) -> DataFrame:
    """Count, mean, deviation, smallest and largest of every column, as text."""
    return table.describe()


def describe_columns(table: DataFrame, columns: Sequence[str], numeric: bool = True) -> DataFrame:
    """The same figures with proper types, one row per column, in one pass.

    Text columns (``numeric=False``) have no mean and no deviation.
    """

    def figures(name: str):
        c = F.col(name)
        parts = [F.lit(name).alias("column"), F.count(c).alias("count")]
        if numeric:
            c = c.cast("double")
            parts += [F.avg(c).alias("mean"), F.stddev_samp(c).alias("stddev")]
        return F.struct(*parts, F.min(c).alias("min"), F.max(c).alias("max"))

    return table.agg(F.array(*[figures(c) for c in columns]).alias("rows")).select(F.inline("rows"))


def preview(articles: DataFrame, n: int = 5) -> DataFrame:
    return articles.orderBy("docid").limit(n)


def schema_table(table: DataFrame) -> DataFrame:
    """Column names and types of a table, as data."""
    rows = [(f.name, f.dataType.simpleString()) for f in table.schema.fields]
    return table.sparkSession.createDataFrame(rows, "col_name string, data_type string")
