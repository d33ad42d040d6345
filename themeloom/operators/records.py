"""Article records: id, date and one chosen field."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions.fields import date_field, int_field, string_field


def article_records(raw: DataFrame, field: str = "text", strict: bool = True) -> DataFrame:
    """``docid, date, body`` with ``field`` as the body.

    ``strict`` fails on an id that is no whole number and on an unreadable
    date; otherwise the article is left out, or has no date.
    """
    records = raw.select(
        int_field("docid", strict).alias("docid"),
        date_field("date", strict).alias("date"),
        string_field(field).alias("body"),
    )
    return records if strict else records.where(F.col("docid").isNotNull())


def titles(raw: DataFrame, strict: bool = True) -> DataFrame:
    return article_records(raw, "title", strict)


def summaries(raw: DataFrame, field: str = "summary", strict: bool = True) -> DataFrame:
    return article_records(raw, field, strict)


def without_date(records: DataFrame) -> DataFrame:
    return records.drop("date")
