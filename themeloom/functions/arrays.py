"""Arithmetic on ``array<double>`` columns, and entries of ML vectors."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(factor: Column, a: Column) -> Column:
    return F.transform(a, lambda x: factor * x)


def stack(a: Column, b: Column) -> Column:
    """``b`` behind ``a``."""
    return F.concat(a, b)


def zeros(n: int | Column) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def l1_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda total, x: total + F.abs(x))


def is_nonzero(a: Column) -> Column:
    return l1_norm(a) > 0


def squared_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(squares, F.lit(0.0), lambda total, x: total + x)


def numbered(a: Column) -> Column:
    """``array<struct<pos, value>>`` of an array."""
    return F.transform(a, lambda x, i: F.struct(i.alias("pos"), x.alias("value")))


def entries(vector: Column) -> Column:
    """Entries of an ML vector as ``array<struct<term_id, value>>``.

    A sparse vector gives the entries it stores, a dense one its non-zeros.
    """
    raw = F.unwrap_udt(vector)
    stored = F.zip_with(
        raw.getField("indices"),
        raw.getField("values"),
        lambda i, x: F.struct(i.alias("term_id"), x.alias("value")),
    )
    numbered = F.transform(
        raw.getField("values"), lambda x, i: F.struct(i.alias("term_id"), x.alias("value"))
    )
    nonzero = F.filter(numbered, lambda e: e.getField("value") != 0)
    return F.when(raw.getField("type") == 0, stored).otherwise(nonzero)


def rounded(value: Column, digits: int | None) -> Column:
    """The value itself, or rounded where results of two engines are compared."""
    return value if digits is None else F.round(value, digits)


def largest(entry_array: Column, n: int, digits: int | None = None) -> Column:
    """The ``n`` entries of largest value, ties by smaller id."""
    keyed = F.transform(
        entry_array,
        lambda e: F.struct(
            (-rounded(e.getField("value"), digits)).alias("key"),
            e.getField("term_id").alias("term_id"),
            e.getField("value").alias("value"),
        ),
    )
    return F.slice(F.sort_array(keyed), 1, n)
