"""Joins on keys that many rows share.

Rows carry ``slice``, the number of the task that wrote them. A key that a
third of all rows hold is then asked for once per slice, and its rows meet the
answer slice by slice, so no task gets more of them than one slice has.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.plans.staging import staged


def sliced(table: DataFrame, name: str) -> DataFrame:
    """The table, written out with ``slice`` and ``row``, a number of its own for each row."""
    numbers = {"slice": F.spark_partition_id(), "row": F.monotonically_increasing_id()}
    return staged(table.withColumns(numbers), name)


def looked_up(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every sliced row with the other columns of ``table``, nulls where it has no such key.

    ``table`` has one row per key. A null key finds nothing.
    """
    asked = rows.select(*keys, "slice").distinct()
    answers = asked.join(table, list(keys))
    return rows.join(answers, [*keys, "slice"], "left")
