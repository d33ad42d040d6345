"""When a table may be copied to every executor."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Most numbers in a table that is broadcast by a hint (128 MiB of doubles).
BROADCAST_NUMBERS = 16_000_000


def small(table: DataFrame, rows: int, numbers_per_row: int = 1) -> DataFrame:
    """The table, with a broadcast hint if its proven size allows it.

    ``rows`` is a bound that follows from settings (terms, clusters, vector
    length), not an estimate. A larger table is left to Spark, which then
    shuffles both sides of the join.
    """
    fits = rows * max(numbers_per_row, 1) <= BROADCAST_NUMBERS
    return F.broadcast(table) if fits else table
