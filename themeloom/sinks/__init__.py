"""Text and parquet outputs.

Every writer replaces what is there, but only once the new output is whole: it
is written beside the old one, which stays if the job fails, and then takes
its place.
"""

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = ","


def replace(table: DataFrame, path: str, write: Callable[[DataFrame, str], None]) -> None:
    """Write beside ``path`` and swap; ``write(table, folder)`` writes to a new folder."""
    spark, place, mark = table.sparkSession, path.rstrip("/"), uuid.uuid4().hex
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    new, old, here = (hadoop(name) for name in (f"{place}.new-{mark}", f"{place}.old-{mark}", place))
    files = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        write(table, f"{place}.new-{mark}")
    except BaseException:
        files.delete(new, True)
        raise
    was_there = files.exists(here)
    if was_there and not files.rename(here, old):
        raise OSError(f"cannot move the old output of {path}")
    if not files.rename(new, here):
        if was_there:
            files.rename(old, here)
        raise OSError(f"cannot put the new output at {path}")
    if was_there:
        files.delete(old, True)


def _lines(table: DataFrame, line: Column, path: str) -> None:
    replace(table.select(line.alias("value")), path, lambda lines, to: lines.write.text(to))


def number_line(vector: str) -> Column:
    """The numbers of an array column, without brackets."""
    return F.array_join(F.col(vector).cast("array<string>"), SEPARATOR)


def write_term_index(terms: DataFrame, path: str) -> None:
    """``(id,term)`` per line."""
    line = F.concat(F.lit("("), F.col("term_id"), F.lit(SEPARATOR), F.col("term"), F.lit(")"))
    _lines(terms, F.translate(line, "[]", ""), path)


def write_vectors(table: DataFrame, vector: str, path: str) -> None:
    """The numbers of one row per line."""
    _lines(table, number_line(vector), path)


def write_labels(labelled: DataFrame, path: str) -> None:
    """One cluster number per line."""
    _lines(labelled, F.col("cluster").cast("string"), path)


def write_labelled(labelled: DataFrame, path: str) -> None:
    """``docid,date,cluster`` per line, in the order of the table.

    A sorted table gives part files whose names are in order, so that reading
    them in turn gives one sorted list; no single task writes everything.
    """
    date = F.coalesce(F.col("date").cast("string"), F.lit("null"))
    _lines(labelled, F.concat_ws(SEPARATOR, F.col("docid"), date, F.col("cluster")), path)


def write_table(table: DataFrame, path: str) -> None:
    """Parquet, with the docid that the text outputs lack."""
    replace(table, path, lambda rows, to: rows.write.parquet(to))
