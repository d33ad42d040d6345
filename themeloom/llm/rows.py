"""Small helpers that the operators share."""

from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

# The white space of words and lines.
WHITE = b" \t\n\x0b\x0c\r"


# What this Python worker keeps for its next tasks, and what the present task asked for.
_KEPT: dict[Hashable, Any] = {}
_ASKED: set[Hashable] = set()


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """``make()``, kept in the worker until a task of ``map_batches`` does without it."""
    _ASKED.add(key)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def text_bytes(value: str | None) -> bytes:
    """UTF-8 of a text; null counts as empty."""
    return value.encode() if value else b""


def utf8(column: pa.Array) -> list[bytes | None]:
    """UTF-8 of each text of a column."""
    return column.cast(pa.binary()).to_pylist()


def map_batches(
    table: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]]
) -> DataFrame:
    """``mapInArrow`` with a function that is set up once per task.

    ``make()`` gives a function from a record batch to columns by name, in
    the order of ``schema``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _ASKED.clear()
        work = make()
        # Memory that other operators filled is free for this one.
        for key in _KEPT.keys() - _ASKED:
            del _KEPT[key]
        for batch in batches:
            columns = work(batch)
            yield pa.RecordBatch.from_pydict(columns)

    return table.mapInArrow(run, schema)
