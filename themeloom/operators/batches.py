"""Arrow batches in pieces, so that a task's memory does not grow with its rows.

A batch holds thousands of articles. What is made of it on the way to a result
is often many times as large, and is made of a piece at a time instead.
"""

from collections.abc import Iterator

import pyarrow as pa

# Bytes of a piece.
AT_ONCE = 4 << 20


def in_pieces(batches: Iterator[pa.RecordBatch], most: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in batches of about ``most`` bytes or of one row.

    What a batch held is given back before the next one is asked for, and
    after the last one, as an idle worker keeps what it has not given back.
    """
    for batch in batches:
        step = max(batch.num_rows * most // max(batch.nbytes, 1), 1)
        for begin in range(0, batch.num_rows, step):
            yield batch.slice(begin, step)
        del batch
        pa.default_memory_pool().release_unused()
