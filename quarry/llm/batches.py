"""Arrow batches in pieces of bounded size, so that a worker holds few texts as Python objects at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

ROWS = 256


def pieces(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order, at most `rows` at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
