"""Arrow batches cut into blocks of bounded bytes, so a task's memory does not follow the batch size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 4 << 20


def cut(
    batches: Iterable[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES, most_rows: int | None = None
) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold at most `limit` bytes of `column` each, a longer text being a slice of its own,
    and at most most_rows rows."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.cumsum(byte_lengths(batch.column(batch.schema.get_field_index(column))))
        start, n = 0, batch.num_rows
        while start < n:
            base = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, base + limit, side="right")))
            stop = stop if most_rows is None else min(stop, start + most_rows)
            yield batch.slice(start, stop - start)
            start = stop


def byte_lengths(column: pa.Array) -> np.ndarray:
    """UTF-8 bytes of every text; null counts as 0."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def raw(column: pa.Array) -> list[bytes]:
    """Every text as bytes; null becomes the empty text."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """Every text; null becomes the empty text."""
    return [x or "" for x in column.to_pylist()]
