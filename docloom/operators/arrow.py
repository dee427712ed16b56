"""Rows of Arrow batches as NumPy arrays, and runs of rows with equal keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal keys (whole numbers without nulls), across batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.column_stack([batch.column(k).to_numpy() for k in keys])
        cuts = [0, *(np.flatnonzero((columns[1:] != columns[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            if held and tuple(columns[start]) != before:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, stop - start))
            before = tuple(columns[start])
    if held:
        yield pa.Table.from_batches(held)


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of an array column that have that many finite numbers: their places and a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    start = column.offsets.to_numpy()
    size = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(start), -1)
    rows = np.flatnonzero(size == width)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    found = values[start[:-1][rows][:, None] + np.arange(width)] if len(rows) else np.zeros((0, width))
    fine = np.isfinite(found).all(axis=1)
    return rows[fine], found[fine]
