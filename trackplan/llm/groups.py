"""Reading groups of rows from partitions that are sorted by the group's key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def _key_changes(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Positions i > 0 at which a key column differs from row i - 1."""
    changed = np.zeros(max(batch.num_rows - 1, 0), dtype=bool)
    for name in keys:
        values = batch.column(name).to_numpy(zero_copy_only=False)
        changed |= values[1:] != values[:-1]
    return np.flatnonzero(changed) + 1


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Yield record batches that hold whole groups; the input is sorted by `keys` (no nulls).

    A yielded batch may hold several groups.  Memory is that of one input batch
    and the longest group, which callers bound by chunking groups beforehand.
    """
    waiting: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        first = tuple(batch.column(k)[0].as_py() for k in keys)
        if waiting and first != last:
            yield _joined(waiting)
            waiting = []
        cuts = _key_changes(batch, keys)
        if len(cuts):
            waiting.append(batch.slice(0, cuts[-1]))
            yield _joined(waiting)
            batch = batch.slice(cuts[-1])
            waiting = []
        waiting.append(batch)
        last = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)
    if waiting:
        yield _joined(waiting)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(parts) == 1:
        return parts[0]
    table = pa.Table.from_batches(parts).combine_chunks()
    return table.to_batches()[0]


def bounds(batch: pa.RecordBatch, keys: list[str]) -> list[tuple[int, int]]:
    """(start, end) of each group in a batch sorted by `keys`."""
    cuts = [0, *_key_changes(batch, keys).tolist(), batch.num_rows]
    return list(zip(cuts, cuts[1:], strict=False))
