"""Groups of sorted rows inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def _changes(t: pa.Table, keys: int) -> np.ndarray:
    """Places where a group begins, but the first."""
    change = np.zeros(max(0, len(t) - 1), bool)
    for k in range(keys):
        x = t.column(k).to_numpy()
        change |= x[1:] != x[:-1]
    return np.flatnonzero(change) + 1


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of sorted rows, with the bounds of the groups; groups are the first columns' values."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        cuts = _changes(held, keys)
        if len(cuts):
            yield held.slice(0, cuts[-1]), np.concatenate([[0], cuts])
            held = held.slice(cuts[-1])
    if held is not None:
        yield held, np.concatenate([[0], _changes(held, keys), [len(held)]])
