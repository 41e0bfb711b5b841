"""Groups of rows in streams of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def groups_of(batches: Iterator[pa.RecordBatch], a: str, b: str) -> Iterator[pa.Table]:
    """The rows of each pair of whole numbers ``a, b``, which are ordered by them, as one table."""
    held: list[pa.RecordBatch] = []
    group = None
    for batch in batches:
        x, y = batch.column(a).to_numpy(), batch.column(b).to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(x) != 0) | (np.diff(y) != 0)) + 1).tolist(), len(x)]
        for i, j in zip(cuts[:-1], cuts[1:]):
            if i < j:
                if held and (x[i], y[i]) != group:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held = []
                group = (x[i], y[i])
                held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
