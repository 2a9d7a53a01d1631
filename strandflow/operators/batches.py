"""Groups of sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def _changes(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """Places of rows, the first aside, whose key differs from that of the row before."""
    differs = np.zeros(max(0, batch.num_rows - 1), bool)
    for column in batch.columns[:keys]:
        code = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        differs |= code[1:] != code[:-1]
    return np.flatnonzero(differs) + 1


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows sorted by their first `keys` columns, as batches of whole groups with the borders of these (first and last included).
    Only the group that a batch ends in is held back."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            edge = pa.concat_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)])
            if len(_changes(edge, keys)):
                whole = pa.concat_batches(held)
                yield whole, np.array([0, whole.num_rows])
                held = []
        cuts = _changes(batch, keys)
        if not len(cuts):
            held.append(batch)
            continue
        whole = pa.concat_batches([*held, batch.slice(0, cuts[-1])])
        ahead = whole.num_rows - cuts[-1]
        yield whole, np.concatenate([[0], cuts + ahead])
        held = [batch.slice(cuts[-1])]
    if held:
        whole = pa.concat_batches(held)
        yield whole, np.array([0, whole.num_rows])
