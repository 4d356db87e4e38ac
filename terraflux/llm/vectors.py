"""What the two vector operators share: vectors as matrices in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and float64 matrix of the rows of (id, vector) that take part, by number of dimensions.

    Left out are rows whose id or vector is null, whose vector is empty, or holds a null
    or a component that is not finite.
    """
    ids, lists = batch.column(0), batch.column(1)
    if not len(lists):
        return
    known = np.asarray(ids.is_valid()) & np.asarray(lists.is_valid())
    number = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    offset = lists.offsets.to_numpy()
    flat = lists.values.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    size = np.diff(offset)
    for d in np.unique(size[known & (size > 0)]).tolist():
        rows = np.flatnonzero(known & (size == d))
        x = flat[offset[rows][:, None] + np.arange(d)]
        ok = np.isfinite(x).all(axis=1)
        if ok.any():
            yield number[rows[ok]], x[ok]
