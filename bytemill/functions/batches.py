"""Arrow batches in runs of rows whose bytes are bounded, whatever the rows of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of contents that a worker works on together; a single longer value is a run of its own.
TOGETHER = 4 << 20


def runs(values: pa.Array, most: int = TOGETHER) -> Iterator[slice]:
    """Slices of rows with about ``most`` bytes each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(size):
        done = int(size[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, done + most, side="right")))
        yield slice(lo, hi)
        lo = hi


def joined(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], kind)
