"""Arrow batches in small slices: what Python holds of a batch does not grow with its rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text, and rows, that are Python objects at a time; a single row may be larger.
SLICE_BYTES = 1 << 20
SLICE_ROWS = 2048


def cuts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows, in order, of at most ``SLICE_ROWS`` rows and ``SLICE_BYTES`` bytes, but at least one row."""
    ends, begin, before = np.cumsum(sizes), 0, 0
    while begin < len(ends):
        fitting = int(np.searchsorted(ends, before + SLICE_BYTES, "right"))
        end = min(max(begin + 1, fitting), begin + SLICE_ROWS, len(ends))
        yield begin, end
        begin, before = end, int(ends[end - 1])


def _lengths(values: pa.Array) -> np.ndarray:
    return pc.binary_length(values).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def row_sizes(values: pa.Array) -> np.ndarray:
    """Bytes of each string, or of the texts in each array of segments; a segment counts for itself, too."""
    if not pa.types.is_list(values.type):
        return _lengths(values)
    counts = pc.list_value_length(values).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.append(0, np.cumsum(_lengths(values.flatten().field("text")) + 64))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def sliced(values: pa.Array, work: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """``work`` on one slice of ``values`` after the other, its results put together; they have a row for each."""
    parts = [work(values.slice(a, b - a)) for a, b in cuts(row_sizes(values))]
    return pa.concat_arrays(parts) if parts else work(values)
