"""Arrow columns inside of tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Texts, and their bytes, that are handled at once. A longer text is a piece of its own.
PIECE_ROWS = 256
PIECE_BYTES = 1 << 20


def pieces(column: pa.Array) -> Iterator[pa.Array]:
    """A column of texts in slices of bounded size, so that what is made of a text does not pile up for a whole batch."""
    total = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        fits = int(np.searchsorted(total, (total[at - 1] if at else 0) + PIECE_BYTES, side="right"))
        end = min(max(at + 1, fits), at + PIECE_ROWS, len(column))
        yield column.slice(at, end - at)
        at = end
    if not len(column):
        yield column
