"""Arrow batches a stretch at a time.

Spark bounds a batch by its rows and its bytes; what a map makes of it (the ids of
its tokens, the chunks of its texts) may be many times that.  Maps that make much
of a row go through the stretches of a batch, so their memory follows the stretch.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def stretches(batches: Iterator[pa.RecordBatch], place: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in order, in stretches whose lists (or texts) in
    column ``place`` have about ``most`` items (bytes) in all; a row is never cut."""
    for b in batches:
        if not b.num_rows:
            continue
        column = b.column(place)
        length = pc.list_value_length if pa.types.is_list(column.type) or pa.types.is_large_list(column.type) else pc.binary_length
        sizes = pc.fill_null(length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        begins = np.flatnonzero(np.diff(np.cumsum(sizes) // most, prepend=-1))
        for begin, end in zip(begins, [*begins[1:], b.num_rows], strict=True):
            yield b.slice(begin, end - begin)
