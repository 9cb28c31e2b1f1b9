"""Arrow batches in Python workers: cut so that the objects made from one stay few, whatever the size of its rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc


def slices(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int = 1 << 20, most_rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that `column` has about `most_bytes` in each; a larger value stays whole, alone."""
    for batch in batches:
        at = held = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            if i > at and (held + n > most_bytes or i - at >= most_rows):
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        if at < batch.num_rows:
            yield batch.slice(at)
