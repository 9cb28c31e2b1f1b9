"""Arrow batches in Python workers: slicing, per-worker models, record building."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Models by content, kept while the worker process lives; tasks of the same worker share them.
_MODELS: dict[Any, Any] = {}


def model(key: Any, build: Callable[[], Any]) -> Any:
    if key not in _MODELS:
        if len(_MODELS) >= 8:
            _MODELS.clear()
        _MODELS[key] = build()
    return _MODELS[key]


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20, most_rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that `column` has about `most_bytes` in each; a single larger value stays whole."""
    for batch in batches:
        sizes = [0 if x is None else x for x in pa.compute.binary_length(batch.column(column)).to_pylist()]
        at = held = 0
        for i, n in enumerate(sizes):
            if i > at and (held + n > most_bytes or i - at >= most_rows):
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        if at < len(sizes):
            yield batch.slice(at)


def batch_of(schema: pa.Schema, columns: list[Any]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
