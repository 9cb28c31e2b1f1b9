"""Folds over ordered rows whose state passes from row to row and that no window can express.

Rows are shuffled to their keys once and sorted; a task then streams them in Arrow batches and carries the state of
the key it is in. So memory holds a batch, however long a key's rows are, and a retried task repeats its answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def fold(rows: DataFrame, keys: Sequence[str], order: str, inputs: Sequence[str], start: Callable[[], Any], step: Callable[..., tuple[Any, tuple]], out: str) -> DataFrame:
    """`keys`, `order` and the columns `out` (a schema string) of every row.

    `step(state, *inputs)` returns the next state and the row's values of `out`; `start()` is a key's first state.
    Rows of one key and equal order come in no particular order.
    """
    named = [*keys, order]
    narrow = rows.select(*named, *inputs)
    ordered = narrow.repartition(*keys).sortWithinPartitions(*named)
    made = StructType.fromDDL(out)
    schema = StructType([narrow.schema[c] for c in named] + made.fields)
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in made.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        state: Any = None
        for batch in batches:
            groups = zip(*(batch.column(c).to_pylist() for c in keys), strict=True)
            found = []
            for key, *values in zip(groups, *(batch.column(c).to_pylist() for c in inputs), strict=True):
                if key != at:
                    at, state = key, start()
                state, result = step(state, *values)
                found.append(result)
            columns = zip(*found, strict=True) if found else [()] * len(kinds)
            made_now = [pa.array(list(c), t) for c, (_, t) in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in named), *made_now], names=schema.names)

    return ordered.mapInArrow(run, schema)
