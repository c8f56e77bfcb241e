"""Folds over the rows of a key in order of time.

Rows are dealt by key and sorted within their partitions; a task goes through
them once, batch by batch, and keeps the state of one key at a time.  No key is
ever gathered in a row, a list or a group, however long its history is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def fold_in_order(df: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable[[object, tuple], tuple], schema: str) -> DataFrame:
    """One row per input row: ``key`` and what ``step(state, row)`` returns.
    ``start`` makes a key's state, which ``step`` changes in place; rows are
    the columns of ``order``, which also sort them.  Null keys are one key."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last, begun = None, None, False
        for b in batches:
            out = []
            for k, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not begun or k != last:
                    state, last, begun = start(), k, True
                out.append((k, *step(state, row)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    types = [to_arrow_type(f.dataType) for f in _parse_datatype_string(schema).fields]
    rows = df.select(key, *order).repartition(key).sortWithinPartitions(key, *order)
    return rows.mapInArrow(run, schema)
