"""Rows of each key in order through a step with a state, in batches of Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame

TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}


def plain(column: pa.Array) -> list:
    """A column's values as Python objects; numbers without nulls by way of numpy, which is faster."""
    kind = column.type
    if not column.null_count and (pa.types.is_integer(kind) or pa.types.is_floating(kind)):
        return column.to_numpy().tolist()
    return column.to_pylist()


def walk(rows: DataFrame, key: str, order: str, begin: Callable[[], object], step: Callable[[object, dict], dict], returns: str) -> DataFrame:
    """What step(state, row) gives for each row; begin gives the state that a key begins with.

    A key's rows are in one partition, sorted by Spark, which may spill; the
    state alone is carried from batch to batch, so a key of any length needs no
    more memory than a batch, and short keys share batches.
    """
    kinds = [tuple(c.split()) for c in returns.split(", ")]
    schema = pa.schema([(name, TYPES[kind]) for name, kind in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), None
        for batch in batches:
            names, out = batch.schema.names, []
            for values in zip(*map(plain, batch.columns), strict=True):
                row = dict(zip(names, values))  # noqa: B905 - of one length, as all columns give a value
                if row[key] != current:
                    current, state = row[key], begin()
                out.append(step(state, row))
            yield pa.RecordBatch.from_arrays([pa.array(list(map(itemgetter(f.name), out)), f.type) for f in schema], schema=schema)

    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, returns)
