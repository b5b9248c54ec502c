"""One row in, several rows out, without leaving Arrow for the columns that are only carried along."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame


def fan_out(df: DataFrame, inputs: list[str], carry: list[str], outputs: dict[str, str], make: Callable[..., list[tuple]], rows: int = 512, together: bool = False) -> DataFrame:
    """``make(*values of inputs)`` gives the output rows of one row; ``carry`` columns are repeated beside them.

    ``outputs`` maps output names to types. Rows are worked on ``rows`` at a time, which bounds the
    memory of a task whatever the size of the Arrow batches. With ``together`` ``make`` takes whole columns
    of so many rows, as lists, and gives a list of output rows for each row.
    """
    carried = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry)
    schema = ", ".join(x for x in (carried, ", ".join(f"`{c}` {t}" for c, t in outputs.items())) if x)
    names = [*carry, *outputs]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "boolean": pa.bool_()}
        kinds = [types[t] for t in outputs.values()]
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in inputs]
                got = make(*columns) if together else [make(*values) for values in zip(*columns, strict=True)]
                index = pa.array(np.repeat(np.arange(len(got)), [len(g) for g in got]))
                flat = [row for g in got for row in g]
                arrays = [batch.column(batch.schema.get_field_index(c)).take(index) for c in carry]
                parts = list(zip(*flat, strict=True)) if flat else [[] for _ in kinds]
                arrays += [pa.array(p, k) for p, k in zip(parts, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return df.select(*dict.fromkeys([*carry, *inputs])).mapInArrow(run, schema)
