"""One row in, many rows out, by a Python function where the row is: no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def per_row(df: DataFrame, keys: list[str], columns: list[str], make: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """(keys, schema): the rows that ``make`` gives for the ``columns`` of each row; a key keeps its type, nulls included."""
    made = T.StructType.fromDDL(schema)
    kept = [df.schema[k] for k in keys]
    kinds = [to_arrow_type(f.dataType) for f in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for k, values in enumerate(zip(*(b.column(len(keys) + c).to_pylist() for c in range(len(columns))))):
                own = make(*values)
                at += [k] * len(own)
                rows += own
            places = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(places) for k in range(len(keys))), *(pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds))], names=[*keys, *made.names])

    return df.select(*keys, *columns).mapInArrow(run, T.StructType([*kept, *made]))
