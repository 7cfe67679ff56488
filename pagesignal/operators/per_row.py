"""Rows made from single rows by a small Python function, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def per_row(df: DataFrame, key: str, columns: list[str | Column], schema: str, read: Callable[..., list[tuple]]) -> DataFrame:
    """``key`` and the rows of ``schema`` that ``read`` makes of each row's ``columns``. Nothing is shuffled."""
    kind = df.schema[key].dataType.simpleString()
    fields = T._parse_datatype_string(schema).fields
    types, names = [to_arrow_type(f.dataType) for f in fields], [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, rows = [], []
            for i, given in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
                found = read(*given)
                of += [i] * len(found)
                rows += found
            arrays = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *arrays], names=[key, *names])

    return df.select(key, *columns).mapInArrow(run, f"{key} {kind}, {schema}")
