"""Running counts and sums within keys of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut


def running(rows: DataFrame, key: str, order: list[Column], amount: Column) -> DataFrame:
    """``rows`` with ``__at``, how many rows of their key stand before them, and ``__before``, the sum of ``amount`` over these.

    Rows are sorted by ranges of (key, order, row), so a key with many rows, even equal ones, is spread over many tasks. Each task sums within
    its range; what a key has in earlier ranges is added from a table that has at most one row for each range, since
    only one key can go on from one range into the next. Null keys are one key.
    """
    marked = rows.withColumn("__amount", amount.cast("long"))
    by = [F.col(key).asc_nulls_first(), *order]
    # The last number only tells equal rows apart for the ranges.
    laid = marked.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*by, F.col("__tie")).sortWithinPartitions(*by, F.col("__tie")).drop("__tie")
    at, width = rows.columns.index(key), len(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count, total = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys, amounts = batch.column(at), batch.column(width).to_numpy()
            starts = np.ones(n, bool)
            # Equal or both null.
            same = pc.fill_null(pc.equal(keys.slice(1), keys.slice(0, n - 1)), False).to_numpy(zero_copy_only=False)
            null = keys.is_null().to_numpy(zero_copy_only=False)
            starts[1:] = ~(same | (null[1:] & null[:-1]))
            first = keys[0].as_py()
            starts[0] = last is None or first != last[0]
            begin = np.maximum.accumulate(np.where(starts, np.arange(n), -1))
            sums = np.concatenate([[0], np.cumsum(amounts)])
            goes_on = begin < 0
            own_at = np.arange(n) - np.where(goes_on, -count, begin)
            before = sums[:n] - np.where(goes_on, -total, sums[begin])
            last, count, total = (keys[n - 1].as_py(),), int(own_at[-1]) + 1, int(before[-1] + amounts[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(own_at), pa.array(before)], names=[*batch.schema.names, "__part", "__at", "__before"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in laid.schema)
    table = cut(laid.mapInArrow(run, f"{fields}, __part int, __at long, __before long"))
    sums = table.groupBy("__part", key).agg(F.count("*").alias("n"), F.sum("__amount").alias("total"))
    earlier = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("__part").alias("__running_part"), F.col(key).alias("__running_key"), F.sum("n").over(earlier).alias("__running_n"), F.sum("total").over(earlier).alias("__running_total")).where("__running_n > 0")
    joined = table.join(F.broadcast(offsets), (F.col("__part") == F.col("__running_part")) & F.col(key).eqNullSafe(F.col("__running_key")), "left")
    shifted = joined.withColumn("__at", F.col("__at") + F.coalesce("__running_n", F.lit(0))).withColumn("__before", F.col("__before") + F.coalesce("__running_total", F.lit(0)))
    return shifted.select(*rows.columns, "__at", "__before")


def by_group(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each run of equal first ``keys`` columns, in tables of whole runs; a table ends with its batch or after it."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        begins = group_starts(batch, keys)
        if waiting and not _same(waiting[-1], batch, keys):
            yield pa.Table.from_batches(waiting)
            waiting = []
        if len(begins) > 1:  # the last run may go on in the next batch
            yield pa.Table.from_batches([*waiting, batch.slice(0, begins[-1])])
            waiting = [batch.slice(begins[-1])]
        else:
            waiting.append(batch)
    if waiting:
        yield pa.Table.from_batches(waiting)


def _same(a: pa.RecordBatch, b: pa.RecordBatch, keys: int) -> bool:
    return all(a.column(i)[a.num_rows - 1].as_py() == b.column(i)[0].as_py() for i in range(keys))


def group_starts(batch: pa.RecordBatch | pa.Table, keys: int) -> np.ndarray:
    """Where runs of equal first ``keys`` columns begin."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for i in range(keys):
        c = batch.column(i)
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        same = pc.fill_null(pc.equal(c.slice(1), c.slice(0, n - 1)), False).to_numpy(zero_copy_only=False) if n > 1 else np.zeros(0, bool)
        null = c.is_null().to_numpy(zero_copy_only=False)
        new[1:] |= ~(same | (null[1:] & null[:-1]))
    return np.flatnonzero(new)
