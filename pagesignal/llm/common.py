"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of characters other than space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that all executors see: the one named by ``spark.checkpoint.dir``.

    Only on one machine may the session name none; then a temporary folder is set for it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        named = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: The tables cut in the innermost ``temporary`` block. Threads have blocks of their own.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read from there, and the path of the table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (own := _written.get()) is not None:
        own.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files, so that lost executors cost no more than they held."""
    return written(df)[0]


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context.hadoopConfiguration()).delete(at, True)
        if path in (own := _written.get() or []):
            own.remove(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables cut inside the block are deleted at its end."""
    own: list[str] = []
    outer = _written.set(own)
    try:
        yield
    finally:
        remove(spark, *list(own))
        _written.reset(outer)


def fresh(names: Iterable[str], wanted: str) -> str:
    """``wanted``, with underscores added until no column has that name."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def join_split(rows: DataFrame, few: DataFrame, key: str, total: int, most: int = 2000) -> DataFrame:
    """``rows`` with the columns of ``few(key, n, ...)``, where ``n`` says how many of the rows have the key.

    Keys of more than ``total / most`` rows, of which there are at most ``most``, are broadcast; only the rest
    meets in a shuffle, so the rows of a hot key stay where they are. Rows whose key ``few`` lacks go.
    """
    limit = max(16, total // most)
    held = F.struct(*[c for c in few.columns if c not in (key, "n")]).alias("__held")
    marked = rows.join(F.broadcast(few.where(F.col("n") > limit).select(key, held)), key, "left")
    near = marked.where(F.col("__held").isNotNull())
    far = marked.where(F.col("__held").isNull()).drop("__held").join(few.where(F.col("n") <= limit).select(key, held), key)
    return near.unionByName(far).select(*rows.columns, "__held.*")


def crc32_mod(column: Column | str, n: int) -> Column:
    """Remainder of the CRC-32 of the value as text; a null counts as the empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def unit_hash(*columns: Column | str) -> Column:
    """A reproducible number in [0, 1) from the columns' values."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / F.lit(float(1 << 30))


def small(batches: Iterator[pa.RecordBatch], most_bytes: int = 4 << 20, most_rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in batches small enough that Python copies of their texts take little memory."""
    for batch in batches:
        rows = max(1, min(most_rows, batch.num_rows * most_bytes // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def with_columns(batch: pa.RecordBatch, keep: Iterable[str], **new: pa.Array) -> pa.RecordBatch:
    """The named columns of a batch as they are, then the new ones."""
    keep = list(keep)
    arrays = [batch.column(batch.schema.get_field_index(k)) for k in keep]
    return pa.RecordBatch.from_arrays([*arrays, *new.values()], names=[*keep, *new])


def chunks_by_size(texts: list[str | None], limit: int) -> Iterator[tuple[list[int], list[str]]]:
    """Deal out texts in runs of at most ``limit`` characters.

    Longer texts come in several slices, each a run of its own, so that the arrays made
    from a run stay small. Yields the texts' numbers and the slices; null is empty.
    """
    at, run, total = [], [], 0
    for i, text in enumerate(texts):
        text = text or ""
        if total and total + len(text) > limit:
            yield at, run
            at, run, total = [], [], 0
        while len(text) > limit:
            yield [i], [text[:limit]]
            text = text[limit:]
        at.append(i)
        run.append(text)
        total += len(text)
    if at:
        yield at, run


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
