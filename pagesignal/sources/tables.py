"""Readers that bring raw tables to the shapes the operators take."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keyed import KeyedTable
from .shared import local_path

CORPUS = "id string, url string, title string, text string, anchor string, last_modified string, jurisdiction string, place_ids array<string>"
KPI = "seq long, metric string, t string, v string, geo string, src string"
PRESENCE = "seq long, query string, engine string, geo string, serp_surface string, engine_flavor string, seen boolean, citations string, position string, details string, ts string, definition_version string"


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out over all cores if it has fewer partitions than that, as small single files have.

    A table of many files is left as it is, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def gathered(df: DataFrame, most: int = 32) -> DataFrame:
    """``df`` with up to ``most`` of its partitions in one task, as long as each core has four.

    Spark packs small files as if each were 4 MB, so a million of them would be tens of thousands of tasks that take longer to start than to run.
    """
    read = df.rdd.getNumPartitions()
    return df.coalesce(max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-read // most)))


def read_corpus(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with missing url, title and text as empty text, and the rows without an id."""
    filled = df.withColumns({c: F.coalesce(c, F.lit("")) for c in ("url", "title", "text")})
    return filled.where("id IS NOT NULL"), filled.where("id IS NULL")


def _shown(name: str) -> bool:
    """Whether Spark reads files and folders of that name."""
    return not (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def fail(error: OSError) -> None:
        raise error

    for batch in batches:
        for folder, deep in zip(*(c.to_pylist() for c in batch.columns)):
            for at, folders, names in os.walk(folder, onerror=fail, followlinks=True):
                folders[:] = [f for f in folders if deep and _shown(f)]
                yield pa.RecordBatch.from_pydict({"path": pa.array([f"{at}/{n}" for n in names if _shown(n)], pa.string())})


def _contents(batches: Iterator[pa.RecordBatch], most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    paths, held, size = [], [], 0
    for batch in batches:
        for path in batch.column(0).to_pylist():
            with open(path, "rb") as file:
                content = file.read()
            if content:
                paths.append(f"file:{path}")
                held.append(content)
                size += len(content)
            if size >= most:
                yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "content": pa.array(held, pa.binary())})
                paths, held, size = [], [], 0
    yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "content": pa.array(held, pa.binary())})


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of all files below a folder but hidden and empty ones.

    Spark keeps each file that it is to read in the driver, whose 750 MB were too few for 769,000. So tasks list and read a local folder, and only
    the names of the folders in it go through the driver. Other stores are read by Spark, whose driver must have room for their files' names.
    """
    top = local_path(spark, path)
    if top is None or not os.path.isdir(top):
        return gathered(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)).select("path", "content")
    top, tasks = top.rstrip("/"), 4 * spark.sparkContext.defaultParallelism
    folders = [(top, False), *((f.path, True) for f in os.scandir(top) if f.is_dir() and _shown(f.name))]
    paths = spark.createDataFrame(folders, "folder string, deep boolean").repartition(min(tasks, len(folders))).mapInArrow(_listed, "path string")
    return paths.repartition(tasks, "path").mapInArrow(_contents, "path string, content binary")


def read_raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """``url, html`` of page files; bytes that are no UTF-8 are left out. Spark reads no row of a file without bytes."""
    files = read_files(spark, path)
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    # Only files with such bytes go through Python.
    return files.select(F.col("path").alias("url"), F.when(valid, text).otherwise(_without_bad_bytes(F.when(~valid, F.col("content")))).alias("html"))


@F.pandas_udf(T.StringType())
def _without_bad_bytes(contents: pd.Series) -> pd.Series:
    return contents.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


def read_kpi_points(spark: SparkSession, path: str, form: str = "csv") -> DataFrame:
    reader = spark.read.schema(KPI).option("header", "true")
    points = reader.csv(path) if form == "csv" else reader.json(path)
    return points.withColumn("src", F.coalesce(F.nullif(F.col("src"), F.lit("")), F.lit("csv")))


def read_presence_stream(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    return spark.readStream.schema(PRESENCE).format(form).load(path)


def write_keyed_table(df: DataFrame, table: KeyedTable, batch: int) -> int:
    """Upsert rows into a keyed table as a numbered batch; returns the bytes written, which grow with the rows and not with the table."""
    return table.append(df, batch)
