"""Streaming queries run to their end over the given tables, and round trips through the readers and writers; the SQL is that of the batch twin."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import presence as P
from ..operators import publish
from ..sources import tables as T
from ..sources.shared import local_path, remove, shared_folder
from ..streaming import streams as S
from . import fixtures as X
from . import ingest_jobs, publish_jobs

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _folder(spark: SparkSession) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@contextmanager
def _run(spark: SparkSession) -> Iterator[str]:
    """A fresh folder for streams that end inside the block: then what they read and their checkpoints go, and only results stay."""
    folder = _folder(spark)
    try:
        yield folder
    finally:
        remove(spark, f"{folder}/in", f"{folder}/checkpoint")


def _as_stream(df: DataFrame, folder: str, files: int = 4) -> DataFrame:
    """The rows as a file stream that arrives in several batches, in whatever order the files come."""
    df.repartitionByRange(files, "seq").write.parquet(f"{folder}/in")
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")


def stream_presence_upsert(spark, sf_dir):
    with _run(spark) as folder:
        table = S.presence_table(spark, f"{folder}/table")
        S.stream_presence_upsert(_as_stream(X.shaped(spark, sf_dir, "events", X.PRESENCE), folder), table, f"{folder}/checkpoint", "day").awaitTermination()
    return table.read().select(*ingest_jobs._PRESENCE_COLUMNS)


def stream_kpi_upsert(spark, sf_dir):
    with _run(spark) as folder:
        table = S.kpi_table(spark, f"{folder}/table")
        S.stream_kpi_upsert(_as_stream(X.shaped(spark, sf_dir, "orders", X.KPI), folder), table, f"{folder}/checkpoint").awaitTermination()
    return table.read().select("metric", "t", "geo", "src", "v")


def stream_presence_counts(spark, sf_dir):
    with _run(spark) as folder:
        stream = _as_stream(X.shaped(spark, sf_dir, "events", X.PRESENCE), folder)
        rows = P.normalize_presence(P.validate_presence(stream)[0])
        counts = S.presence_counts(rows, late="3650 days")
        counts.writeStream.outputMode("complete").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{folder}/out")).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(F.date_format("minute", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), "engine", "events", "seen", "citations")


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting that holds inside the block alone."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stream_recrawl_state(spark, sf_dir):
    with _run(spark) as folder, _setting(spark, "spark.sql.streaming.stateStore.providerClass", ROCKS):
        stream = _as_stream(X.shaped(spark, sf_dir, "events", X.FETCHES), folder)
        out = S.stream_recrawl_state(stream).writeStream.outputMode("update").foreachBatch(lambda b, n: b.withColumn("n", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/out/batch={n}"))
        out.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{folder}/out").groupBy("url").agg(F.max_by(F.struct("etag", "last_modified", "last_status", "attempts", "backoff_until", "last_success_at"), "n").alias("r"))
    stamp = lambda c: F.date_format(f"r.{c}", "yyyy-MM-dd HH:mm:ss").alias(c)
    return last.select("url", "r.etag", "r.last_modified", "r.last_status", "r.attempts", stamp("backoff_until"), stamp("last_success_at"))


def stream_content_changes(spark, sf_dir):
    with _run(spark) as folder:
        table = S.content_table(spark, f"{folder}/table")
        S.stream_content_changes(_as_stream(X.shaped(spark, sf_dir, "pages", X.CONTENT), folder), table, f"{folder}/checkpoint").awaitTermination()
    return table.read().select("path", "version", "status")


def read_presence_stream(spark, sf_dir):
    """Events written as JSON files and taken in as a stream."""
    with _run(spark) as folder:
        X.shaped(spark, sf_dir, "events", X.PRESENCE).write.json(f"{folder}/in")
        T.read_presence_stream(spark, f"{folder}/in").writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("seq", "query", "engine", "geo", "seen", "citations", "ts")


def read_kpi_points(spark, sf_dir):
    folder = _folder(spark)
    X.shaped(spark, sf_dir, "orders", X.KPI).write.option("header", "true").csv(f"{folder}/csv")
    return T.read_kpi_points(spark, f"{folder}/csv").select("seq", "t", "v", "geo", "src")


def _write_pages(rows: DataFrame, folder: str, parts: int = 1024, local: bool = True) -> None:
    """A file for each of ``rows(page_id, value)``, its bytes and a line feed, below ``parts`` folders, each written by one task and listed as a whole.

    For each folder and file that Spark makes on a local store Hadoop starts a process to set its mode, which took most of the time, so there, unless
    ``local`` is false, Python writes them, whole under another name first. A file's name follows from its page, so a task that runs again writes the same files.
    """
    top = local_path(rows.sparkSession, folder) if local is not False else None
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("page_id"), F.lit(parts))).repartition("part")
    if top is None:
        lines = dealt.select("part", F.concat(F.lit("p"), "page_id").alias("page"), F.col("value").cast("string"))
        lines.write.option("maxRecordsPerFile", 1).partitionBy("part", "page").text(folder)
        return
    os.makedirs(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, nth, own = None, 0, f".{uuid.uuid4().hex}"
        for batch in batches:
            for part, page, value in zip(*batch.columns):
                nth = nth + 1 if page == last else 0
                last = page
                at = f"{top}/part={part}"
                os.makedirs(at, exist_ok=True)
                with open(f"{at}/{own}", "wb") as file:
                    file.write((value.as_py() or b"") + b"\n")
                os.replace(f"{at}/{own}", f"{at}/page=p{page}.{nth}")
        yield from ()

    dealt.sortWithinPartitions("part", "page_id", "value").select("part", "page_id", "value").mapInArrow(run, "part long").write.format("noop").mode("overwrite").save()


def read_raw_pages(spark, sf_dir):
    """Pages as files of bytes, one for each page with a line feed at its end, some with bytes that are no text, and read back."""
    folder = _folder(spark)
    broken = F.expr("CASE page_id % 4 WHEN 0 THEN X'FF' WHEN 1 THEN X'C328E28228' WHEN 2 THEN X'EFBFBD' ELSE X'' END")
    _write_pages(X.table(spark, sf_dir, "pages").select("page_id", F.concat(broken, F.col("html").cast("binary"), broken).alias("value")), f"{folder}/pages")
    pages = T.read_raw_pages(spark, f"{folder}/pages")
    return pages.select(F.regexp_extract("url", "page=p([0-9]+)", 1).cast("long").alias("page_id"), F.sha2(F.expr("left(html, length(html) - 1)").cast("binary"), 256).alias("sha"))


def write_keyed_table(spark, sf_dir):
    """Points in three batches, the second one run twice, and read back as one table."""
    table = S.kpi_table(spark, f"{_folder(spark)}/kpi")
    points = P.validate_kpi(X.shaped(spark, sf_dir, "orders", X.KPI))[0]
    for batch in (0, 1, 1, 2):
        T.write_keyed_table(points.where(F.col("seq") % 3 == batch), table, batch)
    return table.read().select("metric", "t", "geo", "src", "v")


def write_sitemap(spark, sf_dir):
    folder = _folder(spark)
    publish.write_sitemap(X.table(spark, sf_dir, "pages").select(F.col("url").alias("loc"), F.lit("2024-02-01T00:00:00Z").alias("lastmod")), f"{folder}/sitemap")
    return spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(f"{folder}/sitemap")


QUERIES = {f.__name__: f for f in (read_presence_stream, read_kpi_points, read_raw_pages, write_keyed_table, write_sitemap, stream_presence_upsert, stream_kpi_upsert, stream_presence_counts, stream_recrawl_state, stream_content_changes)}
_UPSERTED = f"WITH {ingest_jobs._KPI} SELECT metric, t, geo, src, v FROM points"
SQL = {
    "stream_presence_upsert": ingest_jobs.SQL["presence_upsert"],
    "stream_kpi_upsert": _UPSERTED,
    "stream_presence_counts": ingest_jobs.SQL["presence_minute_counts"],
    "read_presence_stream": f"SELECT seq, query, engine, geo, seen, citations, ts FROM ({X.sql('events', X.PRESENCE)})",
    "read_kpi_points": f"SELECT seq, t, v, geo, coalesce(nullif(src, ''), 'csv') AS src FROM ({X.sql('orders', X.KPI)})",
    "read_raw_pages": "SELECT page_id, sha256(b || html || b) AS sha FROM (SELECT page_id, html, CASE page_id % 4 WHEN 1 THEN '((' WHEN 2 THEN chr(65533) ELSE '' END AS b FROM pages)",
    "write_keyed_table": _UPSERTED,
    "write_sitemap": "SELECT url AS loc, '2024-02-01T00:00:00Z' AS lastmod FROM pages",
    "stream_recrawl_state": ingest_jobs.SQL["recrawl_state"],
    "stream_content_changes": publish_jobs.SQL["content_state"],
}
