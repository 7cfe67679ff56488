"""Streaming forms of the keyed upserts, counts and recrawl state.

All of them give the same result in whatever order and batches the rows arrive: what is kept of a key says, for
each value, which row it came from, so a late row finds its place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, MutableMapping
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators import pages, presence, publish
from ..sources.keyed import KeyedTable


def presence_table(spark: SparkSession, path: str, null_geo: str = "distinct", **options) -> KeyedTable:
    """A keyed table of presence rows; it has ``presence_state``'s columns too."""
    return KeyedTable(spark, path, ["query", "engine", "geo", "ts"], lambda rows: presence.merge_presence(rows, null_geo=null_geo), **options)


def kpi_table(spark: SparkSession, path: str, null_geo: str = "distinct", **options) -> KeyedTable:
    return KeyedTable(spark, path, ["metric", "t", "geo", "src"], lambda rows: presence.kpi_upsert(rows, null_geo=null_geo), **options)


_CONTENT = ["path", "seq", "version", "content", "jsonld", "status", "before", "digest_before"]


def content_table(spark: SparkSession, path: str, **options) -> KeyedTable:
    """A keyed table of each path's newest row and what it did to the path."""
    return KeyedTable(spark, path, ["path"], lambda rows: publish.content_state(publish.state_rows(rows)).select(_CONTENT), **options)


def _upsert_stream(stream: DataFrame, table: KeyedTable, checkpoint: str, prepare: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    return stream.writeStream.foreachBatch(lambda batch, number: table.append(prepare(batch), number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_presence_upsert(stream: DataFrame, table: KeyedTable, checkpoint: str, granularity: str = "second") -> StreamingQuery:
    """Presence events appended to a ``presence_table``, which merges them as ``presence_upsert`` does a batch."""

    def prepare(batch: DataFrame) -> DataFrame:
        return presence.presence_state(presence.normalize_presence(presence.validate_presence(batch)[0], granularity))

    return _upsert_stream(stream, table, checkpoint, prepare)


def stream_kpi_upsert(stream: DataFrame, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    return _upsert_stream(stream, table, checkpoint, lambda batch: presence.validate_kpi(batch)[0])


def stream_content_changes(stream: DataFrame, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Page batches merged into a ``content_table``: each path's newest row, its version, and its status by content against the row before it."""
    return _upsert_stream(stream, table, checkpoint, lambda batch: publish.content_state(publish.prepared_rows(publish.validate_publish(batch)[0])).select(_CONTENT))


def presence_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Events, seen and citations for each engine and tumbling window of ``ts``; rows later than the watermark are dropped."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width).alias("w"), "engine").agg(F.count("*").alias("events"), F.sum(F.col("seen").cast("int")).alias("seen"), F.sum("citations").alias("citations")).select(F.col("w.start").alias("minute"), "engine", "events", "seen", "citations")


#: Failures are kept as bits, this many places of the log to a word.
BLOCK = 1024
_HELD = "good_seq long, good_at timestamp, last_seq long, last_at timestamp, last_status int, attempts long, etag_seq long, etag string, last_modified_seq long, last_modified string"
_FIELDS = [f.split()[0] for f in _HELD.split(", ")]


def fold_fetches(held: dict, words: MutableMapping[int, int], rows: pd.DataFrame) -> None:
    """Take fetches into a url's state, wherever they come in its history, and rows that came before once more.

    Kept: the newest success, the newest fetch, each validator's newest place, and the places of the failures after the newest success, as bits in
    ``words``. Each block of places that the rows touch is read and written once, and blocks before a new success are dropped once, so the
    time is that of the rows.
    """

    def newer(name: str, seq: int) -> bool:
        return held.get(name) is None or seq > held[name]

    good = rows[rows["outcome"].isin(["ok", "not_modified"])]
    if len(good) and newer("good_seq", int(good["seq"].max())):
        best = good.loc[good["seq"].idxmax()]
        held["good_seq"], held["good_at"] = int(best["seq"]), best["fetched_at"]
        block, bit = divmod(held["good_seq"], BLOCK)
        for b in [b for b in words if b < block]:
            held["attempts"] -= words.pop(b).bit_count()
        if block in words:
            left = words[block] >> (bit + 1) << (bit + 1)
            held["attempts"] -= words[block].bit_count() - left.bit_count()
            words[block] = left
    last = rows.loc[rows["seq"].idxmax()]
    if newer("last_seq", int(last["seq"])):
        held["last_seq"], held["last_at"], held["last_status"] = int(last["seq"]), last["fetched_at"], int(last["status"])
    for c in ("etag", "last_modified"):
        told = rows[rows[c].notna()]
        if len(told) and newer(f"{c}_seq", int(told["seq"].max())):
            best = told.loc[told["seq"].idxmax()]
            held[f"{c}_seq"], held[c] = int(best["seq"]), best[c]
    held.setdefault("attempts", 0)
    failed = np.unique(rows.loc[~rows["outcome"].isin(["ok", "not_modified"]), "seq"].to_numpy(np.int64))
    failed = failed[failed > held["good_seq"]] if held.get("good_seq") is not None else failed
    blocks, starts = np.unique(failed // BLOCK, return_index=True)
    for block, own in zip(blocks.tolist(), np.split(failed % BLOCK, starts[1:])):
        bits = np.zeros(BLOCK, bool)
        bits[own] = True
        before = words.get(block, 0)
        after = before | int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        if after != before:
            words[block] = after
            held["attempts"] += after.bit_count() - before.bit_count()


class _Words(MutableMapping):
    """A map state of blocks as a mapping from their number to their bits."""

    def __init__(self, state: Any) -> None:
        self._state = state

    def __getitem__(self, block: int) -> int:
        if not self._state.containsKey((block,)):
            raise KeyError(block)
        return int.from_bytes(self._state.getValue((block,))[0], "little")

    def __setitem__(self, block: int, bits: int) -> None:
        self._state.updateValue((block,), (bits.to_bytes(BLOCK // 8, "little"),))

    def __delitem__(self, block: int) -> None:
        self._state.removeKey((block,))

    def __iter__(self) -> Iterator[int]:
        return iter([k[0] for k in self._state.keys()])

    def __len__(self) -> int:
        return sum(1 for _ in self._state.keys())


class RecrawlProcessor(StatefulProcessor):
    """Keeps a typed row and a map of failure bits for each url, and gives its recrawl state out after each batch that touched it."""

    def init(self, handle: Any) -> None:
        self._held = handle.getValueState("held", _HELD)
        self._words = _Words(handle.getMapState("failed", "block long", "bits binary"))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        held = {k: v for k, v in zip(_FIELDS, self._held.get()) if v is not None} if self._held.exists() else {}
        for pdf in rows:
            fold_fetches(held, self._words, pdf)
        self._held.update(tuple(_plain(held.get(c)) for c in _FIELDS))
        attempts = int(held["attempts"])
        until = pd.Timestamp(held["last_at"]) + pd.Timedelta(seconds=min(pages.BACKOFF_CAP, 2.0 ** min(attempts, 6))) if attempts else pd.NaT
        success = pd.Timestamp(held["good_at"]) if held.get("good_at") is not None else pd.NaT
        yield pd.DataFrame({"url": [key[0]], "etag": [held.get("etag")], "last_modified": [held.get("last_modified")], "last_status": [held["last_status"]], "attempts": [attempts], "backoff_until": [until], "last_success_at": [success]})

    def close(self) -> None:
        pass


def _plain(value: Any) -> Any:
    return value.to_pydatetime() if isinstance(value, pd.Timestamp) else value


def stream_recrawl_state(log: DataFrame) -> DataFrame:
    """Update stream of ``recrawl_state`` rows; needs the RocksDB state store provider."""
    schema = "url string, etag string, last_modified string, last_status int, attempts int, backoff_until timestamp, last_success_at timestamp"
    rows = pages.classify_fetch(log)
    rows = rows.withColumns(pages.validators(rows)).select("url", "seq", "fetched_at", "status", "outcome", "etag", "last_modified")
    return rows.groupBy("url").transformWithStateInPandas(RecrawlProcessor(), schema, "Update", "None")
