"""Best-fit-decreasing packing of documents into sequences of bounded length.

Each task encodes its documents, puts an end id after each and cuts those over the capacity
into pieces: all full but the first, which takes the rest. Pieces are dealt by a hash to
groups of about ``group_docs`` documents; in a group they are packed longest first into the
open sequence with the least room that still holds them. Rooms are small integers, so open
sequences are kept by room, with a segment tree over the rooms that finds the tightest one in
log2(capacity) steps. Only lengths are shuffled. Each group leaves at most a few
sequences part empty, so the groups cost almost nothing against packing all at once.

Training order: given each row's position (``with_file_positions`` reads it off ordered files), a group is a
range of positions rather than a share of a hash, so sequences stand in training order, and the position tells
copies of a document apart.

Nulls and edges: a null text is an empty one, a document of the end id alone. Repeated rows
are packed each time. The result has no more rows than pieces; an empty table gives none.
Columns but ``doc_id`` and ``text`` are not read, whatever their names. Files without a number, or with the same one, are ordered by path. Pieces of equal length keep the order of
doc_id, piece and row. A very long text is encoded whole and cut into pieces; its ids take a few times its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32, small, texts_of
from .tokens import encoder


class RoomTree:
    """A segment tree over rooms 0..capacity: how many open sequences have each."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)

    def add(self, room: int, by: int) -> None:
        i = room + self.width
        while i:
            self.count[i] += by
            i >>= 1

    def tightest(self, least: int) -> int:
        """The smallest room of at least ``least`` that some sequence has, or -1."""
        count, i = self.count, least + self.width
        if count[i]:
            return least
        while i > 1 and (i & 1 or not count[i + 1]):  # up, to the nearest full neighbour on the right
            i >>= 1
        if i <= 1:
            return -1
        i += 1
        while i < self.width:
            i = 2 * i if count[2 * i] else 2 * i + 1
        return i - self.width


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece; ties keep the order of the pieces."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    full = order[lengths[order] == capacity]
    sequence[full] = np.arange(len(full))
    used, tree, by_room = len(full), RoomTree(capacity), [[] for _ in range(capacity + 1)]
    for i in order[len(full) :].tolist():
        n = int(lengths[i])
        room = tree.tightest(n)
        if room < 0:
            at, room = used, capacity
            used += 1
        else:
            at = by_room[room].pop()
            tree.add(room, -1)
        sequence[i], offset[i] = at, capacity - room
        if room > n:
            by_room[room - n].append(at)
            tree.add(room - n, 1)
    return sequence, offset


def cut_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of each piece of a document of ``n`` ids."""
    first = n % capacity or capacity
    return [(0, min(n, first)), *((at, capacity) for at in range(first, n, capacity))]


RANGE_BITS, SEQUENCE_BITS = 13, 27


def with_file_positions(docs: DataFrame, name: str = "position") -> DataFrame:
    """A table read from Parquet files with each row's place in it: the files in the order of their numbers, then of their names.

    Spark numbers the files of a sorted table in its order. The rows of each file are counted, so places are gapless and no two rows
    share one, whatever the files are called; the counts, one for each file, are all that is broadcast.
    """
    # By path, as folders of a table may hold files of one name.
    counts = docs.groupBy(F.col("_metadata.file_path").alias("__file")).agg(F.count("*").alias("__rows"))
    order = Window.orderBy(F.regexp_extract("__file", r"/part-(\d+)[^/]*$", 1).try_cast("long").asc_nulls_last(), "__file").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("__file", F.coalesce(F.sum("__rows").over(order), F.lit(0)).alias("__begins"))
    placed = docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")).join(F.broadcast(begins), "__file")
    return placed.withColumn(name, F.col("__begins") + F.col("__row")).drop("__file", "__row", "__begins")


def pack(docs: DataFrame, path: str, *, capacity: int = 1024, end_id: int = 2, group_docs: int = 8000, position: Column | None = None) -> DataFrame:
    """One row for each piece of each row of ``docs(doc_id, text)``.

    ``path``: a byte-level BPE file of the tokenizers library. Result columns: ``doc_id, piece, start, length,
    ids_crc32, sequence_id, offset``; with ``position`` (a long from 0, under 2^49) also that, and groups are ranges of 8,192
    positions, numbered in their order.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    groups = 1 if position is not None else max(1, -(-docs.count() // group_docs))
    shift = SEQUENCE_BITS if position is not None else 40

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, row = encoder(path), 0
        for batch in small(batches):
            of, rows = [], []
            for i, text in enumerate(texts_of(batch)):
                ids = np.array([*(encode(text) if text else ()), end_id], "<u4")
                row += 1
                for piece, (start, n) in enumerate(cut_pieces(len(ids), capacity)):
                    of.append(i)
                    rows.append((piece, start, n, crc32(ids[start : start + n].tobytes()), row))
            piece, start, n, crc, salt = np.array(rows, np.int64).reshape(-1, 5).T
            take = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(n), pa.array(crc), pa.array(salt), batch.column(2).take(take)], names=["doc_id", "piece", "start", "length", "ids_crc32", "salt", "position"])

    def place(group: pa.Table) -> pa.Table:
        group = group.sort_by([(x, "ascending") for x in ("position", "doc_id", "piece", "salt", "ids_crc32")])
        sequence, offset = best_fit_decreasing(group.column("length").to_numpy(), capacity)
        base = group.column("group")[0].as_py() << shift
        return group.select(["doc_id", "piece", "start", "length", "ids_crc32", "position"]).append_column("sequence_id", pa.array(sequence + base)).append_column("offset", pa.array(offset))

    at = F.lit(0).cast("long") if position is None else position
    cut = docs.select("doc_id", "text", at.alias("position")).mapInArrow(pieces, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, salt long, position long")
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(groups)) if position is None else F.shiftright("position", RANGE_BITS))
    packed = dealt.groupBy("group").applyInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, position long, sequence_id long, offset long")
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *([] if position is None else ["position"]))
