"""Ranked lexical search by a hierarchical max tree over document ranges per term.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII; A to Z are lower-cased. One pass over the
texts counts the terms that some item asks for and writes them, a row for each document, as the index. From it come the
figures of the corpus: documents with a term, all terms, and how many documents hold each asked term.

Search: each task takes the documents of the index in shards and builds, for every asked term, the highest
impact that it has in ranges of 64 documents, in ranges of 512, and so on. For an item, a node's bound is the sum of its
terms' weights times these maxima. Nodes are opened from the highest bound down; a range of 64 documents is
scored exactly. The search of a shard ends when the highest bound left is below the k-th score held, which is carried from shard
to shard; nodes whose bound equals it are opened, as a tie may go to a smaller doc_id. Only a task's best k for each item are
shuffled. The result is exact: bounds are never too low, as no weight is negative.

Scale: items are the stated query set; they are taken in blocks whose count and bytes are bounded, and a block's terms, with their
document counts, are all that the driver sees. Documents are never joined to items, and no postings are shuffled.

Nulls and edges: null and empty texts have no term, so they are neither counted nor found. A null doc_id is a
document that comes last among equal scores. Repeated rows are documents of their own. Rows of one item_id make one item with all their
terms; a null item_id is an item. Items without terms, and tables without rows, give nothing. Other columns are not read. A
very long text is split into words in memory, a few times its size.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small

LEAF, FAN = 64, 8
#: What each byte of a text becomes: separators a space, capitals small letters.
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() and not chr(c).isupper() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def words(raw: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text, with repeats, in order."""
    return raw.translate(_FOLD).split() if raw else []


def asked_terms(items: pa.Table) -> tuple[list, list[np.ndarray], dict[bytes, int]]:
    """Item ids, each one's term numbers, and the numbers of all terms, of ``items(item_id, text)`` in bytes."""
    number: dict[bytes, int] = {}
    own: dict = defaultdict(set)
    for item, raw in zip(items.column(0).to_pylist(), items.column(1).to_pylist()):
        own[item].update(number.setdefault(w, len(number)) for w in words(raw))
    own = {item: terms for item, terms in own.items() if terms}
    return list(own), [np.array(sorted(terms), np.int64) for terms in own.values()], number


def index_documents(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, tfs``: each document's number of terms, and how often it holds those of ``number``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sizes, terms, tfs, ends = [], [], [], [0]
            for raw in batch.column(1).to_pylist():
                own = words(raw)
                sizes.append(len(own))
                for word, tf in Counter(own).items():
                    if (t := number.get(word)) is not None:
                        terms.append(t)
                        tfs.append(tf)
                ends.append(len(terms))
            lists = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tfs array<int>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """What an occurrence count is worth in a document of ``n`` terms, in whole numbers."""
    m = 50 + (50 * n * n_docs) // max(1, total)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class MaxTree:
    """A shard of documents with each term's highest impact over nested ranges of them."""

    def __init__(self, ends: np.ndarray, terms: np.ndarray, impact: np.ndarray, n_terms: int) -> None:
        self.n, self.ends, self.terms, self.impact = len(ends) - 1, ends, terms, impact
        self.doc = np.repeat(np.arange(self.n), np.diff(ends))
        nodes = max(1, -(-self.n // LEAF))
        level = np.zeros((n_terms, nodes), np.int64)
        cell = terms.astype(np.int64) * nodes + self.doc // LEAF
        order = np.argsort(cell, kind="stable")
        if len(order):
            begins = np.flatnonzero(np.diff(cell[order], prepend=-1))
            level.ravel()[cell[order][begins]] = np.maximum.reduceat(impact[order], begins)
        self.levels = [level]
        while nodes > FAN:
            level = np.pad(level, ((0, 0), (0, -nodes % FAN))).reshape(n_terms, -1, FAN).max(2)
            nodes = level.shape[1]
            self.levels.append(level)

    def bounds(self, level: int, begin: int, end: int, terms: np.ndarray, weights: np.ndarray) -> list[int]:
        """The most that a document in each of a level's nodes ``begin`` to ``end`` can score."""
        return (weights @ self.levels[level][terms, begin:end]).tolist()

    def scored(self, node: int, by_term: np.ndarray) -> tuple[int, np.ndarray]:
        """The number of a range's first document, and the exact scores of its documents."""
        first, last = node * LEAF, min(self.n, (node + 1) * LEAF)
        a, b = self.ends[first], self.ends[last]
        # Whole numbers far below 2^53: sums of doubles are exact.
        return first, np.bincount(self.doc[a:b] - first, by_term[self.terms[a:b]] * self.impact[a:b], last - first).astype(np.int64)


def search_shard(tree: MaxTree, doc_ids: list, terms: np.ndarray, weights: np.ndarray, by_term: np.ndarray, held: list[tuple], k: int) -> int:
    """Puts the shard's best documents into ``held``, sorted tuples of minus score, id missing, id. Returns the ranges scored."""
    top, opened = len(tree.levels) - 1, 0
    heap = [(-b, top, i) for i, b in enumerate(tree.bounds(top, 0, tree.levels[top].shape[1], terms, weights))]
    heapq.heapify(heap)
    least = -held[k - 1][0] if len(held) >= k else 1
    while heap and -heap[0][0] >= least:
        _, level, node = heapq.heappop(heap)
        if level:
            begin = node * FAN
            for i, b in enumerate(tree.bounds(level - 1, begin, min(begin + FAN, tree.levels[level - 1].shape[1]), terms, weights), begin):
                if b >= least:
                    heapq.heappush(heap, (-b, level - 1, i))
            continue
        opened += 1
        first, scores = tree.scored(node, by_term)
        found = np.flatnonzero(scores >= least)
        if len(found):
            held += [(-s, doc_ids[first + i] is None, doc_ids[first + i]) for i, s in zip(found.tolist(), scores[found].tolist())]
            held.sort(key=lambda x: x[:2] if x[1] else x)
            del held[k:]
            if len(held) == k:
                least = -held[-1][0]
    return opened


def best_of_index(index: DataFrame, ids: list, own: list[np.ndarray], weights: np.ndarray, n_docs: int, total: int, k: int, item_type: pa.DataType, shard_cells: int = 1 << 21) -> DataFrame:
    """``item_id, doc_id, score``: the best ``k`` of each task's documents for each item.

    A shard has at most ``shard_cells`` cells of terms by ranges (or one range's), so its size doesn't grow with the table.
    """
    fields = {f.name: f.dataType.simpleString() for f in index.schema}
    step = LEAF * max(1, min(512, shard_cells // max(1, len(weights))))
    spark_type = {"int64": "long", "int32": "int"}.get(str(item_type), "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = [[] for _ in ids]
        by_term = np.zeros(len(weights))
        doc_type = None
        for shard in shards(batches, step):
            doc_type = shard.schema.field("doc_id").type
            lists, doc_ids = shard.column("terms").combine_chunks(), shard.column("doc_id").to_pylist()
            ends = lists.offsets.to_numpy().astype(np.int64)
            terms, tf = lists.values.to_numpy()[ends[0] : ends[-1]], shard.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
            ends = ends - ends[0]
            n = np.repeat(shard.column("n").to_numpy(), np.diff(ends))
            tree = MaxTree(ends, terms, impacts(tf, n, n_docs, total), len(weights))
            for i, asked in enumerate(own):
                by_term[asked] = weights[asked]
                search_shard(tree, doc_ids, asked, weights[asked], by_term, held[i], k)
                by_term[asked] = 0
        for item, best in zip(ids, held):
            if best:
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(best), item_type), pa.array([d for _, _, d in best], doc_type), pa.array([-s for s, _, _ in best], pa.int64())], names=["item_id", "doc_id", "score"])

    return index.mapInArrow(run, f"item_id {spark_type}, doc_id {fields['doc_id']}, score long")


def shards(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[pa.Table]:
    """The documents of the batches that hold some asked term, in tables of ``step`` rows, the last one shorter."""
    waiting, rows = [], 0
    for batch in batches:
        batch = batch.filter(pc.greater(pc.list_value_length(batch.column(2)), 0))
        while batch.num_rows:
            part = batch.slice(0, step - rows)
            waiting.append(part)
            rows += part.num_rows
            batch = batch.slice(part.num_rows)
            if rows == step:
                yield pa.Table.from_batches(waiting)
                waiting, rows = [], 0
    if rows:
        yield pa.Table.from_batches(waiting)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, *, k: int = 50, block_items: int = 2000, block_bytes: int = 8 << 20) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best of ``docs(doc_id, text)`` for each of ``items(item_id, text)``."""
    asked = items.select("item_id", F.col("text").cast("binary").alias("text"))
    count, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks, found = max(1, -(-count // block_items), -(-size // block_bytes)), []
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        rows = part.toArrow()
        ids, own, number = asked_terms(rows)
        index = cut(index_documents(docs, number))
        n_docs, total = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        # One row for each asked term at most.
        df = np.zeros(len(number), np.int64)
        counted = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()
        df[counted.column("term").to_numpy()] = counted.column("df").to_numpy()
        weights = np.array([weight(n_docs, x) for x in df.tolist()], np.int64)
        found.append(best_of_index(index, ids, own, weights, n_docs, total, k, rows.schema.field("item_id").type))
    return ranked(reduce(DataFrame.unionByName, found), k)
