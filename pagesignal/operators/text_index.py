"""A stored inverted index over a corpus, kept up by batches, searched by BM25 with block-max skipping.

Tables below the index's folder, each batch in ``batch=<n>`` of its own:

- ``postings``: a row for each term of each shard of ``shard_docs`` documents, with the documents (by number in the shard) and their counts, and for each
  range of ``BLOCK`` documents where the term occurs the highest count and the least document length there. Rows are sorted by term.
- ``documents``: a row for each shard with ids and lengths in order.
- ``gone``: documents of earlier batches that the batch replaced. ``terms``: what the batch adds to each term's document count, less what it
  took away. ``figures``: the same for the number of documents and their total length.

A batch tokenises its own documents and no others; what it replaces is looked up in the postings. A search reads the rows of the asked terms, brings them
together by shard, and scores each query there: the bound of a range is the sum of its terms' weights with the highest count
and the least length of the range, which holds whatever the mean length is by then. Ranges whose bound is below the k-th score held are
skipped, so the result is that of ``bm25_search``. Only each shard's best documents are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokenize
from . import search as S
from .runs import by_group, group_starts

BLOCK = 128
_POSTINGS = "shard long, term string, docs array<int>, tfs array<int>, blocks array<int>, most array<int>, least array<int>"
_DOCUMENTS = "shard long, ids array<string>, lengths array<int>"


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``shard, id, terms, tfs, dl`` of whole shards in order, into postings (kind 0) and the shard's documents (kind 1)."""
    for table in by_group(batches, 1):
        for a, b in _runs(table):
            own = table.slice(a, b - a).combine_chunks()
            lists = own.column("terms").combine_chunks()
            sizes, flat = lists.value_lengths().to_numpy(), lists.flatten()
            tf, dl = own.column("tfs").combine_chunks().flatten().to_numpy(), own.column("dl").to_numpy()
            doc = np.repeat(np.arange(len(own)), sizes)
            names = flat.dictionary_encode()
            term = names.indices.to_numpy()
            order = np.lexsort((doc, term))
            doc, tf, term = doc[order], tf[order], term[order]
            begins = np.flatnonzero(np.diff(term, prepend=-1))
            cell = term.astype(np.int64) * (1 << 32) + doc // BLOCK
            cells = np.flatnonzero(np.diff(cell, prepend=-1))
            ends = np.append(begins, len(term)).astype(np.int32)
            at = np.append(np.searchsorted(cells, begins), len(cells)).astype(np.int32)
            int_lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))
            none = np.zeros(0)
            most = np.maximum.reduceat(tf, cells) if len(cells) else none
            least = np.minimum.reduceat(dl[doc], cells) if len(cells) else none
            shard, n = own.column("shard")[0].as_py(), len(begins)
            empty, shards = np.zeros(n + 1, np.int32), pa.array([shard] * n, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * n, pa.int32()), shards, names.dictionary.take(pa.array(term[begins])), int_lists(ends, doc), int_lists(ends, tf), int_lists(at, doc[cells] // BLOCK if len(cells) else none), int_lists(at, most), int_lists(at, least), pa.ListArray.from_arrays(pa.array(empty), pa.array([], pa.string())), int_lists(empty, none)],
                names=["kind", "shard", "term", "docs", "tfs", "blocks", "most", "least", "ids", "lengths"],
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array([1], pa.int32()), pa.array([shard], pa.int64()), pa.array([None], pa.string()), *(pa.array([[]], pa.list_(pa.int32())) for _ in range(5)), pa.array([own.column("id").to_pylist()], pa.list_(pa.string())), pa.array([dl.tolist()], pa.list_(pa.int32()))],
                names=["kind", "shard", "term", "docs", "tfs", "blocks", "most", "least", "ids", "lengths"],
            )


def _runs(table: pa.Table) -> list[tuple[int, int]]:
    begins = group_starts(table, 1).tolist()
    return list(zip(begins, [*begins[1:], table.num_rows]))


class TextIndex:
    """An index in a folder that all executors see. Ids are texts; a document that comes again replaces the one before."""

    def __init__(self, spark: SparkSession, path: str, shard_docs: int = 4096) -> None:
        self.spark, self.path, self.shard_docs = spark, path.rstrip("/"), shard_docs

    def _fs(self) -> tuple[Any, Any]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path, path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self, below: int | None = None) -> list[int]:
        """The batches that are whole: their ``figures`` are written last."""
        path, fs = self._fs()
        if not fs.exists(path(self.path)):
            return []
        found = [int(s.getPath().getName().removeprefix("batch=")) for s in fs.listStatus(path(self.path)) if fs.exists(path(s.getPath(), "figures/_SUCCESS"))]
        return sorted(b for b in found if below is None or b < below)

    def _read(self, name: str, batches: list[int]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/batch={b}/{name}" for b in batches])

    def append(self, corpus: DataFrame, batch: int, order: str | None = None) -> None:
        """Take in documents as a numbered batch; one that is run again replaces what it wrote.

        Rows without an id are left out; of rows with one id the last by ``order`` counts, or any one where there is no order.
        """
        folder, earlier = f"{self.path}/batch={batch}", self.batches(batch)
        rows = corpus.where("id IS NOT NULL").withColumn("id", F.col("id").cast("string"))
        text = F.struct("title", "text")
        last = rows.groupBy("id").agg((F.max_by(text, order) if order else F.any_value(text)).alias("t")).select("id", "t.title", "t.text")
        counts = S.document_counts(last)
        # Shards go by a hash, so each has about as many documents; they are dealt out before the counts are sorted by shard.
        shards = max(1, -(-last.count() // self.shard_docs))
        dealt = counts.withColumn("shard", F.lit(batch << 32) + F.pmod(F.xxhash64("id"), F.lit(shards))).select("shard", "id", "terms", "tfs", F.col("dl").cast("int").alias("dl"))
        made = dealt.repartition("shard").sortWithinPartitions("shard", "id").mapInArrow(_post, f"kind int, {_POSTINGS}, ids array<string>, lengths array<int>")
        made.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/made")
        made = self.spark.read.schema(f"kind int, {_POSTINGS}, ids array<string>, lengths array<int>").parquet(f"{folder}/made")
        docs = made.where("kind = 1")
        # Sorted by term, so a search for some terms skips most of each file.
        made.where("kind = 0").select(*[c.split()[0] for c in _POSTINGS.split(", ")]).repartitionByRange("term", "shard").sortWithinPartitions("term", "shard").write.mode("overwrite").parquet(f"{folder}/postings")
        docs.select("shard", "ids", "lengths").write.mode("overwrite").parquet(f"{folder}/documents")
        path, fs = self._fs()
        fs.delete(path(f"{folder}/made"), True)
        # What stood before under these ids.
        none = self.spark.createDataFrame([], "shard long, doc int, dl int")
        gone = none
        if earlier:
            held = self._read("documents", earlier).select("shard", F.posexplode(F.arrays_zip("ids", "lengths")).alias("doc", "d")).select("shard", "doc", "d.ids", "d.lengths")
            taken = self._read("gone", earlier).select("shard", "doc")
            ids = self._read("documents", [batch]).select(F.explode("ids").alias("ids"))
            gone = held.join(taken, ["shard", "doc"], "left_anti").join(ids, "ids", "left_semi").select("shard", "doc", F.col("lengths").alias("dl"))
        gone.write.mode("overwrite").parquet(f"{folder}/gone")
        gone = self._read("gone", [batch])
        own = self._read("postings", [batch]).select("term", F.size("docs").alias("df"))
        if earlier:
            left = self._read("postings", earlier).select("shard", "term", F.explode("docs").alias("doc")).join(gone, ["shard", "doc"], "left_semi").select("term", F.lit(-1).alias("df"))
            own = own.unionByName(left)
        own.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0").write.mode("overwrite").parquet(f"{folder}/terms")
        figures = self._read("documents", [batch]).select(F.size("ids").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("dl"))
        figures = figures.unionByName(gone.select(F.lit(-1).alias("n"), (-F.col("dl")).cast("long").alias("dl")))
        figures.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).write.mode("overwrite").parquet(f"{folder}/figures")

    def terms(self) -> DataFrame:
        """``term, df, dl`` as ``corpus_terms`` gives them, from the stored sums: the row without a term stands for all documents."""
        batches = self.batches()
        df = self._read("terms", batches).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0").withColumn("dl", F.lit(None).cast("long"))
        return df.unionByName(self._read("figures", batches).select(F.lit(None).cast("string").alias("term"), F.col("n").alias("df"), "dl").groupBy("term").agg(F.sum("df").alias("df"), F.sum("dl").alias("dl")))

    def documents(self) -> DataFrame:
        """``shard, ids, lengths, gone``: the shards, with the numbers of the documents that later batches replaced."""
        batches = self.batches()
        gone = self._read("gone", batches).groupBy("shard").agg(F.collect_set("doc").alias("gone"))
        return self._read("documents", batches).join(gone, "shard", "left")

    def search(self, queries: DataFrame, k: int = S.TOP_K, block: int = 2000, figures: bool = False) -> DataFrame:
        """``query_id, id, score, rank``, as ``bm25_search`` gives them for the documents that stand.

        ``figures``: instead ``query_id, shard, postings, scored, blocks, opened``: the postings of the query's terms in each shard and how many of them were
        scored, and the same of ranges.
        """
        batches = self.batches()
        if not batches:
            raise ValueError("the index has no batch")
        terms = self.terms().persist()
        try:
            stats = S.measure_corpus(terms)
            asked = queries.where(F.size(tokenize(F.col("q"))) > 0)

            def one(part: DataFrame) -> DataFrame:
                weights = S.term_weights(terms, part, stats).toArrow().combine_chunks()
                # No more terms than a block of queries asks for.
                wanted = self.spark.createDataFrame([(t,) for t in weights.column("term").unique().to_pylist()], "term string")
                rows = self._read("postings", batches).join(F.broadcast(wanted), "term", "left_semi")
                schema = "query_id string, shard long, postings long, scored long, blocks long, opened long" if figures else "query_id string, id string, score double"
                return self.documents().groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(_best_of_shard(weights, stats.avg_dl, k, figures), schema)

            if not figures:
                return S.by_block(asked, one, k, block)
            blocks = max(1, -(-asked.count() // block))
            return reduce(DataFrame.unionByName, [one(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)) for b in range(blocks)])
        finally:
            terms.unpersist()


def _part(tf: np.ndarray, dl: np.ndarray, avg_dl: float) -> np.ndarray:
    return tf * (S.K1 + 1) / (tf + S.K1 * (1 - S.B + S.B * dl / (avg_dl or 1.0)))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(), lists.value_lengths().to_numpy()


def _best_of_shard(weights: pa.Table, avg_dl: float, k: int, figures: bool, digits: int = 9):
    names = weights.column("query_id").unique().to_pylist()
    asker = pc.index_in(weights.column("query_id"), value_set=pa.array(names, pa.string())).to_numpy()
    order = np.argsort(asker, kind="stable")
    asked_terms, asked_weights = weights.column("term").take(pa.array(order)), weights.column("weight").to_numpy()[order]
    begins = np.searchsorted(asker[order], np.arange(len(names) + 1))

    def best(documents: pa.Table, postings: pa.Table) -> pa.Table:
        if not documents.num_rows:
            return _table([], figures)
        ids = np.array(documents.column("ids")[0].as_py(), object)
        dl = documents.column("lengths").combine_chunks().flatten().to_numpy()
        stands = np.ones(len(ids), bool)
        stands[documents.column("gone")[0].as_py() or []] = False
        by_id = np.empty(len(ids), np.int64)
        by_id[np.argsort(ids.astype(str), kind="stable")] = np.arange(len(ids))
        n_blocks = -(-len(ids) // BLOCK)
        doc, sizes = _flat(postings.column("docs"))
        tf, _ = _flat(postings.column("tfs"))
        part = _part(tf, dl[doc] if len(doc) else doc, avg_dl)
        n_terms = postings.num_rows
        # The highest part of each term in each range, and where its postings of the range begin.
        most, per = _flat(postings.column("most"))
        high = np.zeros((n_terms, n_blocks))
        high[np.repeat(np.arange(n_terms), per), _flat(postings.column("blocks"))[0]] = _part(most, _flat(postings.column("least"))[0], avg_dl)
        cell = np.repeat(np.arange(n_terms), sizes) * n_blocks + doc // BLOCK
        at = np.searchsorted(cell, np.arange(n_terms * n_blocks + 1))
        place = pc.index_in(asked_terms, value_set=postings.column("term").combine_chunks())
        place = pc.fill_null(place, -1).to_numpy()
        rows = []
        for q, name in enumerate(names):
            own, w = place[begins[q] : begins[q + 1]], asked_weights[begins[q] : begins[q + 1]]
            own, w = own[own >= 0], w[own >= 0]
            # A term of negative weight raises no score, so a document without it is the best case. The margin is that of sums of doubles.
            bound = np.maximum(w, 0) @ high[own] + 1e-9 if len(own) else np.zeros(n_blocks)
            by_bound = np.argsort(-bound, kind="stable")
            scores = np.full(len(ids), -np.inf)
            done = touched = 0
            least, step = -np.inf, 1
            # Ranges from the highest bound down, twice as many at each step, until none that is left can reach the k-th score.
            while done < n_blocks and bound[by_bound[done]] >= least - 1e-8:
                more = by_bound[done : done + step]
                more = more[bound[more] >= least - 1e-8]
                touched += _score(scores, np.sort(more), own, w, at, doc, part, n_blocks)
                done, step = done + len(more), 2 * step
                scores[~stands] = -np.inf
                if len(scores) >= k:
                    least = np.round(np.partition(scores, -k)[-k], digits)
            if figures:
                rows.append((name, documents.column("shard")[0].as_py(), int(sizes[own].sum()), touched, n_blocks, done))
                continue
            rounded = np.round(scores, digits)
            top = np.lexsort((by_id, -rounded))[:k]
            rows += [(name, ids[i], float(scores[i])) for i in top.tolist() if scores[i] > -np.inf]
        return _table(rows, figures)

    return best


def _score(scores: np.ndarray, blocks: np.ndarray, own: np.ndarray, w: np.ndarray, at: np.ndarray, doc: np.ndarray, part: np.ndarray, n_blocks: int) -> int:
    """Scores the documents of some ranges; returns how many postings that took."""
    for b in blocks.tolist():
        scores[b * BLOCK : (b + 1) * BLOCK] = 0
    cells = (own[:, None] * n_blocks + blocks[None, :]).ravel()
    sizes = at[cells + 1] - at[cells]
    total = int(sizes.sum())
    if total:
        which = np.arange(total) + np.repeat(at[cells] - (np.cumsum(sizes) - sizes), sizes)
        np.add.at(scores, doc[which], part[which] * np.repeat(np.repeat(w, len(blocks)), sizes))
    return total


def _table(rows: list[tuple], figures: bool) -> pa.Table:
    names = ["query_id", "shard", "postings", "scored", "blocks", "opened"] if figures else ["query_id", "id", "score"]
    types = [pa.string(), *([pa.int64()] * 5)] if figures else [pa.string(), pa.string(), pa.float64()]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
