"""Ranking a corpus for a table of queries.

Corpus: ``id, url, title, text, anchor, last_modified, jurisdiction, place_ids``; queries:
``query_id, q``. The queries are the stated, small side, taken in blocks: they meet the corpus where it
lies, and only each task's best documents for each query move.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hash_bucket, snippet, tokenize
from ..functions.urls import host_matches_site, parse_host
from .sizes import broadcast_if_small, is_small

K1, B, EPSILON = 1.5, 0.75, 0.25
OVERFETCH, TOP_K, MOST_TOP_K = 6, 10, 100
RRF_K = 60
VECTOR_DIM = 512


def clamp_top_k(k: int | None) -> int:
    return TOP_K if k is None else max(1, min(MOST_TOP_K, int(k)))


def document_tokens(corpus: DataFrame) -> DataFrame:
    """``id, tokens, dl`` of title and text."""
    tokens = tokenize(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))))
    return corpus.select("id", tokens.alias("tokens")).select("id", "tokens", F.size("tokens").alias("dl"))


def document_counts(corpus: DataFrame) -> DataFrame:
    """``id, terms, tfs, dl``: each document's different terms in order and how often it holds each, counted in the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(1)
            sizes, names = tokens.value_lengths().to_numpy(), tokens.flatten().dictionary_encode()
            # Numbers in the order of the terms, so that a document's cells come sorted.
            rank = np.empty(len(names.dictionary), np.int64)
            by_name = pc.sort_indices(names.dictionary).to_numpy()
            rank[by_name] = np.arange(len(by_name))
            cells, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * max(1, len(rank)) + rank[names.indices.to_numpy()], return_counts=True)
            doc, term = np.divmod(cells, max(1, len(rank)))
            ends = pa.array(np.searchsorted(doc, np.arange(len(sizes) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, names.dictionary.take(pa.array(by_name[term]))), pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32))), batch.column(2)], names=["id", "terms", "tfs", "dl"])

    return document_tokens(corpus).mapInArrow(run, f"id {corpus.schema['id'].dataType.simpleString()}, terms array<string>, tfs array<int>, dl int")


def term_frequencies(corpus: DataFrame) -> DataFrame:
    """``id, term, tf``, counted in the row: nothing is shuffled. Rows of one id are documents of their own."""
    pairs = document_counts(corpus).select("id", F.explode(F.arrays_zip("terms", "tfs")).alias("x"))
    return pairs.select("id", F.col("x.terms").alias("term"), F.col("x.tfs").cast("long").alias("tf"))


def document_frequencies(corpus: DataFrame) -> DataFrame:
    """``term, df``. Terms are made distinct in the row, so only partial counts by term are shuffled."""
    return document_tokens(corpus).select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(corpus: DataFrame) -> DataFrame:
    """One row: ``n_docs, avg_dl``; documents without tokens count."""
    return document_tokens(corpus).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"))


def term_idf(frequencies: DataFrame, stats: DataFrame) -> DataFrame:
    """``term, idf``; a negative value becomes a quarter of the mean over all terms, negatives included."""
    n = stats.select(F.struct("n_docs", "avg_dl")).scalar()["n_docs"]
    raw = frequencies.select("term", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw")).scalar()
    return raw.select("term", F.when(F.col("raw") < 0, EPSILON * mean).otherwise(F.col("raw")).alias("idf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, term, repeats``."""
    return queries.select("query_id", F.explode(tokenize(F.col("q"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("repeats"))


def split_blank_queries(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries with something in them, and the rejected rest."""
    ok = F.length(F.trim(F.coalesce("q", F.lit("")))) > 0
    return queries.where(ok), queries.where(~ok)


@dataclass(frozen=True)
class CorpusStats:
    """Documents, their mean length, and the mean raw idf of the corpus's terms."""

    n_docs: int
    avg_dl: float
    mean_idf: float


def corpus_terms(corpus: DataFrame) -> DataFrame:
    """``term, df, dl`` in one pass over the texts. The row without a term stands for all documents: their number and total length."""
    terms = F.concat(F.array_distinct("tokens"), F.array(F.lit(None).cast("string")))
    rows = document_tokens(corpus).select(F.explode(terms).alias("term"), "dl")
    return rows.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("dl"))


def raw_idf(n_docs: int) -> Column:
    return F.log(n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def measure_corpus(terms: DataFrame) -> CorpusStats:
    """The figures of a corpus from its terms."""
    n_docs, dl = terms.where("term IS NULL").agg(F.sum("df"), F.sum("dl")).first()
    n_docs = n_docs or 0
    # Terms of one df share a raw idf: summed by df, the mean doesn't depend on the order of many terms.
    by_df = terms.where("term IS NOT NULL").groupBy("df").agg(F.count("*").alias("terms"))
    total, n_terms = by_df.agg(F.sum(raw_idf(n_docs) * F.col("terms")), F.sum("terms")).first()
    return CorpusStats(n_docs, (dl or 0) / max(1, n_docs), total / n_terms if n_terms else 0.0)


def term_weights(terms: DataFrame, queries: DataFrame, stats: CorpusStats) -> DataFrame:
    """``query_id, term, weight``: idf times the term's repeats in the query; 0 for a term that no document holds."""
    raw = raw_idf(stats.n_docs)
    idf = F.when(raw < 0, EPSILON * stats.mean_idf).otherwise(raw)
    return query_terms(queries).join(terms.where("term IS NOT NULL"), "term", "left").select("query_id", "term", F.coalesce(F.col("repeats") * idf, F.lit(0.0)).alias("weight"))


def rank_within(scored: DataFrame, score: str = "score", digits: int = 9) -> Column:
    """Place in a query by score, then id. Scores count to ``digits`` places, so that the order of summation makes no difference."""
    return F.row_number().over(Window.partitionBy("query_id").orderBy(F.round(score, digits).desc(), "id"))


def top_by_score(scored: DataFrame, k: int) -> DataFrame:
    return scored.withColumn("rank", rank_within(scored)).where(F.col("rank") <= k)


def best_of_task(score: Callable[[pa.RecordBatch], np.ndarray], names: list[str], k: int, digits: int = 9) -> Callable:
    """For ``mapInArrow``: the best ``k`` of a task's documents for each query, by score to ``digits`` places, then id.

    ``score`` gives the scores of a batch, documents by queries; a batch's first column is the id. Batches are cut so that a
    matrix of scores holds 400,000 at most, or one document's.
    """
    step = max(1, 400_000 // max(1, len(names)))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, scores = [np.empty(0, object)] * len(names), [np.empty(0)] * len(names)
        # The k-th score that each query holds: only documents that reach it are looked at.
        least = np.full(len(names), -np.inf)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                own = batch.slice(at, step)
                found = score(own)
                rounded = np.round(found, digits)
                asked, rows = np.nonzero((rounded >= least[None, :]).T)
                if not len(rows):
                    continue
                doc_ids = np.array(own.column(0).to_pylist(), object)
                begins = np.searchsorted(asked, np.arange(len(names) + 1))
                for j in np.flatnonzero(np.diff(begins)).tolist():
                    new = rows[begins[j] : begins[j + 1]]
                    if len(new) > 4 * k:
                        # All that reach the batch's own k-th score, those that tie with it too.
                        new = new[rounded[new, j] >= np.partition(rounded[new, j], -k)[-k]]
                    merged, whose = np.concatenate([scores[j], found[new, j]]), np.concatenate([ids[j], doc_ids[new]])
                    first = np.lexsort((whose.astype(str), -np.round(merged, digits)))[:k]
                    scores[j], ids[j] = merged[first], whose[first]
                    if len(first) == k:
                        least[j] = np.round(merged[first[-1]], digits)
        for name, own_ids, own_scores in zip(names, ids, scores):
            if len(own_ids):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(own_ids), pa.string()), pa.array(own_ids.tolist(), pa.string()), pa.array(own_scores)], names=["query_id", "id", "score"])

    return best


def by_block(asked: DataFrame, search: Callable[[DataFrame], DataFrame], k: int, block: int) -> DataFrame:
    """The best ``k`` of each query from ``search`` over the queries; more than ``block`` are dealt out by a hash to as many blocks as they need."""
    blocks = max(1, -(-asked.count() // block))
    found = [search(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else asked) for b in range(blocks)]
    return top_by_score(reduce(DataFrame.unionByName, found), k)


def bm25_of(weights: pa.Table, names: list[str], avg_dl: float) -> Callable[[pa.RecordBatch], np.ndarray]:
    """Scores of a batch of (id, tokens): each distinct term of a document meets the queries that ask for it."""
    terms = weights.column("term").unique()
    term = pc.index_in(weights.column("term"), value_set=terms).to_numpy()
    order = np.argsort(term, kind="stable")
    asker = pc.index_in(weights.column("query_id"), value_set=pa.array(names, pa.string())).to_numpy()[order]
    weight = weights.column("weight").to_numpy()[order]
    begins = np.searchsorted(term[order], np.arange(len(terms) + 1))

    def score(batch: pa.RecordBatch) -> np.ndarray:
        tokens, n = batch.column(1), batch.num_rows
        dl = tokens.value_lengths().to_numpy()
        held = pc.index_in(tokens.flatten(), value_set=terms)
        pairs = np.repeat(np.arange(n), dl)[held.is_valid().to_numpy(zero_copy_only=False)] * len(terms) + held.drop_null().to_numpy()
        pairs, tf = np.unique(pairs, return_counts=True)
        doc, which = np.divmod(pairs, max(1, len(terms)))
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[doc] / (avg_dl or 1.0)))
        askers = begins[which + 1] - begins[which]
        at = np.arange(askers.sum()) + np.repeat(begins[which] - (np.cumsum(askers) - askers), askers)
        where = np.repeat(doc, askers) * len(names) + asker[at]
        return np.bincount(where, np.repeat(part, askers) * weight[at], n * len(names)).reshape(n, len(names))

    return score


def bm25_search(corpus: DataFrame, queries: DataFrame, k: int = TOP_K, block: int = 2000) -> DataFrame:
    """``query_id, id, score, rank``: the first ``k`` of all documents.

    Documents without a query term score 0 and take their place among the others, in order of id where scores tie; with a
    negative mean idf hits can come after them. Each task scores its documents for a block of queries and keeps its own best k
    for each, so neither postings nor (query, document) sums are shuffled; the table of terms is worked out once for all blocks.
    Queries without tokens give nothing.
    """
    docs = document_tokens(corpus).select(F.col("id").cast("string").alias("id"), "tokens")
    terms = corpus_terms(corpus).persist()
    try:
        stats = measure_corpus(terms)

        def search(part: DataFrame) -> DataFrame:
            weights = term_weights(terms, part, stats).toArrow().combine_chunks()
            names = weights.column("query_id").unique().to_pylist()
            return docs.mapInArrow(best_of_task(bm25_of(weights, names, stats.avg_dl), names, k), "query_id string, id string, score double")

        return by_block(queries.where(F.size(tokenize(F.col("q"))) > 0), search, k, block)
    finally:
        terms.unpersist()


def hashed_norms(corpus: DataFrame, width: int = VECTOR_DIM) -> DataFrame:
    """``id, norm``: Euclidean length of each document's hashed token counts, in the row. Documents without tokens have none."""
    counts = document_counts(corpus).where(F.size("terms") > 0).select("id", F.transform("terms", lambda t: hash_bucket(t, width)).alias("buckets"), "tfs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy()
            cells = np.repeat(np.arange(len(sizes)), sizes) * width + batch.column(1).flatten().to_numpy()
            cells, place = np.unique(cells, return_inverse=True)
            n = np.bincount(place, batch.column(2).flatten().to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.sqrt(np.bincount(cells // width, n * n, len(sizes))))], names=["id", "norm"])

    return counts.mapInArrow(run, f"id {corpus.schema['id'].dataType.simpleString()}, norm double")


def vector_search(corpus: DataFrame, queries: DataFrame, k: int = TOP_K, width: int = VECTOR_DIM, block: int = 2000) -> DataFrame:
    """``query_id, id, score, rank`` by cosine of hashed token counts.

    Each task multiplies batches of documents by the matrix of a block of queries and keeps its own best k
    for each; only those are shuffled. More queries than ``block`` are dealt out by a hash to as many blocks as they need.
    Counts and their products are whole numbers, so equal texts tie exactly and ties go by id. Queries without
    tokens tie all documents at 0.
    """
    buckets = F.transform("tokens", lambda t: hash_bucket(t, width)).alias("buckets")
    asked = queries.where(F.col("q").isNotNull()).select("query_id", tokenize(F.col("q")).alias("tokens")).select("query_id", buckets)
    docs = document_tokens(corpus).select(F.col("id").cast("string").alias("id"), buckets)

    def count(lists: pa.ListArray) -> np.ndarray:
        sizes = lists.value_lengths().to_numpy()
        at = np.repeat(np.arange(len(lists)), sizes) * width + lists.flatten().to_numpy()
        return np.bincount(at, minlength=len(lists) * width).reshape(len(lists), width).astype(np.float64)

    def search(part: DataFrame) -> DataFrame:
        rows = part.toArrow().combine_chunks()
        names = rows.column("query_id").to_pylist()
        asked_for = count(pa.chunked_array(rows.column("buckets")).combine_chunks()) if names else np.zeros((0, width))
        own_norm = np.sqrt((asked_for**2).sum(1))

        def cosine(batch: pa.RecordBatch) -> np.ndarray:
            m = count(batch.column(1))
            over = np.sqrt((m**2).sum(1))[:, None] * own_norm[None, :]
            return np.divide(m @ asked_for.T, over, out=np.zeros((len(m), len(names))), where=over > 0)

        return docs.mapInArrow(best_of_task(cosine, names, k), "query_id string, id string, score double")

    return by_block(asked, search, k, block)


def rrf_fuse(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists ``query_id, id, rank``."""
    parts = [x.select("query_id", "id", (F.lit(1.0) / (k + F.col("rank"))).alias("score")) for x in lists]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.groupBy("query_id", "id").agg(F.sum("score").alias("score"))


def normalize_scores(ranked: DataFrame, method: str = "zscore") -> DataFrame:
    """Scores of each query's list by population z-score, min-max, or as they are; a flat list becomes 0."""
    over = Window.partitionBy("query_id")
    s = F.col("score")
    if method == "zscore":
        mean, spread = F.avg("score").over(over), F.stddev_pop("score").over(over)
        s = F.when(spread <= 1e-12, 0.0).otherwise((s - mean) / spread)
    elif method == "minmax":
        low, high = F.min("score").over(over), F.max("score").over(over)
        s = F.when(high - low <= 1e-12, 0.0).otherwise((s - low) / (high - low))
    return ranked.withColumn("score", s)


def weighted_fuse(bm25: DataFrame, vector: DataFrame, method: str = "zscore", bm25_weight: float = 0.5, vector_weight: float = 0.5) -> DataFrame:
    """Weighted sum of normalised scores; a document missing from a list counts 0 there."""
    a = normalize_scores(bm25, method).select("query_id", "id", F.col("score").alias("bm25_part"))
    b = normalize_scores(vector, method).select("query_id", "id", F.col("score").alias("vector_part"))
    total = bm25_weight * F.coalesce("bm25_part", F.lit(0.0)) + vector_weight * F.coalesce("vector_part", F.lit(0.0))
    return a.join(b, ["query_id", "id"], "full").select("query_id", "id", total.alias("score"))


def geo_boost(title: Column, q: Column, names: list[str]) -> Column:
    """2 for each market name that stands in title or query between word boundaries."""
    hay = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(q, F.lit(""))))
    total = F.lit(0.0)
    for name in names:
        bare = name.strip().lower()
        if bare:
            total = total + F.when(hay.rlike(r"\b\Q" + bare + r"\E\b"), 2.0).otherwise(0.0)
    return total


def filter_site(df: DataFrame, site: str | None) -> DataFrame:
    return df if not site else df.where(host_matches_site(parse_host(F.col("url")), F.lit(site)))


def filter_domain_whitelist(df: DataFrame, domains: list[str] | None) -> DataFrame:
    """Hosts that match any of the domains; an empty list passes all."""
    if not domains:
        return df
    host = parse_host(F.col("url"))
    return df.where(F.exists(F.array(*map(F.lit, domains)), lambda d: host_matches_site(host, d)))


def filter_lastmod_gte(df: DataFrame, gate: str | None) -> DataFrame:
    """Drops documents modified before the gate; a date that is missing or unreadable, of either, passes."""
    limit, last = F.try_to_timestamp(F.lit(gate)), F.try_to_timestamp(F.col("last_modified"))
    return df if not gate else df.where(F.coalesce(last >= limit, F.lit(True)))


def filter_jurisdiction(df: DataFrame, jurisdiction: str | None) -> DataFrame:
    """Equal without case; documents without one pass."""
    own = F.lower(F.coalesce("jurisdiction", F.lit("")))
    return df if not jurisdiction else df.where((own == "") | (own == jurisdiction.lower()))


def filter_place_ids(df: DataFrame, places: list[str] | None) -> DataFrame:
    """Overlap without case; documents without places fail."""
    if not places:
        return df
    wanted = F.array(*[F.lit(p.lower()) for p in places])
    return df.where(F.coalesce(F.arrays_overlap(F.transform("place_ids", F.lower), wanted), F.lit(False)))


def apply_filters(df: DataFrame, *, site: str | None = None, domains: list[str] | None = None, lastmod_gte: str | None = None, jurisdiction: str | None = None, place_ids: list[str] | None = None) -> DataFrame:
    df = filter_domain_whitelist(filter_site(df, site), domains)
    return filter_place_ids(filter_jurisdiction(filter_lastmod_gte(df, lastmod_gte), jurisdiction), place_ids)


def page(ranked: DataFrame, offset: int, k: int) -> DataFrame:
    """Rows ``offset + 1`` to ``offset + k`` of each query, ranked anew, and whether more follow."""
    counted = ranked.withColumn("rank", rank_within(ranked)).withColumn("has_next", F.count("*").over(Window.partitionBy("query_id")) > offset + k)
    return counted.where(F.col("rank").between(offset + 1, offset + k))


def result_columns(df: DataFrame, vector_score: Column | None = None) -> DataFrame:
    """Adds ``anchored_url``, ``source`` and ``snippet``; rounds the score."""
    anchor = F.coalesce("anchor", F.lit(""))
    source = F.lit("local-bm25") if vector_score is None else F.when(vector_score.isNotNull(), "local-hybrid").otherwise("local-bm25")
    return (
        df.withColumn("anchored_url", F.concat(F.coalesce("url", F.lit("")), F.when(anchor != "", F.concat(F.lit("#"), anchor)).otherwise("")))
        .withColumn("source", source)
        .withColumn("snippet", snippet(F.col("text"), F.col("q")))
        .withColumn("score", F.round("score", 6))
    )


def with_documents(ranked: DataFrame, corpus: DataFrame, queries: DataFrame, most_per_query: int) -> DataFrame:
    """Ranked rows with their documents' columns and their query.

    Candidates are at most ``most_per_query`` a query, so counting the queries bounds them: they go to the corpus
    while that bound is small, and meet it in a shuffle beyond.
    """
    asked = ranked.join(broadcast_if_small(queries.select("query_id", "q")), "query_id")
    small = is_small(queries, 500_000 // most_per_query)
    return corpus.join(F.broadcast(asked) if small else asked, "id")


def both_lists(bm25: DataFrame, vector: DataFrame, method: str = "none") -> DataFrame:
    """One row for each document of either list, with the rank, score and normalised score (``part``) it has in each, null where it has none."""

    def named(ranked: DataFrame, name: str) -> DataFrame:
        part = normalize_scores(ranked.select("query_id", "id", "rank", "score", F.col("score").alias("own")), method)
        return part.select("query_id", "id", F.col("rank").alias(f"{name}_rank"), F.col("own").alias(f"{name}_score"), F.col("score").alias(f"{name}_part"))

    return named(bm25, "bm25").join(named(vector, "vector"), ["query_id", "id"], "full")


def search_query(corpus: DataFrame, queries: DataFrame, *, k: int | None = None, offset: int = 0, names: list[str] = (), **filters) -> DataFrame:
    """BM25 candidates, local boost, filters, paging, snippets, in that order."""
    k = clamp_top_k(k)
    found = with_documents(bm25_search(corpus, queries, OVERFETCH * k).drop("rank"), corpus, queries, OVERFETCH * k)
    boosted = found.withColumn("score", F.col("score") + geo_boost(F.col("title"), F.col("q"), list(names)))
    return result_columns(page(apply_filters(boosted, **filters), offset, k))


def search_hybrid(corpus: DataFrame, queries: DataFrame, *, mode: str = "rrf", method: str = "zscore", k: int | None = None, offset: int = 0, **filters) -> DataFrame:
    """BM25 and vector candidates fused, then filters, paging, snippets and both scores.

    A document that BM25 didn't list has a null ``bm25_score``; one that the vectors didn't list a null
    ``vector_score``.
    """
    k = clamp_top_k(k)
    bm25, vector = bm25_search(corpus, queries, OVERFETCH * k), vector_search(corpus, queries, OVERFETCH * k)
    # Each list is worked out once: its ranks and scores travel together through fusion to the result.
    lists = both_lists(bm25, vector, "none" if mode == "rrf" else method)

    def of(name: str) -> Column:
        return F.lit(1.0) / (RRF_K + F.col(f"{name}_rank")) if mode == "rrf" else 0.5 * F.col(f"{name}_part")

    fused = lists.withColumn("score", F.coalesce(of("bm25"), F.lit(0.0)) + F.coalesce(of("vector"), F.lit(0.0)))
    shown = page(apply_filters(with_documents(fused, corpus, queries, 2 * OVERFETCH * k), **filters), offset, k)
    shown = shown.withColumns({c: F.round(c, 6) for c in ("bm25_score", "vector_score")})
    return result_columns(shown, F.col("vector_score")).withColumn("fusion", F.lit("rrf" if mode == "rrf" else "weighted"))


def corpus_upsert(base: DataFrame, delta: DataFrame, order: str) -> DataFrame:
    """``base`` with the last row by ``order`` of each id in ``delta`` put in its place or added."""
    last = delta.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy(F.col(order).desc()))).where("__n = 1").select(*base.columns)
    return base.join(last.select("id"), "id", "left_anti").unionByName(last)
