"""The stored index against BM25 over the documents themselves."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pagesignal.operators import search, text_index

CORPUS = "id string, title string, text string, seq long"


def documents(rng, ids, words=80):
    vocabulary = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return [(str(i), rng.choice(["", "w1", "title w7", None]), " ".join(rng.choices(vocabulary, weights, k=rng.choice([0, 1, 5, 30, 80]))), n) for n, i in enumerate(ids)]


def ranked(df):
    return sorted((r.query_id, r.rank, r.id, round(r.score, 6)) for r in df.collect())


@pytest.fixture
def queries(spark):
    rng = random.Random(9)
    rows = [(f"q{i}", " ".join(f"w{rng.randrange(80)}" for _ in range(rng.choice([1, 2, 6])))) for i in range(12)]
    return spark.createDataFrame([*rows, ("rare", "w79 w78"), ("none", "zzz"), ("blank", " "), ("twice", "w3 w3 w9")], "query_id string, q string")


@pytest.mark.parametrize("shard_docs", [150, 4096])
def test_search_is_that_of_bm25_after_every_batch(spark, tmp_path, queries, shard_docs):
    rng = random.Random(shard_docs)
    index, held = text_index.TextIndex(spark, f"{tmp_path}/i", shard_docs), {}
    with pytest.raises(ValueError):
        index.search(queries)
    for batch, ids in enumerate([range(700), [*range(600, 900), *range(640, 660)], [], [5, 5, 5, 2000], range(0, 900, 2)]):
        rows = documents(rng, ids)
        given = spark.createDataFrame([*rows, (None, "no", "id", 0)], CORPUS).withColumns({c: F.lit(1) for c in ("shard", "doc", "terms", "dl", "kind")})
        index.append(given, batch, "seq")
        if batch == 1:
            index.append(given, batch, "seq")  # run again
        held.update({r[0]: r for r in rows})
        corpus = spark.createDataFrame(list(held.values()), CORPUS)
        assert ranked(index.search(queries, 10)) == ranked(search.bm25_search(corpus, queries, 10))
    assert ranked(index.search(queries, 10, block=3)) == ranked(search.bm25_search(corpus, queries, 10))
    terms = {r.term: r.df for r in index.terms().collect()}
    assert terms == {r.term: r.df for r in search.corpus_terms(corpus).collect()}


def test_ranges_that_can_not_reach_the_best_are_skipped(spark, tmp_path):
    """Rare terms stand in few ranges: most postings of a query are left alone, and the result is the same."""
    rows = [(str(i), "", "common " * (1 + i % 3) + ("rare " * 3 if i % 997 == 0 else "") + "filler " * (i % 40), i) for i in range(8000)]
    corpus = spark.createDataFrame(rows, CORPUS)
    index = text_index.TextIndex(spark, f"{tmp_path}/i", 8000)
    index.append(corpus, 0)
    queries = spark.createDataFrame([("q", "rare common")], "query_id string, q string")
    assert ranked(index.search(queries, 5)) == ranked(search.bm25_search(corpus, queries, 5))
    figures = index.search(queries, 5, figures=True).agg(F.sum("postings").alias("postings"), F.sum("scored").alias("scored"), F.sum("opened").alias("opened"), F.sum("blocks").alias("blocks")).first()
    assert figures.scored < figures.postings / 2 and figures.opened < figures.blocks / 2


def test_counts_in_the_row(spark):
    rows = [("a", None, "b a b", 0), ("b", "", "", 0), ("c", "X", None, 0), ("a", None, "b a b", 0)]
    corpus = spark.createDataFrame(rows, CORPUS)
    assert sorted(map(tuple, search.term_frequencies(corpus).collect())) == [("a", "a", 1), ("a", "a", 1), ("a", "b", 2), ("a", "b", 2), ("c", "x", 1)]
    assert sorted((r.id, round(r.norm, 6)) for r in search.hashed_norms(corpus).collect()) == [("a", 2.236068)] * 2 + [("c", 1.0)]
    assert search.document_counts(corpus.limit(0)).count() == 0
