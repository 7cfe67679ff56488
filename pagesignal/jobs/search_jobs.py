"""Search queries over documents for the benchmark's queries, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import search as S
from ..operators.text_index import TextIndex
from ..sources.shared import shared_folder
from . import fixtures as X

NAMES = ["Wilmington", "Wrightsville Beach", "Carolina Beach", "Leland", "New Hanover County", "the"]


def _both(spark, sf_dir):
    return X.corpus(spark, sf_dir), X.queries(spark, sf_dir)


def corpus_term_stats(spark, sf_dir):
    corpus = X.corpus(spark, sf_dir)
    frequencies = S.document_frequencies(corpus)
    return frequencies.join(S.term_idf(frequencies, S.corpus_stats(corpus)), "term").select("term", "df", F.round("idf", 6).alias("idf"))


def term_frequencies(spark, sf_dir):
    return S.term_frequencies(X.corpus(spark, sf_dir))


def hashed_norms(spark, sf_dir):
    return S.hashed_norms(X.corpus(spark, sf_dir)).select("id", F.round("norm", 6).alias("norm"))


def _ranked(df):
    return df.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


def bm25_topk(spark, sf_dir):
    return _ranked(S.bm25_search(*_both(spark, sf_dir), 10))


def _index(spark):
    return TextIndex(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")


def index_search(spark, sf_dir):
    """The stored index, built in one batch."""
    corpus, queries = _both(spark, sf_dir)
    index = _index(spark)
    index.append(corpus, 0)
    return _ranked(index.search(queries, 10))


def index_search_upserted(spark, sf_dir):
    """The index after batches: first every document with another's text, then some anew, some of these twice, and some that are new."""
    corpus, queries = _both(spark, sf_dir)
    number = F.col("id").cast("long")
    index = _index(spark)
    index.append(corpus.where(number % 3 < 2).withColumn("text", F.concat(F.lit("the old text the "), F.left("text", F.lit(200)))), 0)
    index.append(corpus.where(number % 3 == 0).withColumn("title", F.lit("x")), 1)
    index.append(corpus.where((number % 3 != 1)), 2)
    return _ranked(index.search(queries, 10))


def bm25_dense_corpus(spark, sf_dir):
    """Items of orders as documents of a few words each, so that most terms are in most documents: the mean idf is negative."""
    rows = X.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("m"), F.month("l_shipdate").cast("string")))), " ").alias("months"), F.min("l_linestatus").alias("status"))
    corpus = rows.select(F.col("l_suppkey").cast("string").alias("id"), F.col("status").alias("title"), F.col("months").alias("text"))
    queries = spark.createDataFrame([(f"q{m}", f"m{m} m{m + 1} o") for m in range(1, 12)], "query_id string, q string")
    return _ranked(S.bm25_search(corpus, queries, 10))


def rejected_queries(spark, sf_dir):
    asked = X.table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.when(F.col("turn") % 3 == 0, F.lit("  ")).otherwise(F.col("text")).alias("q"))
    return S.split_blank_queries(asked)[1].select("query_id")


def vector_topk(spark, sf_dir):
    return _ranked(S.vector_search(*_both(spark, sf_dir), 10))


def _hybrid(mode, method="zscore"):
    def run(spark, sf_dir):
        corpus, queries = _both(spark, sf_dir)
        found = S.search_hybrid(corpus, queries, mode=mode, method=method, k=10, jurisdiction="en")
        return found.select("query_id", "rank", "id", F.round("score", 6).alias("score"), "bm25_score", "vector_score", "source", "has_next")

    return run


def search_geo_boost_paged(spark, sf_dir):
    corpus, queries = _both(spark, sf_dir)
    found = S.search_query(corpus, queries, k=5, offset=5, names=NAMES)
    return found.select("query_id", "rank", "id", "score", "anchored_url", "title", "source", "has_next")


def search_filters(spark, sf_dir):
    corpus, queries = _both(spark, sf_dir)
    found = S.search_query(corpus, queries, k=10, domains=["*.src1.example.com", "src3.example.com", "src6.example.com", "src9.example.com"], lastmod_gte="2024-04-01", jurisdiction="EN", place_ids=["place-3", "place-6", "place-9", "place-2"])
    return found.select("query_id", "rank", "id", "score")


def site_filter(spark, sf_dir):
    corpus = X.corpus(spark, sf_dir)
    host = S.parse_host(F.col("url"))
    return S.filter_site(corpus, "*.src1.example.com").select("id", host.alias("host"))


def snippets(spark, sf_dir):
    corpus, queries = _both(spark, sf_dir)
    return S.search_query(corpus, queries, k=3).select("query_id", "id", "snippet")


def corpus_upsert(spark, sf_dir):
    base = X.corpus(spark, sf_dir).select("id", "title")
    delta = X.table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), (F.col("page_id") * 7 % 1500).cast("string").alias("id"), F.col("url").alias("title"))
    return S.corpus_upsert(base, delta, "seq")


QUERIES = {
    "corpus_term_stats": corpus_term_stats, "term_frequencies": term_frequencies, "hashed_norms": hashed_norms, "bm25_topk": bm25_topk, "index_search": index_search, "index_search_upserted": index_search_upserted, "vector_topk": vector_topk,
    "hybrid_rrf": _hybrid("rrf"), "hybrid_weighted_zscore": _hybrid("weighted"), "hybrid_weighted_minmax": _hybrid("weighted", "minmax"), "hybrid_weighted_none": _hybrid("weighted", "none"), "bm25_dense_corpus": bm25_dense_corpus, "rejected_queries": rejected_queries,
    "search_geo_boost_paged": search_geo_boost_paged, "search_filters": search_filters, "site_filter": site_filter, "snippets": snippets, "corpus_upsert": corpus_upsert,
}

_TOKENS = f"""{X.CORPUS_SQL}, {X.QUERIES_SQL},
doc_tokens AS (SELECT id, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(text, '')), '([a-z0-9]+)', 1) AS tokens FROM corpus),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(tokens) AS term FROM doc_tokens) GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(len(tokens)) AS avg_dl FROM doc_tokens),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT term, df, ln((SELECT n FROM stats) - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM df),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
asked AS (SELECT query_id, term, count(*) AS repeats FROM (SELECT query_id, unnest(regexp_extract_all(lower(q), '([a-z0-9]+)', 1)) AS term FROM queries) GROUP BY ALL)"""
#: All documents with their score for each query that has tokens.
_SCORES = """
hits AS (SELECT query_id, tf.id, sum(repeats * idf * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(tokens) / (SELECT avg_dl FROM stats))))) AS score
  FROM asked JOIN idf USING (term) JOIN tf USING (term) JOIN doc_tokens ON doc_tokens.id = tf.id GROUP BY ALL),
scored AS (SELECT a.query_id, d.id, coalesce(h.score, 0) AS score FROM (SELECT DISTINCT query_id FROM asked) a CROSS JOIN doc_tokens d LEFT JOIN hits h ON h.query_id = a.query_id AND h.id = d.id),
bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM scored) WHERE rank <= 60)"""
_BM25 = f"{_TOKENS},{_SCORES}"
_DENSE = _TOKENS.replace(X.CORPUS_SQL, """corpus AS (SELECT l_suppkey::VARCHAR AS id, min(l_linestatus) AS title, string_agg(DISTINCT 'm' || month(l_shipdate), ' ') AS text FROM lineitem GROUP BY l_suppkey)""").replace(X.QUERIES_SQL, "queries AS (SELECT 'q' || m AS query_id, 'm' || m || ' m' || (m + 1) || ' o' AS q FROM range(1, 12) r(m))")
_VECTOR = f"""
token_bucket AS (SELECT term, ('0x' || right(sha1(term), 3))::INT % 512 AS bucket FROM (SELECT term FROM df UNION SELECT term FROM asked)),
doc_bucket AS (SELECT id, bucket, sum(tf) AS n FROM tf JOIN token_bucket USING (term) GROUP BY ALL),
query_bucket AS (SELECT query_id, bucket, sum(repeats) AS n FROM asked JOIN token_bucket USING (term) GROUP BY ALL),
doc_norm AS (SELECT id, sqrt(sum(n * n)::DOUBLE) AS norm FROM doc_bucket GROUP BY id),
query_norm AS (SELECT query_id, sqrt(sum(n * n)::DOUBLE) AS norm FROM query_bucket GROUP BY query_id),
dots AS (SELECT query_id, id, sum(d.n * q.n)::DOUBLE AS dot FROM doc_bucket d JOIN query_bucket q USING (bucket) GROUP BY ALL),
cosine AS (SELECT q.query_id, d.id, coalesce(dot / (n.norm * m.norm), 0) AS score FROM queries q CROSS JOIN doc_tokens d LEFT JOIN dots USING (query_id, id) LEFT JOIN doc_norm n ON n.id = d.id LEFT JOIN query_norm m ON m.query_id = q.query_id),
vector AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM cosine) WHERE rank <= 60)"""


def _hybrid_sql(fused: str) -> str:
    return f"""WITH {_BM25}, {_VECTOR}, {fused},
kept AS (SELECT f.* FROM fused f JOIN corpus c USING (id) WHERE coalesce(lower(jurisdiction), '') IN ('', 'en')),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank, count(*) OVER (PARTITION BY query_id) > 10 AS has_next FROM kept)
SELECT p.query_id, p.rank, p.id, round(p.score, 6) AS score, round(b.score, 6) AS bm25_score, round(v.score, 6) AS vector_score,
  CASE WHEN v.score IS NULL THEN 'local-bm25' ELSE 'local-hybrid' END AS source, has_next
FROM placed p LEFT JOIN bm25 b USING (query_id, id) LEFT JOIN vector v USING (query_id, id) WHERE p.rank <= 10"""


def _weighted(norm: str) -> str:
    return f"""nb AS (SELECT query_id, id, {norm} AS s FROM bm25), nv AS (SELECT query_id, id, {norm} AS s FROM vector),
fused AS (SELECT query_id, id, 0.5::DOUBLE * coalesce(nb.s, 0) + 0.5::DOUBLE * coalesce(nv.s, 0) AS score FROM nb FULL JOIN nv USING (query_id, id))"""


_W = "OVER (PARTITION BY query_id)"
_Z = f"CASE WHEN stddev_pop(score) {_W} <= 1e-12 THEN 0 ELSE (score - avg(score) {_W}) / stddev_pop(score) {_W} END"
_M = f"CASE WHEN max(score) {_W} - min(score) {_W} <= 1e-12 THEN 0 ELSE (score - min(score) {_W}) / (max(score) {_W} - min(score) {_W}) END"
_BOOST = " + ".join(rf"CASE WHEN regexp_matches(lower(coalesce(title, '') || ' ' || q), '\b{n.lower()}\b') THEN 2.0::DOUBLE ELSE 0 END" for n in NAMES)


def _paged(k: int, offset: int, boost: str, where: str, columns: str, top: int) -> str:
    return f"""WITH {_BM25}, boosted AS (SELECT b.query_id, b.id, b.score + {boost} AS score, q, c.* EXCLUDE (id) FROM bm25 b JOIN corpus c USING (id) JOIN queries USING (query_id) WHERE b.rank <= {top}),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank, count(*) OVER (PARTITION BY query_id) > {offset + k} AS has_next FROM boosted WHERE {where})
SELECT {columns} FROM placed WHERE rank BETWEEN {offset + 1} AND {offset + k}"""


_HOST = "regexp_extract(url, '^[a-z]+://([^/]+)', 1)"
_DOMAINS = f"({' OR '.join(f"({_HOST} = '{d}' OR {_HOST} LIKE '%.{d}')" for d in ('src1.example.com', 'src3.example.com', 'src6.example.com', 'src9.example.com'))})"
_FILTERS = f"{_DOMAINS} AND coalesce(last_modified >= '2024-04-01', true) AND coalesce(jurisdiction, 'en') = 'en' AND coalesce(list_has_any(list_transform(place_ids, lambda x: lower(x)), ['place-3', 'place-6', 'place-9', 'place-2']), false)"
_TERMS = "list_distinct(regexp_extract_all(lower(q), '([a-z0-9]+)', 1))"
_SNIPPET = f"""spotted AS (SELECT *, CASE WHEN strpos(lower(text), lower(q)) > 0 THEN strpos(lower(text), lower(q)) ELSE list_min(list_filter(list_transform({_TERMS}, lambda x: strpos(lower(text), x)), lambda p: p > 0)) END - 1 AS hit, length(text) AS n FROM page),
bounded AS (SELECT *, greatest(0, hit - 73) AS a, least(n, hit + 146) AS z FROM spotted)
SELECT query_id, id, CASE WHEN hit IS NULL THEN substr(text, 1, 220) || CASE WHEN n > 220 THEN '…' ELSE '' END
  ELSE regexp_replace(CASE WHEN a > 0 THEN '…' ELSE '' END || substr(text, a + 1, z - a) || CASE WHEN z < n THEN '…' ELSE '' END, '(?i)(' || array_to_string(list_transform(list_sort(list_transform({_TERMS}, lambda x: lpad((999 - length(x))::VARCHAR, 3, '0') || x)), lambda y: substr(y, 4)), '|') || ')', '<em>\\1</em>', 'g') END AS snippet
FROM bounded"""

SQL = {
    "corpus_term_stats": f"WITH {_TOKENS} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "term_frequencies": f"WITH {_TOKENS} SELECT id, term, tf FROM tf",
    "hashed_norms": f"WITH {_TOKENS}, {_VECTOR} SELECT id, round(norm, 6) AS norm FROM doc_norm",
    "bm25_topk": f"WITH {_BM25} SELECT query_id, rank, id, round(score, 6) AS score FROM bm25 WHERE rank <= 10",
    "index_search": f"WITH {_BM25} SELECT query_id, rank, id, round(score, 6) AS score FROM bm25 WHERE rank <= 10",
    "index_search_upserted": "WITH " + _BM25.replace(X.CORPUS_SQL, X.CORPUS_SQL.replace("corpus AS", "given AS") + ", corpus AS (SELECT id, title, CASE WHEN id::BIGINT % 3 = 1 THEN 'the old text the ' || left(text, 200) ELSE text END AS text FROM given)") + " SELECT query_id, rank, id, round(score, 6) AS score FROM bm25 WHERE rank <= 10",
    "bm25_dense_corpus": f"WITH {_DENSE},{_SCORES} SELECT query_id, rank, id, round(score, 6) AS score FROM bm25 WHERE rank <= 10",
    "rejected_queries": "SELECT conv_id || '-' || turn AS query_id FROM conversations WHERE turn % 3 = 0 OR trim(coalesce(text, '')) = ''",
    "hybrid_weighted_none": _hybrid_sql(_weighted("score")),
    "vector_topk": f"WITH {_TOKENS}, {_VECTOR} SELECT query_id, rank, id, round(score, 6) AS score FROM vector WHERE rank <= 10",
    "hybrid_rrf": _hybrid_sql("fused AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT * FROM bm25 UNION ALL SELECT * FROM vector) GROUP BY ALL)"),
    "hybrid_weighted_zscore": _hybrid_sql(_weighted(_Z)),
    "hybrid_weighted_minmax": _hybrid_sql(_weighted(_M)),
    "search_geo_boost_paged": _paged(5, 5, _BOOST, "true", "query_id, rank, id, round(score, 6) AS score, url || CASE WHEN anchor IS NULL THEN '' ELSE '#' || anchor END AS anchored_url, title, 'local-bm25' AS source, has_next", 30),
    "search_filters": _paged(10, 0, "0", _FILTERS, "query_id, rank, id, round(score, 6) AS score", 60),
    "site_filter": f"WITH {X.CORPUS_SQL} SELECT id, {_HOST} AS host FROM corpus WHERE {_HOST} = 'src1.example.com' OR {_HOST} LIKE '%.src1.example.com'",
    "snippets": f"WITH page AS ({_paged(3, 0, '0', 'true', 'query_id, id, text, q', 18)}), {_SNIPPET}",
    "corpus_upsert": f"""WITH {X.CORPUS_SQL}, delta AS (SELECT (page_id * 7 % 1500)::VARCHAR AS id, url AS title, row_number() OVER (PARTITION BY page_id * 7 % 1500 ORDER BY page_id DESC) AS n FROM pages)
SELECT id, title FROM corpus WHERE id NOT IN (SELECT id FROM delta) UNION ALL SELECT id, title FROM delta WHERE n = 1""",
}
