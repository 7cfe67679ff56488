"""Plain projections of the given tables to the inputs of the operators.

Each is written once as SQL expressions that Spark and the oracle engine both read, so that a job and
its SQL start from the same rows. Natural texts hold none of what the lint rules look for, so lint texts
are decorated by rules on the id, and the pages to parse are built from part rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages", "part") else df


CORPUS = {
    "id": "CAST(doc_id AS STRING)",
    "url": "'https://' || CASE WHEN doc_id % 3 = 0 THEN 'www.' ELSE '' END || source || '.example.com/d/' || CAST(doc_id AS STRING)",
    "title": "split_part(text, chr(10), 1)",
    "text": "text",
    "anchor": "CASE WHEN doc_id % 4 = 0 THEN 'b-' || CAST(doc_id AS STRING) END",
    "last_modified": "CASE WHEN doc_id % 5 > 0 THEN '2024-0' || CAST(1 + doc_id % 9 AS STRING) || '-15' END",
    "jurisdiction": "CASE WHEN doc_id % 7 > 0 THEN lang END",
    "place_ids": "CASE WHEN doc_id % 3 = 0 THEN array('PLACE-' || CAST(doc_id % 10 AS STRING)) END",
}

LINT = {
    "doc_id": "doc_id",
    "text": """CASE WHEN doc_id % 3 = 0 THEN 'TL;DR: ' ELSE '' END
      || CASE WHEN doc_id % 4 = 0 THEN 'Click here to utilize it.' || chr(10) || 'A CLICK HERE link. ' ELSE '' END
      || CASE WHEN doc_id % 5 = 0 THEN 'Vinyl vs wood. Pros and cons. ' ELSE '' END
      || CASE WHEN doc_id % 10 = 0 THEN chr(10) || '| a | b |' || chr(10) || '| --- | --- |' || chr(10) ELSE '' END
      || CASE WHEN doc_id % 6 = 0 THEN chr(10) || '## Why?' || chr(10) || '## Cost' || chr(10) || '### Cost' || chr(10) ELSE '' END
      || CASE WHEN doc_id % 11 = 0 THEN chr(10) || '##' || chr(10) || chr(10) || 'Title below' || chr(10) || '##  ' || chr(10) || '  Really? ' || chr(10) ELSE '' END
      || CASE WHEN doc_id % 7 = 0 THEN 'It costs $1,250 and lasts 3x longer since 2019. ' ELSE '' END
      || CASE WHEN doc_id % 14 = 0 THEN 'One. Two. See [1]. ' ELSE '' END
      || CASE WHEN doc_id % 9 = 0 THEN 'PC Fence or Port City fences in Wilmington, NC: +1 (910) 555-0123. ' ELSE '' END
      || text
      || CASE WHEN doc_id % 8 = 0 THEN ' Built in 1999! ' ELSE '' END""",
    "page_type": "CASE WHEN doc_id % 2 = 0 THEN 'guide' ELSE 'news' END",
    "geo_key": "CASE WHEN doc_id % 4 = 1 THEN 'elsewhere' WHEN doc_id % 4 = 2 THEN 'wilmington_nc' END",
}

PRESENCE = {
    "seq": "event_id",
    "query": "CASE WHEN event_id % 89 = 0 THEN NULL WHEN event_id % 53 = 0 THEN '' ELSE 'query ' || CAST(user_id % 40 AS STRING) END",
    "engine": "upper(event_type)",
    "geo": "CASE WHEN user_id % 5 > 0 THEN 'g' || CAST(user_id % 3 AS STRING) END",
    "serp_surface": "CASE event_id % 4 WHEN 0 THEN ' AIO ' WHEN 1 THEN 'Copilot Answer' WHEN 2 THEN 'perplexity' ELSE ' Other ' END",
    "engine_flavor": "CASE WHEN event_id % 3 > 0 THEN 'Flavor-' || CAST(event_id % 6 AS STRING) END",
    "seen": "value > 50",
    "citations": "CASE WHEN event_id % 97 = 0 THEN 'x' WHEN event_id % 5 > 0 THEN CAST(event_id % 100 AS STRING) END",
    "position": "CASE WHEN event_id % 4 > 0 THEN CAST(event_id % 10 AS STRING) END",
    "details": "CASE WHEN event_id % 2 = 0 THEN props END",
    "ts": "{stamp}",
    "definition_version": "CASE WHEN event_id % 7 = 0 THEN 'v2' END",
}
_STAMP = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")", "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"

KPI = {
    "seq": "o_orderkey",
    "metric": "CASE WHEN o_orderkey % 501 = 0 THEN '' WHEN o_orderkey % 499 = 0 THEN NULL ELSE o_orderpriority END",
    "t": "{day}",
    "v": "CASE WHEN o_orderkey % 101 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS STRING) END",
    "geo": "CASE WHEN o_custkey % 4 > 0 THEN 'c' || CAST(o_custkey % 3 AS STRING) END",
    "src": "CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus ELSE '' END",
}
#: The same points, each order with a metric; only rejects need absent ones.
KPI_ALL = KPI | {"metric": "CASE WHEN o_orderkey % 501 = 0 THEN '' ELSE o_orderpriority END"}
_DAY = "date_format(o_orderdate, 'yyyy-MM-dd')", "strftime(o_orderdate, '%Y-%m-%d')"

FETCHES = {
    "seq": "event_id",
    "url": "'https://h' || CAST(user_id % 7 AS STRING) || '.example.com/p/' || CAST(user_id AS STRING)",
    "fetched_at": "ts",
    "status": "CASE event_type WHEN 'click' THEN 200 WHEN 'view' THEN 304 WHEN 'error' THEN 503 WHEN 'signup' THEN 404 ELSE 200 END",
    "content_type": "CASE WHEN event_id % 3 = 0 THEN ' text/html ; charset=utf-8' WHEN event_id % 3 = 1 THEN 'application/pdf' END",
    "etag": "CASE WHEN event_id % 4 > 0 THEN 'e' || CAST(event_id AS STRING) END",
    "last_modified": "CASE WHEN event_id % 6 = 0 THEN 'm' || CAST(event_id AS STRING) END",
    "sent_etag": "CASE WHEN event_id % 10 = 3 THEN 's' || CAST(event_id AS STRING) END",
    "n_bytes": "CASE WHEN event_id % 50 = 0 THEN 9000000 ELSE 1000 + event_id END",
}

CONTENT = {
    "seq": "page_id",
    "path": "'/p/' || CAST(page_id % 150 AS STRING) || CASE page_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.html' ELSE '/index.md' END",
    "markdown": "CASE WHEN page_id % 3 = 1 THEN NULL ELSE html END",
    "html": "CASE WHEN page_id % 3 = 1 THEN html WHEN page_id % 11 = 0 THEN html END",
    # One object with its keys in two orders, and an empty one.
    "jsonld": """CASE WHEN page_id % 12 = 0 THEN '{"@type":"WebPage","name":"ü","about":{"@type":"Thing","@id":[1, 2]}}' WHEN page_id % 12 = 4 THEN '{ "name": "ü", "about":{"@id":[1,2],"@type":"Thing"},"@type":"WebPage" }' WHEN page_id % 4 = 0 THEN '{}' END""",
    "embed_jsonld": "page_id % 8 = 0",
    "preview": "page_id % 13 = 0",
    "url": "url",
}


def _select(shape: dict[str, str], engine: int) -> str:
    text = ", ".join(f"{e} AS {c}" for c, e in shape.items()).replace("{stamp}", _STAMP[engine]).replace("{day}", _DAY[engine])
    return text.replace("array(", "list_value(") if engine else text


def shaped(spark: SparkSession, sf_dir: str, name: str, shape: dict[str, str]) -> DataFrame:
    text = {c: e.replace("{stamp}", _STAMP[0]).replace("{day}", _DAY[0]) for c, e in shape.items()}
    return table(spark, sf_dir, name).selectExpr(*[f"{e} AS {c}" for c, e in text.items()])


def sql(name: str, shape: dict[str, str]) -> str:
    """The same projection for the oracle engine."""
    return f"SELECT {_select(shape, 1)} FROM {name}"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(spark, sf_dir, "documents", CORPUS)


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items, each whole text a query."""
    return table(spark, sf_dir, "benchmark").select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("query_id"), F.col("text").alias("q"))


CORPUS_SQL = f"corpus AS ({sql('documents', CORPUS)})"
QUERIES_SQL = "queries AS (SELECT 'q' || item_id AS query_id, text AS q FROM benchmark)"
TEXTS_SQL = f"texts AS ({sql('documents', LINT)})"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(spark, sf_dir, "documents", LINT)
