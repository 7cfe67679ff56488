"""Presence, KPI and recrawl queries over events and orders, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pages as G
from ..operators import presence as P
from . import fixtures as X


def _events(spark, sf_dir, unit="minute"):
    good, _ = P.validate_presence(X.shaped(spark, sf_dir, "events", X.PRESENCE))
    return P.normalize_presence(good, unit)


def _points(spark, sf_dir, shape=X.KPI):
    return P.validate_kpi(X.shaped(spark, sf_dir, "orders", shape))


_PRESENCE_COLUMNS = ("query", "engine", "geo", "ts", "serp_surface", "engine_flavor", "seen", "citations", "details", "position", "definition_version")


def presence_upsert(spark, sf_dir):
    return P.presence_upsert(_events(spark, sf_dir, "day")).select(*_PRESENCE_COLUMNS)


def presence_upsert_merged(spark, sf_dir):
    return P.presence_upsert(_events(spark, sf_dir, "day"), null_geo="merge").select(*_PRESENCE_COLUMNS)


def presence_rejects(spark, sf_dir):
    return P.validate_presence(X.shaped(spark, sf_dir, "events", X.PRESENCE))[1].select("seq", "reason")


_FORMS = "CASE event_id % 8 WHEN 0 THEN '3000000000' WHEN 1 THEN '-9223372036854775808' WHEN 2 THEN '9223372036854775808' WHEN 3 THEN ' +7 ' WHEN 4 THEN '1.5' WHEN 5 THEN '' WHEN 6 THEN '1e3' END"


def presence_numbers(spark, sf_dir):
    """Counts of up to 64 bits, and texts that are none; empty engines are engines, absent ones are rejected."""
    engine = F.expr("CASE WHEN event_id % 5 > 0 THEN event_type WHEN event_id % 2 = 0 THEN '' END")
    rows = X.shaped(spark, sf_dir, "events", X.PRESENCE).withColumnRenamed("seq", "event_id").withColumn("citations", F.expr(_FORMS)).drop("engine")
    events = rows.join(X.table(spark, sf_dir, "events").select("event_id", engine.alias("engine")), "event_id").where("query IS NOT NULL")
    good, bad = P.validate_presence(events)
    return good.select("event_id", F.col("citations").cast("string").alias("citations"), F.lit(None).cast("string").alias("reason")).unionByName(bad.select("event_id", "citations", "reason"))


def presence_query(spark, sf_dir):
    table = P.presence_upsert(_events(spark, sf_dir, "day"))
    return P.presence_query(table, queries=["query 1", "query 2", "query 7"], engine="CLICK", surface="aio", since="2024-01-05", until="2024-01-20").select(*_PRESENCE_COLUMNS)


def presence_query_limit(spark, sf_dir):
    table = P.presence_upsert(_events(spark, sf_dir, "day"), null_geo="merge")
    return P.presence_query(table, limit=100).select("query", "engine", "geo", "ts", "seen")


def presence_minute_counts(spark, sf_dir):
    rows = _events(spark, sf_dir, "minute")
    return rows.groupBy("ts", "engine").agg(F.count("*").alias("events"), F.sum("seen").alias("seen"), F.sum("citations").alias("citations"))


def kpi_upsert(spark, sf_dir):
    return P.kpi_upsert(_points(spark, sf_dir, X.KPI_ALL)[0]).select("metric", "t", "geo", "src", "v")


def kpi_rejects(spark, sf_dir):
    return _points(spark, sf_dir)[1].select("seq", "reason")


def kpi_series(spark, sf_dir):
    points = P.kpi_upsert(_points(spark, sf_dir)[0])
    wanted = points.select("metric").distinct().unionByName(spark.createDataFrame([("no such metric",)], "metric string"))
    series = P.kpi_series(wanted, points, "1996-01-01", "1996-03-31", include_src=True)
    return series.select("metric", F.size("points").alias("n"), F.array_join(F.transform("points", lambda p: F.concat_ws("|", p["t"], F.format_string("%.2f", p["v"]), p["src"])), ",").alias("points"))


def kpi_series_chunks(spark, sf_dir):
    """All points of all metrics, a run of 500 a row."""
    points = P.kpi_upsert(_points(spark, sf_dir)[0])
    runs = P.kpi_series_chunks(points.select("metric"), points, chunk=500)
    return runs.select("metric", "chunk", F.size("points").alias("n"), F.sha2(F.array_join(F.transform("points", lambda p: F.concat_ws("|", p["t"], F.format_string("%.2f", p["v"]), p["src"])), ","), 256).alias("sha"))


def kpi_series_of_geo(spark, sf_dir):
    points = P.kpi_upsert(_points(spark, sf_dir, X.KPI_ALL)[0])
    series = P.kpi_series(points.select("metric"), points, geo="c1", src=["csv", "F"])
    return series.select("metric", F.size("points").alias("n"), F.array_join(F.transform("points", lambda p: F.concat_ws("|", p["t"], F.format_string("%.2f", p["v"]))), ",").alias("points"))


def kpi_points(spark, sf_dir):
    points = P.kpi_upsert(_points(spark, sf_dir, X.KPI_ALL)[0])
    return P.kpi_points_of(points.select("metric"), points, src="O").select("metric", "t", "v", "src")


def fetch_classes(spark, sf_dir):
    from ..functions.urls import detect_mime, detect_mode

    log = G.classify_fetch(X.shaped(spark, sf_dir, "events", X.FETCHES)).withColumn("mime", detect_mime(F.col("content_type")))
    return log.select("seq", "outcome", "mime", detect_mode(F.lit("auto"), F.col("mime")).alias("mode"))


def _stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def recrawl_state(spark, sf_dir):
    state = G.recrawl_state(X.shaped(spark, sf_dir, "events", X.FETCHES))
    return state.select("url", "etag", "last_modified", "last_status", "attempts", _stamp("backoff_until"), _stamp("last_success_at"))


def recrawl_attempts(spark, sf_dir):
    return G.recrawl_attempts(X.shaped(spark, sf_dir, "events", X.FETCHES)).select("seq", "attempts", "etag", "last_modified")


def plan_recrawl(spark, sf_dir):
    state = G.recrawl_state(X.shaped(spark, sf_dir, "events", X.FETCHES))
    frontier = X.table(spark, sf_dir, "pages").selectExpr("'https://h' || CAST(page_id % 7 AS STRING) || '.example.com/p/' || CAST(page_id AS STRING) AS url", "CASE WHEN page_id % 9 = 0 THEN 'given' END AS if_modified_since", "CAST(NULL AS STRING) AS etag")
    return G.plan_recrawl(frontier, state, F.lit("2024-01-30 22:00:00").cast("timestamp"))


QUERIES = {f.__name__: f for f in (presence_upsert, presence_upsert_merged, presence_rejects, presence_numbers, presence_query, presence_query_limit, presence_minute_counts, kpi_upsert, kpi_rejects, kpi_series, kpi_series_chunks, kpi_series_of_geo, kpi_points, fetch_classes, recrawl_state, recrawl_attempts, plan_recrawl)}

_RAW = f"raw AS ({X.sql('events', X.PRESENCE)})"
_SURFACE = "coalesce(CASE " + " ".join(f"WHEN lower(trim(serp_surface)) = '{a}' THEN '{b}'" for a, b in P.SURFACES.items()) + " END, lower(serp_surface))"


def _normal(unit: str) -> str:
    return f"""{_RAW}, rows AS (SELECT seq, query, lower(engine) AS engine, geo, {_SURFACE} AS serp_surface, lower(engine_flavor) AS engine_flavor, coalesce(seen, false)::INT AS seen,
  citations::BIGINT AS citations, position::BIGINT AS position, details, strftime(date_trunc('{unit}', strptime(ts, '%Y-%m-%dT%H:%M:%SZ')), '%Y-%m-%dT%H:%M:%SZ') AS ts, definition_version FROM raw WHERE citations IS DISTINCT FROM 'x' AND query IS NOT NULL)"""


def _upsert(null_geo: str) -> str:
    own = "CASE WHEN geo IS NULL THEN seq END" if null_geo == "distinct" else "CASE WHEN false THEN seq END"
    last = ", ".join(f"max_by({c}, seq) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("citations", "details", "position", "definition_version"))
    return f"upserted AS (SELECT query, engine, geo, ts, arg_min_null(serp_surface, seq) AS serp_surface, arg_min_null(engine_flavor, seq) AS engine_flavor, max_by(seen, seq) AS seen, {last} FROM rows GROUP BY query, engine, geo, ts, {own})"



def _kpi(shape: dict[str, str]) -> str:
    return f"raw AS ({X.sql('orders', shape)}), good AS (SELECT seq, metric, t, try_cast(v AS DOUBLE) AS v, geo, coalesce(nullif(src, ''), 'csv') AS src FROM raw WHERE metric IS NOT NULL AND try_cast(v AS DOUBLE) IS NOT NULL), points AS (SELECT metric, t, geo, src, max_by(v, seq) AS v FROM good GROUP BY metric, t, geo, src, CASE WHEN geo IS NULL THEN seq END)"


_KPI, _KPI_ALL = _kpi(X.KPI), _kpi(X.KPI_ALL)
_OUTCOME = "CASE WHEN status = 304 THEN 'not_modified' WHEN n_bytes > 8388608 THEN 'content_too_large' WHEN status IN (429, 500, 502, 503, 504) THEN 'retryable' WHEN status >= 400 THEN 'fetch_failed' ELSE 'ok' END"
_LOG = f"raw AS ({X.sql('events', X.FETCHES)}), log AS (SELECT * REPLACE (CASE WHEN {_OUTCOME} IN ('ok', 'not_modified', 'content_too_large') THEN etag ELSE sent_etag END AS etag, CASE WHEN {_OUTCOME} IN ('ok', 'not_modified', 'content_too_large') THEN last_modified END AS last_modified), {_OUTCOME} AS outcome, {_OUTCOME} IN ('ok', 'not_modified') AS good FROM raw), runs AS (SELECT *, count_if(good) OVER (PARTITION BY url ORDER BY seq) AS run FROM log)"
_HISTORY = """history AS (SELECT seq, url, fetched_at, status, good, count_if(NOT good) OVER (PARTITION BY url, run ORDER BY seq ROWS UNBOUNDED PRECEDING) AS attempts,
  last_value(etag IGNORE NULLS) OVER (PARTITION BY url ORDER BY seq ROWS UNBOUNDED PRECEDING) AS etag, last_value(last_modified IGNORE NULLS) OVER (PARTITION BY url ORDER BY seq ROWS UNBOUNDED PRECEDING) AS last_modified FROM runs)"""
_STATE = """state AS (SELECT url, max_by(etag, seq) AS etag, max_by(last_modified, seq) AS last_modified, max_by(status, seq) AS last_status, max_by(attempts, seq) AS attempts,
  CASE WHEN max_by(attempts, seq) > 0 THEN max_by(fetched_at, seq) + to_seconds(least(60, 2 ** least(max_by(attempts, seq), 10))::INT) END AS backoff_until, max_by(fetched_at, seq) FILTER (WHERE good) AS last_success_at FROM history2 GROUP BY url)"""
_STATE = "history2 AS (SELECT *, coalesce(etag, NULL) AS e FROM history), " + _STATE.replace("max_by(etag, seq) AS etag", "arg_max_null(etag, seq) AS etag").replace("max_by(last_modified, seq) AS last_modified", "arg_max_null(last_modified, seq) AS last_modified")
_COLUMNS = ", ".join(_PRESENCE_COLUMNS)

SQL = {
    "presence_upsert": f"WITH {_normal('day')}, {_upsert('distinct')} SELECT {_COLUMNS} FROM upserted",
    "presence_upsert_merged": f"WITH {_normal('day')}, {_upsert('merge')} SELECT {_COLUMNS} FROM upserted",
    "presence_rejects": f"WITH {_RAW} SELECT seq, CASE WHEN query IS NULL THEN 'query missing' ELSE 'citations not an integer' END AS reason FROM raw WHERE citations = 'x' OR query IS NULL",
    "presence_numbers": f"""WITH {_RAW}, given AS (SELECT event_id, CASE WHEN event_id % 5 > 0 THEN event_type WHEN event_id % 2 = 0 THEN '' END AS engine, {_FORMS} AS citations FROM events JOIN raw ON seq = event_id WHERE query IS NOT NULL),
judged AS (SELECT event_id, citations, CASE WHEN engine IS NULL THEN 'engine missing' WHEN event_id % 8 IN (2, 4, 5, 6) THEN 'citations not an integer' END AS reason FROM given)
SELECT event_id, CASE WHEN reason IS NULL AND event_id % 8 = 3 THEN '7' ELSE citations END AS citations, reason FROM judged""",
    "presence_query": f"WITH {_normal('day')}, {_upsert('distinct')} SELECT {_COLUMNS} FROM upserted WHERE query IN ('query 1', 'query 2', 'query 7') AND engine = 'click' AND serp_surface = 'ai_overview' AND ts >= '2024-01-05' AND ts <= '2024-01-20'",
    "presence_query_limit": f"WITH {_normal('day')}, {_upsert('merge')} SELECT query, engine, geo, ts, seen FROM upserted ORDER BY ts, query, engine, geo NULLS FIRST LIMIT 100",
    "presence_minute_counts": f"WITH {_normal('minute')} SELECT ts, engine, count(*) AS events, sum(seen)::BIGINT AS seen, sum(citations)::BIGINT AS citations FROM rows GROUP BY ts, engine",
    "kpi_upsert": f"WITH {_KPI_ALL} SELECT metric, t, geo, src, v FROM points",
    "kpi_rejects": f"WITH {_KPI} SELECT seq, CASE WHEN metric IS NULL THEN 'metric missing' ELSE 'v not a number' END AS reason FROM raw WHERE metric IS NULL OR try_cast(v AS DOUBLE) IS NULL",
    "kpi_series": f"""WITH {_KPI}, wanted AS (SELECT DISTINCT metric FROM points UNION ALL SELECT 'no such metric')
SELECT metric, count(t) AS n, coalesce(string_agg(t || '|' || printf('%.2f', v) || '|' || src, ',' ORDER BY t, v, src) FILTER (WHERE t IS NOT NULL), '') AS points FROM wanted LEFT JOIN (SELECT * FROM points WHERE t BETWEEN '1996-01-01' AND '1996-03-31') USING (metric) GROUP BY metric""",
    "kpi_series_chunks": f"""WITH {_KPI}, placed AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY t, v, src) - 1 AS place FROM points)
SELECT metric, place // 500 AS chunk, count(*) AS n, sha256(string_agg(t || '|' || printf('%.2f', v) || '|' || src, ',' ORDER BY place)) AS sha FROM placed GROUP BY metric, place // 500""",
    "kpi_series_of_geo": f"""WITH {_KPI_ALL} SELECT m.metric, count(t) AS n, coalesce(string_agg(t || '|' || printf('%.2f', v), ',' ORDER BY t, v, src) FILTER (WHERE t IS NOT NULL), '') AS points
FROM (SELECT DISTINCT metric FROM points) m LEFT JOIN (SELECT * FROM points WHERE geo = 'c1' AND src IN ('csv', 'F')) p ON p.metric = m.metric GROUP BY m.metric""",
    "kpi_points": f"WITH {_KPI_ALL} SELECT m.metric, t, v, src FROM (SELECT DISTINCT metric FROM points) m LEFT JOIN (SELECT * FROM points WHERE src = 'O') p ON p.metric = m.metric",
    "fetch_classes": f"WITH {_LOG} SELECT seq, outcome, CASE seq % 3 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/pdf' ELSE 'application/octet-stream' END AS mime, CASE WHEN seq % 3 = 1 THEN 'pdf' ELSE 'html' END AS mode FROM log",
    "recrawl_state": f"WITH {_LOG}, {_HISTORY}, {_STATE} SELECT url, etag, last_modified, last_status, attempts, strftime(backoff_until, '%Y-%m-%d %H:%M:%S') AS backoff_until, strftime(last_success_at, '%Y-%m-%d %H:%M:%S') AS last_success_at FROM state",
    "recrawl_attempts": f"WITH {_LOG}, {_HISTORY} SELECT seq, attempts, etag, last_modified FROM history",
    "plan_recrawl": f"""WITH {_LOG}, {_HISTORY}, {_STATE}, frontier AS (SELECT 'https://h' || page_id % 7 || '.example.com/p/' || page_id AS url, CASE WHEN page_id % 9 = 0 THEN 'given' END AS given FROM pages)
SELECT url, coalesce(given, last_modified) AS if_modified_since, CASE WHEN given IS NULL THEN etag END AS etag FROM frontier LEFT JOIN state USING (url) WHERE coalesce(backoff_until <= TIMESTAMP '2024-01-30 22:00:00', true)""",
}
