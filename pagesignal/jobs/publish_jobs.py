"""Publishing queries over pages, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import publish as P
from . import fixtures as X

BASE = "https://site.example.com/"


def _batch(spark, sf_dir):
    return P.validate_publish(X.shaped(spark, sf_dir, "pages", X.CONTENT))


def _existing(spark, sf_dir):
    """What an earlier run of the same pages left: some were new since, some have changed since, some in their JSON-LD alone."""
    good = _batch(spark, sf_dir)[0].withColumn("jsonld", F.when(F.col("seq") % 3 == 0, F.lit('{"old":1}')).otherwise(F.col("jsonld")))
    marked = F.when(F.col("seq") % 2 == 0, F.concat("markdown", F.lit("!"))).otherwise(F.col("markdown"))
    return P.prepare_batch(good.withColumn("markdown", marked).withColumn("path", F.when(F.col("seq") % 5 == 0, F.concat(F.lit("/old"), "path")).otherwise(F.col("path"))))


def content_version_merge(spark, sf_dir):
    return P.content_merge(_existing(spark, sf_dir), P.prepare_batch(_batch(spark, sf_dir)[0]))


def content_state(spark, sf_dir):
    return P.content_state(P.prepared_rows(_batch(spark, sf_dir)[0])).select("path", "version", "status")


def publish_rejects(spark, sf_dir):
    return _batch(spark, sf_dir)[1].select("seq", "reason")


def content_history(spark, sf_dir):
    new = P.prepare_batch(_batch(spark, sf_dir)[0])
    return P.history_append(new, P.content_merge(_existing(spark, sf_dir), new), F.lit("2024-02-01")).select("path", "version", F.length("content").alias("n_chars"), "committed_at")


def _history(spark, sf_dir):
    pages = X.table(spark, sf_dir, "pages")
    return pages.selectExpr("'/p/' || CAST(page_id % 20 AS STRING) AS path", "'v' || CAST(page_id % 70 AS STRING) AS version", "page_id AS committed_at")


def rollback_version(spark, sf_dir):
    wanted = _history(spark, sf_dir).select("path", "version").distinct()
    return P.rollback_version(_history(spark, sf_dir), wanted)


def map_url(spark, sf_dir):
    rows = X.shaped(spark, sf_dir, "pages", X.CONTENT)
    return rows.select("seq", U.map_url(F.lit(BASE), F.col("path")).alias("url"), U.rich_results_url(F.concat(F.lit("a b~*é/"), F.col("path"))).alias("test_url"))


def path_validation(spark, sf_dir):
    path = F.expr("CASE page_id % 5 WHEN 0 THEN '../x' WHEN 1 THEN 'a/../../x' WHEN 2 THEN '/a' WHEN 3 THEN 'a/./../b' ELSE ' ' END")
    return X.table(spark, sf_dir, "pages").select("page_id", path.alias("path"), U.path_is_safe(path).alias("safe"), U.preview_path(F.lit("preview/"), path).alias("preview"))


def sitemap_touch(spark, sf_dir):
    pages = X.table(spark, sf_dir, "pages")
    sitemap = pages.selectExpr("' ' || url || ' ' AS loc", "'2023-12-31T00:00:00Z' AS lastmod")
    # Changed pages by another table: those that an event's number names; some of its urls are in no sitemap.
    changed = X.table(spark, sf_dir, "events").selectExpr("user_id AS page_id").distinct().join(pages.select("page_id", "url"), "page_id", "left").select(F.coalesce("url", F.lit("https://elsewhere.example.com/")).alias("url"))
    return P.sitemap_touch(sitemap, changed, F.lit("2024-02-01T00:00:00Z"))


def indexnow_payload(spark, sf_dir):
    payload = P.indexnow_payload(X.table(spark, sf_dir, "pages").select("url"))
    return payload.select("host", "part", F.array_join("url_list", " ").alias("urls"))


def embed_jsonld(spark, sf_dir):
    rows = X.shaped(spark, sf_dir, "pages", X.CONTENT).where("html IS NOT NULL")
    return rows.select("seq", F.sha2(P.embed_jsonld(F.col("html"), F.col("jsonld")).cast("binary"), 256).alias("sha"), P.render_ok(F.col("html")).alias("render_ok"))


def jsonld_sidecars(spark, sf_dir):
    return P.jsonld_sidecars(X.shaped(spark, sf_dir, "pages", X.CONTENT))


def slugs(spark, sf_dir):
    name = F.concat(F.lit("Ümläut & Straße "), F.col("c_name"), F.lit("!"))
    return X.table(spark, sf_dir, "customer").select("c_custkey", U.slug(name).alias("slug"), U.service_city_slug(F.col("c_mktsegment"), name).alias("path"))


def line_diff(spark, sf_dir):
    return _versions(spark, sf_dir).select("page_id", P.line_diff(F.col("url"), F.col("before"), F.col("after")).alias("diff"))


def merged_content(spark, sf_dir):
    return P.merged_content(_existing(spark, sf_dir), P.prepare_batch(_batch(spark, sf_dir)[0])).select("path", "version", F.sha2(F.col("content").cast("binary"), 256).alias("sha"))


def _versions(spark, sf_dir):
    """Each page before and after an edit of some of its lines."""
    after = F.replace(F.col("html"), F.lit("</p>"), F.lit("</p>\n"))
    return X.table(spark, sf_dir, "pages").select("page_id", "url", F.replace(after, F.lit("the"), F.lit("a")).alias("before"), after.alias("after"))


def line_diff_round_trip(spark, sf_dir):
    """The diff of each page applied to what it was: gives what it is."""
    rows = _versions(spark, sf_dir)
    diff = P.line_diff(F.col("url"), F.col("before"), F.col("after"))
    return rows.select("page_id", F.sha2(P.apply_diff(F.col("before"), diff).cast("binary"), 256).alias("sha"), (diff == "").alias("same"))


QUERIES = {f.__name__: f for f in (content_version_merge, content_state, publish_rejects, content_history, rollback_version, map_url, path_validation, sitemap_touch, indexnow_payload, embed_jsonld, jsonld_sidecars, slugs, line_diff, merged_content, line_diff_round_trip)}

# The fixture's JSON-LD in its stable form, and as it is written apart.
_STABLE = """CASE WHEN jsonld LIKE '%WebPage%' THEN '{"@type":"WebPage","about":{"@id":[1,2],"@type":"Thing"},"name":"ü"}' ELSE jsonld END"""
_INDENTED = """CASE WHEN jsonld LIKE '{"@type"%' THEN '{|  "@type": "WebPage",|  "name": "ü",|  "about": {|    "@type": "Thing",|    "@id": [|      1,|      2|    ]|  }|}' ELSE '{|  "name": "ü",|  "about": {|    "@id": [|      1,|      2|    ],|    "@type": "Thing"|  },|  "@type": "WebPage"|}' END"""
_EMBED = f"""CASE WHEN coalesce(jsonld, '{{}}') = '{{}}' THEN html WHEN contains(html, '</head>') THEN replace(html, '</head>', '<script type="application/ld+json">' || {_STABLE} || '</script>' || chr(10) || '</head>')
  WHEN contains(html, '</body>') THEN replace(html, '</body>', '<script type="application/ld+json">' || {_STABLE} || '</script>' || chr(10) || '</body>')
  ELSE html || CASE WHEN html LIKE '%' || chr(10) THEN '' ELSE chr(10) END || '<script type="application/ld+json">' || {_STABLE} || '</script>' || chr(10) END"""


def _rows(name: str, markdown: str = "markdown", path: str = "path", jsonld: str = "jsonld") -> str:
    return f"""{name} AS (SELECT *, left(sha256(path || coalesce(content, '') || coalesce({_STABLE}, '')), 7) AS version
  FROM (SELECT seq, CASE WHEN preview THEN 'preview/' || ltrim({path}, '/') ELSE {path} END AS path, coalesce({markdown}, CASE WHEN embed_jsonld THEN {_EMBED} ELSE html END) AS content, jsonld
    FROM (SELECT * REPLACE ({jsonld} AS jsonld) FROM batch) WHERE (markdown IS NULL) <> (html IS NULL)))"""


def _last(name: str, rows: str) -> str:
    return f"{name} AS (SELECT path, arg_max_null(content, seq) AS content, arg_max_null(version, seq) AS version FROM {rows} GROUP BY path)"


_BATCH = f"batch AS ({X.sql('pages', X.CONTENT)})"
_OLD = """CASE WHEN seq % 3 = 0 THEN '{"old":1}' ELSE jsonld END"""
_MERGE = f"""{_BATCH}, {_rows('old_rows', "CASE WHEN seq % 2 = 0 THEN markdown || '!' ELSE markdown END", "CASE WHEN seq % 5 = 0 THEN '/old' || path ELSE path END", _OLD)}, {_last('old', 'old_rows')}, {_rows('new_rows')}, {_last('new', 'new_rows')},
merged AS (SELECT path, CASE WHEN new.version IS NULL THEN 'kept' WHEN old.version IS NULL THEN 'inserted' WHEN old.content = new.content THEN 'not_modified' ELSE 'changed' END AS status, coalesce(new.version, old.version) AS version FROM old FULL JOIN new USING (path))"""
_HISTORY = "history AS (SELECT '/p/' || page_id % 20 AS path, 'v' || page_id % 70 AS version, page_id AS committed_at FROM pages)"
_HOST = "string_split(string_split(regexp_extract(url, '(?i)^[a-z]+://([^/]+)', 1), '@')[-1], ':')[1]"
_SLUG = "trim(regexp_replace(replace(translate(lower({}), '" + U.ACCENTED + "', '" + U.PLAIN + "'), 'ß', 'ss'), '[^a-z0-9]+', '-', 'g'), '-')"
_NAME = "'Ümläut & Straße ' || c_name || '!'"

SQL = {
    "content_version_merge": f"WITH {_MERGE} SELECT path, status, version FROM merged",
    "content_state": f"""WITH {_BATCH}, {_rows('rows')}, ranked AS (SELECT path, version, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS n, content, lead(content) OVER (PARTITION BY path ORDER BY seq DESC) AS before FROM rows)
SELECT path, version, CASE WHEN before IS NULL THEN 'inserted' WHEN before = content THEN 'not_modified' ELSE 'changed' END AS status FROM ranked WHERE n = 1""",
    "publish_rejects": f"WITH {_BATCH} SELECT seq, 'exactly one of markdown and html' AS reason FROM batch WHERE (markdown IS NULL) = (html IS NULL)",
    "content_history": f"WITH {_MERGE} SELECT path, new.version, length(content) AS n_chars, '2024-02-01' AS committed_at FROM new JOIN merged USING (path) WHERE status IN ('inserted', 'changed')",
    "rollback_version": f"""WITH {_HISTORY}, wanted AS (SELECT DISTINCT path, version FROM history),
recent AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY committed_at DESC, version) AS age FROM history)
SELECT path, version, min(age) AS age, max(committed_at) AS committed_at FROM recent JOIN wanted USING (path, version) WHERE age <= 200 GROUP BY path, version""",
    "map_url": f"""WITH {_BATCH} SELECT seq, CASE seq % 3 WHEN 0 THEN '{BASE}p/' || seq % 150 || '/' WHEN 1 THEN '{BASE}p/' || seq % 150 || '.html' ELSE '{BASE}p/' || seq % 150 || '/' END AS url,
  'https://search.google.com/test/rich-results?url=a+b~%2A%C3%A9%2F' || replace(url_encode(path), '%20', '+') AS test_url FROM batch""",
    "path_validation": "SELECT page_id, CASE page_id % 5 WHEN 0 THEN '../x' WHEN 1 THEN 'a/../../x' WHEN 2 THEN '/a' WHEN 3 THEN 'a/./../b' ELSE ' ' END AS path, page_id % 5 IN (2, 3) AS safe, CASE page_id % 5 WHEN 0 THEN 'preview/../x' WHEN 1 THEN 'preview/a/../../x' WHEN 2 THEN 'preview/a' WHEN 3 THEN 'preview/a/./../b' ELSE 'preview/ ' END AS preview FROM pages",
    "sitemap_touch": "SELECT ' ' || url || ' ' AS loc, CASE WHEN url IN (SELECT url FROM pages WHERE page_id IN (SELECT user_id FROM events)) THEN '2024-02-01T00:00:00Z' ELSE '2023-12-31T00:00:00Z' END AS lastmod FROM pages",
    "indexnow_payload": f"SELECT host, 0 AS part, string_agg(url, ' ' ORDER BY url) AS urls FROM (SELECT DISTINCT {_HOST} AS host, url FROM pages) GROUP BY host",
    "embed_jsonld": f"WITH {_BATCH} SELECT seq, sha256({_EMBED}) AS sha, contains(html, '<') AS render_ok FROM batch WHERE html IS NOT NULL",
    "jsonld_sidecars": f"WITH {_BATCH} SELECT path || '.jsonld' AS path, replace({_INDENTED}, '|', chr(10)) AS jsonld FROM batch WHERE jsonld <> '{{}}' AND NOT embed_jsonld",
    "merged_content": f"""WITH {_MERGE} SELECT path, CASE WHEN status IN ('kept', 'not_modified') THEN old.version ELSE new.version END AS version, sha256(CASE WHEN status IN ('kept', 'not_modified') THEN old.content ELSE new.content END) AS sha FROM merged LEFT JOIN old USING (path) LEFT JOIN new USING (path)""",
    "line_diff_round_trip": "SELECT page_id, sha256(after) AS sha, before = after AS same FROM (SELECT page_id, replace(html, '</p>', '</p>' || chr(10)) AS after, replace(replace(html, '</p>', '</p>' || chr(10)), 'the', 'a') AS before FROM pages)",
    "slugs": f"SELECT c_custkey, {_SLUG.format(_NAME)} AS slug, {_SLUG.format('c_mktsegment')} || '/' || {_SLUG.format(_NAME)} AS path FROM customer",
}
