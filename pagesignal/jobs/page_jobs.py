"""Page parsing and robots queries, and their SQL.

Pages to parse are built from part and nation rows, so the SQL knows their blocks without a parser.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pages as G
from . import fixtures as X

#: Well-formed and sloppy markup in turn: open paragraphs and cells, an unclosed list.
BUILT = {
    "page_id": "p_partkey",
    "html": """'<!DOCTYPE html><html lang="en"><head><title>x</title><link rel="canonical" href="https://shop.example.com/' || CAST(p_partkey AS STRING) || '">'
      || CASE WHEN p_partkey % 3 = 0 THEN '<meta name="robots" content="NOINDEX, follow">' ELSE '' END
      || '<script type="application/ld+json">' || CASE WHEN p_partkey % 5 = 0 THEN '[{"@type":"Product","name":"' || p_name || '"},{"@type":"Thing"}]' WHEN p_partkey % 5 = 1 THEN '{broken' ELSE '{"@context":"https://schema.org","@type":"Product","name":"' || p_name || '"}' END || '</script>'
      || '</head><body><nav class="toc"><ul><li>menu</li></ul></nav><h1> ' || p_name || ' </h1><p>Brand <b>' || p_brand || '</b><p>Type: ' || p_type || ' &amp; more'
      || '<ul><li>size ' || CAST(p_size AS STRING) || '<li><a href="tel:+1-555-' || CAST(p_partkey AS STRING) || '">call</a></ul>'
      || '<table><thead><tr><th>a<th>b</thead><tr><td>' || p_brand || '<td>' || p_type || '<tr><td>' || p_brand || '<td>' || p_type || '</table>'
      || CASE WHEN p_partkey % 4 = 0 THEN '<address>1 Main St<br>Springfield</address><a href="https://goo.gl/maps/' || CAST(p_partkey AS STRING) || '">map</a>' ELSE '' END
      || '<h2></h2><style>p{}</style></body></html>'""",
}


def _built(spark, sf_dir):
    return X.shaped(spark, sf_dir, "part", BUILT)


def page_blocks(spark, sf_dir):
    rows = G.extract_blocks(_built(spark, sf_dir), keep_toc=False)
    text = F.coalesce("text", F.array_join(F.transform("cells", lambda r: F.array_join(r, "|")), "/"))
    return rows.select("page_id", F.col("order").alias("n"), "id", "type", text.alias("text"), F.size(F.coalesce("items", F.array())).alias("n_items"), "xpath")


def page_blocks_with_menu(spark, sf_dir):
    return G.extract_blocks(_built(spark, sf_dir)).groupBy("type").agg(F.count("*").alias("n"))


def page_tables(spark, sf_dir):
    return G.table_cells(G.extract_blocks(_built(spark, sf_dir))).select("page_id", "row", "col", "value")


def page_text(spark, sf_dir):
    return G.page_text(_built(spark, sf_dir))


def page_jsonld(spark, sf_dir):
    return G.extract_jsonld(_built(spark, sf_dir)).select("page_id", "i", "jsonld")


def page_meta(spark, sf_dir):
    return G.extract_page_meta(_built(spark, sf_dir))


#: The same facts in markup as it comes: quoted in each way or not at all, commented out, coded, in capitals, broken.
WILD = {
    "page_id": "p_partkey",
    "html": """'<!-- <link rel=canonical href=/no><meta name=robots content=nofollow> --><HTML data-lang="xx" lang=' || CASE p_partkey % 3 WHEN 0 THEN 'de' WHEN 1 THEN '"en"' ELSE chr(39) || 'fr' || chr(39) END || '><head>'
      || CASE p_partkey % 4 WHEN 0 THEN '<link rel="alternate canonical" data-href="/no" href=/p/' || CAST(p_partkey AS STRING) || '?a&amp;b>' WHEN 1 THEN '<LINK HREF="/q"  REL=canonical>' WHEN 2 THEN '<link rel=canonical><link rel=canonical href=/late>' ELSE '<link rel="canonicals" href="/no">' END
      || CASE p_partkey % 5 WHEN 0 THEN '<meta content="NoFollow" name=GoogleRobots>' WHEN 1 THEN '<meta name="robots" content=>' ELSE '' END
      || '<script type=' || CASE p_partkey % 3 WHEN 0 THEN 'application/ld+json' WHEN 1 THEN chr(39) || 'application/ld+json' || chr(39) ELSE '"Application/LD+JSON" id="x"' END || '>' || CASE p_partkey % 6 WHEN 0 THEN '{broken' WHEN 1 THEN '[{"@context":"c","@type":"A"},{"@type":"B"}]' WHEN 2 THEN '5' ELSE '{"@type":"A","@context":"c"}' END || '</script>'
      || '</head><body><a title="tel:1" href=' || chr(39) || 'tel:+1&#45;2' || chr(39) || '>x</a><a href=https://www.google.com/maps?q=' || CAST(p_partkey AS STRING) || '>m</a><p itemtype="https://schema.org/POSTALADDRESS">1 St<br> <b>X</b></p><address>other</address>'""",
    "jsonld": """CASE p_partkey % 7 WHEN 0 THEN '{"@context":"c","@type":"A"}' WHEN 1 THEN '[]' WHEN 2 THEN 'no json' WHEN 3 THEN '[{"@type":"A"}]' END""",
    "url": "CASE WHEN p_partkey % 2 = 0 THEN 'https://s.example.com/' || CAST(p_partkey AS STRING) END",
}


def page_meta_wild(spark, sf_dir):
    return G.extract_page_meta(X.shaped(spark, sf_dir, "part", WILD))


def page_jsonld_wild(spark, sf_dir):
    return G.extract_jsonld(X.shaped(spark, sf_dir, "part", WILD)).select("page_id", "i", "jsonld")


def precheck(spark, sf_dir):
    return G.precheck(X.shaped(spark, sf_dir, "part", WILD)).select("page_id", "schema_ok", "render_ok", F.size("google_warnings").alias("n_warnings"), "rich_results_test_url")


def raw_page_meta(spark, sf_dir):
    return G.extract_page_meta(X.table(spark, sf_dir, "pages"))


def raw_page_text(spark, sf_dir):
    return G.page_text(X.table(spark, sf_dir, "pages"))


def raw_precheck(spark, sf_dir):
    return G.precheck(X.table(spark, sf_dir, "pages")).select("page_id", "schema_ok", "render_ok", F.size("google_warnings").alias("n_warnings"), "rich_results_test_url")


def raw_page_blocks(spark, sf_dir):
    return G.extract_blocks(X.table(spark, sf_dir, "pages")).select("page_id", F.col("order").alias("n"), "id", "type", "text", "xpath")


def _robots(spark, sf_dir):
    body = F.when(F.col("n_nationkey") % 2 == 0, "USER-AGENT : OurBot\nUser-agent:\ndisallow :  /p/1 \nDisallow:").otherwise("User-agent: other\nDisallow: /q")
    files = X.table(spark, sf_dir, "nation").select(F.concat(F.lit("h"), F.col("n_nationkey").cast("string"), F.lit(".example.com")).alias("host"), F.concat(F.lit("User-agent: *\r\nDisallow: /p/2\nAllow: /p/25\n# Disallow: /p/3\n\n"), body).alias("body"))
    return G.parse_robots(files, "OurBot")


def robots_rules(spark, sf_dir):
    return _robots(spark, sf_dir)


def robots_filter(spark, sf_dir):
    urls = X.table(spark, sf_dir, "events").selectExpr("event_id", "'https://u@H' || CAST(user_id % 25 AS STRING) || '.example.com:80/p/' || CAST(event_id AS STRING) || '?x' AS url")
    return G.robots_filter(urls, _robots(spark, sf_dir)).select("event_id")


def _many_rules(spark, sf_dir):
    """A third of all urls, and of all rules, are one host's; rules are of many lengths."""
    host = "CASE WHEN {0} % 3 = 0 THEN 'hot' ELSE 'h' || CAST({0} % 17 AS STRING) END || '.example.com'"
    events = X.table(spark, sf_dir, "events")
    rules = events.selectExpr(host.format("user_id") + " AS host", "'/p/' || CAST(user_id % 100 AS STRING) || CASE WHEN user_id % 2 = 0 THEN '/' || substr('abcdefgh', 1, CAST(1 + user_id % 8 AS INT)) ELSE '' END AS rule").distinct()
    urls = events.selectExpr("event_id", "'https://' || " + host.format("user_id") + " || '/p/' || CAST(event_id % 997 AS STRING) || '/abcdefgh'  AS url")
    return urls, rules


def robots_filter_prefixes(spark, sf_dir):
    urls, rules = _many_rules(spark, sf_dir)
    return G.robots_filter(urls, rules).select("event_id")


def robots_filter_joined(spark, sf_dir):
    """The same with more rules than are broadcast."""
    urls, rules = _many_rules(spark, sf_dir)
    return G.robots_filter(urls, rules, most_rules=1).select("event_id")


QUERIES = {f.__name__: f for f in (page_blocks, page_blocks_with_menu, page_tables, page_text, page_jsonld, page_meta, page_meta_wild, page_jsonld_wild, precheck, raw_page_meta, raw_page_text, raw_precheck, raw_page_blocks, robots_rules, robots_filter, robots_filter_prefixes, robots_filter_joined)}

_BODY = "/[document][1]/html[1]/body[1]"
_BLOCKS = f"""blocks AS (
  SELECT p_partkey AS page_id, 1 AS n, 'heading' AS type, p_name AS text, 0 AS n_items, '{_BODY}/h1[1]' AS xpath, p_name AS payload FROM part
  UNION ALL SELECT p_partkey, 2, 'para', 'Brand ' || p_brand, 0, '{_BODY}/p[1]', 'Brand ' || p_brand FROM part
  UNION ALL SELECT p_partkey, 3, 'para', 'Type: ' || p_type || ' & more', 0, '{_BODY}/p[2]', 'Type: ' || p_type || ' & more' FROM part
  UNION ALL SELECT p_partkey, 4, 'list', 'size ' || p_size || chr(10) || 'call', 2, '{_BODY}/ul[1]', 'size ' || p_size || chr(10) || 'call' FROM part
  UNION ALL SELECT p_partkey, 5, 'table', 'a|b/' || p_brand || '|' || p_type, 0, '{_BODY}/table[1]', '[["a", "b"], ["' || p_brand || '", "' || p_type || '"]]' FROM part)"""

_HOST_OF = "CASE WHEN user_id % 3 = 0 THEN 'hot' ELSE 'h' || user_id % 17 END || '.example.com'"
_PREFIXES = f"""WITH rules AS (SELECT DISTINCT {_HOST_OF} AS host, '/p/' || user_id % 100 || CASE WHEN user_id % 2 = 0 THEN '/' || substr('abcdefgh', 1, 1 + user_id % 8) ELSE '' END AS rule FROM events),
urls AS (SELECT event_id, {_HOST_OF} AS host, '/p/' || event_id % 997 || '/abcdefgh' AS path FROM events)
SELECT event_id FROM urls WHERE NOT EXISTS (SELECT 1 FROM rules WHERE rules.host = urls.host AND starts_with(path, rule))"""

SQL = {
    "robots_filter_prefixes": _PREFIXES,
    "robots_filter_joined": _PREFIXES,
    "page_blocks": f"WITH {_BLOCKS} SELECT page_id, n, printf('b-%04d-', n) || left(sha1(xpath || '|' || payload), 4) AS id, type, text, n_items, xpath FROM blocks",
    "page_blocks_with_menu": "SELECT type, (SELECT count(*) FROM part) * k AS n FROM (VALUES ('heading', 1), ('para', 2), ('list', 2), ('table', 1)) v(type, k)",
    "page_tables": """SELECT p_partkey AS page_id, 0 AS "row", 0 AS col, 'a' AS value FROM part UNION ALL SELECT p_partkey, 0, 1, 'b' FROM part UNION ALL SELECT p_partkey, 1, 0, p_brand FROM part UNION ALL SELECT p_partkey, 1, 1, p_type FROM part""",
    "page_text": "SELECT p_partkey AS page_id, 'menu' || chr(10) || p_name || chr(10) || 'Brand ' || p_brand || chr(10) || 'Type: ' || p_type || ' & more' || chr(10) || 'size ' || p_size || chr(10) || 'call' AS text FROM part",
    "page_jsonld": """SELECT p_partkey AS page_id, 0 AS i, '{"@type":"Product","name":"' || p_name || '"}' AS jsonld FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT p_partkey, 1, '{"@type":"Thing"}' FROM part WHERE p_partkey % 5 = 0
UNION ALL SELECT p_partkey, 0, '{"@context":"https://schema.org","@type":"Product","name":"' || p_name || '"}' FROM part WHERE p_partkey % 5 > 1""",
    "page_meta": """SELECT p_partkey AS page_id, 'https://shop.example.com/' || p_partkey AS canonical, CASE WHEN p_partkey % 3 = 0 THEN true END AS noindex, CASE WHEN p_partkey % 3 = 0 THEN false END AS nofollow, 'en' AS lang, '+1-555-' || p_partkey AS telephone,
  CASE WHEN p_partkey % 4 = 0 THEN '1 Main St Springfield' END AS address_text, CASE WHEN p_partkey % 4 = 0 THEN 'https://goo.gl/maps/' || p_partkey END AS has_map FROM part""",
    "page_meta_wild": """SELECT p_partkey AS page_id, CASE p_partkey % 4 WHEN 0 THEN '/p/' || p_partkey || '?a&b' WHEN 1 THEN '/q' END AS canonical, CASE WHEN p_partkey % 5 = 0 THEN false END AS noindex, CASE WHEN p_partkey % 5 = 0 THEN true END AS nofollow,
  CASE p_partkey % 3 WHEN 0 THEN 'de' WHEN 1 THEN 'en' ELSE 'fr' END AS lang, '+1-2' AS telephone, '1 St X' AS address_text, 'https://www.google.com/maps?q=' || p_partkey AS has_map FROM part""",
    "page_jsonld_wild": """SELECT p_partkey AS page_id, 0 AS i, CASE p_partkey % 6 WHEN 2 THEN '5' ELSE '{"@context":"c","@type":"A"}' END AS jsonld FROM part WHERE p_partkey % 6 > 0
UNION ALL SELECT p_partkey, 1, '{"@type":"B"}' FROM part WHERE p_partkey % 6 = 1""",
    "precheck": """SELECT p_partkey AS page_id, p_partkey % 6 > 2 AND p_partkey % 7 NOT IN (2, 3) AS schema_ok, true AS render_ok, (p_partkey % 6 < 3)::INT + (p_partkey % 7 IN (2, 3))::INT AS n_warnings,
  CASE WHEN p_partkey % 2 = 0 THEN 'https://search.google.com/test/rich-results?url=https%3A%2F%2Fs.example.com%2F' || p_partkey END AS rich_results_test_url FROM part""",
    # The given pages hold none of the facts but a language.
    "raw_page_meta": r"""SELECT page_id, NULL::VARCHAR AS canonical, NULL::BOOLEAN AS noindex, NULL::BOOLEAN AS nofollow, nullif(regexp_extract(html, '(?i)<html[^>]*\slang="([^"]*)"', 1), '') AS lang, NULL::VARCHAR AS telephone, NULL::VARCHAR AS address_text, NULL::VARCHAR AS has_map FROM pages""",
    "raw_precheck": "SELECT page_id, true AS schema_ok, contains(html, '<') AS render_ok, 0 AS n_warnings, 'https://search.google.com/test/rich-results?url=' || replace(url_encode(url), '%20', '+') AS rich_results_test_url FROM pages",
    "robots_rules": "SELECT 'h' || n_nationkey || '.example.com' AS host, CASE WHEN n_nationkey % 2 = 0 THEN '/p/1' ELSE '/p/2' END AS rule FROM nation",
    "robots_filter": "SELECT event_id FROM events WHERE left(event_id::VARCHAR, 1) <> CASE WHEN user_id % 25 % 2 = 0 THEN '1' ELSE '2' END",
}
