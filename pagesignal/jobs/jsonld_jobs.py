"""JSON-LD queries over part, customer, nation, conversations, and their SQL."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from ..functions.json_text import json_stable
from ..operators import jsonld as J
from . import fixtures as X


def _null_unless(condition: str, value):
    return F.when(F.expr(condition), value)


def jsonld_products(spark, sf_dir):
    c, key = F.col, F.col("p_partkey").cast("string")
    made = J.product(c("p_name"), _null_unless("p_partkey % 2 = 0", key), _null_unless("p_partkey % 3 > 0", c("p_brand")), _null_unless("p_partkey % 5 > 0", F.concat(c("p_size").cast("string"), F.lit(".00"))), F.lit("USD"), F.lit("https://schema.org/InStock"))
    return X.table(spark, sf_dir, "part").select("p_partkey", made.alias("jsonld"))


def jsonld_businesses(spark, sf_dir):
    c, key = F.col, F.col("c_custkey").cast("string")
    hours = F.array(F.struct(F.lit("Monday").alias("day"), F.lit("09:00").alias("opens"), F.lit("17:00").alias("closes")))
    address = _null_unless("c_custkey % 3 = 0", J.postal_address(F.concat(key, F.lit(" Main St")), c("c_mktsegment"), F.lit("NC"), F.lit("28401"), F.lit("US")))
    made = J.local_business(c("c_name"), _null_unless("c_custkey % 2 = 0", F.concat(F.lit("https://b.example.com/"), key)), F.lit("+1-910-555-0123"), F.lit(None).cast("string"), address, J.geo_coordinates(_null_unless("c_custkey % 5 = 0", c("c_nationkey")), F.lit(-77)), _null_unless("c_custkey % 7 = 0", J.opening_hours(hours)), F.lit(None).cast("string"))
    return X.table(spark, sf_dir, "customer").select("c_custkey", made.alias("jsonld"))


def jsonld_faq(spark, sf_dir):
    turns = X.table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    told = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return J.faq_pages(asked.join(told, ["conv_id", "turn"]), "conv_id", "turn", F.col("question"), F.col("answer"))


def jsonld_item_lists(spark, sf_dir):
    key = F.col("l_partkey").cast("string")
    return J.item_lists(X.table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", F.concat(F.lit("https://s.example.com/"), key), key)


def jsonld_breadcrumbs(spark, sf_dir):
    name = F.col("n_name")
    return J.breadcrumbs(X.table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", F.concat(F.lit("https://g.example.com/"), name), name)


def jsonld_articles(spark, sf_dir):
    docs = X.corpus(spark, sf_dir)
    made = J.article(F.col("title"), F.coalesce("last_modified", F.lit("2024-01-01")), F.col("jurisdiction"), F.lit(None).cast("string"), F.col("url"))
    return docs.select("id", made.alias("jsonld"))


def jsonld_web_pages(spark, sf_dir):
    c = F.col
    pages = X.table(spark, sf_dir, "nation")
    city = J.city_service_page(F.concat(F.lit("Roofing in "), c("n_name")), F.concat(F.lit("https://g.example.com/"), c("n_name")), F.lit("https://g.example.com/"), F.lit("https://g.example.com/hub"), c("n_name"), F.lit("Roofing"), F.lit("NC"))
    return pages.select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, J.web_page(c("n_name"), F.lit("d"), F.lit("u"))).otherwise(city).alias("jsonld"))


#: One object for each customer: good ones, and each kind of fault.
OBJECTS = {
    "object_id": "c_custkey",
    "jsonld": """CASE c_custkey % 18
      WHEN 0 THEN '{"@context":"https://schema.org","@type":"LocalBusiness","name":"' || c_name || '","telephone":"1","sameAs":["x"],"geo":{"@type":"GeoCoordinates","latitude":1.5,"longitude":"2"},"address":{"@type":"PostalAddress","streetAddress":"s","addressLocality":"l","addressRegion":"r","postalCode":"p","addressCountry":"c"}}'
      WHEN 1 THEN '{"@context":"https://schema.org","@type":["Place","LocalBusiness"],"name":"","image":3,"address":{"@type":"PostalAddress","streetAddress":"s"}}'
      WHEN 2 THEN '{"@context":"http://schema.org","@type":"Product","name":"p","sku":5,"offers":{"@type":"Offer","price":1.5}}'
      WHEN 3 THEN '{"@context":"https://schema.org","@type":"Product","name":"p","brand":"b","offers":{"@type":"Offer","price":"1","priceCurrency":"USD"}}'
      WHEN 4 THEN '{"@context":"https://schema.org","@type":"Article","headline":"h","author":"a"}'
      WHEN 5 THEN '{"@context":"https://schema.org","@type":"FAQPage","mainEntity":[{"@type":"Question","name":"q","acceptedAnswer":{"@type":"Answer","text":"t"}},{"@type":"Question","name":7}]}'
      WHEN 6 THEN '{"@context":"https://schema.org","@type":"FAQPage","mainEntity":[]}'
      WHEN 7 THEN '{"@context":"https://schema.org","@type":"BreadcrumbList","itemListElement":[{"@type":"ListItem","position":1,"item":"u"},{"@type":"ListItem","position":3,"item":{}}]}'
      WHEN 8 THEN '{"@context":"https://schema.org","@type":"ItemList","itemListElement":[1,2,3,4,5,6]}'
      WHEN 9 THEN '{"@type":"Thing"}'
      WHEN 10 THEN '[1]'
      WHEN 11 THEN '{"@context":"https://schema.org","@type":["HowTo"],"name":"x"}'
      WHEN 12 THEN '{"@context":"https://schema.org","@type":["Product","Thing"],"name":"p","brand":"b","offers":{}}'
      WHEN 13 THEN '{"@context":"https://schema.org","@type":"LocalBusiness","name":"n","telephone":"1","sameAs":["x",5],"hasMap":"m","address":"a"}'
      WHEN 14 THEN '{"@context":"https://schema.org","@type":"BreadcrumbList","itemListElement":["x",{"@type":"ListItem","position":0,"item":"u"},{"@type":"ListItem","position":"2","item":"u"}]}'
      WHEN 15 THEN '{"@context":"https://schema.org","@type":"FAQPage","mainEntity":[5,{"@type":"Question","name":"q","acceptedAnswer":{"@type":"Answer"}}]}'
      WHEN 16 THEN '{"@context":"https://schema.org","@type":"Product","name":"p","brand":["b"],"offers":{"@type":"Offer","price":"1","priceCurrency":"USD","availability":1}}'
      ELSE '{"@context":"https://schema.org","@type":"BreadcrumbList","itemListElement":[{"@type":"ListItem","position":1,"item":"u"},{"@type":"ListItem","item":"u"}]}' END""",
    "page_url": "'https://x.example.com/' || CASE WHEN c_custkey % 5 = 0 THEN 'FAQ/' ELSE 'about' END || '?q'",
    "page_path": "CASE WHEN c_custkey % 7 = 0 THEN '/faq/x' END",
}


def _objects(spark, sf_dir):
    return X.shaped(spark, sf_dir, "customer", OBJECTS)


def jsonld_validate(spark, sf_dir):
    return J.validate_jsonld(_objects(spark, sf_dir))


def jsonld_validity(spark, sf_dir):
    return J.validity(_objects(spark, sf_dir))


def jsonld_suggest(spark, sf_dir):
    return J.suggestions(_objects(spark, sf_dir))


def jsonld_google(spark, sf_dir):
    return J.google_warnings(_objects(spark, sf_dir))


def jsonld_normalize(spark, sf_dir):
    rows = J.normalize(_objects(spark, sf_dir))
    return rows.select("object_id", json_stable(F.col("normal")).alias("normal"))


def jsonld_enrich(spark, sf_dir):
    organizations = X.table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "CAST(s_nationkey % 5 AS STRING) AS market", """CASE WHEN s_suppkey % 3 = 0 THEN '{"@type":"Organization","areaServed":"all"}' ELSE '{"@type":"Organization"}' END AS jsonld""")
    # Places stand against the order of their names, one of them twice; the places of one market are listed outright.
    registry = X.table(spark, sf_dir, "nation").selectExpr("CAST(n_regionkey AS STRING) AS market", "CASE WHEN n_regionkey = 2 THEN 'areaServed' WHEN n_nationkey % 3 = 0 THEN 'county' WHEN n_nationkey % 3 = 1 THEN 'city' ELSE 'zips' END AS kind", "explode(array(-n_nationkey, 50 - n_nationkey)) AS nth", "n_name AS name").where("nth <= 0 OR kind = 'city'")
    services = X.table(spark, sf_dir, "region").selectExpr("-r_regionkey AS nth", "CASE WHEN r_regionkey = 3 THEN 'AFRICA' WHEN r_regionkey = 4 THEN '' ELSE r_name END AS service")
    return J.enrich_organizations(organizations, registry, services, "market").select("s_suppkey", json_stable(F.col("jsonld")).alias("jsonld"))


QUERIES = {f.__name__: f for f in (jsonld_products, jsonld_businesses, jsonld_faq, jsonld_item_lists, jsonld_breadcrumbs, jsonld_articles, jsonld_web_pages, jsonld_validate, jsonld_validity, jsonld_suggest, jsonld_google, jsonld_normalize, jsonld_enrich)}

_HEAD = "'@context': 'https://schema.org', '@type': '{}'"


def _made(kind: str, fields: str) -> str:
    return f"json_merge_patch('{{}}', to_json({{{_HEAD.format(kind)}, {fields}}}))::VARCHAR"


_IN = "object_id % 18"
_O = f"objects AS ({X.sql('customer', OBJECTS)})"


def _faults(table: dict[int, list[str]], column: str, fixed: str = "") -> str:
    rows = ", ".join(f"({k}, '{p}')" for k, paths in table.items() for p in paths)
    return f"SELECT object_id, {column}{fixed} FROM objects JOIN (VALUES {rows}) f(k, {column}) ON {_IN} = k"


# By the contracts: what is absent counts against what should hold it, what is wrong against its own path.
_BROKEN = {
    1: ["/name", "/image", "/address", "/address", "/address", "/address"],
    2: ["/@context", "/sku", "/offers"], 4: ["/"], 5: ["/mainEntity/1/name", "/mainEntity/1"], 6: ["/mainEntity"],
    12: ["/@type", "/offers", "/offers", "/offers"], 13: ["/sameAs/1", "/address"], 14: ["/itemListElement/0", "/itemListElement/1/position", "/itemListElement/2/position"],
    15: ["/mainEntity/0", "/mainEntity/1/acceptedAnswer"], 16: ["/brand", "/offers/availability"], 17: ["/itemListElement/1"],
}
_ADVICE = {
    1: ["add telephone", "add geo or hasMap", "add sameAs"], 2: ["add priceCurrency", "add brand"], 4: ["add image"],
    6: ["add a question"], 7: ["number positions from 1"], 8: ["add itemListOrder"], 10: ["set @type"],
    13: ["add a postal address"], 14: ["number positions from 1"], 17: ["number positions from 1"],
}


def _normalized(text: str) -> str | None:
    """The rule on one text, plainly: a default context, and a @type list of one as its element."""
    value = json.loads(text)
    if not isinstance(value, dict):
        return None
    value.setdefault("@context", "https://schema.org")
    if isinstance(value.get("@type"), list) and len(value["@type"]) == 1:
        value["@type"] = value["@type"][0]
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _literal(text: str | None) -> str:
    return "NULL" if text is None else f"'{text}'"


#: The fixture's objects one by one, each put into its normal form; the name is joined in as in the fixture.
_CASES = re.findall(r"(?:WHEN (\d+) THEN|ELSE) '(.*)'(?: END)?$", OBJECTS["jsonld"], re.M)
_NORMAL = "CASE c_custkey % 18 " + " ".join(f"{f'WHEN {n} THEN' if n else 'ELSE'} {_literal(_normalized(x))}" for n, x in _CASES) + " END"

SQL = {
    "jsonld_products": "SELECT p_partkey, " + _made("Product", "'name': p_name, 'sku': CASE WHEN p_partkey % 2 = 0 THEN p_partkey::VARCHAR END, 'brand': CASE WHEN p_partkey % 3 > 0 THEN {'@type': 'Brand', 'name': p_brand} END, 'offers': CASE WHEN p_partkey % 5 > 0 THEN {'@type': 'Offer', 'price': p_size || '.00', 'priceCurrency': 'USD', 'availability': 'https://schema.org/InStock'} END") + " AS jsonld FROM part",
    "jsonld_businesses": "SELECT c_custkey, " + _made("LocalBusiness", """'name': c_name, 'url': CASE WHEN c_custkey % 2 = 0 THEN 'https://b.example.com/' || c_custkey END, 'telephone': '+1-910-555-0123',
  'address': CASE WHEN c_custkey % 3 = 0 THEN {'@type': 'PostalAddress', 'streetAddress': c_custkey || ' Main St', 'addressLocality': c_mktsegment, 'addressRegion': 'NC', 'postalCode': '28401', 'addressCountry': 'US'} END,
  'geo': CASE WHEN c_custkey % 5 = 0 THEN {'@type': 'GeoCoordinates', 'latitude': c_nationkey, 'longitude': -77} END,
  'openingHoursSpecification': CASE WHEN c_custkey % 7 = 0 THEN [{'@type': 'OpeningHoursSpecification', 'dayOfWeek': 'Monday', 'opens': '09:00', 'closes': '17:00'}] END""") + " AS jsonld FROM customer",
    "jsonld_faq": """SELECT q.conv_id, to_json({'@context': 'https://schema.org', '@type': 'FAQPage', 'mainEntity': list({'@type': 'Question', 'name': q.text, 'acceptedAnswer': {'@type': 'Answer', 'text': a.text}} ORDER BY q.turn)})::VARCHAR AS jsonld
FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant' GROUP BY q.conv_id""",
    "jsonld_item_lists": """SELECT l_orderkey, to_json({'@context': 'https://schema.org', '@type': 'ItemList', 'itemListElement': list({'@type': 'ListItem', 'position': n, 'url': 'https://s.example.com/' || l_partkey, 'name': l_partkey::VARCHAR} ORDER BY n)})::VARCHAR AS jsonld
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'https://s.example.com/' || l_partkey, l_partkey::VARCHAR) AS n FROM lineitem) GROUP BY l_orderkey""",
    "jsonld_breadcrumbs": """SELECT n_regionkey, to_json({'@context': 'https://schema.org', '@type': 'BreadcrumbList', 'itemListElement': list({'@type': 'ListItem', 'position': n, 'item': {'@id': 'https://g.example.com/' || n_name, 'name': n_name}} ORDER BY n)})::VARCHAR AS jsonld
FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS n FROM nation) GROUP BY n_regionkey""",
    "jsonld_articles": f"WITH {X.CORPUS_SQL} SELECT id, " + _made("Article", "'headline': title, 'datePublished': coalesce(last_modified, '2024-01-01'), 'author': CASE WHEN jurisdiction IS NOT NULL THEN {'@type': 'Person', 'name': jurisdiction} END, 'mainEntityOfPage': url") + " AS jsonld FROM corpus",
    "jsonld_web_pages": """SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN to_json({'@context': 'https://schema.org', '@type': 'WebPage', 'name': n_name, 'description': 'd', 'url': 'u'})::VARCHAR
ELSE to_json({'@context': 'https://schema.org', '@type': ['WebPage', 'ItemPage'], 'name': 'Roofing in ' || n_name, 'url': 'https://g.example.com/' || n_name,
  'breadcrumb': {'@type': 'BreadcrumbList', 'itemListElement': [{'@type': 'ListItem', 'position': 1, 'item': {'@id': 'https://g.example.com/', 'name': 'Home'}}, {'@type': 'ListItem', 'position': 2, 'item': {'@id': 'https://g.example.com/hub', 'name': n_name}}]},
  'mainEntity': {'@type': 'Service', 'serviceType': 'Roofing', 'areaServed': n_name || ' NC'}})::VARCHAR END AS jsonld FROM nation""",
    "jsonld_validate": f"WITH {_O} {_faults(_BROKEN, 'path', ', ' + chr(39) + 'schema.validation' + chr(39) + ' AS rule')} UNION ALL SELECT object_id, '/', CASE {_IN} WHEN 9 THEN 'core.required' ELSE 'core.type' END FROM objects WHERE {_IN} IN (9, 10)",
    "jsonld_validity": f"WITH {_O} SELECT object_id, {_IN} NOT IN (1, 2, 4, 5, 6, 9, 10, 12, 13, 14, 15, 16, 17) AS valid FROM objects",
    "jsonld_suggest": f"WITH {_O} {_faults(_ADVICE, 'advice')}",
    "jsonld_google": f"WITH {_O} SELECT object_id, CASE WHEN {_IN} = 11 THEN 'HowTo results are limited' ELSE 'FAQPage outside /faq' END AS warning FROM objects WHERE {_IN} = 11 OR ({_IN} IN (5, 6, 15) AND object_id % 7 > 0 AND object_id % 5 > 0)",
    "jsonld_enrich": """WITH listed AS (SELECT n_regionkey AS k, n_name, n_nationkey AS nth, CASE WHEN n_regionkey = 2 THEN 'areaServed' WHEN n_nationkey % 3 = 0 THEN 'county' WHEN n_nationkey % 3 = 1 THEN 'city' ELSE 'zips' END AS kind FROM nation),
places AS (SELECT k, string_agg('{"@type":"Place","name":"' || n_name || '"}', ',' ORDER BY rank, last, nth DESC) AS names FROM (SELECT *, CASE kind WHEN 'county' THEN 2 ELSE 1 END AS rank, 0 AS last FROM listed WHERE kind <> 'zips' UNION ALL SELECT *, 1, 1 FROM listed WHERE kind = 'city') GROUP BY k),
offers AS (SELECT string_agg('{"@type":"Offer","itemOffered":{"@type":"Service","name":"' || CASE r_regionkey WHEN 3 THEN 'AFRICA' ELSE r_name END || '"}}', ',' ORDER BY r_regionkey DESC) AS names FROM region WHERE r_regionkey <> 4)
SELECT s_suppkey, '{"@type":"Organization",' || CASE WHEN s_suppkey % 3 = 0 THEN '"areaServed":"all",' WHEN names IS NULL THEN '' ELSE '"areaServed":[' || names || '],' END || '"hasOfferCatalog":{"@type":"OfferCatalog","itemListElement":[' || (SELECT names FROM offers) || '],"name":"Services"}}' AS jsonld FROM supplier LEFT JOIN places ON s_nationkey % 5 = k""",
    "jsonld_normalize": f"SELECT c_custkey AS object_id, {_NORMAL} AS normal FROM customer",
}
