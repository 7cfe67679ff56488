"""Lint queries over decorated documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lint as L
from . import fixtures as X

_ROWS = ("doc_id", "rule", "severity", "line", "start", "end", "fix")


def _rule(f):
    return lambda spark, sf_dir: f(X.texts(spark, sf_dir)).select("doc_id", "rule", "severity", "line", "start", F.col("end").alias("stop"), "fix")


def lint_readability(spark, sf_dir):
    rows = L.lint_readability(X.texts(spark, sf_dir), {"guide": 6, "news": 0})
    return rows.select("doc_id", "grade", "target", "n_long", "n_very_long", F.size("notes").alias("n_notes"))


def lint_citation_issues(spark, sf_dir):
    return L.lint_citations(X.texts(spark, sf_dir)).select("doc_id", "rule", "severity", "line", "start", F.col("end").alias("stop"), "sentence", "nth", "claim", "unit", "reason")


def lint_citation_suggestions(spark, sf_dir):
    return L.citation_suggestions(_tails(spark, sf_dir)).select("doc_id", "nth", "claim", "suggestion")


def _tails(spark, sf_dir):
    """Documents whose numbers may stand behind the last whole sentence."""
    return X.table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.when(F.col("doc_id") % 2 == 0, " since 2024, 3x").otherwise(" in 1999.")).alias("text"))


def lint_citation_score(spark, sf_dir):
    return L.citation_scores(X.texts(spark, sf_dir))


def truth(spark):
    return spark.createDataFrame([("wilmington_nc", "+1-910-555-0123", "Wilmington", "NC")], "geo_key string, telephone string, locality string, region string")


#: Rules whose severities a rule set names; all others warn.
GEO_RULES = L.Rules(severity={"geo.nap_mismatch": "error", "geo.region_presence": "info"})


def lint_geo(spark, sf_dir):
    return L.lint_geo(X.texts(spark, sf_dir), truth(spark), "wilmington_nc", GEO_RULES).select("doc_id", "rule", "severity", "fix")


def lint_phrase_table(spark, sf_dir):
    """Phrases of a table, the first two and the next three words of each benchmark item, in all documents."""
    return L.find_phrases(X.table(spark, sf_dir, "documents"), _phrase_table(spark, sf_dir)).select("doc_id", "phrase", "fix", "at", "line", "start", F.col("end").alias("stop"))


def _phrase_table(spark, sf_dir):
    words = F.split(F.regexp_replace("text", r"\s+", " "), " ")
    pairs = F.array(F.struct(F.array_join(F.slice(words, 1, 2), " ").alias("phrase"), F.lit("two").alias("fix")), F.struct(F.translate(F.array_join(F.slice(words, 2, 3), " "), "aeio", "AEIO").alias("phrase"), F.lit("three").alias("fix")))
    return X.table(spark, sf_dir, "benchmark").select(F.inline(pairs)).distinct()


def claim_support(spark, sf_dir):
    return L.numeric_claims(X.texts(spark, sf_dir)).select("doc_id", "sentence", "nth", "claim", "supported")


def line_spans(spark, sf_dir):
    """Where each document's first and last quarter begin and end, as lines and offsets in them."""
    quarter = F.floor(F.length("text") / 4).cast("int")
    given = F.array(F.struct(F.lit(-3).alias("start"), quarter.alias("end")), F.struct((3 * quarter).alias("start"), F.length("text").alias("end")), F.struct(quarter.alias("start"), F.lit(0).alias("end")))
    return L.line_spans(X.table(spark, sf_dir, "documents").withColumn("spans", given)).select("doc_id", "nth", "line", "start", F.col("end").alias("stop"))


def lint_style_ordered(spark, sf_dir):
    ordered = L.ordered_issues(X.texts(spark, sf_dir))
    return ordered.select("doc_id", F.size("issues").alias("n_issues"), F.array_join(F.transform("issues", lambda i: F.concat_ws(":", i["line"].cast("string"), i["start"].cast("string"), i["rule"])), ",").alias("issues"))


QUERIES = {
    "lint_tldr": _rule(L.lint_tldr), "lint_forbidden": _rule(L.lint_forbidden), "lint_comparison": _rule(L.lint_comparison), "lint_brand": _rule(L.lint_brand), "lint_quotables": _rule(L.lint_quotables), "lint_h2": _rule(L.lint_h2),
    "lint_readability": lint_readability, "lint_citation_issues": lint_citation_issues, "lint_citation_suggestions": lint_citation_suggestions, "lint_citation_score": lint_citation_score, "lint_geo": lint_geo, "lint_style_ordered": lint_style_ordered,
    "lint_phrase_table": lint_phrase_table, "claim_support": claim_support, "line_spans": line_spans,
}

_T = X.TEXTS_SQL
_R = L.DEFAULT


def _whole(rule: str, fix: str, where: str) -> str:
    return f"SELECT doc_id, '{rule}' AS rule, '{_R.severity_for(rule)}' AS severity, 1 AS line, 0 AS start, 0 AS stop, '{fix}' AS fix FROM texts WHERE {where}"


_AT = "1 + length(substr(text, 1, p0)) - length(replace(substr(text, 1, p0), chr(10), ''))", "length(string_split(substr(text, 1, p0), chr(10))[-1])"


def _phrases(rule: str, needles: dict[str, str]) -> str:
    pairs = ", ".join("('{}', '{}')".format(n.replace("'", "''"), fix.replace("'", "''")) for n, fix in needles.items())
    return f"""SELECT doc_id, '{rule}' AS rule, '{_R.severity_for(rule)}' AS severity, {_AT[0]} AS line, {_AT[1]} AS start, {_AT[1]} + length(needle) AS stop, fix
FROM (SELECT doc_id, text, needle, fix, (k - 1) * length(needle) + list_sum(list_transform(parts[1:k], lambda x: length(x)))::BIGINT AS p0
  FROM (SELECT doc_id, text, needle, fix, parts, unnest(range(1, len(parts))) AS k
    FROM (SELECT doc_id, text, needle, fix, string_split(lower(text), lower(needle)) AS parts FROM texts CROSS JOIN (VALUES {pairs}) p(needle, fix))))"""


_TABLE = r"""(regexp_matches(text, '(?i)<table\b') OR regexp_matches(text, '(?m)^[^\n]*\|[^\n]*\n\s*\|?\s*:?-{3,}\s*(\|\s*:?-{3,}\s*)+\|?\s*$') OR (contains(text, '|') AND regexp_matches(text, '(?m)^-{3,}')))"""
_FIRST = "CASE " + " ".join(f"WHEN contains(lower(text), '{t}') THEN '{t}'" for t in _R.triggers) + " END"
_COMPARISON = f"""SELECT doc_id, 'comparison.table_missing' AS rule, 'error' AS severity, {_AT[0]} AS line, {_AT[1]} AS start, {_AT[1]} + length(t) AS stop, 'Sum the comparison up in a table.' AS fix
FROM (SELECT doc_id, text, t, strpos(lower(text), t) - 1 AS p0 FROM (SELECT doc_id, text, {_FIRST} AS t FROM texts) WHERE t IS NOT NULL AND NOT {_TABLE})"""
_SENTENCES = "regexp_extract_all(text, '([^.!?]+[.!?])', 1)"
_QUOTABLES = _whole("quotables.too_few", "Write at least 5 sentences of at most 140 characters.", rf"len(list_filter({_SENTENCES}, lambda s: length(regexp_replace(s, '^\s+|\s+$', '', 'g')) <= 140)) < 5")
# The parts of a text in order: a heading, which may go over several lines, a line feed, or the rest of a line.
_H2 = r"""SELECT doc_id, 'scannability.h2_question' AS rule, 'warn' AS severity, line, 0 AS start, length(s) AS stop, 'Word second-level headings as questions.' AS fix
FROM (SELECT doc_id, s, 1 + coalesce(sum(length(s) - length(replace(s, chr(10), ''))) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line
  FROM (SELECT doc_id, p[n] AS s, n FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS n FROM (SELECT doc_id, regexp_extract_all(text, '(?m)^##\s+.+$|\n|[^\n]+') AS p FROM texts))))
WHERE regexp_matches(s, '^##\s+.') AND NOT regexp_matches(s, '\?\s*$')"""
_TLDR = _whole("tldr.missing", "Put a summary marker into the first 400 characters.", " AND ".join(f"NOT contains(lower(substr(text, 1, 400)), '{m}')" for m in _R.markers))
_FORBIDDEN = _phrases("forbidden.phrase", _R.forbidden)
_BRAND = _phrases("brand.glossary.mismatch", {v: f"Write '{_R.brand}'." for v in _R.brand_variants})
_NUMBER, _CITE = _R.number.replace("(?:\\$", "(?:\\$"), _R.citation
_CLAIMS = f"""sents AS (SELECT doc_id, n - 1 AS sentence, s[n] AS s FROM (SELECT doc_id, {_SENTENCES} AS s, unnest(range(1, len({_SENTENCES}) + 1)) AS n FROM texts)),
windowed AS (SELECT doc_id, sentence, s, max(regexp_matches(s, '{_CITE}')::INT) OVER (PARTITION BY doc_id ORDER BY sentence ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 1 AS supported FROM sents),
claims AS (SELECT doc_id, sentence, k - 1 AS nth, c[k] AS claim, supported FROM (SELECT doc_id, sentence, supported, regexp_extract_all(s, '({_NUMBER})', 1) AS c, unnest(range(1, len(regexp_extract_all(s, '({_NUMBER})', 1)) + 1)) AS k FROM windowed))"""
# All parts of a text in order, lone end marks too, so that lengths add up to places.
_SPANS = f"""parts AS (SELECT doc_id, text, p, n, s, coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins
  FROM (SELECT doc_id, text, p, n, p[n] AS s FROM (SELECT doc_id, text, p, unnest(range(1, len(p) + 1)) AS n FROM (SELECT doc_id, text, regexp_extract_all(text, '([^.!?]+[.!?]?|[.!?])', 1) AS p FROM texts)))),
sents AS (SELECT doc_id, text, s, begins, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS sentence FROM parts WHERE length(s) > 1 AND right(s, 1) IN ('.', '!', '?')),
windowed AS (SELECT *, max(regexp_matches(s, '{_CITE}')::INT) OVER (PARTITION BY doc_id ORDER BY sentence ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 1 AS supported FROM sents),
listed AS (SELECT *, regexp_extract_all(s, '({_NUMBER})', 1) AS c, string_split(regexp_replace(s, '{_NUMBER}', chr(1), 'g'), chr(1)) AS g FROM windowed WHERE NOT supported),
claims AS (SELECT doc_id, text, sentence, k - 1 AS nth, c[k] AS claim, begins + length(array_to_string(g[1:k], '')) + length(array_to_string(c[1:k - 1], '')) AS p0 FROM (SELECT *, unnest(range(1, len(c) + 1)) AS k FROM listed))"""
_UNIT = r"lower(regexp_extract(claim, '^\$?\d[\d,]*(?:\.\d+)?\s*([A-Za-z%$]+)', 1))"
_WORDS = "regexp_extract_all(text, '([A-Za-z]+(?:''[A-Za-z]+)?)', 1)"
_SYL = "len(regexp_extract_all(lower(replace(w, '''', '')), '([aeiouy]+)', 1))"
_PARTS = r"list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: length(p) > 0)"
_STYLE = f"SELECT * FROM ({_TLDR}) UNION ALL SELECT * FROM ({_FORBIDDEN}) UNION ALL SELECT * FROM ({_COMPARISON}) UNION ALL SELECT * FROM ({_BRAND}) UNION ALL SELECT * FROM ({_QUOTABLES}) UNION ALL SELECT * FROM ({_H2})"
_DIGITS = "regexp_replace(text, '[^0-9]+', '', 'g')"

SQL = {
    "lint_tldr": f"WITH {_T} {_TLDR}",
    "lint_forbidden": f"WITH {_T} {_FORBIDDEN}",
    "lint_comparison": f"WITH {_T} {_COMPARISON}",
    "lint_brand": f"WITH {_T} {_BRAND}",
    "lint_quotables": f"WITH {_T} {_QUOTABLES}",
    "lint_h2": f"WITH {_T} {_H2}",
    "lint_readability": f"""WITH {_T}, parts AS (SELECT doc_id, page_type, {_WORDS} AS words, {_PARTS} AS parts FROM texts),
counted AS (SELECT doc_id, CASE WHEN page_type = 'guide' THEN 6 ELSE 8 END AS target, len(words) AS nw, len(parts) AS ns,
    list_sum(list_transform(words, lambda w: greatest(1, {_SYL} - CASE WHEN {_SYL} > 1 AND lower(w) LIKE '%e' THEN 1 ELSE 0 END))) AS syl,
    len(list_filter(parts, lambda p: len(regexp_extract_all(p, '(\\S+)', 1)) > 28)) AS n_long, len(list_filter(parts, lambda p: len(regexp_extract_all(p, '(\\S+)', 1)) > 40)) AS n_very_long FROM parts),
graded AS (SELECT *, CASE WHEN nw = 0 THEN 0.0::DOUBLE ELSE round(0.39::DOUBLE * (nw::DOUBLE / greatest(1, ns)) + 11.8::DOUBLE * (syl::DOUBLE / nw) - 15.59::DOUBLE, 2) END AS grade FROM counted)
SELECT doc_id, grade, target, n_long, n_very_long, (grade > target)::INT + (n_long > 0)::INT + (n_very_long > 0)::INT AS n_notes FROM graded""",
    "lint_citation_issues": f"""WITH {_T}, {_SPANS}, noted AS (SELECT *, CASE WHEN {_UNIT} NOT IN ('', {', '.join(f"'{u}'" for u in _R.units)}) THEN {_UNIT} END AS unit FROM claims)
SELECT doc_id, 'citations.numeric_claim_missing' AS rule, 'warn' AS severity, {_AT[0]} AS line, {_AT[1]} AS start, {_AT[1]} + length(claim) AS stop, sentence, nth, claim, unit,
  'No citation within 3 sentences of ' || claim || CASE WHEN unit IS NULL THEN '' ELSE ' (unit ' || unit || ' is not among the allowed ones)' END || '.' AS reason FROM noted""",
    "lint_citation_suggestions": f"""WITH texts AS (SELECT doc_id, text || CASE WHEN doc_id % 2 = 0 THEN ' since 2024, 3x' ELSE ' in 1999.' END AS text FROM documents),
numbered AS (SELECT doc_id, regexp_extract_all(text, '({_NUMBER})', 1) AS c FROM texts WHERE NOT regexp_matches(text, '{_CITE}') AND len(list_filter({_SENTENCES}, lambda s: regexp_matches(s, '{_NUMBER}'))) = 0)
SELECT doc_id, k - 1 AS nth, c[k] AS claim, 'Cite a source for ' || c[k] || '.' AS suggestion FROM (SELECT *, unnest(range(1, len(c) + 1)) AS k FROM numbered)""",
    "lint_citation_score": f"""WITH {_T}, {_CLAIMS}, summed AS (SELECT doc_id, count(*) AS total, count_if(supported) AS supported FROM claims GROUP BY doc_id)
SELECT t.doc_id, regexp_matches(text, '{_CITE}') AS has_citation, coalesce(total, 0) AS total, coalesce(supported, 0) AS supported, CASE WHEN total IS NULL THEN 1.0::DOUBLE ELSE round(supported::DOUBLE / total, 3) END AS score FROM texts t LEFT JOIN summed USING (doc_id)""",
    "lint_geo": f"""WITH {_T}, keyed AS (SELECT doc_id, text FROM texts WHERE coalesce(geo_key, 'wilmington_nc') = 'wilmington_nc')
SELECT doc_id, 'geo.nap_mismatch' AS rule, 'error' AS severity, 'Give the telephone number as listed.' AS fix FROM keyed WHERE NOT contains({_DIGITS}, '19105550123')
UNION ALL SELECT doc_id, 'geo.city_presence', 'warn', 'Name the city: Wilmington' FROM keyed WHERE NOT contains(lower(text), 'wilmington')
UNION ALL SELECT doc_id, 'geo.region_presence', 'info', 'Name the region: NC' FROM keyed WHERE NOT contains(lower(text), 'nc')""",
    "lint_phrase_table": r"""WITH words AS (SELECT string_split(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS w FROM benchmark),
phrases AS (SELECT DISTINCT array_to_string(w[1:2], ' ') AS phrase, 'two' AS fix FROM words UNION SELECT DISTINCT translate(array_to_string(w[2:4], ' '), 'aeio', 'AEIO'), 'three' FROM words),
parts AS (SELECT doc_id, text, phrase, fix, string_split(lower(text), lower(phrase)) AS p FROM documents JOIN phrases ON contains(lower(text), lower(phrase))),
found AS (SELECT doc_id, text, phrase, fix, (k - 1) * length(phrase) + list_sum(list_transform(p[1:k], lambda x: length(x)))::BIGINT AS p0 FROM (SELECT *, unnest(range(1, len(p))) AS k FROM parts))
SELECT doc_id, phrase, fix, p0 AS at, """ + f"{_AT[0]} AS line, {_AT[1]} AS start, {_AT[1]} + length(phrase) AS stop FROM found",
    "claim_support": f"WITH {_T}, {_CLAIMS} SELECT doc_id, sentence, nth, claim, supported FROM claims",
    "line_spans": f"""WITH given AS (SELECT doc_id, text, length(text) // 4 AS q FROM documents),
placed AS (SELECT doc_id, text, 0 AS nth, 0 AS p0, q AS n FROM given UNION ALL SELECT doc_id, text, 1, 3 * q, length(text) - 3 * q FROM given UNION ALL SELECT doc_id, text, 2, q, 0 FROM given)
SELECT doc_id, nth, {_AT[0]} AS line, {_AT[1]} AS start, {_AT[1]} + n AS stop FROM placed""",
    "lint_style_ordered": f"""WITH {_T}, issues AS ({_STYLE})
SELECT doc_id, count(*) AS n_issues, string_agg(line || ':' || start || ':' || rule, ',' ORDER BY line, start, rule, fix) AS issues FROM issues GROUP BY doc_id""",
}
