"""Checks of texts, each giving rows ``doc_id, rule, severity, line, start, end, fix``.

Texts: ``doc_id, text``. Lines count from 1, offsets within the line from 0, ends exclusive.

Rules about a whole text are column expressions. Rules that name places go through a text once in an Arrow batch: the starts of its lines
are found once and searched by bisection, a sentence scan carries its offsets, and the phrases of a table are found by one
automaton. All is linear in the text and its hits, and no rule shuffles.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import spans
from ..functions.text import alphabetic_words, grade_of, let, sentences, split_sentences, strip, word_count
from .per_row import per_row


@dataclass(frozen=True)
class Rules:
    """The default rule set."""

    markers: tuple[str, ...] = ("tl;dr:", "summary:", "tldr:")
    marker_window: int = 400
    forbidden: dict[str, str] = field(default_factory=lambda: {"click here": "Name what the link leads to.", "cutting-edge": "Say what is new about it.", "world-class": "Give the figure or award.", "utilize": "use"})
    triggers: tuple[str, ...] = (" vs ", "comparison", "compare", "pros and cons")
    brand: str = "Port City Fence"
    brand_variants: tuple[str, ...] = ("Port City fences", "PortCity Fence", "PC Fence")
    quotable_chars: int = 140
    least_quotables: int = 5
    target_grade: int = 8
    long_words: int = 28
    very_long_words: int = 40
    window: int = 3
    number: str = r"(?:\$\d[\d,]*(?:\.\d+)?|\b\d{4}\b|\b\d+(?:%|x)\b)"
    citation: str = r"(?:\[[0-9]+\])|(?:https?://[^ )\]]+)"
    # What every number and every citation holds: quick to look for, so the patterns run on few sentences.
    number_hint: str = "[0-9]"
    citation_hint: str = r"\[|http"
    units: tuple[str, ...] = ("ft", "%", "$", "in", "mph", "psi")
    severity: dict[str, str] = field(default_factory=lambda: {"tldr.missing": "error", "comparison.table_missing": "error"})

    def severity_for(self, rule: str) -> str:
        return self.severity.get(rule, "warn")


DEFAULT = Rules()


def _text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def issue(rule: str, rules: Rules, line: Column, start: Column, end: Column, fix: Column) -> list[Column]:
    return [F.lit(rule).alias("rule"), F.lit(rules.severity_for(rule)).alias("severity"), line.cast("int").alias("line"), start.cast("int").alias("start"), end.cast("int").alias("end"), fix.alias("fix")]


def whole_text_issue(rule: str, rules: Rules, fix: str) -> list[Column]:
    return issue(rule, rules, F.lit(1), F.lit(0), F.lit(0), F.lit(fix))


def line_of(text: Column, at: Column) -> Column:
    """1-based line of an offset."""
    before = F.substring(text, F.lit(1), at)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def offset_in_line(text: Column, at: Column) -> Column:
    return F.length(F.substring_index(F.substring(text, F.lit(1), at), "\n", -1))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def hits_ci(texts: pd.Series, needles: pd.Series) -> pd.Series:
    """Offsets of all hits of a needle without regard to case, overlapping ones too."""
    return pd.Series([[begin for begin, _, _ in spans.hits(spans.automaton([needle or ""]), (text or "").lower())] for text, needle in zip(texts, needles)])


def per_text(texts: DataFrame, columns: list[str], schema: str, read: Callable[..., list[tuple]]) -> DataFrame:
    """``doc_id`` and the rows of ``schema`` that ``read`` makes of each text and its other ``columns``."""
    return per_row(texts, "doc_id", [_text().alias("text"), *columns], schema, read)


_PLACED = "rule string, severity string, line int, start int, end int, fix string"


def line_spans(texts: DataFrame) -> DataFrame:
    """``doc_id, nth, line, start, end`` of each of the ``spans`` (start and end offsets) of ``texts(doc_id, text, spans)``."""

    def read(text: str, given: list | None) -> list[tuple]:
        lines = spans.Lines(text)
        return [(i, *lines.span(x["start"], x["end"])) for i, x in enumerate(given or [])]

    return per_text(texts, ["spans"], "nth int, line int, start int, end int", read)


def find_phrases(texts: DataFrame, phrases: DataFrame, block_bytes: int = 32 << 20) -> DataFrame:
    """``doc_id, phrase, fix, at, line, start, end``: every hit, in any case, of each of ``phrases(phrase, fix)`` in each text.

    One automaton of all phrases is broadcast and goes through a text once, however many phrases there are. Its size is bounded: phrases of more
    than ``block_bytes`` come in blocks of about that. Overlapping hits count; null and empty phrases are left out; a phrase
    listed twice is found twice.
    """
    given = phrases.select(F.col("phrase"), F.col("fix")).where(F.length("phrase") > 0)
    size = given.agg(F.coalesce(F.sum(F.octet_length("phrase") + F.octet_length(F.coalesce("fix", F.lit("")))), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))

    def search(block: DataFrame) -> DataFrame:
        rows = block.toArrow()
        names, fixes = rows.column(0).to_pylist(), rows.column(1).to_pylist()
        shared = texts.sparkSession.sparkContext.broadcast((spans.automaton(names), names, fixes))

        def read(text: str) -> list[tuple]:
            found, names, fixes = shared.value
            hits, lines, out = spans.hits(found, text.lower()), None, []
            for begin, end, i in hits:
                lines = lines or spans.Lines(text)
                out.append((names[i], fixes[i], begin, *lines.span(begin, end)))
            return out

        return per_text(texts, [], "phrase string, fix string, at int, line int, start int, end int", read)

    parts = [search(given if blocks == 1 else given.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == b)) for b in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def lint_tldr(texts: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    head = F.lower(F.substring(_text(), 1, rules.marker_window))
    missing = F.lit(True)
    for marker in rules.markers:
        missing = missing & ~head.contains(marker)
    return texts.where(missing).select("doc_id", *whole_text_issue("tldr.missing", rules, f"Put a summary marker into the first {rules.marker_window} characters."))


def phrase_issues(texts: DataFrame, phrases: DataFrame, rule: str, rules: Rules = DEFAULT) -> DataFrame:
    """Issues at every hit of a table ``phrases(phrase, fix)`` of any number of phrases; without a fix, one that names the phrase."""
    found = find_phrases(texts, phrases)
    fix = F.coalesce(F.nullif("fix", F.lit("")), F.concat(F.lit("Write something concrete for '"), F.col("phrase"), F.lit("'.")))
    return found.select("doc_id", *issue(rule, rules, F.col("line"), F.col("start"), F.col("end"), fix))


def _listed(texts: DataFrame, needles: dict[str, str]) -> DataFrame:
    return texts.sparkSession.createDataFrame(list(needles.items()), "phrase string, fix string")


def lint_forbidden(texts: DataFrame, rules: Rules = DEFAULT, phrases: DataFrame | None = None) -> DataFrame:
    """Forbidden phrases: those of the rule set, or of a table ``phrases(phrase, fix)``."""
    return phrase_issues(texts, _listed(texts, rules.forbidden) if phrases is None else phrases, "forbidden.phrase", rules)


def lint_brand(texts: DataFrame, rules: Rules = DEFAULT, phrases: DataFrame | None = None) -> DataFrame:
    return phrase_issues(texts, _listed(texts, _brand_fixes(rules)) if phrases is None else phrases, "brand.glossary.mismatch", rules)


def _brand_fixes(rules: Rules) -> dict[str, str]:
    return {v: f"Write '{rules.brand}'." for v in rules.brand_variants}


# Fixed value: the row of dashes between the head and the body of a Markdown table.
SEPARATOR_ROW = r"\s*\|?\s*:?-{3,}\s*(\|\s*:?-{3,}\s*)+\|?\s*"


def has_table(text: Column) -> Column:
    """An HTML table, a Markdown table, or a bar anywhere with a line of dashes."""
    markdown = text.rlike(rf"(?m)^[^\n]*\|[^\n]*\n{SEPARATOR_ROW}$")
    return text.rlike(r"(?i)<table\b") | markdown | (text.contains("|") & text.rlike(r"(?dm)^-{3,}"))


def lint_comparison(texts: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Comparison wording without a table; the span is that of the first trigger in list order."""
    low = F.lower(_text())
    at, size = F.lit(None).cast("int"), F.lit(None).cast("int")
    for trigger in reversed(rules.triggers):
        hit = F.instr(low, trigger) > 0
        at, size = F.when(hit, F.instr(low, trigger) - 1).otherwise(at), F.when(hit, len(trigger)).otherwise(size)
    found = texts.select("doc_id", _text().alias("text"), at.alias("at"), size.alias("size")).where(F.col("at").isNotNull() & ~has_table(F.col("text")))
    start = offset_in_line(F.col("text"), F.col("at"))
    fix = F.lit("Sum the comparison up in a table.")
    return found.select("doc_id", *issue("comparison.table_missing", rules, line_of(F.col("text"), F.col("at")), start, start + F.col("size"), fix))


def count_quotables(text: Column, most_chars: int) -> Column:
    return F.size(F.filter(sentences(text), lambda s: F.length(strip(s)) <= most_chars))


def lint_quotables(texts: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    few = count_quotables(_text(), rules.quotable_chars) < rules.least_quotables
    return texts.where(few).select("doc_id", *whole_text_issue("quotables.too_few", rules, f"Write at least {rules.least_quotables} sentences of at most {rules.quotable_chars} characters."))


#: A heading of the second level: its words may stand on a later line than its marks.
_H2 = re.compile(r"(?m)^##\s+.+$")
_H2_FIX = "Word second-level headings as questions."


def _headings(text: str, lines: spans.Lines) -> Iterator[tuple[int, int, int]]:
    if "##" in text:
        for m in _H2.finditer(text):
            if not m[0].strip().endswith("?"):
                yield lines.span(*m.span())


def lint_h2(texts: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Second-level Markdown headings that don't end with a question mark."""
    rule = "scannability.h2_question"
    severity = rules.severity_for(rule)
    return per_text(texts.where(_text().contains("##")), [], _PLACED, lambda text: [(rule, severity, *place, _H2_FIX) for place in _headings(text, spans.Lines(text))])


def lint_readability(texts: DataFrame, targets: dict[str, int] | None = None, rules: Rules = DEFAULT) -> DataFrame:
    """``doc_id, grade, target, n_long, n_very_long, notes``; a page type's own target counts when over 0."""
    target = F.lit(rules.target_grade)
    for kind, value in (targets or {}).items():
        if value > 0:
            target = F.when(F.col("page_type") == kind, value).otherwise(target)
    # In steps, so that no array is worked out twice.
    parts = texts.select("doc_id", target.alias("target"), alphabetic_words(_text()).alias("words"), split_sentences(_text()).alias("parts"))
    sizes = parts.select("doc_id", "target", "words", F.transform("parts", word_count).alias("sizes"))
    longer = lambda n: F.size(F.filter("sizes", lambda x: x > n))
    rows = sizes.select("doc_id", F.round(grade_of(F.col("words"), F.size("sizes")), 2).alias("grade"), "target", longer(rules.long_words).alias("n_long"), longer(rules.very_long_words).alias("n_very_long"))
    notes = F.array_compact(F.array(
        F.when(F.col("grade") > F.col("target"), F.concat(F.lit("Aim for grade "), F.col("target"), F.lit(" or less."))),
        F.when(F.col("n_long") > 0, F.concat("n_long", F.lit(f" sentences over {rules.long_words} words: split them."))),
        F.when(F.col("n_very_long") > 0, F.concat("n_very_long", F.lit(f" sentences over {rules.very_long_words} words: split them first."))),
    ))
    return rows.withColumn("notes", notes)


def claims_of(text: str, number: re.Pattern, cited: re.Pattern, window: int) -> Iterator[tuple[int, int, str, int, bool]]:
    """Sentence, place in it, claim, offset, and whether a sentence within the window cites, for each number in a sentence."""
    own = list(spans.sentences(text))
    near = spans.near_any([cited.search(text, a, b) is not None for a, b in own], window)
    for i, (a, b) in enumerate(own):
        for nth, m in enumerate(number.finditer(text[a:b])):
            yield i, nth, m[0], a + m.start(), near[i]


def numeric_claims(texts: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """``doc_id, sentence, nth, claim, supported``: each number and whether a sentence within the window cites. One scan of each text."""
    number, cited, window = re.compile(rules.number), re.compile(rules.citation), rules.window
    read = lambda text: [(s, n, c, ok) for s, n, c, _, ok in claims_of(text, number, cited, window)]
    return per_text(texts.where(_text().rlike(rules.number_hint)), [], "sentence int, nth int, claim string, supported boolean", read)


_UNIT = re.compile(r"\$?\d[\d,]*(?:\.\d+)?\s*([A-Za-z%$]+)")


def lint_citations(texts: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Issues ``doc_id, rule, severity, line, start, end, fix, reason`` of numbers without a citation nearby, with ``sentence, nth, claim, unit``."""
    number, cited, window, units = re.compile(rules.number), re.compile(rules.citation), rules.window, rules.units
    rule = "citations.numeric_claim_missing"
    severity = rules.severity_for(rule)

    def read(text: str) -> list[tuple]:
        lines, out = None, []
        for sentence, nth, claim, at, supported in claims_of(text, number, cited, window):
            if supported:
                continue
            lines = lines or spans.Lines(text)
            unit = m[1].lower() if (m := _UNIT.match(claim)) else None
            unit = unit if unit not in units else None
            note = f" (unit {unit} is not among the allowed ones)" if unit else ""
            out.append((rule, severity, *lines.span(at, at + len(claim)), "Put a footnote or a source address near the number.", f"No citation within {window} sentences of {claim}{note}.", sentence, nth, claim, unit))
        return out

    return per_text(texts.where(_text().rlike(rules.number_hint)), [], f"{_PLACED}, reason string, sentence int, nth int, claim string, unit string", read)


def citation_suggestions(texts: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """``doc_id, nth, claim, suggestion`` for texts with numbers, no citation, and no number in a whole sentence (which would be an issue)."""
    numbers = F.regexp_extract_all(_text(), F.lit(f"({rules.number})"), F.lit(1))
    in_sentences = F.exists(sentences(_text()), lambda s: s.rlike(rules.number))
    rows = texts.where(_text().rlike(rules.number_hint) & ~_text().rlike(rules.citation) & ~in_sentences)
    return rows.select("doc_id", F.posexplode(numbers).alias("nth", "claim")).withColumn("suggestion", F.concat(F.lit("Cite a source for "), F.col("claim"), F.lit(".")))


def citation_scores(texts: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """``doc_id, has_citation, total, supported, score``; 1.0 where there are no claims. All in the row, without a shuffle."""
    cited = F.transform("sentences", lambda s: s.rlike(rules.citation_hint) & s.rlike(rules.citation))
    counts = F.transform("sentences", lambda s: F.when(s.rlike(rules.number_hint), F.regexp_count(s, F.lit(rules.number))).otherwise(0))
    rows = texts.select("doc_id", _text().rlike(rules.citation).alias("has_citation"), sentences(_text()).alias("sentences")).select("doc_id", "has_citation", cited.alias("cited"), counts.alias("counts"))
    w = rules.window

    def near(z: Column) -> Column:
        return F.transform(z["counts"], lambda c, i: F.when((c > 0) & F.exists(F.slice(z["cited"], F.greatest(F.lit(1), i + 1 - w), F.least(i, F.lit(w)) + w + 1), lambda x: x), c).otherwise(0))

    # Bound by let(): else both arrays would be worked out anew for each sentence.
    supported = F.aggregate(let(F.struct(F.col("cited").alias("cited"), F.col("counts").alias("counts")), near), F.lit(0), lambda a, x: a + x)
    total = F.aggregate("counts", F.lit(0), lambda a, x: a + x)
    scored = rows.select("doc_id", "has_citation", total.alias("total"), supported.alias("supported"))
    return scored.withColumn("score", F.when(F.col("total") == 0, 1.0).otherwise(F.round(F.col("supported") / F.col("total"), 3)))


def normalize_phone(s: Column) -> Column:
    return F.regexp_replace(F.coalesce(s, F.lit("")), r"[^0-9]+", "")


def lint_geo(texts: DataFrame, truth: DataFrame, default_key: str, rules: Rules = DEFAULT) -> DataFrame:
    """Phone, city and region of the text's place, from ``truth(geo_key, telephone, locality, region)``.

    A text without a key takes the default one; a key without truth gives no issue.
    """
    from .sizes import broadcast_if_small

    keyed = texts.withColumn("geo_key", F.coalesce(F.when(F.col("geo_key") != "", F.col("geo_key")), F.lit(default_key)))
    rows = keyed.join(broadcast_if_small(truth), "geo_key").select("doc_id", _text().alias("text"), normalize_phone(F.col("telephone")).alias("phone"), F.trim(F.coalesce("locality", F.lit(""))).alias("city"), F.trim(F.coalesce("region", F.lit(""))).alias("state"))
    low, named = F.lower("text"), lambda rule: (F.lit(rule).alias("rule"), F.lit(rules.severity_for(rule)).alias("severity"))
    checks = F.array_compact(F.array(
        F.when((F.col("phone") != "") & ~F.contains(normalize_phone(F.col("text")), F.col("phone")), F.struct(*named("geo.nap_mismatch"), F.lit("Give the telephone number as listed.").alias("fix"))),
        F.when((F.col("city") != "") & ~F.contains(low, F.lower("city")), F.struct(*named("geo.city_presence"), F.concat(F.lit("Name the city: "), F.col("city")).alias("fix"))),
        F.when((F.col("state") != "") & ~F.contains(low, F.lower("state")), F.struct(*named("geo.region_presence"), F.concat(F.lit("Name the region: "), F.col("state")).alias("fix"))),
    ))
    found = rows.select("doc_id", F.explode(checks).alias("c"))
    return found.select("doc_id", F.col("c.rule").alias("rule"), F.col("c.severity").alias("severity"), F.lit(1).alias("line"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.col("c.fix").alias("fix"))


def ordered_issues(texts: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """``doc_id, issues`` for texts with any: each text's issues by line, start, rule, fix, as one array. One scan, no shuffle.

    What holds of a whole text is told by column expressions; the places of phrases, headings and the comparison are
    found in one pass, with one index of the text's lines.
    """
    low = F.lower("text")
    missing, trigger, size = F.lit(True), F.lit(None).cast("int"), F.lit(None).cast("int")
    for marker in rules.markers:
        missing = missing & ~F.lower(F.substring("text", 1, rules.marker_window)).contains(marker)
    for t in reversed(rules.triggers):
        hit = F.instr(low, t) > 0
        trigger, size = F.when(hit, F.instr(low, t) - 1).otherwise(trigger), F.when(hit, len(t)).otherwise(size)
    told = texts.select("doc_id", _text().alias("text")).select(
        "doc_id", "text", missing.alias("missing"), (count_quotables(F.col("text"), rules.quotable_chars) < rules.least_quotables).alias("few"),
        F.when(~has_table(F.col("text")), trigger).alias("trigger"), size.alias("size"),
    )
    phrases = [(p, "forbidden.phrase", fix) for p, fix in rules.forbidden.items()] + [(p, "brand.glossary.mismatch", fix) for p, fix in _brand_fixes(rules).items()]
    found = spans.automaton([p for p, _, _ in phrases])
    severity = {r: rules.severity_for(r) for r in ("tldr.missing", "forbidden.phrase", "brand.glossary.mismatch", "comparison.table_missing", "quotables.too_few", "scannability.h2_question")}

    def read(text: str, missing: bool, few: bool, trigger: int | None, size: int | None) -> list[tuple]:
        lines, rows = spans.Lines(text), []

        def add(rule: str, place: tuple[int, int, int], fix: str) -> None:
            rows.append({"line": place[0], "start": place[1], "rule": rule, "fix": fix, "end": place[2], "severity": severity[rule]})

        if missing:
            add("tldr.missing", (1, 0, 0), f"Put a summary marker into the first {rules.marker_window} characters.")
        if few:
            add("quotables.too_few", (1, 0, 0), f"Write at least {rules.least_quotables} sentences of at most {rules.quotable_chars} characters.")
        for begin, end, i in spans.hits(found, text.lower()):
            add(phrases[i][1], lines.span(begin, end), phrases[i][2])
        if trigger is not None:
            add("comparison.table_missing", lines.span(trigger, trigger + size), "Sum the comparison up in a table.")
        for place in _headings(text, lines):
            add("scannability.h2_question", place, _H2_FIX)
        rows.sort(key=lambda r: (r["line"], r["start"], r["rule"], r["fix"], r["end"]))
        return [(rows,)] if rows else []

    return per_text(told, ["missing", "few", "trigger", "size"], "issues array<struct<line:int,start:int,rule:string,fix:string,end:int,severity:string>>", read)


def lint_style(texts: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """All style issues of all texts, one row each."""
    return ordered_issues(texts, rules).select("doc_id", F.inline("issues")).select("doc_id", "rule", "severity", "line", "start", "end", "fix")
