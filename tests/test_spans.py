"""Places in texts: against plain searches, and in time that grows with the text alone."""

from __future__ import annotations

import random
import re
import time

from pagesignal.functions import spans
from pagesignal.operators import lint


def plain_hits(text, phrases):
    low, out = text.lower(), []
    for i, phrase in enumerate(phrases):
        at = low.find(phrase.lower()) if phrase else -1
        while at >= 0:
            out.append((at, at + len(phrase.lower()), i))
            at = low.find(phrase.lower(), at + 1)
    return sorted(out)


def test_phrases_sentences_and_lines_match_plain_searches():
    rng = random.Random(0)
    for _ in range(300):
        text = "".join(rng.choices(["a", "A", "b", ".", "!", "\n", " ", "é", "İ"], k=rng.randrange(60)))
        phrases = ["".join(rng.choices("abAB. é", k=rng.randrange(1, 4))) for _ in range(8)] + ["aa", "aa", ""]
        assert sorted(spans.hits(spans.automaton(phrases), text.lower())) == plain_hits(text, phrases)
        assert list(spans.sentences(text)) == [m.span() for m in re.finditer(r"[^.!?]+[.!?]", text)]
        lines = spans.Lines(text)
        for at in range(-1, len(text) + 2):
            before = text[: max(at, 0)]
            assert at > len(text) or lines.place(at) == (1 + before.count("\n"), len(before.rsplit("\n", 1)[-1]))
        flags = [rng.random() < 0.2 for _ in range(30)]
        assert spans.near_any(flags, 3) == [any(flags[max(0, i - 3) : i + 4]) for i in range(30)]
    assert list(spans.hits(spans.automaton([]), "x")) == [] and spans.Lines("").span(-5, -9) == (1, 0, 0)


def test_ten_thousand_phrases_in_a_megabyte():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 9))) for _ in range(30_000)]
    text = " ".join(rng.choices(words, k=150_000))[: 1 << 20]
    found = spans.automaton([" ".join(rng.choices(words, k=2)) for _ in range(9_000)] + words[:1_000])
    began = time.perf_counter()
    n = sum(1 for _ in spans.hits(found, text.lower()))
    assert n > 1_000 and time.perf_counter() - began < 1


def test_forty_thousand_claims_in_a_megabyte(spark):
    text = "".join(f"In {1000 + i % 9000} it rose.\nMore {i % 7}.\n" for i in range(40_000))[: 1 << 20]
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string").repartition(1).cache()
    rows.count()
    lint.lint_citations(spark.createDataFrame([(1, "In 2024.")], "doc_id long, text string")).count()
    began = time.perf_counter()
    got = lint.lint_citations(rows).selectExpr("count(*) n", "max(line) last", "max(start) at").first()
    assert got.n > 30_000 and got.last == text.count("\n", 0, text.rfind("In ")) + 1 and got.at == 3
    assert time.perf_counter() - began < 2 * 3  # the whole job, on a busy machine


def test_a_text_of_many_hits_is_linear(spark):
    rows = spark.createDataFrame([(1, "click here\n" * 60_000)], "doc_id long, text string")
    got = lint.lint_forbidden(rows).selectExpr("count(*) n", "max(line) last").first()
    assert (got.n, got.last) == (60_000, 60_000)
    assert lint.lint_style(rows).where("rule = 'forbidden.phrase'").count() == 60_000


def test_phrases_from_a_table_in_blocks(spark):
    texts = spark.createDataFrame([(1, "aAa b"), (1, "aAa b"), (2, None), (3, "")], "doc_id long, text string").selectExpr("*", "1 AS phrase", "1 AS at")
    table = spark.createDataFrame([("aa", "x"), ("A", None), ("a b", "y"), (None, "z"), ("", "z"), ("aa", "x")], "phrase string, fix string")
    whole = sorted(map(str, lint.find_phrases(texts, table).collect()))
    assert whole == sorted(map(str, lint.find_phrases(texts, table, block_bytes=2).collect())) and len(whole) == 2 * (2 * 2 + 3 + 1)
    issues = lint.lint_forbidden(texts, phrases=table).where("doc_id = 1").collect()
    assert {r.fix for r in issues} == {"x", "y", "Write something concrete for 'A'."}
    assert lint.find_phrases(texts, table.limit(0)).count() == 0 == lint.find_phrases(texts.limit(0), table).count()


def test_headings_over_lines(spark):
    body = "##\n\nTitle\n## \n## Next?\n##   \n"
    got = lint.lint_h2(spark.createDataFrame([(1, body)], "doc_id long, text string")).collect()
    want = [(body.count("\n", 0, m.start()) + 1, 0, len(m[0])) for m in re.finditer(r"(?m)^(##\s+.+)$", body) if not m[0].strip().endswith("?")]
    assert [(r.line, r.start, r.end) for r in got] == want and len(want) == 2


def test_severities_of_the_rule_set(spark):
    truth = spark.createDataFrame([("w", "+1 910", "W", "NC")], "geo_key string, telephone string, locality string, region string")
    texts = spark.createDataFrame([(1, "x", None)], "doc_id long, text string, geo_key string")
    got = {r.rule: r.severity for r in lint.lint_geo(texts, truth, "w", lint.Rules(severity={"geo.city_presence": "error"})).collect()}
    assert got == {"geo.nap_mismatch": "warn", "geo.city_presence": "error", "geo.region_presence": "warn"}
