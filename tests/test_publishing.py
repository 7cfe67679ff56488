"""Stable JSON, versions, status by content, and line diffs."""

from __future__ import annotations

import json
import random
import time

from pyspark.sql import functions as F

from pagesignal.functions import json_text, line_diff, stamps
from pagesignal.operators import jsonld, publish


def random_json(rng, depth=0):
    kind = rng.randrange(9 if depth < 4 else 6)
    if kind == 6:
        return [random_json(rng, depth + 1) for _ in range(rng.randrange(4))]
    if kind > 6:
        return {rng.choice(["b", "a", "é", "@type", "Z", "10", "9", "", "😀", "�", "a b"]): random_json(rng, depth + 1) for _ in range(rng.randrange(5))}
    return rng.choice([None, True, False, 0, -7, 12.0, 1.5, 1e-7, 10**25, 2.5e30, "", "x\ty", 'q"\\', " ü", "\x01\x7f", "v1.0", "a/b"])


def test_stable_json_is_that_of_the_rule(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(600):
        value = random_json(rng)
        texts.append(json.dumps(value, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])))
    texts += ['{"a":1,"a":2}', "[1,]", "", " ", "nul", "{'a':1}", "NaN", "01", '{"a":1} x', "1,2", "1,", "]", "][", "[],[", "1],[2", "1.0", "-0", "-0.0", "1e2", "1E400", "9" * 40, "[" * 300 + "]" * 300, None]

    def stable(text):
        try:
            return None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", json_text.json_stable(F.col("t")).alias("s"), json_text.is_empty_json(F.col("t")).alias("e"))
    for r in df.collect():
        assert r.s == stable(texts[r.i]), texts[r.i]
        if r.s is not None:
            assert r.e == (not json.loads(texts[r.i])), texts[r.i]


def test_versions_and_embedding_go_by_the_object(spark):
    rows = spark.createDataFrame([('{"a":1,"b":[1, 2]}',), (' {"b":[1,2],\n"a":1}',), ('{"b":[2,1],"a":1}',), ("null",), (None,), ("no json",)], "j string")
    one, two, other, null, none, text = [r.v for r in rows.select(stamps.content_version(F.lit("/a"), F.lit("c"), F.col("j")).alias("v")).collect()]
    assert one == two != other and null == none != text
    html = "<head></head>"
    got = [r.h for r in rows.select(publish.embed_jsonld(F.lit(html), F.col("j")).alias("h")).collect()]
    assert got[0] == got[1] == '<head><script type="application/ld+json">{"a":1,"b":[1,2]}</script>\n</head>' and got[3] == got[4] == html
    empty = spark.createDataFrame([(x,) for x in ("{}", "[]", '""', "0", "false", " {} ", "")], "j string")
    assert {r.h for r in empty.select(publish.embed_jsonld(F.lit(html), F.col("j")).alias("h")).collect()} == {html}
    batch = spark.createDataFrame([("/a", '{"b":1,"a":["ü"]}', False), ("/b", "{}", False), ("/c", '{"a":1}', True)], "path string, jsonld string, embed_jsonld boolean")
    assert [tuple(r) for r in publish.jsonld_sidecars(batch).collect()] == [("/a.jsonld", json.dumps({"b": 1, "a": ["ü"]}, ensure_ascii=False, indent=2))]


def test_status_goes_by_content(spark):
    kinds = "path string, content string, jsonld string, version string"
    old = spark.createDataFrame([("/same", "x", '{"a":1}', "1"), ("/new", "x", None, "2"), ("/kept", "k", None, "3")], kinds)
    new = spark.createDataFrame([("/same", "x", '{"a":2}', "4"), ("/new", "y", None, "5"), ("/first", "f", None, "6"), ("/empty", "", None, "7")], kinds)
    assert {tuple(r) for r in publish.content_merge(old, new).collect()} == {("/same", "not_modified", "4"), ("/new", "changed", "5"), ("/first", "inserted", "6"), ("/empty", "not_modified", "7"), ("/kept", "kept", "3")}
    assert {(r.path, r.jsonld, r.version) for r in publish.merged_content(old, new).collect()} == {("/same", '{"a":1}', "1"), ("/new", None, "5"), ("/first", None, "6"), ("/kept", None, "3")}
    rows = spark.createDataFrame([("/p", 1, "a", "{}", "1"), ("/p", 2, "a", "[]", "2"), ("/p", 2, "a", "[]", "2"), ("/q", 1, "a", None, "3"), ("/q", 3, "b", None, "4"), ("/e", 1, "", None, "5")], "path string, seq long, content string, jsonld string, version string")
    state = publish.content_state(rows)
    want = {("/p", 2, "not_modified", 1), ("/q", 3, "changed", 1), ("/e", 1, "not_modified", None)}
    assert {(r.path, r.seq, r.status, r.before) for r in state.collect()} == want
    assert {(r.path, r.seq, r.status, r.before) for r in publish.content_state(publish.state_rows(state)).collect()} == want


def test_registry_keeps_order_and_repeats(spark):
    organizations = spark.createDataFrame([("m", '{"@type":"Organization"}'), ("d", '{"@type":"Organization"}'), ("none", "{}"), ("m", "[1]")], "market string, jsonld string")
    registry = spark.createDataFrame([("m", "county", 0, "C"), ("m", "neighbors", 1, "B"), ("m", "neighbors", 0, "Z"), ("m", "neighbors", 2, "Z"), ("m", "city", 0, "A"), ("m", "city", 1, ""), ("d", "city", 0, "no"), ("d", "areaServed", 1, "Q"), ("d", "areaServed", 0, "R"), ("m", "zip", 0, "no")], "market string, kind string, nth int, name string")
    services = spark.createDataFrame([(2, "a"), (1, "b"), (3, "a"), (0, None)], "nth int, service string")
    got = [json.loads(r.jsonld) for r in jsonld.enrich_organizations(organizations, registry, services, "market").collect()]
    served = sorted(",".join(p["name"] for p in x.get("areaServed", [])) for x in got if isinstance(x, dict))
    assert served == ["", "A,Z,B,Z,C", "R,Q"] and [1] in got
    assert {",".join(o["itemOffered"]["name"] for o in x["hasOfferCatalog"]["itemListElement"]) for x in got if isinstance(x, dict)} == {"b,a,a"}


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_diffs_are_shortest_and_apply(monkeypatch):
    rng = random.Random(0)
    for most in (600, 3):
        monkeypatch.setattr(line_diff, "MOST_EDITS", most)
        for k in range(1500):
            lines = "ab\n" if k % 2 else ["a\n", "b\n", "c\n", "\n", "x\r", "y", "\x0b", "@@ -1 +1 @@\n", "\\ No newline at end of line\n"]
            a, b = ("".join(rng.choices(lines, k=rng.randrange(25))) for _ in "ab")
            diff = line_diff.unified(a, b, "/p")
            assert line_diff.apply(a, diff) == b and (diff == "") == (a == b)
            own, other = a.splitlines(True), b.splitlines(True)
            if most > 100:
                assert sum(x - i + y - j for i, x, j, y in line_diff.edits(own, other)) == len(own) + len(other) - 2 * longest(own, other)
    assert line_diff.unified("a\nb\nc\n", "a\nx\nc\n", "/p") == "--- a/p\n+++ b/p\n@@ -1,3 +1,3 @@\n a\n-b\n+x\n c\n"
    assert line_diff.unified("", "x\n", "/p").splitlines()[2] == "@@ -0,0 +1 @@"


def test_a_hundred_thousand_lines_with_fifty_edits():
    rng = random.Random(4)
    before = [f"line {rng.randrange(30_000)}\n" for _ in range(100_000)]
    after = list(before)
    for i in rng.sample(range(100_000), 50):
        after[i] = rng.choice(["changed\n", "", "one\nmore\n"])
    a, b = "".join(before), "".join(after)
    began = time.perf_counter()
    diff = line_diff.unified(a, b, "/p")
    assert time.perf_counter() - began < 1
    assert line_diff.apply(a, diff) == b


def test_diff_columns(spark):
    rows = spark.createDataFrame([("p", "a\n", "b\n"), ("/q", None, "x"), (None, "x", None)], "p string, a string, b string")
    made = rows.withColumn("d", publish.line_diff("p", "a", "b"))
    assert [r.b for r in made.select(publish.apply_diff(F.col("a"), F.col("d")).alias("b")).collect()] == ["b\n", "x", ""]
    assert made.first().d.startswith("--- a/p\n+++ b/p\n")
