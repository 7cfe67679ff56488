"""Hand-worked cases of the operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagesignal.functions import stamps, text, urls
from pagesignal.functions.html_blocks import blocks
from pagesignal.operators import jsonld, lint, pages, presence, publish, search
from pagesignal.sources.tables import read_corpus
from pagesignal.streaming import streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def values(spark, function, *inputs):
    return [one(spark, function(*[F.lit(v) for v in (x if isinstance(x, tuple) else (x,))])) for x in inputs]


def test_text_functions(spark):
    assert values(spark, text.tokenize, "Café au-lait 3x", None, "") == [["caf", "au", "lait", "3x"], [], []]
    assert values(spark, text.sentences, "It costs $1,250.50 now. Tail") == [["It costs $1,250.", "50 now."]]
    assert values(spark, text.syllables, "make", "the", "queue", "rhythm", "'") == [1, 1, 1, 1, 0]
    assert values(spark, text.grade, "", "...") == [0.0, 0.0]
    assert values(spark, lambda t: text.hash_bucket(t, 512), "a", "fence") == [int("86f7e437faa5a7fce15d1ddcb9eaeaea377667b8", 16) % 512, __import__("hashlib").sha1(b"fence").digest()[-2] % 2 * 256 + __import__("hashlib").sha1(b"fence").digest()[-1]]
    assert values(spark, lambda t: text.hash_bucket(t, 1000), "a") == [int("86f7e437faa5a7fce15d1ddcb9eaeaea377667b8", 16) % 1000]


def test_snippets(spark):
    long = "x" * 100 + "Fence" + "y" * 200
    got = values(spark, text.snippet, (long, "fence"), ("abc", "zzz"), ("", "a"), ("Vinyl fence", "fence vinyl"), ("z" * 300, "q"))
    assert got[0] == "…" + "x" * 73 + "<em>Fence</em>" + "y" * 141 + "…"
    assert got[1:4] == ["abc", "", "<em>Vinyl</em> <em>fence</em>"] and got[4] == "z" * 220 + "…"


def test_urls(spark):
    assert values(spark, urls.parse_host, "HTTPS://u:p@A.b:8/x", "/x", None) == ["A.b", "", ""]
    assert values(spark, urls.host_matches_site, ("notexample.com", "*.example.com"), ("a.example.com", "*.example.com"), ("x", "")) == [False, True, True]
    assert values(spark, urls.map_url, ("https://s/", "index.md"), ("https://s", "/a/index.md"), ("https://s", "a.md"), ("https://s", "a.html")) == ["https://s/", "https://s/a/", "https://s/a/", "https://s/a.html"]
    assert values(spark, urls.path_is_safe, "../x", "a/../../x", "/a", " ", "a/../b") == [False, False, True, False, True]
    assert values(spark, urls.slug, "São Paulo!", "  Straße 1 ") == ["sao-paulo", "strasse-1"]
    assert values(spark, urls.detect_mime, " text/html; x", None) == ["text/html", "application/octet-stream"]
    assert values(spark, urls.rich_results_url, "a b~*") == ["https://search.google.com/test/rich-results?url=a+b~%2A"]


def test_stamps(spark):
    day = values(spark, lambda s: stamps.iso_utc(stamps.floor_time(stamps.parse_utc(s), "day")), "2024-01-05T10:11:12+02:00", "bad")
    assert day == ["2024-01-05T00:00:00Z", None]
    assert len(values(spark, lambda p: stamps.content_version(p, F.lit("c"), F.lit(None).cast("string")), "/a")[0]) == 7


CORPUS = "id string, url string, title string, text string, anchor string, last_modified string, jurisdiction string, place_ids array<string>"
SEED = [("doc1", "https://example.com/", "Port City Fence – Wilmington NC", "Vinyl fence care and pricing for Wilmington NC.", None, "2025-01-01", None, None), ("doc2", "https://example.com/vinyl", "Vinyl vs Wood – Pros and Cons", "Comparison table and costs. Wilmington and Wrightsville Beach examples.", "b-4", "2025-02-01", None, ["place-wilmington-nc"])]


def bm25_by_hand(docs, q):
    import math
    import re

    tokens = {i: re.findall("[a-z0-9]+", f"{t} {x}".lower()) for i, t, x in docs}
    n, average = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    df = {w: sum(w in t for t in tokens.values()) for t in tokens.values() for w in t}
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    return {i: sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / average)) for w in re.findall("[a-z0-9]+", q.lower())) for i, t in tokens.items()}


def test_bm25_matches_hand_computation(spark):
    corpus = spark.createDataFrame(SEED, CORPUS)
    queries = spark.createDataFrame([("a", "vinyl fence wilmington fence"), ("b", "!!"), ("c", "nothing")], "query_id string, q string")
    got = {(r.query_id, r.id): r.score for r in search.bm25_search(corpus, queries, 10).collect()}
    want = bm25_by_hand([(r[0], r[2], r[3]) for r in SEED], "vinyl fence wilmington fence")
    assert {k: round(v, 9) for k, v in got.items()} == {**{("a", i): round(v, 9) for i, v in want.items()}, ("c", "doc1"): 0.0, ("c", "doc2"): 0.0}


def test_ties_go_by_id_as_text(spark):
    corpus = spark.createDataFrame([(i, "", "same", "same", None, None, None, None) for i in ("9", "10", "2")], CORPUS)
    queries = spark.createDataFrame([("a", "same")], "query_id string, q string")
    for found in (search.bm25_search(corpus, queries, 3), search.vector_search(corpus, queries, 3)):
        assert [r.id for r in found.orderBy("rank").collect()] == ["10", "2", "9"]


def test_fusion_is_symmetric_and_filters_are_asymmetric(spark):
    a = spark.createDataFrame([("q", "x", 1, 3.0), ("q", "y", 2, 1.0)], "query_id string, id string, rank int, score double")
    b = spark.createDataFrame([("q", "y", 1, 9.0), ("q", "z", 2, 9.0)], "query_id string, id string, rank int, score double")
    rows = lambda df: sorted((r.id, round(r.score, 9)) for r in df.collect())
    assert rows(search.rrf_fuse([a, b])) == rows(search.rrf_fuse([b, a])) == [("x", round(1 / 61, 9)), ("y", round(1 / 62 + 1 / 61, 9)), ("z", round(1 / 62, 9))]
    assert rows(search.weighted_fuse(a, b)) == [("x", 0.5), ("y", -0.5), ("z", 0.0)]
    corpus = spark.createDataFrame(SEED + [("bare", None, None, None, None, "bad date", None, None)], CORPUS)
    ids = lambda **f: sorted(r.id for r in search.apply_filters(corpus, **f).collect())
    assert ids(lastmod_gte="2025-01-15") == ["bare", "doc2"] and ids(jurisdiction="us") == ["bare", "doc1", "doc2"]
    assert ids(place_ids=["PLACE-Wilmington-NC"]) == ["doc2"] and ids(site="*.example.com") == ["doc1", "doc2"] and ids(domains=[]) == ["bare", "doc1", "doc2"]


def test_pages_of_results_join_up(spark):
    ranked = spark.createDataFrame([("q", str(i), float(i % 4)) for i in range(11)], "query_id string, id string, score double")
    whole = [r.id for r in search.page(ranked, 0, 100).orderBy("rank").collect()]
    parts = [r.id for o in (0, 4, 8) for r in search.page(ranked, o, 4).orderBy("rank").collect()]
    assert parts == whole and search.page(ranked, 8, 4).first().has_next is False and search.clamp_top_k(500) == 100


def test_corpus_reader_and_upsert(spark):
    rows = spark.createDataFrame([("1", None, None, None), (None, "u", "t", "x")], "id string, url string, title string, text string")
    good, bad = read_corpus(rows)
    assert good.first().text == "" and bad.count() == 1
    delta = spark.createDataFrame([("1", "new", 1), ("1", "newer", 2), ("3", "x", 1)], "id string, title string, seq int")
    merged = search.corpus_upsert(good.select("id", "title"), delta, "seq")
    assert sorted(tuple(r) for r in merged.collect()) == [("1", "newer"), ("3", "x")]


def lint_rows(spark, function, body, **options):
    texts = spark.createDataFrame([("d", body, "guide", None)], "doc_id string, text string, page_type string, geo_key string")
    return function(texts, **options).collect()


def test_phrase_spans(spark):
    got = lint_rows(spark, lint.lint_forbidden, "Click here. No\nthen CLICK HERE")
    assert sorted((r.line, r.start, r.end) for r in got) == [(1, 0, 10), (2, 5, 15)]
    assert [tuple(one(spark, lint.hits_ci(F.lit(t), F.lit("aa")))) for t in ("aaa", "baab", "b", "")] == [(0, 1), (1,), (), ()]
    assert not lint_rows(spark, lint.lint_forbidden, "") and not lint_rows(spark, lint.lint_forbidden, None)


@pytest.mark.parametrize(("body", "table"), [("a <TABLE>", True), ("|a|\n| --- | --- |", True), ("|\n---", True), ("no | bars\n- -", False), ("---", False)])
def test_tables(spark, body, table):
    assert one(spark, lint.has_table(F.lit(body))) is table


def test_headings_comparison_and_summary(spark):
    assert [(r.line, r.end) for r in lint_rows(spark, lint.lint_h2, "## Why?\n## Cost\n### Cost\n##x")] == [(2, 7)]
    assert [(r.line, r.start, r.end) for r in lint_rows(spark, lint.lint_comparison, "we compare\na vs b")] == [(2, 1, 5)]
    assert len(lint_rows(spark, lint.lint_tldr, "x" * 400 + "tl;dr: y")) == 1 and not lint_rows(spark, lint.lint_tldr, "tl;dr: y")


def test_citation_window(spark):
    def body(gap):
        return "It is 3x. " + "No. " * (gap - 1) + "See [1]."

    near, far = (lint_rows(spark, lint.citation_scores, body(g))[0] for g in (3, 4))
    assert (near.total, near.supported, near.score) == (1, 1, 1.0) and (far.supported, far.score, far.has_citation) == (0, 0.0, True)
    claims = [r.claim for r in lint_rows(spark, lint.lint_citations, "50% off. 3x faster. in 2024. It costs $1,250.50 now.")]
    assert claims == ["3x", "2024", "$1,250"]


def test_geo_truth(spark):
    truth = spark.createDataFrame([("w", "+1-910-555-0123", "Wilmington", "NC")], "geo_key string, telephone string, locality string, region string")
    assert [r.rule for r in lint_rows(spark, lint.lint_geo, "Call 1 (910) 555 0123", truth=truth, default_key="w")] == ["geo.city_presence", "geo.region_presence"]
    assert not lint_rows(spark, lint.lint_geo, "x", truth=truth, default_key="elsewhere")


PRESENCE = "seq long, query string, engine string, geo string, serp_surface string, engine_flavor string, seen boolean, citations string, position string, details string, ts string, definition_version string"


def test_presence_upsert(spark):
    rows = [(1, "q", "E", "g", " AIO ", "F", True, "3", None, None, "2024-01-01T00:00:01Z", None), (2, "q", "e", "g", " Other ", "x", False, None, "1", "d", "2024-01-01T00:00:30Z", None), (3, "q", "e", None, "web", None, True, "x", None, None, "t", None), (4, "q", "e", None, None, None, True, None, None, None, "2024-01-01", None), (5, "q", "e", None, None, None, True, None, None, None, "2024-01-01", None)]
    good, bad = presence.validate_presence(spark.createDataFrame(rows, PRESENCE))
    assert [r.reason for r in bad.collect()] == ["citations not an integer"]
    normal = presence.normalize_presence(good, "minute")
    kept = presence.presence_upsert(normal)
    first = kept.where("geo = 'g'").first()
    assert (first.serp_surface, first.engine_flavor, first.seen, first.citations, first.position, first.details) == ("ai_overview", "f", 0, 3, 1, "d")
    assert kept.count() == 3 and presence.presence_upsert(normal, null_geo="merge").count() == 2
    assert presence.presence_upsert(presence.presence_upsert(normal.where("geo IS NOT NULL"))).count() == 1
    assert values(spark, presence.norm_surface, " Other ") == [" other "]
    assert presence.presence_query(kept, until="2024-01-01").count() == 0


def test_kpi(spark):
    rows = [(1, "m", "2024-01-02", "1", "g", ""), (2, "m", "2024-01-02", "2", "g", None), (3, "m", "2024-01-01", "x", None, None), (4, "", "t", "1", None, None)]
    good, bad = presence.validate_kpi(spark.createDataFrame(rows, "seq long, metric string, t string, v string, geo string, src string"))
    assert bad.count() == 1  # an empty metric is one
    series = {r.metric: [tuple(p) for p in r.points] for r in presence.kpi_series(spark.createDataFrame([("m",), ("none",)], "metric string"), presence.kpi_upsert(good), include_src=True).collect()}
    assert series == {"m": [("2024-01-02", 2.0, "csv")], "none": []}


def test_publish(spark):
    batch = spark.createDataFrame([(1, "/a.md", "x", None, None, None, None), (2, "/a.md", "y", None, None, None, None), (3, "/b", None, None, None, None, None), (4, "../c", "z", None, None, None, None)], "seq long, path string, markdown string, html string, jsonld string, embed_jsonld boolean, preview boolean")
    good, bad = publish.validate_publish(batch)
    assert sorted(r.seq for r in bad.collect()) == [3, 4]
    new = publish.prepare_batch(good)
    assert [r.content for r in new.collect()] == ["y"]
    assert [r.status for r in publish.content_merge(new, new).collect()] == ["not_modified"]
    status = publish.content_merge(new.where("false"), new)
    assert status.first().status == "inserted" and publish.history_append(new, status, F.lit(1), dry_run=True).count() == 0
    assert values(spark, publish.embed_jsonld, ("<head></head></head>", "[1]"), ("x", "[1]"), ("x", "{}"), ("x", "")) == ['<head><script type="application/ld+json">[1]</script>\n</head><script type="application/ld+json">[1]</script>\n</head>', 'x\n<script type="application/ld+json">[1]</script>\n', "x", "x"]


def test_blocks():
    got = blocks("<div><h1> A <i>b</i></h1><p>one<p>two<ul><li>x<li>y<ul><li>z</ul></ul><table><thead><tr><th>h<tr><th>i</thead><tr><td>1</table><script>no</script><p> </p>")
    assert [(b["type"], b["text"]) for b in got] == [("heading", "A b"), ("para", "one"), ("para", "two"), ("list", "x\ny z"), ("list", "z"), ("table", None)]
    assert got[-1]["cells"] == [["h"], ["i"], ["h"], ["i"], ["1"]] and got[2]["xpath"] == "/[document][1]/div[1]/p[2]"
    assert blocks(None) == blocks("") == [] and [b["type"] for b in blocks("<nav><p>x</nav><p class=mytoc>y<p>z", keep_toc=False)] == ["para"]


def test_fetch_and_recrawl(spark):
    log = spark.createDataFrame([(i, "u", s, 10, f"e{i}" if i == 0 else None, None) for i, s in enumerate((200, 503, 503, 503))] + [(9, "v", 304, 9_000_000, None, None), (10, "v", 200, 9_000_000, None, None)], "seq long, url string, status int, n_bytes long, etag string, last_modified string").withColumn("fetched_at", F.timestamp_seconds("seq"))
    assert [r.outcome for r in pages.classify_fetch(log).orderBy("seq").collect()] == ["ok", "retryable", "retryable", "retryable", "not_modified", "content_too_large"]
    state = {r.url: r for r in pages.recrawl_state(log).collect()}
    assert (state["u"].attempts, state["u"].etag, state["u"].backoff_until.timestamp()) == (3, "e0", 11.0) and state["v"].attempts == 1
    assert [r.attempts for r in pages.recrawl_attempts(log).orderBy("seq").collect()] == [0, 1, 2, 3, 0, 1]


def test_recrawl_state_by_words_of_places(spark):
    """Histories over several words of 64 places, in any order, one url with a third of the rows, against a walk in order."""
    import random

    rng = random.Random(5)
    log = [(seq, "hot" if seq % 3 == 0 else f"u{rng.randrange(40)}", rng.choice((503, 503, 503, 200)), 10) for seq in range(-300, 3000)]
    log += [(5000 + 64 * k, "sparse", 503, 10) for k in range(70)] + [(63, "edge", 200, 10), (64, "edge", 503, 10), (127, "edge", 503, 10)]
    log += [(127, "sign", 503, 10), (126, "sign", 200, 10), (None, "sign", 200, 10), (None, "none", 503, 10), (7, None, 503, 10)]
    log += log[::7]
    rng.shuffle(log)
    rows = spark.createDataFrame(log, "seq long, url string, status int, n_bytes long").repartition(5).selectExpr("*", "'e' || seq AS etag", "CAST(NULL AS STRING) AS last_modified", "timestamp_seconds(seq) AS fetched_at")
    want = {}
    for seq, url, status, _ in sorted({r for r in log if r[0] is not None}, key=lambda r: r[0]):
        attempts, good, _, etag = want.get(url, (0, None, None, None))
        want[url] = (0, seq, status, f"e{seq}") if status == 200 else (attempts + 1, good, status, etag)
    want["none"] = (0, None, None, None)
    out = pages.recrawl_state(rows)
    got = {r.url: (r.attempts, r.last_success_at and int(r.last_success_at.timestamp()), r.last_status, r.etag) for r in out.collect()}
    assert got == want and want["sparse"][0] == 70 and want["edge"][0] == 2
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("LogicalRDD") == 1  # the log is read once


def test_recrawl_attempts_over_chunks(spark):
    """Histories over several chunks of 1,024 places, some chunks without a success, against a walk in order."""
    import random

    rng = random.Random(9)
    log = [(seq, "hot" if seq % 3 == 0 else None if seq % 50 == 1 else f"u{seq % 11}", 200 if rng.random() < 0.002 else 503, f"e{seq}" if seq % 7 == 0 else None) for seq in range(-1500, 5000)]
    log += [(9000 + 1024 * k, "sparse", 200 if k == 4 else 503, None) for k in range(12)] + [(None, "early", 503, "first"), (3, "early", 503, None), (2000, "early", 503, None)]
    log += log[::97]
    want, held = [], {}
    for seq, url, status, etag in sorted(log, key=lambda r: (r[0] is not None, r[0] or 0)):
        attempts, known = held.get(url, (0, None))
        # A failed fetch says nothing of the page.
        held[url] = (0, etag or known) if status == 200 else (attempts + 1, known)
        want.append((str(seq), str(url), *held[url]))
    rng.shuffle(log)
    rows = spark.createDataFrame(log, "seq long, url string, status int, etag string").repartition(3).selectExpr("*", "10L AS n_bytes", "CAST(NULL AS STRING) AS last_modified", "timestamp_seconds(seq) AS fetched_at")
    for hot_rows in (1, 500, 1 << 20):  # all urls, the one with a third of the rows, none
        out = pages.recrawl_attempts(rows, hot_rows)
        assert sorted((str(r.seq), str(r.url), r.attempts, r.etag or "") for r in out.collect()) == sorted((*w[:3], w[3] or "") for w in want)
    assert len(out.columns) == len(set(out.columns)) and not any(c.startswith("__") for c in out.columns)


def test_robots(spark):
    files = spark.createDataFrame([("h", "User-agent: *\nDisallow: /a\n\nUser-agent: Bot\nDisallow:\nDisallow: /b\nAllow: /b/c\n# x")], "host string, body string")
    assert [r.rule for r in pages.parse_robots(files, "bot").collect()] == ["/b"] and [r.rule for r in pages.parse_robots(files, "other").collect()] == ["/a"]
    urls_ = spark.createDataFrame([("http://h/b/c",), ("http://H:1/a",), ("http://h",), ("http://x/b",)], "url string")
    assert sorted(r.url for r in pages.robots_filter(urls_, pages.parse_robots(files, "bot")).collect()) == ["http://H:1/a", "http://h", "http://x/b"]


def test_jsonld_checks(spark):
    rows = [(1, '{"@context":"https://schema.org","@type":"Product","name":""}'), (2, "nonsense"), (3, "{}"), (4, '{"@context":"https://schema.org","@type":"Thing"}'), (5, None)]
    objects = spark.createDataFrame(rows, "object_id int, jsonld string")
    got = sorted((r.object_id, r.path, r.rule) for r in jsonld.validate_jsonld(objects).collect())
    assert got == [(1, "/name", "schema.validation"), (2, "/", "core.type"), (3, "/", "core.required"), (3, "/", "core.required"), (5, "/", "core.type")]
    assert {r.object_id for r in jsonld.validity(objects).where("valid").collect()} == {4}


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 2, 0)])
def test_keyed_streams_take_batches_in_any_order(spark, tmp_path, order):
    """Rows in three files, delivered one batch each in every order, against the batch forms."""
    raw = [(i, f"q{i % 3}", "E", "g", ("aio", "web", "x")[i % 3], f"f{i}", i % 2 == 0, str(i) if i % 4 else None, None, f"d{i}" if i % 5 == 0 else None, "2024-01-01", None) for i in range(12)]
    rows = spark.createDataFrame(raw, PRESENCE)
    kpi = spark.createDataFrame([(i, "m", f"t{i % 3}", str(i), "g", "s") for i in range(12)], "seq long, metric string, t string, v string, geo string, src string")
    pages_ = spark.createDataFrame([(i, f"/p{i % 2}", ("x", "x", "y", "z")[i % 4], None, None, None, None) for i in range(12)], "seq long, path string, markdown string, html string, jsonld string, embed_jsonld boolean, preview boolean")
    plain = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    cases = [
        (rows, streams.presence_table, streams.stream_presence_upsert, presence.presence_upsert(presence.normalize_presence(presence.validate_presence(rows)[0]))),
        (kpi, streams.kpi_table, streams.stream_kpi_upsert, presence.kpi_upsert(presence.validate_kpi(kpi)[0])),
        (pages_, streams.content_table, streams.stream_content_changes, publish.content_state(publish.prepared_rows(publish.validate_publish(pages_)[0]))),
    ]
    for n, (df, made, start, want) in enumerate(cases):
        folder = f"{tmp_path}/{n}"
        table = made(spark, f"{folder}/table", bucket_bytes=4096)
        for k in order:
            df.where(F.col("seq") % 3 == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            start(spark.readStream.schema(df.schema).parquet(f"{folder}/in"), table, f"{folder}/checkpoint").awaitTermination()
        assert plain(table.read().select(want.columns)) == plain(want)
        assert table.live()[0] is not None  # a base was written on the way


def test_recrawl_state_in_any_order():
    """Histories in every order and split, with rows that come twice, against a walk in order."""
    import itertools
    import random

    import pandas as pd

    def walked(log):
        attempts, good, etag = 0, None, None
        for row in sorted({r["seq"]: r for r in log}.values(), key=lambda r: r["seq"]):
            ok = row["outcome"] in ("ok", "not_modified")
            attempts, good, etag = (0, row["seq"], row["etag"] or etag) if ok else (attempts + 1, good, row["etag"] or etag)
        return attempts, good, etag, row["seq"]

    def folded(batches):
        held, words = {}, {}
        for batch in batches:
            streams.fold_fetches(held, words, pd.DataFrame(batch))
        assert held["attempts"] == sum(w.bit_count() for w in words.values())
        return held["attempts"], held.get("good_seq"), held.get("etag"), held["last_seq"]

    def row(seq, outcome):
        return {"seq": seq, "status": 1, "outcome": outcome, "etag": f"e{seq}" if seq % 3 else None, "last_modified": None, "fetched_at": pd.Timestamp("2024-01-01")}

    for outcomes in itertools.product(["ok", "retryable"], repeat=4):
        log = [row(700 * i, o) for i, o in enumerate(outcomes)]
        for order in itertools.permutations(log):
            assert folded([[r] for r in order]) == folded([order[:2], order]) == walked(log)
    rng = random.Random(3)
    for _ in range(30):
        log = [row(rng.randrange(-3000, 6000), rng.choice(["ok", "retryable", "retryable", "retryable", "fetch_failed"])) for _ in range(300)]
        log = list({r["seq"]: r for r in log}.values())
        mixed = rng.sample(log, len(log)) + rng.sample(log, 40)
        assert folded([mixed[i : i + 37] for i in range(0, len(mixed), 37)]) == walked(log)


def test_a_million_failures_of_one_url_take_linear_time():
    import time

    import numpy as np
    import pandas as pd

    def took(n):
        seq = np.random.default_rng(0).permutation(n) + 1
        held, words, began = {}, {}, time.perf_counter()
        for own in np.array_split(seq, n // 50_000):
            streams.fold_fetches(held, words, pd.DataFrame({"seq": own, "status": 503, "outcome": "retryable", "etag": None, "last_modified": None, "fetched_at": pd.Timestamp("2024-01-01")}))
        assert held["attempts"] == n
        return time.perf_counter() - began

    small, large = took(200_000), took(1_000_000)
    assert large < 60 and large < 12 * small



def test_late_rows_are_dropped_from_counts(spark, tmp_path):
    """Rows later than the watermark, which follows the batches before."""
    schema = "ts timestamp, engine string, seen int, citations int"
    seen = {}
    for n, ts in enumerate(["2024-01-01 00:00:30", "2024-01-01 01:00:00", "2024-01-01 02:00:00", "2024-01-01 00:00:40"]):
        spark.createDataFrame([(ts, "e", 1, 1)], "ts string, engine string, seen int, citations int").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "engine", "seen", "citations").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        counts = streams.presence_counts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        counts.writeStream.outputMode("update").foreachBatch(lambda b, k: seen.update({str(r.minute): r.events for r in b.collect()})).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert seen == {"2024-01-01 00:00:00": 1, "2024-01-01 01:00:00": 1, "2024-01-01 02:00:00": 1}


def test_bm25_of_common_words_matches_brute_force(spark):
    """A corpus whose queries' words are in most documents: those without any come first, by id."""
    texts = {str(i): "common words " + ("rare" if i % 3 else "") for i in range(30)} | {str(i): "nothing" for i in (7, 21, 28)}
    corpus = spark.createDataFrame([(i, "", "", t, None, None, None, None) for i, t in texts.items()], CORPUS)
    queries = spark.createDataFrame([("a", "common"), ("b", "rare words"), ("c", "nothing")], "query_id string, q string")
    for name, q in (("a", "common"), ("b", "rare words"), ("c", "nothing")):
        want = bm25_by_hand([(i, "", t) for i, t in texts.items()], q)
        top = sorted(want, key=lambda i: (-round(want[i], 9), i))[:4]
        got = search.bm25_search(corpus, queries, 4).where(F.col("query_id") == name).orderBy("rank").collect()
        assert [r.id for r in got] == top, name


def test_vector_search_in_blocks_of_queries(spark):
    corpus = spark.createDataFrame([(str(i), "", f"w{i}", f"w{i} shared", None, None, None, None) for i in range(20)], CORPUS)
    queries = spark.createDataFrame([(f"q{i}", f"w{i} shared") for i in range(9)], "query_id string, q string")
    rows = lambda df: sorted((r.query_id, r.rank, r.id) for r in df.collect())
    assert rows(search.vector_search(corpus, queries, 3, block=2)) == rows(search.vector_search(corpus, queries, 3))


def test_bm25_in_blocks_of_queries(spark):
    """Rare, common and unknown words, repeated ones, an empty text, and a query without tokens."""
    texts = {str(i): f"w{i % 7} shared " * (i % 4) for i in range(40)}
    corpus = spark.createDataFrame([(i, "", "", t, None, None, None, None) for i, t in texts.items()], CORPUS)
    asked = {"a": "w1 w1 shared", "b": "w2 nowhere", "c": "nowhere", "d": "w3", "e": "w6 w5"}
    queries = spark.createDataFrame([*asked.items(), ("f", " . "), ("g", None)], "query_id string, q string")
    for block in (2, 2000):
        got = {}
        for r in search.bm25_search(corpus, queries, 12, block=block).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        for name, q in asked.items():
            want = bm25_by_hand([(i, "", t) for i, t in texts.items()], q)
            assert got[name] == sorted(want, key=lambda i: (-round(want[i], 9), i))[:12], (name, block)
        assert set(got) == set(asked)
    assert search.bm25_search(corpus.limit(0), queries, 3).count() == 0


def test_best_of_task_keeps_ties_by_id():
    """Scores in three batches, more of them equal than places; differences after the ninth digit are none."""
    rng = np.random.default_rng(3)
    rows = [(f"d{i:03}", [float(v) for v in rng.integers(0, 3, 2) + rng.uniform(0, 1e-11, 2)]) for i in rng.permutation(90)]
    batches = [pa.RecordBatch.from_pydict({"id": [i for i, _ in rows[at : at + 30]], "v": [v for _, v in rows[at : at + 30]]}) for at in (0, 30, 60)]
    keep = search.best_of_task(lambda b: np.array(b.column(1).to_pylist()), ["x", "y"], 7)
    got = [(q, i) for b in keep(iter(batches)) for q, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    want = [(q, i) for j, q in enumerate("xy") for i, _ in sorted(rows, key=lambda r: (-round(r[1][j], 9), r[0]))[:7]]
    assert got == want


def test_flat_pages_take_linear_time():
    import time

    began = time.perf_counter()
    assert len(blocks("<p>x" * 100_000)) == 100_000
    assert time.perf_counter() - began < 20
    assert len(blocks("<i>" * 3000 + "<div><p>a</p></div>" * 3000)) == 3000


def test_urls_of_a_large_host_come_in_parts(spark):
    urls_ = spark.range(50).selectExpr("concat('https://h/', id) AS url").unionByName(spark.createDataFrame([("https://k/1",), ("https://k/1",)], "url string"))
    got = publish.indexnow_payload(urls_, most=10).collect()
    assert sorted(u for r in got for u in r.url_list) == sorted({r.url for r in urls_.collect()}) and len([r for r in got if r.host == "h"]) > 3
    assert [r.url_list for r in got if r.host == "k"] == [["https://k/1"]]
