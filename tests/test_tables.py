"""Keyed tables, robots rules, chunked series and readers."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from pagesignal.jobs import stream_jobs
from pagesignal.operators import pages, presence
from pagesignal.sources import tables
from pagesignal.sources.keyed import KeyedTable
from pagesignal.streaming import streams

KPI = "seq long, metric string, t string, v double, geo string, src string"


def kpi_rows(spark, seqs, keys=40):
    return spark.createDataFrame([(i, f"m{i * 7 % keys}", "t", float(i), "g" if i % 9 else None, "s") for i in seqs], KPI)


def plain(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_a_batch_writes_no_more_than_it_brings(spark, tmp_path):
    """Bytes of a batch that doesn't write the base anew stay those of its rows, while the table grows; all bases together stay in proportion."""
    table = streams.kpi_table(spark, f"{tmp_path}/t", bucket_bytes=4000)
    wrote, bases, seen = [], [], []
    for batch in range(12):
        own = range(batch * 300, batch * 300 + (300 if batch % 2 else 20))
        seen += own
        before = set(table.parts()[0])
        n = tables.write_keyed_table(kpi_rows(spark, own, keys=100_000), table, batch)
        new = set(table.parts()[0]) - before
        assert table.size(table.parts()[1][batch]) <= n
        (bases if new else wrote).append((len(own), n))
        assert plain(table.read().select("metric", "seq", "v")) == plain(presence.kpi_upsert(kpi_rows(spark, seen, keys=100_000)).select("metric", "seq", "v"))
    small, large = [n for rows, n in wrote if rows == 20], [n for rows, n in wrote if rows == 300]
    assert max(small) < min(large) and max(small) < 1.3 * min(small)
    assert 2 <= len(bases) <= 5  # the base doubles in between
    assert table.parts()[0].keys() == {table.live()[0]} or len(table.parts()[0]) <= 2


def test_batches_again_late_and_by_key(spark, tmp_path):
    rows = kpi_rows(spark, range(400))
    want = plain(presence.kpi_upsert(rows))
    for order in ((0, 1, 2, 3), (3, 1, 0, 2)):
        table = streams.kpi_table(spark, f"{tmp_path}/{order[0]}", bucket_bytes=500)
        assert table.read() is None
        for number, part in enumerate(order):
            for _ in range(1 + part % 2):  # some batches are run again, also after their base was written
                table.append(rows.where(F.col("seq") % 4 == part), number)
        assert plain(table.read()) == want
        wanted = rows.select(*table.key).where("metric IN ('m1', 'm5')").distinct()
        assert plain(table.read(wanted)) == plain(presence.kpi_upsert(rows).where("metric IN ('m1', 'm5')"))
        base = spark.read.parquet(table.parts()[0][table.live()[0]])
        assert base.select("__bucket").distinct().count() > 1


def test_buckets_split_as_the_table_grows(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", ["k"], lambda rows: rows.groupBy("k").agg(F.max("v").alias("v")), bucket_bytes=3000)
    counts = []
    for batch in range(6):
        table.append(spark.range(100 * 3**batch).selectExpr("id AS k", "id AS v"), batch)
        newest = table.live()[0]
        if newest is not None:
            counts.append(spark.read.parquet(table.parts()[0][newest]).agg(F.max("__buckets")).first()[0])
    assert counts == sorted(counts) and counts[-1] > counts[0] and table.read().count() == 100 * 3**5


# --- robots ----------------------------------------------------------------------------------


def test_robots_grammar():
    body = "User-agent : *\r\nDisallow : /a\n User-Agent:\nDisallow: /b\ndisallow:\nAllow: /a/c\nDISALLOW:/d  \n# Disallow: /e\nUser-agent: Bot/1.0\nUser-agent: bot\nDisallow: /f\nuser-agent: BOT/1.0\nDisallow: /g\nDisallow: /g"
    assert pages.robots_rules(body, "other") == ["/a", "/b", "/d"]
    assert pages.robots_rules(body, "bOt") == ["/f"] and pages.robots_rules(body, "Bot/1.0") == ["/g"]
    assert pages.robots_rules("Disallow: /x\nUser-agent: named", "named") == [] == pages.robots_rules(None, "x") == pages.robots_rules("", "x")
    assert pages.robots_rules("User-agent: *\nDisallow: /all\nUser-agent: named", "named") == []
    began = time.perf_counter()
    assert len(pages.robots_rules("User-agent: *\n" + "".join(f"Disallow: /path/{i}\n" for i in range(60_000)), "x")) == 60_000
    assert time.perf_counter() - began < 1


@pytest.mark.parametrize("most", [10**6, 1])
def test_prefixes_of_hot_hosts(spark, most):
    rng = random.Random(1)
    hosts = ["hot"] * 5 + ["a", "b", None]
    rules = [(rng.choice(hosts), "/" + "".join(rng.choices("abé/", k=rng.randrange(7)))) for _ in range(60)] + [("a", ""), ("b", None)]
    urls = [(i, f"https://{h}/{''.join(rng.choices('abé/', k=rng.randrange(9)))}?q") for i in range(400) for h in [rng.choice(["HOT", "a", "b", "c"])]] + [(900, None), (901, "nonsense"), (902, "http://hot")] * 2
    got = pages.robots_filter(spark.createDataFrame(urls, "n long, url string").withColumn("rule", F.lit(1)), spark.createDataFrame(rules, "host string, rule string"), most_rules=most)
    assert got.columns == ["n", "url", "rule"]
    own = {}
    for h, r in rules:
        if h and r is not None:
            own.setdefault(h, set()).add(r)

    def free(url):
        host, _, path = (url or "").removeprefix("https://").removeprefix("http://").partition("/")
        path = "/" + path.partition("?")[0] if "://" in (url or "") else ""
        return not any(path.startswith(r) for r in own.get(host.lower(), ()))

    assert sorted((r.n, r.url) for r in got.collect() if r.n < 900) == sorted(u for u in urls if u[0] < 900 and free(u[1]))
    assert sum(r.n >= 900 for r in got.collect()) in (4, 6)


def test_a_hundred_thousand_rules_of_one_host(spark):
    rules = spark.range(100_000).selectExpr("'hot' AS host", "'/p/' || id || '/' AS rule")
    urls = spark.range(300_000).selectExpr("'https://' || CASE WHEN id % 3 = 0 THEN 'hot' ELSE 'h' || id % 50 END || '/p/' || id || '/x' AS url")
    assert pages.robots_filter(urls, rules).count() == pages.robots_filter(urls, rules, most_rules=10).count() == 300_000 - 33_334


def test_validators_of_failed_answers(spark):
    log = spark.createDataFrame([(1, "u", 200, 10, "good", "m1", None), (2, "u", 503, 10, "bad", "m2", None), (3, "u", 404, 10, "bad", "m3", "asked"), (4, "v", 200, 9_000_000, "large", "", None), (5, "v", 304, 1, "", "m5", None)], "seq long, url string, status int, n_bytes long, etag string, last_modified string, sent_etag string").withColumn("fetched_at", F.timestamp_seconds("seq"))
    assert {(r.url, r.etag, r.last_modified) for r in pages.recrawl_state(log).collect()} == {("u", "asked", "m1"), ("v", "large", "m5")}
    assert {(r.url, r.etag) for r in pages.recrawl_state(log.drop("sent_etag")).collect()} == {("u", "good"), ("v", "large")}
    assert [r.etag for r in pages.recrawl_attempts(log).orderBy("seq").collect()] == ["good", "good", "asked", "large", "large"]


# --- ingest ----------------------------------------------------------------------------------


def test_only_absent_keys_are_rejected(spark):
    kinds = "seq long, query string, engine string, citations string, position string"
    rows = [(1, "", "", "3000000000", " -5 "), (2, None, "e", None, None), (3, "q", None, None, None), (4, "q", "e", "1.5", None), (5, "q", "e", None, ""), (6, "q", "e", "9223372036854775808", None)]
    good, bad = presence.validate_presence(spark.createDataFrame(rows, kinds))
    assert [(r.seq, r.citations, r.position) for r in good.collect()] == [(1, 3_000_000_000, -5)]
    assert {r.seq: r.reason for r in bad.collect()} == {2: "query missing", 3: "engine missing", 4: "citations not an integer", 5: "position not an integer", 6: "citations not an integer"}
    points = spark.createDataFrame([(1, "", "", "1", None), (2, None, "t", "1", None), (3, "m", None, "1", None), (4, "m", "t", None, None)], "seq long, metric string, t string, v string, src string")
    good, bad = presence.validate_kpi(points)
    assert [r.seq for r in good.collect()] == [1] and {r.reason for r in bad.collect()} == {"metric missing", "t missing", "v not a number"}


def test_a_hot_metric_comes_in_runs(spark):
    points = spark.range(6000).selectExpr("CASE WHEN id % 3 > 0 THEN 'hot' ELSE 'm' || id % 60 END AS metric", "CAST(id * 7919 % 6000 AS STRING) AS t", "CAST(id AS DOUBLE) AS v", "'s' AS src").repartition(5)
    metrics = points.select("metric").unionByName(spark.createDataFrame([("none",)], "metric string"))
    got = presence.kpi_series_chunks(metrics, points, chunk=250).collect()
    hot = sorted((r.chunk, [p.t for p in r.points]) for r in got if r.metric == "hot")
    assert [c for c, _ in hot] == list(range(16)) and all(len(p) == 250 for _, p in hot)
    assert sum((p for _, p in hot), []) == sorted(r.t for r in points.where("metric = 'hot'").collect())
    assert [(r.chunk, r.points) for r in got if r.metric == "none"] == [(0, [])]
    whole = {r.metric: r.points for r in presence.kpi_series(metrics, points).collect()}
    assert len(whole["hot"]) == 4000 and [p.t for p in whole["hot"]] == sum((p for _, p in hot), [])


def test_bytes_that_are_no_text_are_left_out(spark, tmp_path):
    cases = [b"ab\xffcd", b"\xc3(", "é\ufffd".encode(), b"\n", b"\xe2\x82", b"\xed\xa0\x80x", b"\xf0\x9f\x98\x80"]
    for i, data in enumerate(cases):
        (tmp_path / f"{i}.html").write_bytes(data)
    got = {int(r.url.rsplit("/", 1)[-1].split(".")[0]): r.html for r in tables.read_raw_pages(spark, str(tmp_path)).collect()}
    assert got == {i: data.decode("utf-8", "ignore") for i, data in enumerate(cases)}


def test_small_files_are_few_tasks(spark, tmp_path):
    for i in range(1500):
        (tmp_path / f"{i}.html").write_bytes(b"%d" % i)
    pages = tables.read_raw_pages(spark, str(tmp_path))
    assert pages.rdd.getNumPartitions() <= 16
    assert {r.html for r in pages.collect()} == {str(i) for i in range(1500)}


@pytest.mark.parametrize("local", [True, False])
def test_each_page_is_a_file(spark, tmp_path, local):
    rows = [(1, b"a"), (1, b"b"), (1, b"b"), (2, b"x\xffy\n\nz"), (3, b""), *((i, b"%d" % i) for i in range(10, 60))]
    stream_jobs._write_pages(spark.createDataFrame(rows, "page_id long, value binary"), f"{tmp_path}/pages", parts=8, local=local)
    files = [p for p in (tmp_path / "pages").rglob("*") if p.is_file() and p.name[0] not in "._"]
    assert sorted(p.read_bytes() for p in files) == sorted(v + b"\n" for _, v in rows)
    assert len(list((tmp_path / "pages").iterdir())) <= 10
    got = [(int(r.url.split("page=p")[1].split("/")[0].split(".")[0]), r.html) for r in tables.read_raw_pages(spark, f"{tmp_path}/pages").collect()]
    assert sorted(got) == sorted((i, v.decode("utf-8", "ignore") + "\n") for i, v in rows)


def test_tasks_list_what_spark_lists(spark, tmp_path):
    """A pattern of paths goes through Spark's own listing, a folder doesn't; its files are not in the plan."""
    for name in ("a/b/c.html", "a/_no/x", "a/.no/x", "a/_k=1/y z%20ü.html", "a/_no", "a/.no.crc", "a/n._COPYING_", "a/empty", "_no/x", ".no", "d.html", "_metadata"):
        file = tmp_path / "in" / (name if name not in ("a/_no", ".no") else name + "2")
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(b"" if name == "a/empty" else f"{name}\xff".encode("latin-1"))
    (tmp_path / "in/link").symlink_to(tmp_path / "in/a/b")
    pages = tables.read_raw_pages(spark, f"{tmp_path}/in")
    assert plain(pages) == plain(tables.read_raw_pages(spark, f"{tmp_path}/i[n]")) and pages.count() == 4
    assert not pages.inputFiles()
