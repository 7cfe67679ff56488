"""Training-text operators against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import json
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagesignal.llm import digest, html_crf, language_id, mixing, near_copies, packing, pii, quality_net, quality_rules, queries, simhash, tokens

SF = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
HAS_DATA = pytest.mark.skipif(not SF.exists(), reason="no test tables")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD_TEXTS = [None, "", " ", "\n\n", "a", "A a A", "word " * 30, "ünïcode ẞ 😀 texts are longer than ascii " * 3, "x" * 5000, "one two three\n" * 40, "word " * 30]


@pytest.fixture
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, extra columns with names used inside."""
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, None) for i, t in enumerate(ODD_TEXTS)] + [(4, "a", None, None, 1), (4, "a", None, None, 1), (None, "null id text", "en", "s", 3)]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("fp", "size", "component_id", "part", "positions", "score", "words", "group", "fingerprint")})


def nothing(spark):
    return spark.createDataFrame([], DOCS)


def sample_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- 1: language ---------------------------------------------------------------------------


def test_language_counts_match_brute_force():
    texts = ["Ab, c", "", "é é", "x"]
    ids, of = language_id.gram_ids(texts, 16)
    want = Counter()
    for k, t in enumerate(texts):
        points = [ord(c) if c.isalpha() else 32 for c in f" {t.lower()}  "]
        for i in range(len(points) - 2):
            if points[i] != 32 or points[i + 1] != 32:
                want[k, "two"] += 1
            if points[i + 1] != 32:
                want[k, "three"] += 1
    assert Counter(of.tolist()) == Counter({k: n for k in range(4) if (n := want[k, "two"] + want[k, "three"])}) and ids.max() < 1 << 16
    a, b = language_id.gram_ids(["the cat"], 16)[0], language_id.gram_ids(["THE, cat!"], 16)[0]
    assert set(a.tolist()) & set(b.tolist())


@HAS_DATA
def test_language_held_out_accuracy(spark):
    found = queries.op1_language_id(spark, str(SF)).join(sample_docs(spark).select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(found) > 20 and (found.lang_pred == found.lang).mean() > 0.95 and found.score.between(0, 1).all()
    ids = found.doc_id.tolist()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in ids)


def test_language_edges(spark, odd):
    model = language_id.fit(odd, F.lit(True))
    got = language_id.identify(odd, model).toPandas()
    assert len(got) == odd.count() and set(got[got.doc_id.isin([0, 1, 2, 3])].lang_pred) == {"und"}
    assert language_id.identify(nothing(spark), language_id.fit(nothing(spark), F.lit(True))).count() == 0
    assert language_id.LanguageModel((), np.zeros((4, 0), np.float32), 2, 5).score(["abc"])[0] == ["und"]


def test_long_texts_are_scored_whole():
    model = language_id.LanguageModel(("a", "b"), np.random.default_rng(0).normal(size=(1 << 16, 2)).astype(np.float32), 16, 60)
    from pagesignal.llm.common import chunks_by_size

    text = "lorem ipsum dolor " * 100_000
    assert sum(len(s) for _, run in chunks_by_size([text, None, "x"], 1000) for s in run) == len(text) + 1
    assert model.score([text])[0] == model.score([text[:1_799_982] + "dolor ipsum lorem "])[0]


# --- 2: SimHash ----------------------------------------------------------------------------


def brute_fingerprint(text):
    w = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, reach=2):
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= reach:
                up[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)].append(doc_id)
    return [min((x for x in least[root(i)] if x is not None), default=None) for i in range(len(rows))]


@HAS_DATA
def test_simhash_matches_brute_force(spark):
    docs = {r.doc_id: r.text for r in sample_docs(spark).collect()}
    want = [(i, brute_fingerprint(t)) for i, t in docs.items()]
    comps = brute_components(want)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash(spark, str(SF)).collect()}
    assert got == {i: (f"{fp:016x}", c) for (i, fp), c in zip(want, comps)}


def test_simhash_long_text():
    text = " ".join(f"w{i % 977}" for i in range(250_003))
    words = text.split()
    ones = np.zeros(64, int)
    for i in range(len(words) - 2):
        h = xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42)
        ones += np.array([h >> b & 1 for b in range(64)])
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * ones[b] > len(words) - 2)


@pytest.mark.parametrize("seed", range(3))
def test_links_are_exact_over_shards(spark, seed):
    """Random fingerprints, planted pairs, and a dense cloud, in far smaller shards than in production."""
    r = np.random.default_rng(seed)
    x = r.integers(0, 1 << 63, 1500, dtype=np.uint64)
    x = np.concatenate([x, x[:200] ^ np.uint64(0b101), x[:50] ^ np.uint64(1 << 40)])
    cloud = np.array([sum(1 << b for b in set(r.integers(0, 20, 4).tolist())) for _ in range(300)], np.uint64)
    x = np.unique(np.concatenate([x, cloud])).view(np.int64)
    nodes = spark.createDataFrame([(int(v),) for v in x], "fp long")
    edges = [(e.a, e.b) for e in simhash.link_edges(nodes, leaf_size=100, sample_size=600).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in edges)
    want = brute_components([(int(v), int(v) & (1 << 64) - 1) for v in x])
    roots = {q.node: q.root for q in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert [roots.get(int(v), int(v)) for v in x] == want


def test_local_links_match_brute_force():
    r = np.random.default_rng(9)
    x = np.unique(np.array([sum(1 << b for b in set(r.integers(0, 64, 3).tolist())) for _ in range(900)] + r.integers(0, 1 << 62, 500).tolist(), np.uint64))
    forest = simhash.Forest(len(x))
    for i, j in simhash.spanning_links(x, 2, small=50):
        assert int(x[i] ^ x[j]).bit_count() <= 2
        forest.link(i, j)
    brute = brute_components([(i, int(v)) for i, v in enumerate(x)])
    assert len({forest.root(i) for i in range(len(x))}) == len(set(brute))


def test_simhash_edges(spark, odd):
    got = simhash.near_duplicates(odd)
    assert got.count() == odd.count() and got.columns == ["doc_id", "fingerprint", "component_id"]
    assert {(r.fingerprint, r.component_id) for r in got.where("doc_id < 4").collect()} == {("0" * 16, 0)}
    assert simhash.near_duplicates(nothing(spark)).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == [-1, 0, 4, 5, 6, 7, 8, 9]


@pytest.mark.parametrize("choose", [simhash.representatives, near_copies.representatives])
def test_keep_one_keeps_a_row_of_every_group(spark, choose):
    """Rows that share an id but not a text are no copies: only copies go, whatever their ids."""
    b, c, d, e = (" ".join(f"{x}{i}" for i in range(40)) for x in "bcde")
    near = d.replace("d7 ", "d7 d7 ")
    rows = [(1, b), (1, c), (2, c), (3, d), (None, c), (None, e), (None, e), (4, e), (5, b), (6, None), (7, ""), (None, None)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)), choose)
    assert sorted(map(tuple, kept.select("doc_id", "text").collect()), key=str) == sorted([(1, b), (1, c), (3, d), (4, e), (6, None)], key=str)
    if choose is near_copies.representatives:
        kept = simhash.keep_one(spark.createDataFrame([(9, d), (9, near), (8, near), (9, b)], "doc_id long, text string"), choose)
        assert sorted(map(tuple, kept.collect())) == [(8, near), (9, b)]


def test_tables_of_two_threads_are_kept_apart(spark):
    from threading import Barrier, Thread

    from pagesignal.llm.common import cut, temporary

    met, counts = Barrier(2), []

    def first():
        with temporary(spark):
            cut(spark.range(3)).count()
            met.wait(60)  # the other's table stands by now
            met.wait(60)

    def second():
        with temporary(spark):
            own = cut(spark.range(5))
            met.wait(60)
            met.wait(60)
            one.join()
            counts.append(own.count())

    one, two = Thread(target=first), Thread(target=second)
    one.start(), two.start()
    one.join(), two.join()
    assert counts == [5]


def test_places_in_files_of_any_name(spark, tmp_path):
    for name, rows in [("part-00002-a", 3), ("part-00010-a", 2), ("zz", 4), ("aa", 1)]:
        spark.range(rows).coalesce(1).selectExpr("id AS doc_id", f"'{name}' AS text").write.parquet(f"{tmp_path}/w-{name}")
        made = next(Path(f"{tmp_path}/w-{name}").glob("part-*.parquet"))
        Path(f"{tmp_path}/all").mkdir(exist_ok=True)
        made.rename(f"{tmp_path}/all/{name}.parquet")
    got = packing.with_file_positions(spark.read.parquet(f"{tmp_path}/all")).collect()
    assert [r.text for r in sorted(got, key=lambda r: r.position)] == ["part-00002-a"] * 3 + ["part-00010-a"] * 2 + ["aa"] + ["zz"] * 4
    assert sorted(r.position for r in got) == list(range(10))


def test_chain_of_links_is_one_component(spark):
    chain = [(i, i + 1) for i in range(200)]
    random.Random(1).shuffle(chain)
    got = simhash.components(spark.createDataFrame(chain, "a long, b long"))
    assert got.count() == 201 and {r.root for r in got.collect()} == {0}


def test_one_text_very_often(spark):
    """A hot fingerprint, and ids that many rows share: whole results, and no shuffle brings the rows of one key together."""
    docs = spark.range(100_000).select(F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id")).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, "the very same text of some words").otherwise(F.concat(F.lit("text number "), "id")).alias("text"))
    got = simhash.near_duplicates(docs)
    assert got.count() == 100_000
    same = got.where(F.col("fingerprint") == f"{simhash.fingerprint('the very same text of some words'):016x}")
    assert same.count() >= 50_000 and {r.component_id for r in same.select("component_id").distinct().collect()} == {2}
    kept = simhash.keep_one(docs.where("doc_id = 5").limit(200))
    texts = [r.text for r in kept.collect()]
    assert texts.count("the very same text of some words") == 1 and len(set(texts)) == len(texts) > 10
    parts = got.where(F.col("fingerprint") == f"{simhash.fingerprint('the very same text of some words'):016x}").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 1


def test_hub_of_links(spark):
    hub = [(0, i) for i in range(1, 3000)] + [(10_000 + i, 20_000 + i) for i in range(50)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(hub, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(3000)) and all(got[20_000 + i] == 10_000 + i for i in range(50))


# --- 3: digest -----------------------------------------------------------------------------


def brute_edits(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is None, r[1] or ""))
    out = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        changed = t[: len(t) - half] + after[:half]
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), digest.digest(t.encode()), digest.digest(changed.encode()), digest.digest(after.encode())))
    return out


@pytest.mark.parametrize("range_bytes", [1, 300, 1 << 24])
def test_edits_match_brute_force(spark, odd, range_bytes):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = sorted((str(i), n, sha, a, b, round(digest.likeness(a, b), 9), round(digest.likeness(a, c), 9)) for i, n, sha, a, b, c in brute_edits(rows))
    got = sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in digest.compare_with_edits(odd, range_bytes).collect())
    assert got == want
    assert digest.compare_with_edits(nothing(spark), range_bytes).count() == 0


def test_one_document_is_its_own_next(spark):
    row = digest.compare_with_edits(spark.createDataFrame([(5, "abcd", None, None, None)], DOCS)).first()
    assert row.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and row.near_next == 1.0


@HAS_DATA
def test_digest_tells_edits_from_strangers(spark):
    got = queries.op3_digest(spark, str(SF)).where("n_chars > 300").toPandas()
    assert (got.near_edited >= got.near_next).mean() > 0.9
    assert got[["near_edited", "near_next"]].stack().between(0, 1).all()


def test_digest_counts():
    data = bytes(random.Random(2).randrange(256) for _ in range(3000))
    want = Counter(int(digest._PLACES[0][a] ^ digest._PLACES[1][b]) * 29 % 256 ^ int(digest._PLACES[2][c]) for a, b, c in zip(data, data[1:], data[2:]))
    assert digest.counts(data).tolist() == [want[i] for i in range(256)]
    assert digest.likeness(digest.digest(b""), digest.digest(b"")) == 1.0 and digest.digest(b"a") != digest.digest(b"a" * 9)


# --- 4: personal data ----------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_base(text):
    def ok(kind, s):
        d = re.sub(r"[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            total = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d)))
            return 13 <= len(d) <= 19 and total % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    return {k: [m.span() for m in re.finditer(p, text) if ok(k, m[0])] for k, p in BASE.items()}


@HAS_DATA
def test_plain_spans_match_the_patterns(spark):
    for r in sample_docs(spark).collect():
        base, full = pii.find(r.text)
        assert base == brute_base(r.text) and all(set(base[k]) <= set(full[k]) for k in base)


def test_plain_spans_on_random_strings():
    r = random.Random(4)
    for _ in range(4000):
        text = "".join(r.choice(["a", "b.", "@", "@x.y", ".", "1", "23", "256", "4111 1111 1111 1111", " ", "-", "+", "+1 (555) 010-9999", "(", "%", "é"]) for _ in range(r.randrange(1, 14)))
        assert pii.plain_spans(text) == brute_base(text), text


@pytest.mark.parametrize(("text", "kind", "found"), [
    ("mail jane.doe [at] example [dot] com now", "email", "jane.doe [at] example [dot] com"),
    ("mail jane (AT) example.org now", "email", "jane (AT) example.org"),
    ("write to bob at mail dot example dot com please", "email", "bob at mail dot example dot com"),
    ("jаne@exаmple.com", "email", "jаne@exаmple.com"),
    ("ｊane＠example．com", "email", "ｊane＠example．com"),
    ("call +one nine one zero five five five zero one two three ok", "phone", None),
    ("host 10[.]0[.]0[.]1 is up", "ip", "10[.]0[.]0[.]1"),
    ("ip one nine two.one six eight.one.one end", "ip", "one nine two.one six eight.one.one"),
    ("card four one one one one one one one one one one one one one one one end", "card", "four one one one one one one one one one one one one one one one"),
    ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
    ("4111​111111111111", "card", "4111​111111111111"),
    ("𝐣𝐨𝐡𝐧@example.com", "email", "𝐣𝐨𝐡𝐧@example.com"),
    ("ask ⓙⓐⓝⓔ@example․com", "email", "ⓙⓐⓝⓔ@example․com"),
    ("call ＋１ 910 555 ٠١٢٣ ok", "phone", "＋１ 910 555 ٠١٢٣"),
    ("host one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"),
])
def test_disguises_map_back_to_the_source(text, kind, found):
    base, full = pii.find(text)
    spans = [text[a:b] for a, b in full[kind]]
    assert spans == ([found] if found else spans)
    if found:
        assert not base[kind] and found not in pii.mask(text)


@pytest.mark.parametrize(("text", "kind", "found"), [
    *((f"ask {a} today", "email", a) for a in ("jane at example dot it", "jane at example dot ru", "jane at example dot in", "jane at mail.example dot com", "jane@example dot museum", "j.doe at example.com", "jane dot doe at mail dot example dot it")),
    ("jane at example.com", "email", "jane at example.com"),
    ("please email jane at example.com now", "email", "jane at example.com"),
    ("host 192 dot 168 dot 0 dot 1 is up", "ip", "192 dot 168 dot 0 dot 1"),
    ("host one nine two dot one six eight dot zero dot one is up", "ip", "one nine two dot one six eight dot zero dot one"),
    ("host 10 dot zero dot 0 dot one is up", "ip", "10 dot zero dot 0 dot one"),
    ("call plus one nine one zero five five five zero one two three ok", "phone", "plus one nine one zero five five five zero one two three"),
    ("call plus 1 910 555 0123 ok", "phone", "plus 1 910 555 0123"),
])
def test_any_last_label_spoken_dots_and_plus(text, kind, found):
    base, full = pii.find(text)
    assert not base[kind] and [text[a:b] for a, b in full[kind]] == [found] and found not in pii.mask(text)


def test_prose_about_dots_is_left_alone():
    for text in (
        "She stared at one dot in the picture.", "We looked at a dot it was red.", "They met at noon dot and dash followed.", "Find us at example.com or visit at shop.example.org today.",
        "It is hosted at example.com.", "Get tickets at example.com now.", "two plus 3 is five", "It is 3 dot 5 high", "12 plus 100 200 300 400", "He pointed at that dot on it.",
    ):
        assert not any(pii.find(text)[1].values()), text
    for text in ("a at b" * 50_000, "a at b dot " * 30_000, "1 dot " * 50_000, "plus " * 50_000, "a dot " * 50_000):
        pii.find(text)


def test_clean_prose_has_no_added_spans():
    for text in ("He looked at the dot on the map. One two three four.", "Meet at noon (at home) [dot] 5", "f(x) = [1.2] at {3}", "oh one two"):
        assert not any(pii.find(text)[1].values()), text


def test_pii_takes_linear_time_and_alike_tables_agree():
    assert len({len(k) for k in ("".join(pii._ALIKE), "".join(pii._ALIKE.values()))}) == 1
    for text in ("a" * 300_000, "1" * 300_000, "+1" + " " * 300_000, "a@" * 100_000, "one " * 50_000, "(at " * 50_000, "а" * 200_000):
        pii.find(text)


def test_pii_edges(spark, odd):
    got = pii.detect(odd).collect()
    assert len(got) == odd.count() and all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got)
    masked = pii.mask_documents(spark.createDataFrame([(1, "x a@b.co y", None, None, 10), (2, None, None, None, None)], DOCS).withColumn("spans", F.lit("own")))
    assert [tuple(r) for r in masked.orderBy("doc_id").collect()] == [(1, "x <EMAIL> y", None, None, 11, "own"), (2, None, None, None, None, "own")]
    assert pii.detect(nothing(spark)).count() == 0 and pii.mask("+1 (555) 010-9999 and 10.0.0.1") == "<PHONE> and <IP>"


# --- 5: quality rules ----------------------------------------------------------------------


def brute_measures(text):
    text = text or ""
    w = words_of(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        dup += bool(words_of(line)) and line in lines
        lines.add(line)
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


@HAS_DATA
def test_rule_counts_match_brute_force(spark, odd):
    for df in (sample_docs(spark), odd):
        for r in df.collect():
            assert tuple(getattr(quality_rules.examine(r.text), k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == brute_measures(r.text), r.text


@HAS_DATA
def test_verdicts_follow_quality_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality IS NOT NULL")
    got = queries.op5_quality_rules(spark, str(SF)).join(labels, "doc_id").where("n_words >= 20").toPandas()
    assert (got.kept == (got.quality == 1)).mean() > 0.97 and not (got.base_failed & got.kept).any()


def test_lines():
    good = "This is a line of plain prose that any reader would want to keep here."
    text = "\n".join([good, "Home | About | Contact | Help", "BUY!! NOW!! GET!! IT!!", good, "", "We use cookies to serve you.", "$$$ ### *** &&&"])
    assert quality_rules.clean_lines(text)[0] == f"{good}\n"
    assert quality_rules.examine("\n".join(" ".join(f"word{i}{j}" for j in range(9)) + "." for i in range(5))).kept


def test_menus_without_bars_and_long_lines_of_prose():
    good = "This is a line of plain prose that any reader would want to keep here."
    menu = ["Home", "Products", "", "About us", "Contact", "Our team", "Log out"]
    assert quality_rules.clean_lines("\n".join([good, *menu, good + " Indeed."]))[0] == f"{good}\n\n{good} Indeed."
    assert quality_rules.clean_lines("Home  Products  About us  Contact\nHome\tProducts\tHelp\tContact")[0] == ""
    assert not quality_rules.examine("\n".join(f"Item {a}{b}" for a in "abcdef" for b in "uvwxyz")).kept
    for clean in (
        "You will need:\napples\npears\nplums\nsugar\nbutter\nflour", "- apples\n- pears\n- plums\n- sugar\n- flour\n- eggs", "1. apples\n2. pears\n3. plums\n4. sugar\n5. flour",
        "apples,\npears,\nplums,\nsugar,\nflour.", "Yes.\nNo.\nWhy?\nWell.\nGo!", "apples\npears\nplums\n" + good,
    ):
        assert quality_rules.clean_lines(clean)[0] == clean, clean
    prose = " ".join(f"word{i}" for i in range(60)) + "."
    for opening in ("Read more", "Log in", "Share this"):
        assert quality_rules.examine(f"{opening} {prose}").kept and quality_rules.clean_lines(f"{opening} {prose}")[0] == f"{opening} {prose}"
        assert quality_rules.clean_lines(f"{opening} today. {prose}") == (prose, 60, 60 + len(opening.split()) + 1)
        assert quality_rules.clean_lines(f"{opening} today.")[0] == ""


def test_rule_edges(spark, odd):
    assert quality_rules.judge(odd).count() == odd.count() and quality_rules.judge(nothing(spark)).count() == 0
    kept = quality_rules.clean(odd)
    assert kept.columns == odd.columns and quality_rules.clean(nothing(spark)).count() == 0
    assert all(r.n_chars == len(r.text) for r in kept.collect())


# --- 6: mixing -----------------------------------------------------------------------------


def test_targets_match_resharing_by_hand(spark):
    rows = [(i, "w " * n, None, s, None) for i, (s, n) in enumerate([("a", 10), ("b", 1), ("b", 2), ("c", 500), ("d", 3), (None, 40), (None, 2)])]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    size = {"a": 10, "b": 3, "c": 500, "d": 3, None: 42}
    weight = {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}
    total, open_, target = sum(size.values()), dict(weight), {}
    while True:
        rest = total - sum(target.values())
        share = {s: rest * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in share if share[s] > 3 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * size[s]
            del open_[s]
    assert {r.source: round(r.target, 6) for r in got} == {s: round(t, 6) for s, t in target.items()}
    assert all(r.taken <= 3 * r.size and len(r.positions) * r.size == r.taken for r in got)


@HAS_DATA
def test_mix_matches_its_sql_and_comes_near_targets(spark):
    got = queries.op6_mixing(spark, str(SF)).toPandas()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = c.execute(queries.oracle_sql()["op6_mixing"]).df()
    for df in (got, want):
        df.sort_values("doc_id", inplace=True, ignore_index=True)
    for name in ("doc_id", "size", "source_size", "taken"):
        assert got[name].tolist() == want[name].tolist(), name
    assert np.allclose(got.target, want.target) and np.allclose(got.position.astype(float), want.position.astype(float), equal_nan=True)
    source = {r.doc_id: r.source for r in sample_docs(spark).collect()}
    for _, own in got.groupby(got.doc_id.map(source)):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= own["size"].max()


def test_positions_follow_the_schedule(spark):
    rows = [(i, "w " * 10, None, "a", None) for i in range(400)]
    flat = mixing.mix(spark.createDataFrame(rows, DOCS), ramp=F.lit(0.0), range_rows=7).select(F.explode("positions").alias("t")).toPandas().t
    late = mixing.mix(spark.createDataFrame(rows, DOCS), ramp=F.lit(1.0), range_rows=7).select(F.explode("positions").alias("t")).toPandas().t
    assert np.allclose(np.sort(flat), (np.arange(400) + 0.5) / 400) and np.allclose(np.sort(late) ** 2, (np.arange(400) + 0.5) / 400)


def test_mix_edges(spark, odd):
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(nothing(spark)).count() == 0
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    again = [sorted(map(str, mixing.mixed_documents(odd).collect())) for _ in range(2)]
    assert again[0] == again[1]


# --- 7: token counts -----------------------------------------------------------------------


@HAS_DATA
def test_ids_are_those_of_the_tokenizers_library(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    slow, fast = Tokenizer.from_file(path), tokens.encoder(path)
    texts = [r.text for r in sample_docs(spark).collect()] + [t for t in ODD_TEXTS if t] + ["a<|endoftext|>b", "  \n\n \t x  ", "'s 'll I'VE", "١٢٣ ²½", " \u0000�", "é ﬁ", "  　 x", "x" * 20_000]
    for text in texts:
        assert fast(text) == slow.encode(text, add_special_tokens=False).ids, text[:80]


@HAS_DATA
def test_histogram_matches_brute_force(spark, odd):
    encode = tokens.encoder(queries.tokenizer_path())
    for docs in (sample_docs(spark), odd):
        lengths = [len(encode(r.text)) if r.text else 0 for r in docs.collect()]
        histogram = tokens.length_histogram(docs, queries.tokenizer_path())
        for r in histogram.collect():
            n = r.n_tokens
            assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == (lengths.count(n), sum(x >= n for x in lengths), sum(x for x in lengths if x >= n))
            assert r.tokens_truncated == sum(min(x, n) for x in lengths) and math.isclose(r.share_below, sum(x < n for x in lengths) / len(lengths))
        asked = {r.context_limit: (r.docs_at_least, r.tokens_truncated) for r in tokens.answer_limits(histogram, [1, 7, 100, 10**6]).collect()}
        assert asked == {n: (sum(x >= n for x in lengths), sum(min(x, n) for x in lengths)) for n in asked} and len(asked) == 4
    assert tokens.length_histogram(nothing(spark), queries.tokenizer_path()).count() == 0


# --- 8: main text --------------------------------------------------------------------------


def test_field_labels_other_pages_of_the_same_layouts():
    model, wrong, total = html_crf.default_field(), 0, 0
    for found, want in html_crf.labelled_pages(150, seed=77):
        got = model.label(found)
        wrong, total = wrong + sum(a != b for a, b in zip(got, want)), total + len(want)
    assert wrong < 0.02 * total


def test_viterbi_matches_brute_force():
    from itertools import product

    r = np.random.default_rng(5)
    model = html_crf.Field(r.normal(size=1 << html_crf.BITS), r.normal(size=(2, 2)), r.normal(size=2))
    for n in range(1, 8):
        found = [html_crf.Leaf(f"text {i} here.", 0, frozenset({f"m{i}"}), "p") for i in range(n)]
        emit = [model.weights[f].sum() for f in html_crf.page_features(found)]
        value = lambda y: model.ends[y[0]] + sum(e for e, z in zip(emit, y) if z) + sum(model.pairs[a, b] for a, b in zip(y, y[1:]))
        best = max(product((0, 1), repeat=n), key=value)
        assert tuple(map(int, model.label(found))) == best


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href=/a>Menu</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy it.</div>
<article><h1>Title &amp; more</h1><p><b>First   one.<br><p>Second\n one &lt;x&gt;.</p><p>Third.</p></article><footer>&copy; x &middot; Words here."""


def test_blocks_close_over_any_number_of_open_inline_tags():
    for n in (10, 62, 63, 64, 500):
        page = "<article><nav>" + "<a href=x><b>Menu" * n + "</nav><p>Body." + "<i>" * n + "<p>More." + "</article><table><tr><td>One" + "<u>" * n + "<td>Two</table><div>End"
        menu, body, more, one, two, end = html_crf.leaves(page)
        assert menu.marks >= {"article", "nav"} and (body.marks, more.marks) == ({"article", "p"}, {"article", "p"}), n
        assert (one.marks, two.marks, end.marks) == ({"table", "tr", "td"}, {"table", "tr", "td"}, {"div"}), n
        assert [x.tag for x in (body, more, one, two, end)] == ["p", "p", "td", "td", "div"] and body.linked == 0


def test_main_text_of_a_page(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p>" * 500 + "a < b & c"), (5, "u", "<" * 50), (5, "u", PAGE + "<scr"), (6, "u", "<script>never closed")]
    got = {(r.page_id, i): (r.text, r.n_chars) for i, r in enumerate(html_crf.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("own")).coalesce(1)).collect())}
    want = "Title & more\nFirst one.\nSecond one <x>.\nThird."
    assert got[1, 0] == (want, len(want)) and got[2, 1] == ("", 0) == got[3, 2] == got[6, 6] and got[5, 5][0] == want
    assert html_crf.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


LINE = "The river rose again last night and the old bridge held, though the mayor had closed it since Tuesday morning."


def main_text(page):
    found = html_crf.leaves(page)
    return "\n".join(b.text for b, y in zip(found, html_crf.default_field().label(found)) if y)


@pytest.mark.parametrize(("page", "want"), [
    # Hand-written pages in layouts and states that labelled_pages does not write.
    (f"<article><p><a href=x title=it's>Tom</a> met us. Bob's here.</p><p>{LINE}</p></article>", f"Tom met us. Bob's here.\n{LINE}"),
    (f'<article><p>{LINE}</p><p>See <a href="x>the report</a> now and go on reading it.</p></article>', f"{LINE}\nSee the report now and go on reading it."),
    (f"<article><p>{LINE}</p><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds here and everywhere else.</p></article>", f"{LINE}\nSo x=2 holds here and everywhere else."),
    (f"<article><p>{LINE}</p><p>A &<b></b>amp; B stand here in a long line of words.</p></article>", f"{LINE}\nA &amp; B stand here in a long line of words."),
    ("<aside>" + "<span>" * 70 + "Buy now" + "</aside>" + f"<article><h1>Title</h1><p>{LINE}</p></article>", f"Title\n{LINE}"),
    (f'<div class="row"><div class="col-md-12"><a href=/>Home</a> <a href=/n>News</a></div></div><div class="row"><div class="col-md-8"><h1>River rises</h1><p>{LINE} {LINE}</p><p>{LINE}</p></div><div class="col-md-4"><h4>More</h4><ul><li><a href=1>Bridge shut</a><li><a href=2>Rain falls</a></ul></div></div><div class="row"><p>&copy; 2024 Paper.</p></div>', f"River rises\n{LINE} {LINE}\n{LINE}"),
    (f"<div><a href=1>A</a> <a href=2>B</a></div><div><h1>Title here</h1><p>{LINE} {LINE}<p>{LINE}</div><div>© x</div>", f"Title here\n{LINE} {LINE}\n{LINE}"),
    (f"<table width=100%><tr><td width=20%><a href=a>Start</a><br><a href=b>Archive</a><td><h2>River rises</h2><p>{LINE} {LINE}<p>{LINE}</table>", f"River rises\n{LINE} {LINE}\n{LINE}"),
])
def test_pages_of_other_layouts(page, want):
    assert main_text(page) == want


ONE = "Prose runs on for a good while here, with commas and a full stop. It says something of its own."
TWO = "Another paragraph follows the first one and adds a few more facts to it. It ends here."
KANA = "これは日本語の記事です。空白のない文が続きます。読者はこの文章を最後まで読むでしょう。"
MORE_KANA = "次の段落も同じように続きます。文字だけで区切りはありません。終わりです。"
HAN_TITLE = "見出し"


@pytest.mark.parametrize(("page", "want"), [
    # One paragraph, alone and with a menu and a footer.
    (f"<article><p>{ONE}</p></article>", ONE),
    (f"<html><body><p>{ONE}</p></body></html>", ONE),
    (f"<main><p>{ONE}</p></main>", ONE),
    (f"<nav><ul><li><a href=/>Home</a><li><a href=/a>About</a></ul></nav><article><p>{ONE}</p></article><footer>© 2024 Site</footer>", ONE),
    # Scripts without spaces.
    (f"<div class=content><p>{KANA}</p><p>{MORE_KANA}</p></div>", f"{KANA}\n{MORE_KANA}"),
    (f"<article><p>{KANA}</p><p>{MORE_KANA}</p></article>", f"{KANA}\n{MORE_KANA}"),
    (f"<nav><ul><li><a href=/>ホーム</a><li><a href=/a>会社概要</a></ul></nav><article><h1>{HAN_TITLE}</h1><p>{KANA}</p><p>{MORE_KANA}</p></article><footer>© 2024 会社</footer>", f"{HAN_TITLE}\n{KANA}\n{MORE_KANA}"),
    # Columns side by side.
    (f"<div class=row><div class=col><p>{ONE}</p></div><div class=col><p>{TWO}</p></div></div>", f"{ONE}\n{TWO}"),
    (f"<article><div class=row><div class=col><p>{ONE}</p></div><div class=col><p>{TWO}</p></div></div></article>", f"{ONE}\n{TWO}"),
    (f"<nav><a href=/>x</a></nav><div class=content><div class=left><p>{ONE} {ONE}</p></div><div class=right><p>{TWO}</p></div></div><footer>© x</footer>", f"{ONE} {ONE}\n{TWO}"),
    # What a text area holds is a form's, whatever tags it shows.
    (f"<article><p>{ONE}</p><p>{TWO}</p><textarea><p>form text that is long enough to be prose, really.</textarea></article>", f"{ONE}\n{TWO}"),
    (f"<article><p>{ONE}</p></article><form><textarea/><p>form text that is long enough to be prose, really.</p></textarea></form>", ONE),
])
def test_short_pages_other_scripts_columns_and_forms(page, want):
    assert main_text(page) == want


@HAS_DATA
def test_main_text_matches_the_article_element(spark):
    import html as h

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op8_main_text(spark, str(SF)).collect():
        inside = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        parts = [" ".join(h.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert r.text == "\n".join(p for p in parts if p)


# --- 9: packing ----------------------------------------------------------------------------


def naive_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(5))
def test_packing_matches_naive_best_fit(seed):
    r = np.random.default_rng(seed)
    capacity = int(r.choice([7, 64, 100, 1024]))
    lengths = r.integers(1, capacity + 1, 400)
    sequence, offset = packing.best_fit_decreasing(lengths, capacity)
    assert len(set(sequence)) == naive_best_fit(lengths.tolist(), capacity)
    for s in set(sequence):
        own = sorted((offset[i], lengths[i]) for i in np.flatnonzero(sequence == s))
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= capacity


def test_room_tree_finds_the_tightest():
    r = random.Random(3)
    tree, held = packing.RoomTree(37), Counter()
    for _ in range(3000):
        room = r.randrange(1, 38)
        if held[room] and r.random() < 0.5:
            tree.add(room, -1)
            held[room] -= 1
        else:
            tree.add(room, 1)
            held[room] += 1
        least = r.randrange(1, 38)
        assert tree.tightest(least) == min((x for x, n in held.items() if n and x >= least), default=-1)


@HAS_DATA
def test_pack_round_trip(spark, odd):
    encode, path = tokens.encoder(queries.tokenizer_path()), queries.tokenizer_path()
    docs = {r.doc_id: r.text for r in sample_docs(spark).collect()}
    for group_docs in (30, 10_000):
        rows = packing.pack(sample_docs(spark), path, group_docs=group_docs).toPandas()
        total = 0
        for doc_id, own in rows.groupby("doc_id"):
            ids, own = np.array([*encode(docs[doc_id]), 2], "<u4"), own.sort_values("piece")
            total += len(ids)
            assert own.piece.tolist() == list(range(len(own))) and own.start.tolist() == [0, *own.length.cumsum()[:-1]] and own.length.sum() == len(ids)
            assert own.length[1:].eq(1024).all() if len(own) > 1 else len(ids) <= 1024
            assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length)] == own.ids_crc32.tolist()
        for _, own in rows.groupby("sequence_id"):
            own = own.sort_values("offset")
            assert own.offset.tolist() == [0, *own.length.cumsum()[:-1]] and own.length.sum() <= 1024
        assert set(rows.doc_id) == set(docs) and rows.sequence_id.nunique() <= 1.1 * total / 1024 + 8
    edges = packing.pack(odd, path)
    assert {r.length for r in edges.where("doc_id = 0").collect()} == {1} and edges.select("doc_id").distinct().count() == len(ODD_TEXTS) + 1
    assert packing.pack(nothing(spark), path).count() == 0


# --- 10: quality classifier ----------------------------------------------------------------


@HAS_DATA
def test_classifier_on_held_out_labels(spark):
    sf = str(SF.parent / "sf0.01") if (SF.parent / "sf0.01").exists() else str(SF)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op10_quality_net(spark, sf).join(labels, "doc_id").where("held_out AND quality IS NOT NULL").toPandas()
    good, bad = got.score[got.quality == 1].to_numpy(), got.score[got.quality == 0].to_numpy()
    area = (good[:, None] > bad[None, :]).mean()
    assert area > 0.95 and ((got.score >= 0.5) == got.predicted).all() and got.score.between(0, 1).all()


def test_pooling_matches_brute_force():
    vocabulary = {w: i for i, w in enumerate([*quality_net.SHAPES, "the", "cat", "~."])}
    vectors = np.random.default_rng(0).normal(size=(len(vocabulary), 5)).astype(np.float32)
    model = quality_net.QualityModel(vocabulary, vectors)
    text = "the cat. DOG the 12 , Äb xY"
    cores = [vocabulary[x] for x in ("the", "cat", "<upper>", "the", "<digits>", "<none>", "<title>", "<mixed>")]
    tails = [vocabulary[x] for x in ("<none>", "~.", *["<none>"] * 6)]
    v = vectors.astype(float)
    want = np.concatenate([v[cores].mean(0), v[tails].mean(0), (v[cores][1:] * v[cores][:-1]).sum(0) / 8])
    assert np.allclose(model.pool([text], quality_net.Numbering(vocabulary))[0, :-2], want, atol=1e-5)
    old = quality_net._WORDS_A_SLICE
    quality_net._WORDS_A_SLICE = 3
    try:
        assert np.allclose(model.pool([text], quality_net.Numbering(vocabulary))[0, :-2], want, atol=1e-5)
    finally:
        quality_net._WORDS_A_SLICE = old


def test_classifier_edges(spark, odd):
    labels = spark.createDataFrame([(6, 1), (7, 0), (8, None), (99, 1), (None, 1)], "doc_id long, quality int")
    for some in (labels, labels.where("quality = 1"), labels.where("false")):
        got = quality_net.score(odd, quality_net.fit(odd, some, F.lit(True))).toPandas()
        assert len(got) == odd.count() and got.score.between(0, 1).all() and got.score.notna().all()
    assert quality_net.score(nothing(spark), quality_net.fit(nothing(spark), labels, F.lit(True))).count() == 0


# --- texts of tens of millions of characters -------------------------------------------------


@pytest.fixture(scope="module")
def very_long():
    return "The quick brown fox, number 12, met jane at example dot com. " * 350_000


def test_very_long_texts_fingerprints(very_long):
    n = len(very_long)
    assert n > 20_000_000
    assert simhash.fingerprint(very_long) == simhash.fingerprint(very_long[:-1]) and digest.digest(very_long.encode())[:2] == f"{digest.length_code(n):02x}"
    assert len(near_copies.shingles(very_long)) < 20


def test_very_long_texts_rules_and_pii(very_long):
    got = quality_rules.examine(very_long)
    assert got.n_words == 12 * 350_000 and got.base_failed and not got.kept
    assert len(pii.find(very_long)[1]["email"]) == 350_000


def test_very_long_texts_models(very_long):
    model = quality_net.QualityModel({w: i for i, w in enumerate([*quality_net.SHAPES, "fox"])}, np.ones((7, 4), np.float32))
    x = model.pool([very_long, very_long[:61]], quality_net.Numbering(model.vocabulary))
    assert np.allclose(x[0, :8], x[1, :8], atol=1e-3)
    found = html_crf.leaves(f"<article><p>{very_long}</p></article><p>End")
    assert [len(b.text) for b in found] == [len(very_long) - 1, 3]
    assert len(html_crf.leaves("<div><p>x" * 300_000)) == 300_000


def test_very_long_texts_tokens_and_mixing(spark, very_long):
    encode = tokens.encoder(queries.tokenizer_path())
    docs = spark.createDataFrame([(1, very_long, None, "s", None)], DOCS)
    assert tokens.length_histogram(docs, queries.tokenizer_path()).first().n_tokens == len(encode(very_long))
    assert mixing.mix(docs).first().size == 12 * 350_000
    packed = packing.pack(docs, queries.tokenizer_path()).agg(F.sum("length"), F.max("length")).first()
    assert tuple(packed) == (len(encode(very_long)) + 1, 1024)


# --- the pipeline --------------------------------------------------------------------------


def brute_alike(a, b):
    a, b = ({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (words_of(t.lower()) for t in (a, b)))
    return 10 * len(a & b) >= 8 * len(a | b)


@pytest.mark.parametrize("block", [4, 1000])
def test_near_copies_match_brute_force(spark, block):
    random_ = random.Random(block)
    texts = []
    for k in range(12):
        base = [f"w{random_.randrange(5000)}" for _ in range(random_.choice([3, 8, 60, 150]))]
        for edits in (0, 0, 1, 1, 2, 4, 6):
            edited = list(base)
            for _ in range(edits):
                edited[random_.randrange(len(edited))] = f"new{random_.randrange(5000)}"
            texts.append(" ".join(edited))
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if up[i] != up[j] and brute_alike(texts[i], texts[j]):
                up = [up[j] if x == up[i] else x for x in up]
    want = {i: up.index(up[i]) for i in range(len(texts))}
    got = near_copies.mark(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=block)
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_pipeline_drops_edited_copies(spark):
    import corpus_pipeline as p

    words = [f"w{i}" for i in range(200)]
    edited = [*words[:70], "x", *words[71:150], "y", *words[151:]]
    other = [f"v{i}" if i % 9 == 0 else w for i, w in enumerate(words)]
    texts = [" ".join(t) for t in (words, edited, other)]
    assert (brute_fingerprint(texts[0]) ^ brute_fingerprint(texts[1])).bit_count() > 2
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    assert {r.doc_id for r in p.near_duplicates(spark, docs, "").collect()} == {0, 2}


def test_pipeline_links_by_fingerprints(spark, monkeypatch):
    """Without any min-hash bucket the stage still links what SimHash does, if it is alike enough."""
    import corpus_pipeline as p

    monkeypatch.setattr(near_copies, "bands", lambda own: np.zeros(0, np.int64))
    words = [f"w{i}" for i in range(2000)]
    often, near = [f"v{i}" for i in range(40)] * 50, words[:]
    near[1000] = "x"
    texts = [" ".join(t) for t in (words, near, [*often, *"abcdefghijklmnopqrstuvwxyz"], [*often, *"zyxwvutsrqponmlkjihgfedcba"], [*often, *"abcdefghijklmnopqrstuvwxyz"])]
    prints = [brute_fingerprint(t) for t in texts]
    assert (prints[0] ^ prints[1]).bit_count() <= 2 and (prints[2] ^ prints[3]).bit_count() <= 2
    assert brute_alike(texts[0], texts[1]) and not brute_alike(texts[2], texts[3])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    assert {r.doc_id for r in p.near_duplicates(spark, docs, "").collect()} == {0, 2, 3}


def test_near_copies_edges(spark, odd):
    got = {(r.doc_id, r.component_id) for r in near_copies.mark(odd).collect()}
    assert {(0, 0), (1, 0), (2, 0), (3, 0), (6, 6), (10, 6), (None, None)} <= got
    assert near_copies.mark(odd).count() == odd.count() and near_copies.mark(nothing(spark)).count() == 0


@HAS_DATA
def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = sample_docs(spark)
    names = docs.columns
    kept = p.rules(spark, docs, str(SF)).toPandas()
    want = {r.doc_id: quality_rules.clean_lines(r.text)[0] for r in docs.collect() if quality_rules.examine(r.text).kept}
    assert dict(zip(kept.doc_id, kept.text)) == want and list(kept.columns) == names
    stage2 = p.near_duplicates(spark, spark.createDataFrame(kept), str(SF)).toPandas()
    # The stage's rule: five-word shingles, similarity 0.8 or more.
    up = {i: i for i in want}
    for i in want:
        for j in want:
            if j < i and up[i] != up[j] and brute_alike(want[i], want[j]):
                up = {k: min(up[i], up[j]) if v in (up[i], up[j]) else v for k, v in up.items()}
    assert set(stage2.doc_id) == set(up.values())
    stage3 = p.personal_data(spark, spark.createDataFrame(stage2), str(SF)).toPandas()
    assert dict(zip(stage3.doc_id, stage3.text)) == {i: pii.mask(want[i]) for i in stage2.doc_id}
    stage4 = p.mixture(spark, spark.createDataFrame(stage3), str(SF)).toPandas()
    taken = mixing.mix(spark.createDataFrame(stage3)).toPandas()
    copies = {i: len(x) for i, x in zip(taken.doc_id, taken.positions) if len(x)}
    assert Counter(stage4.doc_id.tolist()) == Counter(copies) and list(stage4.columns) == names
    last = p.run(spark, str(SF)).toPandas()
    assert set(last.doc_id) == set(copies)
    encode = tokens.encoder(queries.tokenizer_path())
    texts = dict(zip(stage3.doc_id, stage3.text))
    assert last.length.sum() == sum((len(encode(texts[i])) + 1) * n for i, n in copies.items())
    assert last.groupby("position").doc_id.nunique().max() == 1 and last.groupby("doc_id").position.nunique().to_dict() == copies


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(None, "one two three four five " * 8, "en", "s", 3)] * 3 + [(i, " ".join(f"w{i}{j}" for j in range(40)), "en", None, None) for i in (7, 7, 8)] + [(9, "", None, None, None)]])
def test_pipeline_edges(spark, rows, tmp_path):
    """Empty tables, nulls, repeated rows, and an extra column whose name is used inside."""
    import corpus_pipeline as p

    spark.createDataFrame(rows, DOCS).withColumn("position", F.lit("own")).withColumn("__dedup_n", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = p.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {7, 8, None} and len({(r.doc_id, r.position) for r in got}) == len({r.position for r in got})
    assert bool(got) == (len(rows) > 1)


def test_packing_keeps_training_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_BITS", 5)
    docs = spark.createDataFrame([(i % 50, f"text {i % 50} " * (i % 7 + 1), None, None, None) for i in range(300)], DOCS).repartitionByRange(3, "doc_id")
    docs.write.parquet(f"{tmp_path}/d")
    files = spark.read.parquet(f"{tmp_path}/d")
    files = packing.with_file_positions(files)
    rows = packing.pack(files, queries.tokenizer_path(), position=F.col("position")).toPandas()
    assert rows.position.nunique() == 300 and len(rows) == 300
    first = rows.groupby(rows.position // 32).sequence_id.agg(["min", "max"]).sort_index()
    assert len(first) == 10
    assert (first["max"].to_numpy()[:-1] < first["min"].to_numpy()[1:]).all()
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum()[:-1]] and own.length.sum() <= 1024


def test_oracle_names_are_registered():
    assert set(queries.oracle_sql()) <= set(queries.queries()) and len(queries.queries()) == 13
    assert json.dumps(sorted(queries.queries()))
