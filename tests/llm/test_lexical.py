"""Lexical search against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagesignal.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, k=50):
    own = [(d, Counter(terms_of(t))) for d, t in docs]
    own = [(d, c, sum(c.values())) for d, c in own if c]
    n_docs, total = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms_of(text))
    rows = []
    for item, terms in asked.items():
        found = []
        for d, c, n in own:
            m = 50 + (50 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0))
        rows += [(item, i + 1, None if missing else d, -s) for i, (s, missing, d) in enumerate(sorted(found)[:k])]
    return sorted(rows, key=str)


def searched(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "terms", "tfs", "rank", "score", "item_id")})
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("doc_id", "score", "q")})
    return sorted(map(tuple, lexical.search(d, i, **options).collect()), key=str)


def test_terms_match_the_pattern():
    for text in [None, "", " ", "a_b C-3 É x y ß", "\x00a\x7fb~c", "".join(map(chr, range(1, 700)))]:
        assert [w.decode() for w in lexical.words(None if text is None else text.encode())] == terms_of(text)


@pytest.mark.parametrize("k", [1, 7, 50])
def test_search_matches_brute_force_with_ties(spark, k):
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(vocabulary, [1 / (j + 1) for j in range(60)], k=rng.choice([1, 3, 10, 40])))) for i in range(900)]
    docs += [(1000 + i, "w3 w9 w9") for i in range(200)]  # a tie longer than k
    docs += [(5, "w3"), (5, "w3"), (None, "w3 w9 w9"), (2000, None), (2001, ""), (2002, "--"), (2003, "w1 " * 30_000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=6))) for i in range(12)] + [(3, "W3 w9 W9"), (None, "w0 w1"), (50, None), (51, "unknown"), (52, "")]
    assert searched(spark, docs, items, k=k) == brute(docs, items, k)


def test_blocks_of_items_and_empty_tables(spark):
    docs = [(i, f"a b{i % 3} c{i % 7}") for i in range(50)]
    items = [(i, f"a c{i}") for i in range(9)]
    assert searched(spark, docs, items, block_items=2) == searched(spark, docs, items, block_bytes=5) == brute(docs, items)
    assert searched(spark, [], items) == searched(spark, docs, []) == searched(spark, [(1, None)], items) == []


def test_small_shards_keep_the_best_of_all_and_skip_ranges():
    rng = np.random.default_rng(3)
    n, n_terms = 5000, 12
    sizes = rng.integers(0, 5, n)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    terms = np.concatenate([rng.choice(n_terms, s, False) for s in sizes]).astype(np.int32)
    impact = rng.zipf(1.5, len(terms)).clip(max=10**6).astype(np.int64)
    asked, weights = np.array([1, 4, 7]), np.array([5, 3, 2])
    by_term = np.zeros(n_terms)
    by_term[asked] = weights
    every = [(-int(sum(by_term[terms[j]] * impact[j] for j in range(ends[i], ends[i + 1]))), False, i) for i in range(n)]
    want = sorted(x for x in every if x[0] < 0)[:10]
    held = []
    opened = lexical.search_shard(lexical.MaxTree(ends, terms, impact, n_terms), list(range(n)), asked, weights, by_term, held, 10)
    assert held == want and opened < -(-n // lexical.LEAF)
    held = []
    for a in range(0, n, 700):
        b = min(n, a + 700)
        lexical.search_shard(lexical.MaxTree(ends[a : b + 1] - ends[a], terms[ends[a] : ends[b]], impact[ends[a] : ends[b]], n_terms), list(range(a, b)), asked, weights, by_term, held, 10)
    assert held == want
