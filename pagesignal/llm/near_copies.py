"""Near copies: different texts that share most of their five-word shingles.

Rule: two texts are linked if the Jaccard similarity of their sets of five-word shingles
(64-bit hashes, ASCII letters lower-cased) is 0.8 or more. Groups are the components of the links.

Candidates: first the classes of ``simhash``, each a bucket: texts whose fingerprints link at 2 or fewer bits.
Pairs at 0.8 differ by up to a dozen bits, a reach at which no vantage-point tree parts the fingerprints, so
the others come from 64 minima of hashed shingles in 16 bands of four; texts that agree on a band share
a bucket. A pair at similarity s shares none with probability (1 - s^4)^16: 2 in 10,000 at 0.8,
fewer above. Buckets with the same members are taken once.

Links: each bucket's texts bring their shingles to one task, which walks them breadth first and
checks each link exactly. Buckets of many texts, or of long ones, are dealt out as pairs of blocks.
No bucket, member or candidate is left out.

Nulls and edges: texts of fewer than five words are one shingle; null and wordless texts are
copies of each other. Copies are one node, so they are never paired up. A null doc_id is treated as
in ``simhash.near_duplicates``. Repeated rows come out as often as they came in; an empty table gives an empty
result; columns but ``doc_id`` and ``text`` are not read. A very long text is one array of its distinct shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_split, remove, small, texts_of, with_columns, written
from .simhash import SEED, class_leads, components, fingerprint, named_classes, shared_classes

BANDS, ROWS, WIDTH = 16, 4, 5
_random = np.random.default_rng(SEED)
_TIMES = _random.integers(0, 1 << 31, (BANDS * ROWS, 1), np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _random.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of the text's five-word shingles, in order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined, n = b" ".join(words), max(1, len(words) - WIDTH + 1)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[-n:] or [0])), np.uint64, n))


def bands(own: np.ndarray) -> np.ndarray:
    """The bucket of a set of shingles in each band."""
    x, least = (own ^ own >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(least, (x[None, at : at + 1024] * _TIMES + _PLUS).min(1), out=least)
    raw = least.tobytes()
    return np.array([xxhash.xxh64_intdigest(raw[k * 4 * ROWS : (k + 1) * 4 * ROWS], k) for k in range(BANDS)], np.uint64).view(np.int64)


def alike_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Positions ``(i, j)`` that span all of ``sets`` joined by steps of similarity 0.8 or more."""
    sizes = np.array([len(s) for s in sets])
    different, values = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(values, np.cumsum(sizes)[:-1])
    mark, links, left = np.zeros(len(different), bool), [], np.arange(len(sets))
    kept, flat = left, values

    def near(i: int) -> np.ndarray:
        nonlocal kept, flat
        if 2 * len(left) < len(kept):
            kept, flat = left, np.concatenate([own[j] for j in left])
        mark[own[i]] = True
        # Differences of running sums count the marked shingles of each set.
        shared = np.add.reduceat(mark[flat].astype(np.int32), np.cumsum(sizes[kept]) - sizes[kept])
        mark[own[i]] = False
        return kept[9 * shared >= 4 * (sizes[i] + sizes[kept])]

    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            found = np.intersect1d(near(at), left, assume_unique=True)
            left = np.setdiff1d(left, found, assume_unique=True)
            queue.extend(found.tolist())
            links += [(int(at), j) for j in found.tolist()]
    return links


def link_edges(docs: DataFrame, nodes: DataFrame, drop: list[str], *, block: int = 300, block_shingles: int = 1_000_000) -> DataFrame:
    """``a, b``: links between ``nodes(node, n, fp, buckets, width)``, the different texts of ``docs(node, text)``.

    A bucket is dealt into so many blocks that each has about ``block`` texts and ``block_shingles`` shingles (``width`` is a text's number of them).
    Adds to ``drop`` the paths of tables that the links are read from; once the links are used up they may go.
    """
    alike, path = written(shared_classes(nodes.select("node", "width", "fp")).select("node", "width", F.xxhash64(F.lit("simhash"), "class").alias("bucket")))
    drop.append(path)
    members = alike.union(nodes.select("node", "width", F.explode("buckets").alias("bucket")))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("mix"), F.min("node").alias("least"), F.sum("width").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("n") / block, F.col("shingles") / block_shingles)).cast("int")
    different = sizes.where("n > 1").groupBy("n", "mix", "least").agg(F.min("bucket").alias("bucket"), F.max("shingles").alias("shingles")).select("bucket", "n", blocks.alias("blocks"))
    of = F.pmod(F.xxhash64("node"), F.col("blocks"))
    met = join_split(members, different, "bucket", (BANDS + 1) * nodes.count())
    dealt, path = written(met.select("bucket", "node", of.alias("of"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("bucket", "node", F.least("of", "other").alias("low"), F.greatest("of", "other").alias("high")))
    drop.append(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield with_columns(batch, ["node"], shingles=pa.array([shingles(t).view(np.int64) for t in texts_of(batch)], pa.list_(pa.int64())))

    def link(group: pa.Table) -> pa.Table:
        node, own = group.column("node").to_numpy(), group.column("shingles").combine_chunks()
        at = own.offsets.to_numpy()
        ij = np.array(alike_links(np.split(own.values.to_numpy(), at[1:-1])), np.int64).reshape(-1, 2)
        return pa.table({"a": node[ij[:, 0]], "b": node[ij[:, 1]]})

    # Only texts that share a bucket are sent, each once; copies of a text are thinned out where they lie.
    asked = dealt.select("node").distinct().join(nodes.select("node", "n"), "node").withColumn("__in", F.lit(True))
    few = asked.count() <= 1_000_000
    found = docs.join(F.broadcast(asked.select("node")), "node") if few else join_split(docs, asked, "node", nodes.agg(F.sum("n")).first()[0]).drop("__in")
    wanted = found.dropDuplicates(["node"])
    sets, path = written(wanted.select("node", "text").mapInArrow(run, "node long, shingles array<long>"))
    drop.append(path)
    return dealt.join(sets, "node").groupBy("bucket", "low", "high").applyInArrow(link, "a long, b long").distinct()


def copy_links(docs: DataFrame, *, block: int = 300) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``doc_id, node`` for every row, ``node, least, n`` for every different text, ``n`` its rows, and the roots of the linked ones."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = texts_of(batch)
            sets, fp = [shingles(t) for t in texts], np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield with_columns(batch, ["doc_id", "node"], fp=pa.array(fp), buckets=pa.array([bands(x) for x in sets], pa.list_(pa.int64())), width=pa.array([len(x) for x in sets], pa.int64()))

    rows = cut(docs.mapInArrow(run, f"doc_id {kind}, node long, fp long, buckets array<long>, width long"))
    nodes = cut(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.min("fp").alias("fp"), F.min("buckets").alias("buckets"), F.min("width").alias("width")))
    drop: list[str] = []
    roots = components(link_edges(docs.select("node", "text"), nodes.select("node", "n", "fp", "buckets", "width"), drop, block=block))
    remove(docs.sparkSession, *drop)
    return rows.select("doc_id", "node"), nodes.select("node", "least", "n"), roots


def mark(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, component_id`` for every row of ``docs(doc_id, text)``."""
    rows, nodes, roots = copy_links(docs, **options)
    return join_split(rows, cut(named_classes(nodes, roots, "node")), "node", rows.count()).select("doc_id", "component_id")


def representatives(docs: DataFrame, **options) -> DataFrame:
    """The text, as ``node``, that stands for each group: that of the smallest doc_id (nulls last), ties by hash."""
    _, nodes, roots = copy_links(docs, **options)
    return class_leads(nodes, roots, "node")
