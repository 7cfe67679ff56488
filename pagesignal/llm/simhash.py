"""SimHash near-duplicates: fingerprints linked at a small Hamming distance.

Fingerprint: 64 majority bits of the XXH64 values (seed 42) of the word shingles, repeats
included; bit i is 1 if set in over half of them.

Links: only distinct fingerprints are compared. A vantage-point tree is grown from a bounded
draw of them: each inner node holds a vantage fingerprint v and a radius t. By the triangle
inequality two fingerprints within ``reach`` differ by at most ``reach`` in their distance
to v, so a fingerprint goes to the inside shard if d <= t and to the outside shard if
d > t - reach; those in the overlap go to both. Every pair within reach meets in a
shard. Shards that the tree can't split (a dense cloud of near copies) are dealt out as
pairs of blocks. Each task finds its shard's links exactly, with the same tree in memory, and
gives a spanning forest of them rather than all pairs.

Components: the forests' edges are contracted by alternating large-star and small-star steps
on DataFrames, each step written to the shared folder.

Hot fingerprints: documents get their component by a join on the fingerprint. Fingerprints of more than
1/2000 of the rows, at most 2000 of them, are broadcast; only the others are shuffled. The same holds for
the links of a hub and the members of a large component.

Nulls and edges: a null or wordless text has fingerprint zero and is linked like any other.
A null doc_id is fingerprinted too; its component is the smallest doc_id that it reaches, or
null if it reaches none. Repeated rows come out as often as they came in. An empty table
gives an empty result. Other columns are not read, whatever their names. A text of tens of millions
of characters is hashed in slices of 100,000 shingles; what it needs besides its words is small. Ties can't
arise: components are named by their smallest doc_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, join_split, remove, small, texts_of, with_columns, written

SEED = 42


def fingerprint(text: str | None, width: int = 3) -> int:
    """64 majority bits of the hashed shingles of ``width`` words."""
    # Splitting bytes at white space takes space and tab to carriage return, and lower() only A-Z.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[:n].tolist(), ends[-n:].tolist())
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    while len(h := np.fromiter((digest(joined[a:b], SEED) for a, b in islice(spans, 100_000)), np.uint64)):
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) for every row of ``docs(doc_id, text)``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            fp = np.array([fingerprint(t, width) for t in texts_of(batch)], np.uint64).view(np.int64)
            yield with_columns(batch, ["doc_id"], fp=pa.array(fp))

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


@dataclass(frozen=True)
class Node:
    """An inner node has a vantage point, a leaf a number and how many blocks it is dealt into."""

    vantage: int = 0
    radius: int = 0
    inside: Node | None = None
    outside: Node | None = None
    leaf: int = -1
    blocks: int = 1


def distances(x: np.ndarray, v: int) -> np.ndarray:
    return np.bitwise_count(x ^ np.uint64(v)).astype(np.int16)


def choose_split(x: np.ndarray, reach: int, random: np.random.Generator) -> tuple[int, int, np.ndarray, np.ndarray] | None:
    """The vantage point and radius, of a few tried, that leave the smallest larger side; None if none helps."""
    best = None
    for v in random.choice(x, min(4, len(x)), replace=False):
        d = distances(x, v)
        upto = np.concatenate([np.zeros(reach, np.int64), np.cumsum(np.bincount(d, minlength=65))])
        inside, outside = upto[reach:], len(x) - upto[: 65]
        cost = np.maximum(inside, outside) + (inside + outside) / 4
        t = int(cost.argmin())
        if max(inside[t], outside[t]) < 0.9 * len(x) and inside[t] + outside[t] < 1.7 * len(x) and (best is None or cost[t] < best[0]):
            best = cost[t], int(v), t, d
    return best and (best[1], best[2], best[3] <= best[2], best[3] > best[2] - reach)


def grow(sample: np.ndarray, weight: float, leaf_size: int, reach: int, least: int = 32) -> tuple[Node, int]:
    """A tree for shards of about ``leaf_size``; each of the sample stands for ``weight`` fingerprints."""
    random, leaves = np.random.default_rng(0), 0

    def node(x: np.ndarray, depth: int) -> Node:
        nonlocal leaves
        split = choose_split(x, reach, random) if len(x) * weight > leaf_size and len(x) >= 2 * least and depth < 40 else None
        if split is None:
            leaves += 1
            full = max(leaf_size, least * 2 * weight)
            return Node(leaf=leaves - 1, blocks=max(1, int(np.ceil(len(x) * weight / (4 * full)))))
        v, t, inside, outside = split
        return Node(v, t, node(x[inside], depth + 1), node(x[outside], depth + 1))

    return node(sample, 0), leaves


def route(x: np.ndarray, tree: Node, reach: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(leaf, blocks, positions)`` for every leaf that some of ``x`` belong to."""
    todo = [(tree, np.arange(len(x)))]
    while todo:
        at, own = todo.pop()
        if not len(own):
            continue
        if at.leaf >= 0:
            yield at.leaf, at.blocks, own
            continue
        d = distances(x[own], at.vantage)
        todo += [(at.inside, own[d <= at.radius]), (at.outside, own[d > at.radius - reach])]


class Forest:
    """Union-find over 0..n-1 that keeps the links that joined two trees."""

    def __init__(self, n: int) -> None:
        self.up, self.links = list(range(n)), []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[b] = a
            self.links.append((i, j))


def spanning_links(x: np.ndarray, reach: int, small: int = 384) -> list[tuple[int, int]]:
    """Positions ``(i, j)`` that link, exactly, all of ``x`` that are joined by steps of at most ``reach``."""
    forest, random, todo = Forest(len(x)), np.random.default_rng(1), [np.arange(len(x))]
    while todo:
        own = todo.pop()
        part = x[own]
        split = choose_split(part, reach, random) if len(own) > small else None
        if split:
            todo += [own[split[2]], own[split[3]]]
        elif len(own) <= small:
            i, j = np.nonzero(np.triu(np.bitwise_count(part[:, None] ^ part[None, :]) <= reach, 1))
            for a, b in zip(own[i].tolist(), own[j].tolist()):
                forest.link(a, b)
        else:
            # A dense cloud: walk it breadth first, each step against those not yet reached.
            left = own
            while len(left):
                queue, left = [left[0]], left[1:]
                while queue and len(left):
                    at = queue.pop()
                    near = distances(x[left], x[at]) <= reach
                    if near.any():
                        found = left[near]
                        left = left[~near]
                        queue.extend(found.tolist())
                        for b in found.tolist():
                            forest.link(int(at), b)
    return forest.links


def link_edges(nodes: DataFrame, *, reach: int = 2, leaf_size: int = 4000, sample_size: int = 262_144) -> DataFrame:
    """``a, b``: links between the distinct longs of ``nodes(fp)`` that span all that lie within reach.

    ``sample_size`` bounds the fingerprints drawn for the tree; the draw is at most a quarter
    of them, and none at all where one shard is enough. It decides only how the work is dealt out.
    """
    n = nodes.count()
    if n > leaf_size:
        drawn = nodes.select("fp").sample(min(0.25, sample_size / n, max(16_384, n // 200) / n), seed=7)
        sample = np.array([r.fp for r in drawn.collect()], np.int64).view(np.uint64)
        tree, _ = grow(np.sort(sample), n / max(1, len(sample)), leaf_size, reach)
    else:
        tree = Node(leaf=0)
    shared = nodes.sparkSession.sparkContext.broadcast(tree)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            shard, fp = [], []
            for leaf, blocks, own in route(x, shared.value, reach):
                of = (x[own] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % blocks
                for other in range(blocks):
                    low, high = np.minimum(of, other), np.maximum(of, other)
                    shard.append((np.int64(leaf) << np.int64(24)) + (low << np.int64(12)) + high)
                    fp.append(x[own])
            if fp:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shard)), pa.array(np.concatenate(fp).view(np.int64))], names=["shard", "fp"])

    def link(group: pa.Table) -> pa.Table:
        x = np.unique(group.column("fp").to_numpy()).view(np.uint64)
        ij = np.array(spanning_links(x, reach), np.int64).reshape(-1, 2)
        signed = x.view(np.int64)
        return pa.table({"a": signed[ij[:, 0]], "b": signed[ij[:, 1]]})

    dealt = nodes.select("fp").mapInArrow(deal, "shard long, fp long")
    return dealt.groupBy("shard").applyInArrow(link, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node that each node of ``edges(a, b)`` reaches; roots included.

    Large-star and small-star steps in turn until nothing changes, which takes about as many rounds as the
    logarithm of the longest chain. Each node's minimum is aggregated before the shuffle, and it goes to the links
    of a hub by broadcast, so a node with very many links is no single task's load. A round's table is deleted
    once the next one stands.
    """
    spark = edges.sparkSession

    def size(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def star(df: DataFrame, large: bool, links: int) -> DataFrame:
        both = df.select(F.col("a").alias("u"), F.col("b").alias("v")).union(df.select(F.col("b").alias("u"), F.col("a").alias("v")))
        seen = both if large else both.where("v < u")
        least = seen.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", "n", F.least("u", "m").alias("m"))
        moved = join_split(both.where("v > u") if large else seen, least, "u", 2 * links).select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not large:
            moved = moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    now, path = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = size(now)
    while before[0]:
        larger, middle = written(star(now, True, before[0]))
        after, next_path = written(star(larger, False, before[0]))
        remove(spark, path, middle)
        now, path, last = after, next_path, before
        before = size(now)
        if before == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def named_classes(nodes: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """``key, n, component_id`` of ``nodes(key, n, least)``: the smallest ``least`` in the component that ``roots`` puts it in."""
    linked = nodes.join(roots.withColumnRenamed("node", key), key)
    of_root = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = join_split(linked.select(key, "root"), of_root, "root", nodes.count()).select(key, "component_id")
    return nodes.join(named, key, "left").select(key, "n", F.coalesce("component_id", "least").alias("component_id"))


def class_leads(nodes: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """The ``key`` that stands for each component of ``nodes(key, least)``: that of the smallest ``least``, nulls last, ties by key."""
    rooted = nodes.join(roots.withColumnRenamed("node", key), key, "left").withColumn("root", F.coalesce("root", key))
    return rooted.groupBy("root").agg(F.min_by(key, F.struct(F.col("least").isNull(), "least", key)).alias(key)).select(key)


def fingerprint_links(docs: DataFrame, *, width: int = 3, reach: int = 2, leaf_size: int = 4000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``doc_id, fp`` for every row, ``fp, least, n`` for every different fingerprint, ``n`` its rows, and the roots of the linked ones."""
    prints = cut(fingerprints(docs, width))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    return prints, nodes, components(link_edges(nodes, reach=reach, leaf_size=leaf_size))


def shared_classes(rows: DataFrame, **options) -> DataFrame:
    """Those of ``rows(fp, ...)`` whose fingerprint other rows have or link to, with their ``class``: the smallest fingerprint that theirs reaches."""
    prints = cut(rows.groupBy("fp").agg(F.count("*").alias("n")))
    roots = components(link_edges(prints, **options)).withColumnRenamed("node", "fp")
    shared = prints.join(roots, "fp", "left").where("n > 1 OR root IS NOT NULL").select("fp", "n", F.coalesce("root", "fp").alias("class"))
    return join_split(rows, cut(shared), "fp", rows.count())


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs(doc_id, text)``."""
    prints, nodes, roots = fingerprint_links(docs, **options)
    found = join_split(prints, cut(named_classes(nodes, roots, "fp")), "fp", prints.count())
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, **options) -> DataFrame:
    """The text, as ``node``, that stands for each group of linked fingerprints: of its smallest doc_id (nulls last) the one of the smallest hash."""
    row = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", F.xxhash64("text").alias("node"))
    _, nodes, roots = fingerprint_links(docs.select("text", row.alias("doc_id")), **options)
    return class_leads(nodes, roots, "fp").join(nodes, "fp").select(F.col("least.node").alias("node"))


def keep_one(docs: DataFrame, choose: Callable[..., DataFrame] = representatives, **options) -> DataFrame:
    """One row for each group of near copies in ``docs(doc_id, text)``, all columns as they were.

    ``choose`` gives the texts that stand for the groups, as ``node``: ``xxhash64`` of each. Of the rows with such a text
    the one with the smallest doc_id (nulls last) stays. So each group keeps a row, whether or not rows share a doc_id or have none, and
    only copies go. Columns of any name pass through. Repeated rows are thinned out before the shuffle, so a text that many rows
    share is no single task's load; the texts are shuffled once.
    """
    names = docs.columns
    wanted = choose(docs.select("doc_id", "text"), **options).select("node")
    number, node = fresh(names, "__dedup_n"), fresh(names, "__dedup_node")
    ties = F.xxhash64(*[c for c in names if c not in ("doc_id", "text")], F.lit(0))
    order = Window.partitionBy(node).orderBy(F.col("doc_id").asc_nulls_last(), F.col("text"), ties)
    first = docs.withColumn(node, F.xxhash64("text")).withColumn(number, F.row_number().over(order)).where(F.col(number) == 1)
    return first.join(wanted.withColumnRenamed("node", node), node, "left_semi").select(*names)
