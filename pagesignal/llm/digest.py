"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

Digest: every window of three bytes of the UTF-8 text is hashed to one of 256 buckets. Each
bucket's code says in which quarter of the buckets, by count, its count lies (two bits);
two hex digits for the length on a log scale come first. The digest has 130 hex digits.

Likeness: 1 less the difference score over its bound. Codes that differ by 1, 2, 3 cost
1, 2, 6; lengths cost up to a fixed share. The result is from 0 to 1, and 1 for equal digests.

Nulls and edges: null and empty texts have the digest of no triplets (all codes zero, length
zero), as have texts of under three bytes but for the length. Two such digests have likeness 1.
Ties among counts share a code. Equal texts have equal digests. Rows of one doc_id follow each other by
text and lie in one range. Repeated rows come out each time; an empty table gives an empty result; other columns
are not read. A text of tens of millions of characters is counted in slices of a mebibyte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, texts_of

BUCKETS = 256
#: Fixed random permutations of a byte, one for each place in a triplet.
_PLACES = [np.random.default_rng(seed).permutation(256).astype(np.uint8) for seed in (11, 12, 13)]
#: What a pair of codes costs.
_COST = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]], np.uint8)
#: The difference at which two digests count as wholly unlike.
_BOUND = 1.5 * BUCKETS
_SLICE = 1 << 20


def counts(data: bytes) -> np.ndarray:
    """How often each bucket is hit by the byte triplets of ``data``."""
    total = np.zeros(BUCKETS, np.int64)
    b = np.frombuffer(data, np.uint8)
    for at in range(0, max(0, len(b) - 2), _SLICE):
        part = b[at : at + _SLICE + 2]
        hashed = _PLACES[0][part[:-2]] ^ _PLACES[1][part[1:-1]]
        # The odd step keeps the xor of the places from undoing itself on swapped bytes.
        hashed = hashed * np.uint8(29) ^ _PLACES[2][part[2:]]
        total += np.bincount(hashed, minlength=BUCKETS)
    return total


def length_code(n: int) -> int:
    return min(255, round(8 * np.log2(1 + n)))


def digest(data: bytes) -> str:
    n = counts(data)
    q = np.sort(n)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (n[:, None] > q[None, :]).sum(1).astype(np.uint8)
    packed = code[0::4] << 6 | code[1::4] << 4 | code[2::4] << 2 | code[3::4]
    return f"{length_code(len(data)):02x}{packed.tobytes().hex()}"


def _codes(text: str) -> np.ndarray:
    p = np.frombuffer(bytes.fromhex(text[2:]), np.uint8)
    return np.stack([p >> 6, p >> 4 & 3, p >> 2 & 3, p & 3], 1).ravel()


def likeness(a: str, b: str) -> float:
    """From 0 to 1; 1 for equal digests."""
    apart = int(_COST[_codes(a), _codes(b)].sum()) + min(32, abs(int(a[:2], 16) - int(b[:2], 16)))
    return max(0.0, 1.0 - apart / _BOUND)


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def cut_points(rows: DataFrame, range_bytes: int, fine: int) -> np.ndarray:
    """Ids, in descending order and negated, that part ``rows(doc_id, text)`` into ranges of about ``range_bytes`` of text.

    Two narrow passes: up to ``fine`` quantiles of the ids, then the bytes between them; neighbours are put together
    until a range is full. What comes to the driver is bounded by ``fine``, not by the rows.
    """
    tasks = max(2, min(fine, 16 * rows.rdd.getNumPartitions()))
    quantiles = sorted(set(rows.agg(F.percentile_approx("doc_id", [i / tasks for i in range(1, tasks)], 10 * tasks)).first()[0] or []), reverse=True)
    below = -np.array(quantiles, np.int64)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(below) + 1)
        for batch in batches:
            total += np.bincount(place_of(batch.column(0), below), batch.column(1).fill_null(0).to_numpy(zero_copy_only=False), len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], names=["k", "n"])

    held = {r.k: r.n for r in rows.select("doc_id", F.octet_length("text").cast("long").alias("n")).mapInArrow(weigh, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    kept, full = [], 0
    for k, at in enumerate(below):
        full += held.get(k, 0)
        if full >= range_bytes:
            kept.append(at)
            full = 0
    return np.array(kept, np.int64)


def place_of(ids: pa.Array, cuts: np.ndarray) -> np.ndarray:
    """The range of each id: ids from a cut upward come before it, nulls last."""
    known = np.asarray(ids.fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    return np.where(np.asarray(ids.is_null().to_numpy(zero_copy_only=False)), len(cuts), np.searchsorted(cuts, -known, "left"))


def with_next(docs: DataFrame, range_bytes: int, fine: int = 1 << 16) -> DataFrame:
    """The rows of ``docs(doc_id, text)`` sorted in ranges, each range followed by its neighbour's first row.

    Columns ``part, borrowed, doc_id, text``: in a part, rows come by descending doc_id (nulls
    last), ties by text (nulls last). Part i is partition i. The texts are shuffled once. What a part
    borrows is the row that follows its last one: the first of the next part that has rows, and for the
    last part the first row of all; of rows that share that id each task lends just the first.
    """
    rows = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    cuts = cut_points(rows, range_bytes, fine)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(place_of(batch.column(0), cuts).astype(np.int32)), batch.column(0)], names=["part", "doc_id"])

    tops = dict(tuple(r) for r in rows.select("doc_id").mapInArrow(top, f"part int, doc_id {kind}").groupBy("part").agg(F.max("doc_id")).collect())
    order = sorted(tops)
    number = {part: k for k, part in enumerate(order)}
    lender = {part: number[before] for part, before in zip(order, order[-1:] + order[:-1])}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lent: dict[int, tuple] = {}

        def rows_of(part: list[int], borrowed: bool, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([borrowed] * len(part)), ids, texts], names=["part", "borrowed", "doc_id", "text"])

        for batch in small(batches):
            part, ids = place_of(batch.column(0), cuts).tolist(), batch.column(0).to_pylist()
            for i, (p, x) in enumerate(zip(part, ids)):
                if x == tops[p]:
                    text = batch.column(1)[i].as_py()
                    own = text is None, text or "", x
                    lent[p] = min(lent.get(p, own), own, key=lambda r: r[:2])
            yield rows_of([number[p] for p in part], False, batch.column(0), batch.column(1))
        for p, (is_null, text, x) in lent.items():
            yield rows_of([lender[p]], True, pa.array([x], pa.int64()), pa.array([None if is_null else text], pa.string()))

    dealt = rows.mapInArrow(deal, f"part int, borrowed boolean, doc_id {kind}, text string")
    return dealt.repartitionById(max(1, len(tops)), "part").sortWithinPartitions("part", "borrowed", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_last())


def compare_with_edits(docs: DataFrame, range_bytes: int = 16 << 20) -> DataFrame:
    """Digest each row's text, its edited text and the next document's, and how alike they are.

    The next document is the one that follows by descending doc_id, after the last the first;
    rows of one doc_id follow each other by text. A lone row is its own next.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # a row that waits for the one after it
        out: list[tuple] = []
        for batch in small(batches):
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for part, borrowed, doc_id, text in zip(*columns):
                text = text or ""
                fp = None
                if held is not None:
                    own_id, own, own_fp = held
                    fp = digest(text.encode())
                    changed = edited(own, text).encode()
                    changed_fp = digest(changed)
                    out.append((own_id, len(own), hashlib.sha256(changed).hexdigest(), own_fp, changed_fp, likeness(own_fp, changed_fp), likeness(own_fp, fp)))
                # Only the first borrowed row of a part is anyone's next.
                held = None if borrowed else (doc_id, text, fp or digest(text.encode()))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)
            out = []

    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    return with_next(docs, range_bytes).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
