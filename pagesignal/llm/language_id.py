"""Language identification: multinomial naive Bayes over hashed character n-grams.

Fit: every labelled row may be drawn; a draw by a hash of its id keeps about ``per_class``
rows of each label, so the fit costs the same at any corpus size. Spark counts hashed
bigrams and trigrams by label; the model is one table of log probabilities, buckets x
labels, whose size is fixed by the parameters, and is broadcast.

Score: each task looks up the rows of its texts' n-grams in that table and adds them up by
text in numpy. All text is read, in slices of bounded size.

Nulls and edges: a null text or one without a letter gives ``und`` with score 0. Rows with
a null label or null text are never learned from. With no learnable row every text is
``und``. Repeated rows are scored alike. Ties go to the first label by code point. Columns
other than those named in the call are not read.
A text of tens of millions of characters is scored in slices like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks_by_size, crc32_mod, small, texts_of, unit_hash, with_columns

UNKNOWN = "und"
#: The model's table has at most this power of two of cells.
MOST_CELLS_BITS = 24


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_ids(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed bigrams and trigrams of the lower-cased texts, and the number of the text of each.

    What is not a letter counts as a space; n-grams of spaces alone are left out.
    """
    low = [t.lower() for t in texts]
    sizes = np.fromiter(map(len, low), np.int64, len(low)) + 3
    # Two spaces around a text keep n-grams from crossing into the next one.
    points = np.frombuffer(("".join(f" {t}  " for t in low)).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[points]
    c = np.where(letter, points, 32).astype(np.uint32)
    doc = np.repeat(np.arange(len(low), dtype=np.int64), sizes)
    a, b, d = c[:-2], c[1:-1], c[2:]
    la, lb = letter[:-2], letter[1:-1]
    shift = np.uint32(32 - bits)
    with np.errstate(over="ignore"):
        two = (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77) + np.uint32(0x27D4EB2F)) * np.uint32(0xC2B2AE3D) >> shift
        three = ((a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)) * np.uint32(0x165667B1) + d * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F) >> shift
    has_two, has_three = la | lb, lb
    ids = np.concatenate([two[has_two], three[has_three]])
    of = np.concatenate([doc[:-2][has_two], doc[:-2][has_three]])
    return ids, of


@dataclass(frozen=True)
class LanguageModel:
    """Labels in code point order and the log probability of each bucket under each label."""

    labels: tuple[str, ...]
    log_p: np.ndarray
    bits: int
    evidence: int

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest label of each text and its probability.

        n-grams of one text are not independent, so no more than ``evidence`` of them
        count: the mean log probability is taken that many times at most.
        """
        k = len(self.labels)
        total, n = np.zeros((len(texts), max(1, k))), np.zeros(len(texts))
        for at, run in chunks_by_size(texts, max(20_000, min(400_000, 2_000_000 // max(1, k)))) if k else ():
            ids, of = gram_ids(run, self.bits)
            if len(ids):
                for j in range(k):
                    total[:, j] += np.bincount(np.asarray(at)[of], self.log_p[:, j][ids], len(texts))
                n += np.bincount(np.asarray(at)[of], minlength=len(texts))
        z = total / np.maximum(n, 1)[:, None] * np.minimum(n, self.evidence)[:, None]
        best = z.argmax(1)
        e = np.exp(z - z.max(1, keepdims=True))
        p = e[np.arange(len(texts)), best] / e.sum(1)
        seen = n > 0
        return [self.labels[b] if s else UNKNOWN for b, s in zip(best, seen)], np.where(seen, p, 0.0)


def drawn(rows: DataFrame, label: str, key: str, per_class: int) -> tuple[list, Column]:
    """The labels of ``rows``, and a condition that about ``per_class`` rows of each meet.

    Rows are drawn by a hash of ``key``. The number of labels is bounded (languages,
    classes); their counts come to the driver.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect() if r[0] is not None}
    rate = F.lit(0.0)
    for value, n in counts.items():
        rate = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, per_class / n))).otherwise(rate)
    return sorted(counts), unit_hash(F.lit("draw"), key) < rate


def fit(docs: DataFrame, train: Column, *, bits: int = 16, per_class: int = 4000, alpha: float = 0.1, evidence: int = 60) -> LanguageModel:
    """Fit on rows of ``docs(doc_id, text, lang)`` where ``train`` holds.

    ``per_class``: documented bound of the sample, about that many rows of each label.
    """
    learnable = docs.select("doc_id", "text", "lang").where(train & F.col("lang").isNotNull())
    labels, chosen = drawn(learnable.select("doc_id", "lang"), "lang", "doc_id", per_class)
    # The table is bounded: with more labels than 256 it has fewer buckets for each.
    bits = min(bits, max(8, MOST_CELLS_BITS - max(0, len(labels) - 1).bit_length()))
    # All tasks look for the sample; only then is it dealt to a few, as its size is bounded.
    rows = learnable.where(chosen & F.col("text").isNotNull()).select("lang", "text").repartition(16)
    size, number = 1 << bits, {x: i for i, x in enumerate(labels)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(number) * size, np.int64)
        for batch in small(batches):
            of_label = [number[x] for x in texts_of(batch, "lang")]
            for at, run in chunks_by_size(texts_of(batch), 400_000):
                ids, of = gram_ids(run, bits)
                key = np.asarray(of_label, np.int64)[np.asarray(at)[of]] * size + ids
                sums += np.bincount(key, minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], names=["k", "n"])

    got = rows.mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    n = np.zeros(len(labels) * size)
    # Bounded by labels x buckets, whatever the size of the corpus.
    pdf = got.toPandas()
    n[pdf["k"].to_numpy()] = pdf["n"].to_numpy()
    n = n.reshape(len(labels), size).T + alpha
    return LanguageModel(tuple(labels), np.log(n / n.sum(0)).astype(np.float32) if labels else np.zeros((size, 0), np.float32), bits, evidence)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``docs(doc_id, text)``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            names, p = shared.value.score(texts_of(batch))
            yield with_columns(batch, ["doc_id"], lang_pred=pa.array(names, pa.string()), score=pa.array(p, pa.float64()))

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def held_out(n: int, remainder: int) -> Column:
    return crc32_mod("doc_id", n) == remainder
