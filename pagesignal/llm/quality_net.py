"""Quality classifier: random-indexing word vectors pooled per document, then a small network.

Words: each stretch between white space is parted into a core and a tail of punctuation
(``word,`` is ``word`` and ``,``). Frequent cores and tails are the vocabulary; any other counts as its
shape (upper, title, lower, digits, mixed), and a tail as its first characters.

Random indexing: every vocabulary entry has a fixed sparse vector of +1 and -1; a word's vector is the
normalised sum of its neighbours' fixed vectors over the training sample, summed on Spark, next to
its own fixed vector.

Pooling: a document is the mean of its core vectors, the mean of its tail vectors and the mean
product of neighbouring core vectors, so that what words there are, how they are punctuated
and whether they repeat all show.

Network: two layers in numpy, trained on the pooled vectors of the sample with classes
weighing alike; one temperature, fitted on a part of the sample kept from training, calibrates
the probabilities.

The sample is bounded by ``per_class`` labelled rows of each class, drawn by a hash. Everything
that comes to the driver is bounded by it, the vocabulary or the vector width. Scoring reads whole texts
in slices of bounded size.

Nulls and edges: null and empty texts are scored as documents of no words. Null labels and ids without
a label are not learned from. With fewer than two classes every score is the share of class 1,
or 0.5 with no labels at all. Repeated rows are scored alike. An id with labels of both classes counts as
class 1. Words of equal frequency enter the vocabulary in code point order. Extra columns of any name are not read.
A text of tens of millions of characters is pooled in slices of 200,000 words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remove, small, texts_of, with_columns, written
from .language_id import drawn

SHAPES = ("<lower>", "<upper>", "<title>", "<digits>", "<mixed>", "<none>")
_PARTS = re.compile(r"(\w*)(.*)", re.S)
_WORDS_A_SLICE = 200_000


def shape(core: str) -> str:
    if not core:
        return "<none>"
    if core.isdigit():
        return "<digits>"
    if core.islower():
        return "<lower>"
    if core.isupper():
        return "<upper>"
    return "<title>" if core[0].isupper() and core[1:].islower() else "<mixed>"


def parts(word: str) -> tuple[str, str]:
    core, tail = _PARTS.match(word).groups()
    return core, tail[:3]


class Numbering:
    """Words to (core, tail) numbers; remembers up to a bounded number of different words."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        self.vocabulary, self.held, self.pairs = vocabulary, {}, np.zeros((1 << 12, 2), np.int32)

    def __call__(self, words: list[str]) -> np.ndarray:
        held = self.held
        if len(held) > 100_000:
            held.clear()
        ids = np.fromiter((held[w] if w in held else self._add(w) for w in words), np.int64, len(words))
        return self.pairs[ids]

    def _add(self, word: str) -> int:
        core, tail = parts(word)
        v = self.vocabulary
        self.held[word] = n = len(self.held)
        if n == len(self.pairs):
            self.pairs = np.concatenate([self.pairs, np.zeros_like(self.pairs)])
        self.pairs[n] = v.get(core, v[shape(core)]) if core else v["<none>"], v.get("~" + tail, v["<none>"])
        return n


def index_vectors(names: list[str], width: int) -> np.ndarray:
    """A fixed sparse vector of +1 and -1 for each name."""
    out = np.zeros((len(names), width), np.float32)
    for i, name in enumerate(names):
        r = np.random.default_rng(zlib.crc32(name.encode()))
        out[i, r.choice(width, 4, replace=False)] = (1, -1, 1, -1)
    return out


@dataclass(frozen=True)
class QualityModel:
    vocabulary: dict[str, int]
    vectors: np.ndarray
    layers: tuple = ()
    centre: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    temperature: float = 1.0
    constant: float | None = None

    def pool(self, texts: list[str | None], numbering: Numbering) -> np.ndarray:
        """A row of pooled features for each text."""
        k = self.vectors.shape[1]
        out = np.zeros((len(texts), 3 * k + 2), np.float64)
        for i, text in enumerate(texts):
            words = (text or "").split()
            sums, n = np.zeros((3, k)), len(words)
            for at in range(0, n, _WORDS_A_SLICE):
                # One word of the slice before is kept, for the product across the border.
                ids = numbering(words[max(0, at - 1) : at + _WORDS_A_SLICE])
                cores = self.vectors[ids[:, 0]]
                own = cores[1:] if at else cores
                sums[0] += own.sum(0)
                sums[1] += self.vectors[ids[1:, 1] if at else ids[:, 1]].sum(0)
                sums[2] += np.einsum("ij,ij->j", cores[1:], cores[:-1])
            out[i, :-2] = (sums / max(1, n)).ravel()
            out[i, -2:] = np.log1p(n), n == 0
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.centre) / self.scale @ w1 + b1) @ w2 + b2

    def score(self, texts: list[str | None], numbering: Numbering) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(self.pool(texts, numbering)) / self.temperature, -40, 40)))


def train_network(x: np.ndarray, y: np.ndarray, *, hidden: int = 24, rounds: int = 400, seed: int = 0) -> tuple[tuple, np.ndarray, np.ndarray, float]:
    """Layers, centre, scale and temperature. A fifth of the rows is kept for the temperature."""
    r = np.random.default_rng(seed)
    kept = r.random(len(y)) < 0.2
    if len(set(y[~kept])) < 2 or len(set(y[kept])) < 2:
        kept[:] = False
    centre, scale = x.mean(0), x.std(0) + 1e-3
    z, t = ((x - centre) / scale)[~kept], y[~kept].astype(float)
    weight = np.where(t == 1, 0.5 / max(1e-9, t.mean()), 0.5 / max(1e-9, 1 - t.mean()))
    p = [r.normal(0, 0.15, (x.shape[1], hidden)), np.zeros(hidden), r.normal(0, 0.15, hidden), np.zeros(())]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, rounds + 1):
        own = slice(None) if len(t) < 4000 else r.choice(len(t), 4000, replace=False)
        zi, ti, wi = z[own], t[own], weight[own]
        h = np.tanh(zi @ p[0] + p[1])
        d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - ti) * wi / len(ti)
        back = np.outer(d, p[2]) * (1 - h * h)
        grads = [zi.T @ back + 1e-4 * p[0], back.sum(0), h.T @ d + 1e-4 * p[2], d.sum()]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - 0.01 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    temperature = 1.0
    if kept.any():
        s, u = np.tanh((x[kept] - centre) / scale @ p[0] + p[1]) @ p[2] + p[3], y[kept]
        grid = np.exp(np.linspace(np.log(0.3), np.log(8), 60))
        loss = [np.logaddexp(0, np.where(u == 1, -s, s) / g).mean() for g in grid]
        temperature = float(grid[int(np.argmin(loss))])
    return tuple(p), centre, scale, temperature


def fit(docs: DataFrame, labels: DataFrame, train: Column, *, per_class: int = 3000, words: int = 12_000, width: int = 32, window: int = 2) -> QualityModel:
    """Fit on rows of ``docs(doc_id, text)`` whose id has a non-null ``quality`` in ``labels(doc_id, quality)``, where ``train`` holds.

    ``per_class``: documented bound of the sample, about that many rows of each class.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(train & F.col("quality").isin(0, 1))
    _, chosen = drawn(known, "quality", "doc_id", per_class)
    # About two classes' rows at most, so the side that is broadcast is bounded.
    few = known.where(chosen).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # All tasks look for the sample; only then is it dealt to a few, as its size is bounded.
    sample, path = written(docs.select("doc_id", "text").where(train).join(F.broadcast(few), "doc_id").select("quality", "text").repartition(24))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in small(batches):
            for text in texts_of(batch):
                for word in set((text or "").split()):
                    core, tail = parts(word)
                    for x in (core, tail and "~" + tail):
                        if x:
                            seen[x] = seen.get(x, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    frequent = sample.mapInArrow(tokens, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n >= 3").orderBy(F.desc("n"), "word").limit(words)
    names = [*SHAPES, *(r.word for r in frequent.collect())]
    vocabulary = {w: i for i, w in enumerate(names)}
    fixed = index_vectors(names, width)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, numbering = np.zeros_like(fixed), Numbering(vocabulary)
        for batch in small(batches):
            for text in texts_of(batch):
                ids = numbering((text or "").split())[:, 0]
                for at in range(0, len(ids), 65_536):  # slices keep the arrays of vectors small
                    for step in range(1, window + 1):
                        own, next_to = ids[at : at + 65_536], ids[at + step : at + step + 65_536]
                        own = own[: len(next_to)]
                        np.add.at(sums, own, fixed[next_to])
                        np.add.at(sums, next_to, fixed[own])
        used = np.flatnonzero(np.abs(sums).sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(list(sums[used].astype(np.float64)), pa.list_(pa.float64()))], names=["i", "v"])

    summed = sample.mapInArrow(contexts, "i long, v array<double>").groupBy("i").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(width)]).alias("v"))
    context = np.zeros_like(fixed)
    for r in summed.collect():
        context[r.i] = r.v
    norm = lambda a: a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-9)
    model = QualityModel(vocabulary, np.concatenate([norm(context), norm(fixed)], axis=1).astype(np.float32))
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbering = Numbering(vocabulary)
        for batch in small(batches):
            x = shared.value.pool(texts_of(batch), numbering)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["quality", "x"])

    rows = sample.select("quality", "text").mapInArrow(pooled, "quality int, x array<double>").toArrow()
    remove(sample.sparkSession, path)
    y = rows.column("quality").to_numpy()
    if len(set(y)) < 2:
        return QualityModel(vocabulary, model.vectors, constant=float(y.mean()) if len(y) else 0.5)
    x = np.array(rows.column("x").to_pylist())
    order = np.lexsort(np.concatenate([x, y[:, None]], axis=1).T)  # the same whatever order the rows come in
    layers, centre, scale, temperature = train_network(x[order], y[order])
    return QualityModel(vocabulary, model.vectors, layers, centre, scale, temperature)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id, score`` for every row of ``docs(doc_id, text)``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbering = Numbering(shared.value.vocabulary)
        for batch in small(batches):
            yield with_columns(batch, ["doc_id"], score=pa.array(shared.value.score(texts_of(batch), numbering), pa.float64()))

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
