"""Token ids by a public byte-level BPE vocabulary, and counts of them.

``encoder(path)`` gives the ids that the ``tokenizers`` library gives for the vocabulary file
at ``path`` with no special tokens added. The merges run in ``tiktoken``, five times as fast
on the same ranks; a text that holds a special token's name, or that it can't take, goes to
``tokenizers`` itself. ``tests/llm`` holds the two against each other.

Length histogram: documents are encoded once and summed by encoded length (partial sums in
each task), so what is shuffled and sorted is bounded by the number of different lengths.
Suffix sums over it answer, for every context limit, how many documents reach it, how many
tokens they hold and how many are left when all are cut to it.

Nulls and edges: null and empty texts have length zero and are counted. An empty table gives
an empty histogram. Repeated rows count each time; documents of equal length share a row. Only ``text`` is read,
whatever else the columns are named. A very long text is encoded whole; its ids take eight bytes each.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, texts_of


@lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[str], list[int]]:
    """A function from a text to its ids. ``path``: a byte-level BPE file of the tokenizers library."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    special = [t["content"] for t in held.get("added_tokens", [])]
    # Byte-level files write each byte as a printable character; this is that public table's rule.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    ranks = {bytes(back[c] for c in word): i for word, i in held["model"]["vocab"].items() if word not in special}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if not any(s in text for s in special):
            try:
                return fast.encode_ordinary(text)
            except BaseException as e:  # a panic of the compiled code is no Exception, and its type has no importable name
                if type(e).__name__ != "PanicException":
                    raise
        return slow.encode(text, add_special_tokens=False).ids

    return encode


def length_counts(docs: DataFrame, path: str) -> DataFrame:
    """``n_tokens, n_docs``: how many rows of ``docs(text)`` have each encoded length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in small(batches):
            n, k = np.unique(np.array([len(encode(t)) if t else 0 for t in texts_of(batch)], np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(k)], names=["n_tokens", "n_docs"])

    return docs.select("text").mapInArrow(run, "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def length_histogram(docs: DataFrame, path: str) -> DataFrame:
    """One row for each encoded length that occurs, with suffix sums.

    ``docs_at_least`` and ``tokens_at_least``: rows of this length or longer, and their tokens.
    ``tokens_truncated``: all tokens left if every document is cut to this length. ``share_below``: the share
    of documents shorter than this, so quantile q is the last length whose share is q or less.
    For a limit L between two lengths, the row of the next longer length n answers: tokens left =
    ``tokens_truncated - (n - L) * docs_at_least``.
    """
    counted = length_counts(docs, path).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    # One row for each different length: their number is bounded by the longest text, not by the rows.
    down = Window.orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = counted.select("n_tokens", "n_docs", "tokens", F.sum("n_docs").over(down).alias("docs_at_least"), F.sum("tokens").over(down).alias("tokens_at_least"), F.sum("n_docs").over(whole).alias("all_docs"), F.sum("tokens").over(whole).alias("all_tokens"))
    return summed.select(
        "n_tokens", "n_docs", "tokens", "docs_at_least", "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("tokens_truncated"),
        ((F.col("all_docs") - F.col("docs_at_least")) / F.col("all_docs")).alias("share_below"),
    )


def answer_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """``context_limit, docs_at_least, tokens_truncated`` for each of a stated list of limits."""
    least = F.explode(F.array(*[F.lit(n) for n in limits])).alias("context_limit")
    asked = histogram.select("n_tokens", "n_docs", least)
    return asked.groupBy("context_limit").agg(
        F.sum(F.when(F.col("n_tokens") >= F.col("context_limit"), F.col("n_docs")).otherwise(0)).alias("docs_at_least"),
        F.sum(F.least("n_tokens", "context_limit") * F.col("n_docs")).alias("tokens_truncated"),
    )
