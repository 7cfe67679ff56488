"""A training corpus from raw documents, in five written stages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesignal.llm import mixing, near_copies, packing, pii, quality_rules, simhash
from pagesignal.llm.common import remove, shared_folder, table, temporary
from pagesignal.llm.queries import tokenizer_path

#: No SQL has the near-copy and token stages; tests hold run() against brute force.
ORACLE_SQL = None


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failed lines; null texts and texts of under 20 words go."""
    return quality_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more, checked on SimHash classes and min-hash buckets. A group without any doc_id keeps one, too."""
    return simhash.keep_one(docs, near_copies.representatives)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data masked; null texts stay null."""
    return pii.mask_documents(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mix takes, in training order; a document taken k times comes k times."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of at most 1024 tokens.

    Documents that lie in files are packed within ranges of their places there, which the stage before put in training
    order; ``position`` tells copies apart. Other frames have no order and are packed by a hash.
    """
    if docs.inputFiles():
        return packing.pack(packing.with_file_positions(docs.select("doc_id", "text")), tokenizer_path(), position=F.col("position"))
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality rules", rules), ("near-duplicates", near_duplicates), ("personal data", personal_data), ("mixing", mixture), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written as Parquet to the shared folder and read again.

    A stage's table and what it cut on its way are deleted once the next stage stands; the last table stays. An empty
    table gives an empty result; repeated rows are copies of each other, rows without a doc_id or that share one with
    other texts are told apart by their texts; extra columns, whatever their names, pass all stages but the last.
    """
    docs, folder, before = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (_, stage) in enumerate(STAGES):
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        if before:
            remove(spark, before)
        before = f"{folder}/{k}"
        docs = spark.read.parquet(before)
    return docs
