"""The registered queries of this folder, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, digest, html_crf, language_id, lexical, mixing, packing, pii, quality_net, quality_rules, simhash, tokens, turn_repair
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, ~language_id.held_out(5, 0))
    found = language_id.identify(docs, model)
    return found.select("doc_id", language_id.held_out(5, 0).alias("held_out"), "lang_pred", "score")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.compare_with_edits(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), narrow=True)
    first = F.when(F.size("positions") > 0, F.col("positions")[0]).alias("position")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", first).orderBy("position", "doc_id")


def op7_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.length_histogram(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_net.fit(docs, table(spark, sf_dir, "labels"), ~language_id.held_out(3, 1))
    scored = quality_net.score(docs, model)
    return scored.select("doc_id", language_id.held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return turn_repair.repair(turn_repair.damaged(conversations), conversations)


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.windows(conversations.unionByName(chat.probe(spark)), tokenizer_path()))


def queries() -> dict:
    own = (op1_language_id, op2_simhash, op3_digest, op4_pii, op5_quality_rules, op6_mixing, op7_token_lengths, op8_main_text, op9_packing, op10_quality_net, op11_lexical, op12_turn_repair, op13_chat)
    return {f.__name__: f for f in own}


#: Shares of the sources by water-filling, then whole passes and part of a last one in hash order.
_OP6 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, text, '')) AS mark FROM documents
), named AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM sized GROUP BY source
), weighed AS (
  SELECT *, (number % 3 + 1)::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap, (number % 3 - 1) * -0.5::DOUBLE AS b FROM named
), leveled AS (
  SELECT *, cap / w AS ratio,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / sum(w) OVER (ORDER BY cap / w, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), targets AS (
  SELECT source, source_size, b, least(cap, coalesce((SELECT arg_min(level, ratio) FROM leveled WHERE level <= ratio), 0) * w) AS target FROM leveled
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.b,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.mark, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), passed AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM placed
), copied AS (
  SELECT *, CASE WHEN size > 0 THEN (passes + CASE WHEN begins + size / 2.0::DOUBLE < target - passes * source_size THEN 1 ELSE 0 END)::BIGINT ELSE 0 END AS copies,
    least(1.0::DOUBLE, (begins + size / 2.0::DOUBLE) / nullif(target, 0)) AS y
  FROM passed
)
SELECT doc_id, size, source_size, target, copies * size AS taken,
  CASE WHEN copies > 0 THEN CASE WHEN b = 0 THEN y ELSE (b - 1 + sqrt((1 - b) * (1 - b) + 4 * b * y)) / (2 * b) END END AS position
FROM copied
"""


#: Every document against every item, term by term.
_OP11 = r"""
WITH folded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms,
    row_number() OVER () AS row FROM documents
), sized AS (
  SELECT doc_id, row, terms, len(terms)::BIGINT AS n FROM folded WHERE len(terms) > 0
), figures AS (
  SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM sized
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), counted AS (
  SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(terms) AS term FROM sized) WHERE term IN (SELECT term FROM asked) GROUP BY row, term
), weighed AS (
  SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counted, figures GROUP BY term, nn
), scored AS (
  SELECT a.item_id, s.doc_id, s.row, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::BIGINT AS score
  FROM asked a JOIN counted c USING (term) JOIN weighed USING (term) JOIN sized s ON s.row = c.row, figures GROUP BY a.item_id, s.doc_id, s.row
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": _OP6, "op11_lexical": _OP11}
