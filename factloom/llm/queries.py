"""Driver queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import chat, neardup, neighbours, packing, passages, quality, secrets, sentencepieces, sharding, toxicity
from factloom.llm.storage import read


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), shingle_words=2, percent=80)


#: Roles as the layout with ``from`` and ``value`` names them.
_FROM = {"user": "human", "assistant": "gpt"}


def _as_records(rows: DataFrame) -> DataFrame:
    """(conv_id, record): each conversation as a JSON record of one of three layouts, by its id,
    with fields that no layout knows."""
    told = F.coalesce(F.col("role"), F.lit(""))
    said = F.coalesce(F.col("text"), F.lit(""))
    turn = F.struct(F.col("turn").isNotNull().alias("later"), "turn", told.alias("role"), said.alias("text"))
    by = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    listed = lambda role: F.transform("t", lambda t: F.struct(role(t).alias("a"), t["text"].alias("b"), F.lit(1).alias("weight")))
    same = lambda t: t["role"]
    renamed = lambda t: F.coalesce(F.create_map(*(F.lit(x) for kv in _FROM.items() for x in kv))[t["role"]], t["role"])
    as_json = lambda top, role, text, turns: F.to_json(F.struct(F.col("conv_id").alias("id"), turns.cast(f"array<struct<{role}:string,{text}:string,weight:int>>").alias(top)))
    kind = F.pmod("conv_id", F.lit(4))
    taken = F.exists("t", lambda t: t["role"].isin("human", "gpt", "bot", "model"))
    record = (
        F.when((kind == 1) | taken, as_json("messages", "role", "content", listed(same)))
        .when(kind == 2, as_json("turns", "role", "text", listed(same)))
        .otherwise(as_json("conversations", "`from`", "value", listed(renamed)))
    )
    return by.select("conv_id", record.alias("record"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the conversations goes in as rows of the table, the others as JSON records of
    three layouts, so that records are told apart by their fingerprints."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    rows = rows.unionByName(more)
    as_rows = F.col("conv_id").isNull() | (F.pmod("conv_id", F.lit(4)) == 0)
    return chat.conversation_digests(chat.canonical_rows(rows.where(as_rows)).unionByName(chat.canonical_records(_as_records(rows.where(~as_rows)))))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.quality(read(spark, sf_dir, "documents"), labels)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(read(spark, sf_dir, "documents"), length=200)


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"), k=10, every=100)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"), shards=40)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    labels = read(spark, sf_dir, "labels").where(remainder != 1).select("doc_id", F.col("toxic").alias("label"))
    out = toxicity.toxicity(read(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", (remainder == 1).alias("held_out"), "score", "predicted")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = public_tokenizers.path
    return packing.pack(read(spark, sf_dir, "documents"), at("byte_bpe_50k.json"), at("byte_bpe_50k.tiktoken"), end_id=2, capacity=1024)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The public vocabulary under a unigram model, which Viterbi is made for."""
    return sentencepieces.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), unigram=True)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_near_dedup, op2_chat_format, op3_quality_rules, op4_suffix_dedup, op5_nearest, op6_sharding, op7_toxicity, op8_secret_scan, op9_packing, op10_sentencepiece, pipeline)
}

ORACLE_SQL = {
    "op1_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []
    WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM words
), flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common WHERE 100 * c >= 80 * (na + nb - c)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets
  UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other
), comp AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sets s JOIN comp c USING (doc_id)
""",
}
