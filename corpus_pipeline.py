"""The corpus pipeline: quality rules, near-duplicates, repeated passages, secrets, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the
last return the columns of ``documents``; the last returns the packed pieces. Each row is a
document of its own, also where doc_ids repeat or are null.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import neardup, packing, passages, quality, secrets
from factloom.llm.storage import materialize, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """The rows with a unique _row, written, so that every use sees the same numbers."""
    return materialize(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")), name)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the classifier keep. Each row is judged by its text alone; null
    and empty texts fail the rules."""
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.quality(docs, labels, carry=COLUMNS[1:]).where("kept").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near-duplicates: five-word shingles, 0.8 or more.
    The first has the smallest doc_id; null ones come last, and of rows that repeat one stays.
    Texts without words are near nothing and stay."""
    docs = _numbered(docs, "numbered")
    found = neardup.near_duplicates(docs.select(F.col("_row").alias("doc_id"), "text"), shingle_words=5, percent=80)
    found = found.select(F.col("doc_id").alias("_row"), "component_id").join(docs.select("_row", "doc_id"), "_row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_last"), "doc_id", "_row"))
    kept = found.groupBy("component_id").agg(first.alias("_first")).select("_first._row")
    return docs.join(kept, "_row", "left_semi").select(COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 200-byte strings that stand elsewhere too. Where a cut splits
    a character, its remaining bytes go; n_chars follows the new text. Rows of equal texts, which
    the stage before leaves none of, would all lose them; null texts stay null."""
    cut = passages.without_repeats(docs.select(*COLUMNS), length=200)
    valid, left = F.try_validate_utf8("kept_bytes"), F.make_valid_utf8("kept_bytes")
    new = F.coalesce(valid, F.replace(left, F.lit("\ufffd"), F.lit("")))
    return cut.withColumn("_text", new).select("doc_id", F.coalesce("_text", "text").alias("text"), "lang", "source", F.when(F.col("_text").isNull(), F.col("n_chars")).otherwise(F.length("_text")).cast("long").alias("n_chars"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets replaced by a mark; n_chars follows the new text. Every row stays; null
    texts stay null."""
    clean = secrets.redact(docs.select(COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces, with their ids' checksums: a row or more for each document, null and empty
    texts included. Rows that repeat a doc_id are documents of their own."""
    at = public_tokenizers.path
    return packing.pack(docs, at("byte_bpe_50k.json"), at("byte_bpe_50k.tiktoken"), end_id=2, capacity=1024)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the classifier, the tokenizer nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
