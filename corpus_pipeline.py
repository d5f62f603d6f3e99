"""Cleaning of a corpus in stages, each a whole pass over what the one before kept.

Documents that the toxicity model rejects go; lines that many documents share stay in one of them; of every group of near duplicates the
document with the smallest doc_id stays; documents that contain a benchmark passage go; what remains is tokenized, and
the tokens are decoded again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark.llm import decontamination, line_dedup, near_dedup, sentencepiece_codec, toxicity
from tabspark.session import shared_scratch

ORACLE_SQL = None  # classification and tokenizing have no SQL form; the tests compare the stages with brute force


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(docs, _read(spark, sf_dir, "labels"), spans=False)
    return scored.where(F.col("__score") < toxicity.THRESHOLD).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a repeated line the document with the smallest doc_id keeps its copies; a document that held nothing else is a copy and goes."""
    out = line_dedup.drop_repeated_lines(docs, keep_first=True)
    out = out.where((F.col("__n_dropped") == 0) | F.col("text").rlike("[^ \\t\\n\\x0b\\f\\r]"))
    return out.select(*[F.length("text").cast("bigint").alias(c) if c == "n_chars" else c for c in docs.columns])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage."""
    out = decontamination.contamination(docs, _read(spark, sf_dir, "benchmark"))
    return out.where(F.size("__items") == 0).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Columns of the input that are called like an added one make room for it."""
    docs = docs.drop("n_tokens", "token_ids", "decoded", "round_trip")
    out = sentencepiece_codec.encode(docs, decoded=True)  # both ways in one pass
    return out.select(*docs.columns, F.coalesce(F.size("__ids"), F.lit(0)).cast("bigint").alias("n_tokens"), F.col("__ids").alias("token_ids"),
                      F.col("__decoded").alias("decoded"), F.col("text").eqNullSafe(F.col("__decoded")).alias("round_trip"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("decontamination", decontaminate), ("sentencepiece", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again before the next."""
    docs = _read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_scratch(spark)}/{name}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
