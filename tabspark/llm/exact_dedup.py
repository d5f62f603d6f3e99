"""Exact duplicates by content-defined chunk recipes, in DataFrame operations only.

A text is cut where its content says so (the first line or sentence end after ``MIN_CHUNK`` characters, at
the latest after ``MAX_CHUNK``), so equal stretches give equal chunks.  Each distinct chunk is moved once,
to check that its hash stands for one content; then documents are lists of chunk identifiers, and only
these short lists are grouped and joined.

Null counts as the empty text, whose recipe is the empty list.  Rows are never merged: repeated rows of one
doc_id are each returned, and all are kept if that doc_id is the one that stays.  An empty table gives an
empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabspark.llm.common import attach, saved

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_CHUNK, MAX_CHUNK = 1024, 8192


def ascii_lower(text: Column) -> Column:
    """Null as empty, A-Z in lower case, every other character as it is."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, UPPER.lower()))


def chunks(text: Column) -> Column:
    cut = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 1}}}?(?:\n|[.!?] )|.{{1,{MAX_CHUNK}}}"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def recipes(docs: DataFrame, chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, text_sha256 and recipe: the ordered identifiers (hash, variant) of the document's chunks.

    The variant tells apart different chunks of one hash; it is 0 unless a hash has several contents.
    """
    cut = docs.select("doc_id", ascii_lower(F.col("text")).alias("__norm")).select(
        "doc_id", F.sha2("__norm", 256).alias("text_sha256"), chunks(F.col("__norm")).alias("__chunks"))
    listed = saved(cut.select("doc_id", "text_sha256", F.transform("__chunks", lambda c: chunk_hash(c)).alias("__hashes")))
    contents = cut.select(F.explode("__chunks").alias("__chunk")).distinct()
    shared = contents.groupBy(chunk_hash(F.col("__chunk")).alias("__h")).agg(F.count("*").alias("__n"))
    shared = saved(shared.where("__n > 1").select("__h"))
    plain = F.transform("__hashes", lambda h: F.struct(h.alias("hash"), F.lit(0).alias("variant")))
    if shared.isEmpty():
        return listed.select("doc_id", "text_sha256", plain.alias("recipe"))
    one = cut.distinct().select("doc_id", "text_sha256", F.posexplode("__chunks").alias("__pos", "__chunk"))
    one = one.withColumn("__h", chunk_hash(F.col("__chunk")))
    variants = contents.withColumn("__h", chunk_hash(F.col("__chunk"))).join(shared, "__h", "left_semi")
    number = variants.groupBy("__h").agg(F.array_sort(F.collect_set("__chunk")).alias("__all"))
    one = one.join(number, "__h", "left")
    variant = F.coalesce(F.array_position("__all", F.col("__chunk")) - 1, F.lit(0)).cast("int")
    part = F.struct("__pos", F.struct(F.col("__h").alias("hash"), variant.alias("variant")).alias("__id"))
    fixed = one.groupBy("doc_id", "text_sha256").agg(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["__id"]).alias("recipe"))
    keys = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("doc_id", "text_sha256")]
    return listed.alias("a").join(fixed.alias("b"), keys, "left").select(
        "a.doc_id", "a.text_sha256", F.coalesce("b.recipe", F.array().cast("array<struct<hash:bigint,variant:int>>")).alias("recipe"))


def exact_dedup(docs: DataFrame, chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Per row: doc_id, keep_id (largest doc_id of the equal texts), group_size, kept, text_sha256."""
    listed = recipes(docs, chunk_hash)
    groups = listed.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    out = attach(listed, groups, "recipe", "group_size")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
