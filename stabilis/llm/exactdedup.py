"""Exact deduplication by skew-safe combining.

Three stages, each of which groups by the full normalised content (the digest only decides where rows go):

1. local: map-side partial aggregation keeps one winner per content in each input partition;
2. salted: the local winners of a content meet in one of ``salts`` groups of its digest;
3. global: the few salt winners of a content are combined.

A content that a third of all rows share thus reaches stage 2 as one row per input partition, and stage 3 as at
most ``salts`` rows. Only (id, digest) rows are joined back, without the text. Everything is built from native
expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stabilis.llm.common import BLANK, keyed


def normalised(text: Column) -> Column:
    """Null becomes empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{BLANK}]+", " ")


def winners(docs: DataFrame, id_col: str, content: Column, salts: int) -> DataFrame:
    """One row per distinct content: digest, a second fingerprint, length, the smallest id and the number of rows."""
    rows = docs.select(
        F.col(id_col).alias("id"),
        content.alias("content"),
        F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"),
    ).withColumn("digest", F.sha2("content", 256))
    salted = rows.groupBy("digest", "salt", "content").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    whole = salted.groupBy("digest", "content").agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size"))
    return whole.select("digest", F.xxhash64("content").alias("check"), F.length("content").alias("chars"), "keep_id", "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty text. Of equal contents the smallest id stays; null ids lose to any other id, and if
    a group has no other id its keep_id is null. Rows that repeat an id with the same content are copies of each
    other: each is listed, and the flag ``kept`` marks every row that carries the group's keep_id. Other columns
    are ignored. An empty table gives an empty result.

    The rows are joined to the winners on digest (SHA-256) and a second independent fingerprint; the winners were
    told apart by full content, so two contents under one key would show as two winners, and raise an error rather
    than merge.
    """
    content = normalised(F.col(text_col))
    best = (
        winners(docs, id_col, content, salts)
        .groupBy("digest", "check")
        .agg(F.min("chars").alias("chars"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("contents"))
        .withColumn("group_size", F.when(F.col("contents") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two contents share a digest")).cast("long")))
        .drop("contents")
    )
    keyed = docs.select(F.col(id_col).alias("id"), content.alias("content")).select(
        "id", F.sha2("content", 256).alias("digest"), F.xxhash64("content").alias("check"), F.length("content").alias("chars")
    )
    # with the length as a third key both sides are dealt anew for the join, so that adaptive execution may split a
    # digest that very many rows share
    return keyed.join(best, ["digest", "check", "chars"]).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The input's rows and columns without exact copies; of rows that also repeat the kept id, all stay.

    Rows are told apart by id and content, so an id with several texts loses only those that are copies. Only ids and
    digests of copies are joined (left anti), so texts are compared in the combining stages alone. Any names of columns
    may occur.
    """
    gone = exact_dedup(docs, id_col, text_col, salts).filter(~F.col("kept")).select(F.col(id_col).alias("gone"), F.col("text_sha256").alias("gone_digest"))
    rows = keyed(docs, id=F.col(id_col), digest=F.sha2(normalised(F.col(text_col)), 256))
    return rows.join(gone, F.col("id").eqNullSafe(F.col("gone")) & (F.col("digest") == F.col("gone_digest")), "left_anti").select("row.*")
