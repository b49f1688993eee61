"""Building a validation corpus: sampling, eight-sentence extracts, reordering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stabilis.functions.text import ORDERS, flat_sentences, paragraphs, reordered
from stabilis.plans.checkpoint import checkpointed


def stratified_sample(files: DataFrame, stratum: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows per stratum in the order of a seeded hash (ties by key), chosen in two steps so that a stratum that holds
    most rows is cut down in many tasks before its best rows meet in one."""
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")).cast("binary"))
    rows = files.withColumn("_order", order).withColumn("_part", F.pmod(F.xxhash64(key), F.lit(64)))
    first = rows.withColumn("_rank", F.row_number().over(W.partitionBy(stratum, "_part").orderBy("_order", key))).filter(F.col("_rank") <= n)
    last = first.withColumn("_rank", F.row_number().over(W.partitionBy(stratum).orderBy("_order", key))).filter(F.col("_rank") <= n)
    return last.drop("_order", "_part", "_rank")


def extracts(texts: DataFrame, key: str, text: str, seed: int = 0) -> DataFrame:
    """key and the first eight sentences of one paragraph of at least eight, chosen by a seeded hash."""
    paras = texts.select(key, F.posexplode(paragraphs(F.col(text))).alias("p", "paragraph")).withColumn("sentences", flat_sentences(F.col("paragraph"))).filter(F.size("sentences") >= 8)
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"), F.col("p").cast("string")).cast("binary"))
    best = paras.groupBy(key).agg(F.min_by("sentences", F.struct(order.alias("o"), F.col("p"))).alias("sentences"))
    return best.select(key, F.slice("sentences", 1, 8).alias("sentences"))


def edits(texts: DataFrame, key: str, sentences: str = "sentences") -> DataFrame:
    """key, edit, original, edited: files in key order take the four orders in turn.

    The turn comes from counts by range, so no task sorts all files.
    """
    names = list(ORDERS)
    placed = checkpointed(texts.select(key, sentences).repartitionByRange(key).sortWithinPartitions(key).withColumn("_p", F.spark_partition_id()))
    inner = placed.withColumn("_n", F.row_number().over(W.partitionBy("_p").orderBy(key)))
    sizes = inner.groupBy("_p").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    turn = (F.col("_n") + F.col("_before") - 1) % len(names)
    rows = inner.join(before, "_p").withColumn("edit", F.element_at(F.array(*[F.lit(x) for x in names]), (turn + 1).cast("int")))
    edited = F.lit(None)
    for name in names:
        edited = F.when(F.col("edit") == name, reordered(F.col(sentences), name)).otherwise(edited)
    return rows.select(key, "edit", F.array_join(sentences, " ").alias("original"), F.array_join(edited, " ").alias("edited"))
