"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length per source. A source's budget is met by whole passes over it, then by an equal
share of each length, then by a bounded knapsack over the lengths that are left; a seeded order picks as many
documents of each length as the plan says. Only counts by (source, length, hash range) are ever brought together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stabilis.llm.common import BLANK, keyed

#: Words that the knapsack fits at most (the shares come nearer than that where documents are short enough).
KNAPSACK = 8_192
#: Hash ranges into which the documents of one length are divided, so that no group has to be ordered as a whole.
RANGES = 1_024


def word_count(text: Column) -> Column:
    """Number of words (runs of characters other than ASCII white space); null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANK}]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Add weight and target to (source, source_size), one row per source.

    Sources by code point, null last, take the weights in turn. All targets add up to ``share`` times all sizes; none
    exceeds ``most`` times its source's size, and what is cut there goes to the others by weight, again and again,
    which ends at one level: target = min(most * size, level * weight). Sources without words get target 0.
    The windows run over one row per source.
    """
    turn = W.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(turn) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), k + 1))
    weighed = weighed.withColumn("cap", most * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    whole = W.partitionBy()
    order = W.orderBy("full_at", "source")
    leveled = weighed.select(
        "*",
        (F.sum("source_size").over(whole) * share).alias("total"),
        F.sum("weight").over(whole).alias("weights"),
        F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("weight_before"),
    ).withColumn("level", F.try_divide(F.col("total") - F.col("cap_before"), F.col("weights") - F.col("weight_before")))
    # sources fill up in order of full_at; the level is that of the first source which does not fill up
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(whole)["level"]
    return leveled.withColumn("at", level).select(
        "source", "source_size", "weight", F.coalesce(F.least("cap", F.col("at") * F.col("weight")), F.col("cap")).alias("target")
    )


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take for the largest reachable sum within the budget (bounded knapsack).

    Counts are divided into powers of two; ``by`` keeps the bundle with which each sum was first reached, and that
    bundle's rest was reached by earlier bundles only.
    """
    take = np.zeros(len(lengths), np.int64)
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    by = np.full(budget + 1, -1, np.int64)
    bundles: list[tuple[int, int]] = []
    for i, (length, count) in enumerate(zip(lengths.tolist(), counts.tolist())):
        left, size = min(count, budget // length), 1
        while left > 0:
            size = min(size, left)
            step = length * size
            new = np.flatnonzero(reached[: budget + 1 - step] & ~reached[step:]) + step
            by[new] = len(bundles)
            reached[new] = True
            bundles.append((i, size))
            left, size = left - size, size * 2
        if reached[budget]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at > 0:
        i, size = bundles[by[at]]
        take[i] += size
        at -= int(lengths[i]) * size
    return take


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, most: int = KNAPSACK) -> np.ndarray:
    """How many documents of each length to take so that their sum comes near the budget.

    An equal share of every length first, then the longest that fit, down to what the knapsack can settle exactly. If
    one document more comes nearer from above than that from below, it is taken.
    """
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return take
    if budget >= total:
        return counts.copy()
    take = np.floor(counts * (budget / total)).astype(np.int64)
    rest = budget - int((lengths * take).sum())
    for i in np.argsort(-lengths, kind="stable"):
        spare = rest - most // 2
        if spare <= 0:
            break
        more = min(int(counts[i] - take[i]), spare // int(lengths[i]))
        take[i] += more
        rest -= more * int(lengths[i])
    window = min(rest, most)
    usable = np.flatnonzero((counts > take) & (lengths <= window))
    more = knapsack(lengths[usable], (counts - take)[usable], window)
    take[usable] += more
    rest -= int((lengths[usable] * more).sum())
    spare = np.flatnonzero(counts > take)
    if len(spare):
        nearest = spare[np.argmin(np.abs(lengths[spare] - rest))]
        if abs(int(lengths[nearest]) - rest) < rest:
            take[nearest] += 1
    return take


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float, most: float, seed: int) -> DataFrame:
    """Per row: id, twin (a hash of the text), source, size, source_size, target and copies."""
    rows = docs.select(F.col(id_col).alias("id"), _twin(text_col).alias("twin"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    order = F.xxhash64(F.lit(seed), "id")
    rows = rows.withColumn("order", order).withColumn("part", F.pmod("order", F.lit(RANGES)).cast("int"))
    counts = rows.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("n"))
    lengths = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    goals = targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)
    goals = goals.withColumn("passes", F.least(F.floor(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))), F.lit(int(most)))).withColumn(
        "budget", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long")
    )
    ready = lengths.alias("l").join(goals.alias("g"), F.col("l.source").eqNullSafe(F.col("g.source"))).select(
        F.col("l.source").alias("source"), "size", "n", "source_size", "target", "passes", F.when(F.col("passes") < int(most), F.col("budget")).otherwise(0).alias("budget")
    )

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ignore_index=True)
        has = pdf["size"].to_numpy() > 0
        pdf["more"] = np.int64(0)
        pdf.loc[has, "more"] = fit_budget(pdf["size"].to_numpy()[has], pdf["n"].to_numpy()[has], int(pdf["budget"].iloc[0]))
        return pdf.drop(columns=["n", "budget"])

    kind = docs.schema[source_col].dataType.simpleString()
    plans = ready.groupBy("source").applyInPandas(plan, f"source {kind}, size long, source_size long, target double, passes long, more long")
    # how many of a length each hash range gives: the ranges in order, until the plan is met
    before = F.coalesce(F.sum("n").over(W.partitionBy("source", "size").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranged = counts.withColumn("before", before).alias("c").join(
        plans.alias("p"), F.col("c.source").eqNullSafe(F.col("p.source")) & (F.col("c.size") == F.col("p.size"))
    ).select(
        F.col("c.source").alias("source"), F.col("c.size").alias("size"), "part", "source_size", "target", "passes",
        F.greatest(F.lit(0), F.least(F.col("n"), F.col("more") - F.col("before"))).alias("more"),
    )
    ranked = rows.alias("d").join(
        ranged.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source")) & (F.col("d.size") == F.col("r.size")) & (F.col("d.part") == F.col("r.part"))
    ).select("id", "twin", F.col("d.source").alias("source"), F.col("d.size").alias("size"), F.col("d.part").alias("part"), "order", "source_size", "target", "passes", "more")
    place = F.row_number().over(W.partitionBy("source", "size", "part").orderBy("order", "id", "twin"))
    copies = (F.col("passes") + (place <= F.col("more")).cast("long")).alias("copies")
    return ranked.select("id", "twin", "source", "size", "source_size", "target", copies)


def _twin(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """Per row: id, size, source_size, target, taken (size times copies), then source and copies.

    Every document is taken floor(target / source_size) times (at most ``most`` times), and as many documents more,
    once each, as bring the source near its target. Null sources are one source; null texts have size 0 and are
    taken 0 words. Rows that repeat an id, text and source stand next to each other in the seeded order, so that which
    of them is taken makes no difference. An empty table gives an empty result.

    The plan of a source sees its lengths (distinct sizes and their counts), not its documents. What remains of its
    target after equal shares is met by the longest documents that fit, down to ``KNAPSACK`` words, which the dynamic
    programme settles exactly over all documents no longer than that; if all others are longer, at most half the
    shortest one's length stays unmet or is taken too much.
    """
    return _planned(docs, id_col, text_col, source_col, weights, share, most, seed).select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), F.col("source").alias(source_col), "copies"
    )


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7
) -> DataFrame:
    """The input's columns, each row as often as the mix takes it; documents without words stay once.

    Rows are told apart by id, text (a hash) and source; of rows that repeat all three, each takes its own share. Any
    names of columns may occur.
    """
    copies = F.when(F.col("size") == 0, 1).otherwise(F.col("copies"))
    plan = _planned(docs, id_col, text_col, source_col, weights, share, most, seed)
    # nulls are equal inside a struct; one key column lets the window below read what the join has dealt
    plan = plan.groupBy(F.struct("id", "twin", "source").alias("key")).agg(F.sort_array(F.collect_list(copies)).alias("copies"))
    rows = keyed(docs, key=F.struct(F.col(id_col).alias("id"), _twin(text_col).alias("twin"), F.col(source_col).alias("source")))
    joined = rows.join(plan.filter(F.element_at("copies", -1) > 0), "key")
    # rows that repeat each other are numbered where the join has brought them together
    turn = F.row_number().over(W.partitionBy("key").orderBy("key"))
    taken = joined.withColumn("times", F.when(F.size("copies") == 1, F.element_at("copies", 1)).otherwise(F.element_at("copies", turn)))
    return taken.filter("times > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")
