"""Canonical response pairs: enumeration, coverage and resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stabilis.sources.tables import KEYS


RESPONSE = ["essay_file", "prompt", "response_index"]
#: Responses of an essay that travel together.
BLOCK = 64


def responses_from_turns(turns: DataFrame, k: int | None = None) -> DataFrame:
    """Responses from conversation turns: user turns answer prompt A, assistant turns B, numbered in order.

    All turns of all conversations count, unless ``k`` asks for the balanced design: the first k of each prompt, of
    conversations that have so many. Ties of turn numbers are ordered by text.
    """
    rows = turns.filter(F.col("role").isin("user", "assistant")).select(
        F.col("conv_id").cast("string").alias("essay_file"),
        F.when(F.col("role") == "user", "A").otherwise("B").alias("prompt"),
        F.row_number().over(W.partitionBy("conv_id", "role").orderBy("turn", "text")).alias("response_index"),
        F.col("text").alias("response"),
    )
    if k is None:
        return rows
    kept = rows.filter(F.col("response_index") <= k)
    full = kept.groupBy("essay_file").count().filter(F.col("count") == 2 * k).select("essay_file")
    return kept.join(full, "essay_file", "left_semi")


def packed(pairs: DataFrame) -> DataFrame:
    """The pairs with one number ``pair`` instead of prompts and indices: unique inside an essay, see ``unpacked``."""
    bit = lambda c: (F.col(c) == "B").cast("long")
    number = ((bit("prompt_1") * 2 + bit("prompt_2")) * (1 << 60)) + F.col("response_index_1").cast("long") * (1 << 30) + F.col("response_index_2")
    rest = [c for c in pairs.columns if c not in KEYS]
    return pairs.select("essay_file", number.alias("pair"), *rest)


def unpacked(rows: DataFrame) -> DataFrame:
    """Rows of ``packed`` pairs with their five keys again."""
    part = lambda shift, bits: F.shiftright("pair", shift).bitwiseAND(F.lit((1 << bits) - 1))
    letter = lambda at: F.when(part(at, 1) == 1, "B").otherwise("A")
    keys = [letter(61).alias("prompt_1"), part(30, 30).cast("int").alias("response_index_1"), letter(60).alias("prompt_2"), part(0, 30).cast("int").alias("response_index_2")]
    return rows.select("essay_file", *keys, *[c for c in rows.columns if c not in ("essay_file", "pair")])


def _side(responses: DataFrame, n: int, carry) -> DataFrame:
    """The responses as side ``n`` of pairs."""
    return responses.select("essay_file", F.col("prompt").alias(f"prompt_{n}"), F.col("response_index").alias(f"response_index_{n}"), *[F.col(c).alias(f"{c}_{n}") for c in carry])


def _canonical() -> Column:
    same = (F.col("prompt_1") == F.col("prompt_2")) & (F.col("response_index_1") <= F.col("response_index_2"))
    across = (F.col("prompt_1") == "A") & (F.col("prompt_2") == "B")
    return same | across


def canonical_pairs(responses: DataFrame, *carry: str) -> DataFrame:
    """Keys and comparison type of AA and BB (i <= j, self pairs included) and AB (all); ``carry`` columns of both
    sides follow with suffixes _1 and _2. One equi-join on the essay."""
    both = _side(responses, 1, carry).join(_side(responses, 2, carry), "essay_file")
    return both.filter(_canonical()).withColumn("comparison_type", F.concat("prompt_1", "prompt_2"))


def wanted_pairs(responses: DataFrame, wanted: DataFrame, *carry: str) -> DataFrame:
    """Canonical pairs of the wanted keys only, with ``carry`` columns of both sides.

    An essay's responses meet by blocks of 64 places: the first side brings its wanted places of a block as the bits of a
    number. What is carried is shuffled once for each block of the other side, not for each pair.
    """
    place = lambda n: F.col(f"response_index_{n}").cast("long") * 2 + (F.col(f"prompt_{n}") == "B").cast("long")
    at = place(2).bitwiseAND(F.lit(63)).cast("int")
    rows = wanted.filter(_canonical()).select(*KEYS, *[F.shiftright(place(n), 6).alias(f"block_{n}") for n in (1, 2)], at.alias("at"))
    blocks = ["essay_file", "block_1", "block_2"]
    first, second = ["essay_file", "prompt_1", "response_index_1"], ["essay_file", "prompt_2", "response_index_2"]
    bits = rows.groupBy(*first, *blocks[1:]).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at"))).alias("bits"))
    left = _side(responses, 1, carry).join(bits, first)
    right = _side(responses, 2, carry).join(rows.select(*second, *blocks[1:], "at").distinct(), second)
    both = left.join(right, blocks).filter(_canonical() & (F.getbit("bits", "at") == 1))
    return both.drop(*blocks[1:], "bits", "at").withColumn("comparison_type", F.concat("prompt_1", "prompt_2"))


def paired_blocks(responses: DataFrame, *carry: str, block: int = BLOCK) -> DataFrame:
    """essay_file, members, others: an essay's responses in blocks (arrays of prompt, response_index and ``carry``), and each
    two blocks of an essay as one row; where a block meets itself, ``others`` is null.

    What is carried is copied once for each other block of the essay and not for each pair, and a task holds two blocks at a
    time. An essay of one block stays where it is; the pairs of blocks of a larger one are dealt one by one.
    """
    essay = W.partitionBy("essay_file")
    unit = responses.withColumn("n", F.row_number().over(essay.orderBy("prompt", "response_index")) - 1).withColumn("size", F.count(F.lit(1)).over(essay))
    member = F.struct("prompt", "response_index", *carry)
    blocks = unit.groupBy("essay_file", F.floor(F.col("n") / block).cast("int").alias("b"), F.ceil(F.col("size") / block).cast("int").alias("of")).agg(F.collect_list(member).alias("members"))
    small, large = blocks.filter("of = 1"), blocks.filter("of > 1")
    spark = responses.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # (dealt to a given number of tasks before they are joined: dealt anew after it, the same keys would not be shuffled again,
    # and the join's own shuffles shrink to a task or two, as there is far more to compute than to shuffle)
    dealt = lambda blocks: blocks.repartition(tasks, "essay_file", "b", "c")
    left = dealt(large.select("essay_file", "b", F.explode(F.expr("sequence(b, of - 1)")).alias("c"), "members"))
    right = dealt(large.select("essay_file", F.explode(F.expr("sequence(0, b)")).alias("b"), F.col("b").alias("c"), F.col("members").alias("others")))
    apart = left.join(right, ["essay_file", "b", "c"]).select("essay_file", "members", F.when(F.col("b") < F.col("c"), F.col("others")).alias("others"))
    return small.select("essay_file", "members").withColumn("others", F.lit(None).cast(small.schema["members"].dataType)).unionByName(apart)


def expected_pairs(essays: DataFrame, k: int) -> DataFrame:
    """The pair keys that each essay must have."""
    numbers = F.sequence(F.lit(1), F.lit(k))
    prompts = F.array(F.lit("A"), F.lit("B"))
    ids = essays.select("essay_file", F.explode(prompts).alias("prompt")).withColumn("response_index", F.explode(numbers))
    return canonical_pairs(ids).select(*KEYS)


def coverage_violations(vectors: DataFrame, k: int) -> DataFrame:
    """Missing and unexpected pair keys (problem column)."""
    have = vectors.select(*KEYS)
    want = expected_pairs(have.select("essay_file").distinct(), k)
    return want.exceptAll(have).withColumn("problem", F.lit("missing")).unionAll(have.exceptAll(want).withColumn("problem", F.lit("unexpected")))


def missing_pairs(pairs: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs without a result yet."""
    return pairs.join(done.select(*KEYS), KEYS, "left_anti")


def missing_responses(essays: DataFrame, k: int, done: DataFrame) -> DataFrame:
    """Response keys of every essay and prompt that have no response yet."""
    want = essays.select("essay_file", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("prompt")).withColumn("response_index", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return want.join(done, ["essay_file", "prompt", "response_index"], "left_anti")


def section_pairs(sections: DataFrame, key: str = "filename") -> DataFrame:
    """The six pairs of four sections per text, in their fixed order."""
    order = [("I", "II"), ("I", "III"), ("II", "III"), ("I", "IV"), ("II", "IV"), ("III", "IV")]
    place = F.create_map(*[F.lit(x) for n, (a, b) in enumerate(order, 1) for x in (f"{a}-{b}", n)])
    a = sections.select(key, F.col("section").alias("section_1"), F.col("body").alias("body_1"))
    b = sections.select(key, F.col("section").alias("section_2"), F.col("body").alias("body_2"))
    return a.join(b, key).withColumn("place", place[F.concat_ws("-", "section_1", "section_2")]).filter(F.col("place").isNotNull())
