"""Structure: dependency features of parsed texts, their similarity, clauses and pattern overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Relations counted per sentence, noun, modifiable word and verb, and the tags that make up each denominator.
PER_SENTENCE = ("advcl", "acl", "acl:relcl", "ccomp", "xcomp", "csubj")
PER_NOUN = ("amod", "compound", "nmod", "appos")
PER_VERB = ("nsubj:pass", "aux:pass", "nsubj", "obj")
NOUNS, MODIFIED, VERBS = ("NOUN", "PROPN", "PRON"), ("VERB", "ADJ", "ADV"), ("VERB", "AUX")
CONTENT = ("NOUN", "PROPN", "VERB", "ADJ", "ADV", "NUM")


def _name(relation: str) -> str:
    return relation.replace(":", "_")


RATES = (
    [f"{_name(r)}_per_sentence" for r in PER_SENTENCE]
    + [f"{_name(r)}_per_noun" for r in PER_NOUN]
    + ["advmod_per_verb_adj_adv"]
    + [f"{_name(r)}_per_verb" for r in PER_VERB]
    + ["average_token_depth", "embedded_clausal_nodes_per_sentence", "maximum_dependency_depth", "mean_dependency_distance", "maximum_dependency_distance", "long_dependency_rate_ge_5"]
)
TOTALS = [_name(r) for r in (*PER_SENTENCE, *PER_NOUN, "advmod", *PER_VERB)] + [
    "total_token_depth", "embedded_clausal_nodes", "maximum_dependency_depth_total", "total_dependency_distance", "maximum_dependency_distance_total", "long_dependencies_ge_5",
]


def _sentence_depths(nodes: Column) -> Column:
    """Depth of each node of a sentence (array of structs with token_id, kept and head_token_id, sorted by token_id).

    Heads become places in the array. Links are then doubled, a logarithmic number of times: a node's link leads twice as
    far each time, and its distance grows by that of the node it leads to. Where links never end (a cycle), the walk goes
    step by step until it meets a node again.
    """
    nowhere, size = F.lit(-1), F.size(nodes)

    def place(head: Column) -> Column:
        """Where a head is: in most sentences ids have no gaps, else it is looked for."""
        straight = (head - F.get(nodes, F.lit(0))["token_id"]).cast("int")
        direct = (straight >= 0) & F.coalesce(F.get(nodes, F.greatest(straight, F.lit(0)))["token_id"] == head, F.lit(False))
        sought = F.array_position(nodes["token_id"], head).cast("int") - 1
        found = F.when(direct, straight).otherwise(sought)
        return F.when(head.isNull(), nowhere).when((found >= 0) & F.get(nodes, F.greatest(found, F.lit(0)))["kept"], found).otherwise(nowhere)

    start = F.struct(
        F.transform(nodes, lambda n: place(n["head_token_id"])).alias("to"),
        F.transform(nodes, lambda n: n["head_token_id"].isNotNull().cast("int")).alias("far"),
    )

    def double(s: Column, _: Column) -> Column:
        return F.struct(
            F.transform(s["to"], lambda t: F.when(t < 0, t).otherwise(F.get(s["to"], t))).alias("to"),
            F.transform(s["far"], lambda d, i: d + F.coalesce(F.get(s["far"], F.nullif(F.get(s["to"], i), nowhere)), F.lit(0))).alias("far"),
        )

    rounds = F.ceil(F.log2(F.greatest(size, F.lit(2)).cast("double"))).cast("int")
    ended = F.aggregate(F.sequence(F.lit(1), rounds), start, double)

    def walked(s: Column, i: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            open_ = (at["to"] >= 0) & ~F.array_contains(at["seen"], at["to"])
            to = F.greatest(at["to"], F.lit(0))
            return F.struct(
                F.when(open_, F.get(s["to"], to)).otherwise(nowhere).alias("to"),
                F.when(open_, at["far"] + F.get(s["far"], to)).otherwise(at["far"]).alias("far"),
                F.when(open_, F.concat(at["seen"], F.array(to))).otherwise(at["seen"]).alias("seen"),
            )

        first = F.struct(F.get(s["to"], i).alias("to"), F.get(s["far"], i).alias("far"), F.array(i).alias("seen"))
        return F.aggregate(F.sequence(F.lit(1), size), first, step, lambda at: at["far"])

    either = lambda s, e: F.transform(e["far"], lambda d, i: F.when(F.get(e["to"], i) < 0, d).otherwise(walked(s, i)))
    # (both states are bound once, as one element arrays)
    return F.flatten(F.transform(F.array(F.struct(start.alias("s"), ended.alias("e"))), lambda b: either(b["s"], b["e"])))


def with_depths(tokens: DataFrame, key: str) -> DataFrame:
    """The tokens that are not punctuation (key, sentence_id, token_id, upos, head_token_id, dependency_relation) with their
    depth in the sentence's tree. Dealt once by key; no Python.

    The root has depth 0. A head that is missing or punctuation counts as one hop and ends the walk, as does a node seen
    before. Of tokens that repeat an id, the first is the one that others hang on.
    """
    node = F.struct("token_id", (F.col("upos") != "PUNCT").alias("kept"), "head_token_id", "upos", "dependency_relation")
    sentences = tokens.repartition(key).groupBy(key, "sentence_id").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    deep = F.arrays_zip(F.col("nodes").alias("n"), _sentence_depths(F.col("nodes")).alias("depth"))
    rows = sentences.select(key, "sentence_id", F.explode(F.filter(deep, lambda x: x["n"]["kept"])).alias("x"))
    return rows.select(key, "sentence_id", "x.n.token_id", "x.n.upos", "x.n.head_token_id", "x.n.dependency_relation", "x.depth")


def depths(tokens: DataFrame, key: str) -> DataFrame:
    """key, sentence_id, token_id and depth of the tokens that are not punctuation; see ``with_depths``."""
    return with_depths(tokens, key).select(key, "sentence_id", "token_id", "depth")


def features(tokens: DataFrame, key: str, threshold: int = 5) -> DataFrame:
    """key, the 21 rates and the 21 totals, and the sizes (sentences, tokens, nouns, verbs)."""
    kept = with_depths(tokens, key)
    distance = F.abs(F.col("token_id") - F.col("head_token_id"))
    rel = F.col("dependency_relation")
    counts = [F.count_if(rel == r).alias(_name(r)) for r in (*PER_SENTENCE, *PER_NOUN, "advmod", *PER_VERB)]
    sums = kept.groupBy(key).agg(
        *counts,
        F.count_distinct("sentence_id").alias("sentences"),
        F.count(F.lit(1)).alias("tokens"),
        F.count_if(F.col("upos").isin(*NOUNS)).alias("nouns"),
        F.count_if(F.col("upos").isin(*MODIFIED)).alias("modified"),
        F.count_if(F.col("upos").isin(*VERBS)).alias("verbs"),
        F.sum("depth").alias("total_token_depth"),
        F.max("depth").alias("maximum_dependency_depth_total"),
        F.coalesce(F.sum(distance), F.lit(0)).alias("total_dependency_distance"),
        F.coalesce(F.max(distance), F.lit(0)).alias("maximum_dependency_distance_total"),
        F.count(distance).alias("distances"),
        F.count_if(distance >= threshold).alias("long_dependencies_ge_5"),
    )
    sums = sums.withColumn("embedded_clausal_nodes", sum((F.col(_name(r)) for r in PER_SENTENCE), F.lit(0)))
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    rates = (
        [per(_name(r), "sentences") for r in PER_SENTENCE]
        + [per(_name(r), "nouns") for r in PER_NOUN]
        + [per("advmod", "modified")]
        + [per(_name(r), "verbs") for r in PER_VERB]
        + [
            per("total_token_depth", "tokens"), per("embedded_clausal_nodes", "sentences"), F.col("maximum_dependency_depth_total").cast("double"),
            per("total_dependency_distance", "distances"), F.col("maximum_dependency_distance_total").cast("double"), per("long_dependencies_ge_5", "distances"),
        ]
    )
    return sums.select(key, *[r.alias(n) for r, n in zip(rates, RATES)], *[F.col(t).cast("double").alias(t) for t in TOTALS], "sentences", "tokens", "nouns", "verbs")


def feature_similarity(a: Column, b: Column) -> Column:
    """1 where both are 0, else 1 - |a - b| / the larger magnitude."""
    return F.coalesce(1 - F.try_divide(F.abs(a - b), F.greatest(F.abs(a), F.abs(b))), F.lit(1.0))


def structure_similarity(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, normalized, total, struct from pairs whose two sides carry ``features`` with suffixes _1 and _2."""
    mean = lambda names: sum((feature_similarity(F.col(f"{n}_1"), F.col(f"{n}_2")) for n in names), F.lit(0.0)) / len(names)
    return pairs.select(*keys, mean(RATES).alias("normalized"), mean(TOTALS).alias("total")).withColumn("struct", (F.col("normalized") + F.col("total")) / 2)


def feature_table(pairs: DataFrame, keys: list[str], names=tuple(RATES)) -> DataFrame:
    """keys, feature, value_1, value_2, similarity: the comparison in long form."""
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"{n}_1").alias("value_1"), F.col(f"{n}_2").alias("value_2")) for n in names])
    return pairs.select(*keys, F.explode(rows).alias("f")).select(*keys, "f.*").withColumn("similarity", feature_similarity(F.col("value_1"), F.col("value_2")))


def multiset_jaccard(left: DataFrame, right: DataFrame, keys: list[str], item: str) -> DataFrame:
    """keys, jaccard: sum of smaller over sum of larger counts of each item; full join on the item."""
    a = left.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("a"))
    b = right.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("b"))
    both = a.join(b, [*keys, item], "full").na.fill(0, ["a", "b"])
    return both.groupBy(*keys).agg(F.sum(F.least("a", "b")).alias("low"), F.sum(F.greatest("a", "b")).alias("high")).select(*keys, (F.col("low") / F.col("high")).alias("jaccard"))


def map_jaccard(one: Column, two: Column) -> Column:
    """Multiset Jaccard of two maps of counts (bigint); null if both are empty."""
    zero = F.lit(0).cast("bigint")
    low = F.map_values(F.map_zip_with(one, two, lambda _, a, b: F.least(F.coalesce(a, zero), F.coalesce(b, zero))))
    high = F.map_values(F.map_zip_with(one, two, lambda _, a, b: F.greatest(F.coalesce(a, zero), F.coalesce(b, zero))))
    total = lambda x: F.aggregate(x, zero, lambda s, v: s + v)
    return F.try_divide(total(low), total(high))


def patterns(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pattern (head tag, relation, tag) of tokens whose head is in the same clause; no punctuation."""
    kept = tokens.filter(F.col("upos") != "PUNCT")
    heads = kept.select(*keys, F.col("token_id").alias("head_token_id"), F.col("upos").alias("head_upos"))
    return kept.join(heads, [*keys, "head_token_id"]).select(*keys, F.concat_ws("|", "head_upos", "dependency_relation", "upos").alias("pattern"))


def matched_patterns(matches: DataFrame, left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Per match (keys, i, j): structurality (multiset Jaccard of patterns, 0 without any), the number of patterns and
    of pattern types of either side, and of types they share.

    ``left`` and ``right`` hold keys, pos and pattern (see ``patterns``). Patterns are counted per unit before they
    meet a match, so a unit with several matches is counted once.
    """
    count = lambda d, side, n: d.groupBy(*keys, F.col("pos").alias(side), "pattern").agg(F.count(F.lit(1)).alias(n))
    pairs = matches.select(*keys, "i", "j").distinct()
    a = pairs.join(count(left, "i", "a"), [*keys, "i"]).withColumn("b", F.lit(0).cast("long"))
    b = pairs.join(count(right, "j", "b"), [*keys, "j"]).withColumn("a", F.lit(0).cast("long"))
    both = a.unionByName(b).groupBy(*keys, "i", "j", "pattern").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sums = both.groupBy(*keys, "i", "j").agg(
        F.sum(F.least("a", "b")).alias("low"), F.sum(F.greatest("a", "b")).alias("high"), F.sum("a").alias("n_patterns_a"), F.sum("b").alias("n_patterns_b"),
        F.count_if(F.col("a") > 0).alias("n_pattern_types_a"), F.count_if(F.col("b") > 0).alias("n_pattern_types_b"), F.count_if(F.least("a", "b") > 0).alias("n_shared_pattern_types"),
    )
    counts = ["n_patterns_a", "n_patterns_b", "n_pattern_types_a", "n_pattern_types_b", "n_shared_pattern_types"]
    rows = pairs.join(sums, [*keys, "i", "j"], "left")
    return rows.select(*keys, "i", "j", F.coalesce(F.try_divide("low", "high"), F.lit(0.0)).alias("structurality"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts])
