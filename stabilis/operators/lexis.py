"""Lexis: vocabulary diversity, vector-space and phrase similarity of text pairs.

Every measure of a single text is computed once per text, before pairs are made: its diversity and the counts of its
terms and phrases, as maps. The measures of a pair are expressions over the maps of both sides, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stabilis.functions.text import TERM, bound, mattr, mtld, ngrams, ratio_similarity, sentences, stripped, words

SMOOTHING = 1e-9
COUNTS = "map<string,bigint>"


def phrase_list(text: Column, n: int) -> Column:
    """All n-grams of a text, none of which crosses a sentence; a sentence is taken apart once."""
    return F.flatten(F.transform(F.transform(sentences(text), lambda s: words(s)), lambda w: ngrams(w, n)))


def phrase_counts(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """key, phrase, cnt."""
    return docs.select(key, F.explode(phrase_list(F.col(text), n)).alias("phrase")).groupBy(key, "phrase").agg(F.count(F.lit(1)).alias("cnt"))


def counts_of(terms: Column) -> Column:
    """A map of counts of a list of strings, made in its row: the list is sorted, and each run of equal ones is a count."""

    def runs(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda k: (k == 0) | (F.get(s, k) != F.get(s, k - 1)))
        ends = lambda at: F.transform(at, lambda k, p: (F.coalesce(F.get(at, p + 1), n) - k).cast("bigint"))
        return F.when(n > 0, bound(starts, lambda at: F.map_from_arrays(F.transform(at, lambda k: F.get(s, k)), ends(at))))

    return F.coalesce(bound(F.sort_array(terms), runs), F.create_map().cast(COUNTS))


def counted(texts: DataFrame, **lists: Column) -> DataFrame:
    """The texts with a map of counts for each named list of strings. Nothing is shuffled."""
    return texts.select(*[c for c in texts.columns if c not in lists], *[counts_of(c).alias(n) for n, c in lists.items()])


def both_counts(one: Column, two: Column) -> Column:
    """Array of (a, b): counts of every term of either side, zero where it is missing."""
    zero = F.lit(0).cast("bigint")
    return F.map_values(F.map_zip_with(one, two, lambda _, a, b: F.struct(F.coalesce(a, zero).cast("double").alias("a"), F.coalesce(b, zero).cast("double").alias("b"))))


def _total(rows: Column, value) -> Column:
    return F.aggregate(rows, F.lit(0.0), lambda acc, r: acc + value(r))


def divergence(one: Column, two: Column) -> Column:
    """Jensen-Shannon divergence (base 2, clamped to 0..1) of the smoothed distributions of two maps of counts.

    Every phrase of either side gets the smoothing on both. One side without phrases gives 1; none at all null.
    """

    def found(rows: Column) -> Column:
        def of(sums: Column) -> Column:
            def part(r: Column) -> Column:
                p, q = (r["a"] + SMOOTHING) / (sums["a"] + sums["v"]), (r["b"] + SMOOTHING) / (sums["b"] + sums["v"])
                return (p * F.log2(2 * p / (p + q)) + q * F.log2(2 * q / (p + q))) / 2

            unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), _total(rows, part)))
            return F.when(F.size(rows) == 0, None).when((sums["a"] == 0) | (sums["b"] == 0), 1.0).otherwise(unit)

        sums = F.struct(_total(rows, lambda r: r["a"]).alias("a"), _total(rows, lambda r: r["b"]).alias("b"), (F.size(rows) * F.lit(SMOOTHING)).alias("v"))
        return bound(sums, of)

    return bound(both_counts(one, two), found)


def cosine(one: Column, two: Column) -> Column:
    """Cosine of raw-count vectors (maps) weighted by smooth idf over the two texts of the pair.

    Terms of one side weigh 1 + ln 1.5, shared ones 1. One side without terms gives 0; none at all null.
    """

    def found(rows: Column) -> Column:
        weigh = lambda r: F.when((r["a"] > 0) & (r["b"] > 0), 1.0).otherwise(1 + F.log(F.lit(1.5)))
        square = lambda c: F.sqrt(_total(rows, lambda r: (r[c] * weigh(r)) * (r[c] * weigh(r))))
        dot = _total(rows, lambda r: r["a"] * r["b"])
        return F.when(F.size(rows) > 0, F.coalesce(F.try_divide(dot, square("a") * square("b")), F.lit(0.0)))

    return bound(both_counts(one, two), found)


def overlap_f1(one: Column, two: Column) -> Column:
    """F1 of greedy matching where tokens are alike only if equal: the shares of either side's tokens (maps of counts)
    that the other side has too. 0 if a side is empty."""

    def found(rows: Column) -> Column:
        share = lambda c, o: F.coalesce(F.try_divide(_total(rows, lambda r: F.when(r[o] > 0, r[c]).otherwise(0.0)), _total(rows, lambda r: r[c])), F.lit(0.0))
        return bound(F.struct(share("a", "b").alias("p"), share("b", "a").alias("r")), lambda s: F.coalesce(F.try_divide(2 * s["p"] * s["r"], s["p"] + s["r"]), F.lit(0.0)))

    return bound(both_counts(one, two), found)


def lexical_columns(responses: DataFrame, keys: list[str], text: str = "response", window: int = 25) -> DataFrame:
    """What the pair measures need of each text: its diversity (mattr), and counts (maps) of terms, grams2, grams3. The
    other columns, ``keys`` among them, stay."""
    clean = stripped(F.coalesce(F.col(text), F.lit("")))
    counts = counted(responses, terms=words(clean, TERM), grams2=phrase_list(clean, 2), grams3=phrase_list(clean, 3))
    return counts.withColumn("mattr", mattr(words(clean), window))


def lexical_similarity(pairs: DataFrame, keys: list[str], size: int = 99) -> DataFrame:
    """keys, mattr_sim, tfidf, phrase_sim, lex from pairs that carry ``lexical_columns`` with suffixes _1 and _2.

    lex = 0.8 * mean(diversity similarity, tfidf) + 0.2 * mean(1 - divergence of 2- and 3-grams). From a text size of
    100 on, diversity is compared by MTLD (columns mtld_1, mtld_2 must be there), else by MATTR.
    """
    if size >= 100:
        diversity = ratio_similarity(F.col("mtld_1"), F.col("mtld_2"))
    else:
        diversity = 1 - F.abs(F.col("mattr_1") - F.col("mattr_2"))
    apart = lambda n: F.coalesce(divergence(F.col(f"{n}_1"), F.col(f"{n}_2")), F.lit(1.0))
    parts = pairs.select(
        *keys, diversity.alias("mattr_sim"), F.coalesce(cosine(F.col("terms_1"), F.col("terms_2")), F.lit(0.0)).alias("tfidf"), ((2 - apart("grams2") - apart("grams3")) / 2).alias("phrase_sim")
    )
    return parts.withColumn("lex", 0.8 * (F.col("mattr_sim") + F.col("tfidf")) / 2 + 0.2 * F.col("phrase_sim"))


def with_mtld(responses: DataFrame, text: str = "response") -> DataFrame:
    return responses.withColumn("mtld", mtld(words(F.col(text))))
