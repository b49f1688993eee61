"""Stand-in dependency tokens: hashed tags, relations and heads. They exercise the operators; they are no parse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stabilis.functions.text import sentences, words

TAGS = ["NOUN", "VERB", "ADJ", "ADV", "PRON", "PROPN", "AUX", "PUNCT"]
RELATIONS = ["nsubj", "obj", "amod", "advmod", "nmod", "conj", "advcl", "acl", "acl:relcl", "ccomp", "xcomp", "csubj", "compound", "appos", "nsubj:pass", "aux:pass"]


def synthetic_tokens(texts: DataFrame, key: str, text: str) -> DataFrame:
    """One row per word; heads are earlier words of the sentence, the first word is the root."""
    rows = texts.select(key, F.posexplode(sentences(F.col(text))).alias("s", "sentence"))
    rows = rows.select(key, (F.col("s") + 1).alias("sentence_id"), F.posexplode(words(F.col("sentence"))).alias("t", "text"))

    def draw(what):
        digest = F.md5(F.concat_ws("|", F.lit(what), key, "sentence_id", "t", "text").cast("binary"))
        return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")

    def pick(names, what):
        return F.element_at(F.array(*[F.lit(x) for x in names]), (draw(what) % len(names) + 1).cast("int"))

    return rows.select(
        key,
        "sentence_id",
        (F.col("t") + 1).alias("token_id"),
        "text",
        pick(TAGS, "u").alias("upos"),
        pick(RELATIONS, "r").alias("dependency_relation"),
        F.when(F.col("t") > 0, (F.pmod(draw("h"), F.col("t")) + 1).cast("int")).alias("head_token_id"),
    )
