"""Queries over parts of texts: paragraphs, sections, cleaned answers, names, parses in CoNLL-U and token scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from stabilis.functions import text as T
from stabilis.operators import organization, pairs
from stabilis.sources import tables

#: Responses that each essay and prompt should have in ``missing_responses``.
WANTED = 5
#: Names of the sections that ``section_pairs`` writes and reads, and the column each one holds.
SECTIONS = {"I": "doc_id", "II": "lang", "III": "source", "IV": "n_chars"}


def paragraphs(docs):
    """doc_id, p, paragraph."""
    return docs.select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("p", "paragraph"))


def flat_sentences(docs):
    """doc_id, s, sentence, where line breaks do not end a sentence."""
    return docs.select("doc_id", F.posexplode(T.flat_sentences(F.col("text"))).alias("s", "sentence"))


def cleaned_answers(turns):
    """conv_id, turn, answer: each turn behind a thought of two lines, with a stray tag after it, cleaned again."""
    told = F.concat(F.lit("<think>first\n"), F.col("role"), F.lit("</think> "), F.col("text"), F.lit("</think>\n"))
    return turns.select("conv_id", "turn", T.without_thoughts(told).alias("answer"))


def flattened_answers(docs):
    """doc_id, answer: the string fields of a JSON object joined; null where one is missing."""
    return docs.select("doc_id", T.flattened_json(F.to_json(F.struct("lang", "source", "text")), ["lang", "source", "text"]).alias("answer"))


def short_names(docs):
    """doc_id, name, shown: short file names and numbers of fixed places."""
    path = F.concat_ws("_", "lang", F.lit("set"), "source", F.concat("doc_id", F.lit(".x.md")))
    return docs.select("doc_id", T.short_name(path).alias("name"), T.fixed(F.col("n_chars") / 8).alias("shown"))


def section_pairs(docs):
    """doc_id, section_1, body_1, section_2, body_2, place: pairs of the sections of a text with four headings."""
    parts = [x for name, c in SECTIONS.items() for x in (F.lit(f"## {name}"), F.coalesce(F.col(c).cast("string"), F.lit("none")))]
    return pairs.section_pairs(tables.sections(docs.select("doc_id", F.array_join(F.array(*parts), "\n").alias("text")), tuple(SECTIONS), "doc_id"), "doc_id")


def missing_responses(responses):
    return pairs.missing_responses(responses.select("essay_file").distinct(), WANTED, responses)


def conllu_tokens(tokens):
    """Tokens written as CoNLL-U, one text per response, and read again; the root's head is 0."""
    cells = [F.col("token_id").cast("string"), F.col("text"), F.lower("text"), F.col("upos"), F.lit("_"), F.lit("_"), F.coalesce(F.col("head_token_id"), F.lit(0)).cast("string"), F.col("dependency_relation"), F.lit("_"), F.lit("_")]
    line = F.struct("token_id", F.concat_ws("\t", *cells).alias("line"))
    whole = tokens.groupBy("rid", "sentence_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), "\n").alias("body"))
    block = F.struct("sentence_id", F.concat(F.lit("# sent_id = "), F.col("sentence_id"), F.lit("\n"), F.col("body")).alias("block"))
    texts = whole.groupBy("rid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(block)), lambda x: x["block"]), "\n\n").alias("conllu"))
    return tables.parse_conllu(texts, "rid", "conllu").drop("lemma", "xpos").na.fill({"head_token_id": 0})


def greedy_token_scores(embeddings):
    """pair_id, precision, recall, f1 of texts of two tokens: vectors n and n + 1 against n + 2 and n + 3."""
    at = lambda k: embeddings.select((F.col("vec_id") - k).alias("pair_id"), F.col("embedding").alias(f"e{k}"))
    rows = at(0)
    for k in (1, 2, 3):
        rows = rows.join(at(k), "pair_id")
    weights = lambda *w: F.array(*[F.lit(x).cast("float") for x in w])
    rows = rows.select("pair_id", F.array("e0", "e1").alias("cand"), F.array("e2", "e3").alias("ref"), weights(1, 2).alias("cand_idf"), weights(3, 1).alias("ref_idf"))
    return organization.greedy_token_scores(rows, 0.25)
