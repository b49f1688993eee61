"""Named queries over the driver's tables and the SQL each one is checked against.

Doubles are rounded to six places on both sides. Stand-ins, where no model is at hand: dependency tokens are drawn from
hashes of words (not a linguistic parse), a response's embedding is a row of ``embeddings`` that a hash of it picks, and
token vectors are digests of words and their neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stabilis.functions import text as T
from stabilis.operators import clauses, contextual, lexis, matching, organization, pairs, scoring, stability, structure, validation
from stabilis.plans import oracle, texts
from stabilis.plans.checkpoint import checkpointed, stored
from stabilis.plans.tokens import synthetic_tokens
from stabilis.sources import tables
from stabilis.sources.tables import COMPONENTS, KEYS

#: Responses of each prompt in the balanced design, replicates and seed of the bootstrap.
K, REPLICATES, SEED = 3, 5_000, 11
#: What tells packed pairs apart.
PAIR = ["essay_file", "pair"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of texts that its file deals to fewer tasks than there are cores is dealt anew (a large one is not)."""
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    few = name in ("documents", "conversations") and rows.rdd.getNumPartitions() < cores
    return rows.repartition(cores) if few else rows


def _rounded(c) -> Column:
    """To six places, halves away from zero, by the doubles' own arithmetic (as DuckDB does), without decimals."""
    x = F.col(c)
    return F.when(F.abs(x) < 1e9, F.signum(x) * (F.floor(F.abs(x) * 1e6 + 0.5) / 1e6) + 0.0).otherwise(F.round(x, 6))


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[_rounded(c).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def responses(spark, sf_dir):
    """All turns of all conversations."""
    return pairs.responses_from_turns(_table(spark, sf_dir, "conversations"))


def balanced_responses(spark, sf_dir):
    """The balanced design that validation asks for: K responses of each prompt."""
    return pairs.responses_from_turns(_table(spark, sf_dir, "conversations"), K)


def _pairs(spark, sf_dir, *carry, of=responses):
    return pairs.canonical_pairs(of(spark, sf_dir), *carry)


def canonical_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select(*KEYS, "comparison_type")


def response_violations(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations")
    rows = turns.select(
        F.col("conv_id").cast("string").alias("essay_file"), F.when(F.col("role") == "user", "A").when(F.col("role") == "assistant", "B").otherwise(F.col("role")).alias("prompt"),
        F.col("turn").cast("int").alias("response_index"), F.col("text").alias("response"),
    )
    return tables.response_violations(rows, K)


def _done(spark, sf_dir):
    return _pairs(spark, sf_dir, of=balanced_responses).filter("comparison_type = 'AA'")


def pair_coverage_violations(spark, sf_dir):
    return pairs.coverage_violations(_done(spark, sf_dir), K)


def resume_missing_pairs(spark, sf_dir):
    return pairs.missing_pairs(_pairs(spark, sf_dir, of=balanced_responses), _done(spark, sf_dir)).select(*KEYS, "comparison_type")


def mattr(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", T.words(F.col("text")).alias("w"))
    # ratios of small integers often lie half-way between two roundings, which engines settle differently
    return docs.select("doc_id", F.size("w").cast("long").alias("tokens"), (F.floor(T.mattr(F.col("w")) * 1000000 + 0.5) / 1000000.0).alias("mattr"))


def mtld(spark, sf_dir):
    return rounded(_table(spark, sf_dir, "documents").select("doc_id", T.mtld(T.words(F.col("text"))).alias("mtld")))


def _ngrams(n):
    return lambda spark, sf_dir: lexis.phrase_counts(_table(spark, sf_dir, "documents"), "doc_id", "text", n)


def _lexical_pairs(spark, sf_dir):
    return pairs.canonical_pairs(lexis.lexical_columns(responses(spark, sf_dir), pairs.RESPONSE), "mattr", "terms", "grams2", "grams3")


def phraseology_jsd(spark, sf_dir):
    apart = lambda n: lexis.divergence(F.col(f"grams{n}_1"), F.col(f"grams{n}_2")).alias(f"jsd{n}")
    return rounded(_lexical_pairs(spark, sf_dir).select(*KEYS, apart(2), apart(3)).filter("jsd2 IS NOT NULL"))


def tfidf_cosine_pairs(spark, sf_dir):
    found = _lexical_pairs(spark, sf_dir).select(*KEYS, lexis.cosine(F.col("terms_1"), F.col("terms_2")).alias("tfidf"))
    return rounded(found.filter("tfidf IS NOT NULL"))


def lexical_similarity(spark, sf_dir):
    return rounded(lexis.lexical_similarity(_lexical_pairs(spark, sf_dir), KEYS))


def embedding_meaning(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    following = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rounded(e.join(following, "vec_id").select("vec_id", organization.cosine_affine(F.col("embedding"), F.col("other")).alias("meaning")))


def _matrix(spark, sf_dir, window=1):
    """Cells of every pair under (essay_file, pair); of windows of sentences, if a size is given."""
    return organization.text_cells(_sentence_terms(spark, sf_dir), window)


def sentence_matrix_tfidf(spark, sf_dir):
    return rounded(pairs.unpacked(_matrix(spark, sf_dir)))


def sliding_matrix(spark, sf_dir):
    return rounded(pairs.unpacked(_matrix(spark, sf_dir, 3)))


def _sentence_terms(spark, sf_dir):
    """Responses with the terms of each sentence."""
    terms = F.transform(T.sentences(F.col("response")), lambda s: T.words(s, T.TERM))
    return responses(spark, sf_dir).select(*pairs.RESPONSE, terms.alias("s"))


def _organization(spark, sf_dir):
    return organization.soft_texts(_sentence_terms(spark, sf_dir))


def soft_organization(spark, sf_dir):
    return rounded(pairs.unpacked(_organization(spark, sf_dir)))


def _tokens(spark, sf_dir):
    rows = responses(spark, sf_dir).withColumn("rid", F.concat_ws("/", "essay_file", "prompt", "response_index"))
    return synthetic_tokens(rows, "rid", "response")


def structure_features(spark, sf_dir):
    return rounded(structure.features(_tokens(spark, sf_dir), "rid"))


def _structure(spark, sf_dir):
    """Similarity of the features of both sides; a response without tokens has features 0."""
    names = [*structure.RATES, *structure.TOTALS]
    found = structure.features(_tokens(spark, sf_dir), "rid")
    ids = responses(spark, sf_dir).withColumn("rid", F.concat_ws("/", "essay_file", "prompt", "response_index"))
    return structure.structure_similarity(pairs.canonical_pairs(ids.drop("response").join(found, "rid", "left").na.fill(0.0, names), *names), KEYS)


def structure_similarity(spark, sf_dir):
    return rounded(_structure(spark, sf_dir))


def multiset_jaccard(spark, sf_dir):
    rows = lexis.counted(responses(spark, sf_dir), w=T.words(F.col("response")))
    both = pairs.canonical_pairs(rows, "w").select(*KEYS, structure.map_jaccard(F.col("w_1"), F.col("w_2")).alias("jaccard"))
    return rounded(both.filter("jaccard IS NOT NULL"))


def _contextual(spark, sf_dir):
    """Best cosines of token vectors, weighed by idf over all responses; a hashed stand-in for a token encoder."""
    return contextual.contextual_similarity(contextual.token_vectors(responses(spark, sf_dir)))


def contextual_similarity(spark, sf_dir):
    return rounded(_contextual(spark, sf_dir))


def _meaning(spark, sf_dir):
    """The contextual half, and the similarity of embeddings: without a model at hand, the embedding of a response is the
    row of ``embeddings`` that a hash of its text picks."""
    table = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    size = table.agg(F.count(F.lit(1)).alias("size"))
    picked = F.conv(F.substring(F.md5(F.coalesce(F.col("response"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") % F.col("size")
    rows = responses(spark, sf_dir).crossJoin(F.broadcast(size)).withColumn("vec_id", picked).join(table, "vec_id", "left")
    both = pairs.canonical_pairs(rows.select(*pairs.RESPONSE, "embedding"), "embedding")
    half = F.coalesce(organization.cosine_affine(F.col("embedding_1"), F.col("embedding_2")), F.lit(0.0))
    return both.select(*KEYS, half.alias("half")).join(_contextual(spark, sf_dir), KEYS).select(*KEYS, organization.meaning(F.col("f1"), F.col("half")).alias("meaning"))


def meaning(spark, sf_dir):
    return rounded(_meaning(spark, sf_dir))


def olms_vectors(spark, sf_dir):
    """The vector of every pair: organization, lexis, meaning and structure of its two texts, to twelve places."""
    counts = responses(spark, sf_dir).groupBy("essay_file").agg(F.max("response_index").alias("response_count"))
    rows = _pairs(spark, sf_dir).join(counts, "essay_file").select(*KEYS, "comparison_type", "response_count")
    lex = lexis.lexical_similarity(_lexical_pairs(spark, sf_dir), KEYS).select(*KEYS, "lex")
    for part in (pairs.unpacked(_organization(spark, sf_dir)), lex, _meaning(spark, sf_dir), _structure(spark, sf_dir).select(*KEYS, "struct")):
        rows = rows.join(part, KEYS, "left")
    return rows.select(*KEYS, "comparison_type", "response_count", *[F.round(F.coalesce(c, F.lit(0.0)), 12).alias(c) for c in COMPONENTS])


def vectors(spark, sf_dir):
    """The vector table that statistics read: scored once, then stored."""
    return stored(spark, "vectors", [f"{sf_dir}/{t}.parquet" for t in ("conversations", "embeddings")], lambda: olms_vectors(spark, sf_dir))


def vector_violations(spark, sf_dir):
    bad = vectors(spark, sf_dir).withColumn("response_count", F.lit(99)).withColumn("comparison_type", F.when(F.col("response_index_2") == K, "XX").otherwise(F.col("comparison_type")))
    return tables.vector_violations(bad)


def _of_vectors(f):
    return lambda spark, sf_dir: rounded(f(vectors(spark, sf_dir)))


def _bootstrap(f):
    """A query over vectors, replicates and seed."""
    return lambda spark, sf_dir: rounded(f(vectors(spark, sf_dir), REPLICATES, SEED))


def _within_intervals(v, replicates, seed):
    return stability.replicate_intervals(stability.within_replicates(v, replicates, seed), ["essay_file", "prompt"], stability.METRICS)


def _shift_intervals(v, replicates, seed):
    return stability.replicate_intervals(stability.shift_replicates(v, replicates, seed), ["essay_file"], stability.DELTAS, stability.DELTAS[1:])


def rescored_pairs(spark, sf_dir):
    """Lexical scores of all pairs: those of the first prompt from a store, the rest made anew."""
    rows, by = responses(spark, sf_dir), scoring.scorer("lexical")
    wanted = pairs.canonical_pairs(rows).select(*KEYS)
    made = stored(spark, "lexical", [f"{sf_dir}/conversations.parquet"], lambda: by(rows, wanted.filter("prompt_2 = 'A'")))
    return rounded(scoring.scored(rows, wanted, by, made))


def _sizes(spark, sf_dir):
    rows = responses(spark, sf_dir).withColumn("n", F.size(T.sentences(F.col("response"))))
    return pairs.packed(pairs.canonical_pairs(rows, "n")).select(*PAIR, F.col("n_1").alias("n_a"), F.col("n_2").alias("n_b"))


def _matches(spark, sf_dir):
    """The matcher's result over cells rounded to six places."""
    return matching.match_texts(_sentence_terms(spark, sf_dir))


def unit_matches(spark, sf_dir):
    return rounded(pairs.unpacked(_matches(spark, sf_dir)))


def matched_sentences(spark, sf_dir):
    """The matcher's result, scored once, then stored."""
    return stored(spark, "matches", [f"{sf_dir}/conversations.parquet"], lambda: _matches(spark, sf_dir))


def _best_matches(spark, sf_dir):
    """Each first-side sentence with its best cell: links that SQL can repeat."""
    cells = _matrix(spark, sf_dir).withColumn("score", F.round("score", 6)).filter("score > 0")
    best = cells.groupBy(*PAIR, "i").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("j"))).alias("b"))
    return best.select(*PAIR, "i", F.col("b.j").alias("j"), (-F.col("b.s")).alias("score"))


def _best_order(f):
    return lambda spark, sf_dir: rounded(pairs.unpacked(f(_best_matches(spark, sf_dir), _sizes(spark, sf_dir))))


def _order(f):
    return lambda spark, sf_dir: rounded(pairs.unpacked(f(matched_sentences(spark, sf_dir), _sizes(spark, sf_dir))))


def _clauses(strict):
    return lambda spark, sf_dir: clauses.split_clauses(_tokens(spark, sf_dir), "rid", strict).drop("token_ids")


def _clause_patterns(spark, sf_dir):
    found = clauses.clause_tokens(_tokens(spark, sf_dir), clauses.split_clauses(_tokens(spark, sf_dir), "rid"), "rid")
    return structure.patterns(found, ["rid", "sentence_id", "pos"]).select("rid", "pos", "pattern")


def clause_patterns(spark, sf_dir):
    """How often each pattern occurs in each loose clause."""
    return _clause_patterns(spark, sf_dir).groupBy("rid", "pos", "pattern").agg(F.count(F.lit(1)).alias("n"))


def _clause_parts(spark, sf_dir):
    """As tables, what ``matched_clause_patterns`` makes in blocks: cells of clauses of every pair, how many clauses both sides have, and patterns of clauses by response."""
    split = stored(spark, "clauses", [f"{sf_dir}/conversations.parquet"], lambda: clauses.split_clauses(_tokens(spark, sf_dir), "rid"))
    texts_of = split.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("sentence_id", "clause", "text"))).alias("c")).select("rid", F.col("c.text").alias("s"))
    rows = responses(spark, sf_dir).drop("response").withColumn("rid", F.concat_ws("/", "essay_file", "prompt", "response_index")).join(texts_of, "rid", "left")
    rows = rows.withColumns({"s": F.coalesce("s", F.array().cast("array<string>")), "text": F.struct(*pairs.RESPONSE), "n": F.size(F.coalesce("s", F.array().cast("array<string>")))})
    both = pairs.packed(pairs.canonical_pairs(rows.drop("s"), "text", "n", "rid")).withColumnsRenamed({"text_1": "one", "text_2": "two"})
    cells = organization.sentence_matrix(both, organization.sentence_terms(rows, ["text"], F.col("s")), PAIR)
    found = structure.patterns(clauses.clause_tokens(_tokens(spark, sf_dir), split, "rid"), ["rid", "sentence_id", "pos"]).select("rid", "pos", "pattern")
    return cells, both.select(*PAIR, "n_1", "n_2", "rid_1", "rid_2"), found


#: Share of the closeness of places in the score of two clauses, and the least score of a match.
POSITION, LEAST = 0.25, 0.3


def _clause_matches(cells, sizes):
    """Clauses matched by similarity blended with the closeness of their places."""
    place = lambda c, n: F.when(F.col(n) > 1, F.col(c) / (F.col(n) - 1)).otherwise(0.0)
    close = 1 - F.abs(place("i", "n_1") - place("j", "n_2"))
    score = F.round(matching.blended(F.col("score"), F.col("score"), close, POSITION), 6)
    return matching.match_units(cells.join(sizes, PAIR).select(*PAIR, "i", "j", score.alias("score")), PAIR, least=LEAST)


def _matched_patterns(cells, sizes, found):
    side = lambda n: sizes.select(*PAIR, F.col(f"rid_{n}").alias("rid")).join(found, "rid").select(*PAIR, "pos", "pattern")
    # (matches are read three times)
    return structure.matched_patterns(checkpointed(_clause_matches(cells, sizes)), side(1), side(2), PAIR)


def _clause_units(spark, sf_dir):
    """Responses with the terms and the patterns of each loose clause."""
    units = clauses.clause_units(_tokens(spark, sf_dir), "rid")
    texts_of = units.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("sentence_id", "clause", T.words(F.col("text"), T.TERM).alias("s"), F.col("patterns").alias("p")))).alias("c"))
    rows = responses(spark, sf_dir).drop("response").withColumn("rid", F.concat_ws("/", "essay_file", "prompt", "response_index")).join(texts_of, "rid", "left")
    return rows.select(*pairs.RESPONSE, *[F.coalesce(f"c.{x}", F.array().cast("array<array<string>>")).alias(x) for x in "sp"])


def matched_clause_patterns(spark, sf_dir):
    """Structure of matched clauses: texts to clauses, clauses to a matrix, matches, and the patterns both sides share. What
    texts have of their own is stored; ``_matched_patterns`` gives the same rows pair by pair."""
    made = stored(spark, "clause_units", [f"{sf_dir}/conversations.parquet"], lambda: _clause_units(spark, sf_dir))
    return rounded(pairs.unpacked(matching.match_patterns(made, POSITION, LEAST)))


def validation_edits(spark, sf_dir):
    found = validation.extracts(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return validation.edits(found, "doc_id")


def stratified_sample(spark, sf_dir):
    return validation.stratified_sample(_table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 10)


def sha256_digest(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(F.col("text"), 256).alias("digest"))


def derived_seed(spark, sf_dir):
    keys = responses(spark, sf_dir).drop("response")
    return keys.select("*", T.derived_seed(42, F.col("essay_file"), F.col("prompt"), F.col("response_index")).alias("seed"))


def text_sizes(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    t = F.col("text")
    return docs.select("doc_id", F.size(T.sentences(t)).cast("long").alias("sentences"), F.size(T.words(t)).cast("long").alias("words"), T.english_word_count(t).cast("long").alias("joined_words"))


def _parts(f, table="documents"):
    return lambda spark, sf_dir: rounded(f(_table(spark, sf_dir, table)))


def chart_intervals(spark, sf_dir):
    """Observed mean distance of each essay and prompt with its bootstrap interval."""
    v = vectors(spark, sf_dir)
    points = stability.within_stability(v).select("essay_file", "prompt", "mean_distance")
    bars = stability.replicate_intervals(stability.within_replicates(v, REPLICATES, SEED), ["essay_file", "prompt"], ["mean_distance"])
    return rounded(points.join(bars, ["essay_file", "prompt"]).select("essay_file", "prompt", "mean_distance", "low", "high"))


def chart_components(spark, sf_dir):
    """Panels of components: each essay's and prompt's mean of each component, under the essay's short name."""
    points = stability.within_stability(vectors(spark, sf_dir))
    panels = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(f"{c}_mean").alias("similarity")) for c in COMPONENTS])).alias("p")
    return rounded(points.select("essay_file", T.short_name(F.col("essay_file")).alias("name"), "prompt", panels).select("essay_file", "name", "prompt", "p.*"))


QUERIES = {
    "responses": responses,
    "response_violations": response_violations,
    "canonical_pairs": canonical_pairs,
    "pair_coverage_violations": pair_coverage_violations,
    "resume_missing_pairs": resume_missing_pairs,
    "mattr": mattr,
    "mtld": mtld,
    "ngram_counts_2": _ngrams(2),
    "ngram_counts_3": _ngrams(3),
    "phraseology_jsd": phraseology_jsd,
    "rescored_pairs": rescored_pairs,
    "tfidf_cosine_pairs": tfidf_cosine_pairs,
    "lexical_similarity": lexical_similarity,
    "embedding_meaning": embedding_meaning,
    "sentence_matrix_tfidf": sentence_matrix_tfidf,
    "sliding_matrix": sliding_matrix,
    "soft_organization": soft_organization,
    "structure_features": structure_features,
    "structure_similarity": structure_similarity,
    "multiset_jaccard": multiset_jaccard,
    "contextual_similarity": contextual_similarity,
    "meaning": meaning,
    "vectors": lambda spark, sf_dir: rounded(olms_vectors(spark, sf_dir)),
    "vector_violations": vector_violations,
    "vector_distances": _of_vectors(stability.vector_distances),
    "within_stability": _of_vectors(stability.within_stability),
    "between_stability": _of_vectors(lambda v: stability.between_stability(stability.within_stability(v))),
    "prompt_shift": _of_vectors(stability.prompt_shift),
    "overall_prompt_shift": _of_vectors(lambda v: stability.overall_shift(stability.prompt_shift(v))),
    "hotelling_t2": _of_vectors(lambda v: stability.hotelling(stability.prompt_shift(v))),
    "bootstrap_within": _bootstrap(stability.bootstrap_within),
    "bootstrap_shift": _bootstrap(stability.bootstrap_shift),
    "bootstrap_overall": _bootstrap(lambda v, n, seed: stability.bootstrap_overall(stability.bootstrap_shift(v, n, seed))),
    "within_intervals": _bootstrap(_within_intervals),
    "shift_intervals": _bootstrap(_shift_intervals),
    "chart_intervals": chart_intervals,
    "chart_components": chart_components,
    "kendall_tau_b": _best_order(lambda m, n: matching.kendall(m, PAIR)),
    "position_matching": _best_order(lambda m, n: matching.positions(m, n, PAIR)),
    "continuity": _best_order(lambda m, n: matching.continuity(m, n, PAIR)),
    "hard_organization": _order(lambda m, n: matching.organization_of_matches(m, n, PAIR)),
    "mean_match_score": _order(lambda m, n: matching.mean_over_matches(m, n, PAIR)),
    "clause_patterns": clause_patterns,
    "matched_clause_patterns": matched_clause_patterns,
    "unit_matches": unit_matches,
    "clause_split_loose": _clauses(False),
    "clause_split_strict": _clauses(True),
    "validation_edits": validation_edits,
    "stratified_sample": stratified_sample,
    "sha256_digest": sha256_digest,
    "derived_seed": derived_seed,
    "text_sizes": text_sizes,
    "paragraphs": _parts(texts.paragraphs),
    "flat_sentences": _parts(texts.flat_sentences),
    "cleaned_answers": _parts(texts.cleaned_answers, "conversations"),
    "flattened_answers": _parts(texts.flattened_answers),
    "short_names": _parts(texts.short_names),
    "section_pairs": _parts(texts.section_pairs),
    "greedy_token_scores": _parts(texts.greedy_token_scores, "embeddings"),
    "missing_responses": lambda spark, sf_dir: texts.missing_responses(responses(spark, sf_dir)),
    "conllu_tokens": lambda spark, sf_dir: texts.conllu_tokens(_tokens(spark, sf_dir)),
}

ORACLE_SQL = oracle.build(K, REPLICATES, SEED)
