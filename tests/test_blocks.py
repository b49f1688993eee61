"""Sentences of an essay's texts compared and matched block by block, against the matrix and the matcher over its cells."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stabilis.functions import text as T
from stabilis.operators import contextual, matching, organization, pairs

TEXTS = [
    ("e", "A", 1, "The cat sat on the mat. The dog lay on the log! Birds sing. Birds sing."), ("e", "A", 2, "A dog lay down.\nThe cat ran"), ("e", "A", 3, None), ("e", "B", 1, "!. a b. ?"),
    ("e", "B", 2, "Évidemment, le chat dort. Le chat dort. Le chien aussi."), ("e", "B", 3, "The cat sat on the mat. " * 5), ("f", "A", 1, ""), ("f", "B", 1, "alone here"), ("g", "B", 1, "the end"),
]


def cells_of(rows, places=6):
    rows = rows.withColumn("s", T.sentences(F.col("response"))).withColumn("text", F.struct(*pairs.RESPONSE)).withColumn("n", F.size("s"))
    both = pairs.packed(pairs.canonical_pairs(rows.drop("s"), "text", "n")).withColumnsRenamed({"text_1": "one", "text_2": "two"})
    cells = organization.sentence_matrix(both, organization.sentence_terms(rows, ["text"], F.col("s")), ["essay_file", "pair"])
    return cells if places is None else cells.withColumn("score", F.round("score", places))


@pytest.mark.parametrize("block,tile,together,least", [(64, 1 << 18, 1_024, 0.0), (2, 1 << 18, 3, 0.0), (1, 1, 1_024, 0.0), (64, 40, 2, 0.3)])
def test_matches_of_texts_are_those_of_their_cells(spark, monkeypatch, block, tile, together, least):
    monkeypatch.setattr(matching, "TILE", tile)
    monkeypatch.setattr(organization, "TILE", tile)
    monkeypatch.setattr(matching, "TOGETHER", together)
    rows = spark.createDataFrame(TEXTS, "essay_file string, prompt string, response_index int, response string").repartition(3)
    terms = F.transform(T.sentences(F.col("response")), lambda s: T.words(s, T.TERM))
    got = matching.match_texts(rows.select(*pairs.RESPONSE, terms.alias("s")), least=least, block=block)
    want = matching.match_units(cells_of(rows), ["essay_file", "pair"], least=least)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("block,tile", [(64, 1 << 18), (2, 30), (1, 1)])
def test_organization_of_texts_is_that_of_their_cells(spark, monkeypatch, block, tile):
    monkeypatch.setattr(organization, "TILE", tile)
    rows = spark.createDataFrame(TEXTS, "essay_file string, prompt string, response_index int, response string").repartition(3)
    terms = F.transform(T.sentences(F.col("response")), lambda s: T.words(s, T.TERM))
    got = {r[:2]: r[2] for r in organization.soft_texts(rows.select(*pairs.RESPONSE, terms.alias("s")), block=block).collect()}
    want = {r[:2]: r[2] for r in organization.soft_organization(cells_of(rows, None), ["essay_file", "pair"]).collect()}
    assert got.keys() == want.keys() and got == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("window,block,tile", [(1, 64, 1 << 18), (3, 64, 1 << 18), (3, 2, 30), (2, 1, 1), (7, 3, 1 << 18)])
def test_cells_of_texts_are_those_of_their_windows(spark, monkeypatch, window, block, tile):
    """Windows of sentences that texts carry, against the matrix over joined sentences."""
    monkeypatch.setattr(organization, "TILE", tile)
    rows = spark.createDataFrame(TEXTS, "essay_file string, prompt string, response_index int, response string").repartition(3)
    terms = F.transform(T.sentences(F.col("response")), lambda s: T.words(s, T.TERM))
    cells = organization.text_cells(rows.select(*pairs.RESPONSE, terms.alias("s")), window, block)
    slid = rows.withColumn("s", organization.sliding(T.sentences(F.col("response")), window)).withColumn("text", F.struct(*pairs.RESPONSE)).withColumn("n", F.size("s"))
    both = pairs.packed(pairs.canonical_pairs(slid.drop("s"), "text", "n")).withColumnsRenamed({"text_1": "one", "text_2": "two"})
    frames = organization.sentence_matrix(both, organization.sentence_terms(slid, ["text"], F.col("s")), ["essay_file", "pair"])
    got, want = ({r[:4]: r[4] for r in x.collect()} for x in (cells, frames))
    assert cells.schema.simpleString() == frames.schema.simpleString()
    assert got.keys() == want.keys() and got == pytest.approx(want, abs=1e-9) and cells.count() == len(got)
    with pytest.raises(ValueError):
        organization.text_cells(rows, 0)


def test_matched_patterns_of_blocks_are_those_of_tables(spark, monkeypatch):
    """Clauses matched and their patterns counted in blocks, against the tables of cells, matches and patterns; nothing is
    shuffled for each pair."""
    from stabilis.plans import catalog

    sf = "/root/testdata/sf0.001"
    want = sorted(map(tuple, catalog.rounded(pairs.unpacked(catalog._matched_patterns(*catalog._clause_parts(spark, sf)))).collect()))
    found = catalog.matched_clause_patterns(spark, sf)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and not re.search(r"hashpartitioning\([^)]*pair", plan)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 100
    units = catalog._clause_units(spark, sf)
    for block, tile, together in ((2, 1 << 18, 3), (1, 1, 1_024), (5, 40, 2)):
        monkeypatch.setattr(matching, "TILE", tile)
        monkeypatch.setattr(organization, "TILE", tile)
        monkeypatch.setattr(matching, "TOGETHER", together)
        got = matching.match_patterns(units, catalog.POSITION, catalog.LEAST, block=block)
        assert sorted(map(tuple, catalog.rounded(pairs.unpacked(got)).collect())) == want


def test_patterns_of_clauses_are_those_of_their_tokens(spark):
    from stabilis.operators import clauses, structure
    from stabilis.plans.tokens import synthetic_tokens

    texts = spark.createDataFrame([("x", TEXTS[0][3] * 4), ("y", "one two three four five six seven eight nine ten " * 6), ("z", ""), ("w", None)], "rid string, t string")
    tokens = synthetic_tokens(texts, "rid", "t")
    split = clauses.split_clauses(tokens, "rid")
    # (a token without a tag, and a head that is not there)
    odd = tokens.withColumn("upos", F.when(F.col("token_id") == 5, F.lit(None)).otherwise(F.col("upos"))).withColumn("head_token_id", F.when(F.col("token_id") == 3, 99).otherwise(F.col("head_token_id")))
    for rows, parts in ((tokens, split), (odd, clauses.split_clauses(odd, "rid"))):
        kept = rows.join(parts.select("rid", "sentence_id", "clause", F.explode("token_ids").alias("token_id")), ["rid", "sentence_id", "token_id"])
        want = sorted(map(tuple, structure.patterns(kept, ["rid", "sentence_id", "clause"]).collect()))
        units = clauses.clause_units(rows, "rid")
        got = sorted(map(tuple, units.select("rid", "sentence_id", "clause", F.explode("patterns")).collect()))
        assert got == want and want
        assert sorted(map(tuple, units.drop("patterns").collect())) == sorted(map(tuple, parts.select("rid", "sentence_id", "clause", "text").collect()))


def test_no_cell_is_shuffled(spark):
    from stabilis.plans import catalog

    plan = catalog.sliding_matrix(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and not re.search(r"hashpartitioning\([^)]*pair", plan)


@pytest.mark.parametrize("step", ["_matches", "_organization"])
def test_nothing_is_shuffled_for_each_pair(spark, step):
    from stabilis.plans import catalog

    plan = getattr(catalog, step)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and not re.search(r"hashpartitioning\([^)]*pair", plan)


def test_matrices_solved_together_are_solved_as_alone():
    rng = np.random.default_rng(3)
    costs = [rng.integers(0, 4, (n, n + int(rng.integers(0, 4)))).astype(float) for n in rng.integers(1, 9, 60)]
    for cost, found in zip(costs, matching.assignments(costs)):
        assert (found == matching.assignment(cost)).all() and sorted(found[found >= 0]) == list(range(len(cost)))


def test_unit_vectors_of_two_blocks_are_made_once(monkeypatch):
    """Not once for each text of the other block, all held together."""
    texts = lambda p, n: [{"prompt": p, "response_index": k, "vectors": [[1.0, k], [0.0, 1.0]], "idf": [1.0, 0.5]} for k in range(1, n + 1)]
    kind = pa.list_(pa.struct([("prompt", pa.string()), ("response_index", pa.int32()), ("vectors", pa.list_(pa.list_(pa.float32()))), ("idf", pa.list_(pa.float64()))]))
    batch = pa.record_batch([pa.array(["e"]), pa.array([texts("A", 5)], kind), pa.array([texts("B", 4)], kind)], names=["essay_file", "members", "others"])
    calls, norm = [], np.linalg.norm
    monkeypatch.setattr(np.linalg, "norm", lambda *a, **k: calls.append(1) or norm(*a, **k))

    class Blocks:
        def mapInArrow(self, run, schema):
            return list(run(iter([batch])))

    monkeypatch.setattr(contextual, "paired_blocks", lambda *a, **k: Blocks())
    found = contextual.contextual_similarity(None)
    assert sum(map(len, found)) == 20 and len(calls) == 9
