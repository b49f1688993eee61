"""Lexis, organization, structure, matching, clauses and text functions against plain Python."""

import functools
import itertools
import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from stabilis.functions import text as T
from stabilis.operators import clauses, lexis, matching, organization, structure, validation
from stabilis.operators.pairs import canonical_pairs
from stabilis.plans.tokens import synthetic_tokens


def pairs_of(spark, *texts):
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(texts)], "k int, a string, b string")
    sides = []
    for n, c in ((1, "a"), (2, "b")):
        side = lexis.with_mtld(lexis.lexical_columns(rows.select("k", F.col(c).alias("response")), ["k"]))
        sides.append(side.select("k", *[F.col(x).alias(f"{x}_{n}") for x in ("mattr", "terms", "grams2", "grams3", "mtld")]))
    return sides[0].join(sides[1], "k")


def test_bigrams_stay_in_sentences(spark):
    df = spark.createDataFrame([(1, "Students need evidence. This supports the claim.")], "k int, t string")
    got = {r["phrase"]: r["cnt"] for r in lexis.phrase_counts(df, "k", "t", 2).collect()}
    assert got == dict.fromkeys(["students need", "need evidence", "this supports", "supports the", "the claim"], 1)


def test_lexical_similarity(spark):
    same = "The quick brown fox jumps over the lazy dog."
    got = {r["k"]: r for r in lexis.lexical_similarity(pairs_of(spark, (same, same), ("Text.", "Text."), ("", "some words here"), ("one two three", "four five six")), ["k"]).collect()}
    assert got[0]["lex"] == pytest.approx(1) and got[1]["phrase_sim"] == 0 and got[2]["tfidf"] == 0
    assert got[3]["phrase_sim"] == pytest.approx(0, abs=1e-6)
    long = lexis.lexical_similarity(pairs_of(spark, (same, same)), ["k"], size=100).first()
    assert long["lex"] == pytest.approx(1)


def test_tfidf_by_hand(spark):
    got = pairs_of(spark, ("aa bb bb", "bb cc")).select(lexis.cosine(F.col("terms_1"), F.col("terms_2")).alias("tfidf")).first()["tfidf"]
    w = 1 + math.log(1.5)
    assert got == pytest.approx(2 / (math.sqrt(w * w + 4) * math.sqrt(1 + w * w)))


def test_mattr_and_mtld(spark):
    rng = random.Random(1)
    texts = ["", "a", "a a a a", " ".join(rng.choice("abcdefg") for _ in range(80))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r for r in df.select("i", T.mattr(T.words(F.col("t")), 10).alias("m"), T.mtld(T.words(F.col("t"))).alias("d")).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        want = 0.0 if not w else len(set(w)) / len(w) if len(w) <= 10 else sum(len(set(w[s : s + 10])) / 10 for s in range(len(w) - 9)) / (len(w) - 9)
        assert got[i]["m"] == pytest.approx(want) and got[i]["d"] == pytest.approx(T.mtld_of(w))
    assert T.mtld_of(["a"] * 4) == pytest.approx(2.0) and T.mtld_of(list("abcd")) == 4


def test_rounding_noise_settles_no_organization(spark):
    """The two sentences of one side are alike but for the last bits of three scores: no sentence of the other side points to one
    of them, so that all of its places count alike, whichever bits the order of sums leaves."""
    line = [0, 0, 0.048335860787547286, 0.03491470062300817, 0, 0, 0, 0, 0, 0, 0.10290495946597567, 0, 0, 0, 0.0532084664090977, 0, 0, 0.02198392870596798, 0.04716137954033371, 0, 0.07775041381100323, 0.026049281287671852, 0, 0]
    other = [{2: 0.0483358607875473, 10: 0.10290495946597569, 18: 0.047161379540333725}.get(j, x) for j, x in enumerate(line)]
    cells = spark.createDataFrame([(1, i, j, float(x)) for i, s in enumerate((line, other)) for j, x in enumerate(s)], "k int, i int, j int, score double")
    far = 1 - sum(abs(j / 23 - 0.5) for j in range(24)) / 24
    assert organization.soft_organization(cells, ["k"]).first()["org"] == pytest.approx((0.5 + far) / 2, abs=1e-9)
    matrix = spark.createDataFrame([([[float(a), float(b)] for a, b in zip(line, other)],)], "cells array<array<double>>")
    assert matrix.select(organization._aligned(F.col("cells"), 0.1)).first()[0] == pytest.approx(far, abs=1e-9)


def test_soft_organization(spark):
    rng = np.random.default_rng(0)
    scores = {0: np.eye(3), 1: rng.random((2, 3)), 2: rng.random((1, 2)), 3: np.zeros((4, 4)), 4: rng.random((5, 1))}
    rows = [(k, i, j, float(s[i, j])) for k, s in scores.items() for i in range(s.shape[0]) for j in range(s.shape[1])]
    got = {r["k"]: r["org"] for r in organization.soft_organization(spark.createDataFrame(rows, "k int, i int, j int, score double"), ["k"]).collect()}

    def side(s):
        n, m = s.shape
        pos = lambda c: np.arange(c) / (c - 1) if c > 1 else np.zeros(1)
        w = np.exp((s - s.max(1, keepdims=True)) / 0.1)
        w /= w.sum(1, keepdims=True)
        p = np.clip(1 - np.abs(pos(n) - w @ pos(m)), 0, 1)
        c = np.clip(1 - -(np.clip(w, 1e-12, 1) * np.log(np.clip(w, 1e-12, 1))).sum(1) / np.log(m), 0, 1) if m > 1 else np.ones(n)
        return (c * p).sum() / c.sum() if c.sum() else p.mean()

    for k, s in scores.items():
        assert got[k] == pytest.approx(min(1, max(0, (side(s) + side(s.T)) / 2)), abs=1e-9)


def test_cosine_affine(spark):
    rows = [(1, [1.0, 0.0], [2.0, 0.0]), (2, [1.0, 0.0], [0.0, 3.0]), (3, [1.0, 0.0], [-1.0, 0.0]), (4, [0.0, 0.0], [1.0, 1.0])]
    df = spark.createDataFrame(rows, "k int, a array<double>, b array<double>")
    assert [r["c"] for r in df.orderBy("k").select(organization.cosine_affine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.5, 0.0, None]
    assert spark.range(1).select(organization.meaning(F.lit(0.8), F.lit(0.5)).alias("m")).first()["m"] == pytest.approx(0.65)


def test_greedy_token_scores(spark):
    rows = [(1, [[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.0]], [1.0, 1.0], [2.0]), (2, [], [[1.0]], [], [1.0])]
    got = {r["pair_id"]: r for r in organization.greedy_token_scores(spark.createDataFrame(rows, "pair_id int, cand array<array<float>>, ref array<array<float>>, cand_idf array<float>, ref_idf array<float>")).collect()}
    assert (got[1]["precision"], got[1]["recall"], got[1]["f1"]) == pytest.approx((0.5, 1.0, 2 / 3)) and got[2]["f1"] == 0


def test_sliding_windows_repeat_the_last_sentence(spark):
    df = spark.createDataFrame([(["a", "b", "c"],)], "s array<string>")
    assert df.select(organization.sliding(F.col("s"), 2).alias("w")).first()["w"] == ["a b", "b c", "c c"]


TOKENS = "name string, sentence_id int, token_id int, text string, upos string, dependency_relation string, head_token_id int"


def test_depths_and_features(spark):
    rows = [
        ("t", 1, 1, "cats", "NOUN", "nsubj", 2), ("t", 1, 2, "sleep", "VERB", "root", None), ("t", 1, 3, ",", "PUNCT", "punct", 2), ("t", 1, 4, "when", "ADV", "advmod", 5),
        ("t", 1, 5, "tired", "ADJ", "advcl", 2), ("t", 1, 6, "odd", "ADJ", "amod", 3), ("t", 1, 7, "x", "NOUN", "obj", 8), ("t", 1, 8, "y", "NOUN", "obj", 7), ("t", 1, 9, "z", "NOUN", "acl:relcl", 99),
    ]
    df = spark.createDataFrame(rows, TOKENS)
    got = {r["token_id"]: r["depth"] for r in structure.depths(df, "name").collect()}
    assert got == {1: 1, 2: 0, 4: 2, 5: 1, 6: 1, 7: 2, 8: 2, 9: 1}
    f = structure.features(df, "name").first()
    assert len(structure.RATES) == len(structure.TOTALS) == 21
    assert f["sentences"] == 1 and f["acl_relcl"] == 1 and f["acl"] == 0 and f["advcl_per_sentence"] == 1 and f["maximum_dependency_distance"] == 90
    assert f["long_dependencies_ge_5"] == 1 and f["amod_per_noun"] == pytest.approx(1 / 4) and f["obj_per_verb"] == 2
    assert f["total_token_depth"] == 10 and f["mean_dependency_distance"] == pytest.approx((1 + 1 + 3 + 3 + 1 + 1 + 90) / 7)


def test_structure_of_equal_texts_is_one(spark):
    names = [*structure.RATES, *structure.TOTALS]
    row = spark.range(1).select("id", *[F.lit(float(k % 3)).alias(f"{n}_{s}") for k, n in enumerate(names) for s in (1, 2)])
    assert structure.structure_similarity(row, ["id"]).first()["struct"] == pytest.approx(1)
    assert structure.feature_table(row, ["id"]).count() == 21


def test_assignment_is_optimal():
    rng = np.random.default_rng(6)
    for _ in range(60):
        n = int(rng.integers(1, 6))
        m = int(rng.integers(n, 7))
        cost = rng.integers(0, 9, (n, m)).astype(float)
        row_of = matching.assignment(cost)
        assert sorted(r for r in row_of if r >= 0) == list(range(n))
        got = sum(cost[r, c] for c, r in enumerate(row_of) if r >= 0)
        assert got == min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))


def test_match_units(spark):
    rows = [(1, i, j, s) for i, line in enumerate([[0.9, 0.8, 0.1], [0.85, 0.2, 0.0]]) for j, s in enumerate(line)]
    cells = spark.createDataFrame(rows, "k int, i int, j int, score double")
    got = {(r["i"], r["j"]): r["phase"] for r in matching.match_units(cells, ["k"], least=0.05).collect()}
    assert got == {(0, 1): "assignment", (1, 0): "assignment", (0, 2): "leftover"}
    units = spark.createDataFrame([(1, p) for p in range(4)], "k int, pos int")
    assert [r["pos"] for r in matching.unmatched(units, matching.match_units(cells, ["k"]), ["k"], "j").collect()] == [3]


def plain_best(cells):
    """Largest number of cells of an assignment and, with it, the greatest total; by trying all."""
    rows = sorted({i for i, _ in cells})

    @functools.lru_cache(None)
    def best(k, used):
        if k == len(rows):
            return 0, 0.0
        found = [best(k + 1, used)]
        for (i, j), s in cells.items():
            if i == rows[k] and j not in used:
                n, t = best(k + 1, used | {j})
                found.append((n + 1, t + s))
        return max(found, key=lambda x: (x[0], round(x[1], 9)))

    return best(0, frozenset())


def plain_leftovers(cells, core, capacity):
    used = [[c for c, _ in core], [c for _, c in core]]
    alone = [(i, j) for i, j in cells if i not in used[0] or j not in used[1]]
    out = []
    for i, j in sorted(alone, key=lambda c: (-cells[c], c)):
        if used[0].count(i) < capacity and used[1].count(j) < capacity:
            used[0].append(i)
            used[1].append(j)
            out.append((i, j))
    return out


def checked_matches(found, cells, capacity):
    core = [(r["i"], r["j"]) for r in found if r["phase"] == "assignment"]
    assert len({i for i, _ in core}) == len({j for _, j in core}) == len(core)
    n, total = plain_best(cells)
    assert len(core) == n and sum(cells[c] for c in core) == pytest.approx(total, abs=1e-5)
    assert sorted((r["i"], r["j"]) for r in found if r["phase"] == "leftover") == sorted(plain_leftovers(cells, core, capacity))
    assert all(r["score"] == cells[r["i"], r["j"]] for r in found)


@pytest.mark.parametrize("density,dense", [(0.15, 3), (0.4, 3), (1.0, 3), (0.5, 0), (1.0, 0), (0.15, 10**9)])
def test_matches_are_the_best_ones(spark, monkeypatch, density, dense):
    """Random matrices against trying everything: by matrix, by lists of cells, and pairs that go over several batches."""
    monkeypatch.setattr(matching, "DENSE", dense)
    rng = np.random.default_rng(int(density * 100) + min(dense, 5))
    rows = []
    for k in range(40):
        n, m = rng.integers(1, 8, 2)
        rows += [(f"e{k % 3}", k, i, j, round(float(rng.random()), int(rng.integers(1, 6)))) for i in range(n) for j in range(m) if rng.random() < density]
    cells = spark.createDataFrame([*rows, ("e9", 99, 0, 0, None), ("e9", 98, 0, 0, 0.01)], "e string, k long, i int, j int, score double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = matching.match_units(cells, ["e", "k"], least=0.05).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in {r[1] for r in rows}:
        eligible = {(i, j): s for _, kk, i, j, s in rows if kk == k and s >= 0.05}
        checked_matches([r for r in found if r["k"] == k], eligible, 2)
    assert not [r for r in found if r["k"] > 40]


def test_memory_of_a_sparse_pair_grows_with_its_cells():
    """20,000 units on either side, three cells each: as a matrix, 3 GB."""
    n = 20_000
    i = np.repeat(np.arange(n), 3)
    j = (i * 7 + np.tile([0, 1, 5], n)) % n
    score = ((i * 31 + j * 17) % 97 + 1) / 100
    tracemalloc.start()
    rows, cols = i[: 3 * 2_000], j[: 3 * 2_000]
    core, rest = matching._matched(rows, cols, score[: len(rows)], 2)
    assert tracemalloc.get_traced_memory()[1] < 32 << 20
    tracemalloc.stop()
    assert len(core) == 2_000


def test_registered_matches_against_trying_everything(spark):
    """The stored cells of sf0.001: core and leftovers of every pair whose smaller side is small enough to try."""
    from stabilis.plans import catalog

    sf = "/root/testdata/sf0.001"
    cells, found = {}, {}
    for r in catalog._matrix(spark, sf).collect():
        cells.setdefault((r["essay_file"], r["pair"]), {})[r["i"], r["j"]] = round(r["score"], 6)
    for r in catalog._matches(spark, sf).collect():
        found.setdefault((r["essay_file"], r["pair"]), []).append(r)
    tried = 0
    for pair, own in cells.items():
        small = min(len({i for i, _ in own}), len({j for _, j in own}))
        if small <= 6 and len(own) <= 60:
            flipped = {(j, i): s for (i, j), s in own.items()} if len({i for i, _ in own}) > small else own
            core = [r for r in found[pair] if r["phase"] == "assignment"]
            n, total = plain_best(flipped)
            assert len(core) == n and sum(r["score"] for r in core) == pytest.approx(total, abs=1e-5)
            left = sorted((r["i"], r["j"]) for r in found[pair] if r["phase"] == "leftover")
            assert left == sorted(plain_leftovers(own, [(r["i"], r["j"]) for r in core], 2))
            tried += 1
    assert tried > 50


def test_matched_clause_patterns_against_plain_counting(spark):
    """Clauses, matrix, matcher with places, patterns: all matches of sf0.001 counted one by one."""
    from collections import Counter

    from stabilis.plans import catalog

    cells, sizes, found = catalog._clause_parts(spark, "/root/testdata/sf0.001")
    n = {(r["essay_file"], r["pair"]): r for r in sizes.collect()}
    score = {}
    for r in cells.collect():
        own = n[r["essay_file"], r["pair"]]
        place = lambda x, size: x / (size - 1) if size > 1 else 0.0
        close = 1 - abs(place(r["i"], own["n_1"]) - place(r["j"], own["n_2"]))
        score[r["essay_file"], r["pair"], r["i"], r["j"]] = 0.75 * r["score"] + 0.25 * close
    matches = catalog._clause_matches(cells, sizes).collect()
    assert matches and all(r["score"] >= catalog.LEAST and r["score"] == pytest.approx(score[r["essay_file"], r["pair"], r["i"], r["j"]], abs=1e-6) for r in matches)
    core = [r for r in matches if r["phase"] == "assignment"]
    assert len({(r["essay_file"], r["pair"], r["i"]) for r in core}) == len({(r["essay_file"], r["pair"], r["j"]) for r in core}) == len(core)
    patterns = {}
    for r in found.collect():
        patterns.setdefault((r["rid"], r["pos"]), Counter())[r["pattern"]] += 1
    got = catalog._matched_patterns(cells, sizes, found).collect()
    assert sorted((r["essay_file"], r["pair"], r["i"], r["j"]) for r in got) == sorted((r["essay_file"], r["pair"], r["i"], r["j"]) for r in matches)
    for r in got:
        own = n[r["essay_file"], r["pair"]]
        a, b = (patterns.get((own[f"rid_{s}"], r[c]), Counter()) for s, c in ((1, "i"), (2, "j")))
        high = sum((a | b).values())
        assert r["structurality"] == pytest.approx(sum((a & b).values()) / high if high else 0.0)
        assert (r["n_patterns_a"], r["n_pattern_types_b"], r["n_shared_pattern_types"]) == (sum(a.values()), len(b), len(a & b))


def test_depths_of_chains_gaps_and_cycles(spark):
    """Walks one by one: long chains, gaps in the ids, cycles with tails, missing and punctuated heads."""
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for s in range(30):
        ids = sorted(rng.choice(np.arange(1, 60), int(rng.integers(1, 40)), replace=False).tolist()) if s % 2 else list(range(1, 30))
        tags = {t: "PUNCT" if rng.random() < 0.1 else "NOUN" for t in ids}
        heads = {t: (None if rng.random() < 0.15 else int(rng.choice([*ids, 99]))) if s % 3 else (t - 1 or None) for t in ids}
        for t in ids:
            rows.append(("x", s, t, tags[t], heads[t], "dep"))
            if tags[t] == "PUNCT":
                continue
            depth, seen, at = 0, {t}, heads[t]
            while at is not None:
                depth += 1
                if at in seen or tags.get(at, "PUNCT") == "PUNCT":
                    break
                seen.add(at)
                at = heads[at]
            want[s, t] = depth
    df = spark.createDataFrame(rows, "name string, sentence_id int, token_id int, upos string, head_token_id int, dependency_relation string")
    assert {(r["sentence_id"], r["token_id"]): r["depth"] for r in structure.depths(df, "name").collect()} == want
    plan = structure.features(df, "name")._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_order_measures(spark):
    m = {1: [(0, 0), (1, 1), (2, 2)], 2: [(0, 2), (1, 1), (2, 0)], 3: [(0, 0)], 4: [(0, 1), (1, 1), (2, 0), (2, 2)]}
    df = spark.createDataFrame([(k, i, j) for k, x in m.items() for i, j in x], "k int, i int, j int")
    sizes = spark.createDataFrame([(k, 3, 3) if k != 3 else (3, 1, 1) for k in m], "k int, n_a int, n_b int")
    tau = {r["k"]: r["tau"] for r in matching.kendall(df, ["k"]).collect()}
    assert (tau[1], tau[2], tau[3]) == (1.0, 0.0, 1.0)
    s = x = y = 0
    for (a, b), (c, d) in itertools.combinations(m[4], 2):
        s += np.sign(c - a) * np.sign(d - b)
        x, y = x + (a != c), y + (b != d)
    assert tau[4] == pytest.approx((s / math.sqrt(x * y) + 1) / 2)
    place = {r["k"]: r["position"] for r in matching.positions(df, sizes, ["k"]).collect()}
    assert place[1] == 1 and place[2] == pytest.approx(1 / 3) and place[3] == 1
    seq = {r["k"]: r["sequence"] for r in matching.continuity(df, sizes, ["k"]).collect()}
    assert seq[1] == 1 and seq[2] == 0 and seq[3] == 1


def test_continuity_by_hand(spark):
    """Only neighbours that both have matches are compared; no such neighbours give 0, no matches give 0."""
    m = {1: [(0, 0), (1, 1), (4, 4)], 2: [(0, 0), (2, 2)], 4: [(0, 0), (1, 1), (2, 0)]}
    df = spark.createDataFrame([(k, i, j, 0.5) for k, x in m.items() for i, j in x], "k int, i int, j int, score double")
    sizes = spark.createDataFrame([(k, 5, 5) for k in (1, 2, 3, 4)], "k int, n_a int, n_b int")
    seq = {r["k"]: r["sequence"] for r in matching.continuity(df, sizes, ["k"]).collect()}
    # pair 4: 0-1 kept, 1-2 not; the other way 0 -> {0, 2} and 1 -> {1}, kept
    assert seq == {1: 1.0, 2: 0.0, 3: 0.0, 4: pytest.approx((0.5 + 1) / 2)}
    org = {r["k"]: r for r in matching.organization_of_matches(df, sizes, ["k"]).collect()}
    assert org[1]["org"] == pytest.approx(1) and org[3]["org"] == 0 and org[2]["org"] == pytest.approx(0.34 + 0.33)
    mean = {r["k"]: r["mean"] for r in matching.mean_over_matches(df, sizes, ["k"]).collect()}
    assert mean == {1: 0.5, 2: 0.5, 3: 0.0, 4: 0.5}
    first = matching.ordered(df, ["k"]).filter("k = 1").collect()
    assert [(r["i"], r["j"]) for r in first] == m[1]


def test_metric_of_cells(spark):
    cells = spark.createDataFrame([(1.0, 0.5, 0.6), (0.0, 1.0, None)], "precision double, recall double, f1 double")
    assert [r["score"] for r in matching.scored(cells, "recall").collect()] == [0.5, 1.0]
    with pytest.raises(Exception, match="not finite"):
        matching.scored(cells, "f1").collect()
    with pytest.raises(ValueError):
        matching.scored(cells, "f2")


def words_of(*rows):
    """id -> token, from (text, tag, relation, head) in order."""
    return {n: r for n, r in enumerate(rows, 1)}


def test_clauses():
    # complements do not split off; conjuncts do, with a subject or without
    says = words_of(("she", "PRON", "nsubj", 2), ("says", "VERB", "root", None), ("that", "SCONJ", "mark", 5), ("he", "PRON", "nsubj", 5), ("wrote", "VERB", "ccomp", 2), ("long", "ADJ", "amod", 7), ("letters", "NOUN", "obj", 5), (".", "PUNCT", "punct", 2))
    assert clauses.split_sentence(says, False) == clauses.split_sentence(says, True) == [[1, 2, 3, 4, 5, 6, 7, 8]]
    ran = words_of(("he", "PRON", "nsubj", 2), ("ran", "VERB", "root", None), ("and", "CCONJ", "cc", 4), ("wrote", "VERB", "conj", 2), ("long", "ADJ", "amod", 6), ("letters", "NOUN", "obj", 4), (".", "PUNCT", "punct", 2))
    assert clauses.split_sentence(ran, False) == [[1, 2, 7], [3, 4, 5, 6]]
    assert clauses.split_sentence(ran, True) == [[1, 2, 3, 4, 5, 6, 7]]  # four words are too few
    # five words; it opens with "and" and has no subject, so it is weak
    ran[7] = ("home", "NOUN", "obl", 4)
    assert clauses.split_sentence(ran, True) == [[1, 2, 3, 4, 5, 6, 7]]
    # a subject deeper in the subtree makes it strong; joined again unless asked not to
    ran[6] = ("letters", "NOUN", "nsubj", 4)
    assert clauses.split_sentence(ran, True) == [[1, 2, 3, 4, 5, 6, 7]]
    assert clauses.split_sentence(ran, True, merge=False) == [[1, 2], [3, 4, 5, 6, 7]]
    # an adjective with a copula is a strict predicate, but no loose one
    when = words_of(("we", "PRON", "nsubj", 2), ("left", "VERB", "root", None), ("when", "ADV", "mark", 7), ("the", "DET", "det", 5), ("rain", "NOUN", "nsubj", 7), ("was", "AUX", "cop", 7), ("heavy", "ADJ", "advcl", 2), ("outside", "ADV", "advmod", 7))
    assert clauses.split_sentence(when, False) == [[1, 2, 3, 4, 5, 6, 7, 8]]
    assert clauses.split_sentence(when, True) == [[1, 2], [3, 4, 5, 6, 7, 8]]
    # an infinitive of purpose stays
    go = words_of(("we", "PRON", "nsubj", 2), ("left", "VERB", "root", None), ("early", "ADV", "advmod", 5), ("to", "PART", "mark", 5), ("see", "VERB", "advcl", 2), ("old", "ADJ", "amod", 7), ("friends", "NOUN", "nsubj", 5))
    go = {n: (*t, "VB" if t[0] == "see" else None) for n, t in go.items()}
    assert clauses.split_sentence(go, True) == [[1, 2, 3, 4, 5, 6, 7]]
    go[5] = ("see", "VERB", "advcl", 2, "VBP")
    assert clauses.split_sentence(go, True) == [[1, 2], [3, 4, 5, 6, 7]]
    # nested splits: both keep their tokens loosely, the outer one takes all strictly
    nest = words_of(("a", "NOUN", "root", None), ("b", "NOUN", "nsubj", 3), ("c", "VERB", "advcl", 1), ("d", "NOUN", "obj", 3), ("e", "VERB", "conj", 3), ("f", "NOUN", "obj", 5), ("g", "ADV", "advmod", 5), ("h", "NOUN", "obl", 5), ("i", "ADV", "advmod", 5))
    assert clauses.split_sentence(nest, False) == [[1], [2, 3, 4, 5, 6, 7, 8, 9], [5, 6, 7, 8, 9]]
    assert clauses.split_sentence(nest, True) == [[1], [2, 3, 4, 5, 6, 7, 8, 9]]
    # a bare discourse marker is dropped; a cycle ends
    assert clauses.split_sentence(words_of(("However", "ADV", "root", None), (",", "PUNCT", "punct", 1)), True) == []
    assert clauses.split_sentence(words_of(("x", "VERB", "conj", 2), ("y", "VERB", "conj", 1)), False) == [[1, 2]]
    assert clauses.Part({1: clauses.Token("a", "X", "", None), 2: clauses.Token(",", "X", "", 1)}, [1, 2]).text == "a,"


def test_patterns_of_matched_clauses(spark):
    unit = "k int, pos int, pattern string"
    left = spark.createDataFrame([(1, 0, "x"), (1, 0, "x"), (1, 0, "y"), (1, 1, "z")], unit)
    right = spark.createDataFrame([(1, 0, "x"), (1, 0, "w"), (1, 2, "z")], unit)
    matches = spark.createDataFrame([(1, 0, 0), (1, 1, 2), (1, 5, 5)], "k int, i int, j int")
    got = {(r["i"], r["j"]): tuple(r)[3:] for r in structure.matched_patterns(matches, left, right, ["k"]).collect()}
    assert got == {(0, 0): (0.25, 3, 2, 2, 2, 1), (1, 2): (1.0, 1, 1, 1, 1, 1), (5, 5): (0.0, 0, 0, 0, 0, 0)}


def test_long_sentences_are_taken_apart_once(spark):
    """Twice the words take about twice the time, not four times."""
    import time

    def seconds(n):
        df = spark.createDataFrame([(" ".join(f"w{x % 97}" for x in range(n)),)], "t string")
        began = time.perf_counter()
        df.select(F.size(lexis.phrase_list(F.col("t"), 2)).alias("n"), T.mattr(T.words(F.col("t")))).collect()
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(40_000) < 4 * seconds(20_000) + 1


@pytest.mark.parametrize("strict", [False, True])
def test_clauses_of_many_sentences_take_no_call_each(spark, strict):
    """Clauses of whole batches of sentences equal those of each sentence by itself; no pandas call per sentence."""
    texts = spark.createDataFrame([(str(k), f"word{k} and the {k} ran because it went, or sat. It came by far! " * (1 + k % 3)) for k in range(60)], "rid string, text string")
    tokens = synthetic_tokens(texts, "rid", "text")
    found = clauses.split_clauses(tokens, "rid", strict)
    plan = found._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "InPandas" not in plan
    sentences: dict = {}
    for t in tokens.collect():
        sentences.setdefault((t["rid"], t["sentence_id"]), {})[t["token_id"]] = (t["text"], t["upos"], t["dependency_relation"], t["head_token_id"], None)
    want = {(*k, n, tuple(c)) for k, s in sentences.items() for n, c in enumerate(clauses.split_sentence(s, strict))}
    assert {(r["rid"], r["sentence_id"], r["clause"], tuple(r["token_ids"])) for r in found.collect()} == want and len(want) > 60


def test_clauses_on_spark(spark):
    rows = [("d", 1, 1, "I", "PRON", "nsubj", 2), ("d", 1, 2, "run", "VERB", "root", None), ("d", 2, 1, "Stop", "VERB", "root", None)]
    assert sorted(r["text"] for r in clauses.split_clauses(spark.createDataFrame(rows, TOKENS), "name").collect()) == ["I run", "Stop"]


def test_multiset_jaccard(spark):
    a = spark.createDataFrame([(1, x) for x in "aabc"], "k int, w string")
    b = spark.createDataFrame([(1, x) for x in "abbd"], "k int, w string")
    assert structure.multiset_jaccard(a, b, ["k"], "w").first()["jaccard"] == pytest.approx(2 / 6)


def test_validation(spark):
    text = " ".join(f"Sentence {k}." for k in range(1, 10))
    df = spark.createDataFrame([(f"f{k}", text) for k in range(5)] + [("short", "One. Two.")], "name string, text string")
    found = validation.extracts(df, "name", "text")
    out = {r["name"]: r for r in validation.edits(found, "name").collect()}
    assert [out[f"f{k}"]["edit"] for k in range(5)] == ["keep_same", "intro_conc_swap", "adjacent_swap", "reverse", "keep_same"]
    assert out["f1"]["edited"].startswith("Sentence 8. Sentence 2.") and out["f3"]["edited"].startswith("Sentence 8. Sentence 7.")
    sample = validation.stratified_sample(df.withColumn("g", F.lit(1)), "g", "name", 3)
    assert sample.count() == 3 and sample.columns == ["name", "text", "g"]


def test_small_functions(spark):
    import hashlib
    import json

    one = spark.createDataFrame([("a_b_final_essay.md", "<think>x\ny</think> hi\n </think>", '{"p": " a\\n", "q": "b"}', "e.md", "A", 3)], "f string, t string, j string, e string, p string, i int")
    r = one.select(
        T.short_name(F.col("f")).alias("n"), T.without_thoughts(F.col("t")).alias("t"), T.flattened_json(F.col("j"), ["p", "q"]).alias("j"), T.flattened_json(F.col("j"), ["p", "z"]).alias("z"),
        T.derived_seed(42, F.col("e"), F.col("p"), F.col("i")).alias("s"), T.fixed(F.lit(0.5)).alias("x"),
    ).first()
    want = int.from_bytes(hashlib.sha256(json.dumps([42, "e.md", "A", 3]).encode()).digest()[:4], "big")
    assert (r["n"], r["t"], r["j"], r["z"], r["s"], r["x"]) == ("final_essay", "hi", "a\n\nb", None, want, "0.500000")


def test_canonical_order_and_plan(spark):
    rows = spark.createDataFrame([("e", p, i, "t") for p in "AB" for i in (1, 2, 3)], "essay_file string, prompt string, response_index int, response string")
    df = canonical_pairs(rows, "response")
    assert df.groupBy("comparison_type").count().collect().__len__() == 3 and df.count() == 21
    assert "Cartesian" not in df._jdf.queryExecution().executedPlan().toString()
