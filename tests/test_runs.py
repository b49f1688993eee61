"""Runs that are cut and taken up again, stored scores, named files and ordered outputs."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from stabilis.functions import text as T
from stabilis.operators import collection, lexis, pairs, scoring, validation
from stabilis.sources import files, tables
from stabilis.sources.tables import KEYS, RESPONSES

PROMPTS = {"A": "for a pupil", "B": "for a teacher"}


@pytest.fixture(scope="module")
def essays(spark):
    return spark.createDataFrame([(f"essay {k} é.md", f"Text of essay {k}.") for k in range(12)], "essay_file string, text string").repartition(3)


class Model:
    """Answers with its request and seed; fails on some essays."""

    def __init__(self, failing=()):
        self.failing = failing

    def __call__(self, request, seed):
        if any(f"essay {k}." in request for k in self.failing):
            raise RuntimeError("cut")
        return f"<think>hm</think> {request}|{seed} "


def run(essays, path, failing=(), **how):
    settings = {"repeats": 2, "seed": 7, "task": "Read: ", "settings": {"model": "m"}, "essays_per_job": 3, **how}
    return collection.collect_responses(essays, path, lambda: Model(failing), PROMPTS, **settings)


def test_a_run_that_is_cut_ends_with_each_key_once(spark, essays, tmp_path):
    path = str(tmp_path / "run")
    # essays go in jobs by hash; an essay of the last job fails
    parts = essays.select("essay_file", F.pmod(F.xxhash64("essay_file"), F.lit(4)).alias("p")).collect()
    last = max(r["p"] for r in parts)
    failing = [int(r["essay_file"].split()[1]) for r in parts if r["p"] == last][:1]
    with pytest.raises(Exception, match="cut"):
        run(essays, path, failing)
    before = collection.stored_responses(spark, path).collect()
    assert 0 < len(before) < 48 and files.read_document(spark, path + ".metadata.json")["complete"] is False
    with pytest.raises(FileExistsError):
        run(essays, path)
    rows = run(essays, path, resume=True).collect()
    assert files.read_document(spark, path + ".metadata.json")["complete"] is True
    keys = [(r["essay_file"], r["prompt"], r["response_index"]) for r in rows]
    assert len(keys) == len(set(keys)) == 12 * 2 * 2
    assert spark.read.parquet(path).count() == 48  # nothing was made twice
    for r in rows:
        k = int(r["essay_file"].split()[1])
        seed = int.from_bytes(hashlib.sha256(json.dumps([7, r["essay_file"], r["prompt"], r["response_index"]]).encode()).digest()[:4], "big")
        assert r["response"] == f"Read: Text of essay {k}.\n\n{PROMPTS[r['prompt']]}|{seed}"


def test_a_run_is_taken_up_with_the_same_settings_only(spark, essays, tmp_path):
    path = str(tmp_path / "run")
    with pytest.raises(FileNotFoundError):
        run(essays, path, resume=True)
    run(essays.limit(2), path, essays_per_job=100)
    for change in ({"repeats": 3}, {"seed": 8}, {"task": "x"}, {"settings": {"model": "n"}}):
        with pytest.raises(ValueError, match="settings"):
            run(essays.limit(2), path, resume=True, **change)
    with pytest.raises(ValueError, match="changed"):
        run(essays.limit(2).withColumn("text", F.concat("text", F.lit("!"))), path, resume=True)
    assert run(essays.limit(3), path, resume=True).count() == 12  # a new essay may be added
    with pytest.raises(ValueError, match="texts"):
        run(essays.withColumn("text", F.lit(" ")), str(tmp_path / "blank"))
    with pytest.raises(ValueError, match="two"):
        run(essays, str(tmp_path / "few"), repeats=1)


@pytest.mark.parametrize("answer,words", [("<think>only</think> ", "empty response"), (None, "no response")])
def test_empty_answers_are_errors(spark, answer, words):
    asked = spark.createDataFrame([("e", "A", 1, "r", 5)], "essay_file string, prompt string, response_index int, request string, seed long")
    with pytest.raises(Exception, match=words):
        collection.generated(asked, lambda: lambda request, seed: answer).collect()


def test_seeds_of_any_name(spark):
    names = ["plain.md", 'quo"te\\.md', "é ü 日本 😀", "tab\tline\n\x01\x7f", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", T.json_ascii(F.col("n")).alias("j"), T.derived_seed(3, F.col("n"), F.lit("A"), F.lit(2)).alias("s"))
    for r in df.collect():
        assert r["j"] == json.dumps(r["n"])
        assert r["s"] == int.from_bytes(hashlib.sha256(json.dumps([3, r["n"], "A", 2]).encode()).digest()[:4], "big")


# scorers and stores


@pytest.fixture(scope="module")
def responses(spark):
    words = ["the cat sat on a mat", "a dog sat on the log today", "nothing in common here", ""]
    return spark.createDataFrame([(f"e{e}", p, i, words[(e + i + ord(p)) % 4]) for e in range(4) for p in "AB" for i in (1, 2, 3)], RESPONSES)


@pytest.mark.parametrize("name", ["lexical", "contextual"])
def test_stored_scores_are_taken_and_the_rest_is_made(spark, responses, tmp_path, name):
    by = scoring.scorer(name)
    wanted = pairs.canonical_pairs(responses).select(*KEYS)
    whole = {tuple(r)[:5]: r for r in scoring.scored(responses, wanted, by).collect()}
    assert len(whole) == wanted.count() == 4 * 21
    column = {"lexical": "lex", "contextual": "f1"}[name]
    path = str(tmp_path / "store")
    part = scoring.scored(responses, wanted, by).filter("prompt_1 = 'A' AND prompt_2 = 'A' AND essay_file <> 'e3'").drop("source")
    # marked values show where a score came from; a repeated row and one of another essay change nothing
    marked = part.withColumn(column, F.col(column) + 10)
    marked.unionAll(marked.limit(3)).unionAll(marked.limit(1).withColumn("essay_file", F.lit("other"))).write.partitionBy("essay_file").parquet(path)
    got = scoring.scored(responses, wanted, by, spark.read.parquet(path).select(*part.columns)).collect()
    assert len(got) == 84
    for r in got:
        stored = r["prompt_2"] == "A" and r["essay_file"] != "e3"
        assert r["source"] == ("stored" if stored else "scored")
        assert r[column] == pytest.approx(whole[tuple(r[k] for k in KEYS)][column] + (10 if stored else 0))


def test_lexical_scorer_is_the_measure(responses):
    both = pairs.canonical_pairs(lexis.lexical_columns(responses, pairs.RESPONSE), "mattr", "terms", "grams2", "grams3")
    want = {tuple(r)[:5]: r["lex"] for r in lexis.lexical_similarity(both, KEYS).collect()}
    wanted = pairs.canonical_pairs(responses).filter("response_index_1 = 1").select(*KEYS)
    got = {tuple(r)[:5]: r["lex"] for r in scoring.scorer("lexical")(responses, wanted).collect()}
    assert got == {k: v for k, v in want.items() if k[2] == 1}


def test_wanted_pairs_meet_in_blocks(spark):
    """An essay of several blocks: each wanted pair once with what both sides carry, and no shuffle by pair of what is carried."""
    keys = {(p, i) for p in "AB" for i in range(1, 71 if p == "A" else 40)}
    rows = spark.createDataFrame([("e", p, i, f"{p}{i}") for p, i in sorted(keys)] + [("f", "A", 1, "f"), ("f", "B", 1, "g")], RESPONSES)
    asked = [(x, y) for x in keys for y in keys if (x[1] * 7 + y[1]) % 5 == 0]  # some are not canonical
    wanted = spark.createDataFrame([("e", *x, *y) for x, y in asked] + [("e", "A", 500, "B", 1)], "essay_file string, prompt_1 string, response_index_1 int, prompt_2 string, response_index_2 int")
    got = [tuple(r) for r in pairs.wanted_pairs(rows, wanted, "response").select(*KEYS[1:], "response_1", "response_2", "comparison_type").collect()]
    want = [(*x, *y, f"{x[0]}{x[1]}", f"{y[0]}{y[1]}", x[0] + y[0]) for x, y in asked if (x[0] == y[0] and x[1] <= y[1]) or x[0] < y[0]]
    assert sorted(got) == sorted(want)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = scoring.scorer("lexical")(rows, wanted)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and not [line for line in dealt if "prompt_1" in line and "prompt_2" in line]


def test_terms_are_counted_in_their_rows(spark):
    texts = ["", "b a b. a b! a", "Ä ä x", None]
    rows = spark.createDataFrame([("e", "A", i, t) for i, t in enumerate(texts)], RESPONSES)
    found = lexis.lexical_columns(rows, pairs.RESPONSE)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r["response_index"]: (r["terms"], r["grams2"], r["grams3"]) for r in found.collect()}
    assert got == {0: ({}, {}, {}), 1: ({}, {"b a": 1, "a b": 2}, {"b a b": 1}), 2: ({}, {"ä ä": 1, "ä x": 1}, {"ä ä x": 1}), 3: ({}, {}, {})}


def test_a_scorer_of_two_texts_and_the_registry(responses, tmp_path):
    closed = str(tmp_path / "closed")

    class Same:
        def __call__(self, a, b):
            return len(set(a.split()) & set(b.split()))

        def close(self):
            open(closed, "w").close()

    wanted = pairs.canonical_pairs(responses).select(*KEYS)
    got = scoring.scorer("pairwise", make=Same, column="same")(responses, wanted)
    texts = {(r["essay_file"], r["prompt"], r["response_index"]): r["response"] for r in responses.collect()}
    for r in got.collect():
        one, two = texts[r[0], r[1], r[2]], texts[r[0], r[3], r[4]]
        assert r["same"] == len(set(one.split()) & set(two.split()))
    import os

    assert os.path.exists(closed)
    with pytest.raises(Exception, match="not finite"):
        scoring.scorer("pairwise", make=lambda: lambda a, b: float("nan"))(responses, wanted).collect()
    with pytest.raises(KeyError, match="lexical"):
        scoring.scorer("nothing")
    with pytest.raises(ValueError, match="already"):
        scoring.register("lexical")(lambda: None)


# files and orders


def test_a_file_for_each_text(spark, tmp_path):
    rows = [("law", "courts", f"t{k}.txt", f"Text {k}\nwith two lines, é.", k) for k in range(30)]
    df = spark.createDataFrame(rows, "domain string, subject string, filename string, text string, n int").repartition(4)
    named = df.withColumn("file", F.concat_ws("/", "domain", "subject", "filename"))
    path = str(tmp_path / "corpus")
    files.write_texts(named, path, "file", "text", ("filename", "n"))
    assert sorted(tuple(r) for r in tables.read_corpus(spark, path).collect()) == sorted(r[:4] for r in rows)
    beside = files.read_texts_metadata(spark, path)
    back = tables.with_originals(beside, tables.read_corpus(spark, path)).collect()
    assert sorted((r["filename"], r["n"], r["original"]) for r in back) == sorted((r[2], r[4], r[3]) for r in rows)
    assert files.read_document(spark, path + "/_SUCCESS") == {"files": 30}
    with pytest.raises(FileExistsError):
        files.write_texts(named, path, "file")
    with pytest.raises(FileNotFoundError):
        files.read_texts_metadata(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("bad", [("../up.txt", "x"), ("/root.txt", "x"), (".hidden", "x"), ("_x", "x"), (None, "x"), ("ok.txt", None), ("a.txt", "again")])
def test_bad_names_write_nothing(spark, tmp_path, bad):
    df = spark.createDataFrame([("a.txt", "x"), bad], "filename string, text string")
    with pytest.raises(ValueError):
        files.write_texts(df, str(tmp_path / "x"))
    assert not (tmp_path / "x").exists()


def test_validation_corpus_round_trip(spark, tmp_path):
    """Extracts written as files, read again and joined with what they were made of."""
    docs = spark.createDataFrame([(k, " ".join(f"Sentence {j} of text {k}." for j in range(12))) for k in range(6)], "doc_id long, text string")
    found = validation.extracts(docs, "doc_id", "text")
    assert found.count() == 6
    named = found.select(F.concat("doc_id", F.lit(".txt")).alias("filename"), F.array_join("sentences", " ").alias("text"), "doc_id")
    path = str(tmp_path / "set")
    files.write_texts(named, path, metadata=("doc_id",))
    back = tables.with_originals(files.read_texts_metadata(spark, path), tables.read_texts(spark, path, "*.txt"))
    assert {r["doc_id"]: r["original"] for r in back.collect()} == {r["doc_id"]: r["text"].strip() for r in named.collect()}


def test_files_in_order_give_one_total_order(spark, tmp_path):
    rows = [(f"e{k % 97:03d}", "AB"[k % 2], k % 5 + 1, f"text {k}") for k in range(3_000)]
    df = spark.createDataFrame(rows, RESPONSES).dropDuplicates(["essay_file", "prompt", "response_index"]).repartition(7)
    path = str(tmp_path / "ordered")
    files.write_ordered(df, path, *files.RESPONSE_ORDER, files=200)
    assert len(files.ordered_files(spark, path)) > 150
    got = [tuple(r)[:3] for r in files.in_order(spark, path)]
    assert got == sorted(tuple(r)[:3] for r in df.collect())


def test_order_of_vectors(spark, tmp_path):
    rows = [(e, p[0], i, p[1], j, p, 2, 0.1, 0.1, 0.1, 0.1) for p in ("AB", "BB", "AA") for e in ("f", "e") for i in (2, 1) for j in (2, 1) if p == "AB" or i <= j]
    path = str(tmp_path / "vectors")
    files.write_ordered(spark.createDataFrame(rows, tables.VECTORS), path, *files.vector_order(), files=5)
    got = [(r["essay_file"], r["comparison_type"], r["response_index_1"], r["response_index_2"]) for r in files.in_order(spark, path)]
    kinds = {"AA": 0, "BB": 1, "AB": 2}
    assert got == sorted(got, key=lambda r: (r[0], kinds[r[1]], r[2], r[3])) and len(got) == len(rows)


def test_essays_must_be_there_and_have_text(spark, tmp_path):
    folder = tmp_path / "essays"
    with pytest.raises(NotADirectoryError):
        tables.read_essays(spark, str(folder))
    folder.mkdir()
    (folder / "notes.txt").write_text("other")
    with pytest.raises(ValueError, match="no files"):
        tables.read_essays(spark, str(folder))
    (folder / "b.md").write_text("  Second.\n")
    (folder / "a.md").write_text("First\nof two lines.")
    assert sorted(tuple(r) for r in tables.read_essays(spark, str(folder)).collect()) == [("a.md", "First\nof two lines."), ("b.md", "Second.")]
    with pytest.raises(NotADirectoryError):
        tables.read_essays(spark, str(folder / "a.md"))
    (folder / "c.md").write_text(" \n\t ")
    with pytest.raises(ValueError, match="c.md"):
        tables.read_essays(spark, str(folder))
    (folder / "c.md").write_text("")
    with pytest.raises(ValueError, match="no text"):
        tables.read_essays(spark, str(folder))
