"""Readers, constraints, sinks and the incremental job."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from stabilis.operators import pairs
from stabilis.sources import providers, sinks, tables
from stabilis.streaming.arrivals import score_arrivals
from stabilis.streaming.resume import score_stream


def make(spark, k=3):
    return spark.createDataFrame([(e, p, i, f'one, "two"\nthree {i}') for e in ("first.md", "second.md") for p in "AB" for i in range(1, k + 1)], tables.RESPONSES)


def test_csv_round_trip(spark, tmp_path):
    rows = make(spark)
    sinks.write_csv(rows, str(tmp_path / "r"), compressed=True)
    back = tables.read_responses(spark, str(tmp_path / "r"))
    assert back.exceptAll(rows).count() == 0 and rows.exceptAll(back).count() == 0
    with pytest.raises(Exception):
        sinks.write_csv(rows, str(tmp_path / "r"))
    with pytest.raises(Exception):
        spark.createDataFrame([("e", 1)], "essay string, i int").write.csv(str(tmp_path / "bad"), header=True)
        tables.read_responses(spark, str(tmp_path / "bad")).collect()


def test_response_rules(spark):
    rows = make(spark)
    rules = lambda df: {r["rule"] for r in tables.response_violations(df).collect()}
    assert rules(rows) == set()
    assert rules(rows.filter("NOT (essay_file = 'first.md' AND response_index = 3 AND prompt = 'A')")) == {"incomplete_essay"}
    assert "duplicate_key" in rules(rows.unionAll(rows.limit(1)))
    assert "blank_response" in rules(rows.withColumn("response", F.lit(" "))) and "unknown_prompt" in rules(rows.withColumn("prompt", F.lit("C")))
    assert pairs.missing_responses(rows.select("essay_file").distinct(), 4, rows).count() == 4


def test_sections(spark):
    good = "## I\none\n## II\ntwo\n## III\nthree\n## IV\nfour\n"
    df = spark.createDataFrame([("a.md", good)], "filename string, text string")
    got = tables.sections(df)
    assert {r["section"]: r["body"].strip() for r in got.collect()} == {"I": "one", "II": "two", "III": "three", "IV": "four"}
    assert [(r["section_1"], r["section_2"]) for r in pairs.section_pairs(got).orderBy("place").collect()] == [("I", "II"), ("I", "III"), ("II", "III"), ("I", "IV"), ("II", "IV"), ("III", "IV")]
    for bad in (good.replace("## IV", "## III"), good.replace("## IV\nfour\n", ""), good.replace("two", " ")):
        with pytest.raises(Exception):
            tables.sections(spark.createDataFrame([("a.md", bad)], "filename string, text string")).collect()


def test_conllu(spark):
    line = lambda *c: "\t".join(c)
    text = "\n".join([
        "# sent_id = 4", line("1-2", "du", "_", "_", "_", "_", "_", "_", "_", "_"), line("1", "de", "de", "ADP", "P", "_", "2", "case", "_", "_"), line("2", "le", "le", "DET", "D", "_", "0", "root", "_", "_"),
        line("2.1", "x", "_", "_", "_", "_", "_", "_", "_", "_"), "broken line", "", "# no id", line("1", "Fin", "fin", "NOUN", "N", "_", "0", "root", "_", "_"), "",
    ])
    got = tables.parse_conllu(spark.createDataFrame([("d", text)], "name string, conllu string")).orderBy("global_token_id").collect()
    assert [(r["sentence_id"], r["token_id"], r["global_token_id"], r["text"], r["head_token_id"]) for r in got] == [(4, 1, 1, "de", 2), (4, 2, 2, "le", None), (2, 1, 3, "Fin", None)]


def test_texts_and_metadata(spark, tmp_path):
    (tmp_path / "c" / "AH" / "art").mkdir(parents=True)
    (tmp_path / "c" / "AH" / "art" / "one.txt").write_text(" body \n")
    (tmp_path / "c" / "top.txt").write_text("no")
    assert [(r["domain"], r["subject"], r["filename"]) for r in tables.read_corpus(spark, str(tmp_path / "c")).collect()] == [("AH", "art", "one.txt")]
    sinks.write_metadata(str(tmp_path / "v.csv"), {"a": float("nan"), "b": [1, float("inf")], 3: "x"})
    assert tables.read_metadata(str(tmp_path / "v.csv")) == {"a": None, "b": [1, None], "3": "x"}


def test_report(spark, tmp_path):
    path = sinks.write_report(str(tmp_path / "report.md"), {"Rows": make(spark).limit(2), "Test": spark.createDataFrame([(1, 0.25)], "n int, x double")})
    body = open(path, encoding="utf-8").read()
    assert "## Rows" in body and "| n | x |" in body and "0.250000" in body


def test_incremental_scoring(spark, tmp_path):
    paths = [str(tmp_path / n) for n in ("in", "stored", "done", "check")]
    score = lambda df: df.select(*tables.KEYS, "comparison_type", F.lit(1.0).alias("org"))
    rows = make(spark)
    for part in (rows.filter("response_index < 3"), rows.filter("response_index = 3"), rows.filter("response_index = 3")):
        part.coalesce(1).write.mode("append").parquet(paths[0])
        stream = spark.readStream.schema(rows.schema).parquet(paths[0])
        score_stream(stream, paths[1], paths[2], paths[3], score).awaitTermination()
    done = spark.read.parquet(paths[2])
    assert done.count() == 42 == done.select(*tables.KEYS).distinct().count()


def test_gates(spark):
    old = {"repeats": 3, "seed": 1, "complete": False, "essays": {"a": "1"}}
    tables.check_resume(old, {**old, "complete": True})
    tables.check_response_resume(old, {**old, "essays": {"a": "1", "b": "2"}})
    for bad, check in (({**old, "repeats": 4}, tables.check_resume), ({**old, "essays": {"a": "2"}}, tables.check_response_resume), ({**old, "seed": 2}, tables.check_response_resume)):
        with pytest.raises(ValueError):
            check(old, bad)
    row = ("e", "A", 1, "A", 1, "AA", 3, 0.1, 0.2, 0.3, 0.4)
    vectors = spark.createDataFrame([row], tables.VECTORS)
    tables.check_complete(vectors, {"complete": True, "essays": ["e"], "response_count": 3})
    for change in ({"complete": False}, {"essays": ["f"]}, {"essays": ["e", "f"]}, {"response_count": 4}):
        with pytest.raises(ValueError):
            tables.check_complete(vectors, {"complete": True, "essays": ["e"], "response_count": 3, **change})


def test_chart_rules(spark):
    names = "essay_file string, prompt string, mean_distance double, " + ", ".join(f"{c}_mean double" for c in tables.COMPONENTS)
    good = [("e", p, 0.1, 0.1, 0.1, 0.1, 0.1) for p in "AB"]
    rules = lambda rows: {r["rule"] for r in tables.chart_violations(spark.createDataFrame(rows, names)).collect()}
    assert rules(good) == set()
    assert rules([*good, good[0]]) == {"duplicate_row"} and rules(good[:1]) == {"missing_prompt"} and rules([*good[:1], (*good[1][:2], float("nan"), 0.1, 0.1, 0.1, 0.1)]) == {"not_finite"}
    with pytest.raises(ValueError):
        tables.chart_violations(spark.createDataFrame(good, names).drop("prompt"))


def test_originals_and_providers(spark):
    meta = spark.createDataFrame([("a",), ("b",)], "filename string")
    texts = spark.createDataFrame([("a", "x"), ("c", "y")], "filename string, text string")
    assert [r["original"] for r in tables.with_originals(meta.filter("filename = 'a'"), texts).collect()] == ["x"]
    with pytest.raises(Exception, match="no original for b"):
        tables.with_originals(meta, texts).collect()
    rows = spark.createDataFrame([(1, "aa"), (2, "b"), (3, "aa"), (4, None)], "k int, t string")
    got = providers.provided(rows, ["k"], "t", "v", "array<double>", lambda: lambda ts: [[float(len(t))] for t in ts], batch=2)
    assert {r["k"]: r["v"] for r in got.collect()} == {1: [2.0], 2: [1.0], 3: [2.0], 4: [0.0]}
    with pytest.raises(Exception, match="gave 0 values"):
        providers.provided(rows, ["k"], "t", "v", "double", lambda: lambda ts: []).collect()


def test_logs(spark, tmp_path):
    units = spark.createDataFrame([("f", "loose", 1, "b"), ("f", "loose", 0, "a"), ("f", "strict", 0, "c")], "name string, label string, pos int, text string")
    assert sinks.numbered(units, "name").splitlines() == ["## Filename: f", "", "### loose", "", "1. a", "2. b", "### strict", "", "1. c"]
    found = spark.createDataFrame([(1, 0, 1, 0.5), (1, 0, 0, 0.9)], "k int, i int, j int, score double")
    assert sinks.match_log(found, ["k"]).splitlines()[2:] == ["| 1 | 0 | 0 | 0.900000 |", "| 1 | 0 | 1 | 0.500000 |"]
    scores = spark.createDataFrame([(f, n, "I", s, x) for f, x in (("a", 0.5), ("b", 1.0)) for n, s in ((1, "II"), (2, "III"))], "filename string, place int, section_1 string, section_2 string, lex double")
    report = sinks.calibration_report(scores, ["lex"])
    assert report.count("## ") == 3 and "| I-II | 0.750000 |" in report
    bad = spark.createDataFrame([("e", "A", 0, "A", 1, "AA", 3, 0.1, 0.2, 0.3, 0.4)], tables.VECTORS)
    with pytest.raises(ValueError, match="bad_index"):
        sinks.append_vectors(bad, str(tmp_path / "v"))
    sinks.append_vectors(bad.withColumn("response_index_1", F.lit(1)), str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).count() == 1


def test_catalogue(spark):
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(found) and len(found) >= 40
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "lex" in df.columns


@pytest.mark.parametrize("name", ["responses", "lexical_similarity", "soft_organization", "vectors", "bootstrap_shift", "between_stability", "continuity", "hotelling_t2", "mtld", "validation_edits", "cleaned_answers", "flattened_answers", "short_names", "section_pairs", "greedy_token_scores", "missing_responses", "conllu_tokens"])
def test_against_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("conversations", "documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got, want = __spark_entry__.queries()[name](spark, sf).toPandas(), con.sql(__spark_entry__.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    flat = lambda df: sorted(json.dumps([None if v != v else v for v in row], default=str) for row in df[columns].astype(object).values.tolist())
    assert sorted(got.columns) == columns and flat(got) == flat(want)


@pytest.mark.parametrize("shards", [1, 3])
def test_arrivals(spark, tmp_path, shards):
    """Every pair once, in the batch of its later side, whatever comes again; state only, no stored table."""
    rows = make(spark).withColumn("at", F.lit(1)).withColumn("extra", F.lit("x"))
    source, done, check = (str(tmp_path / n) for n in ("in", "done", "check"))
    score = lambda df: df.withColumn("both", F.length("response_1") + F.length("response_2"))
    again = rows.filter("response_index = 3").withColumn("response", F.lit("late")).withColumn("at", F.lit(9))
    odd = rows.limit(2).withColumn("prompt", F.lit(None).cast("string")).unionByName(rows.limit(1).withColumn("essay_file", F.lit("only.md")).withColumn("response", F.lit(None).cast("string")))
    seen = []
    for part in (rows.filter("response_index < 3").unionByName(odd), rows.filter("response_index = 3").unionByName(again), again, rows.limit(0)):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        score_arrivals(stream, done, check, score, shards=shards, order="at").awaitTermination()
        seen.append(spark.read.parquet(done).count())
    assert seen == [21, 43, 43, 43]
    got = {tuple(r[k] for k in tables.KEYS): (r["comparison_type"], r["response_1"], r["response_2"]) for r in spark.read.parquet(done).filter("essay_file <> 'only.md'").collect()}
    want = {tuple(r[k] for k in tables.KEYS): (r["comparison_type"], r["response_1"], r["response_2"]) for r in pairs.canonical_pairs(make(spark), "response").collect()}
    assert got == want


def test_arrivals_after_a_loss(spark, tmp_path):
    """A batch whose commit was lost runs again and adds nothing."""
    source, done, check = (str(tmp_path / n) for n in ("in", "done", "check"))
    rows = make(spark)
    run = lambda: score_arrivals(spark.readStream.schema(rows.schema).parquet(source), done, check, lambda df: df.drop("response_1", "response_2")).awaitTermination()
    for part in (rows.filter("response_index < 3"), rows.filter("response_index = 3")):
        part.write.mode("append").parquet(source)
        run()
    last = max((tmp_path / "check" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    run()
    found = spark.read.parquet(done)
    assert found.count() == 42 == found.select(*tables.KEYS).distinct().count()
