"""Typed readers and the constraints that are checked where data enters."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stabilis.functions.text import stripped

RESPONSES = "essay_file STRING, prompt STRING, response_index INT, response STRING"
VECTORS = (
    "essay_file STRING, prompt_1 STRING, response_index_1 INT, prompt_2 STRING, response_index_2 INT, "
    "comparison_type STRING, response_count INT, org DOUBLE, lex DOUBLE, meaning DOUBLE, struct DOUBLE"
)
KEYS = ["essay_file", "prompt_1", "response_index_1", "prompt_2", "response_index_2"]
COMPONENTS = ["org", "lex", "meaning", "struct"]


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and quoted fields that may hold line breaks; a malformed row fails the job."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST", enforceSchema=False)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, RESPONSES)


def read_vectors(spark: SparkSession, source) -> DataFrame:
    """A vector table from a DataFrame, a Parquet folder or CSV."""
    if isinstance(source, DataFrame):
        return source
    return spark.read.schema(VECTORS).parquet(source) if source.rstrip("/").endswith(".parquet") else read_csv(spark, source, VECTORS)


def read_texts(spark: SparkSession, path: str, pattern: str = "*.md", recursive: bool = False) -> DataFrame:
    """Whole stripped files with their names: path, filename, text."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=recursive)
    where = F.input_file_name()
    return rows.select(where.alias("path"), F.element_at(F.split(where, "/"), -1).alias("filename"), stripped(F.col("value")).alias("text"))


def read_essays(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """essay_file and text of a folder's files. A folder that is not there, one without such files, and a file without text
    are errors: they would end in a run without essays, or with blank ones."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(where) or not system.getFileStatus(where).isDirectory():
        raise NotADirectoryError(f"there is no folder {path}")
    found = system.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where, pattern))
    if found is None or not len(found):
        raise ValueError(f"there are no files {pattern} in {path}")
    rows = read_texts(spark, path, pattern)
    blank = rows.filter(F.coalesce(F.col("text"), F.lit("")) == "").select("filename").limit(1).collect()
    if blank or rows.count() < len(found):
        raise ValueError(f"there is no text in {blank[0]['filename'] if blank else 'a file'}")
    return rows.select(F.col("filename").alias("essay_file"), "text")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Text files below domain/subject folders: domain, subject, filename, text; shallower files are left out."""
    rows = read_texts(spark, path, "*.txt", recursive=True)
    inner = F.split(F.regexp_replace("path", r"^.*?" + os.path.basename(path.rstrip("/")) + "/", ""), "/")
    return rows.withColumn("parts", inner).filter(F.size("parts") >= 3).select(
        F.element_at("parts", 1).alias("domain"), F.element_at("parts", 2).alias("subject"), "filename", "text"
    )


def sections(texts: DataFrame, names=("I", "II", "III", "IV"), key: str = "filename", text: str = "text") -> DataFrame:
    """key, section, body of ``## NAME`` headings; raises (when run) on duplicate, missing or empty sections."""
    head = r"(?m)^##\s+(" + "|".join(sorted(names, key=len, reverse=True)) + r")\s*$"
    found = F.regexp_extract_all(F.col(text), F.lit(head), F.lit(1))
    bodies = F.slice(F.split(F.col(text), head), 2, 1 << 20)
    wanted = F.array(*[F.lit(n) for n in names])
    ok = (F.size(found) == len(names)) & (F.size(F.array_except(wanted, found)) == 0) & ~F.exists(bodies, lambda b: stripped(b) == "")
    rows = F.arrays_zip(found.alias("section"), bodies.alias("body"))
    checked = F.when(ok, rows).otherwise(F.raise_error(F.concat(F.lit("sections missing, duplicate or empty in "), F.col(key))))
    return texts.select(key, F.explode(checked).alias("s")).select(key, "s.section", stripped(F.col("s.body")).alias("body"))


def read_metadata(path: str) -> dict:
    """JSON sidecar of a result file (driver-side: one small document)."""
    with open(os.path.splitext(path)[0] + ".metadata.json", encoding="utf-8") as f:
        return json.load(f)


def parse_conllu(parses: DataFrame, name: str = "name", conllu: str = "conllu") -> DataFrame:
    """CoNLL-U text to one row per token: sentence, token and running ids, fields, head (null for the root).

    Comments, multiword ranges, empty nodes and lines without ten columns are skipped. Sentences are numbered by
    their ``sent_id`` comment where that is a number, else by their order.
    """
    blocks = parses.select(name, F.posexplode(F.filter(F.split(conllu, r"\n\s*\n"), lambda b: F.trim(b) != "")).alias("block", "body"))
    ident = F.expr(r"try_cast(regexp_extract(body, '(?m)^# *sent_id *= *([0-9]+) *$', 1) AS INT)")
    lines = blocks.select(name, "block", F.coalesce(ident, F.col("block") + 1).alias("sentence_id"), F.posexplode(F.split("body", "\n")).alias("line", "raw"))
    cells = lines.withColumn("c", F.split("raw", "\t")).filter((F.size("c") == 10) & F.get("c", F.lit(0)).rlike("^[0-9]+$"))
    head = F.get("c", F.lit(6)).try_cast("int") if hasattr(F.col("x"), "try_cast") else F.get("c", F.lit(6)).cast("int")
    fields = {"text": 1, "lemma": 2, "upos": 3, "xpos": 4}
    return cells.select(
        name,
        "sentence_id",
        F.get("c", F.lit(0)).cast("int").alias("token_id"),
        F.row_number().over(W.partitionBy(name).orderBy("block", "line")).alias("global_token_id"),
        *[F.get("c", F.lit(i)).alias(k) for k, i in fields.items()],
        F.when(head != 0, head).alias("head_token_id"),
        F.get("c", F.lit(7)).alias("dependency_relation"),
    )


def response_violations(responses: DataFrame, expected: int | None = None) -> DataFrame:
    """rule, rows: how often each rule is broken; no row if none is. One pass over rows and one over groups."""
    blank = lambda c: F.col(c).isNull() | (stripped(F.col(c)) == "")
    rows = responses.agg(
        F.count_if(blank("essay_file")).alias("blank_essay"),
        F.count_if(F.coalesce(~F.col("prompt").isin("A", "B"), F.lit(True))).alias("unknown_prompt"),
        F.count_if(blank("response")).alias("blank_response"),
        F.count_if(F.coalesce(F.col("response_index") < 1, F.lit(True))).alias("bad_index"),
    )
    repeated = responses.groupBy("essay_file", "prompt", "response_index").count().filter("count > 1").agg(F.count(F.lit(1)).alias("duplicate_key"))
    groups = responses.groupBy("essay_file", "prompt").agg(F.max("response_index").alias("k"), F.count_distinct("response_index").alias("n"))
    essays = groups.groupBy("essay_file").agg(F.count_distinct("prompt").alias("prompts"), F.min("k").alias("low"), F.max("k").alias("high"), F.count_if(F.col("k") != F.col("n")).alias("gaps"))
    most = F.lit(expected) if expected else F.max("high").over(W.partitionBy())
    gaps = essays.withColumn("want", most).agg(F.count_if((F.col("prompts") != 2) | (F.col("gaps") > 0) | (F.col("low") != F.col("want")) | (F.col("high") != F.col("want"))).alias("incomplete_essay"))
    return _broken(rows.join(F.broadcast(repeated)).join(F.broadcast(gaps)))


def _broken(counts: DataFrame) -> DataFrame:
    """Unpivot one row of rule counts to the rules that are broken."""
    return counts.unpivot([], counts.columns, "rule", "rows").filter("rows > 0")


def vector_violations(vectors: DataFrame) -> DataFrame:
    """rule, rows over a vector table: keys, canonical order, types, scores and counts."""
    p1, p2, i, j, k = F.col("prompt_1"), F.col("prompt_2"), F.col("response_index_1"), F.col("response_index_2"), F.col("response_count")
    canonical = ((p1 == p2) & (i <= j)) | ((p1 == "A") & (p2 == "B"))
    finite = F.lit(True)
    for c in COMPONENTS:
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    false = F.lit(False)
    rules = {
        "blank_essay": F.col("essay_file").isNull() | (stripped(F.col("essay_file")) == ""),
        "bad_index": ~F.coalesce((i >= 1) & (j >= 1), false),
        "not_canonical": ~F.coalesce(p1.isin("A", "B") & p2.isin("A", "B") & canonical, false),
        "wrong_type": ~F.coalesce(F.col("comparison_type") == F.concat(p1, p2), false),
        "not_finite": ~finite,
        "bad_count": ~F.coalesce((k >= 2) & (i <= k) & (j <= k), false),
    }
    rows = vectors.agg(*[F.count_if(c).alias(n) for n, c in rules.items()], (F.count_distinct("response_count") - 1).alias("several_counts"))
    repeated = vectors.groupBy(*KEYS).count().filter("count > 1").agg(F.count(F.lit(1)).alias("duplicate_key"))
    return _broken(rows.join(F.broadcast(repeated)))


def differing(old: dict, new: dict, ignore: tuple[str, ...] = ("complete",)) -> list[str]:
    """Names whose values differ between two metadata documents; a run resumes only if there are none."""
    return sorted(k for k in (old.keys() | new.keys()) - set(ignore) if old.get(k) != new.get(k))


def check_resume(old: dict, new: dict, ignore: tuple[str, ...] = ("complete",)) -> None:
    """Raise where a stored run was made with other settings."""
    if names := differing(old, new, ignore):
        raise ValueError(f"stored results were made with other settings: {', '.join(names)}")


def check_response_resume(old: dict, new: dict) -> None:
    """Raise unless version, repeats, settings and seed policy are equal and no known essay has changed; new essays may
    be added. Essays are a name -> digest mapping under ``essays``."""
    check_resume(old, new, ("complete", "essays"))
    known, now = old.get("essays", {}), new.get("essays", {})
    if changed := sorted(e for e in known if known[e] != now.get(e)):
        raise ValueError(f"essays have changed: {', '.join(changed)}")


def check_complete(vectors: DataFrame, metadata: dict) -> None:
    """Raise unless the metadata says the run ended, and names the essays and the count that the vectors have."""
    if not metadata.get("complete"):
        raise ValueError("the vectors are not complete")
    found = vectors.agg(F.count_distinct("essay_file").alias("n"), F.min("response_count").alias("low"), F.max("response_count").alias("high")).first()
    missing = vectors.sparkSession.createDataFrame([(e,) for e in metadata["essays"]], "essay_file string").join(vectors.select("essay_file").distinct(), "essay_file", "left_anti")
    if found["n"] != len(metadata["essays"]) or missing.limit(1).count():
        raise ValueError("the vectors are of other essays than the metadata names")
    if not found["low"] == found["high"] == metadata["response_count"]:
        raise ValueError("the vectors have another response count than the metadata says")


def chart_violations(within: DataFrame) -> DataFrame:
    """rule, rows over a within-essay table: one row per essay and prompt, both prompts, finite values."""
    needed = ["essay_file", "prompt", "mean_distance", *[f"{c}_mean" for c in COMPONENTS]]
    if absent := [c for c in needed if c not in within.columns]:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    bad = F.lit(False)
    for c in needed[2:]:
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = within.agg(F.count_if(bad).alias("not_finite"), F.count_if(~F.col("prompt").isin("A", "B")).alias("unknown_prompt"))
    groups = within.groupBy("essay_file").agg(F.count_if(F.col("prompt") == "A").alias("a"), F.count_if(F.col("prompt") == "B").alias("b"))
    sums = groups.agg(F.count_if((F.col("a") > 1) | (F.col("b") > 1)).alias("duplicate_row"), F.count_if((F.col("a") == 0) | (F.col("b") == 0)).alias("missing_prompt"))
    return _broken(rows.join(F.broadcast(sums)))


def with_originals(metadata: DataFrame, texts: DataFrame, key: str = "filename") -> DataFrame:
    """Metadata rows with their original texts; raises (when run) where a text has no file."""
    found = metadata.join(texts.select(key, F.col("text").alias("original")), key, "left")
    gone = F.raise_error(F.concat(F.lit("no original for "), F.col(key))).cast("string")
    return found.withColumn("original", F.when(F.col("original").isNull(), gone).otherwise(F.col("original")))
