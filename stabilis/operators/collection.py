"""Collecting responses from a generator, in a run that can be cut and taken up again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stabilis.functions import text as T
from stabilis.plans.checkpoint import exists
from stabilis.sources.files import read_document, write_document
from stabilis.sources.sinks import append_by_essay
from stabilis.sources.tables import RESPONSES, check_response_resume

#: How seeds are made; stored with a run, as a run with other seeds is another experiment.
SEED_POLICY = "first 32 bits of sha256 over JSON of base seed, essay, prompt and repetition"
#: Essays whose responses are made in one job: what a cut run may lose.
ESSAYS = 1_000


def stored_responses(spark: SparkSession, path: str) -> DataFrame:
    """What a run has collected, each key once; no rows where there is nothing yet. A part that was appended twice counts
    once: of the rows of a key, the smallest response."""
    if not exists(spark, path):
        return spark.createDataFrame([], RESPONSES)
    rows = spark.read.schema(RESPONSES).parquet(path)
    keys = ["essay_file", "prompt", "response_index"]
    return rows.groupBy(*keys).agg(F.min("response").alias("response"))


def missing_requests(essays: DataFrame, done: DataFrame, prompts: dict[str, str], task: str, repeats: int, seed: int) -> DataFrame:
    """essay_file, prompt, response_index, request and seed of the responses that are not there yet."""
    asked = F.explode(F.array(*[F.struct(F.lit(p).alias("prompt"), F.lit(words).alias("recipient")) for p, words in prompts.items()]))
    rows = essays.select("essay_file", "text", asked.alias("p"), F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("response_index"))
    rows = rows.select("essay_file", "p.prompt", "response_index", F.concat(F.lit(task), "text", F.lit("\n\n"), "p.recipient").alias("request"))
    keys = ["essay_file", "prompt", "response_index"]
    return rows.join(done.select(*keys), keys, "left_anti").withColumn("seed", T.derived_seed(seed, F.col("essay_file"), F.col("prompt"), F.col("response_index")))


def generated(requests: DataFrame, make: Callable[[], Callable[[str, int], str]]) -> DataFrame:
    """Responses to requests. ``make`` builds a generator once per task; it takes a request and a seed. Thoughts are taken
    out and white space is stripped; a response without anything else is an error, and so is one that is no text."""

    def run(batches):
        generator = make()
        try:
            for pdf in batches:
                found = [generator(r, int(s)) for r, s in zip(pdf["request"], pdf["seed"])]
                for e, p, i, text in zip(pdf["essay_file"], pdf["prompt"], pdf["response_index"], found):
                    if not isinstance(text, str):
                        raise ValueError(f"no response for {e}, {p}, {i}")
                yield pdf[["essay_file", "prompt", "response_index"]].assign(response=found)
        finally:
            if hasattr(generator, "close"):
                generator.close()

    rows = requests.select("essay_file", "prompt", "response_index", "request", "seed").mapInPandas(run, RESPONSES)
    answer = T.stripped(T.without_thoughts(F.col("response")))
    empty = F.raise_error(F.concat_ws(", ", F.lit("empty response for"), "essay_file", "prompt", "response_index")).cast("string")
    return rows.select("essay_file", "prompt", "response_index", F.when(answer == "", empty).otherwise(answer).alias("response"))


def collect_responses(
    essays: DataFrame, path: str, make: Callable[[], Callable[[str, int], str]], prompts: dict[str, str], repeats: int, seed: int,
    task: str = "", settings: dict | None = None, resume: bool = False, essays_per_job: int = ESSAYS,
) -> DataFrame:
    """Fill ``path`` (Parquet, by essay) with ``repeats`` responses of every essay (essay_file, text) and prompt.

    A sidecar ``path.metadata.json`` holds settings, seeds' policy and the essays' digests. A stored run is only taken up
    with ``resume``, with the same settings and unchanged essays (new ones may be added); then only missing keys are asked
    for. Essays go in jobs of ``essays_per_job``, each of which is appended as a whole or not at all, so a run that is cut
    loses at most one job, and asking again adds nothing twice. Blank essays, repeats below two and empty responses are
    errors. Gives back all responses.
    """
    spark = essays.sparkSession
    if repeats < 2:
        raise ValueError("repeats must be at least two")
    blank = essays.filter(F.col("text").isNull() | (T.stripped(F.col("text")) == "")).limit(1).count()
    digests = {r["essay_file"]: r["digest"] for r in essays.select("essay_file", F.sha2("text", 256).alias("digest")).toLocalIterator()}
    if blank or not digests:
        raise ValueError("essays must be there and have texts")
    if len(digests) != essays.count():
        raise ValueError("essays must have different names")
    sidecar = path.rstrip("/") + ".metadata.json"
    now = {"schema_version": 1, "repeats": repeats, "settings": {**(settings or {}), "task": task, "prompts": prompts, "seed": seed}, "seed_policy": SEED_POLICY, "essays": digests, "complete": False}
    before = read_document(spark, sidecar)
    if before is not None and not resume:
        raise FileExistsError(f"{path} holds responses; resume it or choose another place")
    if before is None and resume:
        raise FileNotFoundError(f"nothing to resume at {path}")
    if before is not None:
        check_response_resume(before, now)
    write_document(spark, sidecar, now)
    parts = -(-len(digests) // essays_per_job)
    part = F.pmod(F.xxhash64("essay_file"), F.lit(parts))
    for k in range(parts):
        asked = missing_requests(essays.filter(part == k), stored_responses(spark, path), prompts, task, repeats, seed)
        # (requests are dealt evenly: a response takes far longer to make than to move)
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        append_by_essay(generated(asked.repartition(tasks, "essay_file", "prompt", "response_index"), make), path)
    found = stored_responses(spark, path)
    if found.count() != len(digests) * len(prompts) * repeats:
        raise ValueError("responses are missing, or are of essays that the run does not know")
    write_document(spark, sidecar, {**now, "complete": True})
    return found
