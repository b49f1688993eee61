"""Small documents and named text files in any file system that Spark can reach."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stabilis.sources.sinks import clean


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def read_document(spark: SparkSession, path: str) -> dict | None:
    """A JSON document, or None where it is not there."""
    system, where = _place(spark, path)
    if not system.exists(where):
        return None
    stream = system.open(where)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
    finally:
        stream.close()


def write_document(spark: SparkSession, path: str, data: dict) -> None:
    """A JSON document: written beside its place, then moved there."""
    system, where = _place(spark, path)
    _, part = _place(spark, path + ".part")
    stream = system.create(part, True)
    try:
        stream.write(bytearray(json.dumps(clean(data), indent=2).encode("utf-8")))
    finally:
        stream.close()
    if system.exists(where):
        system.delete(where, False)
    if not system.rename(part, where):
        raise OSError(f"cannot move {part} to {path}")


def write_texts(texts: DataFrame, path: str, name: str = "filename", text: str = "text", metadata: tuple[str, ...] = ()) -> None:
    """One file per row below ``path``, named by a column (which may hold folders), and the other wanted columns as a
    Parquet table ``_metadata`` beside the files.

    Tasks write to files of their own and move them to their names at the end of the row, so a task that is run again leaves
    the same files. ``path`` must be new. Names must differ, stay below ``path`` and not begin with _ or a dot, and texts
    must not be null; a row that breaks this fails the job before any file is written. ``_SUCCESS`` is written last.
    """
    spark = texts.sparkSession
    system, where = _place(spark, path)
    if system.exists(where):
        raise FileExistsError(path)
    root = str(system.makeQualified(where).toString())
    named = F.col(name).isNotNull() & ~F.col(name).rlike(r"(^|/)[._]|^/|/$|//|^$") & F.col(text).isNotNull()
    bad = texts.filter(~F.coalesce(named, F.lit(False))).limit(1).count()
    if bad or texts.groupBy(name).count().filter("count > 1").limit(1).count():
        raise ValueError("names must be given, different and inside the folder, and texts must not be null")

    def run(batches):
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for file, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                target = f"{base}/{file}"
                files.create_dir(target.rpartition("/")[0], recursive=True)
                part = f"{target.rpartition('/')[0]}/.{target.rpartition('/')[2]}.part"
                with files.open_output_stream(part) as out:
                    out.write(body.encode("utf-8"))
                files.move(part, target)
            yield pa.record_batch([pa.array([len(batch)], pa.int64())], names=["n"])

    written = texts.select(F.col(name).cast("string"), F.col(text).cast("string")).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
    texts.select(name, *metadata).write.mode("errorifexists").parquet(f"{path}/_metadata")
    write_document(spark, f"{path}/_SUCCESS", {"files": written})


def read_texts_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The table beside files of ``write_texts``; an error where they were not all written."""
    if read_document(spark, f"{path}/_SUCCESS") is None:
        raise FileNotFoundError(f"{path} is not complete")
    return spark.read.parquet(f"{path}/_metadata")


def write_ordered(df: DataFrame, path: str, *order, files: int | None = None) -> None:
    """Parquet files whose names, in order, give the rows in one total order: rows are dealt by ranges of the order, sorted
    inside each range, and files are numbered by range. A reader needs no sort; see ``in_order``."""
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *order).sortWithinPartitions(*order).write.mode("errorifexists").parquet(path)


def ordered_files(spark: SparkSession, path: str) -> list[str]:
    """Files of ``write_ordered`` in the order of their rows."""
    system, where = _place(spark, path)
    return sorted(str(f.getPath().toString()) for f in system.listStatus(where) if f.getPath().getName().startswith("part-"))


def in_order(spark: SparkSession, path: str):
    """The rows of ``write_ordered``, one after the other, a file at a time."""
    for file in ordered_files(spark, path):
        yield from spark.read.parquet(file).coalesce(1).toLocalIterator()


#: Total orders of the result tables: responses, vectors (AA, BB, AB, then indices), results by essay, charts (A first).
RESPONSE_ORDER = ("essay_file", "prompt", "response_index")
ESSAY_ORDER = ("essay_file",)
CHART_ORDER = ("prompt", "essay_file")


def vector_order():
    kind = F.when(F.col("comparison_type") == "AA", 0).when(F.col("comparison_type") == "BB", 1).otherwise(2)
    return F.col("essay_file"), kind, F.col("response_index_1"), F.col("response_index_2")
