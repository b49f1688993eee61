"""Written tables that outlive executors."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a new one for a session on one machine; on a cluster that is
    an error, as executors do not share local folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def state(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files of a table."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    return "|".join(sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files))


def stored(spark: SparkSession, name: str, sources: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` made from the tables ``sources``: written once in a session, as Parquet in the shared folder, then
    read. Where their files have changed since, it is made anew."""
    mark = hashlib.md5("\n".join(state(spark, s) for s in sources).encode()).hexdigest()[:12]
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{mark}"
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the session's checkpoint folder and read from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
