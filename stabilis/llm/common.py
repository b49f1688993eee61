"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts, as a regular expression class body.
BLANK = r"\x20\x09-\x0D"
#: The remainder modulo 4 of crc32(doc_id as text) that is kept out of training.
HELD_OUT = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column | str) -> Column:
    """True where crc32 of the id's decimal text leaves remainder 2 modulo 4; a null id is not held out."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the reliable checkpoint folder of the session. Where none is set, one is made for a session
    on one machine; on a cluster that is an error, as executors do not share local folders."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return df.checkpoint()


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """df with ``rank``, 1, 2, 3 ... in the given total order. The sort is dealt by ranges; the driver sees only the number
    of rows of each range. No column of df may be named rank."""
    low = 33  # bits of a row's number within its partition
    rows = checkpointed(df.orderBy(*order).withColumn("rank", F.monotonically_increasing_id()))
    part = F.shiftright("rank", low)
    counts = sorted((r["part"], r["n"]) for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    ahead = np.cumsum([0, *[n for _, n in counts]])[:-1].tolist()
    offsets = df.sparkSession.createDataFrame([(p, a) for (p, _), a in zip(counts, ahead)], "ranked_part long, ranked_ahead long")
    inside = F.col("rank").bitwiseAND(F.lit((1 << low) - 1))
    return (
        rows.join(F.broadcast(offsets), part == F.col("ranked_part"))
        .withColumn("rank", F.col("ranked_ahead") + inside + 1)
        .drop("ranked_part", "ranked_ahead")
    )


def keyed(docs: DataFrame, **keys: Column) -> DataFrame:
    """The rows as one struct column ``row``, and keys beside it; no name of theirs can clash."""
    return docs.select(F.struct("*").alias("row"), *[c.alias(k) for k, c in keys.items()])


def utf8_buffer(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column without copying its values; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type)
    _, offsets, data = array.buffers()
    if len(array) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def words_of(raw: np.ndarray, off: np.ndarray, word: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of documents (a buffer and its n + 1 offsets), folded, a space after each, as one buffer; first byte, length
    and document of each word. ``word`` tells for each byte whether it belongs to a word, ``fold`` what it becomes."""
    # a blank after every document, so that no word goes from one into the next
    spaced = np.insert(raw, off[1:] - off[0], 32)
    inside = word[spaced]
    step = np.diff(inside.view(np.int8), prepend=np.int8(0))
    first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    kept = inside.copy()
    kept[last] = True
    joined = np.where(inside, fold[spaced], np.uint8(32))[kept]
    size = last - first
    begin = np.cumsum(size + 1) - size - 1
    ends = off[1:] - off[0] + np.arange(1, len(off))
    return joined, begin, size, np.searchsorted(ends, first, "right")


def words_at(raw: np.ndarray) -> np.ndarray:
    """The little-endian 64-bit word that starts at each byte; the last seven reach into zero padding."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray(len(raw), "<u8", padded.data, strides=(1,)).copy()


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift, in place): equal in, equal out, near-random bits."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x
