"""Importance resampling towards a target corpus, over hashed word n-grams, by a vectorised byte automaton.

Tasks read Arrow's UTF-8 buffers. A table of 256 entries classifies bytes and folds capitals; differences of the classes
are the borders of words; words are copied together with one space between. The CRC-32 of every run of one, two and three
words is then advanced through a table for all starts at once, byte by byte: the state after a run is the state from which
the next longer run goes on, so each word is read once for each length of run.

1. Each task counts its buckets; the counts of all tasks are added (at most ``buckets`` rows from each).
2. The gains of all buckets, a table of fixed size, go to the tasks, which add them up by document.
3. Documents are put in order of weight plus Gumbel noise (a hash of the id); ranks come from a range-partitioned sort.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stabilis.llm.common import checkpointed, ranked, utf8_buffer, words_of

#: Fixed by the contract: buckets, longest run of words, words that a document needs to be drawn, percent drawn, seed.
BUCKETS, WORDS, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Bytes of text that are split into words at a time (one document at least), and words that are hashed at a time.
_BYTES, _CHUNK = 1 << 20, 1 << 18
#: Starts that are still open from which on they are advanced together; fewer (very long words) go on one by one.
_TOGETHER = 16

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = _WORD[ord("A") : ord("Z") + 1] = _WORD[128:] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_CRC = _crc_table()


def run_hashes(joined: np.ndarray, begin: np.ndarray, size: np.ndarray, words: int = WORDS):
    """CRC-32 of the runs of 1, 2, ... ``words`` words that end at each word; the first n - 1 of n-word runs are not runs."""
    order = np.argsort(-size, kind="stable")
    at, lengths = begin[order], size[order]
    longest = int(lengths[0]) if len(lengths) else 0
    open_ = len(size) - np.cumsum(np.bincount(size, minlength=longest + 1))
    state = np.full(len(size), 0xFFFFFFFF, np.uint32)
    for n in range(words):
        if n:
            # the state after the run before this word, and the space between
            state = np.concatenate([state[:1], state[:-1]])
            state = _CRC[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8))
        lanes = state[order]
        for k in range(longest):
            m = int(open_[k])
            if m < _TOGETHER:
                for i in range(m):
                    rest = joined[at[i] + k : at[i] + lengths[i]].tobytes()
                    lanes[i] = zlib.crc32(rest, int(lanes[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
                break
            lanes[:m] = _CRC[(lanes[:m] ^ joined[at[:m] + k]) & np.uint32(255)] ^ (lanes[:m] >> np.uint32(8))
        state[order] = lanes
        yield state ^ np.uint32(0xFFFFFFFF)


def features(raw: np.ndarray, off: np.ndarray, buckets: int = BUCKETS, words: int = WORDS):
    """Pieces of (document, bucket) of all features, and the number of words of each document as (document, None)."""
    i = 0
    while i < len(off) - 1:
        j = max(i + 1, int(np.searchsorted(off, off[i] + _BYTES, "right")) - 1)
        joined, begin, size, doc = words_of(raw[off[i] : off[j]], off[i : j + 1], _WORD, _FOLD)
        for a in range(0, len(size), _CHUNK):
            lead = min(a, words - 1)  # words of the piece before, which runs may begin with
            part = slice(a - lead, a + _CHUNK)
            owner = doc[part]
            for n, crc in enumerate(run_hashes(joined, begin[part], size[part], words)):
                valid = np.arange(len(owner)) >= max(lead, n)
                if n:
                    valid[n:] &= owner[n:] == owner[: len(owner) - n]
                yield i + owner[valid], (crc[valid] % np.uint32(buckets)).astype(np.int64)
        yield i + np.arange(j - i), np.bincount(doc, minlength=j - i)[: j - i], "words"
        i = j


def bucket_counts(texts: DataFrame, text_col: str, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n of all features of all texts; null counts as empty."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for found in features(*utf8_buffer(batch.column(0)), buckets):
                if len(found) == 2:
                    total += np.bincount(found[1], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    counted = texts.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket, from the counts of the source and of the target."""
    n = {r["bucket"]: r["n"] for r in source.collect()}
    t = {r["bucket"]: r["n"] for r in target.collect()}
    rows = [(b, float(n.get(b, 0)), float(t.get(b, 0))) for b in range(buckets)]
    counts = source.sparkSession.createDataFrame(rows, "bucket long, s double, t double")
    ratio = (F.col("t") + 1) * (sum(n.values()) + float(buckets)) / ((F.col("s") + 1) * (sum(t.values()) + float(buckets)))
    found = counts.select("bucket", F.floor(F.log(ratio) * 1000).alias("gain")).orderBy("bucket").collect()
    return np.array([r["gain"] for r in found], np.int64)


def noise(id_col: Column, seed: int = SEED) -> Column:
    """floor(1000 x standard Gumbel noise), the same for an id in every run; a null id counts as empty text."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_features and weight (sum of gains)."""

    def run(batches):
        for batch in batches:
            size = len(batch)
            count, weight, n_words = (np.zeros(size, np.int64) for _ in range(3))
            for doc, value, *kind in features(*utf8_buffer(batch.column(1)), len(gain)):
                if kind:
                    n_words[doc] = value
                elif len(doc):
                    # documents come in ascending order: one sum for each stretch
                    new = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                    count[doc[new]] += np.diff(np.append(new, len(doc)))
                    weight[doc[new]] += np.add.reduceat(gain[value], new)
            yield pa.record_batch([batch.column(0), pa.array(n_words), pa.array(count), pa.array(weight)], names=["id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
    percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS,
) -> DataFrame:
    """One row per input row: id, n_features, weight, score and rank (null where the row is not drawn).

    Of the rows with ``least_words`` words or more, ``percent`` in a hundred (rounded down) are drawn: those with the
    highest scores, ties to the smaller id, a null id last. Rows that repeat an id and text tie in everything and take
    ranks next to each other, each its own. Null texts are empty: no features, weight 0, never drawn. A target without
    features leaves the source's own counts to decide. Other columns are ignored. An empty table gives an empty result.
    """
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_text, buckets), buckets)
    scored = weighed(docs, gain, id_col, text_col).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    scored = checkpointed(scored.withColumn("fits", F.col("n_words") >= least_words))
    number = scored.filter("fits").count() * percent // 100
    ordered = ranked(scored, F.desc("fits"), F.desc("score"), F.asc_nulls_last("id"), F.monotonically_increasing_id())
    drawn = F.when(F.col("fits") & (F.col("rank") <= number), F.col("rank"))
    return ordered.select(F.col("id").alias(id_col), "n_features", "weight", "score", drawn.alias("rank"))


def drawn_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns. Rows are told by id: of rows that repeat an id, all
    come back if one is drawn."""
    ids = resample(docs, target, id_col, text_col, **how).filter("rank IS NOT NULL").select(F.col(id_col).alias("drawn")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("key"))
    return rows.join(ids, F.col("key").eqNullSafe(F.col("drawn")), "left_semi").select("row.*")
