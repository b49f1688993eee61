"""Incremental scoring: new responses arrive as a stream, each batch adds the pairs it completes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stabilis.operators.pairs import canonical_pairs, missing_pairs
from stabilis.plans.checkpoint import exists
from stabilis.sources.tables import KEYS


def score_stream(responses: DataFrame, stored: str, done: str, checkpoint: str, score: Callable[[DataFrame], DataFrame], order: str | None = None) -> StreamingQuery:
    """Append arriving responses to ``stored`` and the scores of pairs that have none yet to ``done`` (Parquet folders).

    ``score`` takes canonical pairs (keys, comparison_type, response_1, response_2) and gives back rows with the keys.
    Of rows with one key in one batch the one with the smallest ``order`` stays, at a tie the smallest response. Only essays
    of the batch are paired again, from the stored table; ``arrivals.score_arrivals`` holds them as state instead. A batch that is run twice adds nothing: stored responses and scored
    pairs are anti-joined.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = _read(spark, stored, batch)
        keys = ["essay_file", "prompt", "response_index"]
        first = F.min_by(F.struct("*"), F.struct(*([order] if order else []), F.col("response")))
        fresh = batch.groupBy(*keys).agg(first.alias("row")).select("row.*").join(old.select(*keys), keys, "left_anti")
        fresh.write.mode("append").parquet(stored)
        essays = batch.select("essay_file").distinct()
        pairs = canonical_pairs(spark.read.parquet(stored).join(essays, "essay_file", "left_semi"), "response")
        score(missing_pairs(pairs, _read(spark, done, pairs.select(*KEYS)))).write.mode("append").parquet(done)

    return responses.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _read(spark, path: str, like: DataFrame) -> DataFrame:
    """A Parquet folder, or no rows where it is not there yet."""
    return spark.read.parquet(path) if exists(spark, path) else like.limit(0)
