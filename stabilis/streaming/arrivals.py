"""Pairs of arriving responses with the responses seen before held as state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Pairs that a task hands over at a time.
TILE = 2_000


class _Cell(StatefulProcessor):
    """Responses of one essay and two shards (or one shard with itself); state: prompt and index to carried values."""

    def __init__(self, carry: list[str], types: list[T.DataType]):
        self.carry, self.types = carry, types

    def init(self, handle) -> None:
        values = T.StructType([T.StructField(f"v{k}", t) for k, t in enumerate([T.IntegerType(), *self.types])])
        self.seen = handle.getMapState("seen", T.StructType([T.StructField("prompt", T.StringType()), T.StructField("response_index", T.IntegerType())]), values)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        essay, low, high = key
        arrived: dict[tuple, tuple] = {}
        for pdf in rows:
            for shard, order, prompt, index, *values in pdf[["shard", "order", "prompt", "response_index", *self.carry]].itertuples(index=False, name=None):
                name, values = (prompt, int(index)), tuple(None if v is None or v is pd.NA else v for v in values)
                # of rows with one key the first counts, then the smallest values: the same row in every cell
                rank = (order, tuple((v is not None, str(v)) for v in values))
                if name not in arrived or rank < arrived[name][0]:
                    arrived[name] = (rank, (int(shard), *values))
        fresh = {name: row for name, (_, row) in sorted(arrived.items()) if not self.seen.containsKey(name)}
        if not fresh:
            return
        out = []
        for (old, values), known in [*((x, True) for x in self.seen.iterator()), *((x, False) for x in fresh.items())]:
            old, values = tuple(old), tuple(values)
            for name, row in fresh.items():
                if (low != high and row[0] == values[0]) or (not known and name > old):
                    continue  # met in the cell of their shard; or counted from the other side
                (a, left), (b, right) = sorted(((name, row), (old, values)), key=lambda x: x[0])
                out.append((essay, *a, *b, a[0] + b[0], *left[1:], *right[1:]))
                if len(out) == TILE:
                    yield self._frame(out)
                    out = []
        if out:
            yield self._frame(out)
        for name, row in fresh.items():
            self.seen.updateValue(name, row)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        sides = [f"{c}_{n}" for n in (1, 2) for c in self.carry]
        return pd.DataFrame(rows, columns=["essay_file", "prompt_1", "response_index_1", "prompt_2", "response_index_2", "comparison_type", *sides])

    def close(self) -> None:
        pass


def arriving_pairs(responses: DataFrame, carry: tuple[str, ...] = ("response",), shards: int = 1, order: str | None = None) -> DataFrame:
    """Canonical pairs (keys, comparison_type, ``carry`` of both sides) of a stream of responses, each once, in the batch
    that brings its later side.

    State holds key and ``carry`` of every response seen, by essay, in the state store: a batch reads the state of its own
    essays only, and no stored table. ``carry`` may be features computed on the stream, once per response. With several
    ``shards`` an essay's pairs are dealt to shards * (shards + 1) / 2 tasks, and each response is held by ``shards`` of them,
    so that an essay with a great part of all responses is not one task's.

    A response that comes again is ignored. Of rows with one key in one batch the one with the smallest ``order`` counts
    (without ``order``, or at a tie, the one with the smallest values). Rows with a null essay, prompt or index are left out;
    null values are carried. The RocksDB state store is needed and set for the session.
    """
    spark = responses.sparkSession
    if spark.conf.get(_PROVIDER) != _ROCKS:
        spark.conf.set(_PROVIDER, _ROCKS)
    types = [responses.schema[c].dataType for c in carry]
    keys = ["essay_file", "prompt", "response_index"]
    rows = responses.dropna(subset=keys).select(
        *[F.col(k) if k != "response_index" else F.col(k).cast("int").alias(k) for k in keys], *carry, (F.col(order).cast("double") if order else F.lit(0.0)).alias("order"), F.pmod(F.xxhash64("prompt", "response_index"), F.lit(shards)).cast("int").alias("shard")
    )
    cells = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("low", F.least("shard", "other")).withColumn("high", F.greatest("shard", "other"))
    sides = [T.StructField(f"{c}_{n}", t) for n in (1, 2) for c, t in zip(carry, types)]
    named = [("essay_file", T.StringType()), ("prompt_1", T.StringType()), ("response_index_1", T.IntegerType()), ("prompt_2", T.StringType()), ("response_index_2", T.IntegerType()), ("comparison_type", T.StringType())]
    schema = T.StructType([*[T.StructField(n, t) for n, t in named], *sides])
    return cells.groupBy("essay_file", "low", "high").transformWithStateInPandas(_Cell(list(carry), types), schema, "append", "none")


def score_arrivals(responses: DataFrame, done: str, checkpoint: str, score: Callable[[DataFrame], DataFrame], carry: tuple[str, ...] = ("response",), shards: int = 1, order: str | None = None) -> StreamingQuery:
    """Append the scores of the pairs that arriving responses complete to ``done`` (Parquet), each pair exactly once.

    ``score`` takes the pairs of ``arriving_pairs`` and gives back rows with the keys; it may not aggregate. Offsets, state and
    the files of a batch are committed together by ``checkpoint`` and the sink's log: a batch that is run again after a loss
    starts from the state before it, and its unfinished files are not listed.
    """
    pairs = score(arriving_pairs(responses, carry, shards, order))
    return pairs.writeStream.format("parquet").option("path", done).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
