"""Values that native models make of texts: parsers, embedders, token encoders. Models are given as functions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts in one call, and words (with padding to the longest) in one call.
BATCH, BUDGET = 64, 1 << 16


def packed(sizes: list[int], batch: int, budget: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts, in falling order of size, for one call each: at most ``batch`` texts, and at most ``budget`` words
    when all are padded to the first. A text above the budget goes alone."""
    a = 0
    while a < len(sizes):
        b = min(a + batch, a + max(1, budget // max(1, sizes[a])), len(sizes))
        yield a, b
        a = b


def _exhausted(error: Exception) -> bool:
    return isinstance(error, MemoryError) or "out of memory" in str(error).lower()


def asked(provider: Callable[[list[str]], Iterator], texts: list[str]) -> list:
    """The provider's values of texts, one for each. Where it runs out of memory, halves are asked for by themselves."""
    try:
        got = list(provider(texts))
    except (MemoryError, RuntimeError) as error:
        if not _exhausted(error) or len(texts) == 1:
            raise
        half = len(texts) // 2
        return asked(provider, texts[:half]) + asked(provider, texts[half:])
    if len(got) != len(texts):
        raise ValueError(f"the provider gave {len(got)} values for {len(texts)} texts")
    return got


def _numbers(value) -> Iterator[list]:
    """The innermost lists of numbers in a value."""
    if isinstance(value, dict):
        for part in value.values():
            yield from _numbers(part)
    elif isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        if len(value) and isinstance(value[0], (float, int)) or getattr(value, "ndim", 0) == 1 and value.dtype.kind in "fiu":
            yield value
        else:
            for part in value:
                yield from _numbers(part)


def check(value, width: int | None) -> None:
    """Raise where a vector has another width or a number that is not finite."""
    for vector in _numbers(value):
        if width is not None and len(vector) != width:
            raise ValueError(f"the provider gave a vector of {len(vector)} numbers instead of {width}")
        if not all(map(math.isfinite, vector)):
            raise ValueError("the provider gave a number that is not finite")


def provided(
    rows: DataFrame, keys: list[str], text: str, name: str, schema: str, make: Callable[[], Callable[[list[str]], Iterator]],
    batch: int = BATCH, budget: int = BUDGET, width: int | None = None,
) -> DataFrame:
    """The rows with a column ``name`` that a provider makes of each distinct text.

    ``make`` builds the provider once per task; it takes a list of texts and gives back a value for each, and an error if it
    does not. If it has a method ``close``, that is called when the task ends, however it ends. Equal texts are sent once;
    null texts are sent as empty ones. Inside a partition the longest texts go first, packed to ``budget`` words with
    padding, so that calls are even and the largest one comes at once. Vectors are checked: all numbers finite, and
    ``width`` of them if it is given. The result does not depend on how texts are packed.
    """
    import pandas as pd

    def run(batches):
        provider = make()
        try:
            for pdf in batches:
                texts = pdf["text"].tolist()
                # values leave call by call: a partition's values are never held together
                for a, b in packed(pdf["size"].tolist(), batch, budget):
                    values = asked(provider, texts[a:b])
                    for value in values:
                        check(value, width)
                    yield pd.DataFrame({"text": texts[a:b], "value": pd.Series(values, dtype=object)})
        finally:
            if hasattr(provider, "close"):
                provider.close()

    source = rows.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("text"))
    distinct = source.select("text").distinct().withColumn("size", F.size(F.split("text", " ")))
    made = distinct.sortWithinPartitions(F.desc("size"), "text").mapInPandas(run, f"text string, value {schema}")
    return rows.join(source.join(made, "text").select(*keys, F.col("value").alias(name)), keys)
