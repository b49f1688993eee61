"""Scorers of pairs by name, and scores that come from a store where it has them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stabilis.operators import contextual, lexis, pairs
from stabilis.sources.tables import KEYS

#: What a scorer is: from responses and the keys of wanted pairs to KEYS and its columns.
Scorer = Callable[[DataFrame, DataFrame], DataFrame]
_FACTORIES: dict[str, Callable[..., Scorer]] = {}


def register(name: str):
    """Add a factory of scorers under a name that is not taken."""

    def add(factory: Callable[..., Scorer]):
        if name in _FACTORIES:
            raise ValueError(f"there is a scorer {name} already")
        _FACTORIES[name] = factory
        return factory

    return add


def scorer(name: str, **settings) -> Scorer:
    """The scorer of a name, with its settings."""
    if name not in _FACTORIES:
        raise KeyError(f"no scorer {name}; there are {', '.join(sorted(_FACTORIES))}")
    return _FACTORIES[name](**settings)


@register("lexical")
def _lexical(size: int = 99) -> Scorer:
    def score(responses, wanted):
        some = responses.join(wanted.select("essay_file").distinct(), "essay_file", "left_semi")
        carried = ["mattr", "terms", "grams2", "grams3"]
        return lexis.lexical_similarity(pairs.wanted_pairs(lexis.lexical_columns(some, pairs.RESPONSE), wanted, *carried), KEYS, size).select(*KEYS, "lex")

    return score


@register("contextual")
def _contextual(baseline: float = 0.0, make=contextual.hashed_vectors, width: int | None = contextual.WIDTH) -> Scorer:
    """idf is that of all responses, whichever pairs are wanted."""

    def score(responses, wanted):
        vectors = contextual.token_vectors(responses, make, width)
        some = vectors.join(wanted.select("essay_file").distinct(), "essay_file", "left_semi")
        return contextual.contextual_similarity(some, baseline).join(wanted.select(*KEYS), KEYS, "left_semi")

    return score


@register("pairwise")
def _pairwise(make, column: str = "score") -> Scorer:
    """A function of two texts, built once per task by ``make``; a score that is not finite is an error."""

    def score(responses, wanted):
        import math

        def run(batches):
            function = make()
            try:
                for pdf in batches:
                    found = [float(function(a, b)) for a, b in zip(pdf["response_1"], pdf["response_2"])]
                    if not all(map(math.isfinite, found)):
                        raise ValueError("a score is not finite")
                    yield pdf[KEYS].assign(**{column: found})
            finally:
                if hasattr(function, "close"):
                    function.close()

        both = pairs.wanted_pairs(responses, wanted, "response").select(*KEYS, F.coalesce("response_1", F.lit("")).alias("response_1"), F.coalesce("response_2", F.lit("")).alias("response_2"))
        return both.mapInPandas(run, f"essay_file string, prompt_1 string, response_index_1 int, prompt_2 string, response_index_2 int, `{column}` double")

    return score


def scored(responses: DataFrame, wanted: DataFrame, by: Scorer, stored: DataFrame | None = None) -> DataFrame:
    """KEYS, the scorer's columns and ``source`` of the wanted pairs: ``stored`` where the store has the pair (and a value),
    else ``scored``. Only pairs that the store does not have are computed; a pair that the store repeats comes once."""
    if stored is None:
        return by(responses, wanted).withColumn("source", F.lit("scored"))
    names = [c for c in stored.columns if c not in KEYS]
    # (Parquet partitioned by essay is pruned to the wanted essays by Spark itself)
    known = stored.dropna(subset=names).groupBy(*KEYS).agg(*[F.min(c).alias(c) for c in names]).join(wanted.select(*KEYS), KEYS, "left_semi")
    fresh = by(responses, wanted.select(*KEYS).join(known.select(*KEYS), KEYS, "left_anti")).select(*KEYS, *names)
    return known.withColumn("source", F.lit("stored")).unionByName(fresh.withColumn("source", F.lit("scored")))
