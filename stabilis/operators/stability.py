"""Stability statistics over a vector table: centroids, distances, shifts, bootstrap, intervals, Hotelling's test."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stabilis.plans.checkpoint import checkpointed
from stabilis.sources.tables import COMPONENTS

METRICS = ["mean_distance", *[f"{c}_mean" for c in COMPONENTS]]


def norm(columns) -> Column:
    return F.sqrt(sum((c * c for c in columns), F.lit(0.0)))


def without_self(vectors: DataFrame) -> DataFrame:
    """Drop self comparisons; AB keeps equal indices, which are different responses."""
    return vectors.filter((F.col("comparison_type") == "AB") | (F.col("response_index_1") != F.col("response_index_2")))


def vector_distances(vectors: DataFrame) -> DataFrame:
    """Within-prompt vectors with their distance to the centroid of their essay and prompt."""
    rows = without_self(vectors.filter(F.col("comparison_type").isin("AA", "BB"))).withColumn("prompt", F.col("prompt_1"))
    group = W.partitionBy("essay_file", "prompt")
    distance = norm([F.col(c) - F.avg(c).over(group) for c in COMPONENTS])
    return rows.select("essay_file", "prompt", "response_index_1", "response_index_2", *COMPONENTS, distance.alias("distance"))


def within_stability(vectors: DataFrame) -> DataFrame:
    """Per essay and prompt: pairs, mean distance, component means and sample deviations (null for one pair)."""
    return vector_distances(vectors).groupBy("essay_file", "prompt").agg(
        F.count(F.lit(1)).alias("pair_count"),
        F.avg("distance").alias("mean_distance"),
        *[F.avg(c).alias(f"{c}_mean") for c in COMPONENTS],
        *[F.stddev_samp(c).alias(f"{c}_sd") for c in COMPONENTS],
    )


#: Ranges that a group's values are dealt to in each of two rounds before the wanted ranks are looked for.
RANGES = 4_096


def _narrowed(rows: DataFrame, wanted: DataFrame, groups: list[str], small) -> tuple[DataFrame, DataFrame]:
    """Deal each part of each group to ranges between its smallest and largest value; keep the ranges that hold a wanted rank.

    ``rows`` has groups, part and value, ``wanted`` groups, part, rank (from 0, within the part) and place. Counts per range
    are combined before they are shuffled.
    """
    keys = [*groups, "part"]
    ends = rows.groupBy(*keys).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    share = F.try_divide(F.col("value") - F.col("low"), F.col("high") - F.col("low"))
    dealt = rows.join(small(ends), keys).withColumn("range", F.coalesce(F.least(F.floor(share * RANGES), F.lit(RANGES - 1)), F.lit(0).cast("long"))).drop("low", "high")
    counts = dealt.groupBy(*keys, "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*keys).orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    found = wanted.join(counts.withColumn("before", before), keys).filter("rank >= before AND rank < before + n")
    found = found.select(*groups, F.concat_ws("/", "part", "range").alias("part"), (F.col("rank") - F.col("before")).alias("rank"), "place")
    kept = dealt.select(*groups, F.concat_ws("/", "part", "range").alias("part"), "value")
    return kept.join(small(found.select(*keys).distinct()), keys, "left_semi"), found


def at_ranks(values: DataFrame, wanted: DataFrame, groups: list[str], value: str, few: bool) -> DataFrame:
    """groups, place and value of the values at wanted ranks (groups, rank from 0, place): exact, and no task holds a group.

    Two rounds of counts per range leave the ranges that hold a wanted rank; their distinct values are numbered. ``few``
    says that the number of groups has a bound, so that tables by group may be broadcast.
    """
    small = F.broadcast if few else (lambda df: df)
    rows = values.select(*groups, F.lit("").alias("part"), F.col(value).alias("value")).filter("value IS NOT NULL")
    wanted = wanted.withColumn("part", F.lit(""))
    for _ in range(2):
        rows, wanted = _narrowed(rows, wanted, groups, small)
    keys = [*groups, "part"]
    counts = rows.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    to = F.sum("n").over(W.partitionBy(*keys).orderBy("value"))
    return counts.withColumn("to", to).join(wanted, keys).filter("rank >= to - n AND rank < to").select(*groups, "place", "value")


def described(values: DataFrame, groups: list[str], value: str, few: bool = False) -> DataFrame:
    """count, mean, sd, min, q1, median, q3, max, iqr, range, cv per group; undefined ones are null, and null values do not
    count. Quartiles are exact and interpolated; see ``at_ranks`` for ``few``. A null in a group column is an error."""
    sums = values.groupBy(*groups).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    names = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    place = {n: (F.col("count") - 1) * F.lit(q) for n, q in names.items()}
    ranks = F.array(*[F.struct(F.lit(f"{n}_{side}").alias("place"), f(place[n]).cast("long").alias("rank")) for n in names for side, f in (("low", F.floor), ("high", F.ceil))])
    wanted = sums.filter("count > 0").select(*groups, F.explode(ranks).alias("x")).select(*groups, "x.place", "x.rank")
    found = at_ranks(values, wanted, groups, value, few).groupBy(*groups)
    found = found.agg(*[F.max(F.when(F.col("place") == f"{n}_{side}", F.col("value"))).alias(f"{n}_{side}") for n in names for side in ("low", "high")])
    between = lambda n: F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * (place[n] - F.floor(place[n]))
    q = sums.join(F.broadcast(found) if few else found, groups, "left").withColumns({n: between(n) for n in names})
    return q.select(
        *groups, "count", "mean", "sd", "min", "q1", "median", "q3", "max",
        (F.col("q3") - F.col("q1")).alias("iqr"), (F.col("max") - F.col("min")).alias("range"), F.try_divide("sd", "mean").alias("cv"),
    )


def between_stability(within: DataFrame) -> DataFrame:
    """``described`` across essays per prompt and metric: two prompts and five metrics, ten groups of any size."""
    values = checkpointed(within.select("prompt", *METRICS)).unpivot("prompt", METRICS, "metric", "value")
    return described(values, ["prompt", "metric"], "value", few=True)


def _contrast(rows: DataFrame, keys: list[str], side) -> DataFrame:
    """keys, baseline_*, delta_*, magnitude; side(kind, component) is a mean column."""
    for c in COMPONENTS:
        rows = rows.withColumn(f"baseline_{c}", (side("AA", c) + side("BB", c)) / 2)
        rows = rows.withColumn(f"delta_{c}", side("AB", c) - F.col(f"baseline_{c}"))
    return rows.withColumn("magnitude", norm([F.col(f"delta_{c}") for c in COMPONENTS]))


def prompt_shift(vectors: DataFrame) -> DataFrame:
    """Per essay: centroids of AA, BB (no self pairs) and AB, baseline, shift and its magnitude; one aggregate."""
    means = [F.avg(F.when(F.col("comparison_type") == t, F.col(c))).alias(f"{t.lower()}_{c}") for t in ("AA", "BB", "AB") for c in COMPONENTS]
    return _contrast(without_self(vectors).groupBy("essay_file").agg(*means), ["essay_file"], lambda t, c: F.col(f"{t.lower()}_{c}"))


def overall_shift(shifts: DataFrame) -> DataFrame:
    """Number of essays, mean magnitude and mean shift (mean of magnitudes, not magnitude of the mean). Essays without a
    shift (a prompt with one response) do not count."""
    return shifts.agg(F.count("magnitude").alias("essay_count"), F.avg("magnitude").alias("magnitude"), *[F.avg(f"delta_{c}").alias(f"delta_{c}") for c in COMPONENTS])


DELTAS = ["magnitude", *[f"delta_{c}" for c in COMPONENTS]]
#: Attempts at a sample with two different responses before it counts as impossible.
ATTEMPTS = 40
#: Replicates that are made at a time, and cells (replicates x pairs) that a tile of them may have.
CHUNK, TILE = 1_250, 1 << 19
#: Pairs that fill at least one in so many places of the matrix of ids are summed as a matrix.
FILLED = 4
#: Pairs from which on distances are products of matrices, and cells that a tile of those may have (it stays in a core's cache).
MANY, NEAR = 64, 1 << 16
#: Pairs below which all are held at once; so many chunks of replicates of an essay with fewer are made at a time.
FEW, LONG = 32, 4
#: Rows that leave at a time.
ROWS = 20_000
#: Responses of a prompt beyond which an essay's pairs are dealt in tiles of so many by so many; slots drawn at a time there.
SIDE, SLOTS = 256, 256
#: Fixed values of the counter-based generator: steps between counters, multipliers of the mixer.
REPLICATE_STEP, SLOT_STEP, MIX = 0x9E3779B1, 0x85EBCA6B, (0x7FEB352D, 0x846CA68B)
_LOW32 = np.uint64(0xFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    """32 near-random bits for each of 32 bits (held in 64)."""
    for shift, factor in zip((16, 15), MIX):
        x = ((x ^ (x >> np.uint64(shift))) * np.uint64(factor)) & _LOW32
    return x ^ (x >> np.uint64(16))


def _streams(seed: int, essay: str, prompt: str, first: int, replicates: int) -> np.ndarray:
    """Where the draws of each replicate start."""
    key = int(hashlib.md5(f"{seed}|{essay}|{prompt}".encode()).hexdigest()[:8], 16)
    return _mixed((np.uint64(key) + np.arange(first, first + replicates, dtype=np.uint64) * np.uint64(REPLICATE_STEP)) & _LOW32)


def _ids(streams: np.ndarray, start: int, stop: int, k: int) -> np.ndarray:
    """Ids from 1 to k of a range of slots, a row for each stream."""
    slots = np.arange(start, stop, dtype=np.uint64) * np.uint64(SLOT_STEP)
    return (_mixed((streams[:, None] + slots) & _LOW32) % np.uint64(k)).astype(np.int64) + 1


def drawn(seed: int, essay: str, prompt: str, k: int, first: int, replicates: int, attempts: int = ATTEMPTS) -> np.ndarray:
    """Seeded samples of k responses with replacement, a row for each of so many replicates from ``first`` (1, 2, ...) on;
    ids from 1.

    Draws are mixed counters: a key from (seed, essay, prompt), a step for each replicate, a step for each slot of each
    attempt; any replicate can be drawn by itself. The first attempt with two different ids counts; it raises if a sample
    fails every time.
    """
    stream = _streams(seed, essay, prompt, first, replicates)
    out, open_ = np.empty((replicates, k), np.int64), np.arange(replicates)
    for attempt in range(attempts):
        ids = _ids(stream[open_], attempt * k, (attempt + 1) * k, k)
        out[open_] = ids
        alike = np.ones(len(ids), bool)
        for c in range(1, k):
            alike &= ids[:, c] == ids[:, 0]
            if not alike.any():
                return out
        open_ = open_[alike]
    raise ValueError("a bootstrap sample kept a single response")


def counted(ids: np.ndarray, k: int) -> np.ndarray:
    """How often each id (column) occurs in each sample (row)."""
    rows = np.arange(len(ids))[:, None] * (k + 1) + ids
    return np.bincount(rows.ravel(), minlength=len(ids) * (k + 1)).reshape(len(ids), k + 1).astype(float)


def counted_between(seed: int, essay: str, prompt: str, k: int, first: int, replicates: int, low: int, high: int, attempts: int = ATTEMPTS) -> np.ndarray:
    """How often each id from ``low`` to ``high`` - 1 (column) occurs in each sample of ``drawn`` (row). Slots are drawn a few at
    a time, so that memory does not grow with k."""
    stream, open_, width = _streams(seed, essay, prompt, first, replicates), np.arange(replicates), high - low
    out = np.empty((replicates, width))
    for attempt in range(attempts):
        n = len(open_)
        count, least, most = np.zeros((n, width)), np.full(n, k), np.ones(n, np.int64)
        for a in range(attempt * k, (attempt + 1) * k, SLOTS):
            ids = _ids(stream[open_], a, min(a + SLOTS, (attempt + 1) * k), k)
            least, most = np.minimum(least, ids.min(1)), np.maximum(most, ids.max(1))
            row, col = np.nonzero((ids >= low) & (ids < high))
            count += np.bincount(row * width + ids[row, col] - low, minlength=n * width).reshape(n, width)
        out[open_] = count
        open_ = open_[least == most]
        if not len(open_):
            return out
    raise ValueError("a bootstrap sample kept a single response")


def _totals(first: np.ndarray, second: np.ndarray, i: np.ndarray, j: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Per sample the weight of all pairs and the weighted sum of each component, as products of matrices."""
    place, shape = i * second.shape[1] + j, (first.shape[1], second.shape[1])

    def total(values: np.ndarray) -> np.ndarray:
        return ((first @ np.bincount(place, values, shape[0] * shape[1]).reshape(shape)) * second).sum(1)

    return np.stack([total(np.ones(len(i))), *[total(scores[:, c]) for c in range(scores.shape[1])]], 1)


def _centres(first: np.ndarray, second: np.ndarray, i: np.ndarray, j: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """The centroids of ``weighted_means``, a component at a time."""
    sums = _totals(first, second, i, j, scores)
    with np.errstate(invalid="ignore", divide="ignore"):
        return sums[:, 1:] / sums[:, :1]


def _apart(first: np.ndarray, second: np.ndarray, i: np.ndarray, j: np.ndarray, scores: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Per sample the weighted sum of the pairs' distances to its centroid, walked in tiles. Squares of the distances of many
    pairs are one product of matrices (a square less twice the product, and the other square, about the middle of all pairs)."""
    out = np.zeros((len(first), 1))
    step = max(1, (TILE if len(i) < MANY else NEAR) // max(1, len(first)))
    tiles = [slice(a, a + step) for a in range(0, len(i), step)]
    if len(i) < MANY:
        for t in tiles:
            square = sum((scores[t, c] - centre[:, c, None]) ** 2 for c in range(scores.shape[1]))
            out += (first[:, i[t]] * second[:, j[t]] * np.sqrt(square)).sum(1, keepdims=True)
        return out
    # (a row for each pair: counts of an id then lie side by side)
    middle = scores.mean(0)
    scores, centre = scores - middle, centre - middle
    left = np.concatenate([scores, (scores**2).sum(1, keepdims=True), np.ones((len(i), 1))], 1)
    right = np.concatenate([-2 * centre, np.ones(out.shape), (centre**2).sum(1, keepdims=True)], 1).T
    one, two = np.ascontiguousarray(first.T), np.ascontiguousarray(second.T)
    for t in tiles:
        distance = left[t] @ right
        np.sqrt(np.maximum(distance, 0.0, out=distance), out=distance)
        weight = one[i[t]]
        weight *= two[j[t]]
        out[:, 0] += np.einsum("pr,pr->r", distance, weight)
    return out


def _few_means(first: np.ndarray, second: np.ndarray, i: np.ndarray, j: np.ndarray, scores: np.ndarray, distances: bool) -> np.ndarray:
    """``weighted_means`` of few pairs: a row for each pair, so that samples lie side by side."""
    weight = first.T[i] * second.T[j]
    total = weight.sum(0)
    with np.errstate(invalid="ignore", divide="ignore"):
        centre = [(weight * c[:, None]).sum(0) / total for c in scores.T]
        if not distances:
            return np.stack(centre, 1)
        square = sum((s[:, None] - c) ** 2 for s, c in zip(scores.T, centre))
        return np.stack([(weight * np.sqrt(square)).sum(0) / total, *centre], 1)


def weighted_means(first: np.ndarray, second: np.ndarray, i: np.ndarray, j: np.ndarray, scores: np.ndarray, distances: bool = True) -> np.ndarray:
    """Per sample: mean distance to its centroid (if asked for) and the centroid, of pairs (i, j) that weigh the product of
    the counts of both ids: as often as pairs of slots show them. Pairs are walked in tiles; centroids of many pairs that fill a
    matrix of ids well are products of matrices."""
    filled = first.shape[1] * second.shape[1] <= FILLED * len(i)
    if filled and not distances and len(i) >= FEW:
        return _centres(first, second, i, j, scores)
    if len(i) < FEW:
        return _few_means(first, second, i, j, scores, distances)
    if filled and len(i) >= MANY:
        sums = _totals(first, second, i, j, scores)
        with np.errstate(invalid="ignore", divide="ignore"):
            centre = sums[:, 1:] / sums[:, :1]
            return np.concatenate([_apart(first, second, i, j, scores, centre) / sums[:, :1], centre], 1)
    step = max(1, TILE // max(1, len(first)))
    tiles = [slice(a, a + step) for a in range(0, len(i), step)]
    total, centre = np.zeros((len(first), 1)), np.zeros((len(first), scores.shape[1]))
    for t in tiles:
        weight = first[:, i[t]] * second[:, j[t]]
        total += weight.sum(1, keepdims=True)
        centre += weight @ scores[t]
    with np.errstate(invalid="ignore", divide="ignore"):
        centre /= total
        if not distances:
            return centre
        return np.concatenate([_apart(first, second, i, j, scores, centre) / total, centre], 1)


def _resampled(pairs: dict[str, np.ndarray], essay: str, first: int, replicates: int, seed: int, distances: bool) -> dict[str, np.ndarray]:
    """``weighted_means`` of so many replicates from ``first`` on by comparison type, of tables (i, j, components). A prompt
    with a single response has none. Cross pairs have no distances."""
    counts, size = {}, {}
    for kind in ("AA", "BB"):
        if len(pairs[kind]):
            size[kind[0]] = int(pairs[kind][:, :2].max())
    for p, k in size.items():
        if k > 1:
            counts[p] = counted(drawn(seed, essay, p, k, first, replicates), k)
    out = {}
    for kind, table in pairs.items():
        if kind != "AB":
            table = table[table[:, 0] != table[:, 1]]
        if len(table) and kind[0] in counts and kind[1] in counts:
            i, j = table[:, 0].astype(int), table[:, 1].astype(int)
            out[kind] = weighted_means(counts[kind[0]], counts[kind[1]], i, j, table[:, 2:], distances and kind != "AB")
    return out


#: What tells replicates of large essays apart, and what is summed for each.
REPLICATE, SUMS = ["essay_file", "comparison_type", "replicate"], ["weight", *COMPONENTS]


#: What tells tiles apart.
TILES = ["essay_file", "comparison_type", "ti", "tj"]


def _tiles(rows: DataFrame, large: DataFrame, side: int) -> tuple[DataFrame, DataFrame]:
    """Tiles of pairs of large essays, at most ``side`` by ``side`` in a row, and their keys alone."""
    size = lambda at: F.when(F.substring("comparison_type", at, 1) == "A", F.col("size_A")).otherwise(F.col("size_B"))
    block = lambda n: F.floor((F.col(f"response_index_{n}") - 1) / side).cast("int")
    # a prompt with a single response has no replicate
    kept = without_self(rows).join(large, "essay_file").select("*", size(1).alias("n1"), size(2).alias("n2")).filter("n1 > 1 AND n2 > 1")
    pair = F.array(F.col("response_index_1").cast("double"), F.col("response_index_2").cast("double"), *COMPONENTS)
    kept = kept.select("essay_file", "comparison_type", block(1).alias("ti"), block(2).alias("tj"), "n1", "n2", pair.alias("row"))
    return kept.groupBy(*TILES, "n1", "n2").agg(F.collect_list("row").alias("pairs")), kept.select(*TILES).distinct()


def _tiled(rows: DataFrame, large: DataFrame, replicates: int, seed: int, side: int, tasks: int, distances: bool) -> DataFrame:
    """essay_file, comparison_type, replicate, components (the centroid) and, if asked for, mean_distance of large essays.

    Pairs are dealt in tiles of ``side`` by ``side`` responses. A tile gives its share of each replicate's sums; shares are
    added up by Spark, and distances are taken in a second walk over the tiles, which then have the centroids: neither a task
    nor a row holds an essay's pairs. ``large`` has essay_file, size_A and size_B, from ``_sizes``.
    """
    n = len(COMPONENTS)
    tiles, places = _tiles(rows, large, side)

    def walked(batches, made, names):
        """Rows that ``made`` gives for each chunk of replicates of each tile: of counts of ids, pairs, and the centroids that
        travel with the tile."""
        for batch in batches:
            for at in range(batch.num_rows):
                essay, kind, ti, tj, n1, n2 = (batch.column(c)[at].as_py() for c in range(6))
                table = batch.column(6)[at].values.flatten().to_numpy().reshape(-1, 2 + n)
                table = table[np.lexsort((table[:, 1], table[:, 0]))]
                i, j = table[:, 0].astype(int) - ti * side - 1, table[:, 1].astype(int) - tj * side - 1
                totals = np.stack([batch.column(c)[at].values.to_numpy(zero_copy_only=False) for c in range(7, batch.num_columns)], 1) if batch.num_columns > 7 else None
                for first in range(1, replicates + 1, CHUNK):
                    count = min(CHUNK, replicates - first + 1)
                    ids = lambda p, k, t: counted_between(seed, essay, p, k, first, count, t * side + 1, (t + 1) * side + 1)  # noqa: E731, B023
                    one = ids(kind[0], n1, ti)
                    two = one if (kind[0], ti) == (kind[1], tj) else ids(kind[1], n2, tj)
                    found = made(one, two, i, j, table[:, 2:], None if totals is None else totals[first - 1 : first - 1 + count])
                    keys = [pa.array([x]).take(pa.array(np.zeros(count, np.int64))) for x in (essay, kind)]
                    yield pa.record_batch([*keys, pa.array(np.arange(first, first + count, dtype=np.int32)), *[pa.array(np.ascontiguousarray(c)) for c in found.T]], names=[*REPLICATE, *names])
            del batch  # else it would be held while the next one is read

    def sums(batches):
        return walked(batches, lambda one, two, i, j, scores, _: _totals(one, two, i, j, scores), SUMS)

    def apart(batches):
        return walked(batches, lambda *a: np.concatenate([_apart(*a[:5], a[5][:, 1:]), a[5]], 1), ["apart", *SUMS])

    schema = lambda names: "essay_file string, comparison_type string, replicate int, " + ", ".join(f"{c} double" for c in names)
    share = lambda x: F.coalesce(F.try_divide(x, "weight"), F.lit(float("nan"))).alias(x)
    found = tiles.repartition(tasks, *TILES).mapInArrow(sums, schema(SUMS)).groupBy(*REPLICATE).agg(*[F.sum(c).alias(c) for c in SUMS])
    found = found.select(*REPLICATE, "weight", *[share(c) for c in COMPONENTS])
    if not distances:
        return found
    totals = found.groupBy("essay_file", "comparison_type").agg(F.array_sort(F.collect_list(F.struct("replicate", *SUMS))).alias("c"))
    dealt = places.join(totals, ["essay_file", "comparison_type"]).select(*TILES, *[F.col(f"c.{c}").alias(c) for c in SUMS])
    again = tiles.join(dealt, TILES).repartition(tasks, *TILES).select(*TILES, "n1", "n2", "pairs", *SUMS)
    away = again.mapInArrow(apart, schema(["apart", *SUMS])).groupBy(*REPLICATE).agg(F.sum("apart").alias("apart"), *[F.max(c).alias(c) for c in SUMS])
    return away.select(*REPLICATE, share("apart").alias("mean_distance"), *COMPONENTS)


def _sizes(rows: DataFrame) -> DataFrame:
    """essay_file, the largest number of a response, and by prompt that of its own pairs (null without any)."""
    index = F.greatest("response_index_1", "response_index_2")
    return rows.groupBy("essay_file").agg(F.max(index).alias("most"), *[F.max(F.when(F.col("comparison_type") == p + p, index)).alias(f"size_{p}") for p in "AB"])


def _replicated(vectors: DataFrame, replicates: int, seed: int, groups: list[str], names: list[str], kinds: list[str], distances: bool, rows_of, columns_of, arrays: bool) -> DataFrame:
    """Replicates of every essay, a row each or (``arrays``) as one array per group and chunk.

    Essays of up to ``SIDE`` responses of a prompt are dealt with chunks of their replicates, so that few essays fill all cores
    too; larger ones (some K * K pairs each) by ``_tiled``. ``rows_of`` and ``columns_of`` make the rows of both. The number of
    partitions is given, as there is far more to compute than to shuffle.
    """
    if replicates < 1 or seed < 0:
        raise ValueError("replicates must be at least 1 and seed at least 0")
    spark, every = vectors.sparkSession, vectors.filter(F.col("comparison_type").isin(*kinds))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    large = _sizes(every).filter(F.col("most") > SIDE).drop("most")
    rows = every.join(large, "essay_file", "left_anti")
    essays = rows.groupBy("essay_file").agg(F.collect_list(F.struct("comparison_type", F.array(F.col("response_index_1").cast("double"), F.col("response_index_2").cast("double"), *COMPONENTS).alias("row"))).alias("pairs"))
    chunk = lambda n: LONG * CHUNK if n < FEW else CHUNK
    step = F.when(F.size("pairs") < FEW, chunk(0)).otherwise(chunk(FEW))
    dealt = essays.select("essay_file", "pairs", F.explode(F.sequence(F.lit(1), F.lit(replicates), step)).alias("first"))
    dealt = dealt.repartition(tasks, "essay_file", "first")

    def made(essay, pairs, first):
        # tables of pairs in one order, whatever order the shuffle gave
        kind, row = pairs.field("comparison_type").to_numpy(zero_copy_only=False), pairs.field("row").flatten().to_numpy()
        row = row.reshape(-1, 2 + len(COMPONENTS))
        tables = {k: row[kind == k] for k in kinds}
        tables = {k: t[np.lexsort((t[:, 1], t[:, 0]))] for k, t in tables.items()}
        return rows_of(essay, _resampled(tables, essay, first, min(chunk(len(row)), replicates - first + 1), seed, distances))

    def together(held):
        """Rows of some groups and chunks."""
        of = pa.array(np.repeat(np.arange(len(held)), [len(found) for *_, found in held]))
        keys = [pa.array(g).take(of) for g in zip(*[group for group, *_ in held])]
        numbers = np.concatenate([np.arange(first, first + len(found), dtype=np.int32) for _, first, found in held])
        values = np.concatenate([found for *_, found in held]).T
        return pa.record_batch([*keys, pa.array(numbers), *[pa.array(np.ascontiguousarray(c)) for c in values]], names=[*groups, "replicate", *names])

    def run(batches):
        for batch in batches:
            pairs = batch.column(1)
            ends = pairs.offsets.to_numpy()
            held, waiting = [], 0
            for n, (essay, first) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                for *group, found in made(essay, pairs.values.slice(ends[n], ends[n + 1] - ends[n]), first):
                    if arrays:
                        ahead = pa.array([0, len(found)], pa.int32())
                        values = [pa.array(np.ascontiguousarray(found[:, c])) for c in range(len(names))]
                        yield pa.record_batch([*[pa.array([g]) for g in group], pa.array([first], pa.int32()), *[pa.ListArray.from_arrays(ahead, v) for v in values]], names=[*groups, "first", *names])
                        continue
                    held.append((group, first, found))
                    waiting += len(found)
                    if waiting >= ROWS:
                        yield together(held)
                        held, waiting = [], 0
            if held:
                yield together(held)
            del batch, pairs  # else they would be held while the next batch is read

    kind = "array<double>" if arrays else "double"
    schema = ", ".join([*[f"{g} string" for g in groups], "first int" if arrays else "replicate int", *[f"{n} {kind}" for n in names]])
    found = dealt.mapInArrow(run, schema)
    others = columns_of(_tiled(every, large, replicates, seed, SIDE, tasks, distances)).select(*groups, "replicate", *names)
    if not arrays:
        return found.unionByName(others)
    others = others.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("replicate", *names))).alias("c"))
    others = others.select(*groups, *[F.col(f"c.{n}").alias(n) for n in names])
    chunks = found.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("first", *names))).alias("c"))
    return chunks.select(*groups, *[F.flatten(F.col(f"c.{n}")).alias(n) for n in names]).unionByName(others)


def within_replicates(vectors: DataFrame, replicates: int, seed: int, arrays: bool = True) -> DataFrame:
    """essay_file, prompt and per metric the array of its values in every replicate of the resampled responses (or,
    without ``arrays``, replicate and its values, a row each)."""

    def rows(essay, found):
        return [(essay, kind[0], found[kind]) for kind in ("AA", "BB") if kind in found]

    def columns(found):
        return found.withColumns({"prompt": F.substring("comparison_type", 1, 1), **{f"{c}_mean": F.col(c) for c in COMPONENTS}})

    return _replicated(vectors, replicates, seed, ["essay_file", "prompt"], METRICS, ["AA", "BB"], True, rows, columns, arrays)


def shift_replicates(vectors: DataFrame, replicates: int, seed: int, arrays: bool = True) -> DataFrame:
    """essay_file and, for the magnitude and shift of the prompt contrast, the array of its values in every replicate (or,
    without ``arrays``, replicate and its values, a row each)."""

    def rows(essay, found):
        if len(found) < 3:
            return []
        delta = found["AB"] - (found["AA"] + found["BB"]) / 2
        return [(essay, np.concatenate([np.sqrt((delta**2).sum(1, keepdims=True)), delta], 1))]

    def columns(found):
        side = lambda kind, c: F.max(F.when(F.col("comparison_type") == kind, F.col(c)))
        deltas = [(side("AB", c) - (side("AA", c) + side("BB", c)) / 2).alias(f"delta_{c}") for c in COMPONENTS]
        all_ = found.groupBy("essay_file", "replicate").agg(F.count_distinct("comparison_type").alias("kinds"), *deltas).filter("kinds = 3")
        return all_.withColumn("magnitude", norm([F.col(f"delta_{c}") for c in COMPONENTS]))

    return _replicated(vectors, replicates, seed, ["essay_file"], DELTAS, ["AA", "BB", "AB"], False, rows, columns, arrays)


def bootstrap_within(vectors: DataFrame, replicates: int, seed: int) -> DataFrame:
    """essay_file, prompt, replicate, mean_distance and component means of the resampled within-prompt pairs."""
    return within_replicates(vectors, replicates, seed, arrays=False)


def bootstrap_shift(vectors: DataFrame, replicates: int, seed: int) -> DataFrame:
    """essay_file, replicate, magnitude and shift of the resampled prompt contrast."""
    return shift_replicates(vectors, replicates, seed, arrays=False)


def replicate_intervals(replicated: DataFrame, groups: list[str], metrics: list[str], directional=(), confidence: float = 0.95) -> DataFrame:
    """``intervals`` of arrays of replicates; every group's values are in its own row, so nothing is shuffled."""
    if not 0 < confidence < 1:
        raise ValueError("confidence must be between 0 and 1")

    def quantile(values: Column, q: float) -> Column:
        place = (F.size(values) - 1) * F.lit(q)
        low = F.floor(place).cast("int")
        a, b = F.get(values, low), F.get(values, F.least(low + 1, F.size(values) - 1))
        return a + (b - a) * (place - low)

    def interval(m: str) -> Column:
        share = F.size(F.filter(m, lambda x: x >= 0)) / F.size(m) if m in directional else F.lit(None).cast("double")
        tail = (1 - confidence) / 2
        return F.struct(F.lit(m).alias("metric"), F.sort_array(m).alias("v"), share.alias("directional"), F.lit(tail).alias("tail"))

    rows = replicated.select(*groups, F.explode(F.array(*[interval(m) for m in metrics])).alias("x")).select(*groups, "x.*")
    tail = (1 - confidence) / 2
    return rows.select(*groups, "metric", quantile(F.col("v"), tail).alias("low"), quantile(F.col("v"), 1 - tail).alias("high"), "directional")


def bootstrap_overall(shifts: DataFrame) -> DataFrame:
    return shifts.groupBy("replicate").agg(F.avg("magnitude").alias("magnitude"), *[F.avg(f"delta_{c}").alias(f"delta_{c}") for c in COMPONENTS])


def intervals(replicates: DataFrame, groups: list[str], metrics: list[str], directional=(), confidence: float = 0.95) -> DataFrame:
    """groups, metric, low, high, directional: percentile interval; share of values >= 0 for directional metrics. A group has
    a row for each replicate, some thousands, however many essays there are."""
    if not 0 < confidence < 1:
        raise ValueError("confidence must be between 0 and 1")
    tail = (1 - confidence) / 2
    long = replicates.unpivot(groups, metrics, "metric", "value")
    out = long.groupBy(*groups, "metric").agg(F.percentile("value", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"), F.avg((F.col("value") >= 0).cast("double")).alias("share"))
    return out.select(*groups, "metric", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"), F.when(F.col("metric").isin(*directional) if directional else F.lit(False), F.col("share")).alias("directional"))


def hotelling(shifts: DataFrame) -> DataFrame:
    """status, essays, t2, f, df1, df2, p of the one-sample test that the mean shift is zero; one row.

    Means, covariances and the largest magnitudes come from one aggregate; the driver solves a 4 x 4 system.
    Unavailable with four essays or fewer, a rank under four or a condition number over 1e12. Essays without a shift
    do not count.
    """
    names = [f"delta_{c}" for c in COMPONENTS]
    shifts = shifts.dropna(subset=names)
    p = len(names)
    row = shifts.agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(f"m{i}") for i, a in enumerate(names)],
        *[F.covar_samp(names[i], names[j]).alias(f"c{i}{j}") for i in range(p) for j in range(i, p)],
    ).first()
    n = row["n"]
    found = ("unavailable", n, None, None, p, None, None)
    if n > p:
        mean = np.array([row[f"m{i}"] for i in range(p)])
        cov = np.array([[row[f"c{min(i, j)}{max(i, j)}"] for j in range(p)] for i in range(p)])
        # singular values of the centred data are the roots of (n - 1) times the covariance's eigenvalues
        singular = np.sqrt(np.maximum(np.linalg.eigvalsh(cov), 0) * (n - 1))
        cond = np.linalg.cond(cov)
        if (singular > np.finfo(float).eps * max(n, p) * singular.max()).all() and np.isfinite(cond) and cond <= 1e12:
            t2 = float(n * mean @ np.linalg.solve(cov, mean))
            f, d2 = (n - p) / (p * (n - 1)) * t2, n - p
            x, a = d2 / (d2 + p * f), d2 / 2
            found = ("available", n, t2, float(f), p, d2, float(x**a * (1 + a * (1 - x))))
    return shifts.sparkSession.createDataFrame([found], "status string, essays long, t2 double, f double, df1 int, df2 int, p double")
