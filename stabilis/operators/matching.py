"""Matching of text units and the order measures over matches."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stabilis.operators.organization import paired_cosines, paired_members
from stabilis.operators.pairs import BLOCK, paired_blocks

#: Cells that problems which are solved together may have.
TILE = 1 << 18


def assignments(costs: list[np.ndarray]) -> list[np.ndarray]:
    """Of each cost matrix the row of each column (-1: none) in an assignment of least total cost; rows must not outnumber
    columns. Matrices of about one size are solved together."""
    out: list = [None] * len(costs)
    order = sorted(range(len(costs)), key=lambda k: costs[k].shape[::-1])
    a = 0
    while a < len(order):
        b, n = a, 0
        while b < len(order):
            n = max(n, len(costs[order[b]]))
            if b > a and (b - a + 1) * n * costs[order[b]].shape[1] > TILE:
                break
            b += 1
        for k, found in zip(order[a:b], _solved([costs[k] for k in order[a:b]])):
            out[k] = found
        a = b
    return out


def _solved(costs: list[np.ndarray]) -> list[np.ndarray]:
    """Shortest augmenting paths with potentials, vectorised over columns and matrices."""
    size, m = np.array([len(c) for c in costs]), max(c.shape[1] for c in costs)
    cost = np.full((len(costs), size.max(), m), np.inf)
    for k, c in enumerate(costs):
        cost[k, : c.shape[0], : c.shape[1]] = c
    u, v, row_of = np.zeros(cost.shape[:2]), np.zeros((len(costs), m)), np.full((len(costs), m), -1)
    for row in range(size.max()):
        own = np.flatnonzero(size > row)
        best, via, done = np.full((len(own), m), np.inf), np.full((len(own), m), -1), np.zeros((len(own), m), bool)
        at, col = np.full(len(own), row), np.full(len(own), -1)
        while len(own):
            slack = np.where(done, np.inf, cost[own, at] - u[own, at][:, None] - v[own])
            shorter = slack < best
            best, via = np.where(shorter, slack, best), np.where(shorter, col[:, None], via)
            open_best = np.where(done, np.inf, best)
            col = open_best.argmin(1)
            step = open_best[np.arange(len(own)), col]
            u[own, row] += step
            p, c = np.nonzero(done)
            u[own[p], row_of[own[p], c]] += step[p]
            v[own] -= np.where(done, step[:, None], 0.0)
            best -= np.where(done, 0.0, step[:, None])
            done[np.arange(len(own)), col] = True
            at = row_of[own, col]
            ends = at < 0
            if ends.any():
                p, c, path = own[ends], col[ends], via[ends]
                while len(p):
                    before = path[np.arange(len(p)), c]
                    row_of[p, c] = np.where(before >= 0, row_of[p, before], row)
                    p, c, path = p[before >= 0], before[before >= 0], path[before >= 0]
                own, best, via, done, at, col = (x[~ends] for x in (own, best, via, done, at, col))
    return [found[: c.shape[1]] for found, c in zip(row_of, costs)]


def assignment(cost: np.ndarray) -> np.ndarray:
    """Row of each column (-1: none) in an assignment of least total cost; rows must not outnumber columns."""
    return assignments([cost])[0]


def components(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """A number for each cell, equal for cells that are linked through common rows and columns."""
    label = rows.copy()
    while True:
        by_col = np.full(cols.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(by_col, cols, label)
        by_row = np.full(rows.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(by_row, rows, by_col[cols])
        if (by_row[rows] == label).all():
            return label
        label = by_row[rows]


def sparse_assignment(rows: np.ndarray, cols: np.ndarray, score: np.ndarray) -> list[int]:
    """Cells of an assignment with as many cells as possible and, among those, the greatest total score.

    Shortest augmenting paths over lists of cells by row, with a heap; memory grows with the cells. Every row has a column
    of its own where it stays alone, at a price above all that scores can make up for, so each path ends.
    """
    n, m = int(rows.max()) + 1, int(cols.max()) + 1
    alone = float(score.max() - score.min()) * (n + 1) + 1
    row, col = [*rows.tolist(), *range(n)], [*cols.tolist(), *range(m, m + n)]
    cost = [*(score.max() - score).tolist(), *[alone] * n]
    by_row: list[list[int]] = [[] for _ in range(n)]
    for c, r in enumerate(row):
        by_row[r].append(c)
    u, v = [0.0] * n, [0.0] * (m + n)
    cell_of_col: dict[int, int] = {}
    cell_of_row: dict[int, int] = {}
    for first in range(n):
        far, via, closed, heap = {}, {}, {}, []
        at, base = first, 0.0
        while True:
            for c in by_row[at]:
                j = col[c]
                d = base + cost[c] - u[at] - v[j]
                if j not in closed and d < far.get(j, np.inf):
                    far[j], via[j] = d, c
                    heapq.heappush(heap, (d, j))
            base, j = heapq.heappop(heap)
            while j in closed:
                base, j = heapq.heappop(heap)
            if j not in cell_of_col:
                break
            closed[j] = base
            at = row[cell_of_col[j]]
        u[first] += base
        for k, d in closed.items():
            u[row[cell_of_col[k]]] += base - d
            v[k] -= base - d
        while True:
            c = via[j]
            before = cell_of_row.get(row[c])
            cell_of_col[j] = cell_of_row[row[c]] = c
            if row[c] == first:
                break
            j = col[before]
    return sorted(c for c in cell_of_row.values() if c < len(rows))


#: A component whose cells fill at least one in so many places of its matrix is solved as a matrix.
DENSE = 3


def _core(i: np.ndarray, j: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Which eligible cells an assignment takes: components apart, dense ones as matrices."""
    taken = np.zeros(len(i), bool)
    label = components(i, j)
    order = np.argsort(label, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
        rows, r = np.unique(i[own], return_inverse=True)
        cols, c = np.unique(j[own], return_inverse=True)
        if len(own) * DENSE < len(rows) * len(cols):
            taken[own[sparse_assignment(r, c, score[own])]] = True
            continue
        # as many cells as possible come first: a missing one costs more than scores can make up for
        cost = np.full((len(rows), len(cols)), float(score[own].max() - score[own].min()) * (len(rows) + 1) + 1)
        cost[r, c] = score[own].max() - score[own]
        row_of = assignment(cost.T if len(rows) > len(cols) else cost)
        taken[own] = row_of[r] == c if len(rows) > len(cols) else row_of[c] == r
    return taken


def _matched(i: np.ndarray, j: np.ndarray, score: np.ndarray, capacity: int):
    """Cells taken by the assignment and, in order, as leftovers."""
    core = _core(i, j, score)
    return np.flatnonzero(core), _leftovers(i, j, score, core, capacity)


def _leftovers(i: np.ndarray, j: np.ndarray, score: np.ndarray, core: np.ndarray, capacity: int) -> np.ndarray:
    used_i, used_j = np.bincount(i[core], minlength=i.max() + 1), np.bincount(j[core], minlength=j.max() + 1)
    open_ = np.flatnonzero((used_i[i] == 0) | (used_j[j] == 0))
    rest = []
    for k in open_[np.lexsort((j[open_], i[open_], -score[open_]))].tolist():
        if used_i[i[k]] < capacity and used_j[j[k]] < capacity:
            used_i[i[k]] += 1
            used_j[j[k]] += 1
            rest.append(k)
    return np.array(rest, np.int64)


def _matched_matrices(scores: list[np.ndarray], capacity: int, least: float):
    """i, j, the cells taken by the assignment and, in order, as leftovers, of each matrix of scores; those without a cell
    under ``least`` are solved together."""
    whole = [k for k, s in enumerate(scores) if (s >= least).all()]
    costs = [scores[k].max() - scores[k] for k in whole]
    row_of = dict(zip(whole, assignments([c.T if len(c) > c.shape[1] else c for c in costs])))
    for k, s in enumerate(scores):
        if k not in row_of:
            i, j = np.nonzero(s >= least)
            yield i, j, *(_matched(i, j, s[i, j], capacity) if len(i) else (i, i))
            continue
        (n, m), other = s.shape, np.flatnonzero(row_of[k] >= 0)
        i, j = np.divmod(np.arange(n * m), m)
        core = np.zeros(n * m, bool)
        core[other * m + row_of[k][other] if n > m else row_of[k][other] * m + other] = True
        yield i, j, np.flatnonzero(core), _leftovers(i, j, s.ravel(), core, capacity) if n != m else other[:0]


def match_units(cells: DataFrame, keys: list[str], capacity: int = 2, least: float = 0.0) -> DataFrame:
    """keys, i, j, score, phase: one-to-one matches, as many as possible and of the greatest total score, then leftovers.

    Cells (keys, i, j, score) under ``least`` or without a score never match. After the assignment, pairs of which at least
    one side is still unmatched are taken by falling score (ties by i, then j) while both have matched under ``capacity``
    times. Eligible cells are dealt by pair and walked batch by batch; a pair's memory grows with its eligible cells.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    rows = cells.filter(F.col("score") >= least).select(*keys, F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("score").cast("double").alias("score"))
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "i", "j")

    def settled(table: pa.Table) -> pa.Table:
        """Matches of whole pairs, in order."""
        i, j, score = (table.column(n).to_numpy() for n in ("i", "j", "score"))
        takes, phases = [], []
        edges = _edges(table, keys)
        for a, b in zip(edges, edges[1:]):
            core, rest = _matched(i[a:b].astype(np.int64), j[a:b].astype(np.int64), score[a:b], capacity)
            takes += [core + a, rest + a]
            phases += ["assignment"] * len(core) + ["leftover"] * len(rest)
        out = table.take(pa.array(np.concatenate(takes).astype(np.int64)))
        return out.append_column("phase", pa.array(phases, pa.string())).combine_chunks()

    def run(batches):
        held: list[pa.Table] = []
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            edges = _edges(table, keys)
            # the last pair of a batch may go on in the next one
            if held and (len(edges) > 2 or _apart(held[-1], table, keys)):
                cut = 0 if _apart(held[-1], table, keys) else edges[1]
                yield from settled(pa.concat_tables([*held, table.slice(0, cut)])).to_batches()
                held, table = [], table.slice(cut)
                edges = _edges(table, keys)
            if not held and len(edges) > 2:
                yield from settled(table.slice(0, edges[-2])).to_batches()
                table = table.slice(edges[-2])
            held.append(table)
        if held:
            yield from settled(pa.concat_tables(held)).to_batches()

    kinds = ", ".join(f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in keys)
    return dealt.mapInArrow(run, f"{kinds}, i int, j int, score double, phase string")


#: Pairs of texts whose matches are made together.
TOGETHER = 1_024


def match_texts(texts: DataFrame, capacity: int = 2, least: float = 0.0, places: int = 6, block: int = BLOCK) -> DataFrame:
    """essay_file, pair (see ``pairs.packed``), i, j, score, phase: ``match_units`` over the cells of ``sentence_matrix``,
    rounded, of all canonical pairs of texts.

    ``texts`` has the keys of responses and ``s``, the terms of each sentence (array of arrays). Texts meet block by block,
    so that neither terms nor cells are shuffled for each pair; a pair's memory grows with its cells.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    both = paired_blocks(texts, "s", block=block)

    def settled(found):
        essays, numbers, matrices = zip(*found)
        parts = [(i[c], j[c], s[i[c], j[c]], len(core), len(rest)) for s, (i, j, core, rest) in zip(matrices, _matched_matrices(list(matrices), capacity, least)) for c in [np.concatenate([core, rest]).astype(np.int64)]]
        i, j, score, cores, rests = zip(*parts)
        pair = np.repeat(np.arange(len(found)), np.array(cores) + np.array(rests))
        phase = np.repeat(np.tile([0, 1], len(found)), np.array([cores, rests]).T.ravel())
        columns = [pa.array(essays).take(pa.array(pair)), pa.array(np.array(numbers)[pair]), *[pa.array(np.concatenate(x).astype(t)) for x, t in ((i, np.int32), (j, np.int32), (score, float))]]
        return pa.record_batch([*columns, pa.array(["assignment", "leftover"]).take(pa.array(phase))], names=["essay_file", "pair", "i", "j", "score", "phase"])

    def run(batches):
        for batch in batches:
            held, cells = [], 0
            for found in paired_cosines(batch, places):
                held.append(found)
                cells += found[2].size
                if len(held) == TOGETHER or cells >= TILE:
                    yield settled(held)
                    held, cells = [], 0
            if held:
                yield settled(held)

    return both.mapInArrow(run, "essay_file string, pair bigint, i int, j int, score double, phase string")


#: Columns of ``structure.matched_patterns`` that count.
COUNTS = ["n_patterns_a", "n_patterns_b", "n_pattern_types_a", "n_pattern_types_b", "n_shared_pattern_types"]


def _overlaps(batch: pa.RecordBatch):
    """Of matched units of a batch of ``paired_blocks``, whose fourth field has the patterns of each unit: structurality and
    ``COUNTS``. Units are told by the place of their text and their own."""
    lists = [batch.column(c).values.field(3) for c in (1, 2)]
    codes = pa.concat_arrays([x.values.values for x in lists]).dictionary_encode()
    width, codes = max(1, len(codes.dictionary)), codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    cut, units = len(lists[0].values.values), len(lists[0].values)
    texts = np.concatenate([lists[0].offsets.to_numpy()[:-1], lists[1].offsets.to_numpy()[:-1].astype(np.int64) + units]).astype(np.int64)
    sizes = np.concatenate([np.diff(x.values.offsets.to_numpy()) for x in lists])
    held = np.concatenate([codes[o[0] : o[-1]] for o, codes in ((lists[0].values.offsets.to_numpy(), codes[:cut]), (lists[1].values.offsets.to_numpy(), codes[cut:]))])
    types, times = np.unique(np.repeat(np.arange(len(sizes)), sizes) * width + held, return_counts=True)
    start = np.searchsorted(types, np.arange(len(sizes) + 1) * width)

    def of(one, i, two, j):
        a, b = texts[one] + i, texts[two] + j
        n = start[a + 1] - start[a]
        match = np.repeat(np.arange(len(a)), n)
        at = np.arange(len(match)) - np.repeat(np.cumsum(n) - n, n) + start[a][match]
        wanted = b[match] * width + types[at] % width
        there = np.minimum(np.searchsorted(types, wanted), max(0, len(types) - 1))
        both = types[there] == wanted
        low = np.bincount(match[both], np.minimum(times[at[both]], times[there[both]]), len(a))
        high = sizes[a] + sizes[b] - low
        share = np.divide(low, high, out=np.zeros(len(a)), where=high > 0)
        return [share, *[x.astype(np.int64) for x in (sizes[a], sizes[b], n, start[b + 1] - start[b], np.bincount(match[both], minlength=len(a)))]]

    return of


def match_patterns(texts: DataFrame, weight: float, least: float, capacity: int = 2, places: int = 6, block: int = BLOCK) -> DataFrame:
    """essay_file, pair (see ``pairs.packed``), i, j, structurality and ``COUNTS``: ``structure.matched_patterns`` of the units that
    ``match_units`` matches by similarity, blended with the closeness of places, of all canonical pairs of texts.

    ``texts`` has the keys of responses, ``s``, the terms of each unit, and ``p``, its patterns (arrays of arrays). Texts meet
    block by block, so that neither terms nor patterns, cells or matches are shuffled for each pair.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    place = lambda n: np.arange(n) / (n - 1) if n > 1 else np.zeros(n)

    def blend(score):
        close = 1 - np.abs(place(score.shape[0])[:, None] - place(score.shape[1]))
        return np.floor(((1 - weight) * score + weight * close) * 10**places + 0.5) / 10**places

    def settled(found, overlaps):
        essays, numbers, matrices, sides = zip(*found)
        taken = [(i[c], j[c]) for i, j, core, rest in _matched_matrices(list(map(blend, matrices)), capacity, least) for c in [np.concatenate([core, rest]).astype(np.int64)]]
        pair = np.repeat(np.arange(len(found)), [len(i) for i, _ in taken])
        i, j = (np.concatenate(x).astype(np.int64) for x in zip(*taken))
        one, two = np.array(sides)[pair].T
        columns = [pa.array(essays).take(pa.array(pair)), pa.array(np.array(numbers)[pair]), *[pa.array(x.astype(np.int32)) for x in (i, j)], *map(pa.array, overlaps(one, i, two, j))]
        return pa.record_batch(columns, names=["essay_file", "pair", "i", "j", "structurality", *COUNTS])

    def run(batches):
        for batch in batches:
            overlaps, held, cells = _overlaps(batch), [], 0
            for found in paired_members(batch):
                held.append(found)
                cells += found[2].size
                if len(held) == TOGETHER or cells >= TILE:
                    yield settled(held, overlaps)
                    held, cells = [], 0
            if held:
                yield settled(held, overlaps)

    counts = ", ".join(f"{c} bigint" for c in COUNTS)
    return paired_blocks(texts, "s", "p", block=block).mapInArrow(run, f"essay_file string, pair bigint, i int, j int, structurality double, {counts}")


def _edges(table: pa.Table, keys: list[str]) -> list[int]:
    """Where runs of equal keys begin, and the end."""
    new = np.zeros(max(0, len(table) - 1), bool)
    for k in keys:
        code = pc.fill_null(pc.dictionary_encode(table.column(k)).combine_chunks().indices, -1).to_numpy(zero_copy_only=False)
        new |= code[1:] != code[:-1]
    return [0, *(np.flatnonzero(new) + 1).tolist(), len(table)]


def _apart(before: pa.Table, after: pa.Table, keys: list[str]) -> bool:
    """Whether the last row of one table and the first of the next belong to different pairs."""
    return any(before.column(k)[-1].as_py() != after.column(k)[0].as_py() for k in keys)


def unmatched(units: DataFrame, matches: DataFrame, keys: list[str], side: str) -> DataFrame:
    """Units (keys, pos) without a match on the side "i" or "j"."""
    return units.join(matches.select(*keys, F.col(side).alias("pos")).distinct(), [*keys, "pos"], "left_anti")


def kendall(matches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tau: (tau-b + 1) / 2 of matched positions; one match gives 1, an undefined tau 0.5."""
    rows = matches.select(*keys, "i", "j", F.row_number().over(W.partitionBy(*keys).orderBy("i", "j")).alias("r"))
    later = rows.select(*keys, F.col("i").alias("i2"), F.col("j").alias("j2"), F.col("r").alias("r2"))
    sign = F.signum(F.col("i2") - F.col("i")) * F.signum(F.col("j2") - F.col("j"))
    pairs = rows.join(later, keys).filter("r < r2")
    sums = pairs.groupBy(*keys).agg(
        F.sum(sign).alias("s"), F.count_if(F.col("i") != F.col("i2")).alias("x"), F.count_if(F.col("j") != F.col("j2")).alias("y")
    )
    tau = F.try_divide("s", F.sqrt(F.col("x").cast("double")) * F.sqrt(F.col("y").cast("double")))
    return matches.select(*keys).distinct().join(sums, keys, "left").select(*keys, F.when(F.col("s").isNull(), 1.0).when(tau.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (tau + 1) / 2))).alias("tau"))


def positions(matches: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, position: mean closeness of relative positions; sizes has keys, n_a, n_b. A side of one unit is at 0."""
    place = lambda c, n: F.when(F.col(n) > 1, F.col(c) / (F.col(n) - 1)).otherwise(0.0)
    return matches.join(sizes, keys).groupBy(*keys).agg(F.avg(1 - F.abs(place("i", "n_a") - place("j", "n_b"))).alias("position"))


def continuity(matches: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, sequence: share of neighbouring matched units whose matches are neighbours too, averaged over both
    directions; sizes has keys, n_a, n_b.

    Only neighbours that both have matches are compared; a side without such neighbours scores 0, a side of one unit
    1, and a pair without matches 0.
    """

    def one_way(a: str, b: str) -> DataFrame:
        targets = matches.groupBy(*keys, a).agg(F.collect_set(b).alias("t"))
        following = targets.select(*keys, (F.col(a) - 1).alias(a), F.col("t").alias("t2"))
        hit = F.arrays_overlap(F.transform("t", lambda x: x + 1), F.col("t2"))
        return targets.join(following, [*keys, a]).groupBy(*keys).agg(F.avg(hit.cast("int")).alias(f"c_{a}"))

    side = lambda a, n: F.when(F.col(n) < 2, 1.0).otherwise(F.coalesce(f"c_{a}", F.lit(0.0)))
    matched = matches.select(*keys).distinct().withColumn("any", F.lit(True))
    rows = sizes.join(matched, keys, "left").join(one_way("i", "j"), keys, "left").join(one_way("j", "i"), keys, "left")
    return rows.select(*keys, F.when(F.col("any"), (side("i", "n_a") + side("j", "n_b")) / 2).otherwise(0.0).alias("sequence"))


def hard_organization(tau: Column, position: Column, sequence: Column) -> Column:
    return 0.34 * tau + 0.33 * position + 0.33 * sequence


def organization_of_matches(matches: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tau, position, sequence, org of every pair in ``sizes``: order measures over matches; all 0 without any."""
    rows = sizes.select(*keys)
    for part in (kendall(matches, keys), positions(matches, sizes, keys), continuity(matches, sizes, keys)):
        rows = rows.join(part, keys, "left")
    parts = [F.coalesce(c, F.lit(0.0)) for c in ("tau", "position", "sequence")]
    return rows.select(*keys, *[p.alias(c) for p, c in zip(parts, ("tau", "position", "sequence"))], hard_organization(*parts).alias("org"))


def mean_over_matches(matches: DataFrame, units: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """keys, mean: mean score of a pair's matches, 0 for pairs (rows of ``units``) without a match."""
    found = matches.groupBy(*keys).agg(F.avg(score).alias("mean"))
    return units.select(*keys).join(found, keys, "left").select(*keys, F.coalesce("mean", F.lit(0.0)).alias("mean"))


def ordered(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Matches of each pair by first unit, falling score, second unit; sorted inside partitions dealt by pair."""
    return matches.repartition(*keys).sortWithinPartitions(*keys, "i", F.desc("score"), "j")


def scored(cells: DataFrame, metric: str) -> DataFrame:
    """Matrix cells with one of ``precision``, ``recall``, ``f1`` as score; a value that is not finite is an error."""
    if metric not in ("precision", "recall", "f1"):
        raise ValueError("metric must be precision, recall or f1")
    value = F.col(metric)
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return cells.withColumn("score", F.when(bad, F.raise_error(F.lit("score is not finite")).cast("double")).otherwise(value))


def blended(bert: Column, tfidf: Column, position: Column | None = None, weight: float = 0.0) -> Column:
    """Mean of two scores, optionally mixed with the closeness of positions."""
    if not 0 <= weight <= 1:
        raise ValueError("weight must be between 0 and 1")
    semantic = (bert + tfidf) / 2
    return semantic if position is None else (1 - weight) * semantic + weight * position
