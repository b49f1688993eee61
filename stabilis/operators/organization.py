"""Organization and meaning: sentence matrices, soft alignment of order, embeddings."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stabilis.functions.text import TERM, bound, sentences, words
from stabilis.operators.pairs import BLOCK, paired_blocks

#: Cells that texts which are compared together may have.
TILE = 1 << 18
#: Sharpness below which a softmax counts as even: what sums of its weights leave by rounding alone.
EVEN = 1e-12


def sentence_rows(responses: DataFrame, keys: list[str], text: str = "response") -> DataFrame:
    """keys, pos (from 0), sentence."""
    return responses.select(*keys, F.posexplode(sentences(F.col(text))).alias("pos", "sentence"))


def sliding(sents: Column, window: int) -> Column:
    """Each sentence joined with the next ones; past the end the last sentence repeats."""
    if window < 1:
        raise ValueError("window must be at least 1")
    n = F.size(sents)
    at = lambda i: F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda o: F.element_at(sents, F.least(i + o, n)))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(at(i), " "))).otherwise(F.array().cast("array<string>"))


def sentence_terms(responses: DataFrame, keys: list[str], sents: Column) -> DataFrame:
    """keys, pos, term, tf: terms of each sentence (array ``sents``), counted once per text."""
    rows = responses.select(*keys, F.posexplode(sents).alias("pos", "s"))
    return rows.select(*keys, "pos", F.explode(words(F.col("s"), TERM)).alias("term")).groupBy(*keys, "pos", "term").agg(F.count(F.lit(1)).alias("tf"))


def sentence_matrix(pairs: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """keys, i, j, score: TF-IDF cosine of every sentence of one side with every one of the other.

    ``pairs`` has keys, one and two (what tells the texts apart), n_1 and n_2 (their numbers of sentences); ``terms``
    has text, pos, term and tf, counted before. Inverse document frequencies are smooth and come from all sentences
    of both sides. Cells without a shared term are 0. Only the cells' own pair is crossed: rows are dealt by pair
    once, for the frequencies, the norms and the products.
    """
    sides = pairs.select(*keys, "n_1", "n_2", F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("one").alias("text")), F.struct(F.lit(2).alias("side"), F.col("two").alias("text")))).alias("x"))
    rows = sides.select(*keys, (F.col("n_1") + F.col("n_2")).alias("docs"), "x.side", "x.text").join(terms, "text").drop("text").repartition(*keys)
    rows = rows.withColumn("df", F.count(F.lit(1)).over(W.partitionBy(*keys, "term")))
    rows = rows.withColumn("w", F.col("tf") * (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1))
    rows = rows.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(*keys, "side", "pos"))))
    cell = lambda n: F.collect_list(F.when(F.col("side") == n, F.struct("pos", "w"))).alias(f"s{n}")
    shared = rows.groupBy(*keys, "term").agg(cell(1), cell(2)).filter((F.size("s1") > 0) & (F.size("s2") > 0))
    products = shared.select(*keys, F.explode("s1").alias("a"), "s2").select(*keys, "a", F.explode("s2").alias("b")).select(
        *keys, F.col("a.pos").alias("i"), F.col("b.pos").alias("j"), (F.col("a.w") * F.col("b.w")).alias("score")
    )
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    grid = pairs.filter("n_1 > 0 AND n_2 > 0").select(*keys, F.explode(upto("n_1")).alias("i"), "n_2").select(*keys, "i", F.explode(upto("n_2")).alias("j"), F.lit(0.0).alias("score"))
    return grid.unionByName(products).groupBy(*keys, "i", "j").agg(F.sum("score").alias("score"))


class Terms(NamedTuple):
    """Counted terms of the sentences of texts, which follow each other: where each text's sentences and entries begin (and
    the end); by entry the text, the sentence (numbered over all texts), the term's number, how often the sentence has it and
    how many sentences of the text do."""

    rows: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    row: np.ndarray
    term: np.ndarray
    tf: np.ndarray
    df: np.ndarray


def counted_terms(sizes: np.ndarray, row: np.ndarray, term: np.ndarray) -> Terms:
    """``Terms`` of texts with so many sentences, from the sentence and the number of each word."""
    rows = np.concatenate([[0], np.cumsum(sizes)])
    width = int(term.max()) + 1 if len(term) else 1
    cells, tf = np.unique(row * width + term, return_counts=True)
    row, term = np.divmod(cells, width)
    text = np.repeat(np.arange(len(sizes)), sizes)[row]
    _, own, df = np.unique(text * width + term, return_inverse=True, return_counts=True)
    return Terms(rows, np.searchsorted(text, np.arange(len(sizes) + 1)), text, row, term, tf.astype(float), df[own].astype(float))


def sentence_cosines(one: Terms, k: int, others: Terms, first: int, last: int) -> np.ndarray:
    """What ``sentence_matrix`` has of text ``k`` (a row for each sentence) with each of the texts ``first`` to ``last`` - 1 of
    the other side (a column for each sentence)."""
    x, y = slice(one.ends[k], one.ends[k + 1]), slice(others.ends[first], others.ends[last])
    terms, own = np.unique(one.term[x], return_inverse=True)
    place = np.full(max(one.term.max(initial=-1), others.term.max(initial=-1)) + 1, -1)
    place[terms] = np.arange(len(terms))
    sizes = np.diff(others.rows[first : last + 1])
    docs = one.rows[k + 1] - one.rows[k] + sizes.astype(float)
    text, row, at, df = others.text[y] - first, others.row[y] - others.rows[first], place[others.term[y]], others.df[y]
    shared = at >= 0
    here, there = np.zeros(len(terms)), np.zeros((len(sizes), len(terms)))
    here[own], there[text[shared], at[shared]] = one.df[x], df[shared]
    idf = np.log((1 + docs[:, None]) / (1 + here + there)) + 1
    w = others.tf[y] * (np.log((1 + docs[text]) / (1 + df + np.where(shared, here[at] if len(terms) else 0.0, 0.0))) + 1)
    w /= np.sqrt(np.bincount(row, w * w, sizes.sum()))[row]
    counts, weights = np.zeros((one.rows[k + 1] - one.rows[k], len(terms))), np.zeros((sizes.sum(), len(terms)))
    counts[one.row[x] - one.rows[k], own] = one.tf[x]
    weights[row[shared], at[shared]] = w[shared] * idf[text[shared], at[shared]]
    length = np.sqrt(counts**2 @ (idf**2).T)
    return (counts @ weights.T) / np.repeat(np.where(length > 0, length, 1.0), sizes, axis=1)


def _slid(sizes: np.ndarray, row: np.ndarray, term: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The sentence and the number of each word of ``sliding`` windows of sentences, from those of the sentences themselves."""
    ends = np.cumsum(sizes)
    text = np.searchsorted(ends, row, "right")
    first, last = (ends - sizes)[text], ends[text] - 1
    found = []
    for back in range(window):
        within = row - back >= first
        # (the last sentence fills what is left of a window)
        times = np.where(row[within] == last[within], window - back, 1)
        found.append((np.repeat(row[within] - back, times), np.repeat(term[within], times)))
    return tuple(np.concatenate(x) for x in zip(*found))


def _sides(batch, window: int = 1):
    """For a row of a batch of ``paired_blocks``, its sides: keys in order, and terms (of windows of sentences)."""
    columns = [batch.column(1), batch.column(2)]
    lists = [c.values.field(2) for c in columns]
    coded = pa.concat_arrays([x.values.values for x in lists]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    codes = [coded[: len(lists[0].values.values)], coded[len(lists[0].values.values) :]]
    ends = [[c.offsets.to_numpy(), x.offsets.to_numpy(), x.values.offsets.to_numpy()] for c, x in zip(columns, lists)]
    names = [(c.values.field(0).to_pylist(), c.values.field(1).to_numpy(zero_copy_only=False)) for c in columns]

    def of(row):
        found = []
        for side, (of_row, of_text, of_sentence) in enumerate(ends):
            prompt, index = names[side]
            keys = sorted((prompt[m], int(index[m]), m) for m in range(of_row[row], of_row[row + 1]))
            sizes = np.array([of_text[m + 1] - of_text[m] for *_, m in keys], np.int64)
            words = np.concatenate([np.zeros(0, np.int64), *[np.diff(of_sentence[of_text[m] : of_text[m + 1] + 1]) for *_, m in keys]]).astype(np.int64)
            own = np.concatenate([codes[side][:0], *[codes[side][of_sentence[of_text[m]] : of_sentence[of_text[m + 1]]] for *_, m in keys]])
            found.append((keys, sizes, np.repeat(np.arange(len(words)), words), own))
        # numbers of terms without gaps
        number = np.unique(np.concatenate([x[3] for x in found]), return_inverse=True)[1]
        cut = len(found[0][3])
        slid = lambda sizes, at, n: (at, n) if window == 1 else _slid(sizes, at, n, window)
        return [(keys, counted_terms(sizes, *slid(sizes, at, n))) for (keys, sizes, at, _), n in zip(found, (number[:cut], number[cut:]))]

    return of


def paired_cosines(batch: pa.RecordBatch, places: int | None = None, window: int = 1):
    """Essay, pair (see ``pairs.packed``) and matrix of the sentences (rounded, if so many places are given) of each pair of
    texts with sentences, of a batch of ``paired_blocks`` that carry the terms of each sentence (array of arrays). With a
    ``window`` the matrix is that of so many sentences each, as ``sliding`` joins them."""
    for *found, _ in paired_members(batch, places, window):
        yield tuple(found)


def paired_members(batch: pa.RecordBatch, places: int | None = None, window: int = 1):
    """``paired_cosines`` and where its two texts are: their places among the members of the batch, whose others follow."""
    first = len(batch.column(1).values)
    of, bit = _sides(batch, window), {"A": 0, "B": 1}
    for row, essay in enumerate(batch.column(0).to_pylist()):
        (left, one), (right, two) = of(row)
        apart = batch.column(2)[row].is_valid
        right, two = (right, two) if apart else (left, one)
        for k, x in enumerate(left):
            a = 0 if apart else k
            while a < len(right):
                room = TILE // max(1, one.ends[k + 1] - one.ends[k] + one.rows[k + 1] - one.rows[k])
                b = max(a + 1, int(np.searchsorted(two.rows, two.rows[a] + room, "right")) - 1)
                cells = sentence_cosines(one, k, two, a, b)
                cells = cells if places is None else np.round(cells, places)
                for n, y in enumerate(right[a:b], a):
                    score = cells[:, two.rows[n] - two.rows[a] : two.rows[n + 1] - two.rows[a]]
                    if score.size:
                        yield essay, ((bit[x[0]] * 2 + bit[y[0]]) << 60) + (x[1] << 30) + y[1], score, (x[2], y[2] + first if apart else y[2])
                a = b


def text_cells(texts: DataFrame, window: int = 1, block: int = BLOCK) -> DataFrame:
    """essay_file, pair (see ``pairs.packed``), i, j, score: ``sentence_matrix`` of all canonical pairs of texts, or that of
    ``sliding`` windows of so many sentences.

    ``texts`` has the keys of responses and ``s``, the terms of each sentence (array of arrays). Texts meet block by block, so
    that neither terms nor cells are shuffled for each pair; matrices leave a few at a time.
    """
    if window < 1:
        raise ValueError("window must be at least 1")

    def packed(found):
        essays, numbers, matrices = zip(*found)
        pair = pa.array(np.repeat(np.arange(len(found)), [m.size for m in matrices]))
        places = [np.divmod(np.arange(m.size, dtype=np.int32), np.int32(m.shape[1])) for m in matrices]
        columns = [pa.array(essays).take(pair), pa.array(numbers).take(pair), *[pa.array(np.concatenate(x)) for x in zip(*places)], pa.array(np.concatenate([m.ravel() for m in matrices]))]
        return pa.record_batch(columns, names=["essay_file", "pair", "i", "j", "score"])

    def run(batches):
        for batch in batches:
            held, cells = [], 0
            for found in paired_cosines(batch, window=window):
                held.append(found)
                cells += found[2].size
                if cells >= TILE:
                    yield packed(held)
                    held, cells = [], 0
            if held:
                yield packed(held)

    return paired_blocks(texts, "s", block=block).mapInArrow(run, "essay_file string, pair bigint, i int, j int, score double")


def _sharpness(entropy: Column, n: Column) -> Column:
    """How far the entropy of a softmax over n > 1 places stays under that of even weights. Rounding noise is 0, else it would
    settle, by the order of sums, which places of a pair without any sharp ones count."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - entropy / F.log(n.cast("double"))))
    return bound(c, lambda x: F.when(x < EVEN, 0.0).otherwise(x))


def _one_way(cells: DataFrame, keys: list[str], row: str, col: str, temperature: float) -> DataFrame:
    line = W.partitionBy(*keys, row)
    n = F.count(F.lit(1)).over(line)
    m = F.max(row).over(W.partitionBy(*keys)) + 1
    x = cells.select(
        *keys, row, col, n.alias("n"), F.when(m > 1, F.col(row) / (m - 1)).otherwise(0.0).alias("x"), F.exp((F.col("score") - F.max("score").over(line)) / temperature).alias("e")
    )
    x = x.withColumn("w", F.col("e") / F.sum("e").over(line))
    clipped = F.greatest(F.lit(1e-12), F.least(F.lit(1.0), "w"))
    rows = x.groupBy(*keys, row).agg(
        F.first("n").alias("n"),
        F.first("x").alias("x"),
        F.sum(F.col("w") * F.when(F.col("n") > 1, F.col(col) / (F.col("n") - 1)).otherwise(0.0)).alias("y"),
        F.sum(-clipped * F.log(clipped)).alias("h"),
    )
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    rows = rows.select(*keys, unit(1 - F.abs(F.col("x") - F.col("y"))).alias("p"), F.when(F.col("n") > 1, _sharpness(F.col("h"), F.col("n"))).otherwise(1.0).alias("c"))
    total = rows.groupBy(*keys).agg(F.sum(F.col("p") * F.col("c")).alias("pc"), F.sum("c").alias("c"), F.avg("p").alias("p"))
    return total.select(*keys, F.coalesce(F.try_divide("pc", "c"), F.col("p")).alias("side"))


def soft_organization(cells: DataFrame, keys: list[str], temperature: float = 0.1) -> DataFrame:
    """keys, org: how well the order of one side's sentences follows the other's.

    Each sentence's softmax over the other side's gives its expected place; places are compared and weighed by how
    sharp (of low entropy) the softmax is; both directions are averaged. Pairs without cells have no row (score 0).
    """
    if not temperature > 0:
        raise ValueError("temperature must be positive")
    dealt = cells.repartition(*keys)  # all windows and sums below are of one pair
    one, two = _one_way(dealt, keys, "i", "j", temperature), _one_way(dealt, keys, "j", "i", temperature).withColumnRenamed("side", "other")
    return one.join(two, keys).select(*keys, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("side") + F.col("other")) / 2)).alias("org"))


def _aligned(lines: Column, temperature: float) -> Column:
    """``_one_way`` of a matrix in one row (array of arrays)."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    total = lambda values, of: F.aggregate(values, F.lit(0.0), lambda s, v: s + of(v))
    place = lambda k, n: F.when(n > 1, k / (n - 1)).otherwise(0.0)

    def line(scores: Column, at: Column) -> Column:
        n = F.size(scores)

        def weighed(w: Column) -> Column:
            y = total(F.transform(w, lambda x, k: x * place(k, n)), lambda x: x)
            h = total(F.transform(w, lambda x: F.greatest(F.lit(1e-12), F.least(F.lit(1.0), x))), lambda x: -x * F.log(x))
            return F.struct(unit(1 - F.abs(place(at, F.size(lines)) - y)).alias("p"), F.when(n > 1, _sharpness(h, n)).otherwise(1.0).alias("c"))

        share = lambda e: bound(total(e, lambda x: x), lambda all_: F.transform(e, lambda x: x / all_))
        return bound(bound(bound(F.array_max(scores), lambda top: F.transform(scores, lambda x: F.exp((x - top) / temperature))), share), weighed)

    def side(rows: Column) -> Column:
        return F.coalesce(F.try_divide(total(rows, lambda r: r["p"] * r["c"]), total(rows, lambda r: r["c"])), total(rows, lambda r: r["p"]) / F.size(rows))

    return bound(F.transform(lines, line), side)


def soft_texts(texts: DataFrame, temperature: float = 0.1, block: int = BLOCK) -> DataFrame:
    """essay_file, pair (see ``pairs.packed``), org: ``soft_organization`` over the cells of ``sentence_matrix`` of all
    canonical pairs of texts.

    ``texts`` has the keys of responses and ``s``, the terms of each sentence (array of arrays). Texts meet block by block; a
    pair's matrix is one row, so that neither terms nor cells are shuffled.
    """
    if not temperature > 0:
        raise ValueError("temperature must be positive")

    def packed(found):
        essays, numbers, matrices = zip(*found)
        lines = pa.ListArray.from_arrays(_ends([x for m in matrices for x in [m.shape[1]] * len(m)]), np.concatenate([m.ravel() for m in matrices]))
        return pa.record_batch([pa.array(essays), pa.array(numbers), pa.ListArray.from_arrays(_ends([len(m) for m in matrices]), lines)], names=["essay_file", "pair", "cells"])

    def run(batches):
        for batch in batches:
            held, cells = [], 0
            for found in paired_cosines(batch):
                held.append(found)
                cells += found[2].size
                if cells >= TILE:
                    yield packed(held)
                    held, cells = [], 0
            if held:
                yield packed(held)

    rows = paired_blocks(texts, "s", block=block).mapInArrow(run, "essay_file string, pair bigint, cells array<array<double>>")
    across = F.transform(F.sequence(F.lit(0), F.size(F.get("cells", F.lit(0))) - 1), lambda j: F.transform("cells", lambda r: F.get(r, j)))
    org = lambda two: (_aligned(F.col("cells"), temperature) + _aligned(two, temperature)) / 2
    return rows.select("essay_file", "pair", F.greatest(F.lit(0.0), F.least(F.lit(1.0), bound(across, org))).alias("org"))


def _ends(sizes: list[int]) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())


def cosine_affine(a: Column, b: Column) -> Column:
    """(cosine + 1) / 2, clamped; null for a zero vector, a null vector or unequal lengths."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    cos = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when((F.size(a) == F.size(b)) & cos.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cos + 1) / 2)))


def meaning(bert_f1: Column, embedding: Column) -> Column:
    """Mean of a contextual F1 (not clamped) and the embedding similarity."""
    return (bert_f1 + embedding) / 2


def greedy_token_scores(pairs: DataFrame, baseline: float = 0.0) -> DataFrame:
    """pair_id, precision, recall, f1 from token embeddings: idf-weighted mean of each token's best cosine.

    Input: pair_id, cand and ref (array<array<float>>), cand_idf and ref_idf (array<float>). The three scores are
    rescaled by (x - baseline) / (1 - baseline). A side without tokens or idf gives 0 before rescaling.
    """
    import numpy as np

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                a, b = (np.array([np.asarray(t, np.float64) for t in x]) for x in (r.cand, r.ref))
                if not len(a) or not len(b):
                    p = q = 0.0
                else:
                    a, b = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) for x in (a, b))
                    cos = a @ b.T
                    wa, wb = np.asarray(r.cand_idf, float), np.asarray(r.ref_idf, float)
                    p = float((cos.max(1) * wa).sum() / wa.sum()) if wa.sum() else 0.0
                    q = float((cos.max(0) * wb).sum() / wb.sum()) if wb.sum() else 0.0
                f = 2 * p * q / (p + q) if p + q else 0.0
                rows.append((r.pair_id, *[(x - baseline) / (1 - baseline) for x in (p, q, f)]))
            yield pd.DataFrame(rows, columns=["pair_id", "precision", "recall", "f1"])

    kind = pairs.schema["pair_id"].dataType.simpleString()
    return pairs.select("pair_id", "cand", "ref", "cand_idf", "ref_idf").mapInPandas(run, f"pair_id {kind}, precision double, recall double, f1 double")
