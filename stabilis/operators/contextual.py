"""Contextual similarity of texts from token vectors: inverse document frequencies, best cosines, precision, recall, F1."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stabilis.functions.text import WORD
from stabilis.operators.pairs import BLOCK, RESPONSE, paired_blocks
from stabilis.sources.providers import provided
from stabilis.sources.tables import KEYS

#: What a token provider gives for a text.
TOKENS = "struct<tokens: array<string>, vectors: array<array<float>>>"
#: Numbers in a hashed vector, and the share of each neighbour in it.
WIDTH, NEIGHBOUR = 8, 0.5
#: Cells of a matrix of cosines that are held at a time.
TILE = 1 << 20
#: Words whose digests a worker keeps; beyond them it forgets all.
KNOWN = 50_000


def hashed_vectors():
    """A token provider for tests and machines without a model: a word's vector is its digest, plus half of its neighbours'."""
    known: dict[str, np.ndarray] = {}

    def vector(word: str) -> np.ndarray:
        if word not in known:
            if len(known) >= KNOWN:
                known.clear()
            digest = hashlib.md5(word.encode("utf-8", "surrogatepass")).digest()
            known[word] = np.frombuffer(digest, ">u2").astype(np.float32) / 32768 - 1
        return known[word]

    def encode(texts: list[str]):
        for text in texts:
            words = regex.findall(WORD, text.lower())
            own = np.zeros((len(words) + 2, WIDTH), np.float32)
            own[1:-1] = [vector(w) for w in words] if words else own[1:-1]
            yield {"tokens": words, "vectors": (own[1:-1] + NEIGHBOUR * (own[:-2] + own[2:])).tolist()}

    return encode


def token_vectors(responses: DataFrame, make=hashed_vectors, width: int = WIDTH, text: str = "response") -> DataFrame:
    """The keys of responses with tokens, vectors and idf of each (arrays); every distinct text is encoded once.

    idf is log((n + 1) / (df + 1)) over all n responses, as BERTScore's; a token that most responses have weighs little.
    A response without tokens has empty arrays.
    """
    rows = provided(responses.select(*RESPONSE, text), RESPONSE, text, "t", TOKENS, make, width=width).select(*RESPONSE, "t.tokens", "t.vectors")
    size = responses.agg(F.count(F.lit(1)).alias("size"))
    found = rows.select(*RESPONSE, F.posexplode("tokens").alias("p", "token"))
    df = found.select(*RESPONSE, "token").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.col("size") + 1).cast("double") / (F.col("df") + 1))
    weighed = found.join(df, "token").join(F.broadcast(size)).groupBy(*RESPONSE).agg(F.array_sort(F.collect_list(F.struct("p", idf.alias("idf")))).alias("w"))
    return rows.join(weighed.select(*RESPONSE, F.col("w.idf").alias("idf")), RESPONSE, "left").withColumn("idf", F.coalesce("idf", F.array().cast("array<double>")))


def best_cosines(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest cosine of each row of unit vectors with the other side's, walked in tiles."""
    rows, cols = np.full(len(one), -np.inf), np.full(len(two), -np.inf)
    step = max(1, TILE // max(1, len(two)))
    for a in range(0, len(one), step):
        cos = one[a : a + step] @ two.T
        rows[a : a + step] = cos.max(1)
        np.maximum(cols, cos.max(0), out=cols)
    return rows, cols


def matched(one, two, baseline: float = 0.0) -> tuple[float, float, float]:
    """Precision (of the first side), recall and F1 of sides (unit vectors, idf), rescaled by (x - baseline) / (1 - baseline).
    A side without tokens or weight gives 0 before rescaling."""
    p = r = 0.0
    if len(one[0]) and len(two[0]):
        best = best_cosines(one[0], two[0])
        p, r = (float((b * w).sum() / w.sum()) if w.sum() else 0.0 for b, w in zip(best, (one[1], two[1])))
    f = 2 * p * r / (p + r) if p + r else 0.0
    return tuple((x - baseline) / (1 - baseline) for x in (p, r, f))


def contextual_similarity(vectors: DataFrame, baseline: float = 0.0, block: int = BLOCK) -> DataFrame:
    """Keys, precision, recall and f1 of all canonical pairs, from ``token_vectors``.

    An essay's responses meet block by block, see ``paired_blocks``: a task holds the vectors of two blocks at a time.
    """
    both = paired_blocks(vectors, "vectors", "idf", block=block)

    def sides(column):
        """Of each row the keys, unit vectors and weights of its members, made when they are asked for."""
        ends, members = column.offsets.to_pylist(), column.values
        prompt, index, lists, weights = (members.field(n) for n in range(4))
        tokens, weight_ends = lists.offsets.to_numpy(), weights.offsets.to_numpy()
        starts, numbers, idf = lists.values.offsets.to_numpy(), lists.values.values.to_numpy(), weights.values.to_numpy()

        def of(row):
            out = []
            for m in range(ends[row], ends[row + 1]):
                a, b = tokens[m], tokens[m + 1]
                v = numbers[starts[a] : starts[b]].astype(np.float64).reshape(b - a, -1) if b > a else np.zeros((0, 1))
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                out.append(((prompt[m].as_py(), index[m].as_py()), (v, idf[weight_ends[m] : weight_ends[m + 1]].copy())))
            return sorted(out, key=lambda x: x[0])

        return of

    def run(batches):
        for batch in batches:
            one, two = sides(batch.column(1)), sides(batch.column(2))
            for row, essay in enumerate(batch.column(0).to_pylist()):
                left, right = one(row), two(row) if batch.column(2)[row].is_valid else None
                found = []
                for x, y in ((x, y) for k, x in enumerate(left) for y in (left[k:] if right is None else right)):
                    x, y = (x, y) if x[0] <= y[0] else (y, x)
                    found.append((essay, *x[0], *y[0], *matched(x[1], y[1], baseline)))
                columns = [pa.array(c, t) for c, t in zip(zip(*found), [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), *[pa.float64()] * 3])]
                yield pa.record_batch(columns, names=[*KEYS, "precision", "recall", "f1"])
            del batch, one, two  # else they would be held while the next batch is read

    return both.mapInArrow(run, "essay_file string, prompt_1 string, response_index_1 int, prompt_2 string, response_index_2 int, precision double, recall double, f1 double")
