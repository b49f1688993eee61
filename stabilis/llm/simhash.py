"""SimHash fingerprints and near-duplicate components through pivot distance tables.

Distinct fingerprints that may link share one of a few bit blocks (as many blocks as allowed bits, plus one), so rows
meet by block value. Where fingerprints meet, a table of their Hamming distances to reference fingerprints (pivots)
discards every pair that differs by more than the allowed bits in any coordinate, and the rest is verified. Crowded
blocks are split once more by the bits that are left. Components come from alternating star contractions on Spark.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stabilis.llm.common import checkpointed, keyed

#: Fixed by the contract: seed of XXH64, words in a shingle, bits that may differ.
SEED, WORDS, BITS = 42, 3, 3
#: Pivots in a distance table; fingerprints in a block from which on it is split by further bits.
PIVOTS, CROWDED = 16, 2_000
#: Shingles that are counted at a time.
_CHUNK = 1 << 15

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """64 bits, each set if more than half of the shingles' XXH64 have it; zero without words."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxh64_intdigest(joined, seed)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(parts) - words + 1].tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    counts = np.zeros(64, np.int64)
    for k in range(0, len(starts), _CHUNK):
        h = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[k : k + _CHUNK], stops[k : k + _CHUNK])], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(((counts * 2 > len(starts)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """id, twin (a hash of the text) and fp (the fingerprint's 64 bits as a signed long) of each row; null text counts
    as empty."""

    @F.pandas_udf("long")
    def run(texts):
        import pandas as pd

        return pd.Series(np.array([fingerprint(t, words, seed) for t in texts], np.uint64).astype(np.int64))

    return docs.select(F.col(id_col).alias("id"), _twin(text_col).alias("twin"), run(F.col(text_col)).alias("fp"))


def _twin(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, the same everywhere."""
    return np.array([int.from_bytes(hashlib.sha256(b"pivot%d" % k).digest()[:8], "little") for k in range(count)], np.uint64)


def distance_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distance of each fingerprint to each pivot."""
    return np.stack([np.bitwise_count(fps ^ p) for p in pivots()], axis=1).astype(np.int8)


def _verified(fps: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Which candidate pairs link: pivot coordinates first, a few at a time, then the bits themselves."""
    keep = np.arange(len(a))
    for k in range(0, table.shape[1], 4):
        keep = keep[(np.abs(table[a[keep], k : k + 4] - table[b[keep], k : k + 4]) <= bits).all(1)]
    return keep[np.bitwise_count(fps[a[keep]] ^ fps[b[keep]]) <= bits]


def _small(fps, table, key, bits):
    """Links within runs of equal keys, by comparing each row with the one d places on, for growing d."""
    out, rows, d = [], np.arange(len(fps)), 0
    while len(rows):
        d += 1
        rows = rows[rows + d < len(fps)]
        rows = rows[key[rows] == key[rows + d]]
        ok = _verified(fps, table, rows, rows + d, bits)
        out.append(np.stack([fps[rows[ok]], fps[rows[ok] + d]]))
    return out


def _crowd(fps: np.ndarray, table: np.ndarray, bits: int):
    """A spanning forest of one crowded block: each fingerprint meets only those that no tree has reached yet."""
    left = np.arange(len(fps))
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            ok = _verified(fps, table, np.full(len(left), x), left, bits)
            if len(ok):
                yield np.stack([np.full(len(ok), fps[x]), fps[left[ok]]])
                front.extend(left[ok].tolist())
                left = np.delete(left, ok)


def _links(bits: int, few: int = 48):
    def run(batches):
        """Rows come sorted by block; blocks that reach past a batch are carried over."""
        rest_key, rest_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def done(key, fp):
            if not len(key):
                return
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(start, len(key)))
            table = distance_table(fp)
            crowded = np.repeat(size > few, size)
            found = _small(fp[~crowded], table[~crowded], key[~crowded], bits)
            for s, n in zip(start[size > few], size[size > few]):
                found.extend(_crowd(fp[s : s + n], table[s : s + n], bits))
            for pair in found:
                if pair.shape[1]:
                    a, b = pair.astype(np.int64)
                    yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            key = np.concatenate([rest_key, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([rest_fp, batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint64)])
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if cut or len(key) > 4_000_000:
                yield from done(key[:cut], fp[:cut])
            rest_key, rest_fp = key[cut:], fp[cut:]
        yield from done(rest_key, rest_fp)

    return run


def _blocks(width: int, parts: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of ``parts`` nearly equal blocks of ``width`` bits."""
    at = [width * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def _part(fp, first: int, size: int):
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << size) - 1))


def links(fps: DataFrame, bits: int = BITS, crowded: int = CROWDED) -> DataFrame:
    """Links (a < b) between distinct fingerprints at most ``bits`` bits apart: enough of them to keep components.

    Two such fingerprints agree on one of bits + 1 blocks. A block value with more than ``crowded`` fingerprints is
    split by the same argument on the bits outside it, so that it spreads over (bits + 1) * 2**12 further values.
    """
    fp, parts = F.col("fp"), bits + 1
    first = _blocks(64, parts)
    rows = fps.select(fp, F.explode(F.array(*[F.struct(F.lit(t).alias("t"), _part(fp, *b).alias("v")) for t, b in enumerate(first)])).alias("k")).select("fp", "k.t", "k.v")
    counts = rows.groupBy("t", "v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowded).select("t", "v", F.lit(True).alias("hot"))
    rows = rows.join(counts, ["t", "v"], "left")
    second = F.lit(None)
    for t, (a, n) in enumerate(first):
        others = [bit for bit in range(64) if not a <= bit < a + n]
        pieces = []
        for s, (x, m) in enumerate(_blocks(len(others), parts)):
            runs = others[x : x + m]  # at most two runs of neighbouring bits
            gap = next((i for i in range(1, m) if runs[i] != runs[i - 1] + 1), m)
            value = _part(fp, runs[0], gap)
            if gap < m:
                value = F.shiftleft(value, m - gap).bitwiseOR(_part(fp, runs[gap], m - gap))
            pieces.append(F.lit((s + 1) << 20).bitwiseOR(value))
        second = F.when(F.col("t") == t, F.array(*[p.cast("long") for p in pieces])).otherwise(second)
    keyed = rows.select("fp", "t", "v", F.explode(F.when(F.col("hot"), second).otherwise(F.array(F.lit(0).cast("long")))).alias("s")).select(
        F.xxhash64("t", "v", "s").alias("key"), "fp"
    )
    return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_links(bits), "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root (smallest reachable node) of every node that has an edge; edges are (a, b) of longs.

    Large-star and small-star steps alternate until the edges stand still; each round is written to the checkpoint
    folder. Raises if that has not happened after ``rounds`` rounds (their number grows with the logarithm).
    """

    def state(e):
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        return (r[0], r[1])

    def star(e, large: bool):
        if large:
            e = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        joined = e.join(least, F.col("a") == F.col("u"))
        if large:
            out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.filter(F.col("a") != F.col("b")).distinct()

    edges = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b")))
    before = state(edges)
    for _ in range(rounds if before[0] else 0):
        edges = checkpointed(star(star(edges, True), False))
        now = state(edges)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, seed: int, bits: int, crowded: int) -> DataFrame:
    """Per row: id, twin, fp, component_id, component_size and first, the (id, twin) that stands for the component."""
    rows = checkpointed(fingerprints(docs, id_col, text_col, words, seed))
    order = F.struct(F.col("id").isNull().alias("unnamed"), "id", "twin")
    distinct = rows.groupBy("fp").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("n"))
    roots = components(links(distinct.select("fp"), bits, crowded))
    labelled = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    names = labelled.groupBy("root").agg(F.min("least").alias("first"), F.sum("n").alias("component_size"))
    named = labelled.select("fp", "root").join(names, "root").select("fp", F.col("first.id").alias("component_id"), "component_size", "first")
    return rows.join(named, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED, bits: int = BITS, crowded: int = CROWDED) -> DataFrame:
    """Per row: id, fingerprint (16 hex digits), component_id (smallest id reachable over links), component_size.

    Null and empty texts and texts of white space have fingerprint zero and link like others. Rows with equal
    fingerprints link; repeated rows repeat their result. Null ids never name a component unless it has no other id.
    An empty table gives an empty result. Other columns are ignored.
    """
    return _grouped(docs, id_col, text_col, words, seed, bits, crowded).select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        "component_size",
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED, bits: int = BITS, crowded: int = CROWDED) -> DataFrame:
    """The input's rows and columns with one document of each component: that of the smallest id (null only where it
    has no other) and, if this id has several texts in the component, of one text. Rows that repeat it stay.

    Rows are told apart by id and a hash of the text, so an id with several texts loses only those that go.
    """
    found = _grouped(docs, id_col, text_col, words, seed, bits, crowded)
    stays = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("twin") == F.col("first.twin"))
    gone = found.filter(~stays).select(F.col("id").alias("gone"), F.col("twin").alias("gone_twin"))
    rows = keyed(docs, id=F.col(id_col), twin=_twin(text_col))
    return rows.join(gone, F.col("id").eqNullSafe(F.col("gone")) & (F.col("twin") == F.col("gone_twin")), "left_anti").select("row.*")
