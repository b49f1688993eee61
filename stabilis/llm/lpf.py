"""Removal of repeated byte strings by longest-previous-factor arrays, over a corpus of any size.

A byte goes if a string of ``length`` bytes that covers it also starts earlier (smaller id, or same document and
earlier start). Every such string (a window) belongs to one anchor: the leftmost of its 32-byte grams with the least
hash. Equal windows have equal anchors at the same place, so only texts around equal anchors must be compared:

1. Tasks list each document's anchors with the run of windows that belongs to each. Of runs with equal bytes in a
   batch only the earliest goes on; the others repeat it. Anchors that very many documents share are known from a sample:
   around those the batch's own longest previous factors are taken at once, and windows without one go on one by one,
   each with its own hash for an anchor. (The sample decides only where windows meet; results do not depend on it.)
2. Anchors that occur once are dropped (only hashes and places are shuffled for that).
3. Anchors that occur in the same documents form one group (those of two copies, or of a passage). The bytes of the
   runs left are cut from their documents, neighbouring runs of a group as one piece, and meet by group. There a suffix
   order, the longest common prefixes of its neighbours, and the previous and next smaller positions give the longest
   previous factor of every window; windows whose factor has ``length`` bytes are repeats. Should an anchor still have
   very many runs, their windows meet one by one in the same computation.
4. Repeated windows are merged per document and cut out.

Hashes only decide what is compared where; a byte is removed only after a comparison of bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stabilis.llm.common import mixed, utf8_buffer, words_at

#: Bytes of a repeated string, and of the grams from which anchors are chosen.
LENGTH, GRAM = 100, 32
#: Runs around one anchor from which on its windows are dealt one by one.
CROWDED = 20_000
#: Shared anchors: one row in so many is sampled; an anchor counts as shared if it occurs in more sampled rows than so
#: many, and than would fill half a shuffle partition; so many are listed at most. They only balance the work.
ONE_IN, AT_LEAST, LISTED = 16, 16, 1 << 16
#: Windows of a document that are handled at a time; positions must fit in the low bits of an anchor's key.
_CHUNK, _LOW = 1 << 18, 20
#: Bytes of runs that are put in suffix order at a time.
_BLOCK = 1 << 20
#: A place is the first window's start, shifted by so many bits, plus the number of windows.
_SHIFT = 20
_PLACE = 1 << _SHIFT

_POWERS: dict = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        base = 0x9E3779B97F4A7C15
        size = max(n, 1 << 20)
        for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def string_hashes(raw: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the string of ``size`` bytes (8 at least) at each position, and the sums and powers it was made from."""
    up, down = _powers(len(raw))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(words_at(raw)) * up)])
    n = len(raw) - size + 1
    return mixed((total[size - 7 : size - 7 + n] - total[:n]) * down[:n]), total, down


def anchor_runs(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of windows with a common anchor in pieces [start, stop) of a buffer, each piece by itself.

    Returns anchor hash, hash of the run's bytes (with the place of the anchor), first window and number of windows,
    as positions in the buffer.
    """
    n = len(raw) - length + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    h, total, down = string_hashes(raw, gram)
    grams = len(h)
    key = (h >> np.uint64(_LOW)) << np.uint64(_LOW) | np.arange(grams, dtype=np.uint64)
    span, width = length - gram + 1, 1
    while 2 * width <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < span:
        key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
    at = (key & np.uint64((1 << _LOW) - 1)).astype(np.int64)
    # piece of each window; a window that leaves its piece belongs to none
    piece = np.zeros(n + 1, np.int32)
    counts = np.maximum(stops - starts - length + 1, 0)
    for k, (a, c) in enumerate(zip(starts.tolist(), counts.tolist()), 1):
        piece[a : a + c] = k
    piece = piece[:n]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (piece[1:] != piece[:-1])])
    first = np.flatnonzero(new)
    number = np.diff(np.append(first, n))
    valid = piece[first] > 0
    first, number = first[valid], number[valid]
    ends = first + number - 1 + length - 7
    run = mixed((total[ends] - total[first]) * down[first] + number.astype(np.uint64))
    anchor = at[first]
    run = mixed(run + (anchor - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return h[anchor], run, first, number


def _ranks(data: np.ndarray, most: int) -> list[tuple[int, np.ndarray]]:
    """(8, 16, 32, ... up to ``most`` bytes, rank of each position's string of that many bytes)."""
    word = words_at(data)[: max(len(data) - 7, 0)].byteswap()
    out = [(8, np.unique(word, return_inverse=True)[1].astype(np.int64))]
    while 2 * out[-1][0] <= most:
        size, rank = out[-1]
        m = len(rank) - size
        out.append((2 * size, np.unique(rank[:m] * (len(data) + 1) + rank[size:], return_inverse=True)[1].astype(np.int64)))
    return out


def _towards_smaller(value: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Longest common prefix of each suffix with the previous smaller position in suffix order; 0 where there is none.

    ``common[i]`` belongs to the suffixes i - 1 and i. A link to a greater position is replaced by that one's own link
    (all between are greater still) until every link leads to a smaller position.
    """
    link, least = np.arange(-1, len(value) - 1), common.copy()
    open_ = np.flatnonzero((link >= 0) & (value[link] > value))
    while len(open_):
        via = link[open_]
        least[open_], link[open_] = np.minimum(least[open_], least[via]), link[via]
        open_ = open_[(link[open_] >= 0) & (value[link[open_]] > value[open_])]
    return np.where(link >= 0, least, 0)


def previous_factors(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each start (ascending), the longest prefix of its suffix, at most ``length`` bytes, that begins at an
    earlier start too. Every start must have ``length`` bytes, at least 8."""
    if length < 8:
        raise ValueError("length must be at least 8")
    if len(starts) < 2:
        return np.zeros(len(starts), np.int64)
    ranks = _ranks(data, length)
    size, top = ranks[-1]
    # suffix order of the starts by their first ``length`` bytes, ties in corpus order
    order = np.lexsort((top[starts + (length - size)], top[starts]))
    a, b = starts[order[:-1]], starts[order[1:]]
    common = np.zeros(len(a), np.int64)
    for size, rank in reversed(ranks):
        fits = common + size <= length
        x, y = (np.where(fits, p + common, 0) for p in (a, b))
        common += size * (fits & (rank[x] == rank[y]))
    word = words_at(data)
    last = np.minimum(np.stack([a, b]) + common, len(data) - 1)
    differ = (word[last[0]] ^ word[last[1]]).view(np.uint8).reshape(-1, 8) != 0
    tail = np.where(differ.any(1), differ.argmax(1), 8)
    common = np.concatenate([[0], np.minimum(common + tail, length)])
    before = _towards_smaller(order, common)
    after = _towards_smaller(order[::-1], np.concatenate([[0], common[:0:-1]]))[::-1]
    out = np.empty(len(starts), np.int64)
    out[order] = np.maximum(before, after)
    return out


def _sub_runs(pieces: list[bytes], count: np.ndarray, length: int):
    """Pieces (in corpus order) with their numbers of windows, cut where repeated windows begin or end:
    piece, offset of the first window, number of windows, whether they are repeats."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    begin = np.cumsum([0, *map(len, pieces)])[:-1]
    ahead = np.cumsum(count) - count
    piece = np.repeat(np.arange(len(count)), count)
    starts = begin[piece] + np.arange(len(piece)) - ahead[piece]
    found = previous_factors(data, starts, length) >= length
    first = np.flatnonzero(np.concatenate([[True], (found[1:] != found[:-1]) | (piece[1:] != piece[:-1])]))
    return piece[first], first - ahead[piece[first]], np.diff(np.append(first, len(piece))), found[first]


def _listed(raw: np.ndarray, off: np.ndarray, length: int, chunk: int):
    """Runs of all documents of a batch: anchor, hash of the run, document, first window in the buffer, windows."""
    # cut documents into pieces that overlap by length - 1 bytes, then gather pieces up to the chunk size
    pieces = []
    for i in range(len(off) - 1):
        for a in range(off[i], max(off[i + 1] - length + 1, off[i]), chunk):
            pieces.append((i, a, min(a + chunk + length - 1, off[i + 1])))
    parts, k = [(*(np.zeros(0, np.uint64),) * 2, *(np.zeros(0, np.int64),) * 3)], 0
    while k < len(pieces):
        j = k + 1
        while j < len(pieces) and pieces[j][2] - pieces[k][1] < 2 * chunk and pieces[j][1] >= pieces[k][1]:
            j += 1
        group = np.array(pieces[k:j], np.int64)
        base = group[0, 1]
        anchor, run, first, number = anchor_runs(raw[base : group[-1, 2]], group[:, 1] - base, group[:, 2] - base, length)
        parts.append((anchor, run, group[np.searchsorted(group[:, 1] - base, first, "right") - 1, 0], first + base, number))
        k = j
    return tuple(np.concatenate(x) for x in zip(*parts))


def _met(length: int):
    """The distinct anchors of each document, from batches of texts."""

    def run(batches):
        for batch in batches:
            anchor, _, doc, _, _ = _listed(*utf8_buffer(batch.column(0)), length, _CHUNK)
            order = np.lexsort((doc, anchor))
            anchor, doc = anchor[order], doc[order]
            new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])[: len(anchor)]
            yield pa.record_batch([pa.array(anchor[new].view(np.int64))], names=["anchor"])

    return run


def shared_anchors(texts: DataFrame, length: int = LENGTH) -> np.ndarray:
    """Anchors that alone would fill half a shuffle partition, judged by a sample of the rows (column text); at most
    ``LISTED``. Windows between two anchors number about half of those that one gram can serve."""
    sample = texts.select("text").sample(1 / ONE_IN, seed=0)
    size = sample.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    anchors = 2 * size / (length - GRAM + 2)
    least = max(AT_LEAST, anchors / int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")) / 2)
    counts = sample.mapInArrow(_met(length), "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    top = counts.filter(F.col("n") > least).orderBy(F.desc("n"), "anchor").limit(LISTED).collect()
    return np.sort(np.array([r["anchor"] for r in top], np.int64).view(np.uint64))


def _anchors(length: int, shared: np.ndarray):
    """anchor, key, at (a place) and repeat of runs, from batches of (id, key, text)."""

    def joined(doc, first, number):
        """Neighbouring runs of one document as one."""
        order = np.lexsort((first, doc))
        doc, first, number = doc[order], first[order], number[order]
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (first[1:] != first[:-1] + number[:-1])])[: len(doc)])
        return doc[new], first[new], np.add.reduceat(number, new) if len(new) else number

    def run(batches):
        for batch in batches:
            key = batch.column(1).to_numpy(zero_copy_only=False)
            raw, off = utf8_buffer(batch.column(2))
            sort = [("id", "ascending"), ("key", "ascending")]
            place = np.empty(len(batch), np.int64)
            place[pc.sort_indices(pa.table({"id": batch.column(0), "key": batch.column(1)}), sort_keys=sort, null_placement="at_start").to_numpy()] = np.arange(len(batch))
            anchor, hashed, doc, first, number = _listed(raw, off, length, _CHUNK)
            if not len(anchor):
                continue
            order = np.lexsort((first, place[doc], hashed, anchor))
            anchor, hashed, doc, first, number = (x[order] for x in (anchor, hashed, doc, first, number))
            start = first - off[doc]
            new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (hashed[1:] != hashed[:-1])])
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            own = (key[doc] == key[doc[head]]) & (start == start[head])  # the earliest itself, or a repeated row of it
            text = raw.tobytes()
            repeat = np.zeros(len(anchor), bool)
            for k in np.flatnonzero(~own).tolist():
                a, b, n = first[k], first[head[k]], number[k] + length - 1
                repeat[k] = text[a : a + n] == text[b : b + n]
            once = new | ~own
            anchor, doc, first, number, repeat = (x[once] for x in (anchor, doc, first, number, repeat))
            crowd = np.flatnonzero(np.isin(anchor, shared) & ~repeat)
            crowd = crowd[np.lexsort((first[crowd] - off[doc[crowd]], place[doc[crowd]], anchor[crowd]))]
            rest = ~repeat
            rest[crowd] = False
            alone = [(anchor[rest], doc[rest], first[rest], number[rest])]
            again = [(doc[repeat], first[repeat], number[repeat])]
            filled = np.cumsum(number[crowd] + length - 1) // _BLOCK
            for part in np.split(crowd, np.flatnonzero((np.diff(filled) > 0) & (np.diff(anchor[crowd]) > 0)) + 1):
                if len(part):
                    spans = zip(first[part].tolist(), (first[part] + number[part] + length - 1).tolist())
                    pieces = [text[a:b] for a, b in spans]
                    piece, offset, count, found = _sub_runs(pieces, number[part], length)
                    again.append((doc[part[piece[found]]], first[part[piece[found]]] + offset[found], count[found]))
                    piece, offset, count = piece[~found], offset[~found], count[~found]
                    windows = np.repeat(offset - (np.cumsum(count) - count), count) + np.arange(count.sum())
                    row = np.repeat(piece, count)
                    begin = np.cumsum([0, *map(len, pieces)])[:-1]
                    own_hash = string_hashes(np.frombuffer(b"".join(pieces), np.uint8), length)[0][begin[row] + windows]
                    alone.append((own_hash, doc[part[row]], first[part[row]] + windows, np.ones(len(row), np.int64)))
            spans = joined(*(np.concatenate(x) for x in zip(*again)))
            anchor, doc, first, number = (np.concatenate(x) for x in zip(*alone, (spans[0].astype(np.uint64), *spans)))
            at = (first - off[doc]) * _PLACE + number
            repeat = np.arange(len(doc)) >= len(doc) - len(spans[0])
            # repeats need not meet others: they are dealt evenly
            anchor = np.where(repeat, mixed(key[doc].view(np.uint64) + at.astype(np.uint64)), anchor)
            yield pa.record_batch([pa.array(anchor.view(np.int64)), pa.array(key[doc]), pa.array(at), pa.array(repeat)], names=["anchor", "key", "at", "repeat"])

    return run


def _settle(length: int):
    """Longest previous factors in each group. Rows (meet, key, at, data) come sorted by group, then in corpus order;
    rows may repeat. Of a group with very many rows only what is new is kept for the rows to come."""

    def settled(rows):
        key, at, data = (list(x) for x in zip(*rows))
        at = np.array(at)
        piece, offset, number, found = _sub_runs(data, at % _PLACE, length)
        start = (at // _PLACE)[piece] + offset
        out = [pa.array(np.array(key)[piece][found]), pa.array(start[found]), pa.array((start + number - 1 + length)[found])]
        fresh = [
            [key[p], int(a) * _PLACE + int(n), data[p][o : o + n - 1 + length]]
            for p, o, n, a, f in zip(piece.tolist(), offset.tolist(), number.tolist(), start.tolist(), found.tolist()) if not f
        ]
        return pa.record_batch(out, names=["key", "a", "b"]), fresh

    def run(batches):
        rows, filled, most, last, seen = [], 0, 8 * _BLOCK, None, None
        for batch in batches:
            for meet, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if (meet, *row[:2]) == seen:
                    continue
                if meet != last and filled >= _BLOCK:
                    yield settled(rows)[0]
                    rows, filled, most = [], 0, 8 * _BLOCK
                elif filled >= most:
                    out, rows = settled(rows)
                    yield out
                    filled = sum(len(r[2]) for r in rows)
                    most = max(most, 2 * filled)
                last, seen = meet, (meet, *row[:2])
                rows.append(row)
                filled += len(row[2])
        if rows:
            yield settled(rows)[0]

    return run


def _places(at: Column) -> tuple[Column, Column]:
    """First window and number of windows of a packed place."""
    return F.shiftright(at, _SHIFT), at.bitwiseAND(F.lit(_PLACE - 1))


def _pieces(texts: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """meet, id, key, at and the bytes of every chain in question; runs of crowded anchors window by window."""
    start, number = _places(F.col("q.at"))
    cut = (
        texts.join(asked.filter(F.size("asked") > 0), "key")
        .select("id", "key", F.encode("text", "UTF-8").alias("raw"), F.explode("asked").alias("q"))
        .select("id", "key", "q.meet", "q.at", "q.hot", F.substring("raw", (start + 1).cast("int"), (number + (length - 1)).cast("int")).alias("data"))
    )
    start, number = _places(F.col("at"))

    def alone(k: Column) -> Column:
        window = F.substring(F.col("data"), (k + 1).cast("int"), F.lit(length))
        return F.struct(F.xxhash64(window).alias("meet"), ((start + k) * _PLACE + 1).alias("at"), window.alias("data"))

    windows = F.transform(F.sequence(F.lit(0).cast("long"), number - 1), alone)
    whole = F.array(F.struct("meet", "at", "data"))
    return cut.select("id", "key", F.explode(F.when(F.col("hot"), windows).otherwise(whole)).alias("p")).select("p.meet", "id", "key", "p.at", "p.data")


def _judged(runs: DataFrame, crowded: int) -> DataFrame:
    """key, at, meet and hot of the runs that are repeats (meet is null) or whose anchor occurs elsewhere too; one
    shuffle, of hashes and places. Of runs with equal bytes a batch sends one, and of shared anchors' windows too.

    ``meet`` is the group: equal for anchors that occur in the same documents, near each other in the first of them. It
    covers the fewer bytes of a document, the more documents there are.
    """
    same = W.partitionBy("anchor")
    least = F.min(F.struct("key", "at")).over(same)
    known = runs.select(
        "*", F.count_if(~F.col("repeat")).over(same).alias("n"), least.alias("least"), F.max("key").over(same).alias("high"), F.expr("bit_xor(key)").over(same).alias("all")
    )
    part = F.shiftright(F.shiftright("least.at", _SHIFT) * F.least("n", F.lit(crowded)), _SHIFT)
    meet = F.when(~F.col("repeat"), F.xxhash64("n", "least.key", "high", "all", part))
    return known.filter("repeat OR n > 1").select("key", "at", meet.alias("meet"), (F.col("n") > crowded).alias("hot"))


def _chains(judged: DataFrame) -> DataFrame:
    """key and runs (array of at, meet, hot): neighbouring runs of one group as one, repeated rows once."""
    order = W.partitionBy("key").orderBy("at", "meet")
    rows = judged.withColumn("before", F.lag("at").over(order)).filter("before IS NULL OR before <> at")
    start, number = _places(F.col("at"))
    rows = rows.select("key", "meet", "hot", start.alias("start"), number.alias("number"))
    order = W.partitionBy("key").orderBy("start", "number", "meet")
    ahead = lambda c: F.lag(c).over(order)
    half = _SHIFT - 1
    joins = (ahead(F.col("start") + F.col("number")) == F.col("start")) & (ahead("meet") == F.col("meet")) & ~F.col("hot") & (F.shiftright(ahead("start"), half) == F.shiftright("start", half))
    chain = F.sum(F.when(joins, 0).otherwise(1)).over(order)
    joined = rows.withColumn("chain", chain).groupBy("key", "chain", "meet", "hot").agg(F.min("start").alias("start"), F.sum("number").alias("number"))
    return joined.groupBy("key").agg(F.collect_list(F.struct((F.col("start") * _PLACE + F.col("number")).alias("at"), "meet", "hot")).alias("runs"))


def _merged(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        a, b = max(a, 0), min(b, size)
        if a >= b:
            continue
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, crowded: int = CROWDED, seed: int = 0
) -> DataFrame:
    """Per row: id, removed (array of byte ranges), kept (the remaining bytes) and n_bytes.

    Ids may have any type that can be ordered. Null texts are empty and lose nothing. A null id counts as smaller than
    all others. An id with several texts has so many documents, in the order of a hash; so has the null id. Rows that
    repeat an id and text are one document, and repeat its result. An empty table gives an empty result.

    Documents travel under a 64-bit hash of id and text. Should two of them share it, the job raises an error; another
    ``seed`` parts them.
    """
    if length <= GRAM:
        raise ValueError(f"length must be more than {GRAM}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    rows = rows.select("id", F.xxhash64(F.lit(seed), "id", "text").alias("key"), "text")
    # one row per document, dealt by key once: both joins below read this shuffle
    check = F.hash(F.lit(seed), "id", "text")
    texts = rows.groupBy("key").agg(F.first("id").alias("id"), F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"), F.min(check).alias("low"), F.max(check).alias("high"))
    # (all its columns take part here, so that both joins need the same ones and the shuffle is shared)
    texts = texts.filter(F.when(F.col("low") != F.col("high"), F.raise_error(F.lit("two documents share a key: choose another seed"))).otherwise(F.col("copies") > 0))
    runs = rows.mapInArrow(_anchors(length, shared_anchors(rows, length)), "anchor long, key long, at long, repeat boolean")
    chains = _chains(_judged(runs, crowded))
    asked = chains.select("key", F.filter("runs", lambda r: r["meet"].isNotNull()).alias("asked"))

    def span(r: Column) -> Column:
        start, number = _places(r["at"])
        return F.struct(start.alias("a"), (start + number - 1 + length).alias("b"))

    gone = chains.select("key", F.transform(F.filter("runs", lambda r: r["meet"].isNull()), span).alias("gone"))
    pieces = _pieces(texts, asked, length).repartition("meet").sortWithinPartitions("meet", "id", "key", "at").select("meet", "key", "at", "data")
    found = pieces.mapInArrow(_settle(length), "key long, a long, b long").groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("found"))
    joined = texts.join(gone, "key", "left").join(found, "key", "left")
    none = F.array().cast("array<struct<a: long, b: long>>")
    joined = joined.select("id", "text", "copies", F.concat(F.coalesce("gone", none), F.coalesce("found", none)).alias("spans"))

    @F.pandas_udf("removed array<struct<a: long, b: long>>, kept binary, n_bytes long")
    def cut(texts, spans):
        import pandas as pd

        out = []
        for text, found in zip(texts, spans):
            raw = text.encode("utf-8", "surrogatepass")
            gone = _merged([(s["a"], s["b"]) for s in found], len(raw))
            stops = [0, *[b for _, b in gone]]
            starts = [*[a for a, _ in gone], len(raw)]
            out.append(([{"a": a, "b": b} for a, b in gone], b"".join(raw[x:y] for x, y in zip(stops, starts)), len(raw)))
        return pd.DataFrame(out, columns=["removed", "kept", "n_bytes"])

    done = joined.select("id", "copies", cut("text", "spans").alias("r"))
    each = done.select("id", "r", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return each.select(F.col("id").alias(id_col), "r.removed", "r.kept", "r.n_bytes")


def removal_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans and kept_sha256, from ``without_repeats``."""
    return without_repeats(docs, id_col, text_col, length).select(
        id_col,
        "n_bytes",
        F.aggregate("removed", F.lit(0).cast("long"), lambda acc, s: acc + s["b"] - s["a"]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
