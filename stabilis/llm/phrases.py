"""Removal of repeated word windows by sharded automata of recurring passages.

A word goes if a window of ``length`` words that covers it also starts earlier (smaller id, or same document and earlier
start). Every window belongs to one anchor: the leftmost of its five-word grams with the least hash. Equal windows have
equal anchors at the same place, so an anchor that occurs once belongs to no repeated window.

1. Tasks list each document's anchors with the run of windows that belongs to each. Of runs with equal words in a batch
   only the earliest goes on; the others repeat it. Windows around anchors that very many documents share (known from a
   sample) are compared within the batch, and those left go on one by one, with their own hash for an anchor.
2. Anchors that occur once are dropped, and anchors that occur in the same documents form one group (hashes and places).
3. All documents are read again; the words around the anchors that are left go to the shard of their group.
4. In a shard, windows that occur twice are confirmed word by word and joined to passages: neighbouring windows that always
   occur together. The passages are compiled into an Aho-Corasick automaton over words, and everything in the shard is
   streamed through it to locate every occurrence; all but the first of a passage are repeats.
5. Repeated windows are merged per document and cut out.

Hashes only decide what is compared where. A shard's automaton takes a bounded number of words.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stabilis.llm.common import mixed, utf8_buffer, words_of
from stabilis.llm.lpf import _PLACE, CROWDED, LISTED, ONE_IN, AT_LEAST, _chains, _judged, _merged, _places, _powers

#: Words of a repeated window, and of the grams from which anchors are chosen.
LENGTH, GRAM = 20, 5
#: Bytes of text that are split into words at a time (one document at least); windows that are handled at a time.
_BYTES, _CHUNK, _LOW = 1 << 20, 1 << 18, 20
#: Words from which on a shard's automaton is compiled.
_SHARD = 1 << 17

_SAME = np.arange(256, dtype=np.uint8)
_WORD = np.ones(256, bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Texts:
    """The words of a batch of texts, split a few documents at a time."""

    def __init__(self, column: pa.Array):
        self.raw, self.off = utf8_buffer(column)
        self.slices, i = [], 0
        while i < len(self.off) - 1:
            j = max(i + 1, int(np.searchsorted(self.off, self.off[i] + _BYTES, "right")) - 1)
            joined, begin, size, doc = words_of(self.raw[self.off[i] : self.off[j]], self.off[i : j + 1], _WORD, _SAME)
            ahead = np.searchsorted(doc, np.arange(j - i + 1))
            self.slices.append((i, j, joined, begin.astype(np.int32), size.astype(np.int32), ahead))
            i = j
        self.edges = np.array([s[0] for s in self.slices], np.int64)

    def __len__(self) -> int:
        return len(self.off) - 1

    def words(self, doc: int) -> int:
        i, _, _, _, _, ahead = self.slices[np.searchsorted(self.edges, doc, "right") - 1]
        return int(ahead[doc - i + 1] - ahead[doc - i])

    def piece(self, doc: int, first: int, number: int) -> bytes:
        """``number`` words of a document from ``first`` on, one space between."""
        i, _, joined, begin, size, ahead = self.slices[np.searchsorted(self.edges, doc, "right") - 1]
        a = ahead[doc - i] + first
        b = a + number - 1
        return joined[begin[a] : begin[b] + size[b]].tobytes()

    def without(self, doc: int, spans: list[tuple[int, int]]) -> bytes:
        """A document's words outside of spans of words, one space between."""
        i, _, joined, begin, size, ahead = self.slices[np.searchsorted(self.edges, doc, "right") - 1]
        a, b = ahead[doc - i], ahead[doc - i + 1]
        if a == b:
            return b""
        keep = np.ones(b - a, bool)
        for x, y in spans:
            keep[x:y] = False
        return joined[begin[a] : begin[b - 1] + size[b - 1] + 1][np.repeat(keep, size[a:b] + 1)][:-1].tobytes()


def anchor_runs(hashes: np.ndarray, doc: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of windows with a common anchor, from the hashes and documents of words: anchor hash, hash of the run's words
    (with the place of the anchor), first window and number of windows."""
    n = len(hashes) - length + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    up, down = _powers(len(hashes) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)])])
    grams = len(hashes) - gram + 1
    h = mixed((total[gram:] - total[:grams]) * down[:grams])
    key = (h >> np.uint64(_LOW)) << np.uint64(_LOW) | np.arange(grams, dtype=np.uint64)
    span, width = length - gram + 1, 1
    while 2 * width <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < span:
        key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
    at = (key & np.uint64((1 << _LOW) - 1)).astype(np.int64)
    valid = doc[:n] == doc[length - 1 :]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (valid[1:] != valid[:-1]) | (doc[1:n] != doc[: n - 1])])
    first = np.flatnonzero(new)
    number = np.diff(np.append(first, n))
    first, number = first[valid[first]], number[valid[first]]
    run = mixed((total[first + number - 1 + length] - total[first]) * down[first] + number.astype(np.uint64))
    anchor = at[first]
    run = mixed(run + (anchor - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return h[anchor], run, first, number


def _listed(texts: Texts, length: int):
    """Runs of all documents of a batch: anchor, hash of the run, document, first window (word of the document), windows."""
    parts = [(*(np.zeros(0, np.uint64),) * 2, *(np.zeros(0, np.int64),) * 3)]
    for i, j, joined, begin, size, ahead in texts.slices:
        up, down = _powers(len(joined) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[joined] * up[: len(joined)])])
        hashes = mixed((total[begin + size] - total[begin]) * down[begin])
        doc = np.repeat(np.arange(j - i), np.diff(ahead))
        for a in range(0, len(hashes), _CHUNK):
            part = slice(a, a + _CHUNK + length - 1)
            anchor, run, first, number = anchor_runs(hashes[part], doc[part], length)
            own = doc[a + first]
            parts.append((anchor, run, i + own, a + first - ahead[own], number))
    return tuple(np.concatenate(x) for x in zip(*parts))


def shared_anchors(texts: DataFrame, length: int = LENGTH) -> np.ndarray:
    """Anchors that alone would fill half a shuffle partition, judged by a sample of the rows (column text); at most
    ``LISTED``. They only balance the work: results do not depend on them."""

    def met(batches):
        for batch in batches:
            anchor, _, doc, _, _ = _listed(Texts(batch.column(0)), length)
            order = np.lexsort((doc, anchor))
            anchor, doc = anchor[order], doc[order]
            new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])[: len(anchor)]
            yield pa.record_batch([pa.array(anchor[new].view(np.int64))], names=["anchor"])

    counts = texts.select("text").sample(1 / ONE_IN, seed=0).mapInArrow(met, "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.filter(F.col("n") > AT_LEAST)
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    top = counts.orderBy(F.desc("n"), "anchor").limit(LISTED).collect()
    # runs of a sample: about one for every eight words
    rows = texts.select("text").sample(1 / ONE_IN, seed=0).agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    least = rows / 50 / parts / 2
    return np.sort(np.array([r["anchor"] for r in top if r["n"] > least], np.int64).view(np.uint64))


def _classes(codes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A number for each start, equal where the ``length`` codes from there on are equal."""
    rank, size = codes, 1
    while 2 * size <= length:
        m = len(rank) - size
        rank = np.unique(rank[:m] * np.int64(len(codes) + 1) + rank[size:], return_inverse=True)[1].astype(np.int64)
        size *= 2
    return np.unique(rank[starts] * np.int64(len(codes) + 1) + rank[starts + length - size], return_inverse=True)[1]


def passages(windows: np.ndarray, piece: np.ndarray) -> list[tuple[int, int]]:
    """First window and number of windows of each recurring passage, at its first occurrence: neighbouring windows that
    recur, and always occur together. ``windows`` are the classes of all windows in order, ``piece`` tells where each is."""
    count = np.bincount(windows)
    first = np.zeros(len(windows), bool)
    first[np.unique(windows, return_index=True)[1]] = True
    base = first & (count[windows] > 1)
    ahead = np.flatnonzero(piece[1:] == piece[:-1])
    pair, place, often = np.unique(windows[ahead] * np.int64(len(count)) + windows[ahead + 1], return_inverse=True, return_counts=True)
    linked = np.zeros(len(windows), bool)  # to the window before
    linked[ahead + 1] = (often[place] == count[windows[ahead]]) & (often[place] == count[windows[ahead + 1]])
    linked &= base & np.concatenate([[False], base[:-1]])
    begin = np.flatnonzero(base & ~linked)
    ends = np.flatnonzero(base & ~np.append(linked[1:], False))
    return list(zip(begin.tolist(), (ends - begin + 1).tolist()))


def _text(codes: np.ndarray) -> str:
    """One character for each code; the surrogates are left out."""
    return np.where(codes >= 0xD800, codes + 0x800, codes).astype("<u4").tobytes().decode("utf-32-le")


def repeated(pieces: list[list[bytes]], length: int) -> np.ndarray:
    """For all windows of the pieces (in corpus order), whether their words also start earlier."""
    known: dict[bytes, int] = {}
    sizes = np.array([len(p) for p in pieces], np.int64)
    codes = np.array([known.setdefault(w, len(known) + 1) for p in pieces for w in [*p, None]], np.int64)
    known.pop(None, None)
    begin = np.cumsum(sizes + 1) - sizes - 1
    codes[begin + sizes] = 0  # between pieces
    count = sizes - length + 1
    piece = np.repeat(np.arange(len(pieces)), count)
    ahead = np.cumsum(count) - count
    starts = begin[piece] + np.arange(len(piece)) - ahead[piece]
    found = np.zeros(len(starts), bool)
    recurring = passages(_classes(codes, starts, length), piece) if len(starts) > 1 else []
    if not recurring:
        return found
    text, automaton = _text(codes), ahocorasick.Automaton()
    for w, number in recurring:
        a = int(starts[w])
        automaton.add_word(text[a : a + number - 1 + length], (a, number))
    automaton.make_automaton()
    window = np.full(len(codes), -1, np.int64)
    window[starts] = np.arange(len(starts))
    for end, (a, number) in automaton.iter(text):
        at = end - (number - 1 + length) + 1
        if at != a:
            found[window[at] : window[at] + number] = True
    return found


def _parts(found: np.ndarray, count: np.ndarray):
    """Pieces' windows, cut where repeated ones begin or end: piece, offset, number of windows, whether they are repeats."""
    piece, ahead = np.repeat(np.arange(len(count)), count), np.cumsum(count) - count
    first = np.flatnonzero(np.concatenate([[True], (found[1:] != found[:-1]) | (piece[1:] != piece[:-1])])[: len(piece)])
    return piece[first], first - ahead[piece[first]], np.diff(np.append(first, len(piece))), found[first]


def _anchors(length: int, shared: np.ndarray):
    """anchor, key, at (a place) and repeat of runs, from batches of (id, key, text)."""
    import xxhash

    def run(batches):
        for batch in batches:
            key = batch.column(1).to_numpy(zero_copy_only=False)
            texts = Texts(batch.column(2))
            sort = [("id", "ascending"), ("key", "ascending")]
            place = np.empty(len(batch), np.int64)
            place[pc.sort_indices(pa.table({"id": batch.column(0), "key": batch.column(1)}), sort_keys=sort, null_placement="at_start").to_numpy()] = np.arange(len(batch))
            anchor, hashed, doc, first, number = _listed(texts, length)
            if not len(anchor):
                continue
            order = np.lexsort((first, place[doc], hashed, anchor))
            anchor, hashed, doc, first, number = (x[order] for x in (anchor, hashed, doc, first, number))
            new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (hashed[1:] != hashed[:-1])])
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            own = (key[doc] == key[doc[head]]) & (first == first[head])  # the earliest itself, or a repeated row of it
            repeat = np.zeros(len(anchor), bool)
            for k in np.flatnonzero(~own).tolist():
                n, h = number[k] + length - 1, head[k]
                repeat[k] = number[k] == number[h] and texts.piece(doc[k], first[k], n) == texts.piece(doc[h], first[h], n)
            once = new | ~own
            anchor, doc, first, number, repeat = (x[once] for x in (anchor, doc, first, number, repeat))
            crowd = np.flatnonzero(np.isin(anchor, shared) & ~repeat)
            crowd = crowd[np.lexsort((first[crowd], place[doc[crowd]], anchor[crowd]))]
            rest = ~repeat
            rest[crowd] = False
            alone = [(anchor[rest], doc[rest], first[rest], number[rest])]
            again = [(doc[repeat], first[repeat], number[repeat])]
            filled = np.cumsum(number[crowd] + length - 1) // _SHARD
            for some in np.split(crowd, np.flatnonzero((np.diff(filled) > 0) & (np.diff(anchor[crowd]) > 0)) + 1):
                if not len(some):
                    continue
                pieces = [texts.piece(d, f, n + length - 1).split() for d, f, n in zip(doc[some], first[some], number[some])]
                p, offset, count, found = _parts(repeated(pieces, length), number[some])
                again.append((doc[some[p[found]]], first[some[p[found]]] + offset[found], count[found]))
                p, offset, count = p[~found], offset[~found], count[~found]
                windows = np.repeat(offset - (np.cumsum(count) - count), count) + np.arange(count.sum())
                p = np.repeat(p, count)
                own_hash = [xxhash.xxh64_intdigest(b" ".join(pieces[a][w : w + length])) for a, w in zip(p.tolist(), windows.tolist())]
                alone.append((np.array(own_hash, np.uint64), doc[some[p]], first[some[p]] + windows, np.ones(len(p), np.int64)))
            spans = tuple(np.concatenate(x) for x in zip(*again))
            anchor, doc, first, number = (np.concatenate(x) for x in zip(*alone, (spans[0].astype(np.uint64), *spans)))
            at = first * _PLACE + number
            repeat = np.arange(len(doc)) >= len(doc) - len(spans[0])
            # repeats need not meet others: they are dealt evenly
            anchor = np.where(repeat, mixed(key[doc].view(np.uint64) + at.astype(np.uint64)), anchor)
            yield pa.record_batch([pa.array(anchor.view(np.int64)), pa.array(key[doc]), pa.array(at), pa.array(repeat)], names=["anchor", "key", "at", "repeat"])

    return run


def _cut(length: int):
    """meet, id, key, at and words of every run in question, from batches of (id, key, text, asked); runs of crowded
    anchors window by window."""
    import xxhash

    def run(batches):
        for batch in batches:
            texts = Texts(batch.column(2))
            meet, row, at, data = [], [], [], []
            for doc, asked in enumerate(batch.column(3).to_pylist()):
                for q in asked:
                    first, number = divmod(q["at"], _PLACE)
                    for a, n in [(first + k, 1) for k in range(number)] if q["hot"] else [(first, number)]:
                        piece = texts.piece(doc, a, n + length - 1)
                        meet.append(xxhash.xxh64_intdigest(piece) - (1 << 63) if q["hot"] else q["meet"])
                        row.append(doc)
                        at.append(a * _PLACE + n)
                        data.append(piece)
            take = pa.array(row, pa.int64())
            out = [pa.array(meet, pa.int64()), batch.column(0).take(take), batch.column(1).take(take), pa.array(at, pa.int64()), pa.array(data, pa.binary())]
            yield pa.record_batch(out, names=["meet", "id", "key", "at", "data"])

    return run


def _settle(length: int):
    """key and the span of words of each repeat. Rows (meet, key, at, data) come sorted by group, then in corpus order; rows
    may repeat. Of a group with very many rows only what is new is kept for the rows to come."""

    def settled(rows):
        key, at, pieces = (list(x) for x in zip(*rows))
        at = np.array(at)
        piece, offset, number, found = _parts(repeated(pieces, length), at % _PLACE)
        start = (at // _PLACE)[piece] + offset
        out = [pa.array(np.array(key)[piece][found]), pa.array(start[found]), pa.array((start + number - 1 + length)[found])]
        fresh = [
            [key[p], int(a) * _PLACE + int(n), pieces[p][o : o + n - 1 + length]]
            for p, o, n, a, f in zip(piece.tolist(), offset.tolist(), number.tolist(), start.tolist(), found.tolist()) if not f
        ]
        return pa.record_batch(out, names=["key", "a", "b"]), fresh

    def run(batches):
        rows, filled, most, last, seen = [], 0, 8 * _SHARD, None, None
        for batch in batches:
            for meet, key, at, data in zip(*[c.to_pylist() for c in batch.columns]):
                if (meet, key, at) == seen:
                    continue
                if meet != last and filled >= _SHARD:
                    yield settled(rows)[0]
                    rows, filled, most = [], 0, 8 * _SHARD
                elif filled >= most:
                    out, rows = settled(rows)
                    yield out
                    filled = sum(len(r[2]) for r in rows)
                    most = max(most, 2 * filled)
                last, seen = meet, (meet, key, at)
                rows.append([key, at, data.split()])
                filled += len(rows[-1][2])
        if rows:
            yield settled(rows)[0]

    return run


def without_phrases(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, crowded: int = CROWDED, seed: int = 0
) -> DataFrame:
    """Per row: id, n_words, removed (array of ranges of words) and kept (the remaining words, one space between, UTF-8).

    Ids may have any type that can be ordered. Null texts are empty and lose nothing. A null id counts as smaller than all
    others. An id with several texts has so many documents, in the order of a hash; so has the null id. Rows that repeat an
    id and text are one document, and repeat its result. Other columns are ignored. An empty table gives an empty result.

    Documents travel under a 64-bit hash of id and text. Should two of them share it, the job raises an error; another
    ``seed`` parts them.
    """
    if length <= GRAM:
        raise ValueError(f"length must be more than {GRAM}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    rows = rows.select("id", F.xxhash64(F.lit(seed), "id", "text").alias("key"), "text")
    # one row per document, dealt by key once: both joins below read this shuffle, so both use all its columns
    check = F.hash(F.lit(seed), "id", "text")
    texts = rows.groupBy("key").agg(F.first("id").alias("id"), F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"), F.min(check).alias("low"), F.max(check).alias("high"))
    texts = texts.filter(F.when(F.col("low") != F.col("high"), F.raise_error(F.lit("two documents share a key: choose another seed"))).otherwise(F.col("copies") > 0))
    runs = rows.mapInArrow(_anchors(length, shared_anchors(rows, length)), "anchor long, key long, at long, repeat boolean")
    chains = _chains(_judged(runs, crowded))
    asked = chains.select("key", F.filter("runs", lambda r: r["meet"].isNotNull()).alias("asked")).filter(F.size("asked") > 0)

    def span(r):
        start, number = _places(r["at"])
        return F.struct(start.alias("a"), (start + number - 1 + length).alias("b"))

    gone = chains.select("key", F.transform(F.filter("runs", lambda r: r["meet"].isNull()), span).alias("gone"))
    kind = rows.schema["id"].dataType.simpleString()
    pieces = texts.join(asked, "key").select("id", "key", "text", "asked").mapInArrow(_cut(length), f"meet long, id {kind}, key long, at long, data binary")
    pieces = pieces.repartition("meet").sortWithinPartitions("meet", "id", "key", "at").select("meet", "key", "at", "data")
    found = pieces.mapInArrow(_settle(length), "key long, a long, b long").groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("found"))
    none = F.array().cast("array<struct<a: long, b: long>>")
    joined = texts.join(gone, "key", "left").join(found, "key", "left")
    joined = joined.select("id", "text", "copies", F.concat(F.coalesce("gone", none), F.coalesce("found", none)).alias("spans"))

    def kept(batches):
        for batch in batches:
            words = Texts(batch.column(1))
            spans = [_merged([(s["a"], s["b"]) for s in found], words.words(k)) for k, found in enumerate(batch.column(3).to_pylist())]
            out = [
                batch.column(0),
                batch.column(2),
                pa.array([words.words(k) for k in range(len(words))], pa.int64()),
                pa.array([[{"a": a, "b": b} for a, b in s] for s in spans], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                pa.array([words.without(k, s) for k, s in enumerate(spans)], pa.binary()),
            ]
            yield pa.record_batch(out, names=["id", "copies", "n_words", "removed", "kept"])

    done = joined.mapInArrow(kept, f"id {kind}, copies long, n_words long, removed array<struct<a: long, b: long>>, kept binary")
    each = done.select("*", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return each.select(F.col("id").alias(id_col), "n_words", "removed", "kept")


def removal_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row: id, n_words, n_removed and kept_sha256, from ``without_phrases``."""
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, s: acc + s["b"] - s["a"])
    return without_phrases(docs, id_col, text_col, length).select(id_col, "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
