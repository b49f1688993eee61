"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

A sequence of tokens is the BPE encoding of its bytes exactly when each token encodes to itself and each adjacent
pair does (merging the two tokens' bytes gives the pair back). So the encoding of every prefix of a piece ends in
one certain token, and a left-to-right machine can follow the live hypotheses: a set of (trie node of an open token,
last closed token, tokens not yet emitted). Such sets are the states of the transducer. They and their transitions
are made when first met; what all hypotheses agree on is emitted, which happens after at most the longest token's
length, as open tokens that long have no continuation.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries of a worker's older and newer encoded pieces, half for each; half as many states. Only speed depends on it.
CACHE_LIMIT = 300_000
#: Characters of texts whose results leave a task together.
_OUT = 1 << 21


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from the text of a rank file: lines of base64 token and decimal rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def merge(ranks: dict[bytes, int], parts: list[bytes], keep: int = 1) -> list[bytes]:
    """Merge adjacent parts, lowest rank first and leftmost among equals, until no pair has a rank or ``keep`` are left."""
    while len(parts) > keep:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    """Encodes pieces of bytes to rank ids; states are built on demand and forgotten beyond ``limit``."""

    def __init__(self, ranks: dict[bytes, int], limit: int = CACHE_LIMIT):
        self.ranks = ranks
        self.limit = limit
        self.bytes_of = {i: token for token, i in ranks.items()}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, i in ranks.items():
            node = 0
            for b in token:
                nxt = self.children[node].get(b)
                if nxt is None:
                    nxt = len(self.children)
                    self.children[node][b] = nxt
                    self.children.append({})
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = i
        self.made: dict[bytes, list[bytes] | None] = {}
        self.sides: dict[int, tuple[bool, list, list]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        start = ((0, -1, ()),)
        self.ids = {start: 0}
        self.states = [start]
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def _side(self, token: int) -> tuple[bool, list, list]:
        """Whether the token encodes to itself; the parts that stand at its right and at its left edge while it is
        being merged, each with the rank of the merge that ends it (infinity for the token itself)."""
        known = self.sides.get(token)
        if known is None:
            parts = self._parts(self.bytes_of[token])
            known = self.sides[token] = (parts is not None, self._edge(token, -1), self._edge(token, 0)) if parts is not None else (False, [], [])
        return known

    def _parts(self, text: bytes) -> list[bytes] | None:
        """The two parts whose merge makes the token, none for a byte, None if its bytes do not merge to it."""
        parts = self.made.get(text)
        if parts is None and text not in self.made:
            parts = merge(self.ranks, [bytes([b]) for b in text], keep=2) if len(text) > 1 else []
            self.made[text] = parts = parts if len(parts) < 3 else None
        return parts

    def _edge(self, token: int, side: int) -> list[tuple[bytes, float]]:
        text, ends, edge = self.bytes_of[token], float("inf"), []
        while True:
            edge.append((text, ends))
            if len(text) == 1:
                return edge
            if self.ranks[text] > ends:
                raise ValueError("a token ranks below one of its parts: these ranks do not come from merges in order")
            ends = self.ranks[text]
            text = self._parts(text)[side]

    def _fits(self, last: int, token: int) -> bool:
        """Whether the token can close after the last one: no merge joins parts of both before their own merges end
        those parts (of equal ranks the leftmost pair merges first)."""
        if last < 0:
            return self._side(token)[0]
        ok = self.pairs.get((last, token))
        if ok is None:
            if len(self.pairs) > 2 * self.limit:
                self.pairs.clear()
            ok = self.pairs[last, token] = self._apart(last, token)
        return ok

    def _apart(self, last: int, token: int) -> bool:
        sound, _, lefts = self._side(token)
        if not sound:
            return False
        get = self.ranks.get
        for a, a_ends in self._side(last)[1]:
            for b, b_ends in lefts:
                rank = get(a + b)
                if rank is not None and rank < a_ends and rank <= b_ends:
                    return False
        return True

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Make the transition that is not there yet."""
        live, closed, shortest = [], None, 1 << 30
        children, token_at = self.children, self.token_at
        for node, last, pending in self.states[state]:
            nxt = children[node].get(byte)
            if nxt is None:
                continue
            if children[nxt]:
                live.append((nxt, last, pending))
                if len(pending) < shortest:
                    shortest = len(pending)
            if closed is None:
                token = token_at[nxt]
                if token >= 0 and self._fits(last, token):
                    closed = (0, token, (*pending, token))
        if closed is None:
            raise ValueError("no token ends at this byte: the ranks are not closed under their merges")
        path = closed[2]
        agreed, emitted = 0, ()
        for x in path if live else ():
            if agreed == shortest or any([hypothesis[2][agreed] != x for hypothesis in live]):
                break
            agreed += 1
        if not live:
            key, emitted = ((0, path[-1], ()),), path
        elif agreed:
            key = (*[(node, last, pending[agreed:]) for node, last, pending in live], (0, path[-1], path[agreed:]))
            emitted = path[:agreed]
        else:
            live.append(closed)
            key = tuple(live)
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        self.moves[state][byte] = (to, emitted)
        return to, emitted

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece; a piece that is itself in the vocabulary is its own token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if 2 * len(self.states) > self.limit:
            self._reset()
        moves, state, out = self.moves, 0, []
        for byte in piece:
            step = moves[state].get(byte)
            state, emitted = step if step is not None else self._move(state, byte)
            if emitted:
                out.extend(emitted)
        out.extend(self.states[state][-1][2])
        return tuple(out)


class Utf8Stream:
    """Incremental UTF-8 decoding: the state is the unfinished character (at most three bytes)."""

    def __init__(self):
        self.rest = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """Length of the incomplete character at the end: a lead byte that announces more bytes than follow it."""
        for back in range(1, min(4, len(data) + 1)):
            b = data[-back]
            if b & 0xC0 != 0x80:
                needs = 4 if b >= 0xF0 else 3 if b >= 0xE0 else 2 if b >= 0xC0 else 1
                return back if needs > back else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.rest + data
        hold = self.unfinished(data)
        self.rest = data[len(data) - hold :]
        return data[: len(data) - hold].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.rest = self.rest, b""
        return rest.decode("utf-8", "replace")


class _Pieces(dict):
    """What a piece of text becomes: its ids in decimal, the bytes of its ids, and the ids as 32-bit integers.

    Pieces are encoded when first asked for. Beyond half the limit they become the older ones, of which those asked
    for again come back and the others are forgotten the next time: frequent pieces outlive the many that occur once.
    """

    def __init__(self, machine: Transducer, limit: int | None = None):
        super().__init__()
        self.machine = machine
        self.limit = (CACHE_LIMIT if limit is None else limit) // 2
        self.older: dict[str, tuple[bytes, bytes, bytes]] = {}

    def __missing__(self, piece: str) -> tuple[bytes, bytes, bytes]:
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()
        made = self.older.get(piece)
        if made is None:
            ids = self.machine.encode(piece.encode("utf-8", "surrogatepass"))
            table = self.machine.bytes_of
            made = b" ".join([b"%d" % i for i in ids]), b"".join([table[i] for i in ids]), struct.pack(f"<{len(ids)}i", *ids)
        self[piece] = made
        return made


#: Texts of so many characters are split into runs of so many pieces, which bounds memory; results are the same.
_LONG, _RUN = 1 << 20, 50_000


class Splitter:
    """Matches of a pattern with \\p{L}, \\p{N} and \\s, one after another.

    Texts of the basic plane go through the standard library's engine with those classes written out as ranges
    (taken from the ``regex`` module, character by character), which is several times faster; others go to ``regex``.
    """

    def __init__(self, pattern: str):
        import regex

        self.general = regex.compile(pattern)
        plane = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x10000))))
        ranges = {}
        for name in (r"\p{L}", r"\p{N}", r"\s"):
            found = [m.group() for m in regex.finditer(f"{name}+", plane)]
            ranges[name] = "".join(f"\\u{ord(x[0]):04x}-\\u{ord(x[-1]):04x}" for x in found)
        parts, inside = [], False
        for token in regex.findall(r"\\p\{\w\}|\\.|.", pattern, regex.DOTALL):
            if token == r"\S":
                parts.append(f"[^{ranges[r'\s']}]")
            elif token in ranges:
                parts.append(ranges[token] if inside else f"[{ranges[token]}]")
            else:
                inside = token == "[" or inside and token != "]"
                parts.append(token)
        self.plane = re.compile("".join(parts))
        self.beyond = re.compile("[\U00010000-\U0010ffff\ud800-\udfff]")

    def runs(self, text: str):
        """The pieces of a text as lists: one list for an ordinary text, runs of ``_RUN`` for a very long one."""
        engine = self.general if self.beyond.search(text) else self.plane
        if len(text) < _LONG:
            yield engine.findall(text)
            return
        found = engine.finditer(text)
        while part := [m.group() for _, m in zip(range(_RUN), found)]:
            yield part


_WORKER: dict = {}


def _machine(ranks_data: bytes, pattern: str):
    """The worker's own machine for a vocabulary; reused by its later tasks."""
    key = (hashlib.sha256(ranks_data).digest(), pattern)
    if _WORKER.get("key") != key:
        machine = Transducer(parse_ranks(ranks_data))
        gc.freeze()  # the trie and the states live as long as the worker; collections need not visit them
        gc.set_threshold(100_000, 50, 100)
        _WORKER.update(key=key, pieces=_Pieces(machine), split=Splitter(pattern), table=machine.bytes_of)
    return _WORKER["pieces"], _WORKER["split"], _WORKER["table"]


def vocabulary(spark: SparkSession, path: str):
    """Broadcast the rank file (a fixed vocabulary of about a megabyte, whatever the corpus)."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _columns(df: DataFrame, drop: set[str]) -> list[str]:
    return [c for c in df.columns if c not in drop]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """The input's columns with an array of ids added; a column already named ``ids_col`` is replaced.

    Null text gives null; empty text gives an empty array. Each text is encoded whole, batch by batch in the tasks;
    there is no shuffle.
    """
    data = vocabulary(docs.sparkSession, ranks_path)

    @F.pandas_udf("array<int>")
    def ids(texts):
        pieces, split, _ = _machine(data.value, pattern)
        return texts.map(lambda t: None if t is None else np.frombuffer(b"".join([pieces[p][2] for run in split.runs(t) for p in run]), "<i4"))

    return docs.select(*_columns(docs, {ids_col}), ids(F.col(text_col)).alias(ids_col))


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """The input's columns with the decoded text added; null ids give null; unknown ids raise KeyError."""
    data = vocabulary(df.sparkSession, ranks_path)

    @F.pandas_udf("string")
    def text(ids):
        table = _machine(data.value, "")[2]

        def one(row):
            stream = Utf8Stream()
            return "".join(stream.feed(b"".join(table[i] for i in row[k : k + _RUN])) for k in range(0, len(row), _RUN)) + stream.close()

        return ids.map(lambda row: None if row is None else one([int(i) for i in row]))

    return df.select(*_columns(df, {text_col}), text(F.col(ids_col)).alias(text_col))


def digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 and decoded_sha256 of the whole text, ``lossless`` and, if asked for, the ids.

    Encoding and decoding run in the same pass in runs of pieces, so that memory does not grow with a text's number
    of tokens. Null and empty texts have no tokens. Rows are independent: repeated rows repeat their result.
    """
    data = vocabulary(docs.sparkSession, ranks_path)

    def result(ids, out):
        n, ids_sha, text_sha, same, kept = zip(*out)
        return pa.record_batch(
            [ids, pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(same, pa.bool_())]
            + ([pa.array(kept, pa.list_(pa.int32()))] if keep_ids else []),
            names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "lossless"] + (["ids"] if keep_ids else []),
        )

    def run(batches):
        pieces, split, _ = _machine(data.value, pattern)
        for batch in batches:
            out, size, first_row = [], 0, 0
            for row, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                n, ids_hash, text_hash, stream, same, first, all_ids = 0, hashlib.sha256(), hashlib.sha256(), Utf8Stream(), True, True, []
                at = 0
                for part in split.runs(text):
                    if not part:
                        continue
                    decimals, decoded, packed = zip(*map(pieces.__getitem__, part))
                    ids = b" ".join(decimals)
                    n += ids.count(b" ") + 1
                    if keep_ids:
                        all_ids.append(np.frombuffer(b"".join(packed), "<i4"))
                    ids_hash.update(ids if first else b" " + ids)
                    raw = b"".join(decoded)
                    text_hash.update(raw)
                    got = stream.feed(raw)
                    same = same and text.startswith(got, at)
                    at, first = at + len(got), False
                same = same and stream.close() == "" and at == len(text)
                out.append((n, ids_hash.hexdigest(), text_hash.hexdigest(), same, np.concatenate(all_ids) if all_ids else np.zeros(0, np.int32)))
                size += len(text)
                # results of few texts are held together, not of a whole batch
                if size >= _OUT:
                    yield result(batch.column(0).slice(first_row, len(out)), out)
                    out, size, first_row = [], 0, row + 1
            if out:
                yield result(batch.column(0).slice(first_row, len(out)), out)

    kind = docs.schema[id_col].dataType.simpleString()
    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean" + (", ids array<int>" if keep_ids else ""))
        .withColumnRenamed("id", id_col)
    )
