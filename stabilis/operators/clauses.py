"""Clauses of parsed sentences: loose and strict splitting, and the joining of fragments.

A clause is the part of a dependency tree below a split root; the rest of the sentence is the main clause. The only
thing that Python sees is one sentence's tokens.
"""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Tags, relations, words and least sizes of the rules.
CONTENT = {"NOUN", "PROPN", "VERB", "ADJ", "ADV", "NUM"}
NOMINAL = {"NOUN", "PROPN", "PRON"}
SUBJECTS = {"nsubj", "nsubj:pass"}
COPULAS = {"cop", "aux:pass"}
SPLITS = {"conj", "advcl", "acl:relcl"}
WEAK_STARTS = {"and", "or", "but", "that", "which", "because", "to", "by", "with"}
COORDINATORS = {"and", "or", "but"}
RELATIVES = {"who", "which", "that"}
DISCOURSE = {"for example", "however"}
LOOSE, STRICT = (4, 2), (5, 3)
#: Tags that a split root may have.
LOOSE_ROOTS, STRICT_ROOTS = {"VERB"}, {"VERB", "ADJ", "NOUN"}


class Token(NamedTuple):
    text: str
    upos: str
    relation: str
    head: int | None
    xpos: str | None = None


class Part:
    """Some tokens of a sentence, and the facts about them that rules ask for."""

    def __init__(self, sentence: dict[int, Token], ids):
        self.ids = sorted(ids)
        self.tokens = [sentence[i] for i in self.ids]
        self.words = [t for t in self.tokens if t.upos != "PUNCT"]
        self.relations = {t.relation for t in self.tokens}

    @property
    def text(self) -> str:
        return " ".join(t.text for t in self.words).replace(" ,", ",").replace(" .", ".")

    @property
    def opening(self) -> str | None:
        return self.words[0].text.lower() if self.words else None

    @property
    def has_subject(self) -> bool:
        return bool(self.relations & SUBJECTS)

    @property
    def is_discourse(self) -> bool:
        return self.text.lower() in DISCOURSE

    @property
    def joins_previous(self) -> bool:
        """A fragment that continues the clause before it."""
        return self.opening is None or self.opening in WEAK_STARTS

    def reaches(self, words: int, content: int) -> bool:
        return len(self.words) >= words and sum(t.upos in CONTENT for t in self.tokens) >= content

    def splits_loosely(self, root: Token) -> bool:
        return root.upos == "VERB" and (self.has_subject or root.relation == "conj") and self.reaches(*LOOSE)

    def splits_strictly(self, root: Token) -> bool:
        predicate = root.upos == "VERB" or (root.upos in ("ADJ", "NOUN") and self.relations & COPULAS)
        anchored = any(t.upos in NOMINAL for t in self.tokens)
        if not (predicate and anchored and (self.has_subject or root.relation == "conj") and self.reaches(*STRICT)) or self.is_discourse:
            return False
        if self.joins_previous and not (self.opening in COORDINATORS and self.has_subject):
            return False
        if root.relation == "advcl":
            return not (root.xpos == "VB" and any(t.text.lower() == "to" and t.relation == "mark" for t in self.tokens))
        if root.relation == "acl:relcl":
            return self.has_subject and any(t.upos in CONTENT and t.text.lower() not in RELATIVES for t in self.tokens)
        return True


def _subtree(children: dict[int, list[int]], root: int) -> set[int]:
    """A token and all below it; a token is visited once, so a cycle ends."""
    out, stack = set(), [root]
    while stack:
        at = stack.pop()
        if at not in out:
            out.add(at)
            stack.extend(children.get(at, ()))
    return out


def split_sentence(tokens: dict[int, tuple], strict: bool, merge: bool = True) -> list[list[int]]:
    """Clauses as sorted token ids, by first token. tokens: id -> (text, upos, relation, head[, xpos]).

    Loose: a verb below one of ``SPLITS`` whose subtree has a subject (or which is a conjunct), four words and two
    content words splits off with its subtree; nested splits keep their tokens in both. Strict: see
    ``Part.splits_strictly``; nested splits stay with the outer one, bare discourse markers are dropped, and with
    ``merge`` a clause that opens with one of ``WEAK_STARTS`` is joined to the one before it. What is left of the
    sentence is the main clause, even if it is punctuation only.
    """
    return _split({i: Token(*t) for i, t in sorted(tokens.items())}, strict, merge)


def _split(sentence: dict[int, Token], strict: bool, merge: bool = True) -> list[list[int]]:
    """``split_sentence`` of tokens in order of their ids."""
    roots, fits = (STRICT_ROOTS, Part.splits_strictly) if strict else (LOOSE_ROOTS, Part.splits_loosely)
    wanted = [i for i, t in sentence.items() if t.relation in SPLITS and t.upos in roots]
    below = {}
    if wanted:
        children: dict[int, list[int]] = {}
        for i, t in sentence.items():
            if t.head is not None:
                children.setdefault(t.head, []).append(i)
        below = {i: _subtree(children, i) for i in wanted}
        below = {i: ids for i, ids in below.items() if fits(Part(sentence, ids), sentence[i])}
    if strict:
        below = {i: ids for i, ids in below.items() if not any(i in other for j, other in below.items() if j != i)}
    main = set(sentence).difference(*below.values())
    clauses = sorted(([sorted(ids) for ids in [main, *below.values()] if ids]), key=lambda c: c[0])
    if not strict:
        return clauses
    clauses = [c for c in clauses if not Part(sentence, c).is_discourse]
    joined: list[list[int]] = []
    for c in clauses:
        if merge and joined and Part(sentence, c).joins_previous:
            joined[-1] = sorted(joined[-1] + c)
        else:
            joined.append(c)
    return joined


def split_clauses(tokens: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """key, sentence_id, clause (from 0), n_tokens, text (words without punctuation), token_ids.

    A column ``xpos`` is used where there is one (infinitives); without it no clause counts as an infinitive.
    """
    found = lambda sentence, clause: (len(clause), Part(sentence, clause).text, clause)
    return _split_rows(tokens, key, strict, found, [("n_tokens", "int", pa.int32()), ("text", "string", pa.string()), ("token_ids", "array<int>", pa.list_(pa.int32()))])


def _split_rows(tokens: DataFrame, key: str, strict: bool, found, fields: list[tuple]) -> DataFrame:
    """key, sentence_id, clause and what ``found`` makes of a sentence and each of its clauses."""

    def run(batches):
        for batch in batches:
            held = batch.column(2)
            ends, nodes = held.offsets.to_pylist(), held.values
            first, last = ends[0], ends[-1]
            columns = [nodes.field(n).slice(first, last - first).to_pylist() for n in range(6)]
            ids, words = columns[0], list(map(Token, *columns[1:]))
            at, numbers, made = [], [], [[] for _ in fields]
            for row, (a, b) in enumerate(zip(ends, ends[1:])):
                sentence = dict(zip(ids[a - first : b - first], words[a - first : b - first]))
                for k, clause in enumerate(_split(sentence, strict)):
                    at.append(row)
                    numbers.append(k)
                    for column, x in zip(made, found(sentence, clause)):
                        column.append(x)
            at = pa.array(at, pa.int32())
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(numbers, pa.int32()), *[pa.array(x, t) for x, (*_, t) in zip(made, fields)]]
            yield pa.record_batch(columns, names=[key, "sentence_id", "clause", *[f[0] for f in fields]])

    kind = tokens.schema[key].dataType.simpleString()
    xpos = F.col("xpos") if "xpos" in tokens.columns else F.lit(None).cast("string").alias("xpos")
    number = lambda c: F.col(c).cast("int").alias(c)
    node = F.struct(number("token_id"), "text", "upos", "dependency_relation", number("head_token_id"), xpos)
    sentences = tokens.select(key, number("sentence_id"), node.alias("node")).groupBy(key, "sentence_id").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    return sentences.mapInArrow(run, f"{key} {kind}, sentence_id int, clause int, " + ", ".join(f"{name} {of}" for name, of, _ in fields))


def clause_units(tokens: DataFrame, key: str) -> DataFrame:
    """key, sentence_id, clause (from 0), text and patterns (array: head tag, relation, tag) of loose clauses: ``split_clauses``
    and ``structure.patterns`` of their tokens, made where the sentence is, so that no token is looked for again."""

    def patterns(sentence: dict[int, Token], ids: list[int]) -> list[str]:
        inside = {i: sentence[i] for i in ids if sentence[i].upos is not None and sentence[i].upos != "PUNCT"}
        return ["|".join(x for x in (inside[t.head].upos, t.relation, t.upos) if x is not None) for t in inside.values() if t.head in inside]

    def found(sentence, clause):
        return Part(sentence, clause).text, patterns(sentence, clause)

    return _split_rows(tokens, key, False, found, [("text", "string", pa.string()), ("patterns", "array<string>", pa.list_(pa.string()))])


def clause_tokens(tokens: DataFrame, clauses: DataFrame, key: str) -> DataFrame:
    """Tokens with the place of their clause (``pos``, from 0 over the whole text); a token of nested clauses repeats."""
    order = W.partitionBy(key).orderBy("sentence_id", "clause")
    placed = clauses.withColumn("pos", F.row_number().over(order) - 1).select(key, "sentence_id", "pos", F.explode("token_ids").alias("token_id"))
    return tokens.join(placed, [key, "sentence_id", "token_id"])
