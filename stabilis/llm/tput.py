"""Ranked lexical search by three phases with a uniform threshold over term-partitioned postings.

Queries are taken in blocks (a bounded number of bytes); only what a block holds is known to the driver and to tasks.

* Documents are read once: the block's terms in each, with frequencies, are kept as the forward index. Lists are dealt by
  term; a long list is cut into segments by document, so that no term, however frequent, fills a task. Within a segment
  entries come by falling score.
* Phase 1: the heads of all lists give partial sums; the documents with the best ones are looked up exactly. The k-th best
  score found is a lower bound for every query.
* Phase 2: each list gives all entries that reach (lower bound / number of lists) for some query that has the term. They
  meet by blocks of documents, where partial sums, and upper bounds from what lists may still hold, leave the candidates.
* Phase 3: candidates are looked up in the forward index; exact scores that reach the lower bound are ranked.

A document that no list gave in phase 2 has less than the lower bound, so nothing is lost.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stabilis.llm.common import checkpointed, mixed

#: Documents listed for a query.
TOP = 10
#: Entries of a list's head, and documents of a query that are looked up in phase 1.
HEAD, LOOKED_UP = 50, 100
#: Entries in a segment of a list; entries of a block of documents.
SEGMENT, BLOCK = 4_096, 1 << 18
#: Bytes of query texts that are handled at a time (one text at least).
QUERY_BYTES = 1 << 20
#: Bytes of a text that are split at a time; documents that are looked up at a time.
_PIECE, _DOCS = 1 << 20, 1 << 10

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None):
    """Lists of a text's terms in order, as UTF-8: runs of ASCII letters and digits and of anything beyond ASCII; A-Z in
    lower case."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
    a = 0
    while a < len(data):
        b = data.find(b" ", a + _PIECE)
        b = len(data) if b < 0 else b
        yield data[a:b].split()
        a = b


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and the number of values of each row."""
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """row, id, n (terms of the text with repeats), terms and tfs (of the vocabulary) of every document with terms."""

    def run(batches):
        for batch in batches:
            number, size, terms, tfs = [], [], [], []
            for text in batch.column(2):
                n, counts = 0, Counter()
                for part in terms_of(text.as_py()):
                    n += len(part)
                    counts.update(map(vocabulary.get, part))
                counts.pop(None, None)
                number.append(n)
                size.append(len(counts))
                terms.extend(counts.keys())
                tfs.extend(counts.values())
            out = [batch.column(0), batch.column(1), pa.array(number, pa.int64()), _lists(np.array(terms, np.int32), size, pa.int32()), _lists(np.array(tfs, np.int64), size, pa.int64())]
            yield pa.record_batch(out, names=["row", "id", "n", "terms", "tfs"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"row long, id {kind}, n long, terms array<int>, tfs array<long>").filter("n > 0")


class Block:
    """What tasks need to know of a block of queries: its terms' weights, who asks for them, and the corpus's size."""

    def __init__(self, queries: list[set[bytes]], vocabulary: dict[bytes, int], found: dict[int, int], docs: int, total: int):
        self.docs, self.total = docs, total
        self.weight = np.zeros(len(vocabulary), np.int64)
        self.found = np.zeros(len(vocabulary), np.int64)
        for term, n in found.items():
            self.found[term] = n
            self.weight[term] = math.floor(1000 * math.log((2 * docs + 2) / (2 * n + 1)))
        # terms without weight or documents add nothing to any score
        self.asked = [np.array(sorted(t for t in map(vocabulary.get, q) if self.weight[t] > 0), np.int64) for q in queries]
        pairs = sorted((t, q) for q, terms in enumerate(self.asked) for t in terms.tolist())
        self.asking = np.array([q for _, q in pairs], np.int64)
        self.times = np.bincount([t for t, _ in pairs], minlength=len(vocabulary)).astype(np.int64)
        self.first = np.cumsum(self.times) - self.times

    def shares(self, n: np.ndarray, size: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """The part of each entry's score that does not depend on the term; n by document, size its number of entries."""
        m = np.array([10 + 90 * x * self.docs // self.total for x in n.tolist()], np.int64)
        return 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, size))


def postings(forward: DataFrame, block: Block, shards: int, segment: int) -> DataFrame:
    """Segments of lists: term, part, rows and shares, by falling share."""
    parts = np.maximum(1, -(-block.found // segment))

    def listed(batches):
        for batch in batches:
            row, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            (term, size), (tf, _) = _flat(batch.column(3)), _flat(batch.column(4))
            share, rows = block.shares(n, size, tf), np.repeat(row, size)
            part = shard_of(rows, shards) * parts[term] // shards
            keep = np.flatnonzero(block.weight[term] > 0)
            keep = keep[np.lexsort((part[keep], term[keep]))]
            term, part, rows, share = term[keep], part[keep], rows[keep], share[keep]
            new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (part[1:] != part[:-1])])[: len(term)])
            sizes = np.diff(np.append(new, len(term)))
            out = [pa.array(term[new].astype(np.int32)), pa.array(part[new]), _lists(rows, sizes, pa.int64()), _lists(share, sizes, pa.int32())]
            yield pa.record_batch(out, names=["term", "part", "rows", "shares"])

    def ordered(batches):
        for batch in batches:
            (rows, size), (share, _) = _flat(batch.column(2)), _flat(batch.column(3))
            order = np.lexsort((rows, -share, np.repeat(np.arange(len(size)), size)))
            yield pa.record_batch([batch.column(0), batch.column(1), _lists(rows[order], size, pa.int64()), _lists(share[order], size, pa.int32())], names=batch.schema.names)

    kind = "term int, part long, rows array<long>, shares array<int>"
    pieces = forward.mapInArrow(listed, kind).groupBy("term", "part").agg(F.collect_list(F.struct("rows", "shares")).alias("p"))
    return pieces.select("term", "part", F.flatten("p.rows").alias("rows"), F.flatten("p.shares").alias("shares")).mapInArrow(ordered, kind)


def shard_of(rows: np.ndarray, shards: int) -> np.ndarray:
    """The block of documents that a document belongs to."""
    return ((mixed(rows.astype(np.uint64)) >> np.uint64(33)).astype(np.int64) * shards) >> 31


def heads(lists: DataFrame, size: int) -> pa.Table:
    """term, row and share of the first ``size`` entries of every list; at most so many for each term of the block."""
    first = lists.select("term", F.explode(F.arrays_zip(F.slice("rows", 1, size).alias("row"), F.slice("shares", 1, size).alias("share"))).alias("e")).select("term", "e.*")
    best = W.partitionBy("term").orderBy(F.desc("share"), "row")
    return first.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= size).drop("k").toArrow()


def _promising(block: Block, head: pa.Table, most: int) -> tuple[dict[int, list[int]], np.ndarray]:
    """Queries by document to look up in phase 1, and the largest score that each term can add."""
    term, row, share = (head.column(k).to_numpy() for k in range(3))
    score = block.weight[term] * share
    largest = np.zeros(len(block.weight), np.int64)
    np.maximum.at(largest, term, score)
    order = np.argsort(term, kind="stable")
    begin = np.searchsorted(term[order], np.arange(len(block.weight) + 1))
    asked: dict[int, list[int]] = {}
    for q, terms in enumerate(block.asked):
        own = np.concatenate([np.zeros(0, np.int64), *[order[begin[t] : begin[t + 1]] for t in terms]]).astype(np.int64)
        docs, place = np.unique(row[own], return_inverse=True)
        sums = np.bincount(place, score[own], minlength=len(docs))
        for d in docs[np.lexsort((docs, -sums))[:most]].tolist():
            asked.setdefault(d, []).append(q)
    return asked, largest


def look_up(forward: DataFrame, asked: DataFrame, block: Block, least: np.ndarray) -> DataFrame:
    """q, id, row and score of the pairs asked for (row, queries) whose exact score is positive and reaches ``least``."""
    joined = forward.join(asked, "row").select("row", "id", "n", "terms", "tfs", "queries")

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), _DOCS):
                some = batch.slice(a, _DOCS)
                n = some.column(2).to_numpy(zero_copy_only=False)
                (term, size), (tf, _), (query, wanted) = _flat(some.column(3)), _flat(some.column(4)), _flat(some.column(5))
                score, doc = block.weight[term] * block.shares(n, size, tf), np.repeat(np.arange(len(n)), size)
                times = block.times[term]
                offset = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                asking = block.asking[np.repeat(block.first[term], times) + offset]
                width = len(block.asked)
                # (sums stay below 2**53: doubles hold them exactly)
                total = np.bincount(np.repeat(doc, times) * width + asking, np.repeat(score, times), minlength=len(n) * width)
                d = np.repeat(np.arange(len(n)), wanted)
                exact = total[d * width + query].astype(np.int64)
                keep = (exact > 0) & (exact >= least[query])
                take = pa.array(d[keep])
                yield pa.record_batch([pa.array(query[keep].astype(np.int32)), some.column(1).take(take), some.column(0).take(take), pa.array(exact[keep])], names=["q", "id", "row", "score"])

    return joined.mapInArrow(run, f"q int, id {joined.schema['id'].dataType.simpleString()}, row long, score long")


def candidates(lists: DataFrame, block: Block, bound: np.ndarray, largest: np.ndarray, shards: int, top: int) -> DataFrame:
    """row and queries (array) of the documents that may still be among the best of a query."""
    lists_of = np.array([max(1, len(t)) for t in block.asked], np.int64)
    threshold = np.maximum(1, -(-bound // lists_of))
    least = np.full(len(block.weight), np.iinfo(np.int64).max)
    for q, terms in enumerate(block.asked):
        least[terms] = np.minimum(least[terms], threshold[q])

    def cut(batches):
        for batch in batches:
            term = batch.column(0).to_numpy(zero_copy_only=False)
            (rows, size), (share, _) = _flat(batch.column(2)), _flat(batch.column(3))
            terms = np.repeat(term, size)
            keep = np.flatnonzero(block.weight[terms] * share >= least[terms])
            shard = shard_of(rows[keep], shards)
            order = np.lexsort((terms[keep], shard))
            keep, shard = keep[order], shard[order]
            terms, rows, share = terms[keep], rows[keep], share[keep]
            new = np.flatnonzero(np.concatenate([[True], (terms[1:] != terms[:-1]) | (shard[1:] != shard[:-1])])[: len(terms)])
            sizes = np.diff(np.append(new, len(terms)))
            yield pa.record_batch([pa.array(shard[new]), pa.array(terms[new]), _lists(rows, sizes, pa.int64()), _lists(share, sizes, pa.int32())], names=["shard", "term", "rows", "shares"])

    def summed(pieces):
        term = np.concatenate([p[0] for p in pieces])
        rows = np.concatenate([p[1] for p in pieces])
        score = block.weight[term] * np.concatenate([p[2] for p in pieces])
        docs, place = np.unique(rows, return_inverse=True)
        order = np.argsort(term, kind="stable")
        term, place, score = term[order], place[order], score[order]
        begin = np.searchsorted(term, np.arange(len(block.weight) + 1))
        found_doc, found_query = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for q, terms in enumerate(block.asked):
            spans = [slice(begin[t], begin[t + 1]) for t in terms.tolist() if begin[t] < begin[t + 1]]
            if not spans:
                continue
            value, doc = np.concatenate([score[s] for s in spans]), np.concatenate([place[s] for s in spans])
            # what a list may still hold of a document that it has not given
            left = np.minimum(largest[terms], threshold[q] - 1)
            unseen = np.repeat(np.minimum(largest[[term[s.start] for s in spans]], threshold[q] - 1), [s.stop - s.start for s in spans])
            given = value >= threshold[q]
            part = np.bincount(doc[given], value[given], minlength=len(docs))
            most = part + left.sum() - np.bincount(doc[given], unseen[given], minlength=len(docs))
            reach = max(bound[q], np.partition(part, -top)[-top]) if len(docs) >= top else bound[q]
            hit = np.flatnonzero((part > 0) & (most >= reach))
            found_doc.append(hit)
            found_query.append(np.full(len(hit), q))
        doc, query = np.concatenate(found_doc), np.concatenate(found_query)
        order = np.lexsort((query, doc))
        size = np.bincount(doc, minlength=len(docs))
        some = size > 0
        return pa.record_batch([pa.array(docs[some]), _lists(query[order], size[some], pa.int32())], names=["row", "queries"])

    def meet(batches):
        last, pieces = None, []
        for batch in batches:
            shard, term = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            (rows, size), (share, _) = _flat(batch.column(2)), _flat(batch.column(3))
            ends = np.cumsum(size)
            edges = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if shard[a] != last and pieces:
                    yield summed(pieces)
                    pieces = []
                last = shard[a]
                span = slice(ends[a] - size[a], ends[b - 1])
                pieces.append((np.repeat(term[a:b], size[a:b]), rows[span], share[span]))
        if pieces:
            yield summed(pieces)

    given = lists.mapInArrow(cut, "shard long, term int, rows array<long>, shares array<int>")
    return given.repartition("shard").sortWithinPartitions("shard").mapInArrow(meet, "row long, queries array<int>")


def _search(docs: DataFrame, texts: list[str | None], id_col: str, text_col: str, top: int, head: int, segment: int, shard_size: int) -> DataFrame:
    """q, id, score and rank for one block of queries."""
    spark = docs.sparkSession
    queries = [{w for part in terms_of(t) for w in part} for t in texts]
    vocabulary = {t: k for k, t in enumerate(sorted(set().union(*queries)))}
    forward = checkpointed(forward_index(docs, vocabulary, id_col, text_col))
    size = forward.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    found = {r["term"]: r["n"] for r in forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    block = Block(queries, vocabulary, found, size["docs"], size["total"])
    shards = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(block.found.sum()) // shard_size))
    lists = checkpointed(postings(forward, block, shards, segment))
    # phase 1
    asked, largest = _promising(block, heads(lists, max(head, top)), max(LOOKED_UP, top))
    bound = np.zeros(len(queries), np.int64)
    first = F.broadcast(spark.createDataFrame(sorted(asked.items()), "row long, queries array<int>"))  # LOOKED_UP for each query at most
    best = W.partitionBy("q").orderBy(F.desc("score"))
    for r in look_up(forward, first, block, bound).withColumn("k", F.row_number().over(best)).filter(F.col("k") <= top).filter(F.col("k") == top).collect():
        bound[r["q"]] = r["score"]
    # phases 2 and 3
    exact = look_up(forward, candidates(lists, block, bound, largest, shards, top), block, bound)
    best = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return exact.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("q", "rank", "id", "score")


def search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    top: int = TOP, head: int = HEAD, segment: int = SEGMENT, shard_size: int = BLOCK, query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """item, rank, id and score of the ``top`` best documents of each item, by falling score, then by smaller id.

    Null texts have no terms; a document or item without terms matches nothing. A null document id comes last among equal
    scores. Rows that repeat an id are documents of their own, and items that repeat an id are queries of their own: all
    are listed. Other columns are ignored. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    out, texts, names, filled = [], [], [], 0
    kind = items.schema[item_col].dataType.simpleString()

    def settled():
        known = spark.createDataFrame(list(enumerate(names)), f"q int, item {kind}")
        found = _search(docs, texts, id_col, text_col, top, head, segment, shard_size)
        return found.join(F.broadcast(known), "q").select(F.col("item").alias(item_col), F.col("rank"), F.col("id").alias(id_col), "score")

    for r in items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).toLocalIterator():
        if texts and filled + len(r["text"] or "") > query_bytes:
            out.append(settled())
            texts, names, filled = [], [], 0
        texts.append(r["text"])
        names.append(r["item"])
        filled += len(r["text"] or "")
    if texts or not out:
        out.append(settled())
    whole = out[0]
    for df in out[1:]:
        whole = whole.unionByName(df)
    return whole
