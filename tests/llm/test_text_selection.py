"""Resampling, ranked search and phrase removal against plain Python, with nulls, empty and long texts, ties, repeats."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stabilis.llm import phrases, resampling, tput
from stabilis.llm.common import ranked

PHRASE = " ".join(f"w{k}" for k in range(25))
LONG = " ".join(f"Term{k % 977} of the {k % 13}" for k in range(30_000))
CLASH = ["id", "row", "key", "rank", "score", "weight", "n_words", "terms", "term", "q", "bucket", "spans", "copies", "meet", "fits"]
TEXTS = [
    (1, "The quick brown fox, the lazy dog; " * 6),
    (2, "the QUICK brown fox " * 8),
    (3, None),
    (4, ""),
    (5, LONG),
    (6, LONG + " the end"),
    (7, f"one {PHRASE} two"),
    (8, f"three\t{PHRASE}\n\nfour"),
    (9, " ".join(PHRASE.split()[:19])),
    (10, "again " * 90),
    (11, "naïve café 日本語 😀   x ÀÉ " * 7),
    (12, f"{PHRASE} fox {PHRASE}"),
    (12, f"{PHRASE} fox {PHRASE}"),
    (13, " .,; \x0b \x0c"),
    (None, f"five {PHRASE} fox " + "dog " * 30),
    (14, "x" * 300_000 + " " + PHRASE),
    (12, "quick fox " * 20),
]
ITEMS = [(1, "Brown fox! quick FOX"), (2, None), (3, ""), (4, PHRASE), (4, PHRASE), (5, "日本語 café nowhere"), (None, "the"), (6, "unheard-of")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)
    return df.select("*", *[F.lit(7).alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string").select("*", F.lit(1).alias("q"), F.lit(1).alias("item"))


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


# resampling


def plain_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)], len(w)


def plain_resample(texts, target, percent=5):
    known = [(i, *plain_features(t)) for i, t in texts]
    s, t = Counter(x for _, f, _ in known for x in f), Counter(x for _, text in target for x in plain_features(text)[0])
    S, T = sum(s.values()) + 10_000.0, sum(t.values()) + 10_000.0
    out = []
    for i, f, n in known:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * S / ((s[b] + 1) * T))) for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    fit = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(fit[: percent * len(fit) // 100], 1)}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=repr)


@pytest.mark.parametrize("percent", [5, 50, 100])
def test_resample(docs, items, percent):
    got = rows(resampling.resample(docs, items, percent=percent), "doc_id", "n_features", "weight", "score", "rank")
    assert got == plain_resample(TEXTS, ITEMS, percent)


def test_resample_empty_tables(docs, items):
    assert resampling.resample(docs.limit(0), items).count() == 0
    got = rows(resampling.resample(docs, items.limit(0)), "doc_id", "n_features", "weight", "score", "rank")
    assert got == plain_resample(TEXTS, [])


def test_drawn_documents_keep_their_columns(docs, items):
    drawn = {r["doc_id"] for r in resampling.resample(docs, items, percent=50).filter("rank IS NOT NULL").collect()}
    got = resampling.drawn_documents(docs, items, percent=50)
    assert got.columns == docs.columns
    assert rows(got, "doc_id", "text") == sorted([t for t in TEXTS if t[0] in drawn], key=repr)


def test_run_hashes_across_chunks(monkeypatch):
    monkeypatch.setattr(resampling, "_CHUNK", 7)
    monkeypatch.setattr(resampling, "_BYTES", 40)
    texts = ["a bb ccc dddd eeeee " * 5, "", "one two", "ß" * 100, "z9 " * 30]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *[len(t.encode()) for t in texts]])
    got = {k: Counter() for k in range(len(texts))}
    for doc, value, *kind in resampling.features(raw, off):
        if not kind:
            for d, v in zip(doc.tolist(), value.tolist()):
                got[d][v] += 1
    assert [got[k] for k in range(len(texts))] == [Counter(plain_features(t)[0]) for t in texts]


def test_ranked_is_one_total_order(spark):
    df = spark.range(0, 5_000, 1, 11).select(F.pmod(F.hash("id"), F.lit(40)).alias("v"), "id")
    got = [r["rank"] for r in ranked(df, F.desc("v"), F.asc("id")).orderBy(F.desc("v"), F.asc("id")).collect()]
    assert got == list(range(1, 5_001))
    assert ranked(df.limit(0), F.asc("id")).count() == 0


# ranked search


def plain_search(texts, items, top=10):
    words = lambda t: [lower(w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    known = [(i, Counter(words(t))) for i, t in texts]
    known = [(i, c) for i, c in known if c]
    n, total, df = len(known), sum(sum(c.values()) for _, c in known), Counter(w for _, c in known for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in known:
            m = 10 + 90 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in set(words(text)) if c[w])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, k, s[3], -s[0]) for k, s in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("how", [{}, {"top": 2, "head": 1, "segment": 1, "shard_size": 1}, {"query_bytes": 1}])
def test_search(docs, items, how):
    got = rows(tput.search(docs, items, **how), "item_id", "rank", "doc_id", "score")
    assert got == plain_search(TEXTS, ITEMS, how.get("top", 10))


def test_search_thresholds_lose_nothing(spark, monkeypatch):
    """Many documents and few looked up, so that the bounds decide."""
    monkeypatch.setattr(tput, "LOOKED_UP", 1)
    rng = np.random.default_rng(5)
    texts = [(k, " ".join(f"t{int(x)}" for x in rng.zipf(1.4, 30) % 90)) for k in range(600)]
    asked = [(k, " ".join(f"t{int(x)}" for x in rng.integers(0, 90, 9))) for k in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = rows(tput.search(docs, spark.createDataFrame(asked, "item_id long, text string"), top=3, head=3), "item_id", "rank", "doc_id", "score")
    assert got == plain_search(texts, asked, 3)


def test_search_empty_tables(docs, items):
    assert tput.search(docs.limit(0), items).count() == 0
    assert tput.search(docs, items.limit(0)).count() == 0


# phrases


def plain_phrases(texts, length=20):
    """Documents in the order of id (null first), texts of one id as the operator orders them: by the given order."""
    seen, out, done = set(), [], {}
    for i, t in texts:
        if (i, t) not in done:
            w = (t or "").encode().split()
            keep = [True] * len(w)
            for k in range(len(w) - length + 1):
                window = tuple(w[k : k + length])
                if window in seen:
                    keep[k : k + length] = [False] * length
                seen.add(window)
            done[i, t] = (i, len(w), len(w) - sum(keep), hashlib.sha256(b" ".join(x for x, y in zip(w, keep) if y)).hexdigest())
        out.append(done[i, t])
    return sorted(out, key=repr)


@pytest.mark.parametrize("crowded", [phrases.CROWDED, 1])
def test_phrases(docs, crowded):
    one_text = [t for t in TEXTS if t != (12, "quick fox " * 20)]
    got = phrases.without_phrases(docs.filter("text IS NULL OR text NOT LIKE 'quick fox quick%'"), crowded=crowded)
    got = sorted(((r["doc_id"], r["n_words"], r["n_words"] - len(bytes(r["kept"]).split()), hashlib.sha256(r["kept"]).hexdigest()) for r in got.collect()), key=repr)
    assert got == plain_phrases(sorted(one_text, key=lambda t: (t[0] is not None, t[0] or 0)))


def test_phrases_of_an_id_with_several_texts(spark):
    df = spark.createDataFrame([(1, PHRASE), (1, PHRASE + " x"), (1, PHRASE)], "doc_id long, text string")
    got = rows(phrases.removal_digest(df), "n_words", "n_removed")
    # one of the two texts is the earlier one; the repeated row has the result of its text
    assert got in ([(25, 0), (25, 0), (26, 25)], [(25, 25), (25, 25), (26, 0)])


def test_phrases_empty_table(docs):
    assert phrases.removal_digest(docs.limit(0)).count() == 0


@pytest.mark.parametrize("shared", [True, False])
def test_phrases_random(spark, monkeypatch, shared):
    """Few words, so that windows recur in many contexts; with every anchor shared, windows are dealt one by one."""
    rng = np.random.default_rng(3)
    stock = [" ".join(rng.choice(list("abcdef"), 40)) for _ in range(6)]
    texts = []
    for k in range(120):
        a, b, c = rng.integers(0, 6), rng.integers(0, 20), rng.integers(0, 41)
        texts.append((k, " ".join(["s", *stock[a].split()[b:c], *rng.choice(list("ab"), rng.integers(0, 30)), *["r"] * int(rng.integers(0, 30))])))
    if shared:
        everything = lambda texts, length: np.sort(phrases._listed(phrases.Texts(texts.select("text").toArrow().column(0)), length)[0])
        monkeypatch.setattr(phrases, "shared_anchors", everything)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = rows(phrases.removal_digest(df), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == plain_phrases(texts)


def test_repeated_in_a_long_group(monkeypatch):
    """A group beyond a shard's words is settled part by part."""
    import pyarrow as pa

    monkeypatch.setattr(phrases, "_SHARD", 64)
    data = [" ".join(f"v{(k * 7 + j) % 50}" for j in range(30)).encode() for k in range(60)]
    batch = pa.record_batch([pa.array([1] * 60, pa.int64()), pa.array(range(60), pa.int64()), pa.array([11] * 60, pa.int64()), pa.array(data, pa.binary())], names=["meet", "key", "at", "data"])
    gone = {k: set() for k in range(60)}
    for out in phrases._settle(20)([batch]):
        for key, a, b in zip(*[c.to_pylist() for c in out.columns]):
            gone[key].update(range(a, b))
    seen = set()
    for k, d in enumerate(data):
        w, want = d.split(), set()
        for j in range(11):
            window = tuple(w[j : j + 20])
            if window in seen:
                want.update(range(j, j + 20))
            seen.add(window)
        assert gone[k] == want


def test_passages_are_joined():
    pieces = [PHRASE.encode().split(), b"x y z".split() + PHRASE.encode().split(), PHRASE.encode().split()[2:]]
    got = phrases.repeated(pieces, 20)
    assert got.tolist() == [False] * 6 + [False] * 3 + [True] * 6 + [True] * 4
