"""Providers of native values, token vectors and contextual similarity against plain Python."""

import itertools
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from stabilis.operators import contextual
from stabilis.sources import providers
from stabilis.sources.tables import RESPONSES


def test_packing():
    sizes = [5000, 300, 300, 200, 10, 10, 10, 1, 0]
    parts = list(providers.packed(sizes, 3, 1000))
    assert parts == [(0, 1), (1, 4), (4, 7), (7, 9)]
    assert [k for a, b in parts for k in range(a, b)] == list(range(9))
    assert all((b - a) * sizes[a] <= 1000 or b - a == 1 for a, b in parts)
    assert list(providers.packed([], 3, 10)) == []


class Counting:
    """A provider that notes its calls in a folder, one file each, and when it is closed."""

    def __init__(self, folder, fail=None, most=None):
        self.folder, self.fail, self.most, self.calls = folder, fail, most, 0

    def __call__(self, texts):
        if self.most and len(texts) > self.most:
            raise RuntimeError("CUDA out of memory")
        if self.fail:
            raise ValueError(self.fail)
        self.calls += 1
        with open(f"{self.folder}/{os.getpid()}-{id(self)}-{self.calls}", "w") as f:
            f.write("\n".join(texts))
        return [[float(len(t)), float(t.count(" "))] for t in texts]

    def close(self):
        open(f"{self.folder}/closed-{os.getpid()}-{id(self)}", "w").close()


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(k, " ".join(["w"] * (k % 40)) + f" {k % 50}") for k in range(200)] + [(200, None), (201, ""), (202, "")]
    return spark.createDataFrame(rows, "k long, t string").repartition(3)


@pytest.mark.parametrize("batch,budget,most", [(64, 1 << 16, None), (5, 60, None), (64, 1 << 16, 2)])
def test_provided_is_independent_of_packing(spark, texts, tmp_path, batch, budget, most):
    folder = str(tmp_path)
    got = {r["k"]: r["v"] for r in providers.provided(texts, ["k"], "t", "v", "array<double>", lambda: Counting(folder, most=most), batch, budget, 2).collect()}
    want = {r["k"]: r["t"] or "" for r in texts.collect()}
    assert got == {k: [float(len(t)), float(t.count(" "))] for k, t in want.items()}
    calls = [open(f"{folder}/{n}").read().split("\n") for n in os.listdir(folder) if not n.startswith("closed")]
    assert sorted(t for c in calls for t in c) == sorted(set(want.values()))  # each distinct text once
    sizes = [[len(t.split(" ")) for t in c] for c in calls]
    assert all(s == sorted(s, reverse=True) and len(s) <= batch and (len(s) * s[0] <= budget or len(s) == 1) for s in sizes)
    assert any(n.startswith("closed") for n in os.listdir(folder))


def test_provider_is_closed_after_an_error(spark, texts, tmp_path):
    folder = str(tmp_path)
    with pytest.raises(Exception, match="no model"):
        providers.provided(texts, ["k"], "t", "v", "array<double>", lambda: Counting(folder, fail="no model")).collect()
    assert any(n.startswith("closed") for n in os.listdir(folder))


@pytest.mark.parametrize("value,width,words", [([1.0, math.nan], 2, "not finite"), ([1.0, math.inf], None, "not finite"), ([1.0], 2, "instead of 2"), ({"a": [[0.0, 1.0], [2.0]]}, 2, "instead of 2")])
def test_vectors_are_checked(value, width, words):
    with pytest.raises(ValueError, match=words):
        providers.check(value, width)
    providers.check({"tokens": ["a"], "vectors": [[0.0, 1.0]]}, 2)
    providers.check(np.ones((3, 2)), 2)


def test_one_text_that_is_too_large_is_an_error():
    with pytest.raises(RuntimeError, match="memory"):
        providers.asked(Counting("/nowhere", most=0.5), ["x"])


ROWS = [
    ("e", "A", 1, "the cat sat on the mat"), ("e", "A", 2, "a dog sat on the log"), ("e", "A", 3, ""), ("e", "B", 1, "the cat sat on the mat"),
    ("e", "B", 2, "Évidemment, le chat dort"), ("f", "A", 1, None), ("f", "B", 1, "the the the"), ("g", "A", 1, "the end " * 300),
]


def plain(rows, baseline=0.0):
    encode = contextual.hashed_vectors()
    made = {r[:3]: next(iter(encode([r[3] or ""]))) for r in rows}
    df = {}
    for m in made.values():
        for t in set(m["tokens"]):
            df[t] = df.get(t, 0) + 1
    out = {}
    for a, b in itertools.product(sorted(made), repeat=2):
        if a[0] != b[0] or not (a[1] == b[1] and a[2] <= b[2] or (a[1], b[1]) == ("A", "B")):
            continue
        p, r = 0.0, 0.0
        if made[a]["tokens"] and made[b]["tokens"]:
            def side(one, two):
                weight = [math.log((len(rows) + 1) / (df[t] + 1)) for t in one["tokens"]]
                best = [max(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)) for y in two["vectors"]) for x in one["vectors"]]
                return sum(w * x for w, x in zip(weight, best)) / sum(weight) if sum(weight) else 0.0

            p, r = side(made[a], made[b]), side(made[b], made[a])
        f = 2 * p * r / (p + r) if p + r else 0.0
        out[a[0], *a[1:], *b[1:]] = [(x - baseline) / (1 - baseline) for x in (p, r, f)]
    return out


@pytest.mark.parametrize("block,tile,baseline", [(64, 1 << 20, 0.0), (1, 3, 0.0), (2, 1 << 20, 0.25)])
def test_contextual_similarity(spark, monkeypatch, block, tile, baseline):
    monkeypatch.setattr(contextual, "TILE", tile)
    vectors = contextual.token_vectors(spark.createDataFrame(ROWS, RESPONSES).repartition(3))
    got = contextual.contextual_similarity(vectors, baseline, block).collect()
    want = plain(ROWS, baseline)
    assert len(got) == len(want)
    for r in got:
        assert [r["precision"], r["recall"], r["f1"]] == pytest.approx(want[tuple(r)[:5]], abs=1e-6)


def test_a_text_is_its_own_best_match(spark):
    vectors = contextual.token_vectors(spark.createDataFrame(ROWS, RESPONSES))
    own = {tuple(r)[:5]: r["f1"] for r in contextual.contextual_similarity(vectors).collect()}
    assert own["e", "A", 1, "A", 1] == pytest.approx(1) and own["e", "A", 1, "B", 1] == pytest.approx(1)
    assert own["e", "A", 3, "A", 3] == 0  # no tokens
    assert contextual.contextual_similarity(vectors.limit(0)).count() == 0


def test_context_changes_a_token():
    one, two = (next(iter(contextual.hashed_vectors()([t]))) for t in ("river bank", "savings bank"))
    assert one["vectors"][1] != two["vectors"][1]


def test_values_of_a_partition_are_not_held_together(spark):
    """Values leave call by call: at a call, those of a few calls before are alive at most."""

    def make():
        import gc
        import weakref

        class Value(dict):
            pass

        alive, calls = [], []

        def provider(texts):
            gc.collect()
            calls.append(1)
            held = sum(ref() is not None for ref in alive)
            if held > 3 * 64:
                raise ValueError(f"{held} values are held")
            for t in texts:
                value = Value(n=len(t))
                alive.append(weakref.ref(value))
                yield value

        return provider

    rows = spark.range(1500).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("t")).coalesce(1)
    found = providers.provided(rows, ["id"], "t", "v", "struct<n: int>", make)
    assert found.filter("v.n = length(concat('text ', id))").count() == 1500


def test_pairs_of_blocks_are_dealt_one_by_one(spark):
    """An essay of many blocks is no single task's; results do not depend on the size of blocks."""
    rows = spark.createDataFrame([("a", "AB"[k % 2], k // 2 + 1, f"word{k % 5} and word{k % 7} here") for k in range(24)] + [("b", "A", 1, "alone"), ("b", "B", 1, None)], "essay_file string, prompt string, response_index int, response string")
    vectors = contextual.token_vectors(rows)

    def found(block):
        return {tuple(r[:5]): tuple(round(x, 9) for x in r[5:]) for r in contextual.contextual_similarity(vectors, block=block).collect()}

    whole = found(64)
    assert len(whole) == 24 * 25 // 2 + 3 and found(3) == whole and found(1) == whole
    tasks = contextual.contextual_similarity(vectors, block=2).rdd.mapPartitions(lambda p: [sum(1 for r in p if r["essay_file"] == "a")]).collect()
    assert sum(n > 0 for n in tasks) > 1
