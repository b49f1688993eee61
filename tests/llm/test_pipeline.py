"""The corpus pipeline on the smallest tables, stage by stage against plain Python."""

import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from stabilis.llm import toxicity
from stabilis.llm.common import held_out, mixed, table
from tests.llm.test_operators import grouped, plain_fingerprint, water

SF = "/root/testdata/sf0.001"


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def plain_score(model, text):
    """The score of a text's distinct n-grams, each hashed by itself."""
    raw = text.encode().translate(bytes(toxicity._FOLD.tolist()))
    data, logit, weights = b" " + raw + b" ", model.bias, dict(zip(model.columns.tolist(), model.weights.tolist()))
    grams = {data[k : k + n] for n in toxicity.GRAMS for k in range(len(data) - n + 1)}
    hashed = {int(mixed(np.array([int.from_bytes(g, "little") ^ (len(g) << 60)], np.uint64))[0]) >> (64 - toxicity.FEATURE_BITS) for g in grams}
    return model.score(logit + sum(weights.get(h, 0.0) for h in hashed))


def test_stages(spark):
    docs = table(spark, SF, "documents")
    before = texts(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        after = texts(out)
        assert out.columns == docs.columns and set(after) <= set(before)
        if name == "toxicity":
            model = toxicity.fit(docs, table(spark, SF, "labels"))
            assert set(after) == {i for i, t in before.items() if plain_score(model, t) < toxicity.CUT} and len(after) >= 0.7 * len(before)
        elif name == "exact dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[i]), i)
            assert set(after) == set(first.values())
        elif name.startswith("SimHash"):
            fps = {i: plain_fingerprint(t) for i, t in before.items()}
            group, first = grouped(fps.values()), {}
            for i in sorted(before):
                first.setdefault(group[fps[i]], i)
            assert set(after) == set(first.values())
        elif name.startswith("mixing"):
            counts, sizes, taken = Counter(r["doc_id"] for r in out.select("doc_id").collect()), Counter(), Counter()
            words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in before.items()}
            for r in docs.collect():
                sizes[r["source"]] += words[r["doc_id"]]
                taken[r["source"]] += words[r["doc_id"]] * counts[r["doc_id"]]
            target = water(sizes)
            assert max(counts.values()) <= 2 and all(abs(taken[s] - target[s]) <= max(words.values()) / 2 + 1 for s in sizes)
        docs, before = out, after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(last) == docs.count()
    for r in last:
        assert r["lossless"] and r["decoded_sha256"] == hashlib.sha256(before[r["doc_id"]].encode()).hexdigest() and len(r["ids"]) == r["n_tokens"]


def test_pipeline_on_odd_documents(spark, tmp_path):
    """Nulls in every column, repeated rows, blank and very long texts, and columns named like inner ones."""
    names = ["row", "key", "size", "copies", "fingerprint", "score", "predicted", "digest", "id", "twin", "times"]
    made = [(1, "one two", "a"), (1, "one two", "a"), (2, "one  two", "b"), (3, None, None), (None, "three", None), (None, None, "a"), (4, "", "b"), (5, "long " * 200_000, "b"), (6, "\u00e9\u4e2d\U0001f600", "a")]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string").select("*", F.lit(None).cast("string").alias("lang"), *[F.lit(7).alias(c) for c in names])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0.5, 0), (None, None, None), (9, 0.1, 1)], "doc_id long, quality double, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = table(spark, str(tmp_path), "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
    kept = {(r["doc_id"], r["text"]) for r in now.collect()}
    # of equal texts the row with the smallest id stays; the null texts and the empty one are equal
    assert kept == {(1, "one two"), (3, None), (None, "three"), (5, "long " * 200_000), (6, "\u00e9\u4e2d\U0001f600")}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {i for i, _ in kept}


def test_pipeline_on_no_documents(spark, tmp_path):
    for name in ("documents", "labels"):
        table(spark, SF, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_held_out_matches_crc32(spark):
    import zlib

    df = spark.range(50).select("id", held_out("id").alias("h"))
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in df.collect())
