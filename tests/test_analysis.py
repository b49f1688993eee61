"""Statistics over vector tables: fixture facts, malformed tables, bootstrap, Hotelling."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stabilis.operators import pairs, stability
from stabilis.sources.tables import COMPONENTS, KEYS, VECTORS, vector_violations


def fixture(spark, essays=2, k=3):
    rows = []
    for e in range(essays):
        for kind, offset in (("AA", 0.2), ("BB", 0.3), ("AB", 0.1)):
            for i, j in itertools.product(range(1, k + 1), repeat=2):
                if kind == "AB" or i <= j:
                    v = offset + 0.01 * e + 0.02 * (i + j)
                    rows.append((f"essay_{e}.md", kind[0], i, kind[1], j, kind, k, v, 0.8 * v, v + 0.1, 0.7 * v))
    return spark.createDataFrame(rows, VECTORS)


@pytest.fixture(scope="module")
def vectors(spark):
    return fixture(spark).cache()


def test_counts_and_coverage(spark, vectors):
    assert vectors.count() == 42 and fixture(spark, 1, 10).count() == 210
    assert vector_violations(vectors).count() == 0 and pairs.coverage_violations(vectors, 3).count() == 0


@pytest.mark.parametrize(
    "change,rule",
    [
        (lambda v: v.unionAll(v.limit(1)), "duplicate_key"),
        (lambda v: v.withColumn("org", F.lit(float("nan"))), "not_finite"),
        (lambda v: v.withColumn("org", F.lit(None).cast("double")), "not_finite"),
        (lambda v: v.withColumn("comparison_type", F.lit("BA")), "wrong_type"),
        (lambda v: v.withColumn("essay_file", F.lit(" ")), "blank_essay"),
        (lambda v: v.withColumn("response_count", F.lit(1)), "bad_count"),
        (lambda v: v.withColumn("response_count", F.col("response_index_1") + 3), "several_counts"),
        (lambda v: v.withColumn("prompt_1", F.lit("C")), "not_canonical"),
        (lambda v: v.withColumn("response_index_1", F.lit(0)), "bad_index"),
    ],
)
def test_malformed_tables(vectors, change, rule):
    assert rule in {r["rule"] for r in vector_violations(change(vectors)).collect()}


def test_missing_pair(vectors):
    short = vectors.filter("NOT (essay_file = 'essay_0.md' AND comparison_type = 'AB' AND response_index_1 = 2 AND response_index_2 = 2)")
    assert [r["problem"] for r in pairs.coverage_violations(short, 3).collect()] == ["missing"]


def test_distance_to_centroid(spark):
    rows = [("e", "A", 1, "A", 2, "AA", 3, 0.0, 0.0, 0.0, 0.0), ("e", "A", 1, "A", 3, "AA", 3, 2.0, 4.0, 6.0, 8.0)]
    got = stability.vector_distances(spark.createDataFrame(rows, VECTORS)).collect()
    assert [r["distance"] for r in got] == pytest.approx([math.sqrt(30)] * 2)
    within = stability.within_stability(spark.createDataFrame(rows, VECTORS)).first()
    assert [within[f"{c}_mean"] for c in COMPONENTS] == pytest.approx([1, 2, 3, 4])


def test_self_pairs_do_not_count(vectors):
    poisoned = vectors.withColumn("org", F.when((F.col("comparison_type") != "AB") & (F.col("response_index_1") == F.col("response_index_2")), 100.0).otherwise(F.col("org")))
    same = lambda f: f(vectors).exceptAll(f(poisoned)).count() == 0
    assert same(stability.within_stability) and same(stability.prompt_shift)
    assert same(lambda v: stability.bootstrap_within(v, 5, 1)) and same(lambda v: stability.bootstrap_shift(v, 5, 1))


def test_described(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)] + [("b", 0.0), ("b", 0.0), ("c", 1.0)], "g string, x double")
    got = {r["g"]: r for r in stability.described(df, ["g"], "x").collect()}
    assert (got["a"]["mean"], got["a"]["iqr"], got["a"]["range"]) == (2.5, 1.5, 3.0) and got["a"]["sd"] == pytest.approx(math.sqrt(5 / 3))
    assert got["b"]["cv"] is None and got["c"]["sd"] is None


def test_prompt_shift(spark):
    rows = [r for e, d in (("x", 0.2), ("y", -0.2)) for r in ((e, "A", 1, "A", 2, "AA", 2, *[0.5] * 4), (e, "B", 1, "B", 2, "BB", 2, *[0.5] * 4), (e, "A", 1, "B", 1, "AB", 2, 0.5 + d, 0.5, 0.5, 0.5))]
    shifts = stability.prompt_shift(spark.createDataFrame(rows, VECTORS))
    assert sorted(r["delta_org"] for r in shifts.collect()) == pytest.approx([-0.2, 0.2])
    overall = stability.overall_shift(shifts).first()
    assert overall["essay_count"] == 2 and overall["magnitude"] == pytest.approx(0.2) and overall["delta_org"] == pytest.approx(0)


def test_bootstrap_keeps_multiplicity(spark, monkeypatch):
    v = fixture(spark, 1, 4)
    table = lambda kind: np.array([tuple(r) for r in v.filter(F.col("comparison_type") == kind).select("response_index_1", "response_index_2", *COMPONENTS).collect()])
    monkeypatch.setattr(stability, "drawn", lambda *a: np.array([[1, 2, 2, 3]]))
    got = stability._resampled({kind: table(kind) for kind in ("AA", "BB", "AB")}, "essay_0.md", 1, 1, 0, True)
    kept = [(1, 2), (1, 2), (1, 3), (2, 3), (2, 3)]
    for kind, offset in (("AA", 0.2), ("BB", 0.3)):
        x = [offset + 0.02 * (i + j) for i, j in kept]
        assert got[kind][0, 1] == pytest.approx(sum(x) / 5)
        scale = math.sqrt(1 + 0.64 + 1 + 0.49)
        assert got[kind][0, 0] == pytest.approx(sum(abs(a - sum(x) / 5) for a in x) / 5 * scale)
    ab = sum(0.1 + 0.02 * (i + j) for i in (1, 2, 2, 3) for j in (1, 2, 2, 3)) / 16
    assert got["AB"][0, 0] == pytest.approx(ab)


def test_bootstrap_of_essays(spark, vectors):
    """Rows against slots walked one by one; a prompt with one response has no replicate."""
    got = {(r["essay_file"], r["prompt"], r["replicate"]): r for r in stability.bootstrap_within(vectors, 7, 3).collect()}
    shift = {(r["essay_file"], r["replicate"]): r for r in stability.bootstrap_shift(vectors, 7, 3).collect()}
    assert len(got) == 2 * 2 * 7 and len(shift) == 2 * 7
    table = {tuple(r[k] for k in KEYS): [r[c] for c in COMPONENTS] for r in vectors.collect()}
    for e in ("essay_0.md", "essay_1.md"):
        ids = {p: stability.drawn(3, e, p, 3, 1, 7) for p in "AB"}
        for n in range(7):
            means = {}
            for p in "AB":
                s = ids[p][n].tolist()
                x = np.array([table[(e, p, min(a, b), p, max(a, b))] for a, b in itertools.combinations(s, 2) if a != b])
                means[p] = x.mean(0)
                row = got[(e, p, n + 1)]
                assert [row[f"{c}_mean"] for c in COMPONENTS] == pytest.approx(list(means[p]))
                assert row["mean_distance"] == pytest.approx(np.sqrt(((x - means[p]) ** 2).sum(1)).mean())
            ab = np.array([table[(e, "A", a, "B", b)] for a in ids["A"][n].tolist() for b in ids["B"][n].tolist()]).mean(0)
            assert [shift[(e, n + 1)][f"delta_{c}"] for c in COMPONENTS] == pytest.approx(list(ab - (means["A"] + means["B"]) / 2))
    lone = vectors.filter("prompt_1 = 'A' AND prompt_2 = 'A' OR response_index_1 = 1 AND response_index_2 = 1")
    assert {r["prompt"] for r in stability.bootstrap_within(lone, 3, 1).collect()} == {"A"} and stability.bootstrap_shift(lone, 3, 1).count() == 0


def test_draws_are_seeded_and_not_degenerate():
    a, b = (stability.drawn(3, "e", "A", 2, 1, 200) for _ in range(2))
    assert (a == b).all() and a.shape == (200, 2) and set(a.ravel().tolist()) == {1, 2} and (a.min(1) < a.max(1)).all()
    assert (stability.drawn(4, "e", "A", 5, 1, 50) != stability.drawn(3, "e", "A", 5, 1, 50)).any()
    with pytest.raises(ValueError):
        stability.drawn(3, "e", "A", 1, 1, 1)


def test_any_replicate_can_be_drawn_by_itself():
    whole = stability.drawn(3, "e", "A", 3, 1, 500)
    assert (stability.drawn(3, "e", "A", 3, 101, 50) == whole[100:150]).all()
    share = np.bincount(stability.drawn(5, "e", "B", 10, 1, 20_000).ravel(), minlength=11)[1:] / 200_000
    assert abs(share - 0.1).max() < 0.005


@pytest.mark.parametrize("chunk,tile", [(1_250, 1 << 19), (3, 8)])
def test_chunks_and_tiles_do_not_change_replicates(spark, vectors, monkeypatch, chunk, tile):
    want = {f: sorted(map(repr, f(vectors, 10, 3).collect())) for f in (stability.bootstrap_within, stability.bootstrap_shift)}
    arrays = stability.within_replicates(vectors, 10, 3).collect()
    monkeypatch.setattr(stability, "CHUNK", chunk)
    monkeypatch.setattr(stability, "TILE", tile)
    for f, rows in want.items():
        got = f(vectors, 10, 3).collect()
        assert len(got) == len(rows) and [pytest.approx(r[-4:]) for r in sorted(got, key=lambda r: repr(r[:3]))] == [r[-4:] for r in sorted(f(vectors, 10, 3).collect(), key=lambda r: repr(r[:3]))]
    again = {(r["essay_file"], r["prompt"]): r for r in stability.within_replicates(vectors, 10, 3).collect()}
    for r in arrays:
        for m in stability.METRICS:
            assert again[r["essay_file"], r["prompt"]][m] == pytest.approx(r[m])


@pytest.mark.parametrize("kind,share", [("AB", 1.0), ("AA", 1.0), ("AB", 0.6)])
def test_centroids_as_products_of_matrices(monkeypatch, kind, share):
    """Large essays' centroids, also of tables with missing pairs, equal those of the walk over pairs."""
    rng, k = np.random.default_rng(5), 30
    i, j = (x.ravel() for x in np.meshgrid(np.arange(1, k + 1), np.arange(1, k + 1), indexing="ij"))
    kept = (rng.random(k * k) < share) & ((kind == "AB") | (i < j))
    i, j = i[kept], j[kept]
    scores = rng.random((len(i), len(COMPONENTS)))
    first = stability.counted(stability.drawn(1, "e", "A", k, 1, 40), k)
    second = first if kind == "AA" else stability.counted(stability.drawn(1, "e", "B", k, 1, 40), k)
    calls, matrices = [], stability._centres
    monkeypatch.setattr(stability, "_centres", lambda *a: calls.append(1) or matrices(*a))
    fast = stability.weighted_means(first, second, i, j, scores, distances=False)
    assert calls == [1] and np.allclose(fast, stability.weighted_means(first, second, i, j, scores)[:, 1:], rtol=1e-12)


@pytest.mark.parametrize("k,distances", [(3, True), (3, False), (7, True), (7, False), (30, True), (60, True)])
def test_means_and_distances_of_few_and_many_pairs(k, distances):
    """Against the plain sums; tiles of many pairs stay in a core's cache, half a million cells at a time would not."""
    import tracemalloc

    rng, n = np.random.default_rng(6), 1_250
    i, j = np.triu_indices(k, 1)
    i, j, scores = i + 1, j + 1, rng.random((len(i), len(COMPONENTS)))
    counts = stability.counted(stability.drawn(2, "e", "A", k, 1, n), k)
    tracemalloc.start()
    got = stability.weighted_means(counts, counts, i, j, scores, distances)
    assert tracemalloc.get_traced_memory()[1] < 10 << 20
    tracemalloc.stop()
    for r in range(0, n, 97):
        w = counts[r, i] * counts[r, j]
        centre = (w[:, None] * scores).sum(0) / w.sum()
        apart = (w * np.sqrt(((scores - centre) ** 2).sum(1))).sum() / w.sum()
        assert np.allclose(got[r], [apart, *centre] if distances else centre, rtol=1e-12, atol=1e-14)


def test_places_are_rounded_as_in_sql(spark):
    """Values whose double lies beside a half, where decimals and doubles round apart; signs, zeros and what is no number."""
    import duckdb

    from stabilis.plans import catalog

    rng = np.random.default_rng(7)
    values = [*((rng.integers(0, 10**7, 3_000) * 2 + 1) / 2e6).tolist(), *rng.normal(size=200).tolist(), 0.0078125, -0.0078125, 1e-7, -1e-7, 0.0, 5e-7, 1e10 + 0.5, 3e9]
    values += [-v for v in values[:500]]
    frame = spark.createDataFrame([*[(n, v) for n, v in enumerate(values)], (-1, None), (-2, float("nan"))], "n int, v double")
    got = {r["n"]: r["v"] for r in catalog.rounded(frame).collect()}
    want = duckdb.sql("SELECT " + ", ".join(f"round({v!r}::DOUBLE, 6)" for v in values)).fetchall()[0]
    assert [got[n] for n in range(len(values))] == list(want)
    assert got[-1] is None and math.isnan(got[-2]) and catalog.rounded(frame).schema == frame.schema


def test_bootstrap_of_an_essay_with_200_responses(spark):
    """Tiles keep memory small: 60,000 pairs and 40 replicates, in tiles of half a million cells."""
    k = 200
    rng = np.random.default_rng(1)
    tables = {kind: np.array([(i, j, *rng.random(4)) for i in range(1, k + 1) for j in range(1, k + 1) if kind == "AB" or i <= j]) for kind in ("AA", "BB", "AB")}
    import tracemalloc

    tracemalloc.start()
    got = stability._resampled(tables, "e", 1, 40, 7, True)
    assert tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()
    ids = {p: stability.drawn(7, "e", p, k, 1, 40)[11] for p in "AB"}
    plain = {kind: {(int(r[0]), int(r[1])): r[2:] for r in t} for kind, t in tables.items()}
    x = np.array([plain["AA"][min(a, b), max(a, b)] for a, b in itertools.combinations(ids["A"].tolist(), 2) if a != b])
    assert got["AA"][11, 1:] == pytest.approx(x.mean(0)) and got["AA"][11, 0] == pytest.approx(np.sqrt(((x - x.mean(0)) ** 2).sum(1)).mean())
    ab = np.array([plain["AB"][a, b] for a in ids["A"].tolist() for b in ids["B"].tolist()])
    assert got["AB"][11] == pytest.approx(ab.mean(0))


def test_counts_of_a_range_of_ids_are_those_of_whole_samples(monkeypatch):
    monkeypatch.setattr(stability, "SLOTS", 3)
    for k in (2, 3, 11):
        whole = stability.counted(stability.drawn(7, "e", "A", k, 5, 60), k)
        for low in range(1, k + 1, 4):
            assert (stability.counted_between(7, "e", "A", k, 5, 60, low, low + 4)[:, : k + 1 - low] == whole[:, low : low + 4]).all()
    with pytest.raises(ValueError):
        stability.counted_between(3, "e", "A", 1, 1, 1, 1, 2)


def test_large_essays_are_never_one_row(spark, monkeypatch):
    """Replicates of essays in tiles are those of essays in a row; a prompt with one response still has none."""
    rng = np.random.default_rng(4)
    keys = [(e, p, i, q, j) for e, a, b in (("e", 7, 5), ("f", 2, 3), ("g", 1, 6), ("h", 6, 0)) for p, q, m, n in (("A", "A", a, a), ("B", "B", b, b), ("A", "B", a, b)) for i in range(1, m + 1) for j in range(1, n + 1) if p != q or i <= j]
    # (pairs are missing, too)
    vectors = spark.createDataFrame([(*k, k[1] + k[3], 7, *map(float, rng.random(4))) for k in keys if k[2] != 3 or k[4] != 4], VECTORS).repartition(3)
    runs = [stability.bootstrap_within, stability.bootstrap_shift, stability.within_replicates, stability.shift_replicates]
    flat = lambda r: [y for x in r if not isinstance(x, (str, int)) for y in (x if isinstance(x, list) else [x])]
    made = lambda: [{tuple(x for x in r if isinstance(x, (str, int))): flat(r) for r in f(vectors, 9, 3).collect()} for f in runs]
    want = made()
    assert {k[0] for k in want[0]} == {"e", "f", "g", "h"} and {k[0] for k in want[1]} == {"e", "f"}
    monkeypatch.setattr(stability, "SIDE", 2)
    monkeypatch.setattr(stability, "CHUNK", 4)
    for f, x, y in zip(runs, made(), want):
        assert x.keys() == y.keys(), f
        for k in y:
            assert x[k] == pytest.approx(y[k], abs=1e-12), (f, k)
    rows = [r for r in stability._tiles(vectors, stability._sizes(vectors).filter("most > 2").drop("most"), 2)[0].collect() if r["essay_file"] != "f"]
    assert {r["essay_file"] for r in rows} == {"e", "g", "h"} and max(len(r["pairs"]) for r in rows) <= 4


def test_replicates_are_made_in_many_tasks(spark, vectors):
    made = stability.bootstrap_within(fixture(spark, 8, 3), 5_000, 1)
    used = made.select(F.spark_partition_id().alias("p")).distinct().count()
    assert used > 1 and made.count() == 8 * 2 * 5_000


@pytest.mark.parametrize("ranges", [4_096, 3])
def test_quartiles_are_exact(spark, monkeypatch, ranges):
    """Against numpy: ties, one value, few rows, heavy concentration, nulls; few and many ranges."""
    monkeypatch.setattr(stability, "RANGES", ranges)
    rng = np.random.default_rng(2)
    groups = {"ties": rng.integers(0, 4, 301).astype(float), "one": np.array([5.0]), "two": np.array([1.0, 2.0]), "same": np.full(50, 0.3), "wide": np.append(rng.random(200), [1e12, -1e9]), "small": rng.normal(size=97) * 1e-9}
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v] + [("ties", None), ("none", None)], "g string, x double").repartition(3)
    for few in (True, False):
        got = {r["g"]: r for r in stability.described(df, ["g"], "x", few).collect()}
        for g, v in groups.items():
            assert [got[g][n] for n in ("q1", "median", "q3")] == pytest.approx(np.quantile(v, [0.25, 0.5, 0.75]).tolist())
            assert got[g]["count"] == len(v)
        assert got["none"]["count"] == 0 and got["none"]["median"] is None


def test_intervals_of_arrays(spark):
    df = spark.createDataFrame([("g", [2.0, -2.0, 0.0, 1.0, -1.0], [1.0] * 5)], "g string, x array<double>, y array<double>")
    got = {r["metric"]: r for r in stability.replicate_intervals(df, ["g"], ["x", "y"], ["x"], 0.5).collect()}
    assert (got["x"]["low"], got["x"]["high"], got["x"]["directional"]) == (-1.0, 1.0, 0.6)
    assert (got["y"]["low"], got["y"]["high"], got["y"]["directional"]) == (1.0, 1.0, None)
    with pytest.raises(ValueError):
        stability.replicate_intervals(df, ["g"], ["x"], [], 1.0)


def test_intervals(spark):
    df = spark.createDataFrame([(float(x),) for x in (-2, -1, 0, 1, 2)], "x double")
    r = stability.intervals(df, [], ["x"], ["x"], 0.5).first()
    assert (r["low"], r["high"], r["directional"]) == (-1.0, 1.0, 0.6)
    assert stability.intervals(df, [], ["x"], [], 0.5).first()["directional"] is None
    with pytest.raises(ValueError):
        stability.intervals(df, [], ["x"], [], 1.0)


def test_hotelling(spark):
    m = (0.1, 0.2, 0.3, 0.4)
    rows = [tuple(m[c] + s * (c == k) for c in range(4)) for k in range(4) for s in (1, -1)]
    names = ", ".join(f"delta_{c} double" for c in COMPONENTS)
    r = stability.hotelling(spark.createDataFrame(rows, names)).first()
    assert r["status"] == "available" and (r["df1"], r["df2"]) == (4, 4)
    assert r["t2"] == pytest.approx(28 * 0.3) and r["f"] == pytest.approx(1.2)
    assert stability.hotelling(spark.createDataFrame(rows[:4], names)).first()["status"] == "unavailable"
    assert stability.hotelling(spark.createDataFrame([(1.0,) * 4] * 8, names)).first()["status"] == "unavailable"
    x = 4 / (4 + 4 * 6.388)
    assert x**2 * (1 + 2 * (1 - x)) == pytest.approx(0.05, abs=1e-4)


def test_resume(vectors):
    done = vectors.filter("comparison_type = 'AB'").select(*KEYS)
    assert pairs.missing_pairs(vectors, done).count() == 24


def test_registered_bootstrap_has_the_default_number_of_replicates(spark):
    from stabilis.plans import catalog

    got = catalog.QUERIES["bootstrap_overall"](spark, "/root/testdata/sf0.001").select("replicate").distinct()
    assert got.count() == 5_000
