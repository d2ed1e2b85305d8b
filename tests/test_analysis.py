import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from themeweave.operators import metrics as M, quality as Q, robustness as R, shares as S, temporal as Y, vectors as V

SCHEMA = "phrase_id int, chunk_id string, cluster_id int, year int, technology_meta string, source_file string"


def phrases(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_distribution_golden(spark):
    rows = [(i, "c", c, 2020, t, "d") for i, (c, t) in enumerate([(0, "a"), (0, "b"), (1, "a"), (2, None), (None, "a")])]
    got = {r.cluster_id: r for r in M.group_distribution(phrases(spark, rows), "cluster_id", "technology_meta").collect()}
    assert got[0].entropy_norm == 1 and got[1].entropy_norm == 0 and got[0].hhi == 0.5 and 2 not in got and None not in got
    glob = {r.cluster_id: r for r in M.group_distribution(phrases(spark, rows), "cluster_id", "technology_meta", basis="global").collect()}
    assert glob[0].entropy_norm == pytest.approx(math.log(2) / math.log(2))
    prof = {r.cluster_id: r for r in M.cluster_profile(phrases(spark, rows), "cluster_id", "technology_meta", 4).collect()}
    assert prof[3]["size"] == 0 and prof[2]["size"] == 1 and prof[2].entropy_raw == 0 and prof[0].is_cross_cutting and not prof[3].is_cross_cutting
    with pytest.raises(ValueError):
        M.group_distribution(phrases(spark, rows), "cluster_id", "technology_meta", basis="other")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4), st.sampled_from("abc")), min_size=1, max_size=30))
def test_salience_rows_sum_to_one(spark, pairs):
    df = phrases(spark, [(i, "c", c, 2020, t, "d") for i, (c, t) in enumerate(pairs)])
    sal = S.salience(df, "technology_meta", "cluster_id")
    sums = {r.technology_meta: r.s for r in sal.groupBy("technology_meta").agg(F.sum("share").alias("s")).collect()}
    assert all(abs(v - 1) < 1e-9 for v in sums.values())
    assert sal.count() == len({t for _, t in pairs}) * len({c for c, _ in pairs})


def test_baseline_counts_zeros_and_null_clusters(spark):
    rows = [(1, "c", 0, 2020, "T", "d"), (2, "c", None, 2020, "T", "d"), (3, "c", 0, 2020, "x", "d"), (4, "c", 1, 2020, "y", "d"), (5, "c", 1, 2020, "y", "d")]
    got = {r.cluster_id: r for r in S.target_and_baselines(S.salience(phrases(spark, rows), "technology_meta", "cluster_id"), "technology_meta", "cluster_id", "T").collect()}
    assert got[0].target_share == 0.5 and got[0].tech_weighted == 0.5 and got[0].doc_weighted == pytest.approx(1 / 3)
    assert got[1].target_share == 0 and got[1].tech_weighted == 0.5 and got[1].doc_weighted == pytest.approx(2 / 3)


def test_year_fraction_golden(spark):
    chunks = spark.createDataFrame([("c0", 2021, "T", "a"), ("c1", 2021, "T", "a"), ("c2", 2021, "T", "b"), ("c3", 2022, "T", "c"), ("c4", 2022, "T", "c"), ("c5", 2022, "Other", "d")], "chunk_id string, year int, technology_meta string, source_file string")
    ph = spark.createDataFrame([("c0", 0), ("c1", 1), ("c2", 0), ("c3", 0), ("c4", 1), ("c5", None)], "chunk_id string, cluster_id int")
    got = {(r.year, r.cluster_id): r.fraction for r in Y.year_doc_fraction(ph, chunks, "cluster_id", tech="technology_meta", target="T").collect()}
    assert got == {(2021, 0): 1.0, (2021, 1): 0.5, (2022, 0): 1.0, (2022, 1): 1.0}
    whole = {(r.year, r.cluster_id): r.fraction for r in Y.year_doc_fraction(ph, chunks, "cluster_id").collect()}
    assert whole[2022, 0] == 0.5
    assert Y.year_doc_fraction(ph.limit(0), chunks, "cluster_id").count() == 0


def test_ranks_share_ties_and_novelty(spark):
    m = spark.createDataFrame([(1, 0, 3.0), (1, 1, 3.0), (1, 2, 0.0), (2, 0, 0.0), (2, 1, 5.0), (2, 2, 1.0)], "year int, c int, v double")
    v = {r.year: r.volatility for r in Y.rank_volatility(m, "c", "v").collect()}
    assert v == {2: pytest.approx((abs(3 - 1.5) + abs(1 - 1.5) + abs(2 - 3)) / 3)}
    n = {r.year: (r.active, r.new, r.new_share) for r in Y.cluster_novelty(m, "c", "v").collect()}
    assert n == {1: (2, 2, 1.0), 2: (2, 1, 0.5)}
    rel = Y.row_relative(m.withColumn("v", F.when(F.col("year") == 1, 0.0).otherwise(F.col("v"))), "v").collect()
    assert sum(r.relative for r in rel if r.year == 1) == 0 and sum(r.relative for r in rel if r.year == 2) == pytest.approx(1)


def test_lexical_novelty(spark):
    rows = [("AI", 2018, "privacy worries"), ("ai", 2019, "privacy again"), ("AI", 2019, None), ("gm", 2018, "again crops"), ("AI", 2020, "no")]
    df = spark.createDataFrame(rows, "technology_meta string, year int, concern string")
    got = {r.year: (r.num_phrases, r.vocab, r.new) for r in Y.lexical_novelty(df, "technology_meta", "concern", "Ai").collect()}
    assert got == {2018: (1, 2, 2), 2019: (2, 2, 1), 2020: (1, 0, 0)}


def test_volume_and_kind_checks(spark):
    df = phrases(spark, [(1, "c1", 0, 2020, "a", "d"), (2, "c1", 0, 2020, "a", "d"), (3, "c2", 0, 2021, "a", "d")])
    got = {r.year: (r.concern_phrases, r.concern_paragraphs) for r in M.volume_table(df, "concern", "technology_meta", "year").collect()}
    assert got == {2020: (2, 1), 2021: (1, 1)}
    with pytest.raises(ValueError):
        M.volume_table(df.drop("chunk_id"), "concern", "technology_meta", "year")
    for bad in ("Concern", "risk", ""):
        with pytest.raises(ValueError):
            M.top_clusters(df, bad, "cluster_id")
    top = M.top_clusters(phrases(spark, [(i, "c", c, 2020, "a", "d") for i, c in enumerate([0, 0, 1, 2, 0, 1])]), "concern", "cluster_id", n=2).collect()
    assert [(r.cluster_id, r.n) for r in top] == [(0, 3), (1, 2)]


def ari(a, b):
    from collections import Counter

    c2 = lambda n: n * (n - 1) / 2
    n, cells = len(a), Counter(zip(a, b))
    i, x, y = sum(map(c2, cells.values())), sum(map(c2, Counter(a).values())), sum(map(c2, Counter(b).values()))
    e = x * y / c2(n)
    return (i - e) / ((x + y) / 2 - e)


def test_adjusted_rand(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 4, 60).tolist(), rng.integers(0, 3, 60).tolist()
    df = spark.createDataFrame(list(zip(a, b)), "a int, b int")
    assert S.adjusted_rand(df, "a", "b").first().ari == pytest.approx(ari(a, b))
    assert S.adjusted_rand(df, "a", "a").first().ari == pytest.approx(1)


def test_robustness_grid(spark):
    rng = np.random.default_rng(42)
    x = rng.random((4, 8))
    x /= x.sum(1, keepdims=True)
    sal = spark.createDataFrame([(f"t{t}", c, float(x[t, c])) for t in range(4) for c in range(8)], "tech string, c int, share double")
    out = R.stable_core_robustness(sal, "tech", "c", "t0", (0.4, 0.5), (0.7, 0.8)).collect()
    assert len(out) == 4 and all(len(r.over.split("; ")) == 5 for r in out)
    with pytest.raises(ValueError):
        R.stable_core_robustness(sal, "tech", "c", "missing")


def test_vectors(spark):
    rng = np.random.default_rng(1)
    v = np.r_[rng.normal(0, 0.05, (10, 4)) + [1, 0, 0, 0], rng.normal(0, 0.05, (10, 4)) + [0, 1, 0, 0], rng.normal(0, 0.05, (10, 4)) + [0, 0, 1, 0]]
    df = spark.createDataFrame([(i, i // 10, x.tolist()) for i, x in enumerate(v)], "id int, c int, v array<double>")
    cents = V.centroids(df, "c", "v")
    c = {r.c: np.array(r.centroid) for r in cents.collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for k in range(3):
        m = u[k * 10 : k * 10 + 10].mean(0)
        assert np.allclose(c[k], m / np.linalg.norm(m))
    near = {r.id: r.c for r in V.assign_nearest(df.drop("c"), "id", "v", cents, "c", "centroid").collect()}
    assert all(near[i] == i // 10 for i in range(30))
    soft = V.soft_membership(df, "id", "v", cents.select("c", "centroid"), "c", "centroid")
    assert soft.count() == 90 and soft.filter("similarity > 0.9").count() == 30
    assigned, kc = V.kmeans(df.drop("c"), "id", "v", 3, starts=2)
    groups = {}
    for r in assigned.collect():
        groups.setdefault(r.cluster_id, set()).add(r.id // 10)
    assert sorted(map(len, groups.values())) == [1, 1, 1] and all(abs(np.linalg.norm(r.centroid) - 1) < 1e-9 for r in kc.collect())
    with pytest.raises(ValueError):
        V.kmeans(df.limit(2), "id", "v", 3)
    branch = V.average_linkage(v, 3)
    assert len({tuple(branch[k * 10 : k * 10 + 10]) for k in range(3)}) == 3
    tops = V.exemplars(df, "id", "v", "c", cents.select("c", "centroid"), "centroid", 2)
    assert tops.count() == 6


def test_pca_trajectory(spark):
    pts = {2018: [0.0, 0, 0], 2019: [3.0, 4, 0], 2020: [6.0, 8, 0.5]}
    long = spark.createDataFrame([(y, k, x) for y, p in pts.items() for k, x in enumerate(map(float, p))], "year int, pos int, mean double")
    got = V.pca_trajectory(long).orderBy("year").collect()
    want = np.linalg.norm(np.array(pts[2019]) - np.array(pts[2018]))
    assert math.hypot(got[1].pc1 - got[0].pc1, got[1].pc2 - got[0].pc2) == pytest.approx(want, rel=1e-2)
    assert got[0].displacement_1 == 0
    assert V.pca_trajectory(long.filter("year = 2018")).first().pc2 == 0
    assert V.pca_trajectory(long.limit(0)).count() == 0


def test_prompt_agreement(spark):
    ph = spark.createDataFrame([("A", "c1", 1, [1.0, 0.0]), ("A", "c1", 2, [0.0, 1.0]), ("B", "c1", 3, [1.0, 0.01]), ("B", "c2", 4, [1.0, 0.0])], "variant string, chunk_id string, phrase_id int, v array<double>")
    ch = spark.createDataFrame([(v, c) for v in "AB" for c in ("c1", "c2", "c3")], "variant string, chunk_id string")
    r = S.prompt_agreement(ph, ch, "v").collect()
    assert len(r) == 1 and r[0].n_chunks == 3 and r[0].n_both == 1
    assert r[0].yield_agreement == pytest.approx(2 / 3) and r[0].phrase_agreement == pytest.approx(2 / 3)


def test_quality_tables(spark):
    df = spark.createDataFrame([("the public dialogue was long",), ("Public dialogue",), (None,)], "p string")
    top = {r.term: r for r in Q.vocabulary_frequency(df, "p", top_n=3).collect()}
    assert top["public dialogue"].is_meta_vocab and top["public dialogue"].n == 2 and top["public dialogue"].pct_of_phrases == 100
    assert Q.vocabulary_frequency(df.limit(0), "p").count() == 0
    h = Q.histogram(spark.createDataFrame([(float(x),) for x in (0, 1, 2, 10)], "v double"), "v", 5).collect()
    assert sum(r.n for r in h) == 4 and max(r.bin for r in h) == 4
    docs, meta = spark.createDataFrame([("a",), ("b",)], "f string"), spark.createDataFrame([("a", "T", 2020)], "filename string, technology string, year int")
    assert {tuple(r) for r in Q.metadata_join_lenient(docs, meta, "f").select("f", "technology_meta", "year").collect()} == {("a", "T", 2020), ("b", "Unknown", None)}
    with pytest.raises(ValueError):
        Q.metadata_join_strict(docs, meta, "f")
    assert {tuple(r) for r in Q.label_set_check(docs, "f", meta, "filename").collect()} == {("b", "unexpected")}
