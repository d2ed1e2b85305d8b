import numpy as np
import math
import random
from collections import defaultdict

from themeweave.llm.distinct import own_mass, parsimonious_scores, term_counts
from themeweave.llm.topn import top_n_per_group


def test_top_n_against_sorting(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        g = 0 if rng.random() < 0.4 else rng.randrange(40)
        s = rng.choice([None, float("nan"), -0.0, 0.0, *[round(rng.random(), 1) for _ in range(8)]])
        rows.append((None if i % 97 == 0 else g, i, s, f"t{i}"))
    rows += rng.sample(rows, 300)
    df = spark.createDataFrame(rows, "g int, id bigint, s double, place string")
    got = {(r.g, r.place): (r.id, r.s) for r in top_n_per_group(df, "g", "s", "id", 5).collect()}
    groups = defaultdict(set)
    for g, i, s, _ in rows:
        if g is not None and s is not None and not math.isnan(s):
            groups[g].add((-s, i))
    want = {(g, k): (i, -s) for g, v in groups.items() for k, (s, i) in enumerate(sorted(v)[:5], 1)}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    kept = top_n_per_group(df, "g", "s", "id", 2, keep=["place"]).columns
    assert kept == ["g", "place", "id", "s", "place"]
    assert top_n_per_group(df.limit(0), "g", "s", "id", 5).count() == 0


def test_parsimonious_model(spark):
    counts = {("r1", "common"): 50, ("r1", "own"): 20, ("r2", "common"): 70, ("r2", "rare"): 1, ("r3", "common"): 30, ("r3", "own"): 1, ("r4", "single"): 3}
    df = spark.createDataFrame([(*k, n) for k, n in counts.items()], "record string, term string, n bigint")
    got = {(r.record, r.term): r for r in parsimonious_scores(df).collect()}
    assert set(got) == set(counts)
    total = sum(counts.values())
    for rec in {k[0] for k in counts}:
        assert abs(sum(r.weight for k, r in got.items() if k[0] == rec) - 1) < 1e-6
    assert got["r1", "own"].weight > 2 * got["r1", "own"].share and got["r1", "common"].weight < got["r1", "common"].share
    assert got["r4", "single"].weight == 1
    for (rec, term), r in got.items():  # the fixed point in closed form
        if r.weight > 1e-3:
            e = {k: got[k].n * 0.3 * got[k].weight / (0.3 * got[k].weight + 0.7 * got[k].background) for k in got if k[0] == rec}
            assert abs(e[rec, term] / sum(e.values()) - r.weight) < 1e-6
        assert abs(r.background - r.term_n / total) < 1e-12
        if r.share >= 3 * r.background:
            assert r.weight >= 0.22 * r.share


def test_counts_leave_out_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, "a", 7, 0), (1, "a", 7, 1), (1, "a", 8, 0), (None, "a", 9, 0), (1, None, 10, 0)], "c int, t string, id int, n int")
    assert [tuple(r) for r in term_counts(df, "c", "t", "id").collect()] == [(1, "a", 2)]
    assert parsimonious_scores(term_counts(df.limit(0), "c", "t", "id")).count() == 0


def test_mass_is_the_limit_of_the_iterations():
    rng = np.random.default_rng(2)
    n, b = rng.integers(1, 50, 40).astype(float), rng.dirichlet(np.full(60, 0.3))[:40] + 1e-6
    weight = n / n.sum()
    for _ in range(200_000):
        part = n * 0.3 * weight / (0.3 * weight + 0.7 * b)
        weight = part / part.sum()
    assert abs(own_mass(n, b, 0.3) - part.sum()) < 1e-6 * part.sum()


def test_a_record_with_a_huge_vocabulary_runs_over_classes(spark):
    """Weights from classes of ratios are those of the single terms."""
    rng = np.random.default_rng(3)
    rows = [("hot", f"t{i}", int(c)) for i, c in enumerate(rng.zipf(1.6, 5_000).clip(1, 1_000))] + [("small", f"t{i}", 1) for i in range(0, 5_000, 7)]
    got = {r.term: r for r in parsimonious_scores(spark.createDataFrame(rows, "record string, term string, n long")).filter("record = 'hot'").collect()}
    terms = sorted(got)
    mass = own_mass(np.array([got[t].n for t in terms], float), np.array([got[t].background for t in terms]), 0.3)
    assert all(abs(r.weight - max(0.0, r.n / mass - 0.7 / 0.3 * r.background)) < 1e-6 for r in got.values())
    assert abs(sum(r.weight for r in got.values()) - 1) < 1e-4
