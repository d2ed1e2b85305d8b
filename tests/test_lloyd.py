"""k-means: bounded steps against plain ones, runs that share their passes, odd inputs."""

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pytest

from themeweave.operators import lloyd as L, robustness as R, vectors as V


def _unit(x):
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _bundles(n, dim, seed):
    rng = np.random.default_rng(seed)
    return _unit(rng.normal(size=(12, dim))[rng.integers(0, 12, n)] + rng.normal(0, 0.6, (n, dim)))


def test_bounded_steps_equal_plain_ones(tmp_path, monkeypatch):
    x = np.vstack([_bundles(3_000, 8, 1), np.zeros((2, 8), np.float32)])
    batches = [pa.RecordBatch.from_arrays([pa.array([p[i : i + 16].tobytes() for i in range(0, len(p), 16)], pa.binary())], names=["x"]) for p in np.array_split(x, 4)]
    monkeypatch.setattr(L, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())}))
    ks = [5, 1, 9]
    centres = [x[:k].astype(float) for k in ks]
    moved = [np.zeros(k) for k in ks]
    kept = 0
    for step in range(25):
        folder = tmp_path / ("a" if step < 12 else "b")  # from step 12 on nothing is known of the steps before
        shared = type("B", (), {"value": (str(folder), step, ks, {r: (centres[r].astype(np.float32), moved[r]) for r in range(3)})})
        (out,) = L._step(iter(batches), 8, shared)
        kept += (folder / f"0-{step}").exists()
        for r, raw in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
            got = np.frombuffer(raw, np.float32).reshape(ks[r], 9).astype(float)
            label = L._nearness(x, centres[r].astype(np.float32)).argmax(1)
            want = np.array([np.r_[x[label == k].sum(0, dtype=float), (label == k).sum()] for k in range(ks[r])])
            assert np.array_equal(got[:, -1], want[:, -1]) and np.allclose(got, want, atol=1e-4)
            new = np.where(got[:, -1:] > 0, got[:, :-1] / np.maximum(got[:, -1:], 1), centres[r])
            moved[r] = np.linalg.norm(new.astype(np.float32).astype(float) - centres[r].astype(np.float32), axis=1)
            centres[r] = new
    assert kept == 25 and len(list(tmp_path.rglob("0-*"))) == 2


def test_all_runs_of_a_sweep_share_each_pass(spark, monkeypatch):
    x = _bundles(2_000, 8, 2)
    df = spark.createDataFrame([(i, f"t{i % 3}", v.tolist()) for i, v in enumerate(x)], "phrase_id int, technology_meta string, embedding array<float>")
    plain, steps = L._sent, []

    @contextmanager
    def sent(spark, value):
        if isinstance(value, tuple):
            steps.append(set(value[3]))
        with plain(spark, value) as shared:
            yield shared

    monkeypatch.setattr(L, "_sent", sent)
    assert [(r.k, r.n_clusters) for r in R.k_sweep(df, "concern", (8, 12), starts=4).orderBy("k").collect()] == [(8, 8), (12, 12)]
    assert steps[0] == set(range(8)) and all(b <= a for a, b in zip(steps, steps[1:]))
    monkeypatch.undo()
    assigned, cents = V.kmeans(df, "phrase_id", "embedding", 12, starts=4)
    label = {r.phrase_id: r.cluster_id for r in assigned.collect()}
    assert len(label) == 2_000
    # the centres rest: each is the mean of the vectors nearest to it, and they are as good as plain steps from twelve of the bundles
    mean = np.array([x[[i for i in label if label[i] == k]].mean(0, dtype=float) for k in range(12)])
    c = {r.cluster_id: np.array(r.centroid) for r in cents.collect()}
    assert np.allclose(_unit(mean), np.array([c[k] for k in range(12)]), atol=1e-2)
    assert np.mean([(((x[i] - mean) ** 2).sum(1)).argmin() == k for i, k in label.items()]) > 0.99
    other = x[np.random.default_rng(3).permutation(2_000)[:12]].astype(float)
    for _ in range(100):
        own = (x @ other.T - 0.5 * (other**2).sum(1)).argmax(1)
        other = np.array([x[own == k].mean(0, dtype=float) if (own == k).any() else other[k] for k in range(12)])
    cost = lambda m: ((x[:, None] - m[None]) ** 2).sum(2).min(1).sum()
    assert cost(mean) <= 1.02 * cost(other)


def test_odd_vectors(spark):
    same = spark.createDataFrame([(f"a{i}", [1.0, float(i % 2)]) for i in range(20)] + [("n", None), ("z", [0.0, 0.0])], "id string, v array<double>")
    assigned, cents = V.kmeans(same, "id", "v", 5, starts=2)  # three distinct vectors
    rows = {r.id: r.cluster_id for r in assigned.collect()}
    assert len(rows) == 21 and "n" not in rows and len(set(rows.values())) == 3 and cents.count() == 3
    assert len({rows[f"a{i}"] for i in range(0, 20, 2)}) == 1
    with pytest.raises(Exception, match="different lengths"):
        V.kmeans(spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "id string, v array<double>"), "id", "v", 1)
    with pytest.raises(ValueError, match="fewer than"):
        V.kmeans(same.filter("id = 'none'"), "id", "v", 1)


def test_vectors_apart_from_the_phrases(spark):
    """A phrase without a vector is in no cluster, and the lens table doesn't depend on where the vectors are."""
    x = _bundles(400, 6, 4)
    phrases = spark.createDataFrame([(i, i % 7, f"t{i % 3}", 2000 + i % 2) for i in range(410)], "phrase_id int, cluster_id int, technology_meta string, year int")
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "phrase_id int, embedding array<float>")
    base = spark.createDataFrame([(k, x[k].tolist()) for k in range(7)], "cluster_id int, centroid array<float>")
    bridge = spark.createDataFrame([(k, f"l{k % 2}") for k in range(7)], "cluster_id int, lens string")
    options = {"target": "t0", "base_centroids": base, "bridge": bridge}
    apart = R.run_sensitivity(phrases, "concern", 5, vectors=vectors, **options)
    joined = R.run_sensitivity(phrases.join(vectors, "phrase_id"), "concern", 5, **options)
    assert apart["assignments"].count() == 400
    for name in ("lens_salience", "stable_core"):
        assert sorted(map(str, apart[name].collect())) == sorted(map(str, joined[name].collect()))
