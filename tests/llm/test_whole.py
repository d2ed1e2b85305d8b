"""Queries and operators that must do the whole job, against brute force."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from themeweave.llm.clusters import similarity_clusters
from themeweave.llm.queries import QUERIES


@pytest.fixture(scope="module")
def concerns(sf):
    """(ids, unit vectors) of the usable concern vectors."""
    rows = dict(duckdb.sql(f"SELECT phrase_id, embedding FROM '{sf}/phrase_vectors.parquet' WHERE track = 'concern' AND len(embedding) = 96").fetchall())
    good = {i: v for i, e in rows.items() if np.isfinite(v := np.array([np.nan if x is None else x for x in e], float)).all() and v.any()}
    ids = np.array(sorted(good))
    u = np.array([good[i] for i in ids])
    return ids, u / np.linalg.norm(u, axis=1, keepdims=True)


def test_every_vector_has_its_ten_neighbours(spark, sf, concerns):
    ids, u = concerns
    g = u @ u.T
    np.fill_diagonal(g, -2)
    tenth = np.sort(g, axis=1)[:, -10]
    rows = QUERIES["p3_neighbours"](spark, sf).collect()
    assert len(rows) == 10 * sum(ids % 20 == 0) and all(r.concern_id % 20 == 0 for r in rows) and len({(r.concern_id, r.place) for r in rows}) == len(rows)
    hits = sum(g[np.searchsorted(ids, r.concern_id), np.searchsorted(ids, r.neighbour_id)] >= tenth[np.searchsorted(ids, r.concern_id)] - 1e-6 for r in rows)
    assert hits >= 0.99 * len(rows)


def test_a_track_is_reduced_by_its_own_directions(spark):
    """Densities in one track don't depend on another track being there."""
    rng = np.random.default_rng(4)
    dim, scale = 40, np.r_[np.full(20, 1.0), np.full(20, 0.1)]
    a = np.repeat(rng.standard_normal((30, dim)) * scale, 3, axis=0) + 0.02 * rng.standard_normal((90, dim))
    b = np.repeat(rng.standard_normal((30, dim)) * scale[::-1], 3, axis=0) + 0.02 * rng.standard_normal((90, dim))
    rows = [("concern", i, x.tolist()) for i, x in enumerate(b, 1)]
    more = [("benefit", i, x.tolist()) for i, x in enumerate(a, 1)]
    run = lambda r: {x.ident: x.density for x in similarity_clusters(spark.createDataFrame(r, "track string, id bigint, v array<float>"), "track", "id", "v", dim).collect() if x.track == "concern"}
    alone, beside = run(rows), run(rows + more)
    assert alone.keys() == beside.keys() and len(alone) == 90
    assert np.allclose([alone[k] for k in alone], [beside[k] for k in alone], atol=0.05)


def test_a_set_wider_than_a_tile_stays_whole(spark):
    rng = np.random.default_rng(6)
    dim, sizes = 24, [150, 90, 40, 3]
    centres = rng.standard_normal((len(sizes), dim))
    truth = np.repeat(np.arange(len(sizes)), sizes)
    v = centres[truth] + 0.15 * rng.standard_normal((len(truth), dim))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert ((u @ u.T >= 0.75) == (truth[:, None] == truth)).all()
    df = spark.createDataFrame([("concern", i, x.tolist()) for i, x in enumerate(v)], "track string, id bigint, v array<float>")
    got = {r.ident: r["first"] for r in similarity_clusters(df, "track", "id", "v", dim, node=50, leaf=48, group_rows=100).collect()}
    assert got == {i: int(np.flatnonzero(truth == t)[0]) for i, t in enumerate(truth)}


def test_pairs_of_a_dense_bundle(spark, tmp_path):
    """A third of the vectors in one bundle of different vectors, far more than a tile holds."""
    rng = np.random.default_rng(8)
    n, dim = 30_000, 96
    v = rng.standard_normal((n, dim))
    v[: n // 3] = v[0] + 0.15 * rng.standard_normal((n // 3, dim))
    v = v.astype(np.float32)
    table = pa.table({"track": ["concern"] * n, "phrase_id": pa.array(range(n), pa.int64()), "embedding": pa.array(list(v), pa.list_(pa.float32()))})
    pq.write_table(table, tmp_path / "phrase_vectors.parquet")
    got = {tuple(r) for r in QUERIES["p3_found"](spark, str(tmp_path)).collect()}
    u = v[: n // 3] / np.linalg.norm(v[: n // 3], axis=1, keepdims=True)
    some = rng.permutation(n // 3)[:500]
    g = u[some] @ u.T
    g[np.arange(500), some] = -2
    near = np.argpartition(-g, 10, axis=1)[:, :10]
    want = {(min(int(a), int(b)), max(int(a), int(b))) for a, bs in zip(some, near) for b in bs if u[a] @ u[b] >= 0.955}
    assert len(want & got) >= 0.95 * len(want) > 0
    print("bundle recall", len(want & got) / len(want))
