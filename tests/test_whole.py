"""Queries that must cover all of their table, against plain counts."""

import duckdb

from themeweave.plans.registry import QUERIES


def test_every_benefit_cluster_is_profiled(spark, sf):
    rows = QUERIES["cluster_profile_benefit"](spark, sf).collect()
    ph = f"(SELECT DISTINCT benefit_id, cluster_id, technology_meta FROM '{sf}/benefits.parquet')"
    want = {c: (n, k) for c, n, k in duckdb.sql(f"SELECT cluster_id, count(*), count(DISTINCT technology_meta) FROM {ph} WHERE cluster_id IS NOT NULL GROUP BY ALL").fetchall()}
    got = {r.cluster_id: (r["size"], r.n_technologies) for r in rows}
    assert len(got) == len(rows) and max(want) >= 75
    assert got == {c: (0, 0) for c in range(75)} | want


def test_kmeans_and_sweep_use_the_reference_counts(spark, sf):
    assert QUERIES["kmeans"](spark, sf).select("cluster_id").distinct().count() == 75
    assert [r.k for r in QUERIES["k_sweep"](spark, sf).orderBy("k").collect()] == [60, 75, 90]
