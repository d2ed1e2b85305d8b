"""How stable the answers are under other cluster counts, thresholds and size quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from themeweave.functions.stats import div, plogp, support_norm
from themeweave.operators.lloyd import best_of
from themeweave.operators.metrics import check_track, counts, cross_cutting_summary, cluster_profile, group_distribution
from themeweave.operators.shares import extremes, fingerprint, lens_salience, salience
from themeweave.operators.temporal import diversity_by
from themeweave.operators.vectors import kmeans, map_centroids


def stable_core_robustness(sal: DataFrame, tech: str, cluster: str, target: str, thresholds: Sequence[float] = (0.4, 0.5, 0.6), quantiles: Sequence[float] = (0.70, 0.75, 0.80), ends: int = 5) -> DataFrame:
    """One row per (entropy threshold, size quantile): cross-cutting clusters and share, core size, size bound, and the most over- and under-indexed clusters.

    Sizes and entropies are taken over the clusters' shares, as the grid (tech, cluster, share) holds them.
    """
    if sal.filter(F.col(tech) == target).limit(1).count() == 0:
        raise ValueError(f"no technology {target!r}")
    by = Window.partitionBy(cluster)
    x = sal.withColumn("s", F.sum("share").over(by)).withColumn("q", div(F.col("share"), F.col("s")))
    c = x.groupBy(cluster).agg(F.max("s").alias("size"), F.sum(plogp(F.col("q"))).alias("h"), F.count_if(F.col("q") > 0).alias("k")).withColumn("e", support_norm(F.col("h"), F.col("k")))
    grid = [(float(t), float(q)) for t in thresholds for q in quantiles]
    bounds = c.agg(*[F.percentile("size", F.lit(q)).alias(f"b{i}") for i, q in enumerate(quantiles)])
    y = c.crossJoin(F.broadcast(bounds))  # one row
    parts = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(q).alias("quantile"), F.col(f"b{quantiles.index(q)}").alias("size_bound")) for t, q in grid]))
    y = y.select(cluster, "size", "e", parts.alias("g")).select(cluster, "size", "e", "g.*")
    cut = y.groupBy("threshold", "quantile").agg(F.count("*").alias("n_clusters"), F.count_if(F.col("e") >= F.col("threshold")).alias("n_cross_cutting"), F.count_if((F.col("e") >= F.col("threshold")) & (F.col("size") >= F.col("size_bound"))).alias("n_core"), F.max("size_bound").alias("size_bound"))
    fp = fingerprint(sal, tech, cluster, target).withColumn("value", F.round("value", 9))
    z = y.filter(F.col("e") >= F.col("threshold")).join(fp, cluster)
    g = Window.partitionBy("threshold", "quantile")
    z = z.withColumn("up", F.row_number().over(g.orderBy(F.desc("value"), cluster))).withColumn("down", F.row_number().over(g.orderBy(F.asc("value"), cluster)))
    names = lambda place, keep: F.concat_ws("; ", F.transform(F.sort_array(F.collect_list(F.when(F.col(keep) <= ends, F.struct(F.col(place).alias("o"), F.col(cluster).cast("string").alias("c"))))), lambda s: s["c"]))
    tops = z.groupBy("threshold", "quantile").agg(names("up", "up").alias("over"), names("up", "down").alias("under"))
    out = cut.join(tops, ["threshold", "quantile"], "left").fillna("", ["over", "under"])
    return out.withColumn("pct_cross_cutting", 100 * div(F.col("n_cross_cutting"), F.col("n_clusters"))).drop("n_clusters")


def sensitivity_lens_prevalence(runs: DataFrame, mapping: DataFrame, bridge: DataFrame, cluster: str, run: str = "k") -> DataFrame:
    """(run, lens, share): each lens's share of all lens phrases of a run, through the base clusters its clusters map to (run, cluster, base_cluster)."""
    n = counts(runs, run, cluster).join(mapping.select(run, cluster, "base_cluster"), [run, cluster])
    x = n.join(bridge.select(F.col(cluster).alias("base_cluster"), "lens").distinct(), "base_cluster").groupBy(run, "lens").agg(F.sum("n").alias("n"))
    return x.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(run)))


def sensitivity_lens_by_tech(runs: DataFrame, mapping: DataFrame, bridge: DataFrame, cluster: str, tech: str, run: str = "k") -> DataFrame:
    """(run, tech, lens, share): phrases of the clusters that inherit a lens over all phrases of the technology in the run."""
    total = counts(runs, run, tech).withColumnRenamed("n", "tech_n")
    n = counts(runs, run, tech, cluster).join(mapping.select(run, cluster, "base_cluster"), [run, cluster])
    x = n.join(bridge.select(F.col(cluster).alias("base_cluster"), "lens").distinct(), "base_cluster").groupBy(run, tech, "lens").agg(F.sum("n").alias("n"))
    return x.join(total, [run, tech]).withColumn("share", F.col("n") / F.col("tech_n"))


def pivot_runs(long: DataFrame, runs: Sequence, run: str = "k") -> DataFrame:
    """Lens by run, absent shares 0."""
    names = [str(r) for r in runs]
    return long.withColumn("_r", F.col(run).cast("string")).groupBy("lens").pivot("_r", names).agg(F.max("share")).fillna(0.0, names)


def run_sensitivity(phrases: DataFrame, kind: str, k: int, *, target: str, base_centroids: DataFrame | None = None, bridge: DataFrame | None = None, ident: str = "phrase_id", vector: str = "embedding", tech: str = "technology_meta", year: str = "year", low: int = 5, high: int = 7, seed: int = 42, lens_mapping: str = "nearest", vectors: DataFrame | None = None) -> dict[str, DataFrame]:
    """One run of the track's analyses with ``k`` clusters: core, fingerprint, diversity, lenses and assignments.

    Lenses belong to the base clusters; each new cluster takes those of its nearest base centroid
    (``lens_mapping='raw'`` reads the new ids as base ids). ``vectors`` (ident, vector) holds the phrases' vectors where they are a table of their own.
    """
    check_track(kind)
    if lens_mapping not in ("nearest", "raw"):
        raise ValueError("lens_mapping must be 'nearest' or 'raw'")
    assigned, cents = kmeans(phrases if vectors is None else vectors, ident, vector, k, seed=seed)
    x = phrases.drop("cluster_id", vector).join(assigned, ident)
    dist = group_distribution(x, "cluster_id", tech)
    total = x.agg(F.count("*").alias("_all"))
    core = dist.crossJoin(F.broadcast(total)).select("cluster_id", F.col("total").alias("size"), (F.col("total") / F.col("_all")).alias("prevalence"), F.col("entropy_norm").alias("entropy"))  # one row
    sal = salience(x, tech, "cluster_id")
    out = {"assignments": assigned, "centroids": cents, "stable_core": core, "fingerprint": extremes(fingerprint(sal, tech, "cluster_id", target), "cluster_id", "value", low, high), "diversity": diversity_by(x.filter(F.col(tech) == target), year, "cluster_id")}
    if bridge is not None:
        if lens_mapping == "nearest" and base_centroids is not None:
            m = map_centroids(cents, base_centroids, "cluster_id", "centroid")
            own = m.join(bridge.select(F.col("cluster_id").alias("base_cluster"), "lens").distinct(), "base_cluster").select("cluster_id", "lens")
        else:
            own = bridge.select("cluster_id", "lens")
        out["lens_salience"] = lens_salience(x, tech, "cluster_id", own)
    return out


def k_sweep(phrases: DataFrame, kind: str, ks: Sequence[int] = (60, 75, 90), *, vectors: DataFrame | None = None, **options) -> DataFrame:
    """(k, n_clusters, n_cross_cutting, pct_clusters) of repeated runs; the runs of all ``ks`` share their passes over the vectors."""
    tech, ident = options.get("tech", "technology_meta"), options.get("ident", "phrase_id")
    found = best_of(phrases if vectors is None else vectors, ident, options.get("vector", "embedding"), ks, seed=options.get("seed", 42), starts=options.get("starts", 1))
    base = phrases.select(ident, tech)
    out = None
    for k in ks:
        s = cross_cutting_summary(cluster_profile(base.join(found[k][0], ident), "cluster_id", tech, k)).select(F.lit(k).alias("k"), "n_clusters", "n_cross_cutting", "pct_clusters")
        out = s if out is None else out.unionByName(s)
    return out
