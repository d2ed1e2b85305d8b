"""Vector operators and cluster-count sensitivity over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from themeweave.operators import metrics as M, robustness as R, shares as S, temporal as Y, vectors as V
from themeweave.plans.inputs import BR, K, TARGET, bridge, chunks, ph, phrases, r6, vectors
from themeweave.plans.theme_queries import C, T, _VAR, rounded, variants
from themeweave.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DIM = 96


def q(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


_V = """vec AS (SELECT DISTINCT phrase_id, embedding::DOUBLE[] AS e FROM phrase_vectors WHERE track = 'concern' AND embedding IS NOT NULL AND len(embedding) = 96
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0)"""
_U = _V + ", u AS (SELECT phrase_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM vec)"
_CENT = "cen AS (SELECT cluster_id, list_transform(centroid, lambda x: x / sqrt(list_dot_product(centroid, centroid))) AS c FROM centroids WHERE track = 'concern')"


def _cents(s, d):
    return table(s, d, "centroids").filter("track = 'concern'").select(C, "centroid")


def _members(s, d):
    return vectors(s, d).join(phrases(s, d).select("phrase_id", C, T, "year"), "phrase_id")


def _own_vectors(s, d):
    """Usable vectors of the phrases that occur."""
    return vectors(s, d).join(phrases(s, d).select("phrase_id"), "phrase_id", "left_semi")


@q("l2_normalize", f"WITH {_U} SELECT phrase_id, {r6('e[1]')} AS first, {r6('e[96]')} AS last FROM u")
def _(s, d):
    u = vectors(s, d).withColumn("u", V.l2_normalize("embedding"))
    return rounded(u.select("phrase_id", F.col("u")[0].alias("first"), F.col("u")[95].alias("last")), "first", "last")


@q("centroids", f"""WITH {_U}, {ph()}, x AS (SELECT cluster_id, unnest(e) AS v, generate_subscripts(e, 1) AS pos FROM u JOIN ph USING (phrase_id) WHERE cluster_id IS NOT NULL),
  m AS (SELECT cluster_id, pos, avg(v) AS m, count(*) AS n FROM x GROUP BY ALL), l AS (SELECT cluster_id, sqrt(sum(m * m)) AS l FROM m GROUP BY ALL)
  SELECT cluster_id, n, {r6('max(m / l) FILTER (pos = 1)')} AS first, {r6('max(m / l) FILTER (pos = 96)')} AS last FROM m JOIN l USING (cluster_id) GROUP BY ALL""")
def _(s, d):
    c = V.centroids(_members(s, d), C, "embedding")
    return rounded(c.select(C, "n", F.col("centroid")[0].alias("first"), F.col("centroid")[95].alias("last")), "first", "last")


@q("soft_membership", f"WITH {_U}, {_CENT} SELECT phrase_id, cluster_id, {r6('list_dot_product(e, c)')} AS similarity FROM u, cen WHERE list_dot_product(e, c) >= 0.3")
def _(s, d):
    return rounded(V.soft_membership(vectors(s, d), "phrase_id", "embedding", _cents(s, d), C, "centroid", 0.3), "similarity")


@q("assign_nearest", f"WITH {_U}, {_CENT} SELECT phrase_id, cluster_id, {r6('list_dot_product(e, c)')} AS similarity FROM u, cen QUALIFY row_number() OVER (PARTITION BY phrase_id ORDER BY round(list_dot_product(e, c), 12) DESC, cluster_id) = 1")
def _(s, d):
    return rounded(V.assign_nearest(vectors(s, d), "phrase_id", "embedding", _cents(s, d), C, "centroid"), "similarity")


@q("exemplars", f"WITH {_U}, {_CENT}, {ph()}, x AS (SELECT cluster_id, phrase_id, round(list_dot_product(e, c), 9) AS similarity FROM u JOIN ph USING (phrase_id) JOIN cen USING (cluster_id)) SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY similarity DESC, phrase_id) AS place, phrase_id, {r6('similarity')} AS similarity FROM x QUALIFY place <= 8")
def _(s, d):
    return rounded(V.exemplars(_members(s, d), "phrase_id", "embedding", C, _cents(s, d), "centroid"), "similarity")


def _half(s, d):
    """Centroids of a coarser clustering: those of pairs of themes."""
    x = _members(s, d).filter("cluster_id IS NOT NULL").withColumn("half", F.floor(F.col(C) / 2).cast("int"))
    return V.centroids(x, "half", "embedding").withColumnRenamed("half", C)


_HALF = f"""{ph()}, hx AS (SELECT CAST(floor(cluster_id / 2) AS INTEGER) AS h, unnest(e) AS v, generate_subscripts(e, 1) AS pos FROM u JOIN ph USING (phrase_id) WHERE cluster_id IS NOT NULL),
  hm AS (SELECT h, pos, avg(v) AS m FROM hx GROUP BY ALL), hc AS (SELECT h, list(m ORDER BY pos) AS m FROM hm GROUP BY ALL), hn AS (SELECT h, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS m FROM hc)"""


@q("map_centroids", f"WITH {_U}, {_CENT}, {_HALF} SELECT h AS cluster_id, cluster_id AS base_cluster, {r6('list_dot_product(m, c)')} AS similarity FROM hn, cen QUALIFY row_number() OVER (PARTITION BY h ORDER BY round(list_dot_product(m, c), 12) DESC, cluster_id) = 1")
def _(s, d):
    return rounded(V.map_centroids(_half(s, d), _cents(s, d), C, "centroid"), "similarity")


def _runs(s, d):
    p = phrases(s, d).filter(f"{C} IS NOT NULL")
    return p.withColumn("k", F.lit(75)).unionByName(p.withColumn("k", F.lit(38)).withColumn(C, F.floor(F.col(C) / 2).cast("int")))


def _mapping(s, d):
    return V.map_centroids(_half(s, d), _cents(s, d), C, "centroid").withColumn("k", F.lit(38)).unionByName(V.map_centroids(_cents(s, d), _cents(s, d), C, "centroid").withColumn("k", F.lit(75)))


_RUNS = f"""{BR}, runs AS (SELECT 75 AS k, cluster_id, technology_meta FROM ph WHERE cluster_id IS NOT NULL UNION ALL SELECT 38, CAST(floor(cluster_id / 2) AS INTEGER), technology_meta FROM ph WHERE cluster_id IS NOT NULL),
  mp AS (SELECT 38 AS k, h AS cluster_id, cluster_id AS base FROM hn, cen QUALIFY row_number() OVER (PARTITION BY h ORDER BY round(list_dot_product(m, c), 12) DESC, cluster_id) = 1 UNION ALL SELECT 75, cluster_id, cluster_id FROM cen),
  rl AS (SELECT runs.k, lens, technology_meta FROM runs JOIN mp ON runs.k = mp.k AND runs.cluster_id = mp.cluster_id JOIN br ON br.cluster_id = mp.base)"""


@q("sensitivity_lens_prevalence", f"WITH {_U}, {_CENT}, {_HALF}, {_RUNS} SELECT k, lens, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY k), 6) AS share FROM rl GROUP BY k, lens")
def _(s, d):
    return rounded(R.sensitivity_lens_prevalence(_runs(s, d), _mapping(s, d), bridge(phrases(s, d)), C), "share")


@q("sensitivity_lens_by_tech", f"WITH {_U}, {_CENT}, {_HALF}, {_RUNS}, tn AS (SELECT k, technology_meta, count(*) AS tech_n FROM runs WHERE technology_meta IS NOT NULL GROUP BY ALL) SELECT k, technology_meta, lens, count(*) AS n, tech_n, round(count(*) / max(tech_n), 6) AS share FROM rl JOIN tn USING (k, technology_meta) GROUP BY k, technology_meta, lens, tech_n")
def _(s, d):
    return rounded(R.sensitivity_lens_by_tech(_runs(s, d), _mapping(s, d), bridge(phrases(s, d)), C, T), "share")


@q("sensitivity_pivot", f"""WITH {_U}, {_CENT}, {_HALF}, {_RUNS}, x AS (SELECT k, lens, count(*) / sum(count(*)) OVER (PARTITION BY k) AS share FROM rl GROUP BY k, lens)
  SELECT lens, coalesce(round(max(share) FILTER (k = 38), 6), 0) AS k38, coalesce(round(max(share) FILTER (k = 75), 6), 0) AS k75 FROM x GROUP BY ALL""")
def _(s, d):
    x = R.sensitivity_lens_prevalence(_runs(s, d), _mapping(s, d), bridge(phrases(s, d)), C)
    return rounded(R.pivot_runs(x, (38, 75)).withColumnsRenamed({"38": "k38", "75": "k75"}), "k38", "k75")


@q("similarity_stats", f"WITH {_U}, {_CENT}, {ph()}, x AS (SELECT technology_meta, list_dot_product(e, c) AS s FROM u JOIN ph USING (phrase_id) JOIN cen USING (cluster_id)) SELECT technology_meta, count(*) AS n, round(avg(s), 6) AS mean, round(quantile_cont(round(s, 4), 0.5), 6) AS median FROM x WHERE technology_meta IS NOT NULL GROUP BY ALL")
def _(s, d):
    x = _members(s, d).join(_cents(s, d), C).filter(f"{T} IS NOT NULL").withColumn("s", V.cosine("embedding", "centroid"))
    return rounded(V.similarity_stats(x, T, "s"), "mean", "median")


@q("yearly_mean_vectors", f"WITH {_V}, {ph()}, x AS (SELECT year, unnest(e) AS v, generate_subscripts(e, 1) - 1 AS pos FROM vec JOIN ph USING (phrase_id) WHERE technology_meta = '{TARGET}' AND year IS NOT NULL) SELECT year, CAST(pos AS INTEGER) AS pos, {r6('avg(v)')} AS mean FROM x GROUP BY ALL")
def _(s, d):
    return rounded(Y.trajectory_points(_members(s, d).filter(F.col(T) == TARGET), "embedding", DIM), "mean")


@q("pca_trajectory")
def _(s, d):
    return V.pca_trajectory(Y.trajectory_points(_members(s, d).filter(F.col(T) == TARGET), "embedding", DIM))


@q("concern_space")
def _(s, d):
    return V.concern_space(S.salience(phrases(s, d), T, C), C, T)


@q("weighted_centroid_path")
def _(s, d):
    p = phrases(s, d)
    m = Y.row_relative(Y.year_counts(p.filter(F.col(T) == TARGET), C), "n")
    return V.weighted_path(m, V.concern_space(S.salience(p, T, C), C, T), C, "relative")


@q("hierarchical_clustering")
def _(s, d):
    return V.hierarchical_groups(_cents(s, d), C, "centroid", 8)


@q("lens_vs_tree_ari")
def _(s, d):
    p = phrases(s, d)
    primary = bridge(p).groupBy(C).agg(F.max(F.struct("lens_order", "lens"))["lens"].alias("lens"))
    return S.adjusted_rand(V.hierarchical_groups(_cents(s, d), C, "centroid", 8).join(primary, C), "lens", "branch")


@q("kmeans")
def _(s, d):
    return V.kmeans(vectors(s, d), "phrase_id", "embedding", K)[0]


@q("run_sensitivity")
def _(s, d):
    out = R.run_sensitivity(phrases(s, d), "concern", K, target=TARGET, base_centroids=_cents(s, d), bridge=bridge(phrases(s, d)), vectors=_own_vectors(s, d))
    return out["lens_salience"]


@q("k_sweep")
def _(s, d):
    return R.k_sweep(phrases(s, d), "concern", vectors=_own_vectors(s, d), starts=10)


@q("prompt_agreement", f"""WITH {_VAR}, {_CENT}, v AS (SELECT variant, chunk_id, phrase_idx, c FROM ph JOIN cen USING (cluster_id)), al AS (SELECT chunk_id FROM ch),
  ab AS (SELECT * FROM (VALUES ('A', 'B'), ('A', 'C'), ('B', 'C')) x(va, vb)), n AS (SELECT variant, chunk_id, count(*) AS n FROM v GROUP BY ALL),
  m AS (SELECT va, vb, x.chunk_id, x.phrase_idx AS pa, y.phrase_idx AS pb, list_dot_product(x.c, y.c) AS s FROM ab JOIN v x ON x.variant = va JOIN v y ON y.variant = vb AND y.chunk_id = x.chunk_id),
  ha AS (SELECT va, vb, chunk_id, count(*) FILTER (s >= 0.85) AS h FROM (SELECT va, vb, chunk_id, pa, max(s) AS s FROM m GROUP BY ALL) GROUP BY ALL), hb AS (SELECT va, vb, chunk_id, count(*) FILTER (s >= 0.85) AS h FROM (SELECT va, vb, chunk_id, pb, max(s) AS s FROM m GROUP BY ALL) GROUP BY ALL),
  y AS (SELECT ab.va, ab.vb, al.chunk_id, coalesce(p.n, 0) AS na, coalesce(q.n, 0) AS nb, ha.h AS ha, hb.h AS hb FROM ab CROSS JOIN al LEFT JOIN n p ON p.variant = ab.va AND p.chunk_id = al.chunk_id LEFT JOIN n q ON q.variant = ab.vb AND q.chunk_id = al.chunk_id
        LEFT JOIN ha ON ha.va = ab.va AND ha.vb = ab.vb AND ha.chunk_id = al.chunk_id LEFT JOIN hb ON hb.va = ab.va AND hb.vb = ab.vb AND hb.chunk_id = al.chunk_id)
  SELECT va AS variant_a, vb AS variant_b, count(*) AS n_chunks, round(avg(CAST((na > 0) = (nb > 0) AS INTEGER)), 6) AS yield_agreement, count(*) FILTER (na > 0 AND nb > 0) AS n_both, round(avg((ha + hb) / (na + nb)) FILTER (na > 0 AND nb > 0), 6) AS phrase_agreement FROM y GROUP BY ALL""")
def _(s, d):
    """Variants of the replies with each phrase's vector replaced by its cluster's theme centroid."""
    cents = _cents(s, d)
    v = variants(s, d).join(cents, C).withColumn("phrase_id", F.concat_ws(":", "variant", "chunk_id", F.col("phrase_idx").cast("string"), F.md5("phrase")))
    ch = chunks(s, d).select("chunk_id", F.explode(F.array(*map(F.lit, "ABC"))).alias("variant"))
    return rounded(S.prompt_agreement(v, ch, "centroid"), "yield_agreement", "phrase_agreement")


@q("volume_by_cluster_and_lens", f"WITH {ph('benefit')}, {BR} SELECT lens, year, count(*) AS n FROM ph JOIN br USING (cluster_id) WHERE year IS NOT NULL GROUP BY ALL")
def _(s, d):
    p = phrases(s, d, "benefit")
    return S.lens_counts(p, C, bridge(p), "year")


@q("cluster_tech_dist", f"WITH {ph()} SELECT cluster_id, technology_meta, count(*) AS n FROM ph WHERE cluster_id IS NOT NULL AND technology_meta IS NOT NULL GROUP BY ALL")
def _(s, d):
    return M.counts(phrases(s, d), C, T)
