"""Vector operators: normalising, centroids, memberships, exemplars, k-means and small-matrix analyses."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from themeweave.functions.text import c
from themeweave.operators.lloyd import best_of
from themeweave.session import broadcast_if_small

#: Centroids, labels and similar tables up to this size are broadcast.
SMALL_ROWS = 10_000
#: Largest matrix (rows) that small-matrix analyses bring to the driver.
MATRIX_ROWS = 2_000


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(c(a), c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v) -> Column:
    """Unit vector as doubles; a zero vector stays zero, null stays null."""
    # bound as a lambda variable, the norm is computed once a row and not once an element
    one = F.array(F.struct(c(v).alias("v"), norm(v).alias("n")))
    return F.transform(one, lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x.cast("double") / s["n"]).otherwise(0.0)))[0]


def cosine(a, b) -> Column:
    """Cosine of two vectors; null if either is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def usable(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """Rows whose vector has ``dim`` finite numbers, not all zero."""
    top = F.array_max(F.transform(c(vector), F.abs))
    return df.filter(c(vector).isNotNull() & (F.size(vector) == dim)).filter(~F.exists(c(vector), lambda x: x.isNull()) & (top > 0) & ~F.isnan(top) & (top < float("inf")))


def centroids(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """(cluster, n, centroid): renormalised mean of each cluster's normalised vectors.

    Sums are formed per position before the shuffle, so a cluster's size doesn't matter.
    """
    x = df.filter(c(cluster).isNotNull() & c(vector).isNotNull()).select(cluster, F.posexplode(l2_normalize(vector)).alias("pos", "v"))
    m = x.groupBy(cluster, "pos").agg(F.avg("v").alias("m"), F.count("*").alias("n"))
    g = m.groupBy(cluster).agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("_m"))  # one entry a dimension
    return g.select(cluster, "n", l2_normalize("_m").alias("centroid"))


def _units(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def _centroid_matrix(cents: DataFrame, cluster: str, centroid: str) -> tuple[list, np.ndarray]:
    """Ids in order and unit rows of a centroid table of at most SMALL_ROWS rows."""
    rows = sorted(cents.select(cluster, centroid).limit(SMALL_ROWS + 1).collect(), key=lambda r: r[0])
    if len(rows) > SMALL_ROWS:
        raise ValueError(f"more than {SMALL_ROWS} centroids; compare them in blocks")
    return [r[0] for r in rows], _units(np.array([r[1] for r in rows], float)) if rows else np.zeros((0, 0))


def _against(df: DataFrame, ident: str, vector: str, ids: list, m: np.ndarray, out: str, pick) -> DataFrame:
    """One matrix product per Arrow batch of vectors; ``pick`` turns similarities into (rows, columns)."""

    def run(batches):
        for b in batches:
            v = b.column(1)
            rows = np.flatnonzero(np.array(v.is_valid()) & (np.array(v.value_lengths().fill_null(0)) == m.shape[1])) if m.size else np.zeros(0, int)
            for lo in range(0, len(rows), 2048):
                part = v.take(pa.array(rows[lo : lo + 2048]))
                sims = _units(part.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, m.shape[1])) @ m.T
                r, k = pick(sims)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[lo : lo + 2048][r])), pa.array([ids[j] for j in k], pa.int32()), pa.array(sims[r, k])], names=["ident", "cluster", "similarity"])

    kind = dict(df.dtypes)[ident]
    return df.select(ident, vector).mapInArrow(run, f"ident {kind}, cluster int, similarity double").withColumnsRenamed({"ident": ident, "cluster": out})


def soft_membership(df: DataFrame, ident: str, vector: str, cents: DataFrame, cluster: str, centroid: str, threshold: float | None = None) -> DataFrame:
    """(ident, cluster, similarity) of every vector with every centroid, at ``threshold`` or more if one is given."""
    ids, m = _centroid_matrix(cents, cluster, centroid)
    low = -2.0 if threshold is None else threshold
    return _against(df, ident, vector, ids, m, cluster, lambda s: np.nonzero(s >= low))


def assign_nearest(df: DataFrame, ident: str, vector: str, cents: DataFrame, cluster: str, centroid: str) -> DataFrame:
    """(ident, cluster, similarity) of each vector's nearest centroid; ties to the smaller id. No shuffle."""
    ids, m = _centroid_matrix(cents, cluster, centroid)
    return _against(df, ident, vector, ids, m, cluster, lambda s: (np.arange(len(s)), np.round(s, 12).argmax(1)))


def map_centroids(a: DataFrame, b: DataFrame, cluster: str, centroid: str) -> DataFrame:
    """(cluster, base_cluster, similarity): the nearest centroid of ``b`` for each of ``a``."""
    x = a.select(F.col(cluster).alias("_ident"), F.col(centroid).alias("_v"))
    y = b.select(F.col(cluster).alias("base_cluster"), F.col(centroid).alias("_w"))
    return assign_nearest(x, "_ident", "_v", y, "base_cluster", "_w").withColumnRenamed("_ident", cluster)


def exemplars(df: DataFrame, ident: str, vector: str, cluster: str, cents: DataFrame, centroid: str, n: int = 8) -> DataFrame:
    """(cluster, place, ident, similarity): the ``n`` members nearest to their own centroid; ties by identifier."""
    m = broadcast_if_small(cents.select(F.col(cluster), F.col(centroid).alias("_c")), SMALL_ROWS)
    x = df.join(m, cluster).withColumn("similarity", F.round(cosine(vector, "_c"), 9)).filter(F.col("similarity").isNotNull())
    w = Window.partitionBy(cluster).orderBy(F.desc("similarity"), ident)
    return x.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select(cluster, "place", ident, "similarity")


def similarity_stats(df: DataFrame, by: str, similarity: str, digits: int = 4) -> DataFrame:
    """(by, n, mean, median) of similarities; the median is taken of values rounded to ``digits`` places, whose number is bounded."""
    x = df.filter(c(by).isNotNull() & c(similarity).isNotNull())
    return x.groupBy(by).agg(F.count("*").alias("n"), F.avg(similarity).alias("mean"), F.percentile(F.round(similarity, digits), F.lit(0.5)).alias("median"))


def kmeans(df: DataFrame, ident: str, vector: str, k: int, *, seed: int = 42, starts: int = 10, max_iter: int = 300) -> tuple[DataFrame, DataFrame]:
    """(assignments (ident, cluster_id), centroids (cluster_id, centroid)) of the best of ``starts`` runs on normalised vectors."""
    assigned, centres = best_of(df, ident, vector, [k], seed=seed, starts=starts, max_iter=max_iter)[k]
    rows = [(i, (v / max(np.linalg.norm(v), 1e-12)).tolist()) for i, v in enumerate(centres)]
    return assigned, df.sparkSession.createDataFrame(rows, "cluster_id int, centroid array<double>")


# --- analyses of small matrices (years, clusters): bounded by MATRIX_ROWS -------------------


def _matrix(long: DataFrame, row: str, column: str, value: str) -> pd.DataFrame:
    rows = long.select(row).distinct().limit(MATRIX_ROWS + 1).count()
    if rows > MATRIX_ROWS:
        raise ValueError(f"more than {MATRIX_ROWS} rows; this analysis is for small matrices")
    return long.select(row, column, value).toPandas().pivot(index=row, columns=column, values=value).sort_index().sort_index(axis=1)


def pca_2d(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two principal coordinates of each row and the explained shares; missing components are 0, signs are fixed."""
    x = m - m.mean(0)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    points = np.zeros((len(m), 2))
    share = np.zeros(2)
    for k in range(min(2, len(s))):
        sign = -1.0 if vt[k][np.abs(vt[k]).argmax()] < 0 else 1.0
        points[:, k] = u[:, k] * s[k] * sign
        share[k] = s[k] ** 2 / (s**2).sum() if (s**2).sum() > 0 else 0.0
    return points, share


def pca_trajectory(means: DataFrame) -> DataFrame:
    """(year, pc1, pc2, displacement_1, displacement_2, from_first, from_mean) from yearly mean vectors (year, pos, mean).

    One year gives pc2 = 0; no year gives no row.
    """
    spark = means.sparkSession
    schema = "year int, pc1 double, pc2 double, displacement_1 double, displacement_2 double, from_first double, from_mean double"
    m = _matrix(means, "year", "pos", "mean")
    if m.empty:
        return spark.createDataFrame([], schema)
    p, _ = pca_2d(m.to_numpy(float))
    d, centre = p - p[0], p - p.mean(0)
    rows = [(int(y), *map(float, p[i]), *map(float, d[i]), float(np.hypot(*d[i])), float(np.hypot(*centre[i]))) for i, y in enumerate(m.index)]
    return spark.createDataFrame(rows, schema)


def concern_space(sal: DataFrame, cluster: str, tech: str) -> DataFrame:
    """(cluster, pc1, pc2, explained_1, explained_2): principal plane of clusters by their z-scored shares over technologies."""
    m = _matrix(sal, cluster, tech, "share").fillna(0.0)
    z = (m - m.mean()) / (m.std(ddof=0) + 1e-9)
    p, share = pca_2d(z.to_numpy(float))
    rows = [(int(k), float(a), float(b), float(share[0]), float(share[1])) for k, (a, b) in zip(m.index, p)]
    return sal.sparkSession.createDataFrame(rows, f"{cluster} int, pc1 double, pc2 double, explained_1 double, explained_2 double")


def weighted_path(matrix: DataFrame, space: DataFrame, cluster: str, share: str, year: str = "year") -> DataFrame:
    """(year, pc1, pc2): the clusters' plane averaged by their share of each year."""
    x = matrix.join(space, cluster).groupBy(year)
    total = F.sum(share)
    return x.agg(F.try_divide(F.sum(F.col(share) * F.col("pc1")), total).alias("pc1"), F.try_divide(F.sum(F.col(share) * F.col("pc2")), total).alias("pc2"))


def average_linkage(vectors: np.ndarray, groups: int) -> np.ndarray:
    """Group (from 1) of each row after merging by average cosine distance down to ``groups``."""
    u = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    size, alive = np.ones(len(u)), list(range(len(u)))
    member = np.arange(len(u))
    while len(alive) > max(groups, 1):
        sub = d[np.ix_(alive, alive)]
        i, j = (alive[k] for k in divmod(int(sub.argmin()), len(alive)))
        i, j = min(i, j), max(i, j)
        d[i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[:, i] = d[i]
        d[i, i] = np.inf
        size[i] += size[j]
        member[member == j] = i
        alive.remove(j)
    return np.unique(member, return_inverse=True)[1] + 1


def hierarchical_groups(cents: DataFrame, cluster: str, centroid: str, groups: int) -> DataFrame:
    """(cluster, branch): centroids cut into ``groups`` branches of an average-linkage tree."""
    rows = cents.select(cluster, centroid).orderBy(cluster).limit(MATRIX_ROWS + 1).collect()
    if len(rows) > MATRIX_ROWS:
        raise ValueError(f"more than {MATRIX_ROWS} centroids")
    branch = average_linkage(np.array([r[1] for r in rows], float), groups) if rows else []
    return cents.sparkSession.createDataFrame([(r[0], int(b)) for r, b in zip(rows, branch)], f"{cluster} int, branch int")
