"""Counts, distributions and profiles of clusters.

``phrases`` is one row per phrase with a cluster, a technology, a year, a document and a chunk column.
Rows whose key is null don't count, as noted per operator.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from themeweave.functions.stats import div, entropy, global_norm, hhi, support_norm
from themeweave.functions.text import c, is_target_label, pretty_label

TRACKS = ("concern", "benefit")


def check_track(kind: str) -> str:
    if kind not in TRACKS:
        raise ValueError(f"kind must be one of {TRACKS}, got {kind!r}")
    return kind


def counts(df: DataFrame, *keys: str) -> DataFrame:
    """Rows per combination of non-null keys, pre-aggregated before the shuffle."""
    x = df
    for k in keys:
        x = x.filter(F.col(k).isNotNull())
    return x.groupBy(*keys).agg(F.count("*").alias("n"))


def group_distribution(df: DataFrame, group: str, category: str, *, basis: str = "support", top_k: int = 10) -> DataFrame:
    """Per group: total, categories, entropy_raw, entropy_norm, hhi, topk_share of its category counts.

    ``basis`` 'global' divides the entropy by the log of all categories in the data, 'support' by the log of the group's own.
    """
    n = counts(df, group, category)
    by = Window.partitionBy(group)
    x = n.withColumn("p", F.col("n") / F.sum("n").over(by)).withColumn("r", F.row_number().over(by.orderBy(F.desc("n"), category)))
    out = x.groupBy(group).agg(F.sum("n").alias("total"), F.count("*").alias("categories"), entropy(F.col("p")).alias("entropy_raw"), hhi(F.col("p")).alias("hhi"), F.sum(F.when(F.col("r") <= top_k, F.col("p")).otherwise(0.0)).alias("topk_share"))
    if basis == "global":
        k = df.filter(c(category).isNotNull()).agg(F.count_distinct(category).alias("_k"))
        out = out.crossJoin(F.broadcast(k)).withColumn("entropy_norm", global_norm(F.col("entropy_raw"), F.col("_k"))).drop("_k")  # one row
    elif basis == "support":
        out = out.withColumn("entropy_norm", support_norm(F.col("entropy_raw"), F.col("categories")))
    else:
        raise ValueError("basis must be 'global' or 'support'")
    return out


def cluster_profile(df: DataFrame, cluster: str, tech: str, k: int, *, beyond: bool = False, threshold: float = 0.5) -> DataFrame:
    """Per cluster 0..k-1: size, n_technologies, entropy_raw, entropy_norm (global), is_cross_cutting; empty clusters give zeros.

    ``beyond`` adds every other cluster that occurs; without it, identifiers outside 0..k-1 count as stale.
    """
    sizes = counts(df, cluster).select(cluster, F.col("n").alias("size"))
    d = group_distribution(df, cluster, tech, basis="global").select(cluster, "categories", "entropy_raw", "entropy_norm")
    ids = df.sparkSession.range(k).select(F.col("id").cast("int").alias(cluster))
    x = ids.join(sizes, cluster, "full_outer" if beyond else "left").join(d, cluster, "left")
    zero = {"size": 0, "categories": 0, "entropy_raw": 0.0, "entropy_norm": 0.0}
    return x.fillna(zero).withColumnRenamed("categories", "n_technologies").withColumn("is_cross_cutting", F.col("entropy_norm") >= threshold)


def cluster_summary(profile: DataFrame, labels: DataFrame, cluster: str) -> DataFrame:
    """(cluster, label, size, entropy, type) of every profiled cluster."""
    x = profile.join(labels, cluster, "left")
    return x.select(cluster, pretty_label(cluster, "label").alias("label"), "size", F.col("entropy_norm").alias("entropy"), F.when(F.col("is_cross_cutting"), "cross-cutting").otherwise("technology-specific").alias("type"))


def cross_cutting_summary(profile: DataFrame) -> DataFrame:
    x = profile.agg(F.count("*").alias("n_clusters"), F.count_if("is_cross_cutting").alias("n_cross_cutting"), F.sum("size").alias("n_phrases"), F.sum(F.when(F.col("is_cross_cutting"), F.col("size")).otherwise(0)).alias("n_cross_cutting_phrases"))
    return x.withColumn("pct_clusters", 100 * div(F.col("n_cross_cutting"), F.col("n_clusters"))).withColumn("pct_phrases", 100 * div(F.col("n_cross_cutting_phrases"), F.col("n_phrases")))


def dominance(df: DataFrame, group: str, category: str, *, share: float = 0.6, least: int = 3) -> DataFrame:
    """Per group: categories, dominant category (ties by name), its share, and whether it dominates or categories are few."""
    n = counts(df, group, category)
    x = n.groupBy(group).agg(F.count("*").alias("n_categories"), F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("m"), F.col(category).alias("v"))).alias("top"))
    x = x.select(group, "n_categories", F.col("top.v").alias("dominant"), (-F.col("top.m") / F.col("total")).alias("dominant_share"))
    return x.withColumn("flagged", (F.col("dominant_share") > share) | (F.col("n_categories") < least))


def volume_table(df: DataFrame, kind: str, tech: str, year: str, *, paragraph: Sequence[str] = ("paragraph_id", "para_id", "chunk_id")) -> DataFrame:
    """Per (tech, year): phrases and distinct paragraphs, named by the track."""
    check_track(kind)
    ident = next((p for p in paragraph if p in df.columns), None)
    if ident is None:
        raise ValueError(f"none of {tuple(paragraph)} is a column")
    x = df.filter(F.col(tech).isNotNull() & F.col(year).isNotNull())
    return x.groupBy(tech, year).agg(F.count("*").alias(f"{kind}_phrases"), F.count_distinct(ident).alias(f"{kind}_paragraphs"))


def volume_comparison(concerns: DataFrame, benefits: DataFrame, tech: str, year: str) -> DataFrame:
    """Both tracks' volumes side by side (absent ones 0), with the benefits' share of all phrases."""
    x = concerns.join(benefits, [tech, year], "full_outer")
    numbers = [n for n in x.columns if n not in (tech, year)]
    x = x.fillna(0, numbers)
    return x.withColumn("benefit_share", div(F.col("benefit_phrases"), F.col("benefit_phrases") + F.col("concern_phrases")))


def top_clusters(df: DataFrame, kind: str, cluster: str, labels: DataFrame | None = None, n: int = 10) -> DataFrame:
    """(kind, cluster, n[, label]) of the ``n`` largest clusters; ties by smaller id."""
    check_track(kind)
    top = counts(df, cluster).orderBy(F.desc("n"), cluster).limit(n)
    out = top.select(F.lit(kind).alias("kind"), cluster, "n")
    return out.join(labels, cluster, "left").select("kind", cluster, "n", "label") if labels is not None else out


def target_share_in_specific(df: DataFrame, profile: DataFrame, cluster: str, tech: str, target: str) -> DataFrame:
    """Per technology-specific cluster with phrases: size, target phrases, their share, and the > 0.4 and > 0.5 flags."""
    spec = profile.filter(~F.col("is_cross_cutting") & (F.col("size") > 0)).select(cluster)
    x = df.filter(F.col(cluster).isNotNull()).join(spec, cluster, "left_semi").groupBy(cluster)
    x = x.agg(F.count("*").alias("size"), F.count_if(F.coalesce(F.col(tech) == target, F.lit(False))).alias("n_target"))
    x = x.withColumn("target_share", F.col("n_target") / F.col("size"))
    return x.withColumns({"over_40": F.col("target_share") > 0.4, "over_50": F.col("target_share") > 0.5})


def cohens_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two labels per row: n, agreement, kappa."""
    x = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
    cells = x.groupBy("a", "b").agg(F.count("*").alias("n"))
    left, right = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    chance = left.join(right, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("na").cast("double") * F.col("nb")), F.lit(0.0)).alias("e"))
    t = cells.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("same"))
    x = t.crossJoin(chance).withColumn("agreement", F.try_divide("same", "n")).withColumn("_e", F.try_divide(F.col("e"), F.col("n").cast("double") * F.col("n")))  # one row each
    return x.select("n", "agreement", F.try_divide(F.col("agreement") - F.col("_e"), 1 - F.col("_e")).alias("kappa"))


def target_counts(df: DataFrame, tech: str, labels: Sequence[str]) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.count_if(is_target_label(tech, labels)).alias("n_target"))
