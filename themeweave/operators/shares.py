"""Shares of themes and lenses by technology, baselines and differences.

Long form throughout: one row per (technology, cluster) or (technology, lens). Grids are dense:
pairs that never occur have share 0, so means over technologies count them.
Lens membership is a bridge (lens, cluster[, lens_order]); a phrase counts in every lens of its cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from themeweave.functions.stats import div, plogp
from themeweave.functions.text import pretty_label
from themeweave.operators.metrics import counts


def _keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).filter(F.col(key).isNotNull()).distinct()


def salience(df: DataFrame, tech: str, cluster: str, only: DataFrame | None = None) -> DataFrame:
    """(tech, cluster, n, tech_n, share) for every technology and every cluster of the data.

    The denominator is all phrases of the technology, those without a cluster included. ``only`` (a
    frame of clusters) restricts the clusters but not the denominator.
    """
    total = counts(df, tech).withColumnRenamed("n", "tech_n")
    grid_of = _keys(df, cluster)
    if only is not None:
        grid_of = grid_of.join(only.select(cluster).distinct(), cluster, "left_semi")
    grid = total.crossJoin(grid_of)  # technologies x clusters, both dimensions of the result
    x = grid.join(counts(df, tech, cluster), [tech, cluster], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return x.select(tech, cluster, "n", "tech_n", (F.col("n") / F.col("tech_n")).alias("share"))


def lens_counts(df: DataFrame, cluster: str, bridge: DataFrame, *by: str) -> DataFrame:
    """Phrases per (by, lens); phrases are counted per cluster first, so the bridge multiplies counts, not rows."""
    return counts(df, *by, cluster).join(bridge.select("lens", cluster).distinct(), cluster).groupBy(*by, "lens").agg(F.sum("n").alias("n"))


def lens_prevalence(df: DataFrame, cluster: str, bridge: DataFrame) -> DataFrame:
    """(lens, n): phrases in each lens, 0 for lenses without any."""
    return bridge.select("lens").distinct().join(lens_counts(df, cluster, bridge), "lens", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def lens_stats(df: DataFrame, cluster: str, tech: str, bridge: DataFrame) -> DataFrame:
    """(lens, n, prevalence, entropy): share of all phrases, and entropy of the lens over technologies."""
    total = df.agg(F.count("*").alias("total"))
    by = Window.partitionBy("lens")
    t = lens_counts(df, cluster, bridge, tech).withColumn("p", F.col("n") / F.sum("n").over(by)).groupBy("lens").agg(F.sum(plogp(F.col("p"))).alias("entropy"))
    x = lens_prevalence(df, cluster, bridge).join(t, "lens", "left").crossJoin(F.broadcast(total))  # one row
    return x.select("lens", "n", div(F.col("n"), F.col("total")).alias("prevalence"), F.coalesce("entropy", F.lit(0.0)).alias("entropy"))


def lens_salience(df: DataFrame, tech: str, cluster: str, bridge: DataFrame) -> DataFrame:
    """(tech, lens, n, tech_n, share) on the dense grid."""
    total = counts(df, tech).withColumnRenamed("n", "tech_n")
    grid = total.crossJoin(bridge.select("lens").distinct())  # technologies x lenses
    x = grid.join(lens_counts(df, cluster, bridge, tech), [tech, "lens"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return x.select(tech, "lens", "n", "tech_n", (F.col("n") / F.col("tech_n")).alias("share"))


def target_and_baselines(grid: DataFrame, tech: str, item: str, target: str) -> DataFrame:
    """(item, target_share, tech_weighted, doc_weighted, difference, difference_doc) from a dense grid (tech, item, n, tech_n, share).

    tech_weighted: mean share over the other technologies; doc_weighted: their pooled share.
    """
    own = F.col(tech) == target
    x = grid.groupBy(item).agg(
        F.coalesce(F.max(F.when(own, F.col("share"))), F.lit(0.0)).alias("target_share"),
        F.coalesce(F.avg(F.when(~own, F.col("share"))), F.lit(0.0)).alias("tech_weighted"),
        div(F.sum(F.when(~own, F.col("n"))), F.sum(F.when(~own, F.col("tech_n")))).alias("doc_weighted"),
    )
    return x.withColumns({"difference": F.col("target_share") - F.col("tech_weighted"), "difference_doc": F.col("target_share") - F.col("doc_weighted")})


def extremes(diff: DataFrame, item: str, value: str, low: int, high: int) -> DataFrame:
    """The ``low`` smallest and ``high`` largest rows (a row may be in both), with ``direction``; ties by item."""
    up = Window.orderBy(F.col(value).asc(), F.col(item).asc())
    down = Window.orderBy(F.col(value).desc(), F.col(item).asc())
    # one row per item of an already aggregated table
    a = diff.withColumn("place", F.row_number().over(up)).filter(F.col("place") <= low).withColumn("direction", F.lit("under"))
    b = diff.withColumn("place", F.row_number().over(down)).filter(F.col("place") <= high).withColumn("direction", F.lit("over"))
    return a.unionByName(b)


def distinctive(df: DataFrame, tech: str, cluster: str, target: str, labels: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` clusters a technology talks of least and most compared with the mean of the others."""
    d = extremes(target_and_baselines(salience(df, tech, cluster), tech, cluster, target), cluster, "difference", n, n)
    return d.join(labels, cluster, "left").withColumn("label", pretty_label(cluster, "label"))


def fingerprint(sal: DataFrame, tech: str, cluster: str, target: str) -> DataFrame:
    """(cluster, value): each cluster's shares scaled to sum 1 over technologies; target minus the mean of the others."""
    by = Window.partitionBy(cluster)
    x = sal.withColumn("q", div(F.col("share"), F.sum("share").over(by)))
    own = F.col(tech) == target
    g = x.groupBy(cluster).agg(F.coalesce(F.max(F.when(own, F.col("q"))), F.lit(0.0)).alias("t"), F.coalesce(F.avg(F.when(~own, F.col("q"))), F.lit(0.0)).alias("o"))
    return g.select(cluster, (F.col("t") - F.col("o")).alias("value"))


def shared_top(df: DataFrame, profile: DataFrame, cluster: str, n: int = 20, *, cross_cutting_only: bool = False) -> DataFrame:
    """(cluster, prevalence, entropy_raw) of the ``n`` most prevalent clusters; ties by entropy, then id.

    Both keys are compared to nine places: the last digits of a sum of doubles depend on its order.
    """
    c = counts(df, cluster)
    total = c.agg(F.sum("n").alias("total"))
    keep = profile.filter("is_cross_cutting") if cross_cutting_only else profile
    x = c.join(keep.select(cluster, "entropy_raw"), cluster).crossJoin(F.broadcast(total))  # one row
    return x.select(cluster, (F.col("n") / F.col("total")).alias("prevalence"), "entropy_raw").orderBy(F.desc(F.round("prevalence", 9)), F.desc(F.round("entropy_raw", 9)), cluster).limit(n)


def stable_core(profile: DataFrame, cluster: str, quantile: float = 0.75, annotate: int = 12) -> DataFrame:
    """Clusters with phrases: size, entropy_norm, in_core (cross-cutting and at least the size quantile), score, annotated (best scores of the core)."""
    x = profile.filter(F.col("size") > 0)
    q = x.agg(F.percentile("size", F.lit(quantile)).alias("threshold"))
    x = x.crossJoin(F.broadcast(q)).withColumn("in_core", F.col("is_cross_cutting") & (F.col("size") >= F.col("threshold"))).withColumn("score", F.col("entropy_norm") * F.log1p(F.col("size").cast("double")))  # one row
    place = F.row_number().over(Window.partitionBy("in_core").orderBy(F.desc(F.round("score", 9)), cluster))
    return x.withColumn("annotated", F.col("in_core") & (place <= annotate)).select(cluster, "size", "entropy_norm", "threshold", "in_core", "score", "annotated")


def top_salience_clusters(sal: DataFrame, cluster: str, n: int = 40) -> DataFrame:
    return sal.groupBy(cluster).agg(F.avg("share").alias("mean_share")).orderBy(F.desc(F.round("mean_share", 9)), cluster).limit(n)


def prevalence_table(top: DataFrame, summary: DataFrame, cluster: str) -> DataFrame:
    """Publication table: top clusters with label, type and percentages."""
    x = top.join(summary.select(cluster, "label", "type"), cluster, "left")
    return x.select(cluster, "label", F.round(100 * F.col("prevalence"), 1).alias("prevalence_pct"), F.round("entropy_raw", 2).alias("entropy"), "type")


def panels(cluster_extremes: DataFrame, lens_diff: DataFrame, cluster: str) -> tuple[DataFrame, DataFrame]:
    """Two panels in percent and percentage points: clusters with a direction, and lenses against both baselines."""
    a = cluster_extremes.select(cluster, "label", "direction", F.round(100 * F.col("target_share"), 2).alias("target_pct"), F.round(100 * F.col("tech_weighted"), 2).alias("others_pct"), F.round(100 * F.col("difference"), 2).alias("difference_pp"))
    b = lens_diff.select("lens", F.round(100 * F.col("target_share"), 1).alias("target_pct"), F.round(100 * F.col("difference"), 1).alias("tech_weighted_pp"), F.round(100 * F.col("difference_doc"), 1).alias("doc_weighted_pp"))
    return a, b


# --- studies of prompt variants: rows (variant, tech, chunk, phrase_idx, cluster) -------------


def variant_diagnostics(chunks: DataFrame, phrases: DataFrame, variant: str = "variant", chunk: str = "chunk_id", phrase: str = "phrase") -> DataFrame:
    """Per variant: chunks, covered chunks, coverage, phrases, density, mean words of a phrase."""
    n = chunks.groupBy(variant).agg(F.count_distinct(chunk).alias("n_chunks"))
    p = phrases.groupBy(variant).agg(F.count_distinct(chunk).alias("n_covered"), F.count("*").alias("n_phrases"), F.avg(F.size(F.filter(F.split(phrase, r"\s+"), lambda w: w != ""))).alias("mean_words"))
    x = n.join(p, variant, "left").fillna(0, ["n_covered", "n_phrases"])
    return x.withColumns({"coverage": div(F.col("n_covered"), F.col("n_chunks")), "density": div(F.col("n_phrases"), F.col("n_chunks"))})


def variant_lens_share(phrases: DataFrame, bridge: DataFrame, tech: str, cluster: str, variant: str = "variant") -> DataFrame:
    """Per (variant, tech, lens): n, tech_n and share among phrases mapped to a lens by their cluster's last lens."""
    primary = bridge.groupBy(cluster).agg(F.max(F.struct("lens_order", "lens"))["lens"].alias("lens"))
    n = counts(phrases, variant, tech, cluster).join(primary, cluster).groupBy(variant, tech, "lens").agg(F.sum("n").alias("n"))
    return n.withColumn("tech_n", F.sum("n").over(Window.partitionBy(variant, tech))).withColumn("share", F.col("n") / F.col("tech_n"))


def variant_distinctiveness(shares: DataFrame, tech: str, target: str, variant: str = "variant") -> DataFrame:
    """Per (variant, lens): target share, both baselines and both differences, on the dense grid."""
    total = shares.select(variant, tech, "tech_n").distinct()
    grid = total.join(shares.select("lens").distinct(), how="cross").join(shares.select(variant, tech, "lens", "n"), [variant, tech, "lens"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("share", F.col("n") / F.col("tech_n"))
    own = F.col(tech) == target
    x = grid.groupBy(variant, "lens").agg(F.coalesce(F.max(F.when(own, F.col("share"))), F.lit(0.0)).alias("target_share"), F.coalesce(F.avg(F.when(~own, F.col("share"))), F.lit(0.0)).alias("tech_weighted"), div(F.sum(F.when(~own, F.col("n"))), F.sum(F.when(~own, F.col("tech_n")))).alias("doc_weighted"))
    return x.withColumns({"diff_tech": F.col("target_share") - F.col("tech_weighted"), "diff_doc": F.col("target_share") - F.col("doc_weighted")})


def first_assignment(phrases: DataFrame, cluster: str, variant: str = "variant", chunk: str = "chunk_id", order: str = "phrase_idx") -> DataFrame:
    """The cluster of each chunk's first phrase, per variant."""
    return phrases.filter(F.col(cluster).isNotNull()).groupBy(variant, chunk).agg(F.min(F.struct(order, cluster))[cluster].alias(cluster))


def adjusted_rand(df: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """(by, n, ari): adjusted Rand index of two labelings; null without a defined value."""
    two = lambda x: F.col(x).cast("double") * (F.col(x) - 1) / 2
    x = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = x.groupBy(*by, a, b).agg(F.count("*").alias("n"))
    key = list(by) or [F.lit(0).alias("_0")]
    names = list(by) or ["_0"]
    i = cells.groupBy(*key).agg(F.sum("n").alias("n"), F.sum(two("n")).alias("sij"))
    r = cells.groupBy(*by, a).agg(F.sum("n").alias("m")).groupBy(*key).agg(F.sum(two("m")).alias("sa"))
    q = cells.groupBy(*by, b).agg(F.sum("n").alias("m")).groupBy(*key).agg(F.sum(two("m")).alias("sb"))
    z = i.join(r, names).join(q, names)
    expected = F.try_divide(F.col("sa") * F.col("sb"), two("n"))
    return z.select(*by, "n", F.try_divide(F.col("sij") - expected, (F.col("sa") + F.col("sb")) / 2 - expected).alias("ari"))


def variant_ari(assign: DataFrame, baseline: str, cluster: str, variant: str = "variant", chunk: str = "chunk_id", least: int = 10) -> DataFrame:
    """(variant, n, ari) of each variant's first-phrase clusters against the baseline's; null below ``least`` common chunks."""
    base = assign.filter(F.col(variant) == baseline).select(chunk, F.col(cluster).alias("_base"))
    x = adjusted_rand(assign.filter(F.col(variant) != baseline).join(base, chunk), "_base", cluster, variant)
    return x.withColumn("ari", F.when(F.col("n") >= least, F.col("ari")))


def disagreements(assign: DataFrame, a: str, b: str, cluster: str, n: int = 10, variant: str = "variant", chunk: str = "chunk_id") -> DataFrame:
    """``n`` chunks (by hash order) whose first phrases fall in different clusters under two variants."""
    x, y = (assign.filter(F.col(variant) == v).select(chunk, F.col(cluster).alias(k)) for v, k in ((a, "cluster_a"), (b, "cluster_b")))
    return x.join(y, chunk).filter("cluster_a <> cluster_b").orderBy(F.md5(F.col(chunk).cast("string")), chunk).limit(n)


def prompt_agreement(phrases: DataFrame, chunks: DataFrame, vector: str, *, threshold: float = 0.85, variant: str = "variant", chunk: str = "chunk_id") -> DataFrame:
    """(variant_a, variant_b, n_chunks, yield_agreement, n_both, phrase_agreement) for each pair of variants.

    Yield agrees where both or neither variant gave phrases; phrases agree by the fraction of a
    chunk's phrases, on either side, whose best cosine on the other reaches ``threshold``. Only
    phrases of one chunk meet, and a chunk has few.
    """
    v = chunks.select(variant, chunk).distinct()
    pairs = v.select(chunk, F.col(variant).alias("variant_a")).join(v.select(chunk, F.col(variant).alias("variant_b")), chunk).filter("variant_a < variant_b")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    unit = phrases.select(variant, chunk, F.monotonically_increasing_id().alias("pid") if "phrase_id" not in phrases.columns else F.col("phrase_id").alias("pid"), F.col(vector).alias("v"))
    has = unit.groupBy(variant, chunk).agg(F.count("*").alias("n"))
    y = pairs.join(has.select(chunk, F.col(variant).alias("variant_a"), F.col("n").alias("na")), [chunk, "variant_a"], "left").join(has.select(chunk, F.col(variant).alias("variant_b"), F.col("n").alias("nb")), [chunk, "variant_b"], "left").fillna(0, ["na", "nb"])
    a = unit.select(chunk, F.col(variant).alias("variant_a"), F.col("pid").alias("pa"), F.col("v").alias("va"))
    b = unit.select(chunk, F.col(variant).alias("variant_b"), F.col("pid").alias("pb"), F.col("v").alias("vb"))
    met = a.join(b, chunk).filter("variant_a < variant_b").withColumn("s", dot("va", "vb") / F.sqrt(dot("va", "va") * dot("vb", "vb")))
    side = lambda k: met.groupBy(chunk, "variant_a", "variant_b", k).agg(F.max("s").alias("s")).groupBy(chunk, "variant_a", "variant_b").agg(F.count_if(F.col("s") >= threshold).alias(f"hit_{k}"))
    both = side("pa").join(side("pb"), [chunk, "variant_a", "variant_b"])
    y = y.join(both, [chunk, "variant_a", "variant_b"], "left").withColumn("agree", F.when((F.col("na") > 0) & (F.col("nb") > 0), (F.col("hit_pa") + F.col("hit_pb")) / (F.col("na") + F.col("nb"))))
    same = (F.col("na") > 0) == (F.col("nb") > 0)
    return y.groupBy("variant_a", "variant_b").agg(F.count("*").alias("n_chunks"), F.avg(F.when(same, 1.0).otherwise(0.0)).alias("yield_agreement"), F.count("agree").alias("n_both"), F.avg("agree").alias("phrase_agreement"))


def variant_summary(diagnostics: DataFrame, ari: DataFrame, distinctiveness: DataFrame, name_parts: dict[str, str], variant: str = "variant", *, baseline: str | None = None) -> DataFrame:
    """Per variant: diagnostics, agreement with the baseline (1.0 for the ``baseline`` itself), and for each column of ``name_parts`` the
    differences ``<column>_tech`` and ``<column>_doc`` of the first lens by name that contains the part, case aside (null if none does)."""
    first = lambda part, value: F.min_by(value, F.when(F.lower("lens").contains(part.lower()), F.col("lens")))
    named = [first(part, f"diff_{basis}").alias(f"{column}_{basis}") for column, part in name_parts.items() for basis in ("tech", "doc")]
    out = diagnostics.join(ari.select(variant, "ari"), variant, "left")
    if baseline is not None:
        out = out.withColumn("ari", F.when(F.col(variant) == baseline, 1.0).otherwise(F.col("ari")))
    return out.join(distinctiveness.groupBy(variant).agg(*named), variant, "left") if named else out


def comparison_chart(cluster_extremes: DataFrame, cluster: str) -> DataFrame:
    """Data of a two-sided bar chart: label, both shares in percent and the difference in percentage points."""
    pct = lambda x: F.round(100 * F.col(x), 2) + F.lit(0.0)
    return cluster_extremes.select(cluster, "label", "direction", pct("target_share").alias("target_pct"), pct("tech_weighted").alias("others_pct"), pct("difference").alias("difference_pp"))
