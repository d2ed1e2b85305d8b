"""How themes move over years and time windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from themeweave.functions.stats import div, entropy, hhi, plogp, support_norm
from themeweave.functions.text import WINDOWS, assign_window, c, pretty_label, tokenize
from themeweave.operators.metrics import counts


def year_doc_fraction(phrases: DataFrame, chunks: DataFrame, cluster: str, *, chunk: str = "chunk_id", year: str = "year", doc: str = "source_file", tech: str | None = None, target: str | None = None, clusters: DataFrame | None = None) -> DataFrame:
    """(year, cluster, n_docs, year_docs, fraction): share of a year's documents that raise a cluster.

    Year and document come from the chunks. Dense: every year with documents by every cluster (of
    ``clusters``, or of the matched phrases); years without a match give zeros, but no match at all gives no row.
    """
    ch = chunks.select(chunk, F.col(year).alias("year"), F.col(doc).alias("doc"), *([F.col(tech).alias("_t")] if tech else []))
    if tech and target is not None:
        ch = ch.filter(F.col("_t") == target)
    ch = ch.filter(F.col("year").isNotNull() & F.col("doc").isNotNull())
    hit = phrases.filter(F.col(cluster).isNotNull()).select(chunk, cluster).join(ch.select(chunk, "year", "doc").distinct(), chunk).select("year", "doc", cluster).distinct().groupBy("year", cluster).agg(F.count("*").alias("n_docs"))
    docs = ch.select("year", "doc").distinct().groupBy("year").agg(F.count("*").alias("year_docs"))
    ids = clusters.select(cluster).distinct() if clusters is not None else hit.select(cluster).distinct()
    matched = hit.limit(1).select(F.lit(1).alias("_some"))
    grid = docs.crossJoin(ids).crossJoin(F.broadcast(matched)).drop("_some")  # years x clusters x one row
    x = grid.join(hit, ["year", cluster], "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))
    return x.withColumn("fraction", F.col("n_docs") / F.col("year_docs"))


def year_counts(phrases: DataFrame, cluster: str, year: str = "year") -> DataFrame:
    """(year, cluster, n) of rows with both."""
    return counts(phrases, year, cluster).withColumnRenamed(year, "year")


def row_relative(matrix: DataFrame, value: str, year: str = "year") -> DataFrame:
    """``relative``: value as a share of its year's sum; 0 in an all-zero year."""
    return matrix.withColumn("relative", div(F.col(value), F.sum(value).over(Window.partitionBy(year))))


def dense_years(matrix: DataFrame, cluster: str, value: str, year: str = "year") -> DataFrame:
    """The matrix with a row for every year and cluster that occur, missing values 0."""
    grid = matrix.select(year).distinct().crossJoin(matrix.select(cluster).distinct())  # years x clusters
    return grid.join(matrix.select(year, cluster, value), [year, cluster], "left").fillna(0, [value])


def trend_slopes(matrix: DataFrame, cluster: str, value: str, year: str = "year", n: int = 8) -> DataFrame:
    """(cluster, slope, direction, place): the ``n`` steepest falls and rises of a dense matrix against the years' order; all-zero clusters are left out."""
    years = matrix.select(year).distinct().withColumn("t", F.row_number().over(Window.orderBy(year)) - 1)  # one row a year
    s = matrix.join(F.broadcast(years), year).groupBy(cluster).agg(F.regr_slope(F.col(value).cast("double"), F.col("t").cast("double")).alias("slope"), F.max(value).alias("_m")).filter(F.col("_m") > 0).drop("_m")  # years: bounded by the calendar
    s = s.filter(F.col("slope").isNotNull()).withColumn("slope", F.round("slope", 9)).withColumn("direction", F.when(F.col("slope") > 0, "rising").otherwise("declining"))
    lo = s.withColumn("place", F.row_number().over(Window.orderBy("slope", cluster))).filter(F.col("place") <= n).withColumn("end", F.lit("bottom"))
    hi = s.withColumn("place", F.row_number().over(Window.orderBy(F.desc("slope"), cluster))).filter(F.col("place") <= n).withColumn("end", F.lit("top"))
    return lo.unionByName(hi)


def heat_ordering(matrix: DataFrame, cluster: str, value: str, year: str = "year", n: int = 20) -> DataFrame:
    """(cluster, total, peak_year, place): the ``n`` clusters of largest total, in order of their first peak year."""
    g = matrix.groupBy(cluster).agg(F.round(F.sum(value), 9).alias("total"), F.min(F.struct((-F.round(value, 9)).alias("v"), F.col(year).alias("y")))["y"].alias("peak_year"))
    top = g.orderBy(F.desc("total"), cluster).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy("peak_year", F.desc("total"), cluster)))


def rank_volatility(matrix: DataFrame, cluster: str, value: str, year: str = "year") -> DataFrame:
    """(year, volatility): mean absolute change of the clusters' ranks (ties averaged) since the year before."""
    v = F.round(value, 9)
    x = matrix.withColumn("_v", v)
    avg_rank = F.rank().over(Window.partitionBy(year).orderBy(F.desc("_v"))) + (F.count("*").over(Window.partitionBy(year, "_v")) - 1) / 2
    x = x.withColumn("r", avg_rank).withColumn("prev", F.lag("r").over(Window.partitionBy(cluster).orderBy(year)))
    return x.filter(F.col("prev").isNotNull()).groupBy(year).agg(F.avg(F.abs(F.col("r") - F.col("prev"))).alias("volatility"))


def cluster_novelty(matrix: DataFrame, cluster: str, value: str, year: str = "year") -> DataFrame:
    """(year, active, new, new_share): clusters above 0, those never active before, and their share."""
    x = matrix.withColumn("_on", F.col(value) > 0)
    x = x.withColumn("_first", F.min(F.when(F.col("_on"), F.col(year))).over(Window.partitionBy(cluster)))
    g = x.groupBy(year).agg(F.count_if("_on").alias("active"), F.count_if(F.col("_on") & (F.col("_first") == F.col(year))).alias("new"))
    return g.withColumn("new_share", F.col("new") / F.greatest("active", F.lit(1)))


def lexical_novelty(phrases: DataFrame, tech: str, phrase: str, target: str, year: str = "year") -> DataFrame:
    """(year, num_phrases, vocab, new, new_share): tokens of the target's phrases never used in an earlier year."""
    x = phrases.filter((F.lower(tech) == target.lower()) & F.col(year).isNotNull()).select(F.col(year).alias("year"), F.col(phrase).alias("p"))
    n = x.groupBy("year").agg(F.count("*").alias("num_phrases"))
    tokens = x.select("year", F.explode_outer(F.array_distinct(tokenize("p"))).alias("w")).filter(F.col("w").isNotNull()).distinct()
    first = tokens.groupBy("w").agg(F.min("year").alias("first"))
    t = tokens.join(first, "w").groupBy("year").agg(F.count("*").alias("vocab"), F.count_if(F.col("first") == F.col("year")).alias("new"))
    return n.join(t, "year", "left").fillna(0, ["vocab", "new"]).withColumn("new_share", div(F.col("new"), F.col("vocab")))


def diversity_by(phrases: DataFrame, key: str, cluster: str, top_k: int = 10) -> DataFrame:
    """(key, total, entropy_raw, entropy_norm, hhi, topk_share) of the clusters of each key."""
    n = counts(phrases, key, cluster)
    by = Window.partitionBy(key)
    x = n.withColumn("p", F.col("n") / F.sum("n").over(by)).withColumn("r", F.row_number().over(by.orderBy(F.desc("n"), cluster)))
    g = x.groupBy(key).agg(F.sum("n").alias("total"), F.count("*").alias("k"), entropy(F.col("p")).alias("entropy_raw"), hhi(F.col("p")).alias("hhi"), F.sum(F.when(F.col("r") <= top_k, F.col("p")).otherwise(0.0)).alias("topk_share"))
    return g.select(key, "total", "entropy_raw", support_norm(F.col("entropy_raw"), F.col("k")).alias("entropy_norm"), "hhi", "topk_share")


def window_summary(phrases: DataFrame, cluster: str, *, year: str = "year", doc: str = "source_file", windows: Sequence = WINDOWS) -> DataFrame:
    """(window, n_phrases, n_clusters, n_documents, entropy_raw, entropy_norm) per time window."""
    x = phrases.withColumn("window", assign_window(year, windows)).filter(F.col("window").isNotNull())
    base = x.groupBy("window").agg(F.count("*").alias("n_phrases"), F.count_distinct(cluster).alias("n_clusters"), F.count_distinct(doc).alias("n_documents"))
    p = counts(x, "window", cluster).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("window"))).groupBy("window").agg(F.sum(plogp(F.col("p"))).alias("entropy_raw"))
    y = base.join(p, "window", "left").fillna(0.0, ["entropy_raw"])
    return y.withColumn("entropy_norm", support_norm(F.col("entropy_raw"), F.col("n_clusters")))


def window_top_clusters(phrases: DataFrame, cluster: str, labels: DataFrame, *, year: str = "year", n: int = 10, windows: Sequence = WINDOWS) -> DataFrame:
    """(window, place, cluster, label, n, share): the ``n`` largest clusters of each window; ties by id."""
    x = counts(phrases.withColumn("window", assign_window(year, windows)), "window", cluster)
    by = Window.partitionBy("window")
    x = x.withColumn("share", F.col("n") / F.sum("n").over(by)).withColumn("place", F.row_number().over(by.orderBy(F.desc("n"), cluster))).filter(F.col("place") <= n)
    return x.join(labels, cluster, "left").select("window", "place", cluster, pretty_label(cluster, "label").alias("label"), "n", "share")


def window_matrix(phrases: DataFrame, cluster: str, *, year: str = "year", n: int = 10, windows: Sequence = WINDOWS) -> DataFrame:
    """Wide (cluster, one share column per window, peak_window, peak_share) of the clusters that are among any window's ``n`` largest."""
    names = [name for _, name in windows]
    x = counts(phrases.withColumn("window", assign_window(year, windows)), "window", cluster)
    by = Window.partitionBy("window")
    x = x.withColumn("share", F.col("n") / F.sum("n").over(by)).withColumn("place", F.row_number().over(by.orderBy(F.desc("n"), cluster)))
    keep = x.filter(F.col("place") <= n).select(cluster).distinct()
    w = x.join(keep, cluster, "left_semi").groupBy(cluster).pivot("window", names).agg(F.max("share")).fillna(0.0, names)
    arr = F.array(*[F.col(f"`{name}`") for name in names])
    k = F.array_position(arr, F.array_max(arr)).cast("int")
    return w.withColumn("peak_window", F.element_at(F.array(*map(F.lit, names)), k)).withColumn("peak_share", F.array_max(arr))


def trajectory_points(phrases: DataFrame, vector: str, dim: int, *, year: str = "year") -> DataFrame:
    """(year, pos, mean): mean vector of each year in long form, summed where the rows are."""
    x = phrases.filter(c(year).isNotNull() & (F.size(vector) == dim)).select(F.col(year).alias("year"), F.posexplode(vector).alias("pos", "v"))
    return x.groupBy("year", "pos").agg(F.avg(F.col("v").cast("double")).alias("mean"))
