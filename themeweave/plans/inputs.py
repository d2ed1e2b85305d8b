"""The test tables as the logical inputs of the operators, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from themeweave.session import table

TARGET = "Artificial intelligence"
K = 75
LENSES = 10


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, repeated deliveries dropped."""
    return table(spark, d, "chunks").drop("loaded_at").dropDuplicates(["chunk_id"])


def phrases(spark: SparkSession, d: str, track: str = "concern") -> DataFrame:
    """Phrases of a track in the common schema, repeated deliveries dropped."""
    x = table(spark, d, f"{track}s")
    return x.select(F.col(f"{track}_id").alias("phrase_id"), "chunk_id", F.col(track).alias("phrase"), "technology", "technology_meta", "year", "source_file", "cluster_id").dropDuplicates(["phrase_id"])


def vectors(spark: SparkSession, d: str, track: str = "concern") -> DataFrame:
    """Usable vectors of a track."""
    from themeweave.operators.vectors import usable

    return usable(table(spark, d, "phrase_vectors").filter(F.col("track") == track).dropDuplicates(["phrase_id"]), "embedding", 96).select("phrase_id", "embedding")


def extractions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extractions").dropDuplicates(["extraction_id"])


def label_of(cluster: str = "cluster_id"):
    c = F.col(cluster)
    return F.when(c % 3 != 0, F.concat(F.lit("Theme "), c.cast("string"), F.repeat(F.lit(" of the dialogue"), F.pmod(c, F.lit(4)))))


def labels(ph: DataFrame) -> DataFrame:
    """Labels for two thirds of the clusters, some longer than a chart's."""
    return ph.select("cluster_id").filter("cluster_id IS NOT NULL").distinct().withColumn("label", label_of())


def bridge(ph: DataFrame) -> DataFrame:
    """Lens membership (lens, lens_order, cluster_id), many to many."""
    x = ph.select("cluster_id").filter("cluster_id IS NOT NULL").distinct()
    y = x.select("cluster_id", F.explode(F.sequence(F.lit(0), F.lit(LENSES - 1))).alias("lens_order"))
    return y.filter("cluster_id % 10 = lens_order OR (lens_order < 7 AND cluster_id % 7 = lens_order)").withColumn("lens", F.concat(F.lit("lens_"), F.col("lens_order").cast("string")))


# --- the same in SQL -------------------------------------------------------------------------

CH = "ch AS (SELECT DISTINCT chunk_id, source_file, chunk_index, text, word_count, was_truncated, chunking_method, technology, technology_meta, year FROM chunks)"
EX = "ex AS (SELECT DISTINCT extraction_id, track, chunk_id, raw_phrases, retained_phrases, dropped_by_filter, sentinel_returned, error FROM extractions)"
BR = "br AS (SELECT DISTINCT cluster_id, 'lens_' || j AS lens, j AS lens_order FROM ph, range(10) t(j) WHERE cluster_id % 10 = j OR (j < 7 AND cluster_id % 7 = j))"
SAL = """tn AS (SELECT technology_meta, count(*) AS tech_n FROM ph WHERE technology_meta IS NOT NULL GROUP BY ALL),
  tc AS (SELECT technology_meta, cluster_id, count(*) AS n FROM ph WHERE technology_meta IS NOT NULL AND cluster_id IS NOT NULL GROUP BY ALL),
  sal AS (SELECT technology_meta, cluster_id, coalesce(n, 0) AS n, tech_n, coalesce(n, 0) / tech_n AS share
          FROM tn CROSS JOIN (SELECT DISTINCT cluster_id FROM ph WHERE cluster_id IS NOT NULL) LEFT JOIN tc USING (technology_meta, cluster_id))"""
LENS_SAL = """lc AS (SELECT technology_meta, lens, sum(n) AS n FROM tc JOIN br USING (cluster_id) GROUP BY ALL),
  ls AS (SELECT technology_meta, lens, coalesce(n, 0) AS n, tech_n, coalesce(n, 0) / tech_n AS share
         FROM tn CROSS JOIN (SELECT DISTINCT lens FROM br) LEFT JOIN lc USING (technology_meta, lens))"""
PROFILE = """sz AS (SELECT cluster_id, count(*) AS size FROM ph WHERE cluster_id IS NOT NULL GROUP BY ALL),
  ct AS (SELECT cluster_id, technology_meta, count(*) AS n FROM ph WHERE cluster_id IS NOT NULL AND technology_meta IS NOT NULL GROUP BY ALL),
  cp AS (SELECT cluster_id, n / sum(n) OVER (PARTITION BY cluster_id) AS p FROM ct),
  ce AS (SELECT cluster_id, count(*) AS k, sum(-p * ln(p)) AS h FROM cp GROUP BY ALL),
  prof AS (SELECT CAST(i AS INTEGER) AS cluster_id, coalesce(size, 0) AS size, coalesce(k, 0) AS n_technologies, coalesce(h, 0) AS entropy_raw,
           coalesce(h, 0) / ln((SELECT count(DISTINCT technology_meta) FROM ph)) AS entropy_norm
           FROM range(75) r(i) LEFT JOIN sz ON sz.cluster_id = i LEFT JOIN ce ON ce.cluster_id = i)"""

# every cluster that occurs, beside 0 to 74
PROFILE_ALL = PROFILE.replace("FROM range(75) r(i)", "FROM (SELECT i FROM range(75) r(i) UNION SELECT cluster_id FROM sz) r(i)")


def label_sql(c: str = "cluster_id") -> str:
    return f"CASE WHEN {c} % 3 <> 0 THEN 'Theme ' || {c} || repeat(' of the dialogue', CAST((({c} % 4) + 4) % 4 AS BIGINT)) END"


def pretty_sql(c: str = "cluster_id", label: str | None = None) -> str:
    t = f"coalesce({label or label_sql(c)}, 'Cluster ' || {c})"
    return f"CASE WHEN length({t}) > 40 THEN left({t}, 37) || '...' ELSE {t} END"


def ph(track: str = "concern", name: str = "ph") -> str:
    return f"{name} AS (SELECT DISTINCT {track}_id AS phrase_id, chunk_id, {track} AS phrase, technology, technology_meta, year, source_file, cluster_id FROM {track}s)"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"
