"""Queries of the ten problems over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from themeweave.llm.clusters import similarity_clusters
from themeweave.llm.distinct import OWN_SHARE, parsimonious_scores, term_counts
from themeweave.llm.encode import encode_texts, token_sizes
from themeweave.llm.forest import nearest_neighbours
from themeweave.llm.looks import look_alike_classes, look_alikes, visual_forms
from themeweave.llm.pack import pack_items
from themeweave.llm.replies import defective_replies
from themeweave.llm.resolve import unmatched_spellings
from themeweave.llm.split import split_oversized
from themeweave.llm.topn import top_n_per_group
from themeweave.session import broadcast_if_small, cut, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The five benefits of highest similarity of each cluster."""
    return top_n_per_group(table(spark, d, "benefits"), "cluster_id", "similarity", "benefit_id", 5).select("cluster_id", "place", "benefit_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The entry of technologies that each freely typed technology means."""
    return unmatched_spellings(table(spark, d, "chunks"), "chunk_id", ["technology", "technology_meta"], table(spark, d, "technologies"), "tech_id", "name", ["short_name"])


DIM = 96


def _concern_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "phrase_vectors").filter("track = 'concern'").withColumnRenamed("phrase_id", "concern_id")


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar others, however far away, of every usable concern vector whose identifier is divisible by 20, against all."""
    near = nearest_neighbours(_concern_vectors(spark, d), "concern_id", "embedding", DIM, k=10, queries="concern_id % 20 = 0")
    return near.select(F.col("ident").alias("concern_id"), "place", F.col("other").alias("neighbour_id"), F.round("cosine", 6).alias("cosine"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of concerns of which one is among the ten most similar of the other, at a cosine of 0.955 or more.

    All vectors are asked. Pairs below the floor never outrank one above it, so nothing nearer than the floor is left out.
    """
    near = nearest_neighbours(_concern_vectors(spark, d), "concern_id", "embedding", DIM, k=10, floor=0.955)
    return near.select(F.least("ident", "other").alias("concern_id_a"), F.greatest("ident", "other").alias("concern_id_b")).distinct()


def _sized_clusters(spark: SparkSession, d: str) -> DataFrame:
    members = cut(similarity_clusters(table(spark, d, "phrase_vectors"), "track", "phrase_id", "embedding", DIM, floor=0.75))
    sizes = members.groupBy("track", "first").agg(F.count("*").alias("size")).filter("size >= 3")
    return members.join(broadcast_if_small(sizes, 1_000_000), ["track", "first"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Members of every set of three or more mutually similar phrases of a track."""
    return _sized_clusters(spark, d).select("track", F.col("first").alias("first_id"), F.col("ident").alias("phrase_id"))


def p6_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Each cluster of three or more with its size, its three members of highest density and, for concerns, the commonest older theme."""
    members = cut(_sized_clusters(spark, d))
    key = members.withColumn("cluster", F.concat_ws(":", "track", "first")).withColumn("density", F.coalesce("density", F.lit(-1e300)))  # further copies come last
    typical = top_n_per_group(key, "cluster", "density", "ident", 3)
    shown = typical.groupBy("cluster").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("place", "ident"))), lambda x: x["ident"].cast("string"))).alias("typical_ids"))
    themes = table(spark, d, "concerns").select(F.col("concern_id").alias("ident"), "cluster_id").filter("cluster_id IS NOT NULL").distinct()
    older = key.filter("track = 'concern'").join(themes, "ident").groupBy("cluster", "cluster_id").agg(F.count("*").alias("n"))
    commonest = older.groupBy("cluster").agg((-F.max(F.struct("n", (-F.col("cluster_id")).alias("c")))["c"]).alias("older_cluster_id"))
    base = key.select("cluster", "track", "first", "size").distinct()
    return base.join(shown, "cluster").join(commonest, "cluster", "left").select("track", F.col("first").alias("first_id"), "size", "typical_ids", "older_cluster_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Each defective reply with its one defect."""
    replies = table(spark, d, "extractions").withColumn("dropped_phrases", F.transform("dropped_by_filter", lambda x: x["phrase"]))
    return defective_replies(replies, "extraction_id", "chunk_id", "raw_phrases", "sentinel_returned", table(spark, d, "chunks"), "text", table(spark, d, "documents"), "text", "lang", error="error", dropped="dropped_phrases")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Ordered pieces of every chunk text above 2,000 signs."""
    return split_oversized(table(spark, d, "chunks"), ["chunk_id", "source_file"], "text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The chunks that had to be cut."""
    return split_oversized(table(spark, d, "chunks"), ["chunk_id", "source_file"], "text", with_text=False).filter("piece = 1").select("chunk_id", "source_file")


def p7_scores(spark: SparkSession, d: str) -> DataFrame:
    """How characteristic each technology is of each cluster of concerns."""
    scores = parsimonious_scores(term_counts(table(spark, d, "concerns"), "cluster_id", "technology_meta", "concern_id"))
    return scores.select(F.col("record").alias("cluster_id"), F.col("term").alias("technology_meta"), "n", F.round("weight", 6).alias("weight"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Technologies held by at least 5 concerns of a cluster at 3 times their overall share or more.

    In the converged model a term at 3 times its background has the weight (3 x record size / own mass - rest) x background,
    so the scores select; exact counts settle what lies on the border.
    """
    scores = parsimonious_scores(term_counts(table(spark, d, "concerns"), "cluster_id", "technology_meta", "concern_id"))
    rest = (1 - OWN_SHARE) / OWN_SHARE
    likely = scores.filter((F.col("weight") > 0) & (F.col("weight") >= (3 * F.col("record_n") / F.col("mass") - rest) * F.col("background") * (1 - 1e-6)))
    sure = likely.filter((F.col("n") >= 5) & (F.col("n") * F.col("total_n") >= 3 * F.col("term_n") * F.col("record_n")))
    return sure.select(F.col("record").alias("cluster_id"), F.col("term").alias("technology_meta"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode_texts(table(spark, d, "documents"), "doc_id", "text")


def p9_packing(spark: SparkSession, d: str) -> DataFrame:
    """Every document in a container of each kind, sized in tokens of the public tokenizer."""
    sizes = token_sizes(table(spark, d, "documents"), "doc_id", "text")
    return pack_items(sizes, "doc_id", "n_tokens", table(spark, d, "containers"), "container_kind", "capacity_tokens")


def p10_forms(spark: SparkSession, d: str) -> DataFrame:
    """The one visual form of every document's text."""
    return visual_forms(table(spark, d, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose texts differ but look the same."""
    return look_alikes(table(spark, d, "documents"), "doc_id", "text")


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each such document with its class of look-alikes, for tables where the pairs would be too many."""
    return look_alike_classes(table(spark, d, "documents"), "doc_id", "text")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p2_found, p3_found, p3_neighbours, p4_found, p5_found, p5_pieces, p6_found, p6_clusters, p7_found, p7_scores, p8_ids, p9_packing, p10_found, p10_classes, p10_forms)}

ORACLES: dict[str, str] = {
    "p1_found": """
        WITH b AS (SELECT DISTINCT cluster_id, benefit_id, similarity FROM benefits
                   WHERE cluster_id IS NOT NULL AND benefit_id IS NOT NULL AND similarity IS NOT NULL AND NOT isnan(similarity)),
             r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY similarity DESC, benefit_id) AS place FROM b)
        SELECT cluster_id, CAST(place AS INTEGER) AS place, benefit_id FROM r WHERE place <= 5""",
    "p5_found": "SELECT DISTINCT chunk_id, source_file FROM chunks WHERE length(text) > 2000",
    "p7_found": """
        WITH c AS (SELECT DISTINCT concern_id, cluster_id, technology_meta FROM concerns WHERE cluster_id IS NOT NULL AND technology_meta IS NOT NULL),
             n AS (SELECT cluster_id, technology_meta, count(*) AS n FROM c GROUP BY ALL),
             k AS (SELECT cluster_id, count(*) AS k FROM c GROUP BY ALL),
             t AS (SELECT technology_meta, count(*) AS t FROM c GROUP BY ALL)
        SELECT cluster_id, technology_meta FROM n JOIN k USING (cluster_id) JOIN t USING (technology_meta)
        WHERE n >= 5 AND n * (SELECT count(*) FROM c) >= 3 * t * k""",
    # the fixed point of the model in closed form: terms by falling ratio keep a weight while the ratio exceeds the mass times 7/3
    "p7_scores": """
        WITH c AS (SELECT DISTINCT concern_id, cluster_id, technology_meta FROM concerns WHERE cluster_id IS NOT NULL AND technology_meta IS NOT NULL),
             n AS (SELECT cluster_id, technology_meta, count(*) AS n FROM c GROUP BY ALL),
             t AS (SELECT technology_meta, count(*) / (SELECT count(*) FROM c) AS b FROM c GROUP BY ALL),
             x AS (SELECT *, sum(n) OVER w AS cn, sum(b) OVER w AS cb FROM n JOIN t USING (technology_meta) WINDOW w AS (PARTITION BY cluster_id ORDER BY n / b DESC, technology_meta)),
             m AS (SELECT cluster_id, max_by(cn / (1 + 7 / 3 * cb), cn) AS mass FROM x WHERE n / b > 7 / 3 * cn / (1 + 7 / 3 * cb) GROUP BY ALL)
        SELECT cluster_id, technology_meta, n, round(greatest(0, n / mass - 7 / 3 * b), 6) + 0.0 AS weight FROM x JOIN m USING (cluster_id)""",
}
