"""The three stages with their settings, as one place to call the operators from."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from themeweave import config
from themeweave.operators import chunking, extraction, metrics, quality, robustness, shares, temporal, trace, vectors
from themeweave.sources.catalog import Catalog


@dataclass
class Access(config.AccessStage):
    """Obtains and chunks documents."""

    def chunks(self, docs: DataFrame, doc: str, text: str, blocks: str | None = None) -> DataFrame:
        return chunking.chunk_documents(docs, doc, text, blocks, min_words=self.min_chunk_words, min_chars=self.min_chunk_chars, max_words=self.max_chunk_words)

    def catalog(self, spark: SparkSession) -> Catalog:
        return Catalog(spark, self.output_folder)


@dataclass
class Assess:
    """Question-agnostic checks."""

    access: Access = field(default_factory=Access)

    def flags(self, chunks: DataFrame) -> DataFrame:
        return quality.flag_chunk_quality(chunks)

    def quality(self, chunks: DataFrame) -> dict[str, DataFrame]:
        """The frames behind the four quality panels."""
        return {"technology": quality.count_by(chunks, "technology_meta"), "year": quality.count_by(chunks, "year"), "document": quality.count_by(chunks, "source_file"), "words": quality.histogram(chunks, "word_count")}

    def validate_cache(self, extractions: DataFrame, threshold: float = 0.30) -> bool:
        return extraction.cache_is_valid(extractions, threshold)

    def validation_summary(self, spark: SparkSession, n_concern_clusters: int = 75, n_benefit_clusters: int = 75) -> DataFrame:
        return self.access.catalog(spark).validation_summary({"concern": n_concern_clusters, "benefit": n_benefit_clusters})


@dataclass
class Address(config.AddressStage):
    """Answers about one target technology; phrases in the common schema."""

    access: Access = field(default_factory=Access)

    def n_clusters(self, kind: str) -> int:
        return {"concern": self.n_concern_clusters, "benefit": self.n_benefit_clusters}[metrics.check_track(kind)]

    def year_matrix(self, phrases: DataFrame, chunks: DataFrame, target: str | None = None) -> DataFrame:
        """Document fractions by year for the target, over all clusters of the track."""
        ids = phrases.select("cluster_id").filter("cluster_id IS NOT NULL")
        return temporal.year_doc_fraction(phrases, chunks, "cluster_id", tech=self.tech_col, target=target or self.ai_tech_label, clusters=ids)

    def trajectory(self, phrases: DataFrame, vector: str, dim: int, target: str | None = None) -> DataFrame:
        own = phrases.filter(F.col(self.tech_col) == (target or self.ai_tech_label))
        return vectors.pca_trajectory(temporal.trajectory_points(own, vector, dim))

    def salience(self, phrases: DataFrame) -> DataFrame:
        return shares.salience(phrases, self.tech_col, "cluster_id")

    def profile(self, phrases: DataFrame, kind: str) -> DataFrame:
        return metrics.cluster_profile(phrases, "cluster_id", self.tech_col, self.n_clusters(kind), threshold=self.cross_cutting_threshold)

    def cluster_phrases(self, phrases: DataFrame, kind: str, vector: str = "embedding", ident: str = "phrase_id", starts: int = 10) -> tuple[DataFrame, DataFrame]:
        """(phrases with cluster_id, centroids) by k-means."""
        assigned, cents = vectors.kmeans(phrases, ident, vector, self.n_clusters(kind), seed=self.random_seed, starts=starts)
        return phrases.drop("cluster_id").join(assigned, ident), cents

    def memberships(self, phrases: DataFrame, cents: DataFrame, vector: str = "embedding", ident: str = "phrase_id") -> DataFrame:
        return vectors.soft_membership(phrases, ident, vector, cents, "cluster_id", "centroid", self.soft_membership_threshold)

    def distinctive(self, phrases: DataFrame, labels: DataFrame, n: int = 10) -> DataFrame:
        return shares.distinctive(phrases, self.tech_col, "cluster_id", self.ai_tech_label, labels, n)

    def fingerprint(self, phrases: DataFrame) -> DataFrame:
        return shares.fingerprint(self.salience(phrases), self.tech_col, "cluster_id", self.ai_tech_label)

    def lexical_novelty(self, phrases: DataFrame, phrase: str = "phrase") -> DataFrame:
        return temporal.lexical_novelty(phrases, self.tech_col, phrase, self.ai_tech_label)

    def robustness(self, phrases: DataFrame) -> DataFrame:
        return robustness.stable_core_robustness(self.salience(phrases), self.tech_col, "cluster_id", self.ai_tech_label)

    def sensitivity(self, phrases: DataFrame, kind: str, k: int, **options) -> dict[str, DataFrame]:
        return robustness.run_sensitivity(phrases, kind, k, target=self.ai_tech_label, tech=self.tech_col, seed=self.random_seed, **options)

    def validation_sample(self, chunks: DataFrame, phrases: DataFrame) -> DataFrame:
        return trace.validation_sample(chunks, phrases, tech=self.tech_col, n=self.validation_sample_n, seed=self.random_seed)
