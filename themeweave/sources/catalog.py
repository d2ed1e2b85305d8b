"""Artifacts of a run: named Parquet tables in a folder, with a manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from themeweave.schema import SCHEMAS

#: Artifacts a finished run has, and those it may have.
REQUIRED = ("metadata", "chunks", "extractions", "phrases", "embeddings", "centroids", "cluster_entropy", "cluster_tech_dist", "cluster_summary", "yield_summary")
OPTIONAL = ("soft_membership", "cluster_exemplars", "cluster_labels", "lens_membership")


class Catalog:
    """Tables of one run. Phrases and vectors are partitioned by track, so a track's queries read only its files."""

    PARTITIONS = {"phrases": ["track"], "embeddings": ["track"], "extractions": ["track"]}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def has(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def save(self, name: str, df: DataFrame, mode: str = "overwrite") -> DataFrame:
        """Writes a table and reads it back, which also fixes the result of side-effecting steps."""
        w = df.write.mode(mode)
        if name in self.PARTITIONS:
            w = w.partitionBy(*self.PARTITIONS[name])
        w.parquet(self.path(name))
        return self.load(name)

    def load(self, name: str) -> DataFrame | None:
        """A table, or None if it was never written; raises for a missing required one."""
        if self.has(name):
            try:
                return self.spark.read.parquet(self.path(name))
            except AnalysisException:  # a partitioned table without rows has no file to read a schema from
                return self.spark.createDataFrame([], SCHEMAS[name])
        if name in REQUIRED:
            raise FileNotFoundError(f"the run has no {name}")
        return None

    def load_all(self) -> dict[str, DataFrame | None]:
        missing = [n for n in REQUIRED if not self.has(n)]
        if missing:
            raise FileNotFoundError(f"the run lacks {missing}")
        return {n: self.load(n) for n in (*REQUIRED, *OPTIONAL)}

    def verify(self, names: Sequence[str] = REQUIRED) -> DataFrame:
        """(name, status): OK or MISSING for each expected artifact."""
        rows = [(n, "OK" if self.has(n) else "MISSING") for n in names]
        return self.spark.createDataFrame(rows, "name string, status string")

    def validation_summary(self, expected_clusters: dict[str, int] | None = None) -> DataFrame:
        """(section, key, value, status): rows of each artifact, yields, cluster counts against the expected, and the checklist."""
        rows = []
        for n in (*REQUIRED, *OPTIONAL):
            rows.append(("rows", n, str(self.load(n).count()) if self.has(n) else "-1", "OK" if self.has(n) else "MISSING"))
        if self.has("yield_summary"):
            for r in self.load("yield_summary").collect():  # a row a track
                rows += [("yield", f"{r.track}.{k}", str(v), "OK") for k, v in r.asDict().items() if k != "track"]
        if self.has("phrases"):
            found = {r.track: r.n for r in self.load("phrases").groupBy("track").agg(F.count_distinct("cluster_id").alias("n")).collect()}
            for t, k in (expected_clusters or {}).items():
                rows.append(("clusters", t, str(found.get(t, 0)), "OK" if found.get(t, 0) == k else "MISMATCH"))
        return self.spark.createDataFrame(rows, "section string, key string, value string, status string")


def label_map(df: DataFrame, key: str, value: str, limit: int = 10_000) -> dict:
    """A small two-column table as a dict; raises beyond ``limit`` rows."""
    rows = df.select(key, value).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    return {r[0]: r[1] for r in rows}


def schema_of(name: str) -> str:
    return SCHEMAS[name]
