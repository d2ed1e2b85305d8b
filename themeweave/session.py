"""Session helpers: table access, a checkpoint folder, guarded broadcasts."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder (a file or a folder of part files)."""
    return spark.read.parquet(f"{data_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Without one a temporary folder serves a local session (tests); on a cluster, whose
    executors don't share it, that raises."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = os.path.join(tempfile.gettempdir(), f"themeweave-checkpoint-{os.getpid()}")
    spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, store it in the shared checkpoint folder and continue from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it holds at most ``max_rows`` rows, else unhinted (the join then shuffles).

    The count stops after ``max_rows + 1`` rows, so checking a huge side stays cheap.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the session's Python workers, once; they need not have it installed."""
    sc = spark.sparkContext
    if not getattr(sc, "_themeweave_shipped", False):
        here = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="themeweave-"), "themeweave.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, files in os.walk(here):
                for name in sorted(files):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.join("themeweave", os.path.relpath(path, here)))
        sc.addPyFile(target)
        sc._themeweave_shipped = True
    return spark
