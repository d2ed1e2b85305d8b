"""Continuous runs of the same operators over growing folders and event tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from themeweave.operators.quality import flag_chunk_quality


def stream_table(spark: SparkSession, folder: str, schema, *, files_per_trigger: int = 100, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).parquet(folder)


def flag_stream(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Quality flags on a stream of chunks; stateless."""
    return flag_chunk_quality(chunks, text)


def _watermarked(events: DataFrame, ts: str, late: str) -> DataFrame:
    """A stream with a watermark (which needs a zoned time stamp); a batch as it is."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events


def windowed_counts(events: DataFrame, ts: str, key: str, *, window: str = "1 day", late: str = "7 days", value: str | None = None) -> DataFrame:
    """(start, end, key, n[, total]) per time window; rows later than ``late`` are ignored once their window is closed. Runs on batches as well."""
    x = _watermarked(events, ts, late)
    aggs = [F.count("*").alias("n"), *([F.sum(value).alias("total")] if value else [])]
    g = x.filter(F.col(ts).isNotNull()).groupBy(F.window(ts, window).alias("w"), F.col(key)).agg(*aggs)
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in g.columns if c != "w"])


def sessions(events: DataFrame, ts: str, key: str, *, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(start, end, key, n) of each key's bursts of events no further apart than ``gap``."""
    x = _watermarked(events, ts, late)
    g = x.filter(F.col(ts).isNotNull()).groupBy(F.session_window(ts, gap).alias("w"), F.col(key)).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def deduplicated(rows: DataFrame, keys: list[str], ts: str, late: str = "30 days") -> DataFrame:
    """First delivery of each key; state is kept for ``late``."""
    return _watermarked(rows, ts, late).dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)


def extract_stream(chunks: DataFrame, extract: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, chunk: str = "chunk_id") -> StreamingQuery:
    """Extracts each new chunk once: a batch leaves out chunks that ``target`` already holds, so a repeated batch adds nothing."""

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        todo = batch.dropDuplicates([chunk])
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            todo = todo.join(spark.read.parquet(target).select(F.col("chunk_id").alias(chunk)), chunk, "left_anti")
        extract(todo).write.mode("append").parquet(target)

    return chunks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
