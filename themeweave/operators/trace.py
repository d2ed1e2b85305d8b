"""Paragraph traceability, samples for human validation and prompt studies, evidence packs."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window, functions as F

from themeweave.functions.text import html_escape, paragraph_id


def paragraph_trace(chunks: DataFrame, phrases: DataFrame, labels: DataFrame, bridge: DataFrame, *, kind: str = "concern", chunk: str = "chunk_id", cluster: str = "cluster_id", phrase: str = "phrase", order: str = "phrase_id", doc: str = "source_file", index: str = "chunk_index") -> DataFrame:
    """Chunks with the ordered arrays extracted_<kind>s, cluster_ids, cluster_labels, the sorted distinct framing_lenses, and paragraph_id.

    Lists are per chunk and short; chunks without phrases get empty ones.
    """
    x = phrases.join(labels.select(cluster, "label"), cluster, "left").select(chunk, F.struct(F.col(order).alias("o"), F.col(phrase).alias("p"), F.col(cluster).alias("c"), F.col("label").alias("l")).alias("s"))
    g = x.groupBy(chunk).agg(F.sort_array(F.collect_list("s")).alias("s"))
    part = lambda f: F.coalesce(F.filter(F.transform("s", lambda e: e[f]), lambda v: v.isNotNull()), F.array())
    lens = phrases.select(chunk, cluster).distinct().join(bridge.select(cluster, "lens").distinct(), cluster).groupBy(chunk).agg(F.sort_array(F.collect_set("lens")).alias("framing_lenses"))
    out = chunks.join(g, chunk, "left").join(lens, chunk, "left")
    empty = F.array().cast("array<string>")
    return out.withColumns({
        f"extracted_{kind}s": F.coalesce(part("p"), empty),
        "cluster_ids": part("c"),
        "cluster_labels": F.coalesce(part("l"), empty),
        "framing_lenses": F.coalesce("framing_lenses", empty),
        "paragraph_id": paragraph_id(doc, index),
    }).drop("s")


def explode_trace(trace: DataFrame, clusters: str = "cluster_ids") -> DataFrame:
    """One row per paragraph and cluster; entries that aren't numbers are dropped."""
    x = trace.select("*", F.explode(clusters).alias("_c")).drop(clusters)
    return x.withColumn("cluster_id", F.expr("try_cast(_c AS int)")).drop("_c").filter(F.col("cluster_id").isNotNull())


def _hash_order(ident: str, seed: int) -> list[Column]:
    return [F.md5(F.concat(F.col(ident).cast("string"), F.lit(f":{seed}"))), F.col(ident)]


#: Parts a stratum is hashed into before its first ranking.
PARTS = 32


def _first_of(df: DataFrame, stratum: str, ident: str, most: int, seed: int) -> DataFrame:
    """``df`` with the place ``_r`` in hash order of the first ``most`` rows of each stratum, whose parts are ranked apart first, so no task sorts a whole stratum."""
    order = _hash_order(ident, seed)
    parts = df.withColumn("_p", F.pmod(F.xxhash64(ident), F.lit(PARTS))).withColumn("_r", F.row_number().over(Window.partitionBy(stratum, "_p").orderBy(*order))).filter(F.col("_r") <= most)
    return parts.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).filter(F.col("_r") <= most).drop("_p")


def quota_sample(df: DataFrame, stratum: str, ident: str, *, n: int = 250, floor: int = 10, cap: float = 1.5, seed: int = 42) -> DataFrame:
    """Rows by stratum in proportion to its size, at least ``floor`` where there are as many; at most ``cap * n`` in all.

    Rows are taken in hash order, so the sample is the same on any cluster; null strata are left out.
    """
    x = df.filter(F.col(stratum).isNotNull())
    size = x.groupBy(stratum).agg(F.count("*").alias("_size"))
    total = size.agg(F.sum("_size").alias("_total"))
    q = size.crossJoin(F.broadcast(total)).withColumn("_quota", F.least("_size", F.greatest(F.lit(floor), F.round(n * F.col("_size") / F.col("_total")).cast("long"))))  # one row
    take = _first_of(x, stratum, ident, max(n, floor), seed).join(q.select(stratum, "_quota"), stratum).filter(F.col("_r") <= F.col("_quota"))
    return take.orderBy(*_hash_order(ident, seed + 1)).limit(int(cap * n)).drop("_quota", "_r")


def validation_sample(chunks: DataFrame, phrases: DataFrame, *, tech: str = "technology_meta", chunk: str = "chunk_id", phrase: str = "phrase", order: str = "phrase_id", none: str = "(NO_CONCERN)", n: int = 250, floor: int = 10, cap: float = 1.5, seed: int = 42) -> DataFrame:
    """A quota sample of chunks with their phrases joined by ' | ', their number, and blank columns for human judges."""
    s = quota_sample(chunks, tech, chunk, n=n, floor=floor, cap=cap, seed=seed)
    p = phrases.join(s.select(chunk), chunk, "left_semi").groupBy(chunk).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(phrase).alias("p")))).alias("_s"))
    text = F.concat_ws(" | ", F.transform("_s", lambda e: e["p"]))
    out = s.join(p, chunk, "left").withColumn("model_phrases", F.when(F.col("_s").isNull(), none).otherwise(text)).withColumn("n_phrases", F.coalesce(F.size("_s"), F.lit(0)))
    return out.drop("_s").withColumns({"human_phrases": F.lit(""), "human_agrees": F.lit("")})


def even_sample(df: DataFrame, stratum: str, ident: str, n: int, seed: int = 42) -> DataFrame:
    """``n // strata`` rows of each stratum in hash order, one per identifier."""
    x = df.filter(F.col(stratum).isNotNull()).dropDuplicates([ident])
    k = x.agg(F.count_distinct(stratum).alias("_k"))
    return _first_of(x, stratum, ident, n, seed).crossJoin(F.broadcast(k)).filter(F.col("_r") <= F.floor(F.lit(n) / F.col("_k"))).drop("_k", "_r")  # one row


def evidence_fragments(trace: DataFrame, *, kind: str = "concern", tech: str = "technology_meta", doc: str = "source_file", index: str = "chunk_index", text: str = "text") -> DataFrame:
    """(tech, doc, part, index, html): HTML lines of each report: its opening (part 0), its paragraphs (1) by index, with tags only where there are any, and its closing (2).

    A report is never brought together: in the order of the first four columns the lines form the pages."""
    tags = lambda name, col: F.when(F.size(col) > 0, F.concat(F.lit(f"<p class='{name}'>"), html_escape(F.concat_ws("; ", F.transform(col, lambda v: v.cast("string")))), F.lit("</p>"))).otherwise("")
    one = F.concat(F.lit("<div><h4>"), html_escape(F.coalesce("paragraph_id", F.lit(""))), F.lit("</h4><p>"), html_escape(F.coalesce(text, F.lit(""))), F.lit("</p>"), tags("phrases", f"extracted_{kind}s"), tags("lenses", "framing_lenses"), F.lit("</div>"))
    paragraphs = trace.select(tech, doc, F.lit(1).alias("part"), F.col(index).alias("index"), one.alias("html"))
    title = F.concat(F.lit("<section><h3>"), html_escape(F.coalesce(doc, F.lit("Unknown"))), F.lit("</h3>"))
    ends = F.explode(F.array(F.struct(F.lit(0).alias("part"), title.alias("html")), F.struct(F.lit(2).alias("part"), F.lit("</section>").alias("html")))).alias("x")
    reports = trace.select(tech, doc).distinct().select(tech, doc, ends).select(tech, doc, "x.part", F.lit(None).cast(dict(trace.dtypes)[index]).alias("index"), "x.html")
    return paragraphs.unionByName(reports)


def export_evidence_pack(trace: DataFrame, folder: str, *, kind: str = "concern", tech: str = "technology_meta", doc: str = "source_file") -> dict[str, str]:
    """Writes the trace as CSV, JSON lines and Parquet, and HTML fragments by technology and report; gives the paths."""
    base = f"{folder}/{kind}_traceability_paragraphs"
    flat = trace.select(*[F.to_json(k).alias(k) if t.startswith(("array", "map", "struct")) else F.col(k) for k, t in trace.dtypes])
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{base}.csv")
    trace.write.mode("overwrite").json(f"{base}.jsonl")
    trace.write.mode("overwrite").parquet(f"{base}.parquet")
    lines = evidence_fragments(trace, kind=kind, tech=tech, doc=doc)
    lines.repartitionByRange(tech, doc, "part", "index").sortWithinPartitions(tech, doc, "part", "index").select("html").write.mode("overwrite").text(f"{base}.html")
    return {ext: f"{base}.{ext}" for ext in ("csv", "jsonl", "parquet", "html")}


