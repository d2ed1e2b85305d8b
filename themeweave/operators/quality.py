"""Question-agnostic checks of chunks and phrases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from themeweave.functions.text import META_VOCABULARY, bigrams, c, is_missing_text, is_privacy_text, looks_like_bibliography, looks_like_table_row, vocab_tokens


def flag_chunk_quality(chunks: DataFrame, text: str = "text") -> DataFrame:
    """``chunks`` with likely_bibliography and likely_table_row; nothing is dropped."""
    return chunks.withColumns({"likely_bibliography": looks_like_bibliography(text), "likely_table_row": looks_like_table_row(text)})


def quality_summary(chunks: DataFrame, text: str = "text") -> DataFrame:
    f = flag_chunk_quality(chunks, text)
    return f.agg(
        F.count("*").alias("n_chunks"),
        F.count_if("likely_bibliography").alias("n_bibliography"),
        F.count_if("likely_table_row").alias("n_table_row"),
        F.count_if(F.col("likely_bibliography") | F.col("likely_table_row")).alias("n_flagged"),
        F.count_if(is_privacy_text(text)).alias("n_privacy"),
    )


def filter_missing_source_text(df: DataFrame, text: str = "text") -> DataFrame:
    return df.filter(~is_missing_text(text))


def count_by(df: DataFrame, key: str) -> DataFrame:
    """Rows per non-null key."""
    return df.filter(c(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))


def value_shares(df: DataFrame, key: str) -> DataFrame:
    """Counts and shares of the non-null values of a column."""
    counts = count_by(df, key)
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(key, "n", (F.col("n") / F.col("total")).alias("share"))  # one row


def histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, n) of equal-width bins over the observed range; the maximum falls in the last bin."""
    x = df.select(c(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    r = x.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    b = x.crossJoin(F.broadcast(r))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    k = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / F.when(width > 0, width)), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    return b.withColumn("bin", k).groupBy("bin", "lo", "hi").agg(F.count("*").alias("n")).select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "n")


def describe_chunks(chunks: DataFrame, words: str = "word_count", year: str = "year", tech: str = "technology_meta", doc: str = "source_file") -> DataFrame:
    return chunks.agg(
        F.count("*").alias("n_chunks"),
        F.avg(words).alias("mean_words"),
        F.percentile(words, F.lit(0.5)).alias("median_words"),
        F.min(year).alias("min_year"),
        F.max(year).alias("max_year"),
        F.count_distinct(tech).alias("n_technologies"),
        F.count_distinct(doc).alias("n_documents"),
    )


def vocabulary_frequency(df: DataFrame, phrase: str, *, top_n: int = 100, meta: Sequence[str] = META_VOCABULARY) -> DataFrame:
    """(term, n, pct_of_phrases, is_meta_vocab) of the most frequent tokens and token pairs; ties by term."""
    x = df.select(c(phrase).alias("p")).filter(F.col("p").isNotNull())
    total = x.agg(F.greatest(F.count("*"), F.lit(1)).alias("total"))
    t = x.select(vocab_tokens("p").alias("t"))
    terms = t.select(F.explode_outer(F.concat("t", bigrams(F.col("t")))).alias("term")).filter(F.col("term").isNotNull()).groupBy("term").agg(F.count("*").alias("n"))
    top = terms.orderBy(F.desc("n"), "term").limit(top_n)
    return top.crossJoin(F.broadcast(total)).select("term", "n", F.round(100 * F.col("n") / F.col("total"), 2).alias("pct_of_phrases"), F.lower("term").isin(*[m.lower() for m in meta]).alias("is_meta_vocab"))


def label_set_check(df: DataFrame, key: str, expected: DataFrame, expected_key: str) -> DataFrame:
    """(label, status): labels that are only expected ('missing') or only observed ('unexpected')."""
    seen = df.select(c(key).alias("label")).filter(F.col("label").isNotNull()).distinct()
    want = expected.select(c(expected_key).alias("label")).filter(F.col("label").isNotNull()).distinct()
    return want.join(seen, "label", "left_anti").withColumn("status", F.lit("missing")).unionByName(seen.join(want, "label", "left_anti").withColumn("status", F.lit("unexpected")))


def metadata_join_lenient(docs: DataFrame, metadata: DataFrame, doc: str, key: str = "filename") -> DataFrame:
    """Documents with technology and year of their metadata; 'Unknown' and null where there is none."""
    m = metadata.select(c(key).alias("_k"), F.col("technology").alias("_t"), F.col("year").alias("_y"))
    out = docs.drop("technology", "technology_meta", "year").join(m, c(doc) == F.col("_k"), "left")
    return out.withColumn("technology_meta", F.coalesce("_t", F.lit("Unknown"))).withColumnRenamed("_y", "year").drop("_k", "_t")


def metadata_join_strict(docs: DataFrame, metadata: DataFrame, doc: str, key: str = "filename") -> DataFrame:
    """As the lenient join, but raises if a document has no metadata (names a few)."""
    missing = docs.select(c(doc).alias("_k")).distinct().join(metadata.select(c(key).alias("_k")), "_k", "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"documents without metadata, among them {[r[0] for r in missing]}")
    return metadata_join_lenient(docs, metadata, doc, key)
