"""Documents to chunks: paragraphs where there are enough, packed sentences elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from themeweave.functions.text import c, collapse_ws, repack_sentences, split_paragraphs, split_sentences, word_count, words


def line_blocks(text: str | Column) -> Column:
    """The text's non-empty lines as layout blocks."""
    return F.filter(F.transform(F.split(c(text), r"\n"), collapse_ws), lambda x: x != "")


def html_blocks(html: str | Column) -> Column:
    """Text of the block-level elements of a page, tags removed."""
    body = F.regexp_replace(c(html), r"(?is)<(script|style)\b.*?</\1>", " ")
    cut = F.split(F.regexp_replace(body, r"(?i)</?(?:p|div|li|h[1-6]|td|th|tr|br|section|article|blockquote|ul|ol|table)\b[^>]*>", "\u0001"), "\u0001")
    return F.filter(F.transform(cut, lambda x: collapse_ws(F.regexp_replace(x, r"<[^>]+>", " "))), lambda x: x != "")


def chunk_candidates(docs: DataFrame, text: str, blocks: str | None = None, *, min_words: int = 40, min_chars: int = 80, max_words: int = 500, target: int = 300, min_paragraphs: int = 3) -> DataFrame:
    """All columns of ``docs`` but the text, with (doc_case, blocks_used, n_oversized, chunk_index, method, candidate): one row per chunk candidate.

    Case 1: enough substantive paragraphs, all within the limit; case 2: some of them longer, which are
    split into packed sentences; case 3: too few, so the whole text is split into packed sentences.
    ``chunk_index`` counts candidates before any is dropped. Null texts give no row. Expressions only.
    """
    substantive = lambda a: F.size(F.filter(a, lambda p: (word_count(p) >= min_words) & (F.length(p) >= min_chars)))
    own = F.coalesce(c(blocks), F.array().cast("array<string>")) if blocks else F.array().cast("array<string>")
    keep = [x for x in docs.columns if x not in (text, blocks)]
    d = docs.filter(c(text).isNotNull()).withColumn("_blocks", own)
    d = d.withColumn("blocks_used", substantive(F.col("_blocks")) >= min_paragraphs)
    d = d.withColumn("_paras", F.when(F.col("blocks_used"), F.col("_blocks")).otherwise(split_paragraphs(text)))
    d = d.withColumn("_case3", substantive(F.col("_paras")) < min_paragraphs)
    d = d.withColumn("n_oversized", F.when(F.col("_case3"), 0).otherwise(F.size(F.filter("_paras", lambda p: word_count(p) > max_words))))
    named = lambda a, m: F.transform(a, lambda x: F.struct(F.lit(m).alias("method"), x.alias("candidate")))
    packed = named(repack_sentences(split_sentences(text), target), "sentence_fallback")
    one = lambda p: F.when(word_count(p) > max_words, named(repack_sentences(split_sentences(p), target), "sentence_split")).otherwise(named(F.array(p), "paragraph"))
    d = d.withColumn("_cand", F.when(F.col("_case3"), packed).otherwise(F.flatten(F.transform(F.filter(F.transform("_paras", collapse_ws), lambda p: p != ""), one))))
    d = d.withColumn("doc_case", F.when(F.col("_case3"), 3).when(F.col("n_oversized") > 0, 2).otherwise(1))
    # outer: an inner explode would make the optimizer test the array's size in a pushed-down filter, computing it twice
    out = d.select(*keep, "doc_case", "blocks_used", "n_oversized", F.posexplode_outer("_cand").alias("chunk_index", "_x")).filter(F.col("chunk_index").isNotNull())
    return out.select(*keep, "doc_case", "blocks_used", "n_oversized", "chunk_index", "_x.method", F.col("_x.candidate").alias("candidate"))


def keep_chunks(candidates: DataFrame, doc: str, *, min_words: int = 40, min_chars: int = 80, max_words: int = 500) -> DataFrame:
    """Candidates within the floors, cut to ``max_words``, with chunk_id ``<doc>__<chunk_index>``."""
    x = candidates.withColumn("_t", collapse_ws("candidate")).withColumn("_n", word_count("_t"))
    x = x.filter((F.col("_t") != "") & (F.col("_n") >= min_words) & (F.length("_t") >= min_chars))
    x = x.withColumn("was_truncated", F.col("_n") > max_words)
    x = x.withColumn("text", F.when(F.col("was_truncated"), F.concat_ws(" ", F.slice(words("_t"), 1, max_words))).otherwise(F.col("_t")))
    x = x.withColumn("word_count", F.least("_n", F.lit(max_words)).cast("int")).withColumn("chunk_id", F.concat(c(doc).cast("string"), F.lit("__"), F.col("chunk_index").cast("string")))
    return x.withColumnRenamed("method", "chunking_method").drop("_t", "_n", "candidate", "doc_case", "blocks_used", "n_oversized")


def chunk_documents(docs: DataFrame, doc: str, text: str, blocks: str | None = None, *, min_words: int = 40, min_chars: int = 80, max_words: int = 500, target: int = 300, min_paragraphs: int = 3) -> DataFrame:
    """Chunks of every document; see ``chunk_candidates`` and ``keep_chunks``."""
    cand = chunk_candidates(docs, text, blocks, min_words=min_words, min_chars=min_chars, max_words=max_words, target=target, min_paragraphs=min_paragraphs)
    return keep_chunks(cand, doc, min_words=min_words, min_chars=min_chars, max_words=max_words)


def chunk_stats(candidates: DataFrame, doc: str, *, min_words: int = 40, min_chars: int = 80, max_words: int = 500) -> DataFrame:
    """(stat, value): what became of the candidates and which case each document took."""
    x = candidates.withColumn("_t", collapse_ws("candidate")).withColumn("_n", word_count("_t"))
    long = F.col("_n") >= min_words
    per = x.agg(
        F.count("*").alias("paragraphs_seen"),
        F.count_if((F.col("_t") != "") & long & (F.length("_t") >= min_chars)).alias("paragraphs_kept"),
        F.count_if(long & (F.length("_t") >= min_chars) & (F.col("_n") > max_words)).alias("paragraphs_truncated"),
        F.count_if((F.col("_t") != "") & ~long).alias("paragraphs_below_word_floor"),
        F.count_if((F.col("_t") != "") & long & (F.length("_t") < min_chars)).alias("paragraphs_below_char_floor"),
        F.count_if(F.col("_t") == "").alias("paragraphs_empty"),
        F.count_if(F.col("method") == "sentence_split").alias("chunks_from_sentence_split"),
        F.count_if(F.col("method") == "sentence_fallback").alias("chunks_from_sentence_fallback"),
    )
    by = candidates.groupBy(doc).agg(F.max("doc_case").alias("k"), F.max("n_oversized").alias("o"), F.max("blocks_used").alias("b")).agg(
        F.count_if(F.col("k") == 1).alias("documents_paragraph_only"),
        F.count_if(F.col("k") == 2).alias("documents_paragraph_with_split"),
        F.count_if(F.col("k") == 3).alias("documents_sentence_fallback"),
        F.coalesce(F.sum("o"), F.lit(0)).alias("oversized_paragraphs_split"),
        F.count_if(F.col("b")).alias("documents_blocks_primary"),
        F.count_if(~F.col("b")).alias("documents_text_newline_primary"),
    )
    both = per.crossJoin(by)  # one row each
    return both.select(F.explode(F.array(*[F.struct(F.lit(k).alias("stat"), F.col(k).cast("long").alias("value")) for k in both.columns])).alias("x")).select("x.*")


def doc_summary(chunks: DataFrame, doc: str, method: str = "chunking_method", truncated: str = "was_truncated") -> DataFrame:
    """Per document: chunks kept, methods used, truncated chunks."""
    return chunks.groupBy(doc).agg(F.count("*").alias("chunks_kept"), F.concat_ws("+", F.sort_array(F.collect_set(method))).alias("methods"), F.count_if(c(truncated)).alias("truncated"))
