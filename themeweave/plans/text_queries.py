"""Row functions, chunk quality and extraction bookkeeping over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from themeweave.functions import text as T
from themeweave.operators import chunking as C, extraction as E, quality as Q
from themeweave.plans.inputs import CH, EX, TARGET, chunks, extractions, label_of, label_sql, ph, phrases, pretty_sql
from themeweave.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_W = r"[\s\x0B\x1C-\x1F\x{85}\pZ]"
_WS = f"regexp_replace(text, '{_W}+', ' ', 'g')"
_FLAT = f"trim({_WS})"
_WORDS = f"list_filter(string_split_regex(text, '{_W}+'), lambda x: x <> '')"
_SENT = rf"list_filter(list_transform(string_split(regexp_replace({_FLAT}, '([.!?])\s+([A-Z\p{{Nd}}])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"
_PARA = rf"list_filter(list_transform(string_split_regex(text, '\n{_W}*\n'), lambda x: trim(regexp_replace(x, '{_W}+', ' ', 'g'))), lambda x: x <> '')"
_TOK = r"list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda x: length(x) > 3)"
_VOC = r"list_filter(regexp_extract_all(lower(text), '[\pL\pN_]+'), lambda x: regexp_full_match(x, '[a-z]{3,}'))"


def _any_word(terms, column: str) -> str:
    alt = "|".join(t.replace("-", r"\-") for t in terms)
    return rf"coalesce(regexp_matches({column}, '(?i)(^|[^\pL\pN_])({alt})($|[^\pL\pN_])'), false)"


def _chunk_fn(name: str, expr, sql: str) -> None:
    """A function of each chunk's text: (chunk_id, value)."""
    QUERIES[name] = lambda s, d: chunks(s, d).select("chunk_id", expr("text").alias("value"))
    ORACLES[name] = f"WITH {CH} SELECT chunk_id, {sql} AS value FROM ch"


_chunk_fn("collapse_ws", T.collapse_ws, _FLAT)
_chunk_fn("word_count", T.word_count, f"CASE WHEN text IS NOT NULL THEN len({_WORDS}) END")
_chunk_fn("split_sentences", lambda c: F.to_json(T.split_sentences(c)), f"CAST(to_json({_SENT}) AS VARCHAR)")
_chunk_fn("split_paragraphs", lambda c: F.to_json(T.split_paragraphs(c)), f"CAST(to_json({_PARA}) AS VARCHAR)")
_chunk_fn("truncate_words", lambda c: T.truncate_words(c, 20), f"array_to_string(list_slice({_WORDS}, 1, 20), ' ')")
_chunk_fn("head_chars", T.head_chars, "substring(text, 1, 2000)")
_chunk_fn("tokenize", lambda c: F.array_join(T.tokenize(c), " "), f"array_to_string({_TOK}, ' ')")
_chunk_fn("vocab_tokens", lambda c: F.array_join(T.vocab_tokens(c), " "), f"array_to_string({_VOC}, ' ')")
_chunk_fn("bigrams", lambda c: F.array_join(T.bigrams(T.vocab_tokens(c)), "|"), f"array_to_string(list_transform(range(1, len({_VOC})), lambda i: {_VOC}[i] || ' ' || {_VOC}[i + 1]), '|')")
_chunk_fn("is_privacy_text", T.is_privacy_text, _any_word(T.PRIVACY_TERMS, "text"))
_chunk_fn("looks_like_table_row", T.looks_like_table_row, "coalesce(length(text) - length(replace(text, '%', '')) >= 2, false)")
_chunk_fn("contains_tech_term", lambda c: T.contains_term(c, T.TECH_TERMS_WIDE), _any_word(T.TECH_TERMS_WIDE, "text"))
_chunk_fn("html_escape", T.html_escape, "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')")
_chunk_fn("clean_for_xlsx", lambda c: T.clean_control(F.concat(F.lit("\x0b"), c, F.lit("\x00\t"))), r"regexp_replace(chr(11) || text || chr(9), '[\x01-\x08\x0B\x0C\x0E-\x1F]', '', 'g')")
_chunk_fn("is_missing_text", T.is_missing_text, f"text IS NULL OR regexp_full_match(text, '{_W}*')")
# the corpus has no bibliographies: the positive cases are added to every text's own
_BIB = r"regexp_matches(x, '(?i)(^|[^\pL\pN_])(et al\.?|doi:|https?://|pp?\.\s*\d+|vol\.|isbn|issn)') AND regexp_matches(x, '\([12]\d{3}\)')"
QUERIES["looks_like_bibliography"] = lambda s, d: chunks(s, d).select("chunk_id", T.looks_like_bibliography("text").alias("own"), T.looks_like_bibliography(F.concat(F.lit("Smith et al. doi:10.1000/xyz (2020) "), "text")).alias("cited"))
ORACLES["looks_like_bibliography"] = rf"""WITH {CH} SELECT chunk_id,
  coalesce(regexp_matches(text, '(?i)\b(et al\.?|doi:|http(s)?://|pp?\.\s*\d+|vol\.|isbn|issn)\b') AND regexp_matches(text, '\([12]\d{{3}}\)'), false) AS own,
  text IS NOT NULL AS cited FROM ch"""


def parse_year(s, d):
    """Years from free text: file names, and years with months appended."""
    m = table(s, d, "metadata").select("filename", "year").distinct()
    return m.select("filename", "year", T.parse_year("filename").alias("from_name"), T.parse_year(F.concat(F.lit("Report "), F.col("year").cast("string"), F.lit("-04"))).alias("from_text"))


QUERIES["parse_year"] = parse_year
_Y = "TRY_CAST(left(regexp_replace({0}, '[^0-9]', '', 'g'), 4) AS INTEGER)"
_YR = "CASE WHEN length(regexp_replace({0}, '[^0-9]', '', 'g')) >= 4 AND " + _Y + " BETWEEN 1900 AND 2100 THEN " + _Y + " END"
ORACLES["parse_year"] = f"SELECT DISTINCT filename, year, {_YR.format('filename')} AS from_name, {_YR.format(chr(39) + 'Report ' + chr(39) + ' || year || ' + chr(39) + '-04' + chr(39))} AS from_text FROM metadata"

QUERIES["assign_window"] = lambda s, d: phrases(s, d).select("phrase_id", T.assign_window("year").alias("time_window"))
WIN = "CASE WHEN year IS NULL THEN NULL WHEN year <= 2017 THEN '2004-2017' WHEN year <= 2020 THEN '2018-2020' WHEN year <= 2023 THEN '2021-2023' ELSE '2024-2025' END"
ORACLES["assign_window"] = f"WITH {ph()} SELECT phrase_id, {WIN} AS time_window FROM ph"


def _tech_case(column: str) -> str:
    return "CASE " + " ".join(rf"WHEN regexp_matches(lower({column}), '(^|[^\pL\pN_]){t}($|[^\pL\pN_])') THEN '{t}'" for t in (*T.TECH_WORDS, "sensor")) + " END"


QUERIES["first_tech_word"] = lambda s, d: phrases(s, d).select("phrase_id", T.first_tech_word("phrase", (*T.TECH_WORDS, "sensor")).alias("tech_word"))
ORACLES["first_tech_word"] = f"WITH {ph()} SELECT phrase_id, {_tech_case('phrase')} AS tech_word FROM ph"
QUERIES["pretty_label"] = lambda s, d: phrases(s, d).filter("cluster_id IS NOT NULL").select("phrase_id", T.pretty_label("cluster_id", label_of()).alias("label"))
ORACLES["pretty_label"] = f"WITH {ph()} SELECT phrase_id, {pretty_sql()} AS label FROM ph WHERE cluster_id IS NOT NULL"
QUERIES["heatmap_label"] = lambda s, d: phrases(s, d).filter("cluster_id IS NOT NULL").select("phrase_id", T.heatmap_label("cluster_id", label_of()).alias("label"))
_L = f"coalesce({label_sql()}, 'Cluster ' || cluster_id)"
ORACLES["heatmap_label"] = f"WITH {ph()} SELECT phrase_id, CASE WHEN length({_L}) > 40 THEN left({_L}, 40) || '…' ELSE {_L} END AS label FROM ph WHERE cluster_id IS NOT NULL"
QUERIES["paragraph_id"] = lambda s, d: chunks(s, d).select("chunk_id", T.paragraph_id("source_file", "chunk_index").alias("paragraph_id"))
ORACLES["paragraph_id"] = f"WITH {CH} SELECT chunk_id, source_file || '::p' || chunk_index AS paragraph_id FROM ch"
QUERIES["is_ai_label"] = lambda s, d: chunks(s, d).select("chunk_id", T.is_target_label("technology").alias("is_target"))
ORACLES["is_ai_label"] = f"WITH {CH} SELECT chunk_id, coalesce(lower(trim(technology)) IN ('ai', 'artificial intelligence'), false) AS is_target FROM ch"
QUERIES["parse_listcol"] = lambda s, d: extractions(s, d).select("extraction_id", F.array_join(T.parse_listcol(F.to_json("retained_phrases")), "|").alias("phrases"))
ORACLES["parse_listcol"] = f"WITH {EX} SELECT extraction_id, coalesce(array_to_string(retained_phrases, '|'), '') AS phrases FROM ex"

# --- chunk quality ------------------------------------------------------------------------------

QUERIES["flag_chunk_quality"] = lambda s, d: Q.flag_chunk_quality(chunks(s, d)).select("chunk_id", "likely_bibliography", "likely_table_row")
ORACLES["flag_chunk_quality"] = ORACLES["looks_like_bibliography"].replace("AS own", "AS likely_bibliography").replace("text IS NOT NULL AS cited", "length(text) - length(replace(text, '%', '')) >= 2 AS likely_table_row")
QUERIES["quality_summary"] = lambda s, d: Q.quality_summary(chunks(s, d))
ORACLES["quality_summary"] = f"""WITH {CH}, f AS ({ORACLES["flag_chunk_quality"].split("ch AS", 1)[1].split(")", 1)[1].strip()}), p AS (SELECT count(*) AS n FROM ch WHERE {_any_word(T.PRIVACY_TERMS, "text")})
  SELECT count(*) AS n_chunks, count(*) FILTER (likely_bibliography) AS n_bibliography, count(*) FILTER (likely_table_row) AS n_table_row,
  count(*) FILTER (likely_bibliography OR likely_table_row) AS n_flagged, (SELECT n FROM p) AS n_privacy FROM f"""
QUERIES["filter_missing_source_text"] = lambda s, d: Q.filter_missing_source_text(table(s, d, "documents")).select("doc_id")
ORACLES["filter_missing_source_text"] = f"SELECT doc_id FROM documents WHERE NOT (text IS NULL OR regexp_full_match(text, '{_W}*'))"
for _key in ("technology_meta", "year", "source_file"):
    QUERIES[f"count_by_{_key}"] = lambda s, d, k=_key: Q.count_by(chunks(s, d), k)
    ORACLES[f"count_by_{_key}"] = f"WITH {CH} SELECT {_key}, count(*) AS n FROM ch WHERE {_key} IS NOT NULL GROUP BY ALL"
QUERIES["value_counts_normalized"] = lambda s, d: Q.value_shares(phrases(s, d), "technology_meta").select("technology_meta", "n", F.round("share", 6).alias("share"))
ORACLES["value_counts_normalized"] = f"WITH {ph()} SELECT technology_meta, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM ph WHERE technology_meta IS NOT NULL GROUP BY ALL"
QUERIES["word_histogram"] = lambda s, d: Q.histogram(chunks(s, d).withColumn("w", T.word_count("text")), "w").select("bin", F.round("low", 6).alias("low"), "n")
ORACLES["word_histogram"] = f"""WITH {CH}, w AS (SELECT len({_WORDS}) AS v FROM ch WHERE text IS NOT NULL), r AS (SELECT CAST(min(v) AS DOUBLE) AS lo, CAST(max(v) AS DOUBLE) AS hi FROM w)
  SELECT CAST(least(floor((v - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin, round(lo + CAST(least(floor((v - lo) / ((hi - lo) / 30)), 29) AS INTEGER) * ((hi - lo) / 30), 6) AS low, count(*) AS n FROM w, r GROUP BY ALL"""
QUERIES["describe_chunks"] = lambda s, d: Q.describe_chunks(chunks(s, d)).select("n_chunks", F.round("mean_words", 6).alias("mean_words"), "median_words", "min_year", "max_year", "n_technologies", "n_documents")
ORACLES["describe_chunks"] = f"WITH {CH} SELECT count(*) AS n_chunks, round(avg(word_count), 6) AS mean_words, quantile_cont(CAST(word_count AS DOUBLE), 0.5) AS median_words, min(year) AS min_year, max(year) AS max_year, count(DISTINCT technology_meta) AS n_technologies, count(DISTINCT source_file) AS n_documents FROM ch"
for _t in ("concern", "benefit"):
    QUERIES[f"vocabulary_frequency_{_t}"] = lambda s, d, t=_t: Q.vocabulary_frequency(phrases(s, d, t), "phrase")
    ORACLES[f"vocabulary_frequency_{_t}"] = f"""WITH {ph(_t)}, v AS (SELECT {_VOC.replace('text', 'phrase')} AS t FROM ph WHERE phrase IS NOT NULL),
      w AS (SELECT unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM v)
      SELECT term, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM v), 2) AS pct_of_phrases, term IN ({", ".join(f"'{m}'" for m in T.META_VOCABULARY)}) AS is_meta_vocab
      FROM w GROUP BY term ORDER BY n DESC, term LIMIT 100"""
QUERIES["label_set_check"] = lambda s, d: Q.label_set_check(chunks(s, d), "technology_meta", table(s, d, "technologies"), "name")
ORACLES["label_set_check"] = f"""WITH {CH}, a AS (SELECT DISTINCT technology_meta AS label FROM ch WHERE technology_meta IS NOT NULL), b AS (SELECT DISTINCT name AS label FROM technologies)
  SELECT label, 'missing' AS status FROM b WHERE label NOT IN (SELECT label FROM a) UNION ALL SELECT label, 'unexpected' FROM a WHERE label NOT IN (SELECT label FROM b)"""
QUERIES["metadata_join_lenient"] = lambda s, d: Q.metadata_join_lenient(table(s, d, "documents"), table(s, d, "metadata").dropDuplicates(["filename"]), "source").select("doc_id", "technology_meta", "year")
ORACLES["metadata_join_lenient"] = "SELECT doc_id, coalesce(m.technology, 'Unknown') AS technology_meta, m.year FROM documents d LEFT JOIN metadata m ON d.source = m.filename"
QUERIES["metadata_join_strict"] = lambda s, d: Q.metadata_join_strict(chunks(s, d), table(s, d, "metadata").dropDuplicates(["filename"]), "source_file").select("chunk_id", "technology_meta", "year")
ORACLES["metadata_join_strict"] = f"WITH {CH} SELECT chunk_id, coalesce(m.technology, 'Unknown') AS technology_meta, m.year FROM ch LEFT JOIN metadata m ON ch.source_file = m.filename"

# --- chunking -----------------------------------------------------------------------------------


def _docs(s, d):
    return table(s, d, "documents").select("doc_id", "text").withColumn("blocks", C.line_blocks("text"))


QUERIES["chunk_documents"] = lambda s, d: C.chunk_documents(_docs(s, d), "doc_id", "text", "blocks", min_words=10, min_chars=40).select("chunk_id", "doc_id", "chunk_index", "text", "word_count", "was_truncated", "chunking_method")
QUERIES["chunk_documents_split"] = lambda s, d: C.chunk_documents(_docs(s, d), "doc_id", "text", "blocks", min_words=5, min_chars=10, max_words=40, target=25).select("chunk_id", "chunk_index", "word_count", "was_truncated", "chunking_method")
QUERIES["chunk_stats"] = lambda s, d: C.chunk_stats(C.chunk_candidates(_docs(s, d), "text", "blocks", min_words=10, min_chars=40, max_words=60, target=40), "doc_id", min_words=10, min_chars=40, max_words=60)
QUERIES["repack_sentences"] = lambda s, d: table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", F.posexplode_outer(T.repack_sentences(T.split_sentences("text"), 60)).alias("piece", "text")).filter("piece IS NOT NULL")
QUERIES["doc_summary"] = lambda s, d: C.doc_summary(chunks(s, d), "source_file")
ORACLES["doc_summary"] = f"WITH {CH} SELECT source_file, count(*) AS chunks_kept, coalesce(array_to_string(list_sort(list(DISTINCT chunking_method) FILTER (chunking_method IS NOT NULL)), '+'), '') AS methods, count(*) FILTER (was_truncated) AS truncated FROM ch GROUP BY ALL"

# --- extraction ----------------------------------------------------------------------------------

_OFF = rf"list_slice(list_filter({_SENT}, lambda x: len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')) BETWEEN 3 AND 10), 1, 3)"
QUERIES["extract_phrases"] = lambda s, d: E.extract_offline(chunks(s, d), "concern").select("chunk_id", F.array_join("raw_phrases", "|").alias("raw"), F.array_join("retained_phrases", "|").alias("retained"), "sentinel_returned")
_KEEP = "list_filter(raw, lambda p: " + _tech_case("p").replace(" ".join(rf"WHEN regexp_matches(lower(p), '(^|[^\pL\pN_]){t}($|[^\pL\pN_])') THEN '{t}'" for t in ("sensor",)), "").rstrip() + " IS NULL)"
ORACLES["extract_phrases"] = f"WITH {CH}, x AS (SELECT chunk_id, coalesce({_OFF}, []) AS raw FROM ch) SELECT chunk_id, array_to_string(raw, '|') AS raw, array_to_string({_KEEP}, '|') AS retained, len(raw) = 0 AS sentinel_returned FROM x"
QUERIES["explode_phrases"] = lambda s, d: E.explode_phrases(extractions(s, d), chunks(s, d)).select("phrase_id", "track", "chunk_id", "phrase_idx", "phrase", "technology_meta")
ORACLES["explode_phrases"] = f"""WITH {CH}, {EX}, p AS (SELECT track, chunk_id, unnest(retained_phrases) AS phrase, CAST(generate_subscripts(retained_phrases, 1) - 1 AS INTEGER) AS phrase_idx FROM ex)
  SELECT p.chunk_id || '__' || track || '__' || phrase_idx AS phrase_id, track, p.chunk_id, phrase_idx, phrase, technology_meta FROM p LEFT JOIN ch USING (chunk_id)"""
QUERIES["attach_technology"] = lambda s, d: E.attach_technology(phrases(s, d), chunks(s, d)).select("phrase_id", "technology_meta")
ORACLES["attach_technology"] = f"WITH {CH}, {ph()} SELECT phrase_id, coalesce(ph.technology_meta, ch.technology_meta) AS technology_meta FROM ph LEFT JOIN ch USING (chunk_id)"
QUERIES["yield_summary"] = lambda s, d: E.yield_summary(extractions(s, d))
ORACLES["yield_summary"] = f"""WITH {EX} SELECT track, count(DISTINCT chunk_id) AS total_chunks, count(*) FILTER (sentinel_returned) AS sentinel_empties, count(*) FILTER (len(dropped_by_filter) > 0) AS filter_drops_chunks,
  CAST(sum(coalesce(len(dropped_by_filter), 0)) AS BIGINT) AS filter_drops_total, count(error) AS error_chunks, CAST(sum(coalesce(len(retained_phrases), 0)) AS BIGINT) AS retained_phrases FROM ex GROUP BY ALL"""
QUERIES["tech_filter_drops"] = lambda s, d: E.drop_table(extractions(s, d))
ORACLES["tech_filter_drops"] = f"WITH {EX}, x AS (SELECT track, chunk_id, unnest(dropped_by_filter) AS d FROM ex) SELECT track, chunk_id, d.phrase AS phrase, d.tech_word AS tech_word FROM x"
QUERIES["extraction_errors"] = lambda s, d: E.error_table(extractions(s, d))
ORACLES["extraction_errors"] = f"WITH {EX} SELECT track, chunk_id, error FROM ex WHERE error IS NOT NULL"
QUERIES["chunks_to_run"] = lambda s, d: E.chunks_to_run(chunks(s, d), extractions(s, d).filter("track = 'concern'")).select("chunk_id")
ORACLES["chunks_to_run"] = f"WITH {CH}, {EX} SELECT chunk_id FROM ch WHERE chunk_id NOT IN (SELECT chunk_id FROM ex WHERE track = 'concern' AND (error IS NULL OR len(retained_phrases) > 0))"
QUERIES["filter_phrases"] = lambda s, d: E.filter_phrases(extractions(s, d).select("extraction_id", "raw_phrases"), ("sensor", "drone", "embryo")).select("extraction_id", F.size("retained_phrases").alias("kept"), F.size("dropped_by_filter").alias("dropped"))
_HIT = r"regexp_matches(lower(p), '(^|[^\pL\pN_])(sensor|drone|embryo)($|[^\pL\pN_])')"
ORACLES["filter_phrases"] = f"WITH {EX} SELECT extraction_id, len(list_filter(raw_phrases, lambda p: NOT {_HIT})) AS kept, len(list_filter(raw_phrases, lambda p: {_HIT})) AS dropped FROM ex"
QUERIES["volume_of_target"] = lambda s, d: chunks(s, d).filter(T.is_target_label("technology_meta", (TARGET.lower(),))).groupBy("year").agg(F.count("*").alias("n"))
ORACLES["volume_of_target"] = f"WITH {CH} SELECT year, count(*) AS n FROM ch WHERE lower(trim(technology_meta)) = 'artificial intelligence' GROUP BY ALL"
