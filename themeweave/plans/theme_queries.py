"""Cluster metrics, shares, comparisons, traces and samples over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from themeweave.operators import metrics as M, robustness as R, shares as S, trace as X
from themeweave.plans.inputs import BR, CH, K, LENS_SAL, PROFILE, PROFILE_ALL, SAL, TARGET, bridge, chunks, extractions, label_sql, labels, ph, phrases, pretty_sql, r6

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
C, T = "cluster_id", "technology_meta"


def q(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) + F.lit(0.0) for n in names})


PCOLS = f"cluster_id, size, n_technologies, {r6('entropy_raw')} AS entropy_raw, {r6('entropy_norm')} AS entropy_norm, entropy_norm >= 0.5 AS is_cross_cutting"


for _t in M.TRACKS:

    @q(f"cluster_profile_{_t}", f"WITH {ph(_t)}, {PROFILE if _t == 'concern' else PROFILE_ALL} SELECT {PCOLS} FROM prof")
    def _(s, d, t=_t):
        # the number of benefit clusters grows with the rows
        return rounded(M.cluster_profile(phrases(s, d, t), C, T, K, beyond=t == "benefit"), "entropy_raw", "entropy_norm")

    @q(f"lens_prevalence_{_t}", f"WITH {ph(_t)}, {BR} SELECT lens, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM br LEFT JOIN (SELECT cluster_id, count(*) AS n FROM ph GROUP BY ALL) USING (cluster_id) GROUP BY ALL")
    def _(s, d, t=_t):
        p = phrases(s, d, t)
        return S.lens_prevalence(p, C, bridge(p))

    @q(f"top_clusters_{_t}", f"WITH {ph(_t)} SELECT '{_t}' AS kind, cluster_id, count(*) AS n, {label_sql()} AS label FROM ph WHERE cluster_id IS NOT NULL GROUP BY cluster_id ORDER BY n DESC, cluster_id LIMIT 10")
    def _(s, d, t=_t):
        p = phrases(s, d, t)
        return M.top_clusters(p, t, C, labels(p))


    @q(f"volume_table_{_t}", f"WITH {ph(_t)} SELECT technology_meta, year, count(*) AS {_t}_phrases, count(DISTINCT chunk_id) AS {_t}_paragraphs FROM ph WHERE technology_meta IS NOT NULL AND year IS NOT NULL GROUP BY ALL")
    def _(s, d, t=_t):
        return M.volume_table(phrases(s, d, t), t, T, "year")


@q("top_clusters_union", "WITH " + ph("concern", "a") + ", " + ph("benefit", "b") + " (SELECT 'concern' AS kind, cluster_id, count(*) AS n FROM a WHERE cluster_id IS NOT NULL GROUP BY ALL ORDER BY n DESC, cluster_id LIMIT 10) UNION ALL (SELECT 'benefit' AS kind, cluster_id, count(*) AS n FROM b WHERE cluster_id IS NOT NULL GROUP BY ALL ORDER BY n DESC, cluster_id LIMIT 10)")
def _(s, d):
    return M.top_clusters(phrases(s, d), "concern", C).unionByName(M.top_clusters(phrases(s, d, "benefit"), "benefit", C))


def _vol(t, n):
    return f"{n}v AS (SELECT technology_meta, year, count(*) AS {t}_phrases, count(DISTINCT chunk_id) AS {t}_paragraphs FROM {n} WHERE technology_meta IS NOT NULL AND year IS NOT NULL GROUP BY ALL)"


@q("volume_comparison", f"""WITH {ph("concern", "a")}, {ph("benefit", "b")}, {_vol("concern", "a")}, {_vol("benefit", "b")}
  SELECT technology_meta, year, coalesce(concern_phrases, 0) AS concern_phrases, coalesce(concern_paragraphs, 0) AS concern_paragraphs, coalesce(benefit_phrases, 0) AS benefit_phrases, coalesce(benefit_paragraphs, 0) AS benefit_paragraphs,
  round(coalesce(benefit_phrases, 0) / (coalesce(benefit_phrases, 0) + coalesce(concern_phrases, 0)), 6) AS benefit_share FROM av FULL OUTER JOIN bv USING (technology_meta, year)""")
def _(s, d):
    a, b = (M.volume_table(phrases(s, d, t), t, T, "year") for t in M.TRACKS)
    return rounded(M.volume_comparison(a, b, T, "year"), "benefit_share")


@q("cluster_summary", f"WITH {ph()}, {PROFILE} SELECT cluster_id, {pretty_sql('cluster_id', 'CASE WHEN cluster_id IN (SELECT cluster_id FROM ph) THEN ' + label_sql() + ' END')} AS label, size, {r6('entropy_norm')} AS entropy, CASE WHEN entropy_norm >= 0.5 THEN 'cross-cutting' ELSE 'technology-specific' END AS type FROM prof")
def cluster_summary(s, d):
    p = phrases(s, d)
    return rounded(M.cluster_summary(M.cluster_profile(p, C, T, K), labels(p), C), "entropy")


@q("classify_cross_cutting", f"WITH {ph()}, {PROFILE} SELECT count(*) AS n_clusters, count(*) FILTER (entropy_norm >= 0.5) AS n_cross_cutting, CAST(sum(size) AS BIGINT) AS n_phrases, CAST(sum(size) FILTER (entropy_norm >= 0.5) AS BIGINT) AS n_cross_cutting_phrases, round(100.0 * count(*) FILTER (entropy_norm >= 0.5) / count(*), 6) AS pct_clusters, round(100.0 * sum(size) FILTER (entropy_norm >= 0.5) / sum(size), 6) AS pct_phrases FROM prof")
def _(s, d):
    return rounded(M.cross_cutting_summary(M.cluster_profile(phrases(s, d), C, T, K)), "pct_clusters", "pct_phrases")


_DIST = """n AS (SELECT {g}, {c}, count(*) AS n FROM ph WHERE {g} IS NOT NULL AND {c} IS NOT NULL GROUP BY ALL),
  p AS (SELECT *, n / sum(n) OVER (PARTITION BY {g}) AS p, row_number() OVER (PARTITION BY {g} ORDER BY n DESC, {c}) AS r FROM n),
  dist AS (SELECT {g}, CAST(sum(n) AS BIGINT) AS total, count(*) AS categories, sum(-p * ln(p)) AS entropy_raw, sum(p * p) AS hhi, coalesce(sum(p) FILTER (r <= 10), 0) AS topk_share FROM p GROUP BY ALL)"""


@q("distribution_support", f"WITH {ph()}, {_DIST.format(g=C, c=T)} SELECT cluster_id, total, categories, {r6('entropy_raw')} AS entropy_raw, {r6('hhi')} AS hhi, {r6('topk_share')} AS topk_share, {r6('CASE WHEN categories > 1 THEN entropy_raw / ln(greatest(categories, 2)) ELSE 0 END')} AS entropy_norm FROM dist")
def _(s, d):
    return rounded(M.group_distribution(phrases(s, d), C, T), "entropy_raw", "hhi", "topk_share", "entropy_norm")


@q("distribution_by_document", f"WITH {ph('benefit')}, {_DIST.format(g='source_file', c=C)} SELECT source_file, total, categories, {r6('entropy_raw')} AS entropy_raw, {r6('hhi')} AS hhi, {r6('topk_share')} AS topk_share, {r6('entropy_raw / ln((SELECT count(DISTINCT cluster_id) FROM ph))')} AS entropy_norm FROM dist")
def _(s, d):
    return rounded(M.group_distribution(phrases(s, d, "benefit"), "source_file", C, basis="global"), "entropy_raw", "hhi", "topk_share", "entropy_norm")


def _dom(c):
    return f"""WITH {ph()}, n AS (SELECT cluster_id, {c}, count(*) AS n FROM ph WHERE cluster_id IS NOT NULL AND {c} IS NOT NULL GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, {c}) AS r, sum(n) OVER (PARTITION BY cluster_id) AS t, count(*) OVER (PARTITION BY cluster_id) AS k FROM n)
      SELECT cluster_id, k AS n_categories, {c} AS dominant, round(n / t, 6) AS dominant_share, n / t > 0.6 OR k < 3 AS flagged FROM r WHERE r = 1"""


@q("cluster_dominance", _dom(T))
def _(s, d):
    return rounded(M.dominance(phrases(s, d), C, T), "dominant_share")


@q("document_dominance", _dom("source_file"))
def _(s, d):
    return rounded(M.dominance(phrases(s, d), C, "source_file"), "dominant_share")


@q("ai_share_in_tech_specific", f"WITH {ph()}, {PROFILE} SELECT cluster_id, count(*) AS size, count(*) FILTER (technology_meta = '{TARGET}') AS n_target, round(count(*) FILTER (technology_meta = '{TARGET}') / count(*), 6) AS target_share, count(*) FILTER (technology_meta = '{TARGET}') / count(*) > 0.4 AS over_40, count(*) FILTER (technology_meta = '{TARGET}') / count(*) > 0.5 AS over_50 FROM ph WHERE cluster_id IN (SELECT cluster_id FROM prof WHERE entropy_norm < 0.8 AND size > 0) GROUP BY ALL")
def _(s, d):
    p = phrases(s, d)
    return rounded(M.target_share_in_specific(p, M.cluster_profile(p, C, T, K, threshold=0.8), C, T, TARGET), "target_share")


@q("cohens_kappa", f"WITH {CH}, x AS (SELECT coalesce(technology IN (SELECT name FROM technologies), false) AS a, coalesce(technology_meta IN (SELECT name FROM technologies), false) AS b FROM ch), t AS (SELECT count(*) AS n, avg(CAST(a = b AS INTEGER)) AS po, (count(*) FILTER (a) * count(*) FILTER (b) + count(*) FILTER (NOT a) * count(*) FILTER (NOT b)) / (count(*) * count(*)) AS pe FROM x) SELECT n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM t")
def _(s, d):
    from themeweave.session import table

    names = table(s, d, "technologies").select("name").distinct()
    x = chunks(s, d).join(names.withColumnRenamed("name", "technology").withColumn("_a", F.lit(True)), "technology", "left").join(names.withColumnRenamed("name", "technology_meta").withColumn("_b", F.lit(True)), "technology_meta", "left")
    return rounded(M.cohens_kappa(x.select(F.coalesce("_a", F.lit(False)).alias("a"), F.coalesce("_b", F.lit(False)).alias("b")), "a", "b"), "agreement", "kappa")


# --- shares and comparisons ------------------------------------------------------------------


@q("salience", f"WITH {ph()}, {SAL} SELECT technology_meta, cluster_id, n, tech_n, round(share, 6) AS share FROM sal")
def _(s, d):
    return rounded(S.salience(phrases(s, d), T, C), "share")


@q("salience_cross_cutting", f"WITH {ph()}, {PROFILE}, {SAL} SELECT technology_meta, cluster_id, n, tech_n, round(share, 6) AS share FROM sal WHERE cluster_id IN (SELECT cluster_id FROM prof WHERE entropy_norm >= 0.5)")
def _(s, d):
    p = phrases(s, d)
    return rounded(S.salience(p, T, C, M.cluster_profile(p, C, T, K).filter("is_cross_cutting")), "share")


@q("lens_stats", f"WITH {ph()}, {BR}, {SAL}, {LENS_SAL}, e AS (SELECT lens, sum(-p * ln(p)) AS h FROM (SELECT lens, n / sum(n) OVER (PARTITION BY lens) AS p FROM lc) GROUP BY ALL), c AS (SELECT lens, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM br LEFT JOIN (SELECT cluster_id, count(*) AS n FROM ph GROUP BY ALL) USING (cluster_id) GROUP BY ALL) SELECT lens, n, round(n / (SELECT count(*) FROM ph), 6) AS prevalence, {r6('coalesce(h, 0)')} AS entropy FROM c LEFT JOIN e USING (lens)")
def _(s, d):
    p = phrases(s, d)
    return rounded(S.lens_stats(p, C, T, bridge(p)), "prevalence", "entropy")


@q("lens_salience", f"WITH {ph()}, {BR}, {SAL}, {LENS_SAL} SELECT technology_meta, lens, CAST(n AS BIGINT) AS n, tech_n, round(share, 6) AS share FROM ls")
def _(s, d):
    p = phrases(s, d)
    return rounded(S.lens_salience(p, T, C, bridge(p)), "share")


def _diff(src, item):
    return f"""df AS (SELECT {item}, coalesce(max(share) FILTER (technology_meta = '{TARGET}'), 0) AS target_share, coalesce(avg(share) FILTER (technology_meta <> '{TARGET}'), 0) AS tech_weighted,
      coalesce(sum(n) FILTER (technology_meta <> '{TARGET}') / sum(tech_n) FILTER (technology_meta <> '{TARGET}'), 0) AS doc_weighted FROM {src} GROUP BY ALL),
      dd AS (SELECT *, target_share - tech_weighted AS difference, target_share - doc_weighted AS difference_doc FROM df)"""


_DCOLS = ", ".join(f"{r6(x)} AS {x}" for x in ("target_share", "tech_weighted", "doc_weighted", "difference", "difference_doc"))
_DN = ("target_share", "tech_weighted", "doc_weighted", "difference", "difference_doc")


@q("baselines_by_cluster", f"WITH {ph()}, {SAL}, {_diff('sal', C)} SELECT cluster_id, {_DCOLS} FROM dd")
def _(s, d):
    return rounded(S.target_and_baselines(S.salience(phrases(s, d), T, C), T, C, TARGET), *_DN)


@q("distinctive_lenses", f"WITH {ph()}, {BR}, {SAL}, {LENS_SAL}, {_diff('ls', 'lens')} SELECT lens, {_DCOLS} FROM dd")
def _(s, d):
    p = phrases(s, d)
    return rounded(S.target_and_baselines(S.lens_salience(p, T, C, bridge(p)), T, "lens", TARGET), *_DN)


def _ends(low, high, src="dd", value="difference"):
    return f"""(SELECT *, row_number() OVER (ORDER BY {value}, cluster_id) AS place, 'under' AS direction FROM {src} QUALIFY place <= {low} UNION ALL
      SELECT *, row_number() OVER (ORDER BY {value} DESC, cluster_id) AS place, 'over' AS direction FROM {src} QUALIFY place <= {high})"""


_DIS = f"WITH {ph()}, {SAL}, {_diff('sal', C)}"


@q("distinctive_clusters", f"{_DIS} SELECT cluster_id, place, direction, {pretty_sql()} AS label, {_DCOLS} FROM {_ends(10, 10)}")
def _(s, d):
    p = phrases(s, d)
    return rounded(S.distinctive(p, T, C, TARGET, labels(p)), *_DN)


_FP = f"""fq AS (SELECT *, coalesce(share / nullif(sum(share) OVER (PARTITION BY cluster_id), 0), 0) AS q FROM sal),
  fp AS (SELECT cluster_id, coalesce(max(q) FILTER (technology_meta = '{TARGET}'), 0) - coalesce(avg(q) FILTER (technology_meta <> '{TARGET}'), 0) AS value FROM fq GROUP BY ALL)"""


@q("ai_fingerprint", f"WITH {ph()}, {SAL}, {_FP} SELECT cluster_id, {r6('value')} AS value FROM fp")
def _(s, d):
    return rounded(S.fingerprint(S.salience(phrases(s, d), T, C), T, C, TARGET), "value")


@q("fingerprint_selection", f"WITH {ph()}, {SAL}, {_FP}, fr AS (SELECT cluster_id, round(value, 9) AS value FROM fp) SELECT cluster_id, {r6('value')} AS value, place, direction FROM {_ends(5, 7, 'fr', 'value')}")
def _(s, d):
    f = S.fingerprint(S.salience(phrases(s, d), T, C), T, C, TARGET).withColumn("value", F.round("value", 9))
    return rounded(S.extremes(f, C, "value", 5, 7), "value")


_TOP = f"""c0 AS (SELECT cluster_id, count(*) AS n FROM ph WHERE cluster_id IS NOT NULL GROUP BY ALL),
  top AS (SELECT cluster_id, n / (SELECT sum(n) FROM c0) AS prevalence, entropy_raw FROM c0 JOIN prof USING (cluster_id) ORDER BY round(n / (SELECT sum(n) FROM c0), 9) DESC, round(entropy_raw, 9) DESC, cluster_id LIMIT 20)"""


@q("shared_top20", f"WITH {ph()}, {PROFILE}, {_TOP} SELECT cluster_id, {r6('prevalence')} AS prevalence, {r6('entropy_raw')} AS entropy_raw FROM top")
def _(s, d):
    p = phrases(s, d)
    return rounded(S.shared_top(p, M.cluster_profile(p, C, T, K), C), "prevalence", "entropy_raw")


@q("table1", f"WITH {ph()}, {PROFILE}, {_TOP} SELECT cluster_id, {pretty_sql()} AS label, round(100 * prevalence, 1) AS prevalence_pct, round(prof.entropy_raw, 2) AS entropy, CASE WHEN entropy_norm >= 0.5 THEN 'cross-cutting' ELSE 'technology-specific' END AS type FROM top JOIN prof USING (cluster_id)")
def _(s, d):
    p = phrases(s, d)
    prof = M.cluster_profile(p, C, T, K)
    return S.prevalence_table(S.shared_top(p, prof, C), M.cluster_summary(prof, labels(p), C), C)


@q("table2_a", f"{_DIS} SELECT cluster_id, {pretty_sql()} AS label, direction, round(100 * target_share, 2) AS target_pct, round(100 * tech_weighted, 2) AS others_pct, round(100 * difference, 2) + 0.0 AS difference_pp FROM {_ends(10, 10)}")
def _(s, d):
    p = phrases(s, d)
    br = bridge(p)
    a, _b = S.panels(S.distinctive(p, T, C, TARGET, labels(p)), S.target_and_baselines(S.lens_salience(p, T, C, br), T, "lens", TARGET), C)
    return a.withColumn("difference_pp", F.col("difference_pp") + F.lit(0.0))


@q("table2_b", f"WITH {ph()}, {BR}, {SAL}, {LENS_SAL}, {_diff('ls', 'lens')} SELECT lens, round(100 * target_share, 1) AS target_pct, round(100 * difference, 1) + 0.0 AS tech_weighted_pp, round(100 * difference_doc, 1) + 0.0 AS doc_weighted_pp FROM dd")
def _(s, d):
    p = phrases(s, d)
    _a, b = S.panels(S.distinctive(p, T, C, TARGET, labels(p)), S.target_and_baselines(S.lens_salience(p, T, C, bridge(p)), T, "lens", TARGET), C)
    return b.withColumns({n: F.col(n) + F.lit(0.0) for n in ("tech_weighted_pp", "doc_weighted_pp")})


@q("stable_core", f"""WITH {ph()}, {PROFILE}, x AS (SELECT *, (SELECT quantile_cont(CAST(size AS DOUBLE), 0.75) FROM prof WHERE size > 0) AS threshold FROM prof WHERE size > 0),
  y AS (SELECT *, entropy_norm >= 0.5 AND size >= threshold AS in_core, entropy_norm * ln(1 + size) AS score FROM x)
  SELECT cluster_id, size, {r6('entropy_norm')} AS entropy_norm, {r6('threshold')} AS threshold, in_core, {r6('score')} AS score, in_core AND row_number() OVER (PARTITION BY in_core ORDER BY round(score, 9) DESC, cluster_id) <= 12 AS annotated FROM y""")
def _(s, d):
    return rounded(S.stable_core(M.cluster_profile(phrases(s, d), C, T, K), C), "entropy_norm", "threshold", "score")


@q("top_salience_clusters", f"WITH {ph()}, {SAL}, m AS (SELECT cluster_id, avg(share) AS v FROM sal GROUP BY ALL ORDER BY round(v, 9) DESC, cluster_id LIMIT 40) SELECT cluster_id, {r6('v')} AS mean_share FROM m")
def _(s, d):
    return rounded(S.top_salience_clusters(S.salience(phrases(s, d), T, C), C), "mean_share")


_RG = ", ".join(f"({t}, {v})" for t in (0.4, 0.5, 0.6) for v in (0.70, 0.75, 0.80))


@q("stable_core_robustness", f"""WITH {ph()}, {SAL}, {_FP}, s1 AS (SELECT cluster_id, sum(share) OVER (PARTITION BY cluster_id) AS s, share FROM sal),
  cs AS (SELECT cluster_id, max(s) AS size, coalesce(sum(-(share / nullif(s, 0)) * ln(share / nullif(s, 0))) FILTER (share > 0), 0) AS h, count(*) FILTER (share > 0) AS k FROM s1 GROUP BY ALL),
  ce AS (SELECT cluster_id, size, CASE WHEN k > 1 THEN h / ln(greatest(k, 2)) ELSE 0 END AS e FROM cs),
  g AS (SELECT CAST(t AS DOUBLE) AS threshold, CAST(v AS DOUBLE) AS quantile FROM (VALUES {_RG}) v(t, v)),
  b AS (SELECT threshold, quantile, CASE quantile WHEN 0.7 THEN (SELECT quantile_cont(size, 0.7) FROM ce) WHEN 0.75 THEN (SELECT quantile_cont(size, 0.75) FROM ce) ELSE (SELECT quantile_cont(size, 0.8) FROM ce) END AS size_bound FROM g),
  z AS (SELECT threshold, quantile, cluster_id, round(value, 9) AS v, row_number() OVER (PARTITION BY threshold, quantile ORDER BY round(value, 9) DESC, cluster_id) AS up, row_number() OVER (PARTITION BY threshold, quantile ORDER BY round(value, 9), cluster_id) AS down FROM b CROSS JOIN ce JOIN fp USING (cluster_id) WHERE e >= threshold)
  SELECT b.threshold, b.quantile, count(*) FILTER (e >= b.threshold) AS n_cross_cutting, count(*) FILTER (e >= b.threshold AND size >= size_bound) AS n_core, round(size_bound, 6) AS size_bound,
  (SELECT coalesce(string_agg(CAST(cluster_id AS VARCHAR), '; ' ORDER BY up), '') FROM z WHERE z.threshold = b.threshold AND z.quantile = b.quantile AND up <= 5) AS over,
  (SELECT coalesce(string_agg(CAST(cluster_id AS VARCHAR), '; ' ORDER BY up), '') FROM z WHERE z.threshold = b.threshold AND z.quantile = b.quantile AND down <= 5) AS under,
  round(100.0 * count(*) FILTER (e >= b.threshold) / count(*), 6) AS pct_cross_cutting FROM b CROSS JOIN ce GROUP BY ALL""")
def _(s, d):
    return rounded(R.stable_core_robustness(S.salience(phrases(s, d), T, C), T, C, TARGET), "size_bound", "pct_cross_cutting")


# --- prompt variants: the replies' tracks and positions stand for variants ----------------------


def variants(s, d):
    """(variant, chunk_id, technology_meta, phrase_idx, phrase, cluster_id) with three variants made from the retained phrases."""
    e = extractions(s, d).filter("track = 'concern' AND retained_phrases IS NOT NULL").select("chunk_id", F.posexplode("retained_phrases").alias("phrase_idx", "phrase"))
    h = lambda salt: F.pmod(F.conv(F.substring(F.md5(F.concat(F.col("phrase"), F.lit(salt))), 1, 8), 16, 10).cast("long"), F.lit(20)).cast("int")
    x = e.join(chunks(s, d).select("chunk_id", T), "chunk_id").filter(F.col(T).isNotNull())
    base = F.pmod(F.conv(F.substring(F.md5(F.substring("phrase", 1, 8)), 1, 8), 16, 10).cast("long"), F.lit(20)).cast("int")
    v = F.array(*[F.struct(F.lit(n).alias("variant"), F.when(h(n) < m, h(n)).otherwise(base).alias(C)) for n, m in (("A", 0), ("B", 4), ("C", 10))])
    return x.select("chunk_id", T, "phrase_idx", "phrase", F.explode(v).alias("v")).select("v.variant", "chunk_id", T, "phrase_idx", "phrase", f"v.{C}").filter("NOT (variant = 'C' AND phrase_idx > 1)")


_H = "CAST(('0x' || substr(md5(phrase || '{0}'), 1, 8))::BIGINT % 20 AS INTEGER)"
_VAR = f"""{CH}, e AS (SELECT DISTINCT extraction_id, chunk_id, retained_phrases FROM extractions WHERE track = 'concern' AND retained_phrases IS NOT NULL),
  e1 AS (SELECT chunk_id, unnest(retained_phrases) AS phrase, CAST(generate_subscripts(retained_phrases, 1) - 1 AS INTEGER) AS phrase_idx FROM e),
  e2 AS (SELECT e1.*, technology_meta, CAST(('0x' || substr(md5(substr(phrase, 1, 8)), 1, 8))::BIGINT % 20 AS INTEGER) AS base FROM e1 JOIN ch USING (chunk_id) WHERE technology_meta IS NOT NULL),
  ph AS (SELECT 'A' AS variant, chunk_id, technology_meta, phrase_idx, phrase, base AS cluster_id FROM e2
         UNION ALL SELECT 'B', chunk_id, technology_meta, phrase_idx, phrase, CASE WHEN {_H.format('B')} < 4 THEN {_H.format('B')} ELSE base END FROM e2
         UNION ALL SELECT 'C', chunk_id, technology_meta, phrase_idx, phrase, CASE WHEN {_H.format('C')} < 10 THEN {_H.format('C')} ELSE base END FROM e2 WHERE phrase_idx <= 1)"""
_VL = f"{BR}, pl AS (SELECT cluster_id, 'lens_' || max(lens_order) AS lens FROM br GROUP BY ALL), vn AS (SELECT variant, technology_meta, lens, count(*) AS n FROM ph JOIN pl USING (cluster_id) GROUP BY ALL), vs AS (SELECT *, sum(n) OVER (PARTITION BY variant, technology_meta) AS tech_n FROM vn)"


@q("variant_diagnostics", f"WITH {_VAR}, n AS (SELECT count(DISTINCT chunk_id) AS n_chunks FROM ch) SELECT variant, (SELECT n_chunks FROM n) AS n_chunks, count(DISTINCT chunk_id) AS n_covered, count(*) AS n_phrases, round(count(DISTINCT chunk_id) / (SELECT n_chunks FROM n), 6) AS coverage, round(count(*) / (SELECT n_chunks FROM n), 6) AS density, round(avg(len(list_filter(string_split_regex(phrase, '\\s+'), lambda w: w <> ''))), 6) AS mean_words FROM ph GROUP BY variant")
def _(s, d):
    names = F.explode(F.array(*map(F.lit, "ABC"))).alias("variant")
    return rounded(S.variant_diagnostics(chunks(s, d).select("chunk_id", names), variants(s, d)), "coverage", "density", "mean_words")


@q("variant_lens_share", f"WITH {_VAR}, {_VL} SELECT variant, technology_meta, lens, n, CAST(tech_n AS BIGINT) AS tech_n, round(n / tech_n, 6) AS share FROM vs")
def _(s, d):
    v = variants(s, d)
    return rounded(S.variant_lens_share(v, bridge(v), T, C), "share")


@q("variant_distinctiveness", f"""WITH {_VAR}, {_VL}, g AS (SELECT t.variant, t.technology_meta, l.lens, tech_n, coalesce(n, 0) AS n FROM (SELECT DISTINCT variant, technology_meta, tech_n FROM vs) t CROSS JOIN (SELECT DISTINCT lens FROM vs) l LEFT JOIN vn USING (variant, technology_meta, lens)),
  x AS (SELECT variant, lens, coalesce(max(n / tech_n) FILTER (technology_meta = '{TARGET}'), 0) AS target_share, coalesce(avg(n / tech_n) FILTER (technology_meta <> '{TARGET}'), 0) AS tech_weighted, coalesce(sum(n) FILTER (technology_meta <> '{TARGET}') / sum(tech_n) FILTER (technology_meta <> '{TARGET}'), 0) AS doc_weighted FROM g GROUP BY ALL)
  SELECT variant, lens, {r6('target_share')} AS target_share, {r6('tech_weighted')} AS tech_weighted, {r6('doc_weighted')} AS doc_weighted, {r6('target_share - tech_weighted')} AS diff_tech, {r6('target_share - doc_weighted')} AS diff_doc FROM x""")
def _(s, d):
    v = variants(s, d)
    return rounded(S.variant_distinctiveness(S.variant_lens_share(v, bridge(v), T, C), T, TARGET), "target_share", "tech_weighted", "doc_weighted", "diff_tech", "diff_doc")


_FA = "fa AS (SELECT variant, chunk_id, cluster_id FROM ph QUALIFY row_number() OVER (PARTITION BY variant, chunk_id ORDER BY phrase_idx, cluster_id) = 1)"


@q("first_phrase_assignment", f"WITH {_VAR}, {_FA} SELECT * FROM fa")
def _(s, d):
    return S.first_assignment(variants(s, d), C)


def _ari(pairs: str, by: str) -> str:
    g = f"GROUP BY {by}" if by else ""
    p = f"{by}, " if by else ""
    j = f"USING ({by})" if by else "ON true"
    return f"""cell AS (SELECT {p}a, b, count(*) AS n FROM {pairs} GROUP BY ALL), i AS (SELECT {p}sum(n) AS n, sum(n * (n - 1) / 2) AS sij FROM cell {g}),
      ra AS (SELECT {p}sum(m * (m - 1) / 2) AS sa FROM (SELECT {p}a, sum(n) AS m FROM cell GROUP BY ALL) {g}), rb AS (SELECT {p}sum(m * (m - 1) / 2) AS sb FROM (SELECT {p}b, sum(n) AS m FROM cell GROUP BY ALL) {g}),
      ari AS (SELECT {p}CAST(n AS BIGINT) AS n, round((sij - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)), 6) AS ari FROM i JOIN ra {j} JOIN rb {j})"""


@q("variant_ari", f"WITH {_VAR}, {_FA}, pr AS (SELECT y.variant, x.cluster_id AS a, y.cluster_id AS b FROM fa x JOIN fa y USING (chunk_id) WHERE x.variant = 'A' AND y.variant <> 'A'), {_ari('pr', 'variant')} SELECT * FROM ari")
def _(s, d):
    return rounded(S.variant_ari(S.first_assignment(variants(s, d), C), "A", C), "ari")


@q("adjusted_rand", f"WITH {ph()}, pr AS (SELECT cluster_id AS a, technology_meta AS b FROM ph WHERE cluster_id IS NOT NULL AND technology_meta IS NOT NULL), {_ari('pr', '')} SELECT * FROM ari")
def _(s, d):
    return rounded(S.adjusted_rand(phrases(s, d), C, T), "ari")


@q("disagreement_examples", f"WITH {_VAR}, {_FA} SELECT chunk_id, x.cluster_id AS cluster_a, y.cluster_id AS cluster_b FROM fa x JOIN fa y USING (chunk_id) WHERE x.variant = 'A' AND y.variant = 'C' AND x.cluster_id <> y.cluster_id ORDER BY md5(chunk_id), chunk_id LIMIT 10")
def _(s, d):
    return S.disagreements(S.first_assignment(variants(s, d), C), "A", "C", C)


@q("variant_summary", f"""WITH {_VAR}, {_VL}, {_FA}, pr AS (SELECT y.variant, x.cluster_id AS a, y.cluster_id AS b FROM fa x JOIN fa y USING (chunk_id) WHERE x.variant = 'A' AND y.variant <> 'A'), {_ari('pr', 'variant')},
  g AS (SELECT t.variant, t.technology_meta, l.lens, tech_n, coalesce(n, 0) AS n FROM (SELECT DISTINCT variant, technology_meta, tech_n FROM vs) t CROSS JOIN (SELECT DISTINCT lens FROM vs) l LEFT JOIN vn USING (variant, technology_meta, lens)),
  x AS (SELECT variant, lens, coalesce(max(n / tech_n) FILTER (technology_meta = '{TARGET}'), 0) - coalesce(avg(n / tech_n) FILTER (technology_meta <> '{TARGET}'), 0) AS diff,
        coalesce(max(n / tech_n) FILTER (technology_meta = '{TARGET}'), 0) - coalesce(sum(n) FILTER (technology_meta <> '{TARGET}') / sum(tech_n) FILTER (technology_meta <> '{TARGET}'), 0) AS diff_doc FROM g GROUP BY ALL),
  d AS (SELECT variant, {r6("min_by(diff, lens) FILTER (lens ILIKE '%NS_3%')")} AS three_tech, {r6("min_by(diff_doc, lens) FILTER (lens ILIKE '%NS_3%')")} AS three_doc, {r6("min_by(diff, lens) FILTER (lens ILIKE '%absent%')")} AS absent_tech FROM x GROUP BY ALL),
  k AS (SELECT count(DISTINCT chunk_id) AS k FROM ch)
  SELECT p.variant, count(*) AS n_phrases, round(count(DISTINCT p.chunk_id) / any_value(k), 6) AS coverage, round(count(*) / any_value(k), 6) AS density, CASE WHEN p.variant = 'A' THEN 1.0 ELSE any_value(ari) END AS ari, any_value(three_tech) AS three_tech, any_value(three_doc) AS three_doc, any_value(absent_tech) AS absent_tech
  FROM ph p CROSS JOIN k LEFT JOIN ari USING (variant) LEFT JOIN d USING (variant) GROUP BY p.variant""")
def _(s, d):
    v = variants(s, d)
    names = F.explode(F.array(*map(F.lit, "ABC"))).alias("variant")
    diag = S.variant_diagnostics(chunks(s, d).select("chunk_id", names), v)
    dist = S.variant_distinctiveness(S.variant_lens_share(v, bridge(v), T, C), T, TARGET)
    out = S.variant_summary(diag, S.variant_ari(S.first_assignment(v, C), "A", C), dist, {"three": "NS_3", "absent": "absent"}, baseline="A")
    numbers = ("coverage", "density", "ari", "three_tech", "three_doc", "absent_tech")
    return rounded(out.select("variant", "n_phrases", *numbers), *numbers)


@q("figure3_data", f"{_DIS} SELECT cluster_id, {pretty_sql()} AS label, direction, round(100 * target_share, 2) + 0.0 AS target_pct, round(100 * tech_weighted, 2) + 0.0 AS others_pct, round(100 * difference, 2) + 0.0 AS difference_pp FROM {_ends(10, 10)}")
def _(s, d):
    p = phrases(s, d)
    return S.comparison_chart(S.distinctive(p, T, C, TARGET, labels(p)), C)


# --- traces and samples ---------------------------------------------------------------------------

_TRACE = f"""{CH}, {ph()}, {BR}, g AS (SELECT chunk_id, array_to_string(list(phrase ORDER BY phrase_id) FILTER (phrase IS NOT NULL), '|') AS phrases, array_to_string(list(cluster_id ORDER BY phrase_id) FILTER (cluster_id IS NOT NULL), '|') AS clusters FROM ph GROUP BY ALL),
  l AS (SELECT chunk_id, string_agg(lens, '|' ORDER BY lens) AS lenses FROM (SELECT DISTINCT chunk_id, lens FROM ph JOIN br USING (cluster_id)) GROUP BY ALL)"""


@q("paragraph_trace", f"WITH {_TRACE} SELECT chunk_id, source_file || '::p' || chunk_index AS paragraph_id, coalesce(phrases, '') AS phrases, coalesce(clusters, '') AS clusters, coalesce(lenses, '') AS lenses FROM ch LEFT JOIN g USING (chunk_id) LEFT JOIN l USING (chunk_id)")
def _(s, d):
    p = phrases(s, d)
    t = X.paragraph_trace(chunks(s, d), p, labels(p), bridge(p))
    return t.select("chunk_id", "paragraph_id", F.array_join("extracted_concerns", "|").alias("phrases"), F.array_join(F.transform("cluster_ids", lambda x: x.cast("string")), "|").alias("clusters"), F.array_join("framing_lenses", "|").alias("lenses"))


@q("clusters_to_lenses", f"WITH {_TRACE} SELECT chunk_id, lenses FROM l JOIN ch USING (chunk_id)")
def _(s, d):
    p = phrases(s, d)
    return X.paragraph_trace(chunks(s, d), p, labels(p), bridge(p)).filter(F.size("framing_lenses") > 0).select("chunk_id", F.array_join("framing_lenses", "|").alias("lenses"))


@q("explode_trace", f"WITH {CH}, {ph()} SELECT source_file || '::p' || chunk_index AS paragraph_id, cluster_id FROM (SELECT chunk_id, cluster_id FROM ph WHERE cluster_id IS NOT NULL) JOIN ch USING (chunk_id)")
def _(s, d):
    p = phrases(s, d)
    return X.explode_trace(X.paragraph_trace(chunks(s, d), p, labels(p), bridge(p))).select("paragraph_id", "cluster_id")


_QUOTA = f"""{CH}, z AS (SELECT technology_meta, count(*) AS size FROM ch WHERE technology_meta IS NOT NULL GROUP BY ALL), t AS (SELECT sum(size) AS total FROM z),
  qt AS (SELECT technology_meta, least(size, greatest(10, CAST(round(250 * size / total) AS BIGINT))) AS quota FROM z, t),
  sm AS (SELECT chunk_id, technology_meta FROM ch JOIN qt USING (technology_meta) QUALIFY row_number() OVER (PARTITION BY technology_meta ORDER BY md5(chunk_id || ':42'), chunk_id) <= any_value(quota) OVER (PARTITION BY technology_meta)),
  smp AS (SELECT * FROM sm ORDER BY md5(chunk_id || ':43'), chunk_id LIMIT 375)"""


@q("human_sample", f"WITH {_QUOTA}, {ph()}, g AS (SELECT chunk_id, string_agg(phrase, ' | ' ORDER BY phrase_id) AS p, count(*) AS n FROM ph GROUP BY ALL) SELECT chunk_id, technology_meta, CASE WHEN n IS NULL THEN '(NO_CONCERN)' ELSE coalesce(p, '') END AS model_phrases, CAST(coalesce(n, 0) AS INTEGER) AS n_phrases FROM smp LEFT JOIN g USING (chunk_id)")
def _(s, d):
    return X.validation_sample(chunks(s, d), phrases(s, d)).select("chunk_id", T, "model_phrases", "n_phrases")


@q("stratified_sample", f"WITH {CH} SELECT chunk_id, technology_meta FROM ch WHERE technology_meta IS NOT NULL QUALIFY row_number() OVER (PARTITION BY technology_meta ORDER BY md5(chunk_id || ':42'), chunk_id) <= floor(400 / (SELECT count(DISTINCT technology_meta) FROM ch))")
def _(s, d):
    return X.even_sample(chunks(s, d), T, "chunk_id", 400).select("chunk_id", T)


def _html(x: str) -> str:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{sign}', '{entity}')"
    return x


_TAG = "CASE WHEN {0} <> '' THEN '<p class=''{1}''>' || " + _html("replace({0}, '|', '; ')") + " || '</p>' ELSE '' END"


@q("evidence_fragments", f"""WITH {_TRACE}, d AS (SELECT DISTINCT technology_meta, source_file FROM ch)
  SELECT technology_meta, source_file, 1 AS part, chunk_index AS "index", '<div><h4>' || {_html("coalesce(source_file || '::p' || chunk_index, '')")} || '</h4><p>' || {_html("coalesce(text, '')")} || '</p>' || {_TAG.format("coalesce(phrases, '')", 'phrases')} || {_TAG.format("coalesce(lenses, '')", 'lenses')} || '</div>' AS html FROM ch LEFT JOIN g USING (chunk_id) LEFT JOIN l USING (chunk_id)
  UNION ALL SELECT technology_meta, source_file, 0, NULL, '<section><h3>' || {_html("coalesce(source_file, 'Unknown')")} || '</h3>' FROM d UNION ALL SELECT technology_meta, source_file, 2, NULL, '</section>' FROM d""")
def _(s, d):
    p = phrases(s, d)
    return X.evidence_fragments(X.paragraph_trace(chunks(s, d), p, labels(p), bridge(p)))
