"""Temporal analyses over the test tables, and the same operators on the star schema and the events."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from themeweave.operators import metrics as M, shares as S, temporal as Y
from themeweave.plans.inputs import CH, TARGET, chunks, labels, ph, phrases, pretty_sql, r6
from themeweave.plans.text_queries import WIN
from themeweave.plans.theme_queries import C, T, _DIST, rounded
from themeweave.session import table
from themeweave.streaming import streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def q(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _fraction(track: str, target: bool) -> str:
    t = f" AND technology_meta = '{TARGET}'" if target else ""
    return f"""{CH}, {ph(track)}, cy AS (SELECT chunk_id, year, source_file AS doc FROM ch WHERE year IS NOT NULL AND source_file IS NOT NULL{t}),
      hit AS (SELECT cy.year, cluster_id, count(DISTINCT doc) AS n_docs FROM ph JOIN cy USING (chunk_id) WHERE cluster_id IS NOT NULL GROUP BY ALL),
      dy AS (SELECT year, count(DISTINCT doc) AS year_docs FROM cy GROUP BY ALL),
      m AS (SELECT year, cluster_id, coalesce(n_docs, 0) AS n_docs, year_docs, coalesce(n_docs, 0) / year_docs AS fraction FROM dy CROSS JOIN (SELECT DISTINCT cluster_id FROM {"ph WHERE cluster_id IS NOT NULL" if target else "hit"}) LEFT JOIN hit USING (year, cluster_id))"""


def _matrix(s, d, track="concern", target=True):
    p = phrases(s, d, track)
    if target:
        return Y.year_doc_fraction(p, chunks(s, d), C, tech=T, target=TARGET, clusters=p.filter("cluster_id IS NOT NULL"))
    return Y.year_doc_fraction(p, chunks(s, d), C)


@q("year_doc_fraction", f"WITH {_fraction('concern', False)} SELECT year, cluster_id, n_docs, year_docs, round(fraction, 6) AS fraction FROM m")
def _(s, d):
    return rounded(_matrix(s, d, target=False), "fraction")


for _t in M.TRACKS:

    @q(f"{_t}_year_matrix", f"WITH {_fraction(_t, True)} SELECT year, cluster_id, n_docs, year_docs, round(fraction, 6) AS fraction FROM m")
    def _(s, d, t=_t):
        return rounded(_matrix(s, d, t), "fraction")


@q("year_count", f"WITH {ph()} SELECT year, cluster_id, count(*) AS n FROM ph WHERE year IS NOT NULL AND cluster_id IS NOT NULL GROUP BY ALL")
def _(s, d):
    return Y.year_counts(phrases(s, d), C)


_REL = f"WITH {_fraction('concern', True)}, rel AS (SELECT *, coalesce(fraction / nullif(sum(fraction) OVER (PARTITION BY year), 0), 0) AS relative FROM m)"


@q("row_relative", f"{_REL} SELECT year, cluster_id, round(relative, 6) AS relative FROM rel")
def _(s, d):
    return rounded(Y.row_relative(_matrix(s, d), "fraction"), "relative").select("year", C, "relative")


@q("trend_slope", f"""{_REL}, yt AS (SELECT year, row_number() OVER (ORDER BY year) - 1 AS t FROM (SELECT DISTINCT year FROM rel)),
  sl AS (SELECT cluster_id, round(regr_slope(relative, t), 9) AS slope FROM rel JOIN yt USING (year) GROUP BY ALL HAVING max(relative) > 0 AND regr_slope(relative, t) IS NOT NULL),
  u AS (SELECT *, row_number() OVER (ORDER BY slope, cluster_id) AS place, 'bottom' AS "end" FROM sl QUALIFY place <= 8 UNION ALL SELECT *, row_number() OVER (ORDER BY slope DESC, cluster_id) AS place, 'top' AS "end" FROM sl QUALIFY place <= 8)
  SELECT cluster_id, {r6('slope')} AS slope, CASE WHEN slope > 0 THEN 'rising' ELSE 'declining' END AS direction, place, "end" FROM u""")
def _(s, d):
    return rounded(Y.trend_slopes(Y.row_relative(_matrix(s, d), "fraction"), C, "relative"), "slope")


@q("heat_ordering", f"""{_REL}, g AS (SELECT cluster_id, round(sum(relative), 9) AS total FROM rel GROUP BY ALL), pk AS (SELECT cluster_id, year AS peak_year FROM rel QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY round(relative, 9) DESC, year) = 1),
  t AS (SELECT * FROM g JOIN pk USING (cluster_id) ORDER BY total DESC, cluster_id LIMIT 20) SELECT cluster_id, {r6('total')} AS total, peak_year, row_number() OVER (ORDER BY peak_year, total DESC, cluster_id) AS place FROM t""")
def _(s, d):
    return rounded(Y.heat_ordering(Y.row_relative(_matrix(s, d), "fraction"), C, "relative"), "total")


@q("rank_volatility", f"""{_REL}, v AS (SELECT year, cluster_id, round(relative, 9) AS v FROM rel), r AS (SELECT *, rank() OVER (PARTITION BY year ORDER BY v DESC) + (count(*) OVER (PARTITION BY year, v) - 1) / 2 AS r FROM v),
  l AS (SELECT *, lag(r) OVER (PARTITION BY cluster_id ORDER BY year) AS prev FROM r) SELECT year, round(avg(abs(r - prev)), 6) AS volatility FROM l WHERE prev IS NOT NULL GROUP BY ALL""")
def _(s, d):
    return rounded(Y.rank_volatility(Y.row_relative(_matrix(s, d), "fraction"), C, "relative"), "volatility")


@q("cluster_novelty", f"WITH {_fraction('concern', True)}, f AS (SELECT *, min(year) FILTER (fraction > 0) OVER (PARTITION BY cluster_id) AS first FROM m) SELECT year, count(*) FILTER (fraction > 0) AS active, count(*) FILTER (fraction > 0 AND first = year) AS new, round(count(*) FILTER (fraction > 0 AND first = year) / greatest(count(*) FILTER (fraction > 0), 1), 6) AS new_share FROM f GROUP BY ALL")
def _(s, d):
    return rounded(Y.cluster_novelty(_matrix(s, d), C, "fraction"), "new_share")


@q("lexical_novelty", rf"""WITH {ph()}, x AS (SELECT year, phrase FROM ph WHERE lower(technology_meta) = '{TARGET.lower()}' AND year IS NOT NULL),
  w AS (SELECT DISTINCT year, unnest(list_filter(string_split_regex(regexp_replace(lower(phrase), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda t: length(t) > 3)) AS w FROM x),
  f AS (SELECT year, min(year) OVER (PARTITION BY w) AS first FROM w), t AS (SELECT year, count(*) AS vocab, count(*) FILTER (first = year) AS new FROM f GROUP BY ALL)
  SELECT year, num_phrases, coalesce(vocab, 0) AS vocab, coalesce(new, 0) AS new, coalesce(round(new / vocab, 6), 0) AS new_share FROM (SELECT year, count(*) AS num_phrases FROM x GROUP BY ALL) LEFT JOIN t USING (year)""")
def _(s, d):
    return rounded(Y.lexical_novelty(phrases(s, d), T, "phrase", TARGET), "new_share")


_DIV = f"{r6('entropy_raw')} AS entropy_raw, {r6('CASE WHEN categories > 1 THEN entropy_raw / ln(greatest(categories, 2)) ELSE 0 END')} AS entropy_norm, {r6('hhi')} AS hhi, {r6('topk_share')} AS topk_share"


@q("diversity_by_year", f"WITH {ph('concern', 'p0')}, ph AS (SELECT * FROM p0 WHERE technology_meta = '{TARGET}'), {_DIST.format(g='year', c=C)} SELECT year, total, {_DIV} FROM dist")
def _(s, d):
    return rounded(Y.diversity_by(phrases(s, d).filter(F.col(T) == TARGET), "year", C), "entropy_raw", "entropy_norm", "hhi", "topk_share")


_WPH = f"{ph('concern', 'p0')}, ph AS (SELECT *, {WIN} AS w FROM p0 WHERE technology_meta = '{TARGET}')"


@q("window_summary", f"""WITH {_WPH}, e AS (SELECT w, sum(-p * ln(p)) AS h FROM (SELECT w, n / sum(n) OVER (PARTITION BY w) AS p FROM (SELECT w, cluster_id, count(*) AS n FROM ph WHERE w IS NOT NULL AND cluster_id IS NOT NULL GROUP BY ALL)) GROUP BY ALL),
  b AS (SELECT w, count(*) AS n_phrases, count(DISTINCT cluster_id) AS n_clusters, count(DISTINCT source_file) AS n_documents FROM ph WHERE w IS NOT NULL GROUP BY ALL)
  SELECT w AS "window", n_phrases, n_clusters, n_documents, {r6('coalesce(h, 0)')} AS entropy_raw, {r6('CASE WHEN n_clusters > 1 THEN coalesce(h, 0) / ln(greatest(n_clusters, 2)) ELSE 0 END')} AS entropy_norm FROM b LEFT JOIN e USING (w)""")
def _(s, d):
    return rounded(Y.window_summary(phrases(s, d).filter(F.col(T) == TARGET), C), "entropy_raw", "entropy_norm")


_WTOP = "wn AS (SELECT w, cluster_id, count(*) AS n FROM ph WHERE w IS NOT NULL AND cluster_id IS NOT NULL GROUP BY ALL), wr AS (SELECT *, n / sum(n) OVER (PARTITION BY w) AS share, row_number() OVER (PARTITION BY w ORDER BY n DESC, cluster_id) AS place FROM wn)"


@q("window_top_clusters", f"WITH {_WPH}, {_WTOP} SELECT w AS \"window\", place, cluster_id, {pretty_sql()} AS label, n, round(share, 6) AS share FROM wr WHERE place <= 10")
def _(s, d):
    p = phrases(s, d)
    return rounded(Y.window_top_clusters(p.filter(F.col(T) == TARGET), C, labels(p)), "share")


_W4 = ["2004-2017", "2018-2020", "2021-2023", "2024-2025"]


@q("figure4_matrix", f"""WITH {_WPH}, {_WTOP}, x AS (SELECT cluster_id, {", ".join(f"coalesce(max(share) FILTER (w = '{n}'), 0) AS s{i}" for i, n in enumerate(_W4))} FROM wr WHERE cluster_id IN (SELECT cluster_id FROM wr WHERE place <= 10) GROUP BY ALL)
  SELECT cluster_id, {", ".join(f"round(s{i}, 6) AS s{i}" for i in range(4))}, CASE greatest(s0, s1, s2, s3) {" ".join(f"WHEN s{i} THEN '{n}'" for i, n in enumerate(_W4))} END AS peak_window, round(greatest(s0, s1, s2, s3), 6) AS peak_share FROM x""")
def _(s, d):
    m = Y.window_matrix(phrases(s, d).filter(F.col(T) == TARGET), C)
    m = m.withColumnsRenamed({n: f"s{i}" for i, n in enumerate(_W4)})
    return rounded(m, "s0", "s1", "s2", "s3", "peak_share")


# --- star schema: a line is a phrase, an order a document, a nation a technology, a brand a cluster ----


def star(s, d):
    li, o, c, n, p = (table(s, d, t) for t in ("lineitem", "orders", "customer", "nation", "part"))
    x = li.select("l_orderkey", "l_partkey").join(o.select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year")), F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(n.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")).join(p.select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return x.select("l_orderkey", "year", "n_name", "p_brand", "p_type")


_STAR = "st AS (SELECT l_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, n_name, p_brand, p_type FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"
_STAR_SAL = """tn AS (SELECT n_name, count(*) AS tech_n FROM st GROUP BY ALL), tc AS (SELECT n_name, p_brand, count(*) AS n FROM st GROUP BY ALL),
  sal AS (SELECT n_name, p_brand, coalesce(n, 0) AS n, tech_n, coalesce(n, 0) / tech_n AS share FROM tn CROSS JOIN (SELECT DISTINCT p_brand FROM st) LEFT JOIN tc USING (n_name, p_brand))"""


@q("star_salience", f"WITH {_STAR}, {_STAR_SAL} SELECT n_name, p_brand, n, tech_n, round(share, 6) AS share FROM sal")
def _(s, d):
    return rounded(S.salience(star(s, d), "n_name", "p_brand"), "share")


@q("star_profile", f"WITH {_STAR}, ph AS (SELECT * FROM st), {_DIST.format(g='p_brand', c='n_name')} SELECT p_brand, total, categories, {r6('entropy_raw')} AS entropy_raw, {r6('hhi')} AS hhi, {r6('topk_share')} AS topk_share, {r6('entropy_raw / ln((SELECT count(DISTINCT n_name) FROM st))')} AS entropy_norm FROM dist")
def _(s, d):
    return rounded(M.group_distribution(star(s, d), "p_brand", "n_name", basis="global"), "entropy_raw", "hhi", "topk_share", "entropy_norm")


@q("star_diversity_by_year", f"WITH {_STAR}, ph AS (SELECT * FROM st), {_DIST.format(g='year', c='p_brand')} SELECT year, total, {_DIV} FROM dist")
def _(s, d):
    return rounded(Y.diversity_by(star(s, d), "year", "p_brand"), "entropy_raw", "entropy_norm", "hhi", "topk_share")


@q("star_year_doc_fraction", f"WITH {_STAR}, hit AS (SELECT year, p_brand, count(DISTINCT l_orderkey) AS n_docs FROM st GROUP BY ALL), dy AS (SELECT year, count(DISTINCT l_orderkey) AS year_docs FROM st GROUP BY ALL) SELECT year, p_brand, coalesce(n_docs, 0) AS n_docs, year_docs, round(coalesce(n_docs, 0) / year_docs, 6) AS fraction FROM dy CROSS JOIN (SELECT DISTINCT p_brand FROM hit) LEFT JOIN hit USING (year, p_brand)")
def _(s, d):
    x = star(s, d)
    docs = x.select("l_orderkey", "year").distinct()
    return rounded(Y.year_doc_fraction(x.select("l_orderkey", "p_brand"), docs.withColumn("doc", F.col("l_orderkey")), "p_brand", chunk="l_orderkey", doc="doc"), "fraction")


@q("star_trend_slope", f"""WITH {_STAR}, m AS (SELECT year, p_brand, count(*) AS n FROM st GROUP BY ALL), r AS (SELECT *, n / sum(n) OVER (PARTITION BY year) AS relative FROM m), yt AS (SELECT year, row_number() OVER (ORDER BY year) - 1 AS t FROM (SELECT DISTINCT year FROM m)),
  sl AS (SELECT p_brand, round(regr_slope(relative, t), 9) AS slope FROM r JOIN yt USING (year) GROUP BY ALL),
  u AS (SELECT *, row_number() OVER (ORDER BY slope, p_brand) AS place, 'bottom' AS "end" FROM sl QUALIFY place <= 8 UNION ALL SELECT *, row_number() OVER (ORDER BY slope DESC, p_brand) AS place, 'top' AS "end" FROM sl QUALIFY place <= 8)
  SELECT p_brand, {r6('slope')} AS slope, CASE WHEN slope > 0 THEN 'rising' ELSE 'declining' END AS direction, place, "end" FROM u""")
def _(s, d):
    m = Y.dense_years(Y.year_counts(star(s, d), "p_brand"), "p_brand", "n")
    return rounded(Y.trend_slopes(Y.row_relative(m, "n"), "p_brand", "relative"), "slope")


# --- events ---------------------------------------------------------------------------------------


@q("event_day_counts", "SELECT date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def _(s, d):
    x = streams.windowed_counts(table(s, d, "events"), "ts", "event_type", value="value")
    return x.withColumn("total", F.round("total", 4))


@q("event_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL),
  k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", user_id, count(*) AS n FROM k GROUP BY user_id, k""")
def _(s, d):
    return streams.sessions(table(s, d, "events"), "ts", "user_id")


@q("event_deduplicated", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT event_id, user_id, event_type FROM events) GROUP BY ALL")
def _(s, d):
    return streams.deduplicated(table(s, d, "events"), ["event_id"], "ts").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@q("event_first_last", "SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM events GROUP BY ALL")
def _(s, d):
    w = Window.partitionBy("user_id")
    return table(s, d, "events").withColumns({"first_ts": F.min("ts").over(w), "last_ts": F.max("ts").over(w)}).groupBy("user_id", "first_ts", "last_ts").agg(F.count("*").alias("n"))
