import re

import pytest
from pyspark.sql import functions as F

from themeweave.functions import text as T


def col(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr("v").alias("x")).collect()]


def test_parse_year(spark):
    values = ["2019", "Report 2021-04", "n/a", None, "1800", "2200", "1900", "2100", "20", "2021.0", ""]
    assert col(spark, values, T.parse_year) == [2019, 2021, None, None, None, None, 1900, 2100, None, 2021, None]


def test_windows(spark):
    got = col(spark, [2010, 2017, 2018, 2020, 2021, 2023, 2024, None], T.assign_window, "int")
    assert got == ["2004-2017", "2004-2017", "2018-2020", "2018-2020", "2021-2023", "2021-2023", "2024-2025", None]


def test_tokens(spark):
    assert col(spark, ["Hello, world!", "the AI and robots", "", None], T.tokenize) == [["hello", "world"], ["robots"], [], None]
    assert col(spark, ["a b", "one two three", "one", "", "café tables"], lambda c: T.bigrams(T.vocab_tokens(c))) == [[], ["one two", "two three"], [], [], []]


def test_tech_words_keep_word_borders(spark):
    values = ["stigma of it", "algorithm", "gm crops", "ai systems", "maintaining", "brain-computer links", "éai", None]
    assert col(spark, values, T.first_tech_word) == [None, None, "gm", "ai", None, "brain-computer", None, None]
    assert col(spark, ["an algorithm", "A Gene", "genealogy", None], lambda c: T.contains_term(c, T.TECH_TERMS_WIDE)) == [True, True, False, False]


def test_quality_patterns(spark):
    assert col(spark, ["Smith et al. doi:10.1000/xyz (2020)", "See doi:10.1000/xyz for details.", "vol.3 (1999)", "vol. 3 (1999)", None], T.looks_like_bibliography) == [True, False, True, False, False]
    assert col(spark, ["Agrees 45% Disagrees 30%", "one %", "", None], T.looks_like_table_row) == [True, False, False, False]
    assert col(spark, ["data sharing rules", "identifiable", "IDENTIF", None], T.is_privacy_text) == [True, False, True, False]
    assert col(spark, ["x", "  \n", "", None], T.is_missing_text) == [False, True, True, True]


def test_list_columns(spark):
    got = col(spark, ["[1, 2, 3]", "", "[]", None, "['a', 'b']", '["it\'s", "b"]', "a, b"], T.parse_listcol)
    assert got == [["1", "2", "3"], [], [], [], ["a", "b"], ["it's", "b"], ["a", "b"]]


def test_cleaning_and_labels(spark):
    assert col(spark, ["hello\x0bworld", "a\x01b", "line1\nline2\ttabbed", None], T.clean_control) == ["helloworld", "ab", "line1\nline2\ttabbed", None]
    assert col(spark, ["<a & 'b'>", '"q"'], T.html_escape) == ["&lt;a &amp; &#x27;b&#x27;&gt;", "&quot;q&quot;"]
    df = spark.createDataFrame([(1, None), (2, "x" * 41), (3, "short"), (4, " ")], "c int, l string")
    assert [r[0] for r in df.orderBy("c").select(T.pretty_label("c", "l")).collect()] == ["Cluster 1", "x" * 37 + "...", "short", "Cluster 4"]
    assert df.filter("c = 2").select(T.heatmap_label("c", "l")).first()[0] == "x" * 40 + "…"


def test_llm_json(spark):
    got = col(spark, ['```json\n{"label": "a", "n": 1}\n```', '{"label": "b"}', "no json", None], lambda c: T.parse_llm_json(c, "label string, n int"))
    assert [g and g.label for g in got] == ["a", "b", None, None]


def sentences(text):
    flat = " ".join(text.split())
    return [s.strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-Z\d])", flat) if s.strip()]


def repack(parts, target):
    done, cur, n = [], [], 0
    for p in parts:
        k = len(p.split())
        if k >= target:
            if cur:
                done.append(" ".join(cur))
            done.append(p)
            cur, n = [], 0
        elif cur and n + k > target:
            done.append(" ".join(cur))
            cur, n = [p], k
        else:
            cur.append(p)
            n += k
    return done + ([" ".join(cur)] if cur else [])


@pytest.mark.parametrize("target", [5, 40])
def test_sentences_and_packing_match_plain_python(spark, sf, target):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("text IS NOT NULL").select("doc_id", "text")
    got = docs.select("doc_id", "text", T.split_sentences("text").alias("s"), T.repack_sentences(T.split_sentences("text"), target).alias("r"), T.word_count("text").alias("n")).collect()
    for r in got:
        assert r.s == sentences(r.text) and r.r == repack(sentences(r.text), target) and r.n == len(r.text.split()), r.doc_id


def test_percent(spark):
    assert spark.range(1).select(T.percent(F.lit(0.1234))).first()[0] == "12.3%"
