import itertools

from hypothesis import given, settings, strategies as st

from themeweave.llm.looks import look_alike_classes, look_alikes, visual_form, visual_forms, visual_forms_of

SAME = [
    ("ＡＢ１２，", "AB12,"), ("ﬁlm staﬀ", "film staff"), ("été", "été"), ("a b c\td\ne", "a b c d e"),
    ("so­f​t﻿⁠‎", "soft"), ("реорlе ο", "people o"), ("ё", "ë"), ("Å", "Å"), ("👍️", "👍"),
]
DIFFERENT = [("Case", "case"), ("resume", "résumé"), ("m2", "m²"), ("1", "l"), ("O", "0"), ("a b", "ab"), ("a.b", "a,b"), ("и", "u"), ("a  b", "a b"), ("½", "1/2")]


def test_same_and_different():
    for a, b in SAME:
        assert visual_form(a) == visual_form(b), (a, b)
    for a, b in DIFFERENT:
        assert visual_form(a) != visual_form(b), (a, b)
    assert visual_form("Straße ÀB", fold_case=True) == "strasse àb"


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_idempotent(text):
    once = visual_form(text)
    assert visual_form(once) == once


def test_pairs_against_brute_force(spark):
    base = ["the long text", "tһe long text", "the long text", "The long text", "other", "other", "", None, " ​", " ", "othеr", "unique"]
    rows = [(i, t, "x") for i, t in enumerate(base * 2)] + [(0, base[0], "again")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, look string")
    docs = {i: t for i, t, _ in rows if t is not None and visual_form(t).strip()}
    want = {(a, b) for a, b in itertools.combinations(sorted(docs), 2) if docs[a] != docs[b] and visual_form(docs[a]) == visual_form(docs[b])}
    got = [(r.doc_id_a, r.doc_id_b) for r in look_alikes(df, "doc_id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert look_alikes(df.limit(0), "doc_id", "text").count() == 0
    forms = {r.doc_id: r.form for r in visual_forms(df, "doc_id", "text").collect()}
    assert forms[7] is None and forms[6] == "" and forms[1] == "the long text"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=12), max_size=12), st.booleans())
def test_together_as_one_by_one(texts, fold):
    assert visual_forms_of(texts, fold) == {t: visual_form(t, fold) for t in texts}


def test_letters_of_the_same_shape():
    for a, b in (("ɑ", "a"), ("ɡ", "g"), ("ᴏ", "o"), ("ѵ", "v"), ("ꓮꓐꓚ", "ABC")):
        assert visual_form(a) == visual_form(b)
    assert visual_form("ı") != visual_form("i") and visual_form("é") != visual_form("e")


def test_classes(spark):
    rows = [(1, "Wind"), (2, "Wind"), (3, "Wіnd"), (4, "W\u200bind"), (5, "other"), (6, "other"), (7, None), (8, "\u200b"), (3, "Wіnd")]
    got = {tuple(r) for r in look_alike_classes(spark.createDataFrame(rows, "id int, t string"), "id", "t").collect()}
    assert got == {(i, 1, 3, 4) for i in (1, 2, 3, 4)}
    assert look_alike_classes(spark.createDataFrame(rows, "id int, t string").limit(0), "id", "t").count() == 0
