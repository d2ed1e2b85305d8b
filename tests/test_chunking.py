from themeweave.operators import chunking as C

LONG = "This is sentence one. " * 30
PARA = " ".join(["word"] * 60)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc string, text string, blocks array<string>")


def methods(df):
    return [r.chunking_method for r in df.orderBy("chunk_index").collect()]


def test_paragraph_mode(spark):
    d = docs(spark, [("a", "\n\n".join([PARA] * 5), None)])
    assert methods(C.chunk_documents(d, "doc", "text", "blocks")) == ["paragraph"] * 5


def test_long_paragraphs_are_split(spark):
    d = docs(spark, [("a", "\n\n".join([PARA] * 3 + [LONG]), None)])
    out = C.chunk_documents(d, "doc", "text", "blocks", max_words=100, target=50)
    assert set(methods(out)) == {"paragraph", "sentence_split"}
    assert out.filter("word_count > 100").count() == 0


def test_fallback_and_floors(spark):
    d = docs(spark, [("a", "One short sentence here. Another one follows now. " * 20, None), ("b", None, None), ("c", "", None)])
    out = C.chunk_documents(d, "doc", "text", "blocks", min_words=5, min_chars=10)
    assert set(methods(out)) == {"sentence_fallback"} and {r.doc for r in out.collect()} == {"a"}


def test_blocks_win_and_index_counts_dropped(spark):
    d = docs(spark, [("a", "whatever", [PARA, "tiny", PARA, PARA])])
    out = C.chunk_documents(d, "doc", "text", "blocks")
    assert [r.chunk_index for r in out.orderBy("chunk_index").collect()] == [0, 2, 3]
    assert [r.chunk_id for r in out.orderBy("chunk_index").collect()] == ["a__0", "a__2", "a__3"]


def test_truncation_and_stats(spark):
    d = docs(spark, [("a", "x " * 700, None), ("b", "\n\n".join([PARA] * 3), None)])
    cand = C.chunk_candidates(d, "text", "blocks")
    s = {r["stat"]: r["value"] for r in C.chunk_stats(cand, "doc").collect()}
    assert s["paragraphs_seen"] == 4 and s["paragraphs_truncated"] == 1 and s["documents_sentence_fallback"] == 1 and s["documents_paragraph_only"] == 1
    t = C.keep_chunks(cand, "doc").filter("was_truncated").first()
    assert t.word_count == 500 and len(t.text.split()) == 500


def test_html_blocks(spark):
    df = spark.createDataFrame([("<html><style>x{}</style><p>One  <b>two</b></p><div>three<br/>four</div></html>",)], "h string")
    assert df.select(C.html_blocks("h")).first()[0] == ["One two", "three", "four"]


def test_summary(spark):
    df = spark.createDataFrame([("a", "paragraph", True), ("a", "sentence_split", False), ("b", None, None)], "d string, chunking_method string, was_truncated boolean")
    assert {tuple(r) for r in C.doc_summary(df, "d").collect()} == {("a", 2, "paragraph+sentence_split", 1), ("b", 1, "", 0)}
