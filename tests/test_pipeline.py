import os
import time

import pytest
from pyspark.sql import functions as F

from themeweave import config
from themeweave.operators import extraction as E, trace as X
from themeweave.plans.inputs import bridge, labels
from themeweave.sources import catalog, readers, sinks
from themeweave.streaming import streams


class FakeClient:
    def __init__(self, replies):
        self.replies, self.calls = list(replies), 0

    def complete(self, messages, max_tokens):
        self.calls += 1
        r = self.replies.pop(0)
        if isinstance(r, Exception):
            raise r
        return r

    def embed(self, texts):
        return [[float(len(t)), 1.0] for t in texts]


def test_retry_waits_and_gives_up():
    waits = []
    c = FakeClient([E.RateLimitError(), E.RateLimitError(), "done"])
    assert E.complete_with_retry(c, [], sleep=waits.append, draw=lambda: 1.0) == "done" and waits == [1.0, 2.0]
    with pytest.raises(E.RateLimitError):
        E.complete_with_retry(FakeClient([E.RateLimitError()] * 3), [], max_retries=2, sleep=waits.append)
    with pytest.raises(KeyError):
        E.complete_with_retry(FakeClient([KeyError("x")]), [], sleep=waits.append)
    capped = []
    E.complete_with_retry(FakeClient([E.RateLimitError()] * 8 + ["ok"]), [], max_retries=8, sleep=capped.append, draw=lambda: 1.0)
    assert max(capped) == 60.0


def test_limiter_keeps_its_rate():
    now = [0.0]
    lim = E.SlidingWindowLimiter(3, 10.0, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    times = []
    for _ in range(7):
        lim.acquire()
        times.append(now[0])
    assert all(b - a >= 10.0 for a, b in zip(times, times[3:]))


def replies(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, content string, error string")


def test_parse_replies_and_yields(spark):
    r = replies(spark, [("c1", "lost jobs\n ai systems \nNO_CONCERN\n\nmore waste", None), ("c2", "NO_CONCERN", None), ("c3", None, None), ("c4", None, "Timeout: x"), ("c5", "I don't have the text you mean", None), ("c6", "   ", None)])
    x = E.parse_replies(r, "concern")
    got = {a.chunk_id: a for a in x.collect()}
    assert got["c1"].retained_phrases == ["lost jobs", "more waste"] and [d.tech_word for d in got["c1"].dropped_by_filter] == ["ai"]
    assert all(got[c].sentinel_returned for c in ("c2", "c3", "c5", "c6")) and not got["c4"].sentinel_returned and got["c4"].raw_phrases == []
    y = E.yield_summary(x).first()
    assert (y.total_chunks, y.sentinel_empties, y.filter_drops_chunks, y.filter_drops_total, y.error_chunks, y.retained_phrases) == (6, 4, 1, 1, 1, 2)
    ph = E.explode_phrases(x).orderBy("phrase_idx").collect()
    assert [p.phrase_id for p in ph] == ["c1__concern__0", "c1__concern__1"]
    assert not E.cache_is_valid(x) and not E.cache_is_valid(x.limit(0)) and E.cache_is_valid(x.filter("chunk_id = 'c1'"))
    assert E.check_failures(x) == pytest.approx(1 / 6)
    with pytest.raises(RuntimeError):
        E.check_failures(x, on_failure="raise")
    with pytest.raises(ValueError):
        E.parse_replies(r, "risk")


def test_model_calls_and_increment(spark):
    chunks = spark.createDataFrame([("c1", "x"), ("c2", "boom"), ("c3", "y")], "chunk_id string, text string").coalesce(1)

    class Client:
        def complete(self, messages, max_tokens):
            if "boom" in messages[1]["content"]:
                raise ValueError("no")
            return "first\nsecond"

    def extract(c):
        return E.parse_replies(E.call_model(c, "concern", Client), "concern")

    first = extract(chunks.filter("chunk_id <> 'c3'")).cache()
    assert {r.chunk_id for r in E.chunks_to_run(chunks, first).collect()} == {"c2", "c3"}
    assert E.retry_failed(chunks, first, extract, dry_run=True).first().to_run == 2
    both = E.retry_failed(chunks, first, lambda c: extract(c.withColumn("text", F.lit("fine"))))
    assert {r.chunk_id: r.error for r in both.collect()} == {"c1": None, "c2": None, "c3": None}


def test_offline_extractor(spark):
    c = spark.createDataFrame([("a", "One two three. This sentence names ai systems here. No. " + "w " * 12 + "end."), ("b", None)], "chunk_id string, text string")
    got = {r.chunk_id: r for r in E.extract_offline(c, "benefit").collect()}
    assert got["a"].retained_phrases == ["One two three."] and len(got["a"].dropped_by_filter) == 1 and got["b"].sentinel_returned


def test_embedding_is_once_per_text(spark):
    df = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "bbb"), (4, None)], "i int, t string")
    got = {r.i: r.embedding for r in E.embed_texts(df, "t", lambda: FakeClient([])).collect()}
    assert got == {1: [2.0, 1.0], 2: [2.0, 1.0], 3: [3.0, 1.0], 4: None}


def test_labels_and_lenses():
    good = E.label_cluster(3, ["a", "b"], lambda p: '```json\n{"label": "L", "key_terms": ["x"]}\n```')
    assert good.success and good.label == "L" and good.key_terms == ["x"]
    assert E.label_cluster(3, ["a"], lambda p: "nonsense").label == "Cluster 3"
    with pytest.raises(RuntimeError):
        E.label_clusters({1: ["a"], 2: ["b"]}, lambda p: None)
    seen = []
    E.label_cluster(1, [f"phrase {i}" for i in range(12)], lambda p: seen.append(p))
    assert "phrase 7" in seen[0] and "phrase 8" not in seen[0]
    calls = iter([{"big": [0, 1], "small": [2]}, {"small": [3]}])
    assert E.assign_lenses({0: "a", 1: "b", 2: "c", 3: "d", 4: "e"}, lambda left: next(calls)) in ({"big": [0, 1, 4], "small": [2, 3]}, {"big": [0, 1], "small": [2, 3, 4]})


@pytest.fixture()
def traced(spark):
    chunks = spark.createDataFrame([("c1", "r1", 0, "T", "text <one>"), ("c2", "r1", 1, "T", "two"), ("c3", "r2", 0, None, "three")], "chunk_id string, source_file string, chunk_index int, technology_meta string, text string")
    ph = spark.createDataFrame([("c1", 2, "b", 1), ("c1", 1, "a", 7), ("c2", 3, None, None)], "chunk_id string, phrase_id int, phrase string, cluster_id int")
    return X.paragraph_trace(chunks, ph, labels(ph), bridge(ph))


def test_trace_and_evidence(spark, traced, tmp_path):
    got = {r.chunk_id: r for r in traced.collect()}
    assert got["c1"].extracted_concerns == ["a", "b"] and got["c1"].cluster_ids == [7, 1] and got["c1"].framing_lenses == ["lens_0", "lens_1", "lens_7"]
    assert got["c3"].extracted_concerns == [] and got["c3"].paragraph_id == "r2::p0" and got["c2"].framing_lenses == []
    assert {(r.paragraph_id, r.cluster_id) for r in X.explode_trace(traced).collect()} == {("r1::p0", 7), ("r1::p0", 1)}
    paths = X.export_evidence_pack(traced, str(tmp_path))
    assert all(os.path.exists(p) for p in paths.values())
    html = "\n".join(r.value for r in spark.read.text(paths["html"]).collect())
    assert "text &lt;one&gt;" in html and html.index("r1::p0") < html.index("r1::p1")
    assert spark.read.json(paths["jsonl"]).count() == 3
    back = spark.read.option("header", True).option("escape", '"').csv(paths["csv"])
    assert back.filter("chunk_id = 'c1'").first().cluster_ids == "[7,1]"
    assert sinks.zip_folder(str(tmp_path), str(tmp_path / ".." / "out.zip")).endswith("out.zip")


def test_samples(spark):
    df = spark.createDataFrame([(f"c{i}", "big" if i < 900 else "small" if i < 905 else None) for i in range(920)], "chunk_id string, t string")
    s = X.quota_sample(df, "t", "chunk_id", n=100, floor=10)
    n = {r.t: r["count"] for r in s.groupBy("t").count().collect()}
    assert n == {"big": 99, "small": 5}
    assert sorted(r.chunk_id for r in s.collect()) == sorted(r.chunk_id for r in X.quota_sample(df.repartition(7), "t", "chunk_id", n=100, floor=10).collect())
    assert {r.t: r["count"] for r in X.even_sample(df, "t", "chunk_id", 20).groupBy("t").count().collect()} == {"big": 10, "small": 5}


def test_catalog(spark, tmp_path):
    cat = catalog.Catalog(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        cat.load_all()
    assert cat.load("cluster_labels") is None
    ph = spark.createDataFrame([("concern", "p1", "c1", 0, "x", None, "T", 2020, "d", 1)], catalog.schema_of("phrases"))
    assert cat.save("phrases", ph).filter("track = 'concern'").count() == 1
    assert os.path.isdir(tmp_path / "phrases.parquet" / "track=concern")
    for name in catalog.REQUIRED:
        if name != "phrases":
            cat.save(name, readers.empty(spark, name))
    assert set(cat.load_all()) == {*catalog.REQUIRED, *catalog.OPTIONAL}
    v = {(r.section, r.key): (r.value, r.status) for r in cat.validation_summary({"concern": 2}).collect()}
    assert v["rows", "phrases"] == ("1", "OK") and v["rows", "cluster_labels"] == ("-1", "MISSING") and v["clusters", "concern"] == ("1", "MISMATCH")


def test_readers_and_sinks(spark, tmp_path):
    assert readers.read_csv_safe(spark, str(tmp_path / "none.csv"), "a int").count() == 0
    (tmp_path / "blank.csv").write_text("")
    assert readers.read_csv_safe(spark, str(tmp_path / "blank.csv"), "a int").columns == ["a"]
    df = spark.createDataFrame([(1, 'say "x"\nnow', ["a", "b"])], "i int, s string, l array<string>")
    sinks.write_csv(df, str(tmp_path / "t.csv"))
    back = readers.read_csv_safe(spark, str(tmp_path / "t.csv"), "i int, s string, l string").first()
    assert back.s == 'say "x"\nnow' and back.l == '["a","b"]'
    (tmp_path / "m.csv").write_text("filename,technology,year\na.pdf,T,2020\nb.pdf,,n/a\n")
    assert [tuple(r) for r in readers.read_metadata(spark, str(tmp_path / "m.csv")).orderBy("filename").collect()] == [("a.pdf", "T", 2020), ("b.pdf", None, None)]
    (tmp_path / "bad.csv").write_text("filename,year\na,1\n")
    with pytest.raises(ValueError, match="technology"):
        readers.read_metadata(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "pdfs").mkdir()
    (tmp_path / "pdfs" / "one.pdf").write_bytes(b"page one|page two")
    (tmp_path / "pdfs" / "two.pdf").write_bytes(b"\xff")
    got = {r.source_file: r for r in readers.read_pdf(spark, str(tmp_path / "pdfs"), lambda b: (b.decode().split("|"), [" a  b ", ""])).collect()}
    assert got["one.pdf"].full_text == "page one\npage two" and got["one.pdf"].blocks == ["a b"] and got["two.pdf"].error.startswith("UnicodeDecodeError")
    sinks.write_html(df.drop("l"), str(tmp_path / "t.html"))
    assert "<table" in (tmp_path / "t.html").read_text()


def test_config(monkeypatch):
    monkeypatch.setenv("TW_HOME", "/x")
    got = config.layered({"a": 1, "n": {"x": 1, "y": 2}}, {"p": "$TW_HOME/out", "n": {"y": 3}})
    assert got == {"a": 1, "n": {"x": 1, "y": 3}, "p": "/x/out"}
    assert config.stage(config.AccessStage, {"min_chunk_words": 5, "other": 1}).min_chunk_words == 5


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    (tmp_path / "in").mkdir()
    events.repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.stream_table(spark, str(tmp_path / "in"), events.schema, files_per_trigger=1)
    query = streams.windowed_counts(stream, "ts", "event_type", late="3650 days").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    shown = F.date_format("start", "yyyy-MM-dd").alias("day")
    got = {(r.day, r.event_type): r.n for r in spark.table("counts").select(shown, "event_type", "n").collect()}
    want = {(r.day, r.event_type): r.n for r in streams.windowed_counts(events, "ts", "event_type").select(shown, "event_type", "n").collect()}
    assert got == want
    chunks = spark.createDataFrame([(f"c{i}", "One two three.") for i in range(5)], "chunk_id string, text string")
    chunks.write.parquet(str(tmp_path / "chunks"))
    for _ in range(2):
        q = streams.extract_stream(streams.stream_table(spark, str(tmp_path / "chunks"), chunks.schema), lambda c: E.extract_offline(c, "concern"), str(tmp_path / "ex"), str(tmp_path / f"cp{_}"))
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "ex")).count() == 5


def test_labels_know_their_track_and_cache():
    asked = []
    complete = lambda prompt: asked.append(prompt) or '{"label": "L"}'
    first = E.label_clusters({1: ["a"], 2: ["b"]}, complete, kind="benefit")
    assert "benefits" in asked[0] and len(asked) == 2
    assert E.label_clusters({1: ["a"], 3: ["c"]}, complete, cached=first)[1] is first[1] and len(asked) == 3
    with pytest.raises(ValueError):
        E.label_cluster(1, ["a"], complete, "opinion")
    group = lambda left: asked.append(left) or {"new": list(left)}
    assert E.assign_lenses({1: "x", 2: "y"}, group, cached={"old": [1, 9]}) == {"old": [1], "new": [2]} and asked[-1] == {2: "y"}
    assert E.assign_lenses({1: "x"}, group, cached={"old": [1]}) == {"old": [1]} and asked[-1] == {2: "y"}


def test_calls_share_one_budget_and_run_side_by_side(spark):
    class Slow:  # made in the test, so that workers need not import this module
        under_way = 0

        def complete(self, messages, max_tokens):
            self.under_way += 1
            seen = self.under_way
            time.sleep(0.2)
            self.under_way -= 1
            return str(seen)

        def embed(self, texts):
            raise RuntimeError("down")

    chunks = spark.createDataFrame([(f"c{i}", "text") for i in range(20)], "chunk_id string, text string")
    out = E.call_model(chunks.coalesce(1), "concern", Slow, variant="V3", calls_at_once=10).collect()
    assert len(out) == 20 and max(int(r.content) for r in out) > 1
    assert E.call_model(chunks, "concern", Slow, calls_per_minute=60, tasks=3).rdd.getNumPartitions() == 3
    with pytest.raises(Exception, match="batches that failed, by the place of their first text: 0 .*, 5 "):
        E.embed_texts(chunks.select(F.col("chunk_id").alias("t")).coalesce(1), "t", Slow, batch=5).collect()
