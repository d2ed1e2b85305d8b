import math
import random

from hypothesis import given, settings, strategies as st

from themeweave.llm.split import _Borders, _plan, split_oversized, split_spans

ALPHABET = st.sampled_from(list("ab .,\n!?é中。") + ["\n\n", "👩‍🔬", "é", "word "])


def check(text, limit, overlap):
    spans = split_spans(text, limit, overlap)
    assert "".join(text[m:e] for _, m, e in spans) == text
    for s, m, e in spans:
        assert 0 < e - s <= limit and 0 <= m - s <= overlap and m < e
    for before, after in zip(spans, spans[1:]):
        assert after[1] == before[2] and after[0] > before[0]
    return spans


@settings(max_examples=150, deadline=None)
@given(st.lists(ALPHABET, max_size=400).map("".join), st.integers(2, 80), st.data())
def test_invariants(text, limit, data):
    check(text, limit, data.draw(st.integers(0, limit - 1)))


def test_cuts_lie_at_the_strongest_boundary():
    text = ("A sentence of some length, with a clause. " * 20).strip() + "\n\n" + ("Another sentence follows here. " * 28).strip()
    spans = check(text, 1000, 0)
    assert len(spans) == 2 and text[: spans[0][2]].endswith("\n\n")


def test_fewest_balanced_pieces():
    text = "word " * 1000
    spans = check(text, 2000, 200)
    assert len(spans) == math.ceil((5000 - 200) / 1800)
    sizes = [e - s for s, _, e in spans]
    assert max(sizes) - min(sizes) < 300


def test_no_boundary_at_all_and_marks_stay_joined():
    check("x" * 5001, 2000, 200)
    text = "é" * 3000
    assert all(text[e - 1] != "e" for _, _, e in check(text, 2001, 100))


def test_dataframe(spark):
    rows = [("c1", "f", "word " * 900, 1), ("c1", "f", "word " * 900, 2), ("c2", "f", "short", 1), ("c3", None, "y" * 2001, 1), ("c4", "f", None, 1), ("c5", "f", "", 1), ("c6", "f", "z" * 2000, 1)]
    df = spark.createDataFrame(rows, "chunk_id string, source_file string, text string, start int")
    got = split_oversized(df, ["chunk_id", "source_file"], "text").collect()
    assert {r.chunk_id for r in got} == {"c1", "c3"}
    one = sorted((r for r in got if r.chunk_id == "c1"), key=lambda r: r.piece)
    assert [r.piece for r in one] == list(range(len(one)))
    assert "".join(r.text[r.new_from - r.start :] for r in one) == "word " * 900
    assert split_oversized(df.limit(0), ["chunk_id", "source_file"], "text").count() == 0


def test_no_plan_with_fewer_pieces_fits():
    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice(["word ", "longer words, ", "an end. ", "x" * 90 + " ", "\n\n"]) for _ in range(rng.randrange(300, 900)))
        pieces = check(text, 500, 60)
        least = math.ceil((len(text) - 60) / 440)
        assert not any(_plan(_Borders(text), len(text), count, 500, 60) for count in range(least, len(pieces)))
