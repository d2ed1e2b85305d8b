import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from themeweave.llm.encode import TOKENIZER, encode_texts, encoder, token_sizes
from themeweave.llm.pack import best_fit, limits, pack_items


@pytest.fixture(scope="module")
def public():
    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return t


def test_all_documents(spark, sf, public):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r.doc_id: r.ids for r in encode_texts(docs, "doc_id", "text").collect()}
    rows = docs.select("doc_id", "text").collect()
    want = public.encode_batch([r.text or "" for r in rows], add_special_tokens=False)
    assert len(ids) == len(rows)
    assert all(ids[r.doc_id] == w.ids for r, w in zip(rows, want))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdefghijklmnopqrstuvwxyz 'étïñ\n\t09,."), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_any_text(text):
    t = Tokenizer.from_file(TOKENIZER) if not hasattr(test_any_text, "t") else test_any_text.t
    test_any_text.t = t
    t.encode_special_tokens = True
    assert encoder(TOKENIZER).encode_batch([text]) == [t.encode(text, add_special_tokens=False).ids]


def test_pair_check_is_exact(public):
    e = encoder(TOKENIZER)
    rng = random.Random(5)
    tokens = [t for t in e.ids if len(t) < 8]
    pairs = [(rng.choice(tokens), rng.choice(tokens)) for _ in range(3000)]
    a, b = (np.array([e.ids[p[k]] for p in pairs]) for k in (0, 1))
    want = [e._exact(x + y) == [e.ids[x], e.ids[y]] for x, y in pairs]
    assert e.compatible(a, b).tolist() == want
    assert 0 < sum(want) < len(want)


def test_one_unbroken_word_of_a_million_signs(public):
    rng = random.Random(7)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    began = time.time()
    got = encoder(TOKENIZER).encode_batch([word])[0]
    assert time.time() - began < 60
    assert got[:200_000] == public.encode(word, add_special_tokens=False).ids[:200_000]


def test_null_empty_special_long(spark, public):
    rows = [(1, None, 0), (2, "", 0), (3, "<|endoftext|> x", 0), (4, "a" * 40000, 0), (5, " \n ", 0)]
    df = spark.createDataFrame(rows, "doc_id int, text string, ids int")
    got = {r.doc_id: r.ids for r in encode_texts(df, "doc_id", "text").collect()}
    assert got[1] == [] and got[2] == []
    for i, t, _ in rows[2:]:
        assert got[i] == public.encode(t, add_special_tokens=False).ids
    assert {r.doc_id: r.n_tokens for r in token_sizes(df, "doc_id", "text").collect()} == {i: len(v) for i, v in got.items()}
    assert encode_texts(df.limit(0), "doc_id", "text").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 64), min_size=1, max_size=300))
def test_best_fit_keeps_every_limit(sizes):
    cap, most, attention = 64, 9, 0.6 * 64 * 64
    sizes = [min(s, 40) for s in sizes]
    place = best_fit(np.array(sizes), cap, most, attention)
    load, square, n = Counter(), Counter(), Counter()
    for s, p in zip(sizes, place.tolist()):
        load[p] += s
        square[p] += s * s
        n[p] += 1
    assert max(load.values()) <= cap and max(n.values()) <= most and max(square.values()) <= attention


def test_items_and_attention_bind():
    """Every limit holds, and each of them changes the placement that tokens alone would give."""
    rng = np.random.default_rng(1)
    sizes = np.minimum(rng.lognormal(5.1, 0.9, 3_000).astype(int), 2_048)
    cap = 2_048
    most, attention = limits(cap)
    place = best_fit(sizes, cap, most, attention)
    load, square, n = (np.bincount(place, weights=w) for w in (sizes, sizes.astype(float) ** 2, np.ones(len(sizes))))
    assert load.max() <= cap and n.max() <= most and (square[n > 1] <= attention).all()
    assert sizes.sum() / (cap * len(load)) >= 0.98
    tokens = best_fit(sizes, cap, 10**9, 1e18, (1.0, 0.0, 0.0))
    assert (np.bincount(tokens).max() > most) and (np.bincount(tokens, weights=sizes.astype(float) ** 2)[np.bincount(tokens) > 1] > attention).any()
    assert (place != tokens).mean() > 0.02
    assert (best_fit(sizes, cap, most, 1e18) != tokens).any() and (best_fit(sizes, cap, 10**9, attention) != tokens).any()


def test_packing(spark):
    rng = random.Random(9)
    sizes = {i: 0 if i % 50 == 0 else rng.choice([rng.randrange(2, 120), rng.randrange(2, 60)]) for i in range(4000)}
    sizes |= {9001: 100, 9002: 101, 9003: 1000, 9004: 350}
    rows = [(i, s, "x") for i, s in sizes.items()] + [(1, sizes[1], "again"), (9005, None, "n"), (None, 5, "n")]
    items = spark.createDataFrame(rows, "id bigint, size int, container string")
    kinds = spark.createDataFrame([("s", 100), ("m", 400), ("none", None), (None, 5)], "kind string, cap int")
    got = pack_items(items, "id", "size", kinds, "kind", "cap", shard_items=700, tokens_per_item=4, attention_share=1.0).collect()
    for kind, cap in (("s", 100), ("m", 400)):
        mine = [r for r in got if r.kind == kind]
        boxes, pieces = defaultdict(list), defaultdict(list)
        for r in mine:
            boxes[r.container].append(r["size"])
            pieces[r.id].append((r.piece, r["size"]))
            assert r.fill <= cap
        assert set(pieces) == set(sizes) | {9005}
        for i, p in pieces.items():
            p.sort()
            assert sum(s for _, s in p) == sizes.get(i, 0) and [k for k, _ in p] == list(range(len(p)))
            assert len(p) == 1 if sizes.get(i, 0) <= cap else all(s == cap for _, s in p[:-1])
        assert max(map(sum, boxes.values())) <= cap and max(map(len, boxes.values())) <= limits(cap, 4)[0]
        assert sum(sizes.values()) / (cap * len(boxes)) > 0.97
    assert pack_items(items.limit(0), "id", "size", kinds, "kind", "cap").count() == 0
    assert pack_items(items, "id", "size", kinds.limit(0), "kind", "cap").count() == 0
