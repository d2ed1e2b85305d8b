import itertools
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from themeweave.llm import crf
from themeweave.llm.langs import LanguageModel, label_name
from themeweave.llm.replies import ECHO, FOREIGN, REFUSAL, UNFINISHED, Reply, Tagger, damaged, defective_replies, ending, fit, longest_run

EN = ["the group asked about the cost of care at home", "people said that the new rule was not clear to them", "many of the residents wanted more time before the trial", "they hoped that the data would stay with the council"]
FR = ["les habitants ont demandé le prix de la maison", "la règle n'est pas claire pour les gens du village", "beaucoup de personnes voulaient plus de temps avant l'essai", "ils espèrent que les données restent dans la région"]


def test_label_names():
    assert [label_name(x) for x in ("en-GB", "EN", " fr ", "und", None, "")] == ["en", "en", "fr", None, None, None]


def test_language_model():
    m = LanguageModel.train([(t, "en") for t in EN * 3] + [(t, "fr-x") for t in FR * 3] + [("数据会流出本地", "zh")] * 6 + [("x", None), (None, "en")])
    name = lambda t: m.languages[m.language(t)]
    assert name("the people asked about time") == "en" and name("les gens du village") == "fr" and name("试验数据") == "zh"
    assert m.language("123 --") == -1 and m.language("") == -1


def test_longest_run_against_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        text = [rng.choice("abcd") for _ in range(rng.randrange(30))]
        phrase = [rng.choice("abcd") for _ in range(rng.randrange(12))]
        at = {}
        for i, w in enumerate(text):
            at.setdefault(w, []).append(i)
        want = max([k for k in range(len(phrase) + 1) if any(phrase[j : j + k] == text[i : i + k] for j in range(len(phrase) - k + 1) for i in range(len(text) - k + 1))], default=0)
        assert longest_run(at, text, phrase, 99) == want
        assert longest_run(at, text, phrase, 3) == min(want, 3) or want > 3


def test_viterbi_and_likelihood_against_enumeration():
    rng = np.random.default_rng(8)
    lengths = np.array([3, 1, 0, 4])
    starts = np.array([0, 3, 4, 4])
    e, move, begin, end = rng.standard_normal((8, 3)), rng.standard_normal((3, 3)), rng.standard_normal(3), rng.standard_normal(3)
    got = crf.viterbi(e, starts, lengths, move, begin, end)
    for s, n in zip(starts, lengths):
        if n:
            score = lambda p: begin[p[0]] + end[p[-1]] + sum(e[s + i, t] for i, t in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
            assert tuple(got[s : s + n]) == max(itertools.product(range(3), repeat=int(n)), key=score)


def test_training_learns_a_chain():
    rng = np.random.default_rng(1)
    rows, feats, tags, lengths = [], [], [], []
    for _ in range(200):
        n = int(rng.integers(1, 5))
        t = [int(rng.integers(2))]
        for _ in range(n - 1):
            t.append(1 - t[-1])
        for k, x in enumerate(t):
            rows.append(len(tags))
            feats.append(crf.feature(f"seen {x}" if k == 0 else "nothing"))
            tags.append(x)
        lengths.append(n)
    lengths = np.array(lengths)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    w, move, begin, end = crf.train(np.array(rows), np.array(feats), starts, lengths, np.array(tags), 2)
    e = np.stack([np.bincount(rows, w[feats, t], minlength=len(tags)) for t in range(2)], axis=1)
    assert (crf.viterbi(e, starts, lengths, move, begin, end) == tags).all()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    heads, topics = ["harm to", "loss of control over", "more time for", "hidden costs of", "fear of dependence on"], ["local jobs", "family life", "public services", "clean water", "night workers"]
    fr = ["peur de dépendre de la vie privée", "manque de clarté pour nos enfants", "coûts cachés de la maison"]
    no = ["I'm sorry, but I cannot help with this passage.", "I must decline this request.", "As an assistant, I am not able to answer that."]
    prompts, replies, want = [], [], {}
    for i in range(1600):
        french = i % 4 == 0
        text = " ".join(rng.choice(FR if french else EN) + "." for _ in range(6))
        prompts += [(f"c{i}", text, i)] * (2 if i % 9 == 0 else 1)
        good = rng.choice(fr) if french else f"{rng.choice(heads)} {rng.choice(topics)}"
        kind = [*[None] * 25, "refusal", "copy", "language", "truncated", "empty"][rng.randrange(30)]
        if kind == "truncated" and french:
            kind = None
        phrases = {None: [good], "refusal": [rng.choice(no)], "copy": [good, " ".join(text.replace(".", "").upper().split()[:14])], "language": [f"{rng.choice(heads)} {rng.choice(topics)}" if french else rng.choice(fr)], "truncated": [good, f"{rng.choice(heads)} {rng.choice(topics)} {rng.choice(['and the', 'because of…', 'with', 'of'])}"], "empty": rng.choice([None, [], ["…", "1."]])}[kind]
        replies += [(i, f"c{i}", phrases, rng.choice([False, None]), "x")] * (2 if i % 7 == 0 else 1)
        if kind:
            want[i] = kind
    replies += [(9001, "c1", None, True, "x"), (9002, "nowhere", ["harm to local jobs"], False, "x"), (9003, None, [None, "harm to local jobs"], False, "x"), (9004, "c1", ["NO_CONCERN"], False, "x"), (9005, "c0", ["no_concern."], False, "x"), (None, "c1", ["harm"], False, "x")]
    return (
        spark.createDataFrame(replies, "extraction_id bigint, chunk_id string, raw_phrases array<string>, sentinel_returned boolean, text string"),
        spark.createDataFrame(prompts, "chunk_id string, text string, ident int"),
        spark.createDataFrame([(t, "en") for t in EN * 5] + [(t, "fr") for t in FR * 5] + [(None, "en"), ("x", None)], "text string, lang string"),
        want,
    )


def test_defects(spark, corpus):
    replies, prompts, labelled, want = corpus
    args = ("extraction_id", "chunk_id", "raw_phrases", "sentinel_returned", prompts, "text", labelled, "text", "lang")
    rows = defective_replies(replies, *args).collect()
    got = {r.extraction_id: r.defect for r in rows}
    assert len(got) == len(rows)
    assert {i: got[i] for i in (9001, 9002, 9003, 9004, 9005, None) if i in got} == {}
    assert {i for i, d in got.items() if d == "empty"} == {i for i, d in want.items() if d == "empty"}
    # few texts, the same phrases over and over: the field can't learn much here, but accuses no good reply
    accused = [(i, got[i]) for i in range(1600) if i in got and i not in want]
    assert len(accused) <= 10, accused
    assert sum(got.get(i) == d for i, d in want.items()) >= 0.6 * len(want)
    assert defective_replies(replies.limit(0), *args).count() == 0


def test_held_out_damage(sf):
    """Trained on one half of the replies, the field tells damaged copies of the other half from what it was made of."""
    ch = dict(duckdb.sql(f"SELECT chunk_id, any_value(text) FROM '{sf}/chunks.parquet' GROUP BY 1").fetchall())
    rows = duckdb.sql(f"SELECT extraction_id, any_value(chunk_id), any_value(raw_phrases) FROM '{sf}/extractions.parquet' WHERE len(raw_phrases) > 0 GROUP BY 1 ORDER BY 1").fetchall()
    language = LanguageModel.train(duckdb.sql(f"SELECT text, lang FROM '{sf}/documents.parquet' WHERE text IS NOT NULL AND lang IS NOT NULL ORDER BY doc_id").fetchall())
    inner, ends = Counter(), Counter()
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    for t in ch.values():
        inner.update(words(t))
    for _, _, phrases in rows:
        for p in phrases:
            if w := words(p):
                inner.update(w[:-1])
                ends[w[-1]] += 1
    replies = []
    for _, key, phrases in rows:
        if (w := words(" ".join(p or "" for p in phrases))) and (t := ch.get(key)):
            replies.append(Reply(phrases, language.language(t), t, ending(inner[w[-1]], ends[w[-1]])))
    half = len(replies) // 2
    model = fit(replies[:half], language, each=400)
    tagger = Tagger(language, model.vocabulary, model)
    found = tagger.defects(replies[half:])
    good = [r for r, d in zip(replies[half:], found) if d is None]
    assert len(good) >= 0.88 * (len(replies) - half)  # about one reply in eleven is broken
    names = {REFUSAL: "refusal", UNFINISHED: "truncated", FOREIGN: "language", ECHO: "copy"}
    hits, of = Counter(), Counter()
    for r, tags in damaged(good, 300, random.Random(99)):
        tag = next(iter(tags.values()))
        of[tag] += 1
        hits[tag] += tagger.defects([r])[0] == names.get(tag)
    share = {names.get(t, "near miss"): round(hits[t] / n, 3) for t, n in of.items()}
    print("held-out damage", share)
    assert share["refusal"] > 0.95 and share["copy"] > 0.95 and share["truncated"] > 0.9 and share["language"] > 0.7
