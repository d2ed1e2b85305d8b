"""Problem 4: defective replies, by tagging their clauses with a conditional random field."""

from __future__ import annotations

import functools
import json
import pickle
import random
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from themeweave.llm import crf
from themeweave.llm.langs import LanguageModel
from themeweave.session import broadcast_if_small, cut

#: Language, words and places of each word of a prompt.
Facts = tuple[int, list[str], dict[str, list[int]]]
TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
#: Replies and labelled texts that the models are fitted on (bounded samples by hash order).
SAMPLE_REPLIES = 4_000
SAMPLE_TEXTS = 6_000
#: Damaged replies of each kind made of the sample, their weight in training, and steps of the field's trainings, between which it clears the sample.
DAMAGED = 500
DAMAGE_WEIGHT = 8.0
STEPS = (50, 40, 60)
#: Consecutive words shared with the prompt that make a copy; phrases of fewer words than ``LONG_WORDS`` are judged without their prompt's words.
COPY_WORDS = 12
LONG_WORDS = 10
#: Leads of another language over the prompt's, in nats per trigram, at which the feature steps up.
LEADS = (0.05, 0.12, 0.25)
#: Least step of a clause that makes a reply foreign.
FOREIGN_STEP = 3
#: How much faster the features of a reply's end and of a clause's place learn than those of its words, of which there are many more.
PLACE_LEAD = 4.0
#: Clauses of more words are known by their beginning and end, not by all their words.
SHORT_WORDS = 16
#: Share of a reply's words that must be tagged as refusal.
REFUSAL_COVERAGE = 0.5
#: Places at which a word must stand inside a text or reply to count as whole.
WHOLE_PLACES = 2
#: Shares of its places at which a word ends a phrase, between which words are told apart.
END_SHARES = (0.003, 0.02)
#: Sets of prompts' keys, words and languages up to this number are broadcast.
MAX_BROADCAST = 200_000
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"

_WORD = re.compile(r"[^\W_]+")
_CLAUSE = re.compile(r"(?<=[.!?;:])\s+|\n+")
_NOTHING = re.compile(r"^\W*no[\W_]*(?:concern|benefit)s?\W*$", re.I)
_WORD_SQL = r"[\p{L}\p{N}]+"
_LAST_SQL = rf"(?s)^(?:.*[^\p{{L}}\p{{N}}])?({_WORD_SQL})[^\p{{L}}\p{{N}}]*$"
# Parts of refusals; the field is trained on sentences made of them.
REFUSALS = {
    "open": ["", "", "", "Sorry, ", "I'm sorry, but ", "I am sorry: ", "Apologies – ", "My apologies: ", "Unfortunately, ", "Regrettably, ", "I regret that ", "Thank you, however ", "With respect, ", "Hello! ", "As an AI, ", "As a language model, ", "As an assistant, ", "To be clear, ", "I understand the task, but ", "Thank you for sharing. "],
    "able": ["I can't", "I cannot", "I can not", "I am unable to", "I'm unable to", "I won't", "I will not", "I won't be able to", "I am not able to", "I'm not able to", "I would rather not", "I'd rather not", "I'd prefer not to", "I must decline to", "I have to decline to", "I refuse to", "I must refuse to", "I have to refuse to", "I may not", "I must not", "I am not allowed to", "I do not feel able to", "I don't think I should", "we cannot", "we are unable to"],
    "do": ["help with", "assist with", "answer", "process", "extract anything from", "extract opinions from", "summarise", "list anything from", "comment on", "judge", "discuss", "analyse", "continue with", "say anything about", "work on", "take on", "provide an answer to", "give an answer to", "comply with"],
    "what": ["this", "that", "this text", "this passage", "that passage", "this request", "the request", "this paragraph", "these views", "what people said here", "the content", "sensitive passages like this", "such material"],
    "whole": ["no output can be given for {what}", "no answer can be provided for {what}", "this request goes against my guidelines", "answering would go against my guidelines", "declining is best here", "declining is the only option for {what}", "it is not something I can do", "this is something I have to decline", "I must refuse this one", "I will leave {what} unanswered", "I will leave {what} unanswered for safety reasons", "declining is the safest option here", "it is not something I feel able to assist with", "I have to decline", "I must decline this request", "I am only a text tool and may not judge {what}", "my guidelines do not allow it", "{what} must be left unanswered", "I am not comfortable with {what}", "it is against my policy to {do} {what}", "I prefer to leave {what} unanswered"],
    "close": ["", "", "", ".", ".", ". Please share a different text.", ". Please ask something else.", ". Is there anything else?"],
}
# What stands at the end of a text that breaks off.
BREAKS = ("", "", "", "...", "…", "-", " –", ",", " (", ";")


@functools.lru_cache(maxsize=2)
def _vocabulary(path: str) -> tuple[frozenset[str], frozenset[str]]:
    """Whole words of a public (English) vocabulary, and their proper beginnings."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    words = {w[:-4] for w in vocab if w.endswith("</w>") and w[:-4].isalpha() and w[:-4].isascii() and len(w) > 6}
    return frozenset(words), frozenset(w[:k] for w in words for k in range(3, len(w)))


def longest_run(text_at: dict[str, list[int]], text: list[str], phrase: list[str], enough: int) -> int:
    """Length of the longest run of consecutive words of ``phrase`` found in ``text`` (counting stops at ``enough``)."""
    best, j = 0, 0
    while j + best < len(phrase):
        for i in text_at.get(phrase[j], ()):
            k = 0
            while i + k < len(text) and j + k < len(phrase) and text[i + k] == phrase[j + k]:
                k += 1
            if k > best:
                best = k
                if best >= enough:
                    return best
        j += 1
    return best


@dataclass
class Model:
    """Everything a worker needs; plain data, so that it can be sent once as a broadcast variable."""

    languages: list[str]
    trigrams: dict[str, tuple[float, ...]]
    weights: np.ndarray
    move: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    vocabulary: str


@dataclass
class Reply:
    """A reply as the tagger sees it; ``whole``: 1 if its last word also stands inside texts or replies, 2 if it also ends phrases that others follow."""

    phrases: list[str | None]
    language: int = -1
    text: str | None = None
    whole: int = 0
    error: str | None = None
    dropped: frozenset[str] = frozenset()


@dataclass
class Clause:
    text: str
    words: int
    run: int
    lead: int  # 0 the prompt's language or undecided, up to len(LEADS) clearly another
    last: bool
    phrase: int


class Tagger:
    """Turns replies into clauses with features, and clauses into tags."""

    REMEMBERED = 100_000

    def __init__(self, language: LanguageModel, vocabulary: str, model: Model | None = None):
        self.language, self.model = language, model
        self.vocabulary, self.beginnings = _vocabulary(vocabulary)
        self.phrases: dict[str, tuple] = {}
        self.lexical: dict[str, np.ndarray] = {}
        self.ends: dict[tuple[str, int], np.ndarray] = {}

    # -- clauses and features

    def lexical_features(self, clause: str) -> list[int]:
        """Features of the clause's own words: they tell refusals and other languages, but not what is copied or unfinished."""
        low = [w.lower() for w in _WORD.findall(clause)]
        end = clause.rstrip()
        tail = "word" if end[-1:].isalnum() else end[-3:] if end.endswith("...") else end[-1:]
        out = ["bias", f"n={min(len(low), 8)}", f"end={tail}"]
        if len(low) <= SHORT_WORDS:
            out += [f"w={w}" for w in dict.fromkeys(low)]
        if low:
            out += [f"first={low[0]}", f"first two={' '.join(low[:2])}"]
        return [crf.feature(f, 0) for f in out]

    def end_features(self, clause: str, whole: int) -> tuple[str, ...]:
        """Features of the place where a reply ends."""
        words = _WORD.findall(clause)
        if not words:
            return ("no words",)
        last, end = words[-1].lower(), clause.rstrip()
        plain = last.isascii() and last.isalpha()
        known = ("", "inside", "seldom end", "end")[whole] if whole else "vocabulary" if last in self.vocabulary else "beginning" if last in self.beginnings else "unknown"
        tail = "word" if end[-1:].isalnum() else end[-3:] if end.endswith("...") else end[-1:]
        # no features of the word itself where it is no ending: those of the broken-off replies in the sample would be learnt as ends
        out = [f"known={known} plain={plain}", f"known={known} size={min(len(last), 4)}", f"ends={tail}"]
        if known == "end":
            out.append(f"ends in={last}")
        if clause.count("(") > clause.count(")"):
            out.append("open bracket")
        return tuple(out)

    def _remember(self, store: dict, key, make):
        known = store.get(key)
        if known is None:
            if len(store) >= self.REMEMBERED:
                store.clear()
            known = store[key] = make(key)
        return known

    def _phrase(self, phrase: str) -> tuple[list[str], list[tuple[str, int]], np.ndarray | None, int]:
        """Words (of long phrases only), clauses with their number of words, language scores and trigrams behind them."""
        words = _WORD.findall(phrase.lower())
        cut = _CLAUSE.split(phrase) if len(words) > 2 else [phrase]
        clauses = [(c, len(_WORD.findall(c))) for c in map(str.strip, cut) if c]
        scores, n = (None, 0) if _NOTHING.match(phrase) else self.language.scores(phrase)
        return words if len(words) >= COPY_WORDS else [], clauses, scores, n

    def clauses(self, reply: Reply, facts: Facts) -> list[Clause]:
        _, words, at = facts
        out: list[Clause] = []
        for k, phrase in enumerate(reply.phrases):
            if not phrase or not any(map(str.isalpha, phrase)) or _NOTHING.match(phrase):
                continue
            tokens, clauses, scores, n = self._remember(self.phrases, phrase, self._phrase)
            run = longest_run(at, words, tokens, COPY_WORDS) if tokens and words else 0
            lead = 0
            if reply.language >= 0 and n >= 4:
                lead = sum((scores.max() - scores[reply.language]) / n > x for x in LEADS)
            out += [Clause(c, m, run, lead, False, k) for c, m in clauses]
        if out:
            # a quotation that ends with its sentence isn't broken off
            out[-1].last = reply.text is None or not any(f"{out[-1].text}{end}" in reply.text for end in ".?!")
        return out

    @staticmethod
    def place_features(clause: Clause, reply: Reply) -> tuple[str, ...]:
        """Features of the clause's place."""
        run = 0 if clause.run < 4 else 1 if clause.run < COPY_WORDS else 2
        out = [f"run={run}", f"lead={clause.lead}", f"last={clause.last}", f"dropped={reply.phrases[clause.phrase] in reply.dropped}"]
        note = (f"error={' '.join(_WORD.findall(reply.error)[:2]).lower()}",) if clause.last and reply.error else ()
        return tuple(out) + note

    def features(self, reply: Reply, clauses: list[Clause], k: int) -> list[int]:
        c = clauses[k]
        names = self.place_features(c, reply) + (self.end_features(c.text, reply.whole) if c.last else ())
        return self.lexical_features(c.text) + [crf.feature(f) for f in names]

    def facts(self, text: str | None) -> Facts:
        words = _WORD.findall(text.lower()) if text else []
        at: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            at.setdefault(w, []).append(i)
        return -1, words, at

    # -- decisions

    def tags(self, replies: list[Reply]) -> list[tuple[list[Clause], np.ndarray]]:
        m = self.model
        known: dict[str, Facts] = {}
        cut = []
        for r in replies:
            key = r.text or ""
            if key not in known:
                known[key] = self.facts(r.text)
            cut.append(self.clauses(r, known[key]))
        lengths = np.array([len(c) for c in cut], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(cut) else np.zeros(0, np.int64)
        emissions = np.zeros((int(lengths.sum()), len(TAGS)))
        i = 0
        place: dict[tuple[str, ...], np.ndarray] = {}
        for r, clauses in zip(replies, cut):
            for k, c in enumerate(clauses):
                names = self.place_features(c, r)
                if names not in place:
                    place[names] = m.weights[[crf.feature(f) for f in names]].sum(0)
                emissions[i] = self._remember(self.lexical, c.text, lambda t: m.weights[self.lexical_features(t)].sum(0)) + place[names]
                if c.last:
                    emissions[i] += self._remember(self.ends, (c.text, r.whole), lambda x: m.weights[[crf.feature(f) for f in self.end_features(*x)]].sum(0))
                i += 1
        found = crf.viterbi(emissions, starts, lengths, m.move, m.begin, m.end)
        return [(c, found[s : s + len(c)]) for c, s in zip(cut, starts)]

    def defects(self, replies: list[Reply]) -> list[str | None]:
        """The defect of each reply, from the coverage of its clauses' tags, or None."""
        return [self._verdict(c, t) for c, t in self.tags(replies)]

    @staticmethod
    def _verdict(clauses: list[Clause], tags: np.ndarray) -> str | None:
        """Coverage of the clauses' tags as the reply's one defect."""
        if not clauses:
            return None
        words = np.array([max(c.words, 1) for c in clauses])
        if words[tags == REFUSAL].sum() >= REFUSAL_COVERAGE * words.sum():
            return "refusal"
        if any(c.run >= COPY_WORDS for c, t in zip(clauses, tags) if t in (ECHO, FOREIGN, UNFINISHED)):  # exact
            return "copy"
        if any(t == FOREIGN and c.lead >= FOREIGN_STEP for c, t in zip(clauses, tags)):
            return "language"
        if tags[-1] == UNFINISHED and clauses[-1].last:
            return "truncated"
        return None


# --- training by damage ------------------------------------------------------------------


def refusal(rng: random.Random) -> str:
    """A refusal made of ``REFUSALS``."""
    pick = lambda part: rng.choice(REFUSALS[part])
    body = f"{pick('able')} {pick('do')} {pick('what')}" if rng.random() < 0.6 else pick("whole").format(what=pick("what"), do=pick("do"))
    out = pick("open") + body + pick("close")
    return out.lower() if rng.random() < 0.15 else out[0].upper() + out[1:]


def titled(phrase: str, rng: random.Random) -> str:
    """``phrase`` now and then behind a heading, as replies have it."""
    return rng.choice(("Concern: ", "Benefit: ", "Concerns: ", "Benefits: ", "- ")) + phrase if rng.random() < 0.15 else phrase


def truncated(phrase: str, rng: random.Random) -> str | None:
    """``phrase`` broken off inside a word or behind one, as a reply's end that ran out."""
    words = phrase.split()
    if len(words) < 3:
        return None
    k = rng.randrange(1, len(words))
    if rng.random() < 0.5 and len(words[k]) > 3:
        return " ".join([*words[:k], words[k][: rng.randrange(2, len(words[k]))]]) + rng.choice(("", "", "", "-", "...", "…"))
    return " ".join(words[:k]) + rng.choice(BREAKS)


def ending(inside: int, at_end: int) -> int:
    """0 for a word that stands inside too few texts and replies to be whole, else 1 to 3 by the share of its places that end a phrase."""
    if inside < WHOLE_PLACES:
        return 0
    return 1 + sum(at_end >= max(WHOLE_PLACES, share * (inside + at_end)) for share in END_SHARES)


def damaged(replies: list[Reply], each: int, rng: random.Random) -> list[tuple[Reply, dict[int, int]]]:
    """(reply, tags of its phrases) for ``each`` damaged copies of well-formed replies of every kind, near misses among them."""
    out: list[tuple[Reply, dict[int, int]]] = []
    ends = Counter(w[-1] for r in replies for p in r.phrases if p and (w := _WORD.findall(p.lower())))
    inner = Counter(x for r in replies for p in r.phrases if p for x in _WORD.findall(p.lower())[:-1])
    for t in {r.text for r in replies if r.text}:
        inner.update(_WORD.findall(t.lower()))
    spoken = [r for r in replies if any(r.phrases)]
    if not spoken:
        return out
    phrases = lambda r: [p for p in r.phrases if p]
    by_language: dict[int, list[str]] = {}
    for r in spoken:
        if r.language >= 0:
            by_language.setdefault(r.language, []).extend(p for p in phrases(r) if not _NOTHING.match(p))
    # the sample's error notes, so that a note says nothing about damage
    notes = [r.error for r in replies]
    others = {k: [p for j, ps in by_language.items() if j != k for p in ps[:2_000]] for k in by_language}
    for _ in range(each):
        r = rng.choice(spoken)
        out.append((Reply([titled(refusal(rng), rng)], r.language, r.text if rng.random() < 0.2 else None, rng.randrange(4)), {0: REFUSAL}))
        own = phrases(rng.choice(spoken))[-1 if rng.random() < 0.4 else 0 :]
        if (short := truncated(own[-1], rng)) and short != own[-1]:
            word = _WORD.findall(short.lower())[-1:] or [""]
            state = ending(inner[word[0]], ends[word[0]])
            complete = state == 3 and short[-1:].isalnum()
            out.append((Reply([*own[:-1], short], r.language, None, state), {len(own) - 1: ANSWER if complete else UNFINISHED}))
        r = rng.choice(spoken)
        own = phrases(r)[: 1 if rng.random() < 0.4 else None]
        if r.language in others and others[r.language]:
            at = rng.randrange(len(own))
            strange = rng.choice(others[r.language])
            out.append((Reply([*own[:at], strange, *own[at + 1 :]], r.language, r.text, r.whole), {at: FOREIGN}))
        r = rng.choice(spoken)
        words = (r.text or "").split()
        if len(words) >= 24:
            own, size = phrases(r) if rng.random() < 0.4 else [], rng.randrange(14, 24) if rng.random() < 0.75 else rng.randrange(4, 10)
            start = rng.randrange(len(words) - size)
            copy = " ".join(words[start : start + size])
            copy = titled(rng.choice((copy, copy, copy.upper(), re.sub(r"[^\w\s]", "", copy.lower()), f"“{copy}”", copy.rstrip(".,;") + ".")), rng)
            at = rng.randrange(len(own) + 1)
            # shorter runs are a passage's own words
            out.append((Reply([*own[:at], copy, *own[at:]], r.language, r.text, rng.choice((1, 2, 3))), {at: ECHO if size >= 14 else ANSWER}))
    for r, _ in out:
        r.error = rng.choice(notes)
    return out


def fit(replies: list[Reply], language: LanguageModel, *, vocabulary: str = VOCABULARY, each: int = DAMAGED, steps: tuple[int, ...] = STEPS, seed: int = 7) -> Model:
    """Field trained on sampled replies, taken as well-formed, and on damaged copies of them.

    What the first field calls defective among the sampled replies no longer counts as well-formed: it
    joins the second training with the tags found, which also teaches what the replies' error notes are worth.
    """
    tagger = Tagger(language, vocabulary)
    rng = random.Random(seed)
    zero = np.zeros((crf.SPACE, len(TAGS))), np.zeros((len(TAGS),) * 2), np.zeros(len(TAGS)), np.zeros(len(TAGS))
    model = Model(language.languages, language.table, zero[0].astype(np.float32), *zero[1:], vocabulary)
    good, found = replies, []
    for turn, n in enumerate(steps):
        sample = [(r, dict.fromkeys(range(len(r.phrases)), ANSWER)) for r in good[: 3 * each]] + damaged(good, each, rng)
        rows, feats, lengths, tags, weights = [], [], [], [], []
        for r, of in sample:
            clauses = tagger.clauses(r, tagger.facts(r.text))
            if not clauses:
                continue
            for k, c in enumerate(clauses):
                f = tagger.features(r, clauses, k)
                rows += [len(tags)] * len(f)
                feats += f
                tag = of.get(c.phrase, ANSWER)
                tags.append(ANSWER if tag == UNFINISHED and not c.last else tag)
            lengths.append(len(clauses))
            weights.append(DAMAGE_WEIGHT if any(of.values()) else 1.0)
        for r, clauses, own in found:
            for k in range(len(clauses)):
                f = tagger.features(r, clauses, k)
                rows += [len(tags)] * len(f)
                feats += f
                tags.append(int(own[k]))
            lengths.append(len(clauses))
            weights.append(DAMAGE_WEIGHT)
        if not lengths:
            return model
        size = np.array(lengths, np.int64)
        starts = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        w, move, begin, end = crf.train(np.array(rows), np.array(feats), starts, size, np.array(tags), len(TAGS), steps=n, weights=np.array(weights), tied=(ANSWER, ECHO, UNFINISHED), lead=PLACE_LEAD)
        model = Model(language.languages, language.table, w.astype(np.float32), move, begin, end, vocabulary)
        if turn + 1 < len(steps):
            judge = Tagger(language, vocabulary, model)
            judged = [(r, *x) for r, x in zip(replies, judge.tags(replies))]
            bad = [judge._verdict(c, t) is not None for _, c, t in judged]
            good, found = [r for r, b in zip(replies, bad) if not b], [j for j, b in zip(judged, bad) if b]
    return model


_TAGGERS: dict[str, Tagger] = {}


def _tagger(shared) -> Tagger:
    if shared.id not in _TAGGERS:
        _TAGGERS.clear()
        m = shared.value
        _TAGGERS[shared.id] = Tagger(LanguageModel(m.languages, m.trigrams), m.vocabulary, m)
    return _TAGGERS[shared.id]


class _Shared:
    """A broadcast variable with an identity that workers can remember it by."""

    def __init__(self, variable):
        self.variable, self.id = variable, uuid.uuid4().hex

    @property
    def value(self) -> Model:
        return self.variable.value


def _reply(language: int | None, phrases: list[str | None], text: str | None, whole: int | None, error: str | None, dropped: list[str] | None) -> Reply:
    return Reply(phrases, -1 if language is None else language, text, whole or 0, error, frozenset(dropped or ()))


def _judge(batches: Iterator[pa.RecordBatch], shared: _Shared) -> Iterator[pa.RecordBatch]:
    tagger = _tagger(shared)
    for b in batches:
        found = tagger.defects([_reply(*r) for r in zip(*(b.column(c).to_pylist() for c in range(1, 7)))])
        keep = [i for i, d in enumerate(found) if d]
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array([found[i] for i in keep], pa.string())], names=["ident", "defect"])


#: Different words that a task counts before it hands them on.
COUNTED_WORDS = 200_000


def _spoken(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """One pass over the prompts: (key, language) of each, and (word, n) of their words."""
    language = LanguageModel(*shared.value)
    words: Counter = Counter()

    def counted() -> pa.RecordBatch:
        none = pa.nulls(len(words))
        out = pa.RecordBatch.from_arrays([none.cast(key), none.cast(pa.int32()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["key", "language", "word", "n"])
        words.clear()
        return out

    key = pa.null()
    for b in batches:
        key, texts, spoken = b.column(0).type, b.column(1).to_pylist(), []
        for t in texts:
            own = _WORD.findall(t.lower())
            words.update(own)
            spoken.append(language.language_of(own))
        none = pa.nulls(len(texts))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spoken, pa.int32()), none.cast(pa.string()), none.cast(pa.int64())], names=["key", "language", "word", "n"])
        if len(words) > COUNTED_WORDS:
            yield counted()
    if words:
        yield counted()


def _fitted(batches: Iterator[pa.RecordBatch], shared, vocabulary: str) -> Iterator[pa.RecordBatch]:
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["ident"])
    model = fit([_reply(*(r[c] for c in ("language", "phrases", "text", "whole", "error", "dropped"))) for r in rows], LanguageModel(*shared.value), vocabulary=vocabulary)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def _sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """The rows whose key hashes up to the ``n``-th smallest hash; only the hashes are sorted."""
    most = df.select(F.xxhash64(key).alias("h")).distinct().orderBy("h").limit(n).agg(F.max("h")).first()[0]
    return df.filter(F.xxhash64(key) <= most) if most is not None else df.limit(0)


def _whole_words(prompts: DataFrame, replies: DataFrame) -> DataFrame:
    """(word, whole), from the words (word, n) of the prompts and the replies, of the last words of replies that stand inside a text, or before the end of a reply, often enough, as ``ending`` has it."""
    one = F.lit(1).cast("long")
    every = replies.select(F.explode(F.regexp_extract_all(F.lower(F.array_join("phrases", " \n ")), F.lit(f"({_WORD_SQL})"), 1)).alias("word"), one.alias("n"), F.lit(0).alias("end"))
    # a reply's last word doesn't stand inside it
    less = replies.select(F.col("last").alias("word"), (-one).alias("n"), F.lit(0).alias("end"))
    ends = replies.select(F.explode("phrases").alias("p")).select(F.regexp_extract(F.lower("p"), _LAST_SQL, 1).alias("word"), one.alias("n"), F.lit(1).alias("end"))
    words = prompts.select("word", "n", F.lit(0).alias("end")).unionByName(every).unionByName(less).unionByName(ends)
    last = broadcast_if_small(replies.select("last").filter("last <> ''").distinct().withColumnRenamed("last", "word"), MAX_BROADCAST)
    counted = words.join(last, "word", "left_semi").groupBy("word").agg(F.sum("n").alias("n"), F.sum("end").alias("e")).filter(F.col("n") - F.col("e") >= WHOLE_PLACES)
    steps = [F.when(F.col("e") >= F.greatest(F.lit(WHOLE_PLACES), share * F.col("n")), 1).otherwise(0) for share in END_SHARES]
    return counted.select("word", (1 + steps[0] + steps[1]).alias("whole"))


def defective_replies(
    replies: DataFrame, ident: str, key: str, phrases: str, nothing: str, prompts: DataFrame, text: str, labelled: DataFrame, label_text: str, label: str,
    *, error: str | None = None, dropped: str | None = None, sample_replies: int = SAMPLE_REPLIES, sample_texts: int = SAMPLE_TEXTS, vocabulary: str = VOCABULARY,
) -> DataFrame:
    """(ident, defect) of each defective reply to a prompt; replies and prompts meet by ``key``.

    Each reply's phrases are cut into clauses; a conditional random field tags them as answer,
    refusal, echo, foreign or unfinished, and the tags' coverage gives the one defect:
    'refusal' (most words), 'copy' (a tagged phrase repeats at least 12 consecutive words of
    the prompt, checked exactly), 'language' (any foreign phrase), 'truncated' (the reply's last
    clause). 'empty' is decided on the columns alone: ``nothing`` isn't true and the
    phrases are null or hold no letter. The field is fitted in one task to a bounded sample of ``sample_replies`` replies and
    damaged copies of them (see ``fit``; most replies are taken to be well-formed), the languages to ``sample_texts`` rows of ``labelled``. Every reply is judged: all of a
    prompt for its language and, where a phrase is long enough to copy or ends unusually, for its words; whole words are counted over all prompts and replies.
    ``error`` and ``dropped`` name columns with the reply's error note (string) and the phrases that a filter took out (array of strings), which the field weighs.
    Only a prompt's key and language are joined to the replies, and the texts of those few prompts that a long phrase needs.
    Defined cases: repeated rows count once; a null or missing prompt can't be copied nor differ in
    language; null phrases are skipped; an empty table gives no row; other columns are ignored.
    """
    spark, kind = replies.sparkSession, dict(replies.dtypes)[ident]
    extra = [F.col(error).alias("error") if error else F.lit(None).cast("string").alias("error"), F.col(dropped).alias("dropped") if dropped else F.lit(None).cast("array<string>").alias("dropped")]
    own = replies.select(F.col(ident).alias("ident"), F.col(key).alias("key"), F.col(phrases).alias("phrases"), F.coalesce(F.col(nothing), F.lit(False)).alias("nothing"), *extra).filter(F.col("ident").isNotNull())
    letters = F.coalesce(F.exists("phrases", lambda p: F.coalesce(p.rlike(r"\p{L}"), F.lit(False))), F.lit(False))
    empty = own.filter(~F.col("nothing") & ~letters).select("ident", F.lit("empty").alias("defect")).distinct()
    last = F.regexp_extract(F.lower(F.element_at(F.filter("phrases", lambda p: p.rlike(r"\p{L}")), -1)), _LAST_SQL, 1)
    long = F.exists("phrases", lambda p: F.regexp_count(p, F.lit(_WORD_SQL)) >= LONG_WORDS)
    spoken = cut(own.filter(letters).drop("nothing").dropDuplicates(["ident"]).withColumn("last", F.coalesce(last, F.lit(""))).withColumn("long", F.coalesce(long, F.lit(False))))
    asked = prompts.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("key").isNotNull() & F.col("text").isNotNull())
    # languages from a bounded sample, the same whatever the number of partitions
    texts = _sample(labelled.select(F.col(label_text).alias("t"), F.col(label).alias("l")).filter("t IS NOT NULL AND l IS NOT NULL"), "t", sample_texts).collect()
    long_texts = LanguageModel.train(sorted((r.t, r.l) for r in texts))
    some = _sample(spoken, "ident", sample_replies)
    pool = some.join(asked.groupBy("key").agg(F.min("text").alias("text")).join(broadcast_if_small(some.select("key").distinct(), MAX_BROADCAST), "key", "left_semi"), "key", "left")
    # phrases mostly speak their prompt's language: with its label they teach the words that replies use
    talk = sorted((" . ".join(p for p in r.phrases if p and not _NOTHING.match(p)), long_texts.languages[k]) for r in pool.select("phrases", "text").collect() if r.text and (k := long_texts.language(r.text)) >= 0)
    language = LanguageModel.train([*sorted((r.t, r.l) for r in texts), *talk])
    tongue = spark.sparkContext.broadcast((language.languages, language.table))  # at most 60,000 trigrams
    key_kind = dict(asked.dtypes)["key"]
    passed = cut(asked.mapInArrow(lambda it: _spoken(it, tongue), f"key {key_kind}, language int, word string, n long"))
    tongues = passed.filter("key IS NOT NULL").groupBy("key").agg(F.min("language").alias("language"))
    whole = _whole_words(passed.filter("word IS NOT NULL"), spoken)
    met = spoken.join(broadcast_if_small(cut(whole), MAX_BROADCAST), F.col("last") == F.col("word"), "left").drop("word", "last").join(broadcast_if_small(cut(tongues), MAX_BROADCAST), "key", "left")
    # a passage's own words at a reply's end may be a whole quotation
    met = cut(met.withColumn("long", F.col("long") | (F.coalesce("whole", F.lit(0)) <= 1)))
    needed = met.filter("long").select("key").distinct()
    sources = asked.join(broadcast_if_small(needed, MAX_BROADCAST), "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))
    columns = ("ident", "language", "phrases", "text", "whole", "error", "dropped")
    rows = met.filter("NOT long").withColumn("text", F.lit(None).cast("string")).select(*columns).unionByName(met.filter("long").join(sources, "key", "left").select(*columns))
    # the sample goes with its texts, as damage copies from them
    train = _sample(met, "ident", sample_replies).join(pool.select("ident", "text"), "ident").select(*columns)
    model = train.repartition(1).mapInArrow(lambda it: _fitted(it, tongue, vocabulary), "model binary").first()
    if model is None:  # no reply with a letter
        return empty.withColumnRenamed("ident", ident)
    shared = _Shared(spark.sparkContext.broadcast(pickle.loads(model[0])))  # fixed size: hashed weights and the trigrams
    judged = rows.mapInArrow(lambda it: _judge(it, shared), f"ident {kind}, defect string")
    return empty.unionByName(judged).withColumnRenamed("ident", ident)
