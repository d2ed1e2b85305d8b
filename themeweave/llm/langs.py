"""Language of short and long texts from letter trigrams, trained on labelled rows."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable

import numpy as np

#: Words remembered by a worker before it starts afresh (memory only).
REMEMBERED_WORDS = 200_000
#: Most nats that one trigram can speak for a language.
SPREAD = 4.0
_WORD = re.compile(r"[^\W\d_]+")


def label_name(label: str | None) -> str | None:
    """A language label in its short form ('en-GB', 'EN' -> 'en'), or None for unknown ones."""
    name = re.split(r"[-_]", (label or "").strip().lower())[0]
    return None if name in ("", "und", "unknown", "none", "null") else name


def _trigrams(word: str) -> list[str]:
    """Trigrams of a word; letters beyond Latin also stand alone and for their part of Unicode."""
    padded = f" {word} "
    out = [padded[i : i + 3] for i in range(len(padded) - 2)]
    if not word.isascii():
        for c in word:
            if c >= "\u0370":
                out += [c, f"block {ord(c) >> 9}"]
    return out


class LanguageModel:
    """Naive Bayes over letter trigrams; ``table`` maps a trigram to its log probabilities by language."""

    def __init__(self, languages: list[str], table: dict[str, tuple[float, ...]]):
        self.languages, self.table = languages, table
        self.rows: dict[str, int] = {}
        self.known = np.zeros((1024, len(languages) + 1))

    @classmethod
    def train(cls, rows: Iterable[tuple[str | None, str | None]], least_rows: int = 5, keep: int = 60_000) -> LanguageModel:
        """From (text, label) rows; languages with fewer than ``least_rows`` rows are left out, as are the rarest trigrams beyond ``keep``."""
        words: dict[str, Counter] = defaultdict(Counter)
        seen: Counter = Counter()
        for text, label in rows:
            name = label_name(label)
            if name and text:
                seen[name] += 1
                words[name].update(_WORD.findall(text.lower()))
        counts: dict[str, Counter] = {name: Counter() for name in words}
        for name, own in words.items():
            for w, n in own.items():
                for g in _trigrams(w):
                    counts[name][g] += n
        languages = sorted(name for name, n in seen.items() if n >= least_rows)
        total: Counter = Counter()
        for name in languages:
            size = sum(counts[name].values())
            for g, n in counts[name].items():
                total[g] += n / size
        grams = [g for g, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:keep]]
        sizes = {name: sum(counts[name].values()) for name in languages}
        v = max(len(grams), 1)
        # rates of one size for all languages, so rare languages aren't outvoted; no trigram counts for more than SPREAD
        table = {}
        for g in grams:
            logs = [math.log((counts[name][g] / sizes[name] * 1e5 + 0.5) / (1e5 + 0.5 * v)) for name in languages]
            table[g] = tuple(max(x, max(logs) - SPREAD) for x in logs)
        return cls(languages, table)

    def _row(self, word: str) -> int:
        """Row of ``known`` that holds the word's sums of log probabilities and its number of known trigrams."""
        if len(self.rows) >= REMEMBERED_WORDS:
            self.rows.clear()
        k = self.rows[word] = len(self.rows)
        if k == len(self.known):
            self.known = np.concatenate([self.known, np.zeros_like(self.known)])
        found = [self.table[g] for g in _trigrams(word) if g in self.table]
        self.known[k] = (*map(sum, zip(*found)), len(found)) if found else 0
        return k

    def scores(self, text: str) -> tuple[np.ndarray, int]:
        """Log likelihood by language, and the number of trigrams it rests on."""
        return self.scores_of(_WORD.findall(text.lower()))

    def scores_of(self, words: list[str]) -> tuple[np.ndarray, int]:
        """The same of lower-case words."""
        if len(words) + len(self.rows) > REMEMBERED_WORDS:
            self.rows.clear()
        get = self.rows.get
        rows = [k if (k := get(w)) is not None else self._row(w) for w in words]
        total = self.known[rows].sum(0) if rows else np.zeros(len(self.languages) + 1)
        return total[:-1], int(total[-1])

    def language(self, text: str) -> int:
        """Index of the likeliest language, or -1 if the text shows none."""
        total, n = self.scores(text)
        return int(total.argmax()) if n else -1

    def language_of(self, words: list[str]) -> int:
        """The same of lower-case words, of which numbers are left out."""
        total, n = self.scores_of([w for w in words if w.isalpha()])
        return int(total.argmax()) if n else -1
