"""Problem 8: byte-level BPE ids of a whole corpus by speculation and verification."""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Word pattern of the public byte-level tokenizers.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words remembered by a Python worker before it starts afresh (memory only, no effect on results).
REMEMBERED_WORDS = 200_000


def _byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in the vocabulary file -> the byte."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD) and not 0x7F <= b <= 0xA0]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Encoder of one vocabulary file.

    A word's ids are proposed by greedy longest match. A sequence of ids is the true result
    exactly if every adjacent pair is: the true encoding of two tokens' joined bytes is these two
    tokens. All distinct pairs of a batch are tested together, by undoing merges on both
    sides of the border with array lookups; only words with a failing pair are merged step by step.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        sign = _byte_signs()
        vocab = model["vocab"]
        raw = lambda token: bytes(sign[c] for c in token)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        base = {sign[c]: vocab[c] for c in sign}
        n = max(vocab.values()) + 1
        # age: order in which a token can arise; bytes 0, merges from 1 on
        self.age = np.zeros(n, np.int64)
        self.left = np.arange(n)
        self.right = np.arange(n)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        key, made = [], []
        for k, (a, b) in enumerate(pairs):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.merge[x, y] = (k + 1, z)
            key.append(x << 20 | y)
            made.append(k + 1)
            if self.age[z] == 0:
                self.age[z], self.left[z], self.right[z] = k + 1, x, y
        order = np.argsort(key)
        self.key, self.made = np.array(key, np.int64)[order], np.array(made, np.int64)[order]
        self.byte = [base[b] for b in range(256)]
        self.ids = {raw(t): i for t, i in vocab.items() if self.age[i] or len(t) == 1}
        self.words: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        # a token that its own merges don't give can't be proposed
        odd = [t for t, i in self.ids.items() if len(t) > 1 and self._exact(t) != [i]]
        for t in odd:
            del self.ids[t]
        # length of the longest token that begins with two bytes
        self.reach: dict[bytes, int] = {}
        for t in self.ids:
            self.reach[t[:2]] = max(len(t), self.reach.get(t[:2], 1))
        self.find = regex.compile(WORDS).findall

    def _exact(self, word: bytes) -> list[int]:
        """The word's ids by merging, always the earliest-learned pair, of equals the leftmost; n log n in the word's length."""
        ids = [self.byte[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.merge.get
        heap = [(m[0], k) for k, pair in enumerate(zip(ids, ids[1:])) if (m := get(pair))]
        heapq.heapify(heap)
        while heap:
            age, k = heapq.heappop(heap)
            if ids[k] < 0 or (r := after[k]) >= n or (m := get((ids[k], ids[r]))) is None or m[0] != age:
                continue  # one of the pair has been merged meanwhile
            ids[k], ids[r] = m[1], -1
            after[k] = r = after[r]
            if r < n:
                before[r] = k
                if m := get((ids[k], ids[r])):
                    heapq.heappush(heap, (m[0], k))
            if (left := before[k]) >= 0 and (m := get((ids[left], ids[k]))):
                heapq.heappush(heap, (m[0], left))
        return [i for i in ids if i >= 0]

    def _greedy(self, word: bytes) -> list[int]:
        out, at, n = [], 0, len(word)
        ids, reach = self.ids, self.reach
        while at < n:
            for end in range(min(n, at + reach.get(word[at : at + 2], 1)), at, -1):
                if (i := ids.get(word[at:end])) is not None:
                    out.append(i)
                    at = end
                    break
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair (a, b) stays as it is when its joined bytes are encoded."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        result = np.ones(len(a), bool)
        live = np.arange(len(a))
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            # a merge across the border that is due before what was undone there means failure
            k = a << 20 | b
            at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
            bad = (self.key[at] == k) & (self.made[at] < limit)
            result[live[bad]] = False
            age_a, age_b = self.age[a], self.age[b]
            # undo the later of the two merges; of equal ones the right, as the left is made first
            undo_a = age_a > age_b
            on = ~bad & ((age_a > 0) | (age_b > 0))
            # a border merge of the same age comes after the left token's merge, but before the right's
            limit = np.where(undo_a, age_a, age_b + 1)[on]
            live, a, b = live[on], np.where(undo_a, self.right[a], a)[on], np.where(undo_a, b, self.left[b])[on]
        return result

    def encode_words(self, words: list[str]) -> None:
        """Remember the ids of all given words."""
        todo = [w for w in dict.fromkeys(words) if w not in self.words]
        if len(self.words) + len(todo) > REMEMBERED_WORDS and len(self.words):
            self.words.clear()
            self.pairs.clear()
            todo = list(dict.fromkeys(words))
        proposed: list[tuple[str, bytes, list[int]]] = []
        fresh: set[int] = set()
        for w in todo:
            raw = w.encode("utf-8", "surrogatepass")
            if (i := self.ids.get(raw)) is not None:
                self.words[w] = (i,)
                continue
            ids = self._greedy(raw)
            proposed.append((w, raw, ids))
            fresh.update(k for x, y in zip(ids, ids[1:]) if (k := x << 20 | y) not in self.pairs)
        if fresh:
            k = np.fromiter(fresh, np.int64, len(fresh))
            self.pairs.update(zip(k.tolist(), self.compatible(k >> 20, k & 0xFFFFF).tolist()))
        for w, raw, ids in proposed:
            ok = all(self.pairs[x << 20 | y] for x, y in zip(ids, ids[1:]))
            self.words[w] = tuple(ids if ok else self._exact(raw))

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; null and empty texts give an empty list."""
        split = [self.find(t) if t else [] for t in texts]
        out = []
        for lo in range(0, len(split), 1000):
            part = split[lo : lo + 1000]
            self.encode_words([w for words in part for w in words])
            known = self.words
            out += [[i for w in words for i in known[w]] for words in part]
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _encode(batches: Iterator[pa.RecordBatch], path: str, count_only: bool) -> Iterator[pa.RecordBatch]:
    e = encoder(path)
    for b in batches:
        ids = e.encode_batch(b.column(1).to_pylist())
        if count_only:
            value = pa.array([len(x) for x in ids], pa.int32())
        else:
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int64)
            flat = pa.array(np.fromiter((i for x in ids for i in x), np.int32, int(ends[-1])))
            value = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)
        yield pa.RecordBatch.from_arrays([b.column(0), value], names=["ident", "ids"])


def encode_texts(df: DataFrame, ident: str, text: str, *, tokenizer: str = TOKENIZER) -> DataFrame:
    """(ident, ids): byte-level BPE ids of every row's whole text, without special tokens.

    Runs where the rows are, without a shuffle. Defined cases: null and empty texts give an
    empty list; strings of special tokens are ordinary text; any other column is ignored.
    """
    kind = dict(df.dtypes)[ident]
    return df.select(ident, text).mapInArrow(lambda it: _encode(it, tokenizer, False), f"ident {kind}, ids array<int>").withColumnRenamed("ident", ident)


def token_sizes(df: DataFrame, ident: str, text: str, *, tokenizer: str = TOKENIZER) -> DataFrame:
    """(ident, n_tokens) of every row's text; 0 for null and empty texts."""
    kind = dict(df.dtypes)[ident]
    return df.select(ident, text).mapInArrow(lambda it: _encode(it, tokenizer, True), f"ident {kind}, ids int").withColumnsRenamed({"ident": ident, "ids": "n_tokens"})
