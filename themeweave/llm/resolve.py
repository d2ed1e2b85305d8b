"""Problem 2: mapping freely typed values to the entries of a canonical list."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from themeweave.llm.looks import visual_form
from themeweave.session import broadcast_if_small, cut

#: Entries of the list that the driver and a Python worker hold at a time; a longer list is matched block by block.
BLOCK_ENTRIES = 20_000
#: Values remembered by a worker before it starts afresh (memory only).
REMEMBERED_VALUES = 100_000
#: Aliases of at most this many letters only match whole words.
SHORT_ALIAS = 4
#: Least token-set similarity, and least share of a name's letters that a cut-off value must show.
LEAST_SIMILARITY = 0.8
LEAST_PREFIX = 0.6
# Digits typed for letters; l and i share one class, as 1 stands for either.
DIGIT_LETTERS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "l": "i", "|": "i", "!": "i"})
#: A word typed around mentions of so many different entries says nothing about which one is meant; no more than so many such words are used, the commonest first.
FILLER_ENTRIES = 4
MAX_FILLERS = 10_000
_WORD = re.compile(r"[^\W_]+")


def _plain(value: str) -> str:
    """Case-folded visual form without accents."""
    marks = unicodedata.normalize("NFD", visual_form(value).casefold())
    return unicodedata.normalize("NFKC", "".join(c for c in marks if not unicodedata.combining(c)))


def _tokens(value: str) -> list[str]:
    """Words of the value in the spelling class used for comparison; numbers are left out."""
    words = _WORD.findall(_plain(value))
    return [w.translate(DIGIT_LETTERS) for w in words if not w.isdigit()]


def edit_distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) from ``a`` to ``b``, or ``most + 1`` if more.

    The columns of the usual table are held as bits of whole numbers, so a sign of ``b`` costs a few operations.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return min(max(len(a), len(b)), most + 1)
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, same, before, d = full, 0, 0, 0, len(a)
    for y in b:
        here = places.get(y, 0)
        swapped = ((~same & here) << 1) & before
        same = (swapped | (((here & up) + up) ^ up) | here | down) & full
        more, less = (down | ~(same | up)) & full, same & up
        d += bool(more & top) - bool(less & top)
        more, less = ((more << 1) | 1) & full, (less << 1) & full
        up, down, before = (less | ~(same | more)) & full, more & same, here
    return min(d, most + 1)


def _alike(a: str, b: str) -> float:
    most = max(len(a), len(b)) // 3
    if a == b:
        return 1.0
    d = edit_distance(a, b, most)
    return 1 - d / max(len(a), len(b)) if d <= most else 0.0


def _grams(joined: str) -> set[str]:
    return {joined[i : i + 3] for i in range(len(joined) - 2)}


class Resolver:
    """Matcher of values against entries (ident, [name, alias, ...])."""

    def __init__(self, entries: Sequence[tuple[int, Sequence[str | None]]]):
        self.automaton = ahocorasick.Automaton()
        self.patterns: dict[str, int] = {}
        self.names: list[tuple[int, list[str], str, set[str]]] = []
        self.grams: dict[str, list[int]] = defaultdict(list)
        for ident, names in sorted(entries, key=lambda e: e[0]):
            for name in names:
                words = _tokens(name or "")
                joined = "".join(words)
                if not joined:
                    continue
                self.patterns.setdefault(joined, ident)
                if len(joined) > SHORT_ALIAS:
                    grams = _grams(joined)
                    for g in grams:
                        self.grams[g].append(len(self.names))
                    self.names.append((ident, words, joined, grams))
        for p, ident in self.patterns.items():
            self.automaton.add_word(p, (len(p), ident))
        self.automaton.make_automaton()
        self.filler: frozenset[str] = frozenset()
        self.seen: dict[str, tuple[float, int]] = {}

    def resolve(self, value: str) -> tuple[float, int]:
        """(score, ident) of the entry that the value means; (0, 0) if none."""
        if value not in self.seen:
            if len(self.seen) >= REMEMBERED_VALUES:
                self.seen.clear()
            words = _tokens(value)
            mention = self._mention(words)
            self.seen[value] = (2.0 - 1.0 / (1 + mention[0]), mention[2]) if mention else self._similar(words) or (0.0, 0)
        return self.seen[value]

    def around(self, value: str) -> tuple[int, list[str]] | None:
        """(ident, the words typed before and after it) of the mention that decides, if there is one."""
        words = _tokens(value)
        mention = self._mention(words)
        if not mention:
            return None
        size, first, ident = mention
        at, out = 0, []
        for w in words:
            if at + len(w) <= first or at >= first + size:
                out.append(w)
            at += len(w)
        return ident, out

    def _mention(self, words: list[str]) -> tuple[int, int, int] | None:
        """(length, place, ident) of the name found inside the joined words: longest first, none overlapping; the first of these decides."""
        if not words or not self.patterns:
            return None
        text, starts, ends, at = "".join(words), set(), {}, 0
        for w in words:
            starts.add(at)
            at += len(w)
            ends[at] = at
        found = []
        for last, (size, ident) in self.automaton.iter(text):
            first, end = last + 1 - size, last + 1
            if first not in starts:
                continue
            whole = end in ends or (size > SHORT_ALIAS and ((text[end : end + 1] == "s" and end + 1 in ends) or (text[end : end + 2] == "es" and end + 2 in ends)))
            if whole:
                found.append((-size, first, ident))
        taken: list[tuple[int, int, int]] = []
        for size, first, ident in sorted(found):
            if all(first >= f + s or first - size <= f for s, f, _ in taken):
                taken.append((-size, first, ident))
        return taken[0] if taken else None

    def _near(self, joined: str, words: int) -> Iterator[int]:
        """Names that share as many trigrams as one that is similar enough must.

        Each of the at most a fifth of the letters that may differ spoils three trigrams, each border between words two. A name with that
        many in common is found under one of the rarest, so the lists of the common ones are never read.
        """
        grams = sorted(_grams(joined), key=lambda g: (len(self.grams.get(g, ())), g))
        need = max(1, len(grams) - 3 * (len(joined) // 5) - 2 * (words - 1))
        own = set(grams)
        seen: set[int] = set()
        for g in grams[: len(grams) - need + 1]:
            for k in self.grams.get(g, ()):
                if k not in seen:
                    seen.add(k)
                    if len(own & self.names[k][3]) >= need:
                        yield k

    def _similar(self, words: list[str]) -> tuple[float, int] | None:
        words = [w for w in words if w not in self.filler] or words
        joined = "".join(words)
        if len(joined) <= SHORT_ALIAS:
            return None
        best: tuple[float, int] | None = None
        for k in self._near(joined, len(words)):
            ident, own, name, _ = self.names[k]
            score = 0.0
            most = max(len(joined), len(name)) // 5
            if (d := edit_distance(joined, name, most)) <= most:
                score = 1 - d / max(len(joined), len(name))
            if score < 1 and 3 * len(joined) < 5 * len(name) and 3 * len(name) < 5 * len(joined):
                score = max(score, self._token_set(words, own))
            if name.startswith(joined) and len(joined) >= LEAST_PREFIX * len(name):
                score = max(score, 0.9 + 0.1 * len(joined) / len(name))
            if score >= LEAST_SIMILARITY and (best is None or (score, -ident) > (best[0], -best[1])):
                best = (score, ident)
        return best

    @staticmethod
    def _token_set(a: list[str], b: list[str]) -> float:
        """Agreement of two word sets: each word meets its best partner, weighted by length, the worse side counts."""
        best = [[_alike(x, y) for y in b] for x in a]
        ours = sum(max(row) * len(x) for row, x in zip(best, a)) / sum(map(len, a))
        theirs = sum(max(row[j] for row in best) * len(y) for j, y in enumerate(b)) / sum(map(len, b))
        return min(ours, theirs)


def resolve_column(df: DataFrame, value: str, entries: DataFrame, ident: str, names: Sequence[str], *, block_entries: int = BLOCK_ENTRIES, filler_entries: int = FILLER_ENTRIES, max_broadcast: int = 500_000) -> DataFrame:
    """``df`` with ``resolved``: the ident of the entry that ``value`` means, or 0 if it means none.

    A multi-pattern automaton over all names and aliases finds mentions inside the value
    (longest first, non-overlapping); what it leaves goes to token-set similarity that
    bears misspellings, other word orders, joined words and cut-off ends. Words that all data's values show around
    mentions of ``filler_entries`` different entries or more are left out of the comparison. Each distinct value is matched once and
    joined back. The list is read in blocks of ``block_entries``, one after the other; the best score over all blocks wins.
    Defined cases: a null or blank value gives 0; equal scores go to the smaller ident;
    an empty list gives 0 everywhere; null names are skipped.
    """
    spark, kind, arrow = df.sparkSession, dict(entries.dtypes)[ident], to_arrow_type(entries.schema[ident].dataType)
    distinct = cut(df.select(F.col(value).cast("string").alias("_value")).filter(F.col("_value").isNotNull()).distinct())
    blocks = max(1, -(-entries.count() // block_entries))

    def block(b: int):
        part = entries.select(ident, *names)
        if blocks > 1:
            part = part.filter(F.pmod(F.xxhash64(ident), F.lit(blocks)) == b)
        return [(r[0], tuple(r[1:])) for r in part.collect()]  # about block_entries rows of a reference list

    rows = [block(0)] if blocks == 1 else None
    sent = lambda b, filler: spark.sparkContext.broadcast((rows[0] if rows else block(b), filler))
    around = [distinct.mapInArrow(_around(sent(b, frozenset()), arrow), f"word string, ident {kind}") for b in range(blocks)]
    common = around[0]
    for more in around[1:]:
        common = common.unionByName(more)
    counted = common.groupBy("word").agg(F.count_distinct("ident").alias("n")).filter(F.col("n") >= filler_entries)
    filler = frozenset(r.word for r in counted.orderBy(F.desc("n"), "word").limit(MAX_FILLERS).collect())
    best = None
    for b in range(blocks):
        found = distinct.mapInArrow(_matched(sent(b, filler), arrow), f"_value string, score double, ident {kind}")
        best = found if best is None else cut(best.unionByName(found).groupBy("_value").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("ident").alias("i"))).alias("x")).select("_value", (-F.col("x.s")).alias("score"), F.col("x.i").alias("ident")))
    answers = broadcast_if_small(cut(best.filter("score > 0").select("_value", F.col("ident").alias("resolved"))), max_broadcast)
    return df.join(answers, F.col(value).cast("string") == F.col("_value"), "left").drop("_value").withColumn("resolved", F.coalesce("resolved", F.lit(0).cast(kind)))


def _around(shared, arrow: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _resolver(shared)
        for b in batches:
            found = {(w, x[0]) for v in b.column(0).to_pylist() if (x := matcher.around(v)) for w in x[1]}
            yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in found], pa.string()), "ident": pa.array([i for _, i in found], arrow)})

    return run


def _matched(shared, arrow: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _resolver(shared)
        for b in batches:
            out = [matcher.resolve(v) for v in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"_value": b.column(0), "score": pa.array([s for s, _ in out], pa.float64()), "ident": pa.array([i for _, i in out], arrow)})

    return run


_RESOLVERS: dict[int, Resolver] = {}


def _resolver(shared) -> Resolver:
    rows, filler = shared.value
    key = id(rows)  # a broadcast value stays the same object in a worker
    if key not in _RESOLVERS:
        _RESOLVERS.clear()
        _RESOLVERS[key] = Resolver(rows)
        _RESOLVERS[key].filler = filler
    return _RESOLVERS[key]


def unmatched_spellings(df: DataFrame, key: str, fields: Sequence[str], entries: DataFrame, ident: str, name: str, aliases: Sequence[str] = (), *, max_broadcast: int = 100_000) -> DataFrame:
    """(key, field, ident) of each field whose value is neither null, blank nor exactly an entry's name.

    ``ident`` is the entry the value means or 0. Repeated deliveries of a key count once;
    other columns are ignored; an empty table gives no row.
    """
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select(key, "x.field", "x.value")
    typed = long.filter(F.col("value").isNotNull() & ~F.col("value").rlike(r"^[\s\p{Z}\p{C}]*$"))
    names = broadcast_if_small(entries.select(F.col(name).alias("value")).filter(F.col("value").isNotNull()).distinct(), max_broadcast)
    other = typed.join(names, "value", "left_anti")
    return resolve_column(other, "value", entries, ident, [name, *aliases]).select(key, "field", F.col("resolved").alias(ident)).distinct()
