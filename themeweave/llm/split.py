"""Problem 5: cutting oversized texts at natural boundaries into balanced, overlapping pieces."""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Boundary kinds from strongest to weakest; a cut lies at the end of a match.
BOUNDARIES = (
    re.compile(r"\n[^\S\n]*\n\s*"),  # paragraph
    re.compile(r"\r?\n\s*"),  # line
    re.compile(r"[.!?…]+[\"'”’)\]]*\s+|[。！？]+[」』”’）]*\s*"),  # sentence
    re.compile(r"[,;:–—]\s+|[，；：、]"),  # clause
    re.compile(r"\s+"),  # word
)
#: How far from its target a cut may be moved, as a share of the piece length.
REACH = 0.25


def _joined(ch: str) -> bool:
    """Whether no cut may stand right before ``ch``."""
    return unicodedata.combining(ch) > 0 or ch in "‍︎️" or "\U0001f3fb" <= ch <= "\U0001f3ff"


class _Borders:
    def __init__(self, text: str):
        self.text = text
        self.at = [[m.end() for m in b.finditer(text) if 0 < m.end() < len(text)] for b in BOUNDARIES]

    def snap(self, low: int, high: int, target: int) -> int:
        """The cut in [low, high] at the strongest boundary, of equals the one nearest to the target."""
        for places in self.at:
            a, b = bisect.bisect_left(places, low), bisect.bisect_right(places, high)
            if a < b:
                k = bisect.bisect_left(places, target, a, b)
                return min(places[max(a, k - 1) : min(b, k + 1)], key=lambda p: (abs(p - target), p))
        cut = min(max(target, low), high)
        for p in range(cut, low - 1, -1):
            if not _joined(self.text[p]) and self.text[p - 1] != "‍":
                return p
        return cut

    def back(self, low: int, end: int) -> int:
        """Where the overlap before ``end`` begins: the first boundary of any kind at or after ``low``."""
        best = end
        for places in self.at:
            k = bisect.bisect_left(places, low)
            if k < len(places) and places[k] < end:
                best = min(best, places[k])
        if best == end and end > low:  # no boundary at all
            best = low
            while best < end and (_joined(self.text[best]) or self.text[best - 1] == "‍"):
                best += 1
        return best


def split_spans(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """Spans (start, new_from, end) of the pieces of ``text``; [start, new_from) repeats the piece before.

    The fewest pieces that can hold the text are given equal-length targets and each cut
    moves to the strongest boundary near its target; if a piece then breaks the limit, one
    more piece is planned, so the result has the fewest pieces of any such plan. Where no plan fits because the overlap
    leaves too little room for new text (an overlap of nearly the limit), pieces are filled one after the other.
    A text of at most ``limit`` signs is one piece, an empty text none.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    n = len(text)
    if n <= limit:
        return [(0, 0, n)] if n else []
    borders = _Borders(text)
    least = math.ceil((n - overlap) / (limit - overlap))
    for count in range(least, 2 * least + 8):
        if spans := _plan(borders, n, count, limit, overlap):
            return spans
    return _filled(borders, n, limit, overlap)


def _filled(borders: _Borders, n: int, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces filled one after the other, for texts that no balanced plan fits."""
    spans, start, new_from = [], 0, 0
    while n - start > limit:
        high = start + limit
        end = borders.snap(max(new_from + 1, high - int(limit * REACH)), high, high)
        spans.append((start, new_from, end))
        start, new_from = borders.back(max(start + 1, end - overlap), end) if overlap else end, end
    return [*spans, (start, new_from, n)]


def _plan(borders: _Borders, n: int, count: int, limit: int, overlap: int) -> list[tuple[int, int, int]] | None:
    spans: list[tuple[int, int, int]] = []
    start = new_from = 0
    for k in range(count):
        left = count - k
        if left == 1:
            end = n
        else:
            # the rest is divided evenly: each later piece repeats `overlap` signs
            size = (n - start + (left - 1) * overlap) / left
            target = start + round(size)
            room = max(1, int(size * REACH))
            high = min(start + limit, target + room, n - 1)
            low = min(max(new_from + 1, target - room), high)
            if high <= new_from:
                return None
            end = borders.snap(low, high, min(target, high))
        if end - start > limit or end <= new_from:
            return None
        spans.append((start, new_from, end))
        if left > 1:
            start, new_from = borders.back(max(start + 1, end - overlap), end) if overlap else end, end
    return spans


SCHEMA = "piece int, start int, new_from int, end int, text string"


def _pieces(batches: Iterator[pa.RecordBatch], limit: int, overlap: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, out = [], ([], [], [], [], [])
        for r, text in enumerate(b.column(b.num_columns - 1).to_pylist()):
            for k, (s, m, e) in enumerate(split_spans(text, limit, overlap)):
                rows.append(r)
                for column, value in zip(out, (k, s, m, e, text[s:e] if with_text else None)):
                    column.append(value)
        keys = [b.column(c).take(pa.array(rows, pa.int64())) for c in range(b.num_columns - 1)]
        values = [pa.array(v, t) for v, t in zip(out, [pa.int32()] * 4 + [pa.string()])]
        names = [f"k{c}" for c in range(len(keys))] + ["piece", "start", "new_from", "end", "text"]
        yield pa.RecordBatch.from_arrays(keys + values, names=names)


def split_oversized(df: DataFrame, keys: list[str], text: str, *, limit: int = 2000, overlap: int = 200, with_text: bool = True) -> DataFrame:
    """Ordered pieces (*keys, piece, start, new_from, end, text) of every text longer than ``limit`` code points.

    Piece ``piece`` (from 0) is ``text[start:end]``, at most ``limit`` signs long, of which
    ``text[start:new_from]`` (at most ``overlap`` signs) repeats the end of the piece before; the
    parts from ``new_from`` on join to the whole text. Short texts are dropped before any
    shuffle or Python, so only oversized rows move.
    Defined cases: null, empty and short texts give no piece (they need no cut); rows with a null
    key count like any other; repeated deliveries of a key count once (the same text; of different
    ones the first in order); an empty table gives no row; other columns are ignored.
    """
    long = df.select(*keys, F.col(text).alias("_text")).filter(F.length("_text") > limit)
    one = long.groupBy(*keys).agg(F.min("_text").alias("_text"))
    kinds = dict(one.dtypes)
    schema = ", ".join(f"k{c} {kinds[k]}" for c, k in enumerate(keys)) + ", " + SCHEMA
    out = one.mapInArrow(lambda it: _pieces(it, limit, overlap, with_text), schema)
    return out.withColumnsRenamed({f"k{c}": k for c, k in enumerate(keys)})
