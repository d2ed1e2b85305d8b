"""Problem 10: one consistent form for texts that look the same."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from themeweave.session import broadcast_if_small, cut

#: Classes up to this number are broadcast.
MAX_BROADCAST = 200_000

# Letters of other scripts, and the Latin phonetic letters, with the shape of an ordinary Latin letter.
SAME_SHAPE = {
    # Latin
    "ɑ": "a", "ɡ": "g", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z",
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    # Greek
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
    # Armenian
    "օ": "o", "ս": "u", "հ": "h", "Օ": "O", "Տ": "S",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭹ": "Y", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}
# Kinds of compatibility decomposition whose result has the ordinary sign's look. Raised, lowered, circled, styled and fraction signs look different and stay.
PLAIN_KINDS = ("<wide>", "<narrow>", "<compat>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>", "<small>")
# Format signs that are drawn.
DRAWN_FORMAT = "؀؁؂؃؄؅۝܏࢐࢑࣢"
# Further ignorable signs (fillers, joiners, variation selectors), as code point ranges.
IGNORABLE = ((0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF))
BLANK_LETTERLIKE = "⠀"


@functools.lru_cache(maxsize=4)
def _table(fold_case: bool) -> dict[int, str | None]:
    """str.translate table for decomposed text, derived from the Unicode database."""
    out: dict[int, str | None] = {}
    for cp in range(0x80):
        if chr(cp).isspace():
            out[cp] = " "
        elif unicodedata.category(chr(cp)) == "Cc":
            out[cp] = None
    for cp in range(0x80, sys.maxunicode + 1):
        if 0x3400 <= cp <= 0x9FFF or 0xAC00 <= cp <= 0xDFFF or 0x20000 <= cp <= 0xDFFFF:
            continue
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind == "Cn":
            continue
        if ch.isspace() or kind in ("Zs", "Zl", "Zp") or ch in BLANK_LETTERLIKE:
            out[cp] = " "
        elif kind == "Cc" or (kind == "Cf" and ch not in DRAWN_FORMAT and cp < 0x110BD):
            out[cp] = None
        elif ch in SAME_SHAPE:
            out[cp] = SAME_SHAPE[ch]
        elif (d := unicodedata.decomposition(ch)).startswith(PLAIN_KINDS):
            plain = unicodedata.normalize("NFKD", ch)
            if plain[0] != " ":  # spacing accents stay
                out[cp] = "".join(SAME_SHAPE.get(c, c) for c in plain)
    for a, b in IGNORABLE:
        for cp in range(a, b + 1):
            out[cp] = None
    if fold_case:
        for cp in range(0x80):
            if chr(cp).isupper():
                out[cp] = chr(cp).lower()
    return out


def visual_form(text: str, fold_case: bool = False) -> str:
    """The one form of all texts that look like ``text``.

    Full-width signs, ligatures and presentation forms become ordinary signs, every kind of
    blank one blank, invisible signs nothing, letters of other scripts the Latin letter of
    the same shape; accents are composed. Case, accents, digits and punctuation stay
    (``fold_case`` folds case as well). Applying it again changes nothing.
    """
    if text.isascii() and not fold_case:
        return text if text.isprintable() else text.translate(_table(False))
    table = _table(fold_case)
    out = unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(table))
    if fold_case:
        out = unicodedata.normalize("NFC", out.casefold())
    return out


#: Stands between the texts of a batch; no text is changed across it.
_BETWEEN = "\U0010ffff"


@functools.lru_cache(maxsize=4)
def _signs(fold_case: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each code point the one that replaces it, and whether it is dropped (1) or becomes several (2)."""
    to, how = np.arange(sys.maxunicode + 1, dtype=np.uint32), np.zeros(sys.maxunicode + 1, np.uint8)
    for cp, new in _table(fold_case).items():
        if not new:
            how[cp] = 1
        elif len(new) == 1:
            to[cp] = ord(new)
        else:
            how[cp] = 2
    return to, how


def visual_forms_of(texts: list[str], fold_case: bool = False) -> dict[str, str]:
    """The form of each distinct text, all together: one normalisation and one table look-up over the joined texts."""
    todo = dict.fromkeys(texts)
    out = {t: t for t in todo if not fold_case and t.isascii() and t.isprintable()}
    rest = [t for t in todo if t not in out]
    out |= {t: visual_form(t, fold_case) for t in rest if _BETWEEN in t}
    rest = [t for t in rest if t not in out]
    if rest:
        plain = unicodedata.normalize("NFD", _BETWEEN.join(rest))
        to, how = _signs(fold_case)
        signs = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = how[signs]
        if (kind == 2).any():
            changed = plain.translate(_table(fold_case))
        else:
            changed = to[signs[kind == 0]].tobytes().decode("utf-32-le", "surrogatepass")
        forms = unicodedata.normalize("NFC", changed)
        if fold_case:
            forms = unicodedata.normalize("NFC", forms.casefold())
        out |= zip(rest, forms.split(_BETWEEN))
    return out


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = lambda t: xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass"))
    for b in batches:
        for lo in range(0, b.num_rows, 1000):
            part = b.slice(lo, 1000)
            texts = part.column(1).to_pylist()
            done = {t: (digest(form), digest(t)) for t, form in visual_forms_of([t for t in texts if t is not None]).items() if form.strip()}
            at = [i for i, t in enumerate(texts) if t in done]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array([done[texts[i]][0] for i in at], pa.binary()), pa.array([done[texts[i]][1] for i in at], pa.binary())], names=["ident", "look", "own"])


def _forms(batches: Iterator[pa.RecordBatch], fold_case: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 1000):
            part = b.slice(lo, 1000)
            texts = part.column(1).to_pylist()
            done = visual_forms_of([t for t in texts if t is not None], fold_case)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if t is None else done[t] for t in texts], pa.string())], names=["ident", "form"])


def visual_forms(df: DataFrame, ident: str, text: str, *, fold_case: bool = False) -> DataFrame:
    """(ident, form): the visual form of every row's text; null stays null, an empty text empty."""
    kind = dict(df.dtypes)[ident]
    return df.select(ident, text).mapInArrow(lambda it: _forms(it, fold_case), f"ident {kind}, form string").withColumnRenamed("ident", ident)


def _mixed(df: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, look, own, n_texts) of the rows whose form is shared by several different texts."""
    kind = dict(df.dtypes)[ident]
    keyed = cut(df.select(ident, text).filter(F.col(ident).isNotNull() & F.col(text).isNotNull()).mapInArrow(_keys, f"ident {kind}, look binary, own binary"))
    several = keyed.select("look", "own").distinct().groupBy("look").agg(F.count("*").alias("n_texts")).filter("n_texts > 1")
    return cut(keyed.join(broadcast_if_small(several, MAX_BROADCAST), "look").distinct())


def look_alike_classes(df: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, class_id, n_texts, n_rows): each row whose text looks like a different one, with the smallest identifier,
    the number of different texts and of rows of its class. Linear in the rows, however many copies a class holds.

    Defined cases as in ``look_alikes``."""
    mixed = _mixed(df, ident, text)
    classes = mixed.groupBy("look").agg(F.min("ident").alias("class_id"), F.count_distinct("ident").alias("n_rows"))
    joined = mixed.select("ident", "look", "n_texts").distinct().join(broadcast_if_small(classes, MAX_BROADCAST), "look")
    return joined.select(F.col("ident").alias(ident), "class_id", "n_texts", "n_rows")


def look_alikes(df: DataFrame, ident: str, text: str) -> DataFrame:
    """Pairs (ident_a, ident_b), a < b, of rows whose texts differ but have one visual form.

    Only 128-bit keys are shuffled, never texts. Classes of exact copies are told apart first:
    a form with a single text never reaches the pairing, however many copies it has, and
    pairs are made of classes and then expanded to their members.
    Defined cases: null texts and texts without a visible sign are in no pair; exact copies
    are no pair with each other but each pairs with every different look-alike; repeated
    rows (same identifier) count once; an empty table gives no row.
    """
    mixed = _mixed(df, ident, text).select("ident", "look", "own")
    cls = mixed.select("look", "own").distinct()
    pairs = cls.alias("x").join(cls.alias("y"), (F.col("x.look") == F.col("y.look")) & (F.col("x.own") < F.col("y.own"))).select(F.col("x.own").alias("own_x"), F.col("y.own").alias("own_y"))
    members = mixed.select("own", "ident")
    left = pairs.join(members.withColumnRenamed("own", "own_x").withColumnRenamed("ident", "ix"), "own_x")
    both = left.join(members.withColumnRenamed("own", "own_y").withColumnRenamed("ident", "iy"), "own_y").filter("ix <> iy")
    return both.select(F.least("ix", "iy").alias(f"{ident}_a"), F.greatest("ix", "iy").alias(f"{ident}_b")).distinct()
