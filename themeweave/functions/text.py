"""Text functions as Column expressions (no Python workers).

All follow SQL null rules: a null text gives null unless the docstring says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Terms that mark talk of privacy, matched as whole words.
PRIVACY_TERMS = (
    "privacy", "private", "personal data", "personal information", "data protection", "gdpr", "consent", "permission", "surveillance", "monitoring", "tracking", "profile", "profiling", "identif", "anonym",
    "de-anonym", "re-identif", "biometric", "face recognition", "facial recognition", "cctv", "data sharing", "data use", "data misuse", "data breach", "leak", "cyber", "security", "hacking",
)
# Patterns of a bibliography entry.
BIBLIOGRAPHY_TOKENS = (r"et al\.?", r"doi:", r"http(?:s)?://", r"pp?\.\s*\d+", r"vol\.", r"isbn", r"issn")
# Words that name a technology rather than a view of it.
TECH_WORDS = ("ai", "artificial intelligence", "nuclear", "genetic", "nano", "genome", "robot", "drone", "quantum", "gm", "embryo", "stem cell", "neural", "brain-computer")
TECH_TERMS_WIDE = (
    "ai", "artificial intelligence", "nuclear", "genetic", "genome", "gene", "crispr", "embryo", "stem cell", "nano", "robot", "drone", "autonomous", "quantum", "gm", "algorithm", "algorithmic", "automated", "automation",
    "radiation", "engineered", "biometric", "surveillance",
)
# Words about the dialogue itself.
META_VOCABULARY = ("public dialogue", "dialogue participants", "public engagement", "engagement process", "dialogue process", "public consultation", "stakeholder engagement", "public involvement", "public participation")
# Labels of one target technology.
TARGET_LABELS = ("ai", "artificial intelligence")


#: One white-space sign, of any script.
WS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapse_ws(s) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(c(s), WS + "+", " "))


def words(s) -> Column:
    return F.filter(F.split(c(s), WS + "+"), lambda x: x != "")


def word_count(s) -> Column:
    """Number of white-space separated words; null stays null."""
    return F.when(c(s).isNotNull(), F.size(words(s)))


def split_sentences(s) -> Column:
    """Sentences: cuts after . ! ? before an ASCII capital or any digit."""
    return F.filter(F.transform(F.split(collapse_ws(s), r"(?<=[.!?])\s+(?=[A-Z\p{Nd}])"), lambda x: F.trim(x)), lambda x: x != "")


def split_paragraphs(s) -> Column:
    """Blocks between blank lines, white space collapsed, empty ones dropped."""
    return F.filter(F.transform(F.split(c(s), rf"\n{WS}*\n"), collapse_ws), lambda x: x != "")


#: Stands between pieces while they are one string.
_PIECE = "\u0001\u0002"


def repack_sentences(sentences: Column, target: int) -> Column:
    """Sentences joined greedily up to ``target`` words; one of ``target`` words or more stands alone.

    The fold over the sentences only notes, one sign each, which of them open a piece; the sentences themselves
    are joined and cut once, so a long text isn't copied again for every sentence.
    """
    counted = F.transform(sentences, lambda s: F.struct(s.alias("s"), F.size(words(s)).alias("n")))
    start = F.struct(F.lit("").alias("opens"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        alone = x["n"] >= target
        fresh = alone | (a["n"] == 0) | (a["n"] + x["n"] > target)
        n = F.when(alone, 0).when(fresh, x["n"]).otherwise(a["n"] + x["n"])
        return F.struct(F.concat(a["opens"], F.when(fresh, F.lit("1")).otherwise(F.lit("0"))).alias("opens"), n.alias("n"))

    # bound as lambda variables, words are counted and the fold is made once
    bound = F.transform(F.array(counted), lambda c: F.struct(c.alias("c"), F.split(F.aggregate(c, start, step)["opens"], "").alias("o")))
    glued = lambda b: F.array_join(F.zip_with(b["c"], F.slice(b["o"], F.lit(1), F.size(b["c"])), lambda x, o: F.concat(F.when(o == "1", F.lit(_PIECE)).otherwise(F.lit(" ")), x["s"])), "")
    return F.transform(bound, lambda b: F.filter(F.split(glued(b), _PIECE), lambda x: x != ""))[0]


def truncate_words(s, n: int) -> Column:
    return F.concat_ws(" ", F.slice(words(s), 1, n))


def head_chars(s, n: int = 2000) -> Column:
    return F.substring(c(s), 1, n)


def parse_year(x) -> Column:
    """The first four digits found in ``x`` as a year of 1900 to 2100, else null."""
    digits = F.regexp_replace(c(x).cast("string"), "[^0-9]", "")
    year = F.when(F.length(digits) >= 4, F.left(digits, F.lit(4)).try_cast("int"))
    return F.when(year.between(1900, 2100), year)


#: Upper bounds and names of the standard time windows; the last has no bound.
WINDOWS = ((2017, "2004-2017"), (2020, "2018-2020"), (2023, "2021-2023"), (None, "2024-2025"))


def assign_window(year, windows: Sequence[tuple[int | None, str]] = WINDOWS) -> Column:
    """Name of the window a year falls in (bounds inclusive); null stays null."""
    out = F.when(c(year).isNull(), F.lit(None).cast("string"))
    for bound, name in windows:
        out = out.when(c(year) <= bound, name) if bound is not None else out.otherwise(name)
    return out


def tokenize(s) -> Column:
    """Lower-case ASCII tokens longer than three signs."""
    return F.filter(F.split(F.regexp_replace(F.lower(c(s)), r"[^a-z0-9\s]", " "), r"\s+"), lambda x: F.length(x) > 3)


def vocab_tokens(s) -> Column:
    """Whole words of three or more ASCII letters, lower-cased."""
    return F.regexp_extract_all(F.lower(c(s)), F.lit(r"\b[a-z]{3,}\b"), F.lit(0))


def bigrams(tokens: Column) -> Column:
    """Neighbouring tokens joined by a space; none for fewer than two tokens."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def escape_term(term: str) -> str:
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}-" else ch for ch in term)


def first_tech_word(s, terms: Sequence[str] = TECH_WORDS) -> Column:
    """The first of ``terms`` (in their order) that occurs as a whole word, or null."""
    low = F.lower(c(s))
    return F.coalesce(*[F.when(low.rlike(rf"\b{escape_term(t)}\b"), F.lit(t)) for t in terms])


def contains_term(s, terms: Sequence[str]) -> Column:
    """Whether any term occurs as a whole word, case aside; false for null."""
    return F.coalesce(c(s).rlike(r"(?i)\b(?:" + "|".join(map(escape_term, terms)) + r")\b"), F.lit(False))


def is_privacy_text(s) -> Column:
    return contains_term(s, PRIVACY_TERMS)


def looks_like_bibliography(s) -> Column:
    """A bibliography token together with a year in brackets; false for null."""
    token = c(s).rlike(r"(?i)\b(?:" + "|".join(BIBLIOGRAPHY_TOKENS) + r")\b")
    return F.coalesce(token & c(s).rlike(r"\([12]\d{3}\)"), F.lit(False))


def looks_like_table_row(s) -> Column:
    """Two or more percent signs; false for null."""
    return F.coalesce(F.length(c(s)) - F.length(F.replace(c(s), F.lit("%"))) >= 2, F.lit(False))


def is_missing_text(s) -> Column:
    """Null, or blank after trimming white space."""
    return c(s).isNull() | c(s).rlike(rf"^{WS}*$")


def pretty_label(cluster, label, width: int = 40) -> Column:
    """The label, or 'Cluster N' where there is none; cut to ``width`` with three dots."""
    text = F.coalesce(F.when(F.trim(c(label)) != "", c(label)), F.concat(F.lit("Cluster "), c(cluster).cast("string")))
    return F.when(F.length(text) > width, F.concat(F.left(text, F.lit(width - 3)), F.lit("..."))).otherwise(text)


def heatmap_label(cluster, label, width: int = 40) -> Column:
    text = F.coalesce(c(label), F.concat(F.lit("Cluster "), c(cluster).cast("string")))
    return F.when(F.length(text) > width, F.concat(F.left(text, F.lit(width)), F.lit("…"))).otherwise(text)


def html_escape(s) -> Column:
    out = c(s)
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def clean_control(s) -> Column:
    """Without control signs other than tab, line feed and carriage return."""
    return F.regexp_replace(c(s), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def paragraph_id(doc, index) -> Column:
    return F.concat(c(doc), F.lit("::p"), c(index).cast("string"))


def is_target_label(t, labels: Sequence[str] = TARGET_LABELS) -> Column:
    return F.coalesce(F.lower(F.trim(c(t))).isin(*labels), F.lit(False))


def parse_listcol(s) -> Column:
    """An array from its printed form: JSON (single quotes allowed), else parts between commas; nothing gives an empty array."""
    text = F.trim(F.coalesce(c(s), F.lit("")))
    plain = F.filter(F.transform(F.split(F.regexp_replace(text, r"^[\[(]|[\])]$", ""), ","), lambda x: F.trim(F.regexp_replace(F.trim(x), "^['\"]|['\"]$", ""))), lambda x: x != "")
    parsed = F.from_json(text, "array<string>")
    quoted = F.from_json(F.replace(text, F.lit("'"), F.lit('"')), "array<string>")
    return F.when(text.isin("", "[]", "nan"), F.array().cast("array<string>")).otherwise(F.coalesce(parsed, quoted, plain))


def parse_llm_json(s, schema: str) -> Column:
    """The JSON object of a model's reply, code fences removed, in a declared schema; null if it isn't one."""
    bare = F.regexp_replace(F.trim(c(s)), r"^```(?:json)?\s*|\s*```$", "")
    return F.from_json(F.regexp_extract(bare, r"(?s)\{.*\}", 0), schema)


def percent(x, digits: int = 1) -> Column:
    return F.concat(F.format_number(c(x) * 100, digits), F.lit("%"))
