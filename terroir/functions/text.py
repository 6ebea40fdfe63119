"""Text functions as column expressions; regexes use \\A and (?d) where only the first line counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Common words that a lookup leaves out.
COMMON_WORDS = ("a", "and", "the", "an", "du", "del", "do", "da", "le", "la", "i", "co", "company", "inc", "no", "not", "or")
#: Tokens whose presence is a feature of a question.
FEATURE_TOKENS = ("want", "question_does", "recommend", "question_is", "explain", "define", "compare", "what", "what_is", "what_does", "attribute", "attribute_unit", "category", "question_mark", "attribute_price", "predicate")


def clean(c: Column) -> Column:
    """Without line ends and outer white space."""
    return F.regexp_replace(F.regexp_replace(c, "[\r\n]", ""), r"(?U)^\s+|\s+$", "")


def space_before_period(c: Column) -> Column:
    """'5. Red' becomes '5 . Red'; '5.2' stays."""
    return F.regexp_replace(c, r"(\d+)\.(?!\d)", "$1 .")


def cleanup(c: Column) -> Column:
    """Lower-case words for lookup, in the fixed order of steps; an empty result falls back to lower(c).

    Ranges become 'to', possessives and initials close up, punctuation becomes a blank, thousands
    keep their digits.
    """
    s = F.regexp_replace(c, r"\?", " ?")
    s = space_before_period(s)
    s = F.regexp_replace(s, r"[/,.]+$", "")
    s = F.regexp_replace(s, r"(?d)(.*\d)\s*-\s*(\$?\d.*)", "$1 to $2")
    s = F.lower(F.translate(s, "-", " "))
    s = F.regexp_replace(s, "'s", "s")
    s = F.regexp_replace(s, r"(?d)(.)\.\s?(.)[.$]", "$1$2 ")
    s = F.regexp_replace(s, r"(?U)\.[\W$]", " ")
    s = F.regexp_replace(s, r"(\d),(?=\d)", "$1")
    s = F.regexp_replace(s, r"([a-z]+)\.([a-z]+)", "$1 $2")
    s = F.regexp_replace(s, r"(?U)[^\s.$\w]+", " ")
    s = F.trim(F.regexp_replace(s, r"(?U)\s+", " "))
    return F.coalesce(F.nullif(s, F.lit("")), F.lower(c))


def simple_words(c: Column) -> Column:
    """ASCII letters and digits in lower case, as an array of words."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")


def without_common_words(c: Column) -> Column:
    """Struct (text, removed): the words that aren't common ones, and the positions taken out.

    A dollar sign reads as 'dollar' and an ampersand as 'and', closed up to what stands beside it.
    """
    ws = F.split(F.regexp_replace(F.regexp_replace(c, r"\$", "dollar"), "&", "and"), r"(?U)\s+")
    ws = F.filter(ws, lambda w: w != "")
    common = F.array(*[F.lit(w) for w in COMMON_WORDS])
    removed = F.filter(F.transform(ws, lambda w, i: F.when(F.array_contains(common, w), i)), lambda i: i.isNotNull())
    return F.struct(F.array_join(F.filter(ws, lambda w: ~F.array_contains(common, w)), " ").alias("text"), removed.alias("removed"))


def prefixes(ws: Column, n: int = 3) -> Column:
    return F.transform(ws, lambda w: F.substring(w, 1, n))


def query_text(c: Column) -> Column:
    """Without the signs that a full-text query gives a meaning."""
    return F.translate(c, "'!()", " ")


def plain_signs(c: Column) -> Column:
    return F.ltrim(F.regexp_replace(c, r"[^A-Za-z0-9$]+", " "))


#: Where a text is split into sentences: at white space after a stop, but not after
#: abbreviations, titles and (in the first) initials.
SENTENCE_END = r"(?U)(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<![A-Z]\.)(?<=\.|\?)\s"
SUMMARY_SENTENCE_END = r"(?U)(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?)\s"


def sentences(c: Column) -> Column:
    return F.split(c, SENTENCE_END, -1)


def summary_sentences(c: Column) -> Column:
    return F.split(c, SUMMARY_SENTENCE_END, -1)


def without_links(c: Column) -> Column:
    return F.replace(F.regexp_replace(c, r"<a href=\"[^\"]*\">.*?</a>", " "), F.lit("  "), F.lit(" "))


def replace_phrases(c: Column, phrases: Sequence[tuple[str, str]]) -> Column:
    """Longest phrase first, as whole words, in lower case."""
    import re

    s = F.lower(c)
    for old, new in sorted(phrases, key=lambda p: (-len(p[0]), p[0])):
        s = F.regexp_replace(s, rf"\b{re.escape(old)}\b", new)
    return s


def join_phrases(c: Column, phrases: Sequence[str]) -> Column:
    """'red wine' becomes 'red_wine', longest first."""
    s = c
    for p in sorted(phrases, key=lambda p: (-len(p), p)):
        s = F.replace(s, F.lit(p), F.lit(p.replace(" ", "_")))
    return s


def _plain(text: str | None) -> str | None:
    import html
    import unicodedata

    if text is None:
        return None
    try:
        text = text.encode("latin-1").decode("utf-8")
    except UnicodeError:
        pass
    text = html.unescape(text).translate({0xDF: "ss", 0xE6: "ae", 0xF8: "o", 0x153: "oe", 0x2019: "'", 0x2018: "'", 0x201C: '"', 0x201D: '"', 0x2013: "-", 0x2014: "-"})
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def without_accents(c: Column) -> Column:
    """Broken UTF-8 repaired, entities resolved, accents off."""

    @F.pandas_udf("string")
    def plain(s: pd.Series) -> pd.Series:
        return s.map(lambda x: _plain(x) if isinstance(x, str) else None)

    return plain(c)


@lru_cache(maxsize=200_000)
def indel_ratio(a: str, b: str) -> int:
    """Similarity of 0..100 from the longest common subsequence (a substitution costs two)."""
    if not a and not b:
        return 100
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            keep = row[j]
            row[j] = before + 1 if x == y else max(row[j], row[j - 1])
            before = keep
    return round(200 * row[-1] / (len(a) + len(b)))


def ratio(a: Column, b: Column) -> Column:
    @F.pandas_udf("int")
    def each(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else indel_ratio(p, q) for p, q in zip(x, y)], dtype="Int32")

    return each(a, b)


def first_line_matches(c: Column, pattern: str) -> Column:
    """True if the pattern matches from the start, within the first line."""
    return c.rlike(rf"(?d)\A(?:{pattern})")
