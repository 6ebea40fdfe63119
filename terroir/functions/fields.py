"""Fields of scraped records, brought to one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def listing_name(c: Column) -> Column:
    """Without the remarks on other prices."""
    return F.regexp_replace(c, r" \((?:Elsewhere|Previously) \$\d*\)", "")


def last_year(c: Column) -> Column:
    """The last run of four digits that begins with 1, 2 or 3; null if there is none."""
    return F.nullif(F.regexp_extract(c, r"^.*([1-3][0-9]{3})", 1), F.lit(""))


def plain_price(c: Column) -> Column:
    """$ and commas off; null if the rest is no number."""
    return F.regexp_replace(c, "[$,]", "").try_cast("double")


def first_stated(*cs: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cs])


def first_integer(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(\d+)", 1), F.lit("")).try_cast("int")


def size_ladder(c: Column) -> Column:
    """Millilitres by the words of a name."""
    s = F.lower(c)
    return F.when(s.rlike("half[- ]bottle|375 *ml"), 375).when(s.rlike("500 *ml"), 500).when(s.rlike("lit(er|re)"), 1000).otherwise(750)


def size_cell(c: Column) -> Column:
    """'1.5L' -> 1500, '750mL' -> 750, '3l' -> 3000; null if it states none."""
    n = F.regexp_replace(F.lower(c), "ml|l", "").try_cast("double")
    return F.when(n < 10, n * 1000).otherwise(n).cast("int")


def image_address(c: Column, host: str) -> Column:
    """Large version, with a scheme and a host."""
    s = F.regexp_replace(c, "w_.*progressive", "w_1080")
    return F.when(s.startswith("//"), F.concat(F.lit("https:"), s)).when(s.startswith("http"), s).otherwise(F.concat(F.lit(host + "/"), F.ltrim(F.regexp_replace(s, "^/+", ""))))


def sku_code(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "(?i)sku ?[#:] ?", ""))


def unquoted(c: Column) -> Column:
    return F.regexp_replace(c, '^"(.*)"$', "$1")


def wine_kind(c: Column) -> Column:
    """One of the known kinds, with a capital; null for others."""
    s = F.lower(c)
    out = F.lit(None).cast("string")
    for word in ("dessert", "sparkling", "ros", "white", "red"):
        out = F.when(s.contains(word), "Rose" if word == "ros" else word.capitalize()).otherwise(out)
    return out


def score_number(c: Column) -> Column:
    """'92-94' -> 94, '90+' -> 90; null if it is no number."""
    return F.element_at(F.split(F.regexp_replace(c, r"\+", ""), "-"), -1).try_cast("int")


def stock_sum(cells: Column) -> Column:
    """Sum of an inventory's cells ('> 5', '7'); cells without a number count 0."""
    n = F.transform(cells, lambda c: F.coalesce(F.regexp_replace(c, "[<> ]", "").try_cast("int"), F.lit(0)))
    return F.aggregate(n, F.lit(0), lambda a, b: a + b)


def stock_by_words(c: Column, none: str = "unavailable|inquire|sold out", some: int = 100) -> Column:
    """0 if the text says that there is none, else a nominal number; null stays null."""
    return F.when(F.lower(c).rlike(none), 0).otherwise(F.when(c.isNotNull(), some))


def with_features(about: Column, **features: Column) -> Column:
    """A description without enclosing quotes, and what else is stated after it, each under its name."""
    rest = [F.when(F.trim(x) != "", F.concat(F.lit(f"{k}: "), F.trim(x))) for k, x in features.items()]
    return F.concat_ws(" ", unquoted(about), *rest)


def equal_or_same_text(a: Column, b: Column) -> Column:
    return F.coalesce(a.eqNullSafe(b) | (a.cast("string") == b.cast("string")), F.lit(False))


def words_between(words: Column, start: Column, end: Column) -> Column:
    """The words at start..end - 1, joined; empty if there are none."""
    return F.array_join(F.slice(words, start + 1, F.greatest(end - start, F.lit(0))), " ")
