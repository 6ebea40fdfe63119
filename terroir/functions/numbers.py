"""Numbers as people write them, read inside the JVM (no Python workers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Currency words that may stand before or after an amount.
CURRENCY_WORDS = r"(?:US\$|A\$|USD|EUR|GBP|CHF|AUD|SFr\.?|[$€£])"
PLAIN = r"[0-9]+(?:\.[0-9]*)?|\.[0-9]+"
#: 1,234.5 and 1.234,5
GROUPED = r"[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]{1,3}(?:\.[0-9]{3})+,[0-9]+"
DECIMAL_COMMA = r"[0-9]+,[0-9]+"
AMOUNT = rf"(?:{GROUPED}|{DECIMAL_COMMA}|{PLAIN})"
EXPONENT = r"(?:[eE][+-]?[0-9]+)?"


def trimmed(c: Column) -> Column:
    """Text without outer white space (Unicode)."""
    return F.regexp_replace(c, r"(?U)^[\s\u200b\ufeff]+|[\s\u200b\ufeff]+$", "")


def blank_to_null(c: Column) -> Column:
    """Trimmed text; null if nothing but white space is left."""
    return F.nullif(trimmed(c), F.lit(""))


def plain_digits(num: Column, comma_groups: bool = True) -> Column:
    """The text of a number with point decimals and no group marks.

    A lone comma before exactly three digits groups thousands if comma_groups (unless the number
    begins with 0), else it is the decimal mark. One chain of replacements: num is used once.
    """
    if comma_groups:
        commas = r"(?<!^0),(?=\d{3}(?:,\d{3})*(?:\.\d+)?$)"
    else:
        commas = r",(?=\d{3}(?:,\d{3})*\.\d+$)|,(?=\d{3}(?:,\d{3})+$)|(?<=,\d{3}),(?=\d{3}(?:,\d{3})*$)"
    points = r"\.(?=\d{3}(?:\.\d{3})*,\d+$)"
    return F.translate(F.regexp_replace(F.regexp_replace(num, commas, ""), points, ""), ",", ".")


def stated_number(c: Column, comma_groups: bool = True) -> Column:
    """The amount that a text states, as decimal(20,6); null if it states none.

    '$1,283.76', 'USD 5.09', ' 46.9700 ', '22,44 EUR', '999.0' are read; 'N/A', '?', '' are not.
    """
    pattern = rf"(?i)^{CURRENCY_WORDS}?\s*([+-]?{AMOUNT}{EXPONENT})\s*{CURRENCY_WORDS}?$"
    return plain_digits(F.regexp_extract(trimmed(c), pattern, 1), comma_groups).try_cast("decimal(20,6)")
