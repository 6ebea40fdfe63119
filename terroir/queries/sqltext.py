"""Text functions in SQL for the checks, written by themselves: RE2 has no look-around."""

from __future__ import annotations

WORD, SPACE = r"\pL\pM\p{Nd}\p{Pc}", r"\s\pZ\x{0B}\x{85}"
#: Fixed values, written out: the SQL must not follow the module's constants.
COMMON = "'a', 'and', 'the', 'an', 'du', 'del', 'do', 'da', 'le', 'la', 'i', 'co', 'company', 'inc', 'no', 'not', 'or'"


def _sub(c: str, pattern: str, new: str) -> str:
    return f"regexp_replace({c}, '{pattern}', '{new}', 'g')"


def cleanup(c: str) -> str:
    """Lower-case words for lookup; an empty result falls back to lower(c)."""
    s = f"replace({c}, '?', ' ?')"
    s = _sub(s, r"(\d+)\.([^0-9]|$)", r"\1 .\2")
    s = _sub(s, r"[/,.]+$", "")
    s = _sub(s, r"(.*\d)\s*-\s*(\$?\d.*)", r"\1 to \2")
    s = f"replace(lower(replace({s}, '-', ' ')), '''s', 's')"
    s = _sub(s, r"(.)\.\s?(.)[.$]", r"\1\2 ")
    s = _sub(s, rf"\.[^{WORD}]", " ")
    s = _sub(_sub(s, r"(\d),(\d)", r"\1\2"), r"(\d),(\d)", r"\1\2")
    s = _sub(s, r"([a-z]+)\.([a-z]+)", r"\1 \2")
    s = _sub(s, rf"[^.${SPACE}{WORD}]+", " ")
    s = f"trim({_sub(s, rf'[{SPACE}]+', ' ')})"
    return f"coalesce(nullif({s}, ''), lower({c}))"


def lookup_words(c: str) -> str:
    """The words of a cleaned text without common ones; a text of nothing else stays as it is."""
    plain = f"list_filter(string_split_regex(replace(replace({cleanup(c)}, '$', 'dollar'), '&', 'and'), '[{SPACE}]+'), lambda w: w <> '' AND NOT list_contains([{COMMON}], w))"
    return f"CASE WHEN len({plain}) > 0 THEN {plain} ELSE string_split(lower({c}), ' ') END"


def sentences(rows: str, c: str, initials: bool = True) -> str:
    """The rows of a query with ss, the sentences of column c: cut at white space after a stop that
    ends no abbreviation, title (or initial)."""
    here = lambda back, n: f"substr({c}, i - {back}, {n})"
    bad = [rf"i > 4 AND regexp_matches({here(4, 4)}, '^[{WORD}]\.[{WORD}].$')", rf"i > 3 AND regexp_matches({here(3, 3)}, '^[A-Z][a-z]\.$')"]
    if initials:
        bad.append(rf"i > 2 AND regexp_matches({here(2, 2)}, '^[A-Z]\.$')")
    cuts = rf"list_filter(generate_series(2, length({c})), lambda i: regexp_matches({here(1, 2)}, '^[.?][{SPACE}]$') AND NOT ({' OR '.join(f'({b})' for b in bad)}))"
    return f"SELECT *, list_transform(generate_series(1, len(b) - 1), lambda k: substr({c}, b[k] + 1, b[k + 1] - b[k] - 1)) AS ss FROM (SELECT *, list_concat([0], {cuts}, [length({c}) + 1]) AS b FROM ({rows}))"
