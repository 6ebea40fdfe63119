"""Words of a text as they are compared: no case, accents, markup, layout or invisible marks."""

from __future__ import annotations

import html
import re
import unicodedata

#: Zero-width and bidi marks, soft hyphens, joiners, variation selectors.
INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿]")
TAG = re.compile(r"<(?:/?[a-zA-Z][^<>]*|!--.*?--|![^<>]*)>", re.S)
AMP = re.compile("&amp;", re.I)
WORD = re.compile(r"[^\W_]+")
#: Letters that don't decompose.
PLAIN = str.maketrans({"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})
BROKEN = re.compile("[ÃÂâã][\u0080-¿€‚-›Œ-ƒˆ˜™]+")


def repair(text: str) -> str:
    """Undoes UTF-8 that was read as cp1252 or latin-1, where that is what happened."""

    def one(m: re.Match) -> str:
        for code in ("cp1252", "latin-1"):
            try:
                return m[0].replace("ã", "Ã").encode(code).decode("utf-8")
            except UnicodeError:
                continue
        return m[0]

    return BROKEN.sub(one, text) if BROKEN.search(text) else text


def visible(text: str, gap: str = " ") -> str:
    """Text without tags, entities (escaped up to twice) and invisible marks."""
    if "&" in text:
        text = html.unescape(html.unescape(AMP.sub("&amp;", text)))
    if "<" in text:
        text = TAG.sub(gap, text)
    return text if text.isascii() else INVISIBLE.sub("", repair(text))


def fold(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", text.casefold().translate(PLAIN))
    return "".join(c for c in text if not unicodedata.combining(c))


def words(text: str | None) -> list[str]:
    return WORD.findall(fold(visible(text))) if text else []
