"""The parts of a wine listing: house, cuvée, designation, grapes, vintage, size.

Names, aliases and kinds come from the reference list; typing errors of one edit are read through
an index of deletions. What is left of the name after all known parts is the cuvée.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from terroir.llm.canonical import COMMON, JOINING, abbreviates, edit_distance, varietal_parts
from terroir.llm.words import visible, words

#: Designations, as folded words, and their short forms.
DESIGNATIONS = {
    "estate selection": ["estate selection", "estate sel", "est sel", "est selection"],
    "old vines": ["old vines", "old vine", "ov"],
    "gran reserva": ["gran reserva"],
    "reserve": ["reserve", "rsv", "res"],
    "riserva": ["riserva", "ris"],
    "reserva": ["reserva"],
    "grand cru": ["grand cru"],
    "cru": ["cru"],
}
#: Words put before a cuvée that aren't part of it.
BEFORE_CUVEE = {"lot", "vigna", "cuvee", "cuv"}
NOT_CUVEE = {"wine", "wines", "producer"}
#: Short forms of words in grape names.
SHORT = {"blc": "blanc", "nr": "noir", "pt": "petit", "gr": "gris", "bco": "bianco"}
#: Selling words, taken out before the name is read.
SELLING = re.compile(
    r"free shipping|award[ -]winner|great value|best buy|top pick|staff (?:favorite|pick)|low stock|limited(?: edition)?!?|gift (?:box|tin)|founded (?:in )?\d{4}|\bsale\b|\*\* ?new ?\*\*|\bnew!|"
    r"\((?:elsewhere|previously)[^)]*\)|\b\d{2,3}\s*(?:pts|points?)\b|\b(?:red|white|ros[eé]|dessert|sparkling|orange)\s+wine\b|\(limited!?\)|in stock|sold out|must[ -]have|last bottles?",
    re.I,
)
SIZE_TEXT = re.compile(r"(?<![\w.,])(\d+(?:[.,]\d+)?)\s*(ml|millilit(?:er|re)s?|cl|centilit(?:er|re)s?|l|lit(?:er|re)s?|fl\.?\s*oz|oz|ounces?)\b\.?", re.I)
NAMED_SIZE = re.compile(r"\b(double magnum|magnum|half[ -]bottle|split|standard bottle|std\.? btl|1/2 btl)\b", re.I)
NAMED_ML = {"double magnum": 3000, "magnum": 1500, "half bottle": 375, "half-bottle": 375, "split": 187, "standard bottle": 750, "std btl": 750, "std. btl": 750, "1/2 btl": 375}
UNIT_ML = {"m": 1.0, "c": 10.0, "l": 1000.0, "f": 29.5735295625, "o": 29.5735295625}
#: Bottle sizes in trade; a size within 1.5 % of one is that one.
TRADE_SIZES = (187, 200, 250, 375, 500, 620, 700, 720, 750, 1000, 1500, 2250, 3000, 4500, 5000, 6000, 9000, 12000)
NON_VINTAGE = re.compile(r"\bnon[ -]?vintage\b|\bN\.?V\b\.?", re.I)
YEAR = re.compile(r"(?<![\d$.,])((?:19|20)\d\d)(?![\d]|[.,]\d)|(?<![\w])['’](\d\d)(?!\d)")


def snap(ml: float) -> int:
    near = min(TRADE_SIZES, key=lambda s: abs(s - ml))
    return near if abs(near - ml) <= 0.015 * near else round(ml)


def year_of(text: str | None) -> str | None:
    """'2017', 'NV' or None."""
    if not text:
        return None
    m = re.search(r"(?:19|20)\d\d", text)
    if m:
        return m[0]
    m = re.search(r"['’](\d\d)\b", text)
    if m:
        return ("20" if int(m[1]) < 60 else "19") + m[1]
    return "NV" if NON_VINTAGE.search(text) else None


class Fuzzy:
    """Phrases found exactly, or with one edit if they have at least six letters."""

    def __init__(self) -> None:
        self.exact: dict[str, list[object]] = {}
        self.deleted: dict[str, set[str]] = {}
        self.known: dict[str, list[object]] = {}  # phrases looked up before, a bounded memory

    def add(self, phrase: str, what: object) -> None:
        if what not in self.exact.setdefault(phrase, []):
            self.exact[phrase].append(what)
        if len(phrase) >= 6:
            for x in {phrase, *(phrase[:i] + phrase[i + 1 :] for i in range(len(phrase)))}:
                self.deleted.setdefault(x, set()).add(phrase)

    def get(self, phrase: str, fuzzy: bool) -> list[object]:
        if phrase in self.exact:
            return self.exact[phrase]
        if not fuzzy or len(phrase) < 5:
            return []
        if phrase not in self.known:
            if len(self.known) >= 200_000:
                self.known.clear()
            self.known[phrase] = self._near(phrase)
        return self.known[phrase]

    def _near(self, phrase: str) -> list[object]:
        near: set[str] = set()
        for x in {phrase, *(phrase[:i] + phrase[i + 1 :] for i in range(len(phrase)))}:
            near |= self.deleted.get(x, set())
        near = {p for p in near if edit_distance(phrase, p, 1) == 1}
        return self.exact[next(iter(near))] if len(near) == 1 else []


@dataclass
class Parts:
    house: int = -1
    houses: tuple[int, ...] = ()  # those that the name may mean, if house is -1
    cuvee: tuple[str, ...] = ()
    designation: str = ""
    grapes: tuple[int, ...] = ()
    vintage: str = "NV"
    size: int = 750
    unread: list[str] = field(default_factory=list)


class Reader:
    """Reads listings against the reference list: (node, attribute, name) entries.

    selling: take known selling words out first; large tables teach them by themselves.
    """

    def __init__(self, entries: list[tuple[int, int, str]], brand: int = 5, grape: int = 7, selling: bool = True) -> None:
        self.selling = selling
        count: dict[str, int] = {}
        for _, a, name in entries:
            if a == brand:
                for w in set(words(name)):
                    count[w] = count.get(w, 0) + 1
        self.common = {w for w, c in count.items() if c >= COMMON}
        self.houses, self.grapes, self.kinds = Fuzzy(), Fuzzy(), Fuzzy()
        self.house_words: dict[int, list[set[str]]] = {}
        self.longest = 2
        for node, a, name in entries:
            ws = words(name)
            if a == brand:
                core = [w for w in ws if w not in self.common and w not in JOINING]
                self.longest = max(self.longest, len(core))
                self.houses.add("".join(core), node)
                self.house_words.setdefault(node, []).append({w for w in ws if w not in core})
            elif a == grape:
                self.grapes.add("".join(ws), node)
        for name, forms in DESIGNATIONS.items():
            for f in forms:
                self.kinds.add(f.replace(" ", ""), name)

    # -- pieces

    def _find(self, ws: list[str], index: Fuzzy, longest: int, fuzzy: bool) -> tuple[int, int, list[object]] | None:
        exact, known = index.exact, index.known
        for n in range(min(longest, len(ws)), 0, -1):
            for i in range(len(ws) - n + 1):
                phrase = ws[i] if n == 1 else "".join(ws[i : i + n])
                got = exact.get(phrase)
                if got is None and fuzzy and len(phrase) >= 5:
                    got = known.get(phrase)
                    if got is None:
                        got = index.get(phrase, True)
                if got:
                    return i, i + n, got
        return None

    def _house_kind(self, node: int, near: list[str], fuzzy: bool) -> int:
        """How many of the common words near a house's name fit it."""
        best = 0
        for kind in self.house_words[node]:
            kind = kind - JOINING
            best = max(best, sum(1 for w in near if w in kind or any(abbreviates(w, k) for k in kind) or (fuzzy and any(_misspells(w, k) for k in kind))))
        return best

    def house_of(self, ws: list[str], known: int = -1) -> tuple[list[int], list[str]]:
        """The house that a name's words state (none: [], several that they may mean: all), and the words without it."""
        at = None
        for fuzzy in (False, True):
            at = self._find(ws, self.houses, self.longest, fuzzy)
            if at:
                break
        if not at:
            return [], ws
        i, j, nodes = at
        meant = nodes
        for fuzzy in (False, True):
            if len(meant) > 1:  # houses that differ in kind only
                places = [k for k in (*range(max(0, i - 3), i), *range(j, min(j + 3, len(ws)))) if not self._designates(ws, k)]
                near = [w for w in (ws[k].replace("soehne", "sohne") for k in places) if self._is_kind(w, fuzzy)]
                fit = {n: self._house_kind(n, near, fuzzy) for n in meant}
                meant = [n for n in meant if fit[n] == max(fit.values())]
        if len(meant) > 1 and known in nodes:
            meant = [known]
        kinds = set().union(*(k for n in nodes for k in self.house_words[n]))
        taken: set[str] = set()  # a kind stands once: in 'Clos Gublosac Clos Perdu' the second is the cuvée's
        while i > 0 and ws[i - 1] not in taken and self._belongs(ws[i - 1], kinds):
            i -= 1
            taken.add(ws[i])
        while j < len(ws) and ws[j] not in taken and self._belongs(ws[j], kinds) and not (ws[j] == "estate" and j + 1 < len(ws) and ws[j + 1].startswith("sel")):
            j += 1
        return meant, ws[:i] + ["|"] + ws[j:]

    def _designates(self, ws: list[str], k: int) -> bool:
        """Whether a word is part of a designation and so says nothing of the house's kind."""
        after = ws[k + 1] if k + 1 < len(ws) else ""
        return ws[k] in ("ov", "cru", "ris", "rsv") or (ws[k] in ("vine", "vines") and k > 0 and ws[k - 1] == "old") or (ws[k] in ("estate", "est") and after.startswith("sel"))

    def _is_kind(self, w: str, fuzzy: bool) -> bool:
        return w in self.common or (len(w) <= 5 and any(abbreviates(w, c) for c in self.common)) or (fuzzy and any(_misspells(w, c) for c in self.common))

    def _belongs(self, w: str, kinds: set[str]) -> bool:
        if w in BEFORE_CUVEE or w in ("ov", "cru", "ris", "rsv", "vine", "vines"):
            return False
        return w in kinds or w in ("di", "e", "et", "u", "und", "soehne", "the") or (len(w) <= 5 and any(abbreviates(w, k) for k in kinds - JOINING)) or any(_misspells(w, k) for k in kinds)

    def grapes_of(self, ws: list[str]) -> tuple[list[int], list[str]]:
        ws = [SHORT.get(w, w) for w in ws]
        found: list[tuple[int, int]] = []
        for fuzzy in (False, True):
            while at := self._find(ws, self.grapes, 3, fuzzy):
                i, j, nodes = at
                found.append((i, nodes[0]))
                ws = ws[:i] + ["|"] * (j - i) + ws[j:]
        return list(dict.fromkeys(n for _, n in sorted(found))), ws

    def kinds_of(self, ws: list[str]) -> tuple[str, list[str]]:
        for fuzzy in (False, True):
            at = self._find(ws, self.kinds, 2, fuzzy)
            if at:
                i, j, names = at
                return str(names[0]), ws[:i] + ["|"] + ws[j:]
        return "", ws

    # -- whole listings

    def read(self, name: str | None, house: int, varietals: str | None, vintage: str | None, size_ml: float | None) -> Parts:
        """house: the node that the brand column means, -1 if none. size_ml: the size column's."""
        out = Parts()
        text = " ".join(visible(name or "").split())
        if self.selling:
            text = SELLING.sub(" | ", text)
        column_year = year_of(vintage)
        sizes = [float(m[1].replace(",", ".")) * UNIT_ML[m[2][0].lower()] for m in SIZE_TEXT.finditer(text)]
        text = SIZE_TEXT.sub(" | ", text)
        named = NAMED_SIZE.findall(text)
        text = NAMED_SIZE.sub(" | ", text)
        sizes += [NAMED_ML[re.sub(r"\s+", " ", n.lower())] for n in named]
        years = [m[1] or ("20" if int(m[2]) < 60 else "19") + m[2] for m in YEAR.finditer(text)]
        said_nv = bool(NON_VINTAGE.search(text))
        text = NON_VINTAGE.sub(" | ", YEAR.sub(" | ", text))
        out.vintage = (years[-1] if years else None) or column_year or ("NV" if said_nv else None) or "NV"
        out.size = snap(size_ml) if size_ml else snap(sizes[-1]) if sizes else 750
        ws = words(re.sub(r"\|", " ", text))
        # the house: as the column says, if it means one; else as the name says
        stated, rest = self.house_of(ws, house)
        stated = [house] if house > 0 else stated
        out.house, out.houses = (stated[0], ()) if len(stated) == 1 else (-1, tuple(sorted(stated)))
        grapes, rest = self.grapes_of(rest)
        column: list[int] = []
        for part in varietal_parts(varietals or ""):
            column += [g for g in self.grapes_of(words(part))[0] if g not in column]
        out.grapes = tuple(grapes or column)
        out.designation, rest = self.kinds_of(rest)
        left = [w for w in rest if w != "|"]
        left = [w for w in left if w not in NOT_CUVEE or len(left) == 1]
        before = [_before(w) for w in left]
        while left and before[0] and len(left) > 1 and not (left[0] == "lot" and left[1].isdigit()):
            left, before = left[1:], before[1:]
        out.cuvee = tuple(w for k, w in enumerate(left) if not (before[k] and k + 1 < len(left) and not left[k + 1].isdigit()))
        return out


def _misspells(w: str, kind: str) -> bool:
    return len(kind) >= 5 and edit_distance(w, kind, 1) <= 1


def _before(w: str) -> bool:
    """A word that stands before a cuvée, also with one error if it is long enough."""
    return w in BEFORE_CUVEE or (len(w) >= 4 and any(len(x) >= 5 and edit_distance(w, x, 1) == 1 for x in BEFORE_CUVEE))
