"""Freely typed values mapped to the entries of a reference list (problem 6).

Values are deduplicated and normalised; candidates come from an inverted index of character
trigrams over the list's names and aliases, scored by idf-weighted cosine. A candidate above the
threshold is then set against the value word by word (a word that contradicts it rules it out), which
gives its exact weighted cosine: words that are short forms or errors count as the entry's words. The
best entry is accepted above a threshold and if it leads the next by the margin; else the value is
reported as unmatched (-1).

The list is sent to the executors in blocks of bounded size; the blocks' best candidates are
merged by value, so the result doesn't depend on the number of blocks.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terroir.llm.words import fold, visible, words
from terroir.session import Shared, spread

NONE = -1
#: Least cosine of a candidate; least cosine of an accepted entry, and its least lead over the next.
THRESHOLD, ACCEPTED, MARGIN = 0.15, 0.6, 0.03
#: What a word counts as if its letters are moved or glued, it is a short form, or has one error.
MOVED, SHORTENED, ERROR = 0.99, 0.97, 0.9
#: Entries of one block: the bound of what is broadcast at once (some tens of MB).
BLOCK_ENTRIES = 50_000
#: Blocks that a worker keeps in memory; of more, one at a time.
KEPT_BLOCKS = 4
#: A word of at least so many entries is a common one (a kind of house, a direction, a colour).
COMMON = 4
#: Words that join names and mean nothing here, and words that may be added.
JOINING = {"the", "and", "e", "et", "und", "y", "of", "from", "di", "de", "do", "da"}
ADDED = {"wine", "wines", "producer", "region", "grape", "grapes", "old", "vines", "ava", "aoc", "doc", "docg", "igt", "d", "o"}


def _up_to_one(a: str, b: str) -> int:
    """0, 1, or 2 for more edits."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1:
        return 2
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    if len(a) > len(b):
        return 1 if a[i + 1 :] == b[i:] else 2
    if i == len(a):
        return 0
    return 1 if a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]) else 2


def edit_distance(a: str, b: str, most: int) -> int:
    """Edits (a swap of neighbours counts one), or most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if most <= 1:
        return min(_up_to_one(a, b), most + 1)
    two, one, row = [], list(range(len(b) + 1)), []
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return row[-1] if a else len(b)


def abbreviates(short: str, word: str) -> bool:
    """cllrs for cellars, fatt for fattoria, nr for noir, p for pere."""
    if len(short) >= len(word) or not short or short[0] != word[0]:
        return False
    it = iter(word)
    return all(c in it for c in short)


def grams(text: str) -> list[str]:
    s = f"^{text}$"
    return [s[i : i + 3] for i in range(len(s) - 2)]


def key_words(text: str) -> list[str]:
    return [w for w in words(text) if w not in JOINING]


class Reference:
    """The entries of one field's list in one block, and their inverted index."""

    def __init__(self, entries: list[tuple[int, int, str]], frequency: Counter, n: int, common: set[str]) -> None:
        self.common = common
        self.by_letter: dict[str, list[str]] = {}
        for w in sorted(common):
            self.by_letter.setdefault(w[0], []).append(w)
        self.node = [e[0] for e in entries]
        self.depth = [e[1] for e in entries]
        self.words = [key_words(e[2]) for e in entries]
        self.idf = {g: float(np.log((1 + n) / (1 + c)) + 1) for g, c in frequency.items()}
        self.unseen = float(np.log(1 + n) + 1)
        index: dict[str, list[tuple[int, float]]] = {}
        self.norm = np.ones(len(entries))
        self.known: dict[str, float] = {}
        for k, ws in enumerate(self.words):
            weights = self.weights(ws)
            self.norm[k] = max(sum(x * x for x in weights.values()) ** 0.5, 1e-9)
            for g, x in weights.items():
                index.setdefault(g, []).append((k, x))
        self.index = {g: (np.array([k for k, _ in p]), np.array([x for _, x in p])) for g, p in index.items()}

    def weights(self, ws: list[str]) -> dict[str, float]:
        return {g: n * self.idf.get(g, self.unseen) for g, n in Counter(g for w in ws for g in grams(w)).items()}

    def candidates(self, ws: list[str]) -> list[tuple[int, float]]:
        """Every entry above the threshold: a lower cosine can still have the least cost."""
        weights = self.weights(ws)
        size = sum(x * x for x in weights.values()) ** 0.5
        score = np.zeros(len(self.node))
        for g, x in weights.items():
            if g in self.index:
                ks, xs = self.index[g]
                score[ks] += x * xs
        score /= self.norm * max(size, 1e-9)
        near = np.flatnonzero(score >= THRESHOLD)
        return [(int(k), float(score[k])) for k in near]

    def agrees(self, value: list[str], entry: list[str]) -> float | None:
        """Weighted cosine of value and entry once their words are set against each other (1 is equal),
        or None if a word contradicts the entry.

        A word that is a short form or an error of the entry's counts as that word, a little less;
        common words of the entry that the value leaves out count as what isn't in common.
        """
        if value == entry:
            return 1.0
        a, b = "".join(value), "".join(entry)
        if len(value) == 1 and any(w in a for w in JOINING):  # a joining word glued in between
            a = next((a[:i] + a[i + len(w) :] for w in JOINING for i in range(len(a)) if a[i : i + len(w)] == w and a[:i] + a[i + len(w) :] == b), a)
        if a == b or sorted(value) == sorted(entry):
            return MOVED
        most = 1 if len(b) >= 5 else 0
        if edit_distance(a, b, most) <= most:
            return ERROR
        core_b = [w for w in entry if w not in self.common]
        rest_b = [w for w in entry if w in self.common]
        core_a, left = [], list(rest_b)
        told = fit = 0.0  # weight of the entry's words that the value tells, and how well it does
        for w in value:
            if w in left:
                left.remove(w)
                told += self.weight(w)
                fit += self.weight(w)
            elif w in self.common and w not in core_b:
                if w in ADDED or w in ("winery",) and value[0] == w:
                    continue
                return None  # another house's or place's common word
            elif (m := next((x for x in left if abbreviates(w, x)), None)) and (len(w) <= 5):
                left.remove(m)
                told += self.weight(m)
                fit += SHORTENED * self.weight(m)
            elif (m := next((x for x in left if len(x) >= 5 and edit_distance(w, x, 1) == 1), None)) and len(w) >= 4:
                left.remove(m)
                told += self.weight(m)
                fit += ERROR * self.weight(m)
            elif w in ADDED and w not in core_b:
                continue
            elif len(w) <= 5 and len(value) > 1 and w not in core_b and any(abbreviates(w, x) and len(x) - len(w) >= 2 for x in self.by_letter.get(w[0], ())) and not any(abbreviates(w, x) for x in core_b) and len(w) <= 4 and self._short_common(w):
                return None  # an abbreviated common word that the entry doesn't have
            else:
                core_a.append(w)
        a, b = "".join(core_a), "".join(core_b)
        if not b or not a:
            return None
        quality = 1.0
        if a != b:
            most = 1 if len(b) >= 5 else 0
            if edit_distance(a, b, most) <= most:
                quality = ERROR
            elif glued := next((w for w in rest_b if w in left and (a == w + b or a == b + w)), None):
                # a left-out space has glued a common word to the name
                told += self.weight(glued)
                fit += self.weight(glued)
                quality = MOVED
            else:
                return None
        core = sum(self.weight(w) for w in core_b)
        told, fit = told + core, fit + quality * core
        return fit / max((told * sum(self.weight(w) for w in entry)) ** 0.5, 1e-9)

    def weight(self, word: str) -> float:
        """What a word adds to the square of its entry's length; common words add the same each, so
        that which of them a value leaves out tells nothing."""
        if word not in self.known:
            alike = sorted(self.common) if word in self.common else [word]
            self.known[word] = sum(x * x for w in alike for x in self.weights([w]).values()) / len(alike)
        return self.known[word]

    def _short_common(self, w: str) -> bool:
        return not any(c in "aeiouy" for c in w[1:]) or len(w) <= 4

    def best(self, text: str) -> list[tuple[int, int, float]]:
        """(node, depth, score) of the two entries that text can mean best: weighted cosine, best first."""
        value = key_words(text)
        if not value:
            return []
        out: dict[int, tuple[int, int, float]] = {}
        for k, _ in self.candidates(value):
            score = self.agrees(value, self.words[k])
            if score is not None and (self.node[k] not in out or score > out[self.node[k]][2]):
                out[self.node[k]] = (self.node[k], self.depth[k], score)
        return sorted(out.values(), key=lambda x: (-x[2], x[0]))[:2]


# -- values ------------------------------------------------------------------------------------


def _json_list(text: str) -> list[str] | None:
    if text.strip().startswith("["):
        try:
            got = json.loads(text)
        except ValueError:
            return None
        return [str(x) for x in got if x is not None] if isinstance(got, list) else None
    return None


def brand_parts(text: str) -> list[str]:
    text = re.sub(r"[®™©*]|\((?:producer|winery)\)", " ", visible(text), flags=re.I)
    text = re.sub(r"^\s*(?:winery|producer|house|brand)\s*:\s*", "", text, flags=re.I)
    m = re.match(r"^([^,]+),\s*([^,]+)$", text)
    return [f"{m[2]} {m[1]}" if m else text]


def region_parts(text: str) -> list[str]:
    text = re.sub(r"\bD\.\s*O\.(?:\s*C\.)?|\bA\.?V\.?A\b\.?|\bregion(?:\s+of)?\b|^\s*from\b", " ", visible(text), flags=re.I)
    return [p for p in re.split(r"\s*(?:>|/|,|;|\(|\)|\||→)\s*", text) if p.strip()]


def varietal_parts(text: str) -> list[str]:
    listed = _json_list(text)
    parts = listed if listed is not None else re.split(r"\s*(?:,|;|/|&|\+|\||\band\b)\s*", visible(text))
    out = []
    for p in parts:
        p = re.sub(r"\([^()]*\)|\d+(?:[.,]\d+)?\s*%|\*|\bgrapes?\b|\bold vines\b", " ", visible(p), flags=re.I)
        if p.strip(" .-\t\n"):
            out.append(p)
    return out


#: field -> (attribute_id in the list, splitter, keep only the deepest part)
FIELDS = {"brand": (5, brand_parts, True), "region": (6, region_parts, True), "varietals": (7, varietal_parts, False)}


def reference_entries(nodes: DataFrame, attribute_id: int) -> Iterator[tuple[int, int, str]]:
    """(node, depth, name) of every name and alias; roots aren't entries."""
    rows = nodes.where((F.col("attribute_id") == attribute_id) & F.col("id").isNotNull() & (F.coalesce("parent_id", F.lit(0)) != 0))
    for r in rows.select("id", "name", "aliases", "ancestor_node_path").orderBy("id").toLocalIterator():
        depth = (r.ancestor_node_path or "").count(",") + 1
        for name in [r.name, *(_json_list(r.aliases or "") or [])]:
            if name and words(name):
                yield r.id, depth, name


def references(nodes: DataFrame, attribute_id: int) -> Iterator[Reference]:
    frequency, in_entries, n = Counter(), Counter(), 0
    for _, _, name in reference_entries(nodes, attribute_id):
        ws = set(key_words(name))
        in_entries.update(ws)
        frequency.update({g for w in ws for g in grams(w)})
        n += 1
    common = {w for w, c in in_entries.items() if c >= COMMON}
    block: list[tuple[int, int, str]] = []
    for e in reference_entries(nodes, attribute_id):
        block.append(e)
        if len(block) == BLOCK_ENTRIES:
            yield Reference(block, frequency, n, common)
            block = []
    if block:
        yield Reference(block, frequency, n, common)


def _match_field(values: DataFrame, nodes: DataFrame, field: str) -> DataFrame:
    """value, part, node, depth, score: up to two candidates of each part."""
    attribute_id, split, _ = FIELDS[field]
    schema = "value string, part int, node bigint, depth int, score double"
    blocks = [Shared(values.sparkSession, block, keep=False) for block in references(nodes, attribute_id)]
    if not blocks:  # an empty list: nothing can be meant
        return values.select("value", F.lit(0).alias("part"), F.lit(NONE).cast("long").alias("node"), F.lit(0).alias("depth"), F.lit(0.0).alias("score"))

    def match(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, list] = {}
        for pdf in it:
            parts = [(v, k, part, fold(part).strip()) for v in pdf["value"] for k, part in enumerate(split(v) or [""])]
            # each distinct part is looked up once, in one block after the other
            new = {f: p for _, _, p, f in parts if f not in memo}
            found: dict[str, list] = {f: [] for f in new}
            for shared in blocks if new else ():
                for f, p in new.items():
                    found[f] += shared.value.best(p)
                if len(blocks) > KEPT_BLOCKS:
                    shared.drop()
            if len(memo) > 50_000:
                memo = {f: memo[f] for _, _, _, f in parts if f in memo}
            memo |= found
            rows = [(v, k, *g) for v, k, _, f in parts for g in memo[f] or [(NONE, 0, 0.0)]]
            yield pd.DataFrame(rows, columns=["value", "part", "node", "depth", "score"])

    return values.mapInPandas(match, schema)


def map_values(values: DataFrame, nodes: DataFrame, field: str) -> DataFrame:
    """value, node_id for each distinct value (column value) of a field."""
    deepest = FIELDS[field][2]
    found = _match_field(spread(values.select("value").distinct()), nodes, field)
    # the best two of a part over all blocks; one that leads by less than the margin means neither,
    # and so does a name without the common word that tells two entries apart
    ranked = found.groupBy("value", "part").agg(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("minus"), "node", "depth"))).alias("c"))
    first, second = F.get("c", F.lit(0)), F.get("c", F.lit(1))
    clear = (first["minus"] <= -ACCEPTED) & (second.isNull() | (second["minus"] - first["minus"] >= MARGIN))
    node = F.when((first["node"] != NONE) & clear, first["node"]).otherwise(NONE)
    parts = ranked.select("value", "part", node.alias("node"), F.when(node != NONE, first["depth"]).otherwise(-1).alias("depth"))
    if deepest:
        return parts.groupBy("value").agg(F.max_by("node", F.struct("depth", "part")).alias("node_id"))
    return parts.select("value", F.col("node").alias("node_id")).distinct()


def mapped_fields(products: DataFrame, nodes: DataFrame) -> DataFrame:
    """source_product_id, field_name, node_id (-1: means no entry) for every non-blank value.

    Each row once; varietals give a row for each distinct node. Null and blank values give none.
    Repeated listings with equal values give their rows once.
    """
    out = None
    for field in FIELDS:
        rows = products.select("source_product_id", F.col(field).alias("value")).where(F.length(F.regexp_replace("value", r"(?U)\s", "")) > 0).distinct()
        got = rows.join(map_values(rows, nodes, field), "value").select("source_product_id", F.lit(field).alias("field_name"), "node_id")
        out = got if out is None else out.unionByName(got)
    return out.distinct()
