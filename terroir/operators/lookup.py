"""Attributes found in sentences by a weighted dictionary.

The scorer and the greedy cover are plain functions over one sentence; Spark distributes the
distinct sentences and broadcasts the dictionary, whose size is checked.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terroir.functions.text import COMMON_WORDS, cleanup, indel_ratio
from terroir.operators.dictionary import Dictionary
from terroir.session import Shared, cut, spread

MAX_ENTRIES = 200_000
MASK = "*********"
#: Words of the category that say nothing in a partial match.
CATEGORY_WORDS = {"wine", "wines"}
#: Endings of plural nouns and of their singulars.
PLURALS = (("ies", "y"), ("ches", "ch"), ("shes", "sh"), ("ses", "s"), ("xes", "x"), ("zes", "z"), ("men", "man"), ("s", ""))
SCHEMA = "code string, entity_id bigint, value string, start int, `end` int, score double"


@dataclass(frozen=True)
class Settings:
    """Fixed values of the scoring, open to change."""

    fuzzy_length: int = 4
    fuzzy_ratio: int = 80
    known_penalty: int = 5
    ngram_bonus: float = 0.5
    perfect_bonus: float = 1.25
    brand_penalty: float = 0.30
    low_idf: float = 5.5
    high_idf: float = 8.0
    swap_ratio: float = 0.70
    last_run_only: bool = False


@dataclass
class Entry:
    entity_id: int
    code: str
    value: str
    words: list[str]
    max_idf: float
    insufficient: frozenset[str] = frozenset()


@dataclass
class Match:
    entry: Entry
    #: (word, position in the entry, position in the query, score, idf)
    matched: list[tuple[str, int, int, float, float]]
    unmatched: list[tuple[str, float]]
    score: float = 0.0
    exact: bool = False

    @property
    def positions(self) -> set[int]:
        return {q for _, _, q, _, _ in self.matched}


@dataclass
class Index:
    entries: list[Entry]
    idf: dict[str, float]
    settings: Settings = field(default_factory=Settings)

    def __post_init__(self) -> None:
        self.by_prefix: dict[str, list[int]] = {}
        self.by_letter: dict[str, list[int]] = {}
        self.by_text: dict[str, list[int]] = {}
        self.by_word: dict[str, list[int]] = {}
        for i, e in enumerate(self.entries):
            for p in {w[:3] for w in e.words}:
                self.by_prefix.setdefault(p, []).append(i)
            for c in {w[:1] for w in e.words}:
                self.by_letter.setdefault(c, []).append(i)
            for w in set(e.words):
                self.by_word.setdefault(w, []).append(i)
            self.by_text.setdefault(" ".join(e.words), []).append(i)
        for ids in self.by_text.values():
            ids.sort(key=lambda i: (-self.entries[i].max_idf, self.entries[i].entity_id))

    def fuzzy_score(self, word: str, other: str) -> float | None:
        """How well a query's word `other` fits an entry's word, if it isn't equal; None if it doesn't."""
        s = self.settings
        if word[:1] != other[:1] or abs(len(word) - len(other)) > 1:
            return None
        if min(len(word), len(other)) < s.fuzzy_length:
            # of short words only a plural is seen through
            if s.fuzzy_length - 1 not in (len(word), len(other)) or (word + "s" != other and other + "s" != word):
                return None
        r = indel_ratio(word, other) - (s.known_penalty if self.idf.get(other) else 0)
        return r / 100 if r > s.fuzzy_ratio else None

    def lemma(self, word: str) -> str:
        """The singular of a noun, if the dictionary has it; else the word."""
        for end, new in PLURALS:
            if word.endswith(end) and len(word) > len(end) and self.idf.get(word[: -len(end)] + new):
                return word[: -len(end)] + new
        return word

    def fuzzy_idf(self, word: str, other: str) -> float:
        own, query, root = self.idf.get(word, 0.0), self.idf.get(other, 0.0), self.idf.get(self.lemma(other), 0.0)
        known = root if root > 0 and (root < query or query == 0) else query
        return min(known, own, self.settings.high_idf) if known > 0 else min(own, self.settings.high_idf)

    def match(self, entry: Entry, query: list[str], fuzzy: bool) -> Match:
        """Greedy: each word of the entry takes the first free word of the query that fits."""
        used: set[int] = set()
        out = Match(entry, [], [])
        for k, w in enumerate(entry.words):
            best = None
            for q, x in enumerate(query):
                if q in used:
                    continue
                if x == w:
                    best = (q, 1.0, self.idf.get(w, 0.0))
                elif fuzzy and x != MASK and (r := self.fuzzy_score(w, x)) is not None:
                    best = (q, r, self.fuzzy_idf(w, x))
                if best:
                    break
            if best is None:
                out.unmatched.append((w, self.idf.get(w, 0.0)))
            else:
                used.add(best[0])
                out.matched.append((w, k, *best))
        return out

    def run_length(self, matched: list[tuple[str, int, int, float, float]]) -> int:
        run, longest = 0, 0
        before: tuple[int, int] | None = None
        for _, k, q, _, idf in matched:
            if idf <= 0:
                continue
            run = run + 1 if before == (k - 1, q - 1) else 1
            longest, before = max(longest, run), (k, q)
        return run if self.settings.last_run_only else longest

    def scored(self, m: Match, query_length: int) -> bool:
        """Sets score and exact; False if the match is rejected."""
        s, brand = self.settings, m.entry.code == "brand"
        if not m.matched:
            return False
        inexact = any(x[3] < 1 for x in m.matched)
        high = [x for x in m.matched if x[4] > s.low_idf]
        if brand and len(m.entry.words) == 1 and inexact and len(m.matched[0][0]) <= 5:
            return False
        if not high and (m.unmatched or inexact):
            return False
        if brand and m.unmatched and max(len(x[0]) for x in m.matched) < 4:
            return False
        if len(m.matched) == 1 and m.unmatched and max(i for _, i in m.unmatched) > s.high_idf:
            return False
        if len(m.matched) == 1 and len(m.unmatched) >= 2 and inexact:
            return False
        weight = lambda w: 0.1 if w in COMMON_WORDS else 1.0
        rows = [(w, k, q, r, 0.0 if m.unmatched and w in CATEGORY_WORDS else i) for w, k, q, r, i in m.matched]
        gain = sum(r * r * i * i * weight(w) for w, _, _, r, i in rows)
        loss = sum(i * i * weight(w) for w, i in m.unmatched)
        run = self.run_length(rows)
        if run > 1:
            gain *= 1 + s.ngram_bonus * run
        factor = 1.0
        if not inexact and not m.unmatched:
            factor = s.perfect_bonus
            m.exact = query_length == len(m.entry.words)
        elif m.unmatched and all(i < s.low_idf for _, i in m.unmatched):
            loss *= 0.2
        m.score = (gain - loss * (2 if brand else 1)) * factor
        if brand:
            m.score *= 1 - s.brand_penalty * (1 + 0.1 * min(m.positions))
        return True

    def candidates(self, query: list[str], codes: set[str] | None) -> list[Entry]:
        prefixes = {w[:3] for w in query if w != MASK}
        found = {i for p in prefixes for i in self.by_prefix.get(p, ()) if p not in self.entries[i].insufficient}
        if not found:
            first = next((w for w in query if w != MASK), "")
            found = set(self.by_letter.get(first[:1], ()))
        return [self.entries[i] for i in sorted(found) if codes is None or self.entries[i].code in codes]

    def exact_candidates(self, query: list[str]) -> list[Entry]:
        """Those of the candidates that have a word of the query as it is: the only ones that can
        match where errors aren't seen through."""
        prefixes = {w[:3] for w in query if w != MASK}
        found = {i for w in query for i in self.by_word.get(w, ())}
        entries = [self.entries[i] for i in sorted(found)]
        entries = [e for e in entries if any(w[:3] in prefixes and w[:3] not in e.insufficient for w in e.words)]
        return entries or self.candidates(query, None)

    def query(self, sentence: str) -> list[str]:
        """The words of a cleaned sentence, common ones masked so that the others keep their places."""
        return [MASK if w in COMMON_WORDS else w for w in sentence.replace("$", "dollar").split()]

    def cover(self, sentence: str, *, fuzzy: bool = False, single_brand: bool = True, brand: bool = True, codes: set[str] | None = None) -> tuple[list[Match], list[int]]:
        """Matches of a cleaned sentence in the order found, and the positions left over."""
        query = self.query(sentence)
        if not query:
            return [], []
        fits = lambda e: (brand or e.code != "brand") and (codes is None or e.code in codes)
        whole = [self.entries[i] for i in self.by_text.get(" ".join(w for w in query if w != MASK), ()) if fits(self.entries[i])]
        if whole:
            m = self.match(whole[0], query, False)
            m.score, m.exact = 1000.0, True
            return [m], [q for q, w in enumerate(query) if q not in m.positions and w != MASK]
        live = []
        for e in self.candidates(query, codes) if fuzzy else self.exact_candidates(query):
            if fits(e):
                m = self.match(e, query, fuzzy)
                if self.scored(m, len(query)):
                    live.append(m)
        found: list[Match] = []
        while True:
            live = sorted((m for m in live if m.score > 0), key=lambda m: (-m.score, m.entry.entity_id))
            if len(live) > 1 and live[0].entry.code == live[1].entry.code == "brand" and live[1].score / live[0].score > self.settings.swap_ratio and min(live[1].positions) < min(live[0].positions):
                live[0], live[1] = live[1], live[0]
            top = next((m for m in live if m.exact or max(m.positions) - min(m.positions) + 1 == len(m.positions)), None)
            if top is None:
                break
            found.append(top)
            taken = top.positions
            query = [MASK if q in taken else w for q, w in enumerate(query)]
            if top.exact:
                break
            rest = []
            for m in live:
                if m is top or (single_brand and top.entry.code == m.entry.code == "brand") or m.positions <= taken:
                    continue
                if m.positions & taken:
                    m = self.match(m.entry, query, True)
                    if (m.entry.code == "brand" and any(x[3] < 1 for x in m.matched)) or not self.scored(m, len(query)):
                        continue
                rest.append(m)
            live = rest
        return found, [q for q, w in enumerate(query) if w != MASK]


def load(dictionary: Dictionary, settings: Settings | None = None) -> Index:
    """The dictionary as an index in memory; a list above MAX_ENTRIES is refused (see find_attributes)."""
    rows = dictionary.entries.select("entity_id", "code", "base", "words", "max_idf", "insufficient").orderBy("entity_id", "text").take(MAX_ENTRIES + 1)
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"the dictionary has more than {MAX_ENTRIES} entries")
    idf = {r.token: r.idf for r in dictionary.idf.toLocalIterator()}
    return Index([Entry(r.entity_id, r.code, r.base, list(r.words), r.max_idf, frozenset(r.insufficient)) for r in rows], idf, settings or Settings())


def lookup(sentences: DataFrame, text: str, index: Index, **options: object) -> DataFrame:
    """text and its attributes (SCHEMA), one row per attribute of every distinct sentence.

    Equal sentences are looked up once; null and blank ones have no rows. If the text column's name
    is one of SCHEMA, it comes out as <name>_text.
    """
    shared = Shared(sentences.sparkSession, index)

    def each(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for raw, cleaned in zip(pdf["raw"], pdf["cleaned"]):
                for m in shared.value.cover(cleaned, **options)[0]:
                    rows.append((raw, m.entry.code, m.entry.entity_id, m.entry.value, min(m.positions), max(m.positions), m.score))
            yield pd.DataFrame(rows, columns=["raw", "code", "entity_id", "value", "start", "end", "score"])

    return _distinct(sentences, text).mapInPandas(each, f"raw string, {SCHEMA}").withColumnRenamed("raw", f"{text}_text" if text in ("code", "entity_id", "value", "start", "end", "score") else text)


def _distinct(sentences: DataFrame, text: str) -> DataFrame:
    return spread(sentences.select(F.col(text).alias("raw")).where(F.length(F.trim("raw")) > 0).distinct().withColumn("cleaned", cleanup(F.col("raw"))))


def count_candidates(sentences: DataFrame, text: str, index: Index) -> DataFrame:
    """text, n_candidates (entities) of every distinct sentence."""
    shared = Shared(sentences.sparkSession, index)

    def each(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            n = [len({e.entity_id for e in shared.value.candidates(shared.value.query(c), None)}) for c in pdf["cleaned"]]
            yield pd.DataFrame({"raw": pdf["raw"], "n_candidates": n})

    return _distinct(sentences, text).mapInPandas(each, "raw string, n_candidates bigint").withColumnRenamed("raw", text)


ANSWER = "attributes array<struct<code:string,entity_id:bigint,value:string,original:string,start:int,`end`:int,score:double>>, extra_words array<string>"


def answer(index: Index, cleaned: str, codes: set[str] | None, brand: bool, **options: object) -> tuple[list[tuple], list[str]]:
    """Attributes of a cleaned sentence by their places, and the words that none of them takes."""
    words = cleaned.replace("$", "dollar").split()
    found, left = index.cover(cleaned, brand=brand and (codes is None or "brand" in codes), codes=codes, **options)
    taken: dict[str, str] = {}
    rows = []
    for m in sorted(found, key=lambda m: (min(m.positions), -m.score, m.entry.entity_id)):
        # a value that another attribute has taken isn't said twice
        if taken.setdefault(m.entry.value, m.entry.code) == m.entry.code:
            a, b = min(m.positions), max(m.positions)
            rows.append((m.entry.code, m.entry.entity_id, m.entry.value, " ".join(words[a : b + 1]), a, b, m.score))
    common = [q for q, w in enumerate(words) if w in COMMON_WORDS]
    return rows, [words[q] for q in sorted({*left, *common})]


def attribute_lookup(sentences: DataFrame, text: str, index: Index, *, codes: Sequence[str] = (), brand: bool = False, fallback: bool = True, **options: object) -> DataFrame:
    """text, attributes and extra_words (ANSWER) of every distinct sentence.

    codes: only attributes of these; if a sentence has none of them and fallback is set, all that it
    has. brand: whether houses may be found. Attributes stand by their places; of attributes with
    one value and different codes the first counts. Null and blank sentences have no row.
    """
    shared, wanted = Shared(sentences.sparkSession, index), set(codes) or None

    def each(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for raw, cleaned in zip(pdf["raw"], pdf["cleaned"]):
                rows, left = answer(shared.value, cleaned, wanted, brand, **options)
                if not rows and wanted and fallback:
                    rows, left = answer(shared.value, cleaned, None, brand, **options)
                out.append((raw, [dict(zip(("code", "entity_id", "value", "original", "start", "end", "score"), r)) for r in rows], left))
            yield pd.DataFrame(out, columns=["raw", "attributes", "extra_words"])

    return _distinct(sentences, text).mapInPandas(each, f"raw string, {ANSWER}").withColumnRenamed("raw", text)


def disambiguated(df: DataFrame, text: str, names: DataFrame, predicates: DataFrame) -> DataFrame:
    """df with code: the attribute that a text speaks of, null if none.

    names: code, name, ord (names and aliases of attributes with a predicate): the first one that
    occurs in the text counts. Else the first predicate (code, pattern, ord) that matches.
    """
    listed = lambda t, c: t.where(F.col(c).isNotNull()).agg(F.array_sort(F.collect_list(F.struct("ord", F.col(c).alias("p"), "code")))).scalar()
    said = F.coalesce(F.col(text), F.lit(""))
    both = df.withColumn("__names", listed(names, "name")).withColumn("__predicates", listed(predicates, "pattern"))
    named = F.get(F.filter("__names", lambda r: said.contains(r["p"])), F.lit(0))["code"]
    matched = F.get(F.filter("__predicates", lambda r: F.rlike(said, r["p"])), F.lit(0))["code"]
    return both.withColumn("code", F.coalesce(named, matched)).drop("__names", "__predicates")


def lookup_joined(sentences: DataFrame, text: str, dictionary: Dictionary, settings: Settings | None = None, **options: object) -> DataFrame:
    """As lookup, for a dictionary of any size: each sentence meets its candidates in a join.

    Candidates are the entries that share a sufficient prefix with a word of the sentence, those of
    its whole text, and, if there are none, those with a word that begins like its first word. Only
    these, with the frequencies of their words, are sent to the cover of that sentence.
    """
    settings = settings or Settings()
    distinct = _distinct(sentences, text)
    common = [F.lit(w) for w in COMMON_WORDS]
    words = F.filter(F.split(F.replace("cleaned", F.lit("$"), F.lit("dollar")), r"(?U)\s+"), lambda w: (w != "") & ~F.array_contains(F.array(*common), w))
    query = distinct.withColumn("ws", words)
    said = query.select("raw", F.explode(F.array_distinct("ws")).alias("token")).join(dictionary.idf.select("token", "idf"), "token")
    own_idf = said.groupBy("raw").agg(F.map_from_entries(F.collect_list(F.struct("token", "idf"))).alias("query_idf"))
    entries = dictionary.entries.select("entity_id", "code", "base", "text", "words", "max_idf", "insufficient").withColumn("key", F.xxhash64("entity_id", "code", "text")).dropDuplicates(["key"])
    weighed = entries.select("key", F.explode(F.array_distinct("words")).alias("token")).join(dictionary.idf.select("token", "idf"), "token").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("token", "idf"))).alias("entry_idf"))
    entries = cut(entries.join(weighed, "key", "left"))
    starts = lambda ws, n: F.array_distinct(F.transform(ws, lambda w: F.substring(w, 1, n)))
    by_prefix = entries.select("key", F.explode(F.array_except(starts("words", 3), "insufficient")).alias("p"))
    near = query.select("raw", F.explode(starts("ws", 3)).alias("p")).join(by_prefix, "p").select("raw", "key")
    near = cut(near.distinct())
    far = query.join(near, "raw", "left_anti").select("raw", F.substring(F.get("ws", F.lit(0)), 1, 1).alias("c")).join(entries.select("key", F.explode(starts("words", 1)).alias("c")), "c").select("raw", "key")
    whole = query.select("raw", F.array_join("ws", " ").alias("t")).where("t <> ''").join(entries.select("key", F.array_join("words", " ").alias("t")), "t").select("raw", "key")
    pairs = near.unionByName(far).unionByName(whole).distinct()
    candidates = pairs.join(entries, "key").groupBy("raw").agg(F.collect_list(F.struct("entity_id", "code", "base", "text", "words", "max_idf", "insufficient", "entry_idf")).alias("candidates"))
    rows = distinct.join(candidates, "raw").join(own_idf, "raw", "left")

    def each(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for r in pdf.itertuples(index=False):
                idf = dict(r.query_idf or {})
                for c in r.candidates:
                    idf.update(c["entry_idf"] or {})
                index = Index([Entry(c["entity_id"], c["code"], c["base"], list(c["words"]), c["max_idf"], frozenset(c["insufficient"])) for c in sorted(r.candidates, key=lambda c: (c["entity_id"], c["text"]))], idf, settings)
                out += [(r.raw, m.entry.code, m.entry.entity_id, m.entry.value, min(m.positions), max(m.positions), m.score) for m in index.cover(r.cleaned, **options)[0]]
            yield pd.DataFrame(out, columns=["raw", "code", "entity_id", "value", "start", "end", "score"])

    return rows.mapInPandas(each, f"raw string, {SCHEMA}").withColumnRenamed("raw", f"{text}_text" if text in ("code", "entity_id", "value", "start", "end", "score") else text)


def find_attributes(sentences: DataFrame, text: str, dictionary: Dictionary, settings: Settings | None = None, **options: object) -> DataFrame:
    """lookup with the dictionary in memory if it has at most MAX_ENTRIES entries, else lookup_joined: the rows are the same."""
    if dictionary.entries.limit(MAX_ENTRIES + 1).count() <= MAX_ENTRIES:
        return lookup(sentences, text, load(dictionary, settings), **options)
    return lookup_joined(sentences, text, dictionary, settings, **options)
