"""Scoring and cover of the attribute lookup: hand-computed cases."""

import os

import pytest

from terroir.functions.text import indel_ratio
from terroir.operators.dictionary import build
from terroir.operators.lookup import Entry, Index, Settings, find_attributes, load, lookup
from terroir.session import table

IDF = {"napa": 6.0, "valley": 5.6, "reserve": 6.0, "old": 5.0, "wine": 6.0, "zinfandel": 7.0}


def index(*entries, idf=IDF, **settings):
    return Index([Entry(i, c, t, t.split(), 1.0) for i, (c, t) in enumerate(entries)], idf, Settings(**settings))


def score(entry, query, **options):
    ix = index(entry, **options)
    m = ix.match(ix.entries[0], query.split(), False)
    return round(m.score, 4) if ix.scored(m, len(query.split())) else None


@pytest.mark.parametrize(
    ("entry", "want"),
    [(("region", "napa valley"), 168.4), (("brand", "napa valley"), 112.828), (("region", "napa valley reserve"), 98.72), (("region", "napa valley old"), 129.72), (("brand", "napa valley reserve"), 42.0224)],
)
def test_scores(entry, want):
    assert score(entry, "big napa valley red") == want


def test_a_small_dictionary_rejects_partial_matches():
    assert score(("region", "napa valley"), "napa", idf={"napa": 3.0, "valley": 3.0}) is None


def test_longest_or_last_run():
    ix = index(("region", "a b c d"))
    m = [("a", 0, 0, 1, 1), ("b", 1, 1, 1, 1), ("c", 2, 2, 1, 1), ("d", 3, 9, 1, 1)]
    assert ix.run_length(m) == 3 and index(("region", "a"), last_run_only=True).run_length(m) == 1


def test_cover_takes_disjoint_matches_and_masks_words():
    ix = index(("region", "napa valley"), ("varietals", "zinfandel"), ("brand", "napa"))
    found, left = ix.cover("a zinfandel from napa valley tonight")
    assert [(m.entry.code, sorted(m.positions)) for m in found] == [("region", [3, 4]), ("varietals", [1])] and left == [2, 5]


def test_cover_of_a_whole_sentence_and_options():
    ix = index(("region", "napa valley"), ("brand", "napa valley"))
    assert [m.score for m in ix.cover("napa valley")[0]] == [1000.0]
    assert [m.entry.code for m in ix.cover("napa valley", codes={"brand"})[0]] == ["brand"]
    assert [m.entry.code for m in ix.cover("napa valley", brand=False)[0]] == ["region"]
    assert ix.cover("")[0] == [] and ix.cover("the of")[0] == []


def test_fuzzy():
    ix = index(("region", "zinfandel"))
    assert [m.entry.value for m in ix.cover("old zinfandal here", fuzzy=True)[0]] == ["zinfandel"]
    assert ix.cover("old zinfandal here")[0] == []
    assert [indel_ratio(*x) for x in (("abc", "abc"), ("abcd", "abxd"), ("", ""), ("a", ""))] == [100, 75, 100, 0]


def test_dictionary_and_lookup_in_spark(spark):
    nodes = spark.createDataFrame([(1, 5, 0, "root", "[]"), (2, 5, 1, "Château Warre", '["CW Port"]'), (3, 6, 1, "Napa Valley", "[]"), (4, 6, 1, "The Of", None)], "id bigint, attribute_id bigint, parent_id bigint, name string, aliases string")
    attrs = spark.createDataFrame([(5, "brand"), (6, "region")], "attribute_id bigint, code string")
    ix = load(build(nodes, attrs), Settings(low_idf=0.5))
    rows = [("Château Warre 2016 from Napa Valley",), ("napa valley",), (None,), ("",), ("napa valley",), ("nothing known",)]
    got = lookup(spark.createDataFrame(rows, "t string"), "t", ix).collect()
    assert {(r.t[:6], r.code, r.value) for r in got} == {("Châtea", "brand", "Château Warre"), ("Châtea", "region", "Napa Valley"), ("napa v", "region", "Napa Valley")} and len(got) == 3
    assert lookup(spark.createDataFrame([], "t string"), "t", ix).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_a_dictionary_too_large_for_memory_gives_the_same(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    dictionary = build(table(spark, folder, "domain_taxonomy_nodes"), table(spark, folder, "domain_attributes"))
    names = table(spark, folder, "products").select("name").limit(0).unionByName(table(spark, folder, "products").select("name")).unionByName(spark.createDataFrame([("the of",), ("",), (None,), ("Zq",), ("wine of $5 & more",)], "name string"))
    whole = sorted(map(tuple, find_attributes(names, "name", dictionary, fuzzy=True).collect()))
    monkeypatch.setattr("terroir.operators.lookup.MAX_ENTRIES", 3)
    assert sorted(map(tuple, find_attributes(names, "name", dictionary, fuzzy=True).collect())) == whole and len(whole) > 100
