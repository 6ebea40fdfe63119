"""Extraction reads every language, and reviews, names and descriptions."""

import json

import pytest

from terroir.operators.dictionary import build
from terroir.operators import extraction as E
from terroir.operators.lookup import Settings, attribute_lookup, disambiguated, load
from terroir.queries.extraction import extract_from_sentences
from terroir.queries.relational import tfidf_top_terms


@pytest.fixture(scope="module")
def lists(spark):
    nodes = spark.createDataFrame([(1, 5, 0, "root", "[]"), (2, 5, 1, "Château Warre", "[]"), (3, 6, 1, "Napa Valley", "[]"), (4, 7, 1, "Zinfandel", "[]")], "id bigint, attribute_id bigint, parent_id bigint, name string, aliases string")
    return nodes, spark.createDataFrame([(5, "brand"), (6, "region"), (7, "varietals")], "attribute_id bigint, code string")


def test_texts_of_all_languages(spark, lists, tmp_path):
    docs = [(1, "A wine from Napa Valley.", "en"), (2, "Un vin de Napa Valley.", "fr"), (3, "Zinfandel vom Hang.", "de"), (4, "Napa Valley again.", None)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    for name, t in zip(("domain_taxonomy_nodes", "domain_attributes"), lists):
        t.write.parquet(f"{tmp_path}/{name}.parquet")
    assert {(r.doc_id, r.value) for r in extract_from_sentences(spark, str(tmp_path)).collect()} == {(1, "Napa Valley"), (2, "Napa Valley"), (3, "Zinfandel"), (4, "Napa Valley")}
    assert {r.doc_id for r in tfidf_top_terms(spark, str(tmp_path)).collect()} == {1, 2, 3, 4}


RULES = [
    E.Rule(21, "rating", "float"), E.Rule(13, "short_desc", "text"), E.Rule(30, "barrel_months", "float", (r"(\d+) months in barrels",)), E.Rule(31, "wild_yeast", "boolean", ("wild yeast",)),
    E.Rule(5, "brand", "text", dictionary=True, sentences=False, names=True), E.Rule(6, "region", "text", dictionary=True), E.Rule(7, "varietals", "text", dictionary=True, names=True),
]


def test_products(spark, lists):
    review = lambda *c: json.dumps([{"reviewer_name": "a", "score_str": "90", "content": x} for x in c])
    about = "Grown in Napa Valley. It saw 12 months in barrels."
    rows = [(1, "Château Warre 2016", review("Zinfandel at its best. Wild it is. I thought of wild yeast."), about), (2, "Zinfandel", review('""'), about), (3, None, "no json", None), (4, "", None, " "), (1, "Château Warre 2016", review("Zinfandel at its best. Wild it is. I thought of wild yeast."), about)]
    df = spark.createDataFrame([(*r, 9, "x") for r in rows], "source_product_id bigint, name string, reviews string, description string, score int, read string").select("source_product_id", "name", "reviews", "description")
    index = load(build(*lists), Settings(low_idf=0.5))
    reviewers = spark.createDataFrame([("a", 0.5)], "name string, modifier double")
    got = E.extract(df, RULES, index=index, stop=["of"], reviewers=reviewers).collect()
    place = [(k, o, "region", 3, None, None, None) for k, o in ((1, "description"), (2, "description"), (2, "review"))]
    oak = [(k, o, "barrel_months", None, 12.0, None, None) for k, o in ((1, "description"), (2, "description"), (2, "review"))]
    own = [(1, "name", "brand", 2, None, None, None), (1, "review", "varietals", 4, None, None, None), (1, "review", "wild_yeast", None, None, True, None), (2, "name", "varietals", 4, None, None, None)]
    whole = [(k, "product", "rating", None, 90.5, None, None) for k in (1, 2)] + [(1, "product", "short_desc", None, None, None, "Zinfandel at its best. Wild it is. I thought of wild yeast."), (2, "product", "short_desc", None, None, None, "Grown in Napa Valley. It saw 12 months in barrels.")]
    assert sorted([(r.source_product_id, r.origin, r.code, r.value_node_id, r.value_float, r.value_boolean, r.value_text) for r in got], key=str) == sorted(place + oak + own + whole, key=str)
    assert E.extract(df.limit(0), RULES, index=index).count() == 0


def test_rules_are_checked():
    with pytest.raises(ValueError, match="short_desc"):
        E.plan([E.Rule(21, "rating", "float")])
    with pytest.raises(ValueError, match="text"):
        E.Rule(1, "x", "text", ("a",))


def test_lookup_with_codes_and_words_left_over(spark, lists):
    index = load(build(*lists), Settings(low_idf=0.5))
    df = spark.createDataFrame([("the Zinfandel of Napa Valley",), ("Château Warre Zinfandel",), (None,), ("",), ("nothing",)], "value string")
    got = {r.value: ([(a.code, a.original, a.start) for a in r.attributes], list(r.extra_words)) for r in attribute_lookup(df, "value", index, codes=["region"]).collect()}
    assert got == {"the Zinfandel of Napa Valley": ([("region", "napa valley", 3)], ["the", "zinfandel", "of"]), "Château Warre Zinfandel": ([("varietals", "zinfandel", 2)], ["château", "warre"]), "nothing": ([], ["nothing"])}
    with_brand = attribute_lookup(df, "value", index, brand=True).where("value like 'Ch%'").first()
    assert [a.code for a in with_brand.attributes] == ["brand", "varietals"] and with_brand.extra_words == []
    names = spark.createDataFrame([("region", "place", 1), ("foods", "dish", 2)], "code string, name string, ord int")
    predicates = spark.createDataFrame([("foods", "goes? with", 1), ("region", "from", 2)], "code string, pattern string, ord int")
    said = spark.createDataFrame([("a dish from here",), ("it goes with fish from Rome",), ("wine from Rome",), ("wine",), (None,)], "t string")
    assert [r.code for r in disambiguated(said, "t", names, predicates).collect()] == ["foods", "foods", "region", None, None]
