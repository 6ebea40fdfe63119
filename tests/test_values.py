"""Small operators on nulls, empty tables and clashing names."""

import numpy as np
from pyspark.sql import functions as F

from terroir.functions import fields as X
from terroir.operators import records as R
from terroir.operators.lookup import disambiguated
from terroir.operators.units import reversed_units
from terroir.queries.text import fuzzy_entries



def test_cells(spark):
    df = spark.createDataFrame([(["> 5", "7", "x", None], "Sold out today", '"quoted"', " oak "), ([], "in stock", None, ""), (None, None, "plain", None)], "cells array<string>, stock string, about string, oak string")
    got = df.select(X.stock_sum(F.col("cells")).alias("s"), X.stock_by_words(F.col("stock")).alias("w"), X.with_features(F.col("about"), Oak=F.col("oak")).alias("f"), X.equal_or_same_text(F.col("stock"), F.col("about")).alias("e"), X.words_between(F.split("stock", " "), F.lit(1), F.lit(3)).alias("b")).collect()
    assert [tuple(r) for r in got] == [(12, 0, "quoted Oak: oak", False, "out today"), (0, 100, "", False, "stock"), (None, None, "plain", False, None)]


def test_vectors(spark):
    values = spark.createDataFrame([(1, 2, "9.50"), (1, 4, "3"), (2, 2, None), (3, 4, "7")], "k int, attribute_id bigint, value string")
    vectors = R.assemble_vectors(values, ["k"])
    news = spark.createDataFrame([(1, 4, "8"), (1, 5, "new"), (9, 4, "1"), (3, 4, None)], "k int, attribute_id bigint, value string")
    got = {(r.k, r.attribute_id): r.value for r in R.vector_values(R.update_vectors(vectors, news, ["k"]), ["k"]).collect()}
    assert got == {(1, 2): "9.50", (1, 4): "8", (3, 4): "7"} or got == {(1, 2): "9.50", (1, 4): "8", (3, 4): None}
    assert R.vector_values(R.update_vectors(vectors.limit(0), news, ["k"]), ["k"]).count() == 0
    assert R.vector_values(R.update_vectors(vectors, news.limit(0), ["k"]), ["k"]).count() == 3


def test_overrides_without_rules_and_with_nulls(spark):
    df = spark.createDataFrame([("old vines", "a"), (None, "b")], "name string, purpose string")
    rules = spark.createDataFrame([("purpose", "old", "aged", 1), ("purpose", None, "x", 2), (None, "old", "y", 3)], "attr_code string, pattern string, attr_value string, ord int")
    assert sorted(r.purpose for r in R.override(df, "purpose", rules, "purpose", "name").collect()) == ["aged", "b"]
    assert sorted(r.purpose for r in R.override(df, "purpose", rules.limit(0), "purpose", "name").collect()) == ["a", "b"]


def test_fuzzy_entries_and_disambiguation_of_nothing(spark):
    entries = spark.createDataFrame([(1, "finca"), (2, "finka"), (3, "fincas"), (4, "vinca"), (None, None)], "id bigint, name string")
    held = spark.createDataFrame([(1,), (2,), (4,), (None,)], "value_node_id bigint")
    assert sorted((r.id, r.distance) for r in fuzzy_entries(entries, "finca", held).collect()) == [(1, 0), (2, 1)]
    df = spark.createDataFrame([("x",), (None,)], "t string")
    names = spark.createDataFrame([], "code string, name string, ord int")
    predicates = spark.createDataFrame([], "code string, pattern string, ord int")
    assert [r.code for r in disambiguated(df, "t", names, predicates).collect()] == [None, None]


def test_unit_changes_are_shifts_between_known_factors():
    one, two = np.log10(750.0), np.log10(75.0)
    ref, options = np.log10(750.0), (1.0, 10.0, 1000.0)
    assert reversed_units(np.array([one, two, one]), np.array([9.0, 9.0, 9.0]), options, ref) == [1.0, 10.0, 1.0]
    # a few small bottles are no change of unit, though ten times their size is nearer to the usual level
    assert reversed_units(np.array([one, np.log10(187.0), one]), np.array([9.0, 3.0, 9.0]), options, ref) == [1.0, 1.0, 1.0]
    assert reversed_units(np.array([one]), np.array([1.0]), options, float("nan")) == [1.0]
