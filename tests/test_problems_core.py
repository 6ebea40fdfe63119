"""Snapshots, wide tables and units: small cases with known results, and hostile tables."""

from datetime import datetime, timedelta
from decimal import Decimal

import numpy as np

from terroir.operators.snapshots import catalogue_changes
from terroir.operators.units import changepoints, common_units
from terroir.operators.wide import filled_rows, wide_table

T0 = datetime(2022, 5, 1)
UPDATES = "sequence_id bigint, source_id bigint, name string, price string, qoh string, single_product_url string, loaded_at timestamp, state string, __idx int, `__group` int"
RUNS = "sequence_id bigint, source_id bigint, start_time timestamp, end_time timestamp, state string, name string"
VALUES = "sav_id bigint, source_product_id bigint, attribute_id bigint, datatype string, source_id bigint, master_product_id bigint, value string, updated timestamp, code string, is_multivalue boolean, `__cells` string"
ATTRIBUTES = "attribute_id bigint, category_id int, name string, is_multivalue boolean, code string, datatype string, value string"
PRODUCTS = "source_product_id bigint, source_id bigint, bottle_size string, alcohol_pct string, price string, scraped_at timestamp, bin int, factor double, amount string"


def changes(spark, rows, runs):
    u = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], UPDATES)
    p = spark.createDataFrame([(s, g, T0 + timedelta(days=d), None, st, "n") for s, g, d, st in runs], RUNS)
    return sorted(map(tuple, catalogue_changes(u, p).collect()), key=str)


def test_snapshots(spark):
    runs = [(1, 7, 0, "ready"), (2, 7, 1, "error"), (3, 7, 2, "ready"), (9, 7, 3, "ready"), (4, 8, 0, "ready")]
    rows = [
        (1, 7, "A  wine", "$1,000.00", "5", "u1", T0), (3, 7, "a wine ", "1000", "5.0", "u1", T0), (9, 7, "A wine", "1000", None, "u1", T0),
        (1, 7, "B", "2", "", "u2", T0), (2, 7, "B", "3", "1", "u2", T0), (9, 7, "B", "2.00", None, "u2", T0), (9, 7, "B", "2.00", None, "u2", T0),
        (3, 7, None, None, None, None, None), (4, 8, "C", "1", "1", "u1", T0), (77, 7, "D", "1", "1", "u9", T0),
    ]
    assert changes(spark, rows, runs) == sorted([(7, 9, "u1", "changed"), (7, 3, "u2", "removed"), (7, 9, "u2", "added"), (7, 3, None, "added"), (7, 9, None, "removed")], key=str)


def test_snapshots_of_nothing(spark):
    assert changes(spark, [], []) == []
    assert changes(spark, [(1, 1, "a", "1", "1", "u", T0)], []) == []
    assert changes(spark, [], [(1, 1, 0, "ready"), (2, 1, 1, "ready")]) == []


def attribute_tables(spark, rows):
    attrs = [(1, 1, "n", False, "sku", "text"), (2, 1, "n", False, "price", "currency"), (3, 1, "n", False, "qoh", "integer"), (4, 1, "n", False, "body", "float"), (5, 1, "n", False, "organic", "boolean"), (6, 1, "n", False, "added", "datetime"), (7, 1, "n", True, "foods", "text"), (8, 1, "n", None, None, None), (9, 1, "n", False, "sku", "text")]
    return spark.createDataFrame([(*r, "x", True, "y") for r in rows], VALUES), spark.createDataFrame([(*a, "v") for a in attrs], ATTRIBUTES)


def test_wide(spark):
    d = lambda n: T0 + timedelta(days=n)
    cells = [
        (1, 10, 1, "old", 1), (2, 10, 1, " ", 2), (3, 10, 1, "new", 2), (4, 10, 1, "newer", 2), (4, 10, 1, "newer", 2),
        (5, 10, 2, "1.234,50 €", 1), (6, 10, 2, "n/a", 3), (7, 10, 3, "2,019", 1), (8, 10, 3, "7.5", 4), (9, 10, 4, "4,13", 1), (10, 10, 4, "1e1", 2), (11, 10, 5, "Y", 1),
        (12, 10, 6, "2015-02-30", 9), (13, 10, 6, "12 Aug 2015", 1), (14, 10, 7, "Oysters", 1), (15, 10, 7, " oysters ", 2), (16, 10, 7, "cheese", 0), (17, 10, 99, "z", 1), (18, 11, 8, "t", 1),
        (19, 12, 1, None, 1), (20, None, 1, "w", 1), (21, 13, 1, "undated", None), (22, None, None, None, None),
    ]
    values, attrs = attribute_tables(spark, [(i, e, a, "text", 1, 1, v, None if n is None else d(n)) for i, e, a, v, n in cells])
    rows = {r.source_product_id: r for r in wide_table(values, attrs).collect()}
    assert set(rows) == {10, 11, 13}
    r = rows[10]
    assert (r.sku, r.price, r.qoh, r.body, r.organic, r.added, r.foods, r.sku_9) == ("newer", Decimal("1234.500000"), 2019, 10.0, True, datetime(2015, 8, 12), ["Oysters", "cheese"], None)
    assert rows[11].attribute_8 == "t" and rows[13].sku == "undated"
    assert sorted(map(tuple, filled_rows(values, attrs).collect())) == [(10, 1, 4), (10, 2, 5), (10, 3, 7), (10, 4, 10), (10, 5, 11), (10, 6, 13), (10, 7, 14), (10, 7, 16), (11, 8, 18), (13, 1, 21)]


def test_wide_of_nothing(spark):
    values, attrs = attribute_tables(spark, [])
    assert wide_table(values, attrs).collect() == [] and "foods" in wide_table(values, attrs).columns


def units(spark, rows, rates=(("USD", 1.0), ("EUR", 1.123), (None, None))):
    p = spark.createDataFrame([(*r, 1, 2.0, "x") for r in rows], PRODUCTS)
    fx = spark.createDataFrame(list(rates), "currency string, usd_per_unit double")
    return {(r.source_product_id, r.field_name): float(r.amount) for r in common_units(p, fx).collect()}


def test_units(spark):
    rows = [
        (1, 1, "12.7 fl. oz.", "26.8 Proof", "€ 10,00", T0), (2, 1, "0,75 l", "112‰", "$1,283.76 / case of 12", T0), (3, 1, "Magnum", "Alc. 12.5%", "2376 cents", T0),
        (4, 1, "1/2 btl", "14 percent", "$132.72 for 6", None), (5, 1, "unknown", "TBD", "call for price", T0), (6, None, None, None, None, None), (7, 1, "", " ", "", T0), (2, 1, "0,75 l", "112‰", "$1,283.76 / case of 12", T0),
    ]
    got = units(spark, rows)
    assert {k: round(v, 2) for k, v in got.items()} == {(1, "bottle_size"): 375.58, (1, "alcohol_pct"): 1340.0, (1, "price"): 1123.0, (2, "bottle_size"): 750.0, (2, "alcohol_pct"): 1120.0, (2, "price"): 10698.0, (3, "bottle_size"): 1500.0, (3, "alcohol_pct"): 1250.0, (3, "price"): 2376.0, (4, "bottle_size"): 375.0, (4, "alcohol_pct"): 1400.0, (4, "price"): 2212.0}


def test_bare_numbers_follow_their_sources_unit_and_its_changes(spark):
    stated = [(i, 1, f"{ml} ml", "13%", "$15.00", T0 + timedelta(hours=i)) for i, ml in enumerate([750, 750, 375, 1500] * 10)]
    litres = [(100 + i, 2, s, "0.135", None, T0 + timedelta(hours=i)) for i, s in enumerate(["0.75", "0.75", "1.5", "0.375"] * 20)]
    later = [(300 + i, 2, s, "13.5", None, T0 + timedelta(hours=100 + i)) for i, s in enumerate(["75", "75", "150", "37.5"] * 20)]
    got = units(spark, stated + litres + later)
    assert [got[(100 + i, "bottle_size")] for i in range(4)] == [750, 750, 1500, 375] and [got[(300 + i, "bottle_size")] for i in range(80)] == [750, 750, 1500, 375] * 20
    assert {round(got[(x, "alcohol_pct")]) for x in (100, 179, 300, 379)} == {1350}


def test_units_of_nothing(spark):
    assert units(spark, []) == {}
    assert units(spark, [(1, 1, "75", "13", "5", T0)], [])[(1, "price")] == 500


def test_changepoints_equal_brute_force():
    r = np.random.default_rng(3)
    for n in (1, 2, 7, 12):
        x = np.concatenate([r.normal(0, 0.1, n // 2), r.normal(2, 0.1, n - n // 2)])
        ones = np.ones(n)

        def best(t, x=x):
            if t == 0:
                return -0.5, []
            cost = lambda a, b: float(((x[a:b] - x[a:b].mean()) ** 2).sum())
            return min((best(s)[0] + cost(s, t) + 0.5, [*best(s)[1], s]) for s in range(t))

        assert changepoints(ones, x, x * x, 0.5) == best(n)[1]
