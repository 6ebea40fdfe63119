"""Listings, survivors, mapping, leaks and cut texts: small cases with known results, and hostile tables."""

import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from terroir.llm.canonical import Reference, edit_distance, grams, key_words, map_values, mapped_fields
from terroir.llm.leakage import ItemBlock, leaked, leaked_items
from terroir.llm.listings import misspelled, product_groups, product_pairs, similar, stars
from terroir.llm.survivors import survivors, true_places
from terroir.llm.truncation import bare_end, find_limits, fit_censored, judged, source_limits, truncated, truncation_by_source
from terroir.llm.words import words

T0 = datetime(2022, 5, 1)
NODES = "id bigint, attribute_id bigint, parent_id bigint, name string, aliases string, ancestor_node_path string, value string"
PRODUCTS = "source_product_id bigint, source_id bigint, name string, brand string, vintage string, bottle_size string, varietals string, region string, price string, alcohol_pct string, scraped_at timestamp, loaded_at timestamp, house bigint, node_id bigint, value string"
RECORDS = "record_id bigint, master_product_id bigint, source_id bigint, name string, brand string, price string, msrp string, region string, image string, description string, scraped_at timestamp, visible int, depth int, `__s` int"
DOCS = "doc_id bigint, text string, source string, unit string, low int, z double, t string, d string"
ITEMS = "item_id bigint, text string, doc_id bigint"


@pytest.fixture(scope="module")
def nodes(spark):
    houses = ["Château Vodamault", "Domaine Negirôme", "Cantina Nostirone", "Bodegas Mitemuelo", "Viña Mitemuelo", "Maison Facherange", "Finca Talanera"]
    houses += [f"{k} {n}" for k in ("Château", "Domaine", "Cantina", "Bodegas", "Viña", "Maison", "Finca") for n in (f"{k[:2]}zubo{j}k" for j in range(3))]
    rows = [(5, 5, 0, "all brand", "[]", "[0]")] + [(100 + i, 5, 5, n, '["TFW Dasamworth"]' if i == 1 else "[]", "[0, 5]") for i, n in enumerate(houses)]
    rows += [(6, 6, 0, "all region", None, "[0]"), (60, 6, 6, "Varardo", "[]", "[0, 6]"), (61, 6, 60, "Costa Relford", "[]", "[0, 6, 60]"), (62, 6, 61, "North Stuwiltal", "not json", "[0, 6, 60, 61]"), (63, 6, 61, "South Stuwiltal", "[]", "[0, 6, 60, 61]"), (64, 6, 6, "Mulange", "[]", "[0, 6]")]
    rows += [(200 + i, 6, 60, n, "[]", "[0, 6, 60]") for i, n in enumerate(f"{k} {x}" for k, x in zip(["Costa", "North", "South"] * 3, ["Bolono", "Xabago", "Yelor", "Zuvem", "Trelag", "Vimoro", "Kadefi", "Lomupa", "Sugeno"]))]
    rows += [(7, 7, 0, "all varietals", "[]", "[0]")] + [(70 + i, 7, 7, n, '["Denello"]' if i == 0 else "[]", "[0, 7]") for i, n in enumerate(["Bravenolo Gris", "Zemina", "Madolina Noir", "Cegonetta", "Crimac"])]
    return spark.createDataFrame([(*r, "x") for r in rows] + [(None, None, None, None, None, None, None)], NODES)


@pytest.fixture(scope="module")
def rates(spark):
    return spark.createDataFrame([("USD", 1.0)], "currency string, usd_per_unit double")


def listings(spark, rows):
    """rows: id, name, brand, vintage, size, varietals[, region]"""
    return spark.createDataFrame([(r[0], 1, *r[1:6], r[6] if len(r) > 6 else None, None, None, T0, T0, 9, 9, "v") for r in rows], PRODUCTS)


def test_mapping(spark, nodes):
    rows = [
        (1, "n", "CHATEAU VODAMAULT", None, None, '["Zemina", "Denello", "nonsense"]', "Varardo > Costa Relford > North Stuwiltal"), (2, "n", "Ch. Vodamualt", None, None, "60% Crimac (40%), Mdaolina Noir", "from Stuwiltal"),
        (3, "n", "Negirôme, Domaine", None, None, "Field Blend", "Relford D.O."), (4, "n", "Mitemuelo", None, None, "", "Mulange / Varardo"), (5, "n", "Finca Mitemuelo", None, None, None, "???"), (6, "n", "TFW Dasamworth", None, None, "Zemina; Zemina*", "Norht Stuwiltal"),
        (7, "n", "  ", None, None, None, None), (8, "n", "CantinaNostirone®", None, None, "zzz, yyy", "x" * 5000), (1, "n", "CHATEAU VODAMAULT", None, None, '["Zemina", "Denello", "nonsense"]', "Varardo > Costa Relford > North Stuwiltal"),
    ]
    out = mapped_fields(listings(spark, rows), nodes).collect()
    got = {}
    for r in out:
        got.setdefault((r.source_product_id, r.field_name), []).append(r.node_id)
    got = {k: sorted(v) for k, v in got.items()}
    assert {k[0]: v for k, v in got.items() if k[1] == "brand"} == {1: [100], 2: [100], 3: [101], 4: [-1], 5: [-1], 6: [101], 8: [102]}
    assert {k[0]: v for k, v in got.items() if k[1] == "varietals"} == {1: [-1, 70, 71], 2: [72, 74], 3: [-1], 6: [71], 8: [-1]}
    assert {k[0]: v for k, v in got.items() if k[1] == "region"} == {1: [62], 2: [-1], 3: [61], 4: [60], 5: [-1], 6: [62], 8: [-1]} or got[(4, "region")] == [64]


def test_mapping_of_nothing(spark, nodes):
    assert mapped_fields(listings(spark, []), nodes).count() == 0
    one = listings(spark, [(1, "n", "Château Vodamault", None, None, None)])
    assert [r.node_id for r in mapped_fields(one, nodes.limit(0)).collect()] == [-1]


def test_mapping_in_blocks_equals_mapping_at_once(spark, nodes, monkeypatch):
    values = spark.createDataFrame([(v,) for v in ["Vodamault", "Finca Talanrea", "Mitemuelo", "Viña Mitemuelo", "none"]], "value string")
    whole = sorted(map(tuple, map_values(values, nodes, "brand").collect()))
    monkeypatch.setattr("terroir.llm.canonical.BLOCK_ENTRIES", 5)
    monkeypatch.setattr("terroir.llm.canonical.KEPT_BLOCKS", 1)
    assert sorted(map(tuple, map_values(values, nodes, "brand").collect())) == whole
    assert dict(whole) == {"Vodamault": 100, "Finca Talanrea": 106, "Mitemuelo": -1, "Viña Mitemuelo": 104, "none": -1}


def test_all_candidates_are_checked():
    names = [f"Domaine Vodamau{c}" for c in "abcdefghijklmnopqrstuvwxyz"] + ["Domaine Vodamault"]
    frequency = Counter(g for n in names for w in key_words(n) for g in set(grams(w)))
    entries = Reference([(i, 0, n) for i, n in enumerate(names)], frequency, len(names), {"domaine"})
    assert [k for k, _ in entries.candidates(key_words("Domaine Vodamau"))] == list(range(len(names)))


def test_edit_distance():
    assert [edit_distance(*x, 2) for x in (("abc", "abc"), ("abc", "acb"), ("abc", "ab"), ("abc", "xyz"), ("", "a"))] == [0, 1, 1, 3, 1]


SAME = [
    [(1, "Château Vodamault Sitetrozo Old Vines Bravenolo Gris 2017", "Château Vodamault", "2017", "750 ml", "Bravenolo Gris"), (2, "Sitetrozo OV - Vodamault '17 Free Shipping", "other", None, "0.75 L", "Denello"), (3, "2017 CH. VODAMAULT LOT SITETROZO DENELLO OLD VINES (750ML) 96 points", None, None, None, None), (4, "Château Vodamault Sitetroz Old Vines 2017", None, None, None, None)],
    [(10, "Château Vodamault Sitetrozo Old Vines Bravenolo Gris 2018", None, None, None, None)],
    [(11, "Château Vodamault Sitetrozo Old Vines Bravenolo Gris 2017 Magnum", None, None, None, None)],
    [(12, "Château Vodamault Sitetrozo Reserve Bravenolo Gris 2017", None, None, None, None)],
    [(13, "Viña Mitemuelo Sitetrozo Old Vines Bravenolo Gris 2017", None, None, None, None), (15, "Sitetrozo Old Vines Bravenolo Gris 2017", "Vina Mitemuelo", None, None, None)],
    [(14, "Bodegas Mitemuelo Sitetrozo Old Vines Bravenolo Gris 2017", None, None, None, None)],
    [(16, "Zemina", "Finca Talanera", None, None, None), (17, "Finca Talanera Zemina N.V. standard bottle", "", "", "75 cl", "")],
    [(18, None, None, None, None, None)],
    [(19, "Zemina", None, None, None, None)],
]


def test_listings(spark, nodes, rates):
    rows = [r for g in SAME for r in g]
    groups = product_groups(listings(spark, rows + rows[:3] + [(None, "Zemina", "Finca Talanera", None, None, None)]), nodes, rates)
    got = sorted(tuple(r) for r in product_pairs(groups).collect())
    assert got == sorted((a[0], b[0]) for g in SAME for a in g for b in g if a[0] < b[0])
    assert groups.count() == len(rows)


def test_listings_of_nothing(spark, nodes, rates):
    assert product_pairs(product_groups(listings(spark, []), nodes, rates)).count() == 0


def test_errors_in_numbered_and_short_cuvees(spark, nodes, rates):
    name = "Château Vodamault {} Bravenolo Gris 2017"
    cuvees = ["Barrel 40", "Barrel 40", "Barrl 40", "Baorel 40", "Barrel 41", "Lot 7", "Lot 7", "Loot 7", "Lot 8", "Une", "Cuvée Une", "Cvuée Uae", "Ostu", "Osti"]
    rows = [(i, name.format(c), None, None, None, None) for i, c in enumerate(cuvees)]
    got = sorted(tuple(r) for r in product_pairs(product_groups(listings(spark, rows), nodes, rates)).collect())
    assert got == sorted((a, b) for g in ([0, 1, 2, 3], [5, 6, 7], [9, 10, 11]) for a in g for b in g if a < b)


def test_orders_selling_words_and_two_errors_of_cuvees(spark, nodes, rates):
    name = "{} {} Bravenolo Gris 2017"
    houses = ["Château Vodamault", "Domaine Negirôme", "Cantina Nostirone", "Maison Facherange", "Finca Talanera"]
    cuvees = ["Owl Harrow", "Harrow Owl", "Owl Harrow Stupendous Catch 12", "Sitetrozo", "Sitetrozo", "Stietrozzo", "Sitemalo"]
    rows = [(10 * h + i, name.format(house, c), None, None, None, None) for h, house in enumerate(houses) for i, c in enumerate(cuvees)]
    # a word that stands beside a cuvée at one house only tells it apart
    rows += [(90, name.format(houses[0], "Owl Harrow Upper"), None, None, None, None)]
    got = sorted(tuple(r) for r in product_pairs(product_groups(listings(spark, rows), nodes, rates)).collect())
    assert got == sorted((10 * h + a, 10 * h + b) for h in range(5) for g in ([0, 1, 2], [3, 4, 5]) for a in g for b in g if a < b)


def test_a_designation_beside_the_house(spark, nodes, rates):
    entries = spark.createDataFrame([(900, 5, 5, "Pakorstead Family Wines", "[]", "[0, 5]", "x")] + [(901 + i, 5, 5, f"Tozubo{i}k Family Wines", "[]", "[0, 5]", "x") for i in range(9)], NODES)
    rows = [(1, "Cuvée Sitetrozo Old Vines Pakorstead Family Wines 2013", None, None, None, None), (2, "Pakorstead Family Wines Sitetrozo OV 2013", None, None, None, None)]
    assert [tuple(r) for r in product_pairs(product_groups(listings(spark, rows), nodes.unionByName(entries), rates)).collect()] == [(1, 2)]


def pairs_of(spark, nodes, rates, rows):
    return sorted(tuple(r) for r in product_pairs(product_groups(listings(spark, rows), nodes, rates)).collect())


def test_houses_that_differ_in_kind_only(spark, nodes, rates):
    names = ["Pakorstead & Söhne", "Kellerei Pakorstead", "Ligorcombe Vineyards", "Ligorcombe Winery", *(f.format(f"Xabo{i}m") for i in range(4) for f in ("{} & Söhne", "Kellerei {}", "{} Vineyards", "{} Winery"))]
    entries = spark.createDataFrame([(900 + i, 5, 5, n, "[]", "[0, 5]", "x") for i, n in enumerate(names)], NODES)
    rows = [(1, "Pakorstead u. Soehne Sitetrozo 2013", None, None, None, None), (2, "Sitetrozo 2013", "Pakorstead & Söhne", None, None, None), (3, "Kellerei Pakorstead Sitetrozo 2013", None, None, None, None)]
    rows += [(4, "Ligorcombe Vineyard Sitetrozo 2013", None, None, None, None), (5, "Sitetrozo 2013", "Ligorcombe Vineyards", None, None, None), (6, "Ligorcombe Winery Old Vines Sitetrozo 2013", None, None, None, None), (7, "Sitetrozo Old Vines Ligorcombe Winery", "TBD", "2013", None, None)]
    assert pairs_of(spark, nodes.unionByName(entries), rates, rows) == [(1, 2), (4, 5), (6, 7)]


def test_a_house_that_may_be_one_of_several(spark, nodes, rates):
    # only one Mitemuelo has the first cuvée, both have the second, none has the third
    rows = [(1, "Viña Mitemuelo Sitetrozo Zemina 2017", None, None, None, None), (2, "Mitemuelo Sitetrozo Zemina 2017", None, None, None, None), (3, "Mitemuelo Sitetozo 2017", None, None, None, None)]
    rows += [(4 + i, f"{h} Zenomalo 2016", None, None, None, None) for i, h in enumerate(["Viña Mitemuelo", "Bodegas Mitemuelo", "Mitemuelo", "Mitemuelo"])]
    rows += [(8, "Mitemuelo Owl Harrow 2016", None, None, None, None), (9, "Harrow Owl Mitemuelo 2016", None, None, None, None), (10, "Owl Harrow 2016", None, None, None, None), (11, "Owl Harrow 2016", None, None, None, None)]
    assert pairs_of(spark, nodes, rates, rows) == [(1, 2), (1, 3), (2, 3), (6, 7), (8, 9)]


def test_a_spelling_near_to_all_leads(spark, nodes, rates):
    rows = [(10 * k + i, f"Château Vodamault {c} Zemina {2000 + k}", None, None, None, None) for k, g in enumerate([("Founder", "Funder", "Founedr"), ("Grand Mur", "Grnd Mur", "Grand Mtr")]) for i, c in enumerate(g)]
    assert pairs_of(spark, nodes, rates, rows) == [(10 * k + a, 10 * k + b) for k in range(2) for a, b in ((0, 1), (0, 2), (1, 2))]


def test_copies_of_the_table_keep_its_pairs(spark, nodes, rates):
    one = [(i, f"Château Vodamault {c} Zemina 2017", None, None, None, None) for i, c in enumerate(["Nomalema", "Nmalmea", "Sitetrozo", "Stietrozzo"])]
    copies = [(100 * k + r[0], *r[1:]) for k in range(3) for r in one]
    assert pairs_of(spark, nodes, rates, copies) == sorted((a[0], b[0]) for a in copies for b in copies if a[0] < b[0] and a[0] % 100 // 2 == b[0] % 100 // 2)


def test_misspelled_cuvees_meet_without_a_triple_in_common(spark):
    r = random.Random(5)

    def altered(c):
        k = r.randrange(len(c))
        return r.choice([c[:k] + c[k + 1 :], c[:k] + r.choice("xyz") + c[k:], c[:k] + r.choice("xyz") + c[k + 1 :], c[: k - 1] + c[k : k + 1] + c[k - 1 : k] + c[k + 1 :] if k else c])

    base = ["nomalema", "desasiga", "alto sole", "tripigvi", "nimozetre", "trovoseba", "une", "os", "a b", "block 12", "ab ab cd", "\U00010400\U00010401lema", ""]
    cuvees = [altered(altered(c)) if len(c) > 3 and r.random() < 0.5 else altered(c) if c else c for c in base * 14]
    rows = [(f"s{i:03}", 1, "2017", 750, "", " ".join(sorted(c.split())), [1], 1, r.choice([1, 1, 3])) for i, c in enumerate(cuvees)]
    df = spark.createDataFrame(rows, "sig string, house bigint, vintage string, size bigint, designation string, cuvee string, grapes array<bigint>, n bigint, often bigint")
    a, b = (df.select(*[F.col(c).alias(f"{x}_{c}") for c in df.columns]) for x in "ab")
    fits = misspelled(F.col("a_cuvee"), F.col("b_cuvee"), F.col("a_often"), F.col("b_often"))
    want = {(x.a_sig, x.b_sig) for x in a.join(b, F.col("a_sig") < F.col("b_sig")).where(fits).collect()}
    assert {(x.a, x.b) for x in similar(df).collect()} == want and len(want) > 300


SOURCES = "source_id bigint, source_code string, source_name string, trust_rank int, text string"


def test_survivors(spark, nodes):
    sources = spark.createDataFrame([(1, "acme", "Acme Wines", 5, ""), (2, "bolt", "Bolt Cellar", 1, ""), (3, None, None, None, None)], SOURCES)
    d = lambda n: T0 + timedelta(days=n)
    shop = "Please note that Acme ships on Mondays only and keeps your goods for two weeks."
    rec = [
        (1, 1, 1, "Vodamault Zemina", None, "10.00", "12.00", "Varardo", "https://a.example/b/1.jpg", "A long and fine description of this very wine.", d(1)),
        (2, 1, 2, "Vodamault Zemina", None, "10.00", "$13.00", "North Stuwiltal", "https://a.example/default_bottle.png", "<p>Short one here.</p>", d(2)),
        (3, 1, 2, "Vodamault Zemina", None, "10.00", "9999.99", "???", "//b.example/2_front.jpeg", shop.replace("Acme", "Bolt"), d(3)),
        (4, 2, 1, "Solo", None, "1", "2", "Varardo", "https://a.example/b/4.jpg", "Alone it stands here.", d(1)),
        (5, 3, 1, "Zemina Reserve 2017", "Vodamault", None, "-1", "Region", "noimage", "Vodamault Zemina Reserve 2017.", None),
        (6, 3, 3, None, None, None, None, None, None, None, None),
        (7, 4, 1, "n", None, "5", "500", "Varardo", "https://c.example/", shop, d(1)), (8, 4, None, "n", None, None, "7", "Varardo", "https://c.example/p/8.webp", "", d(1)),
        (9, 5, 1, "n", None, None, None, None, None, shop, d(1)), (10, None, 1, "n", None, None, None, None, None, shop, d(1)), (None, 5, 1, "n", None, None, None, None, None, shop, d(1)),
    ]
    df = spark.createDataFrame([(*r, 1, 1, 1) for r in rec + rec[:2]], RECORDS)
    got = {(r.master_product_id, r.field_name): r.record_id for r in survivors(df, sources, nodes).collect()}
    assert got == {(1, "description"): 1, (1, "image"): 3, (1, "msrp"): 2, (1, "region"): 2, (4, "image"): 8, (4, "msrp"): 8, (4, "region"): 8}
    assert survivors(df.limit(0), sources, nodes).count() == 0


def test_outvoted_places_are_not_true(spark):
    claims = [(1, s, n, p) for s, n, p in [(1, 62, [6, 60, 61, 62]), (2, 61, [6, 60, 61]), (3, 64, [6, 64])]] + [(2, 3, 64, [6, 64]), (2, 1, 60, [6, 60]), (2, 2, 60, [6, 60])]
    df = spark.createDataFrame(claims, "group bigint, source bigint, node bigint, path array<bigint>")
    assert sorted(map(tuple, true_places(df).collect())) == [(1, 61), (1, 62), (2, 60)]


def test_an_outvoted_region_does_not_survive(spark, nodes):
    sources = spark.createDataFrame([(k, f"s{k}", f"Shop {k}", k, "") for k in (1, 2, 3)], SOURCES)
    d = lambda n: T0 + timedelta(days=n)
    rec = [(10 * m + s, m, s, "n", None, None, None, r, None, None, d(s)) for m in range(1, 6) for s, r in ((1, "Varardo"), (2, "Costa Relford"), (3, "Mulange"))]
    # the third shop's place is stated last and the first one's is deeper in group 9, but two against one
    rec += [(91, 9, 3, "n", None, None, None, "North Stuwiltal", None, None, d(9)), (92, 9, 1, "n", None, None, None, "Mulange", None, None, d(1)), (93, 9, 2, "n", None, None, None, "Mulange", None, None, d(2))]
    df = spark.createDataFrame([(*r, 1, 1, 1) for r in rec], RECORDS)
    got = {r.master_product_id: r.record_id for r in survivors(df, sources, nodes).where("field_name = 'region'").collect()}
    assert got == {**{m: 10 * m + 2 for m in range(1, 6)}, 9: 93}


def test_boilerplate_of_one_shop(spark, nodes):
    sources = spark.createDataFrame([(1, "a", "Alpha", 1, ""), (2, "b", "Beta", 2, "")], SOURCES)
    shop = "Every order above fifty leaves our cellar on the next working day."
    rec = [(k, k // 2, 1 if k < 40 else 2, "n", None, None, None, None, None, shop if k < 6 else f"A wine of its own, number {k}.", T0) for k in range(4000)]
    df = spark.createDataFrame([(*r, 1, 1, 1) for r in rec], RECORDS)
    got = {r.record_id for r in survivors(df, sources, nodes).where("field_name = 'description'").collect()}
    assert not got & set(range(6)) and len(got) == 1997  # 3 of 2,000 groups, but 3 of the shop's 20


VOCABULARY = [f"w{i}" for i in range(300)]


def brute(docs, items):
    out = set()
    for d, t in docs:
        for i, x in items:
            a, b = words(t), words(x)
            if any(sum(p != q for p, q in zip(a[j : j + 12], b[k : k + 12])) <= 1 for j in range(len(a) - 11) for k in range(len(b) - 11)):
                out.add((d, i))
    return out


def test_leaks_equal_brute_force(spark):
    r = random.Random(1)
    items = [(i, " ".join(r.choices(VOCABULARY, k=r.choice([8, 12, 15, 30])))) for i in range(20)] + [(20, None), (21, ""), (22, "")]
    docs = []
    for d in range(120):
        ws = r.choices(VOCABULARY, k=40)
        if d % 2:
            it = r.choice(items[:20])[1].split()
            k = r.choice([9, 11, 12, 13, len(it)])
            part = it[:k]
            for _ in range(r.choice([0, 1, 1, 2])):
                part[r.randrange(len(part))] = "altered"
            ws[10:10] = part
        docs.append((d, " ".join(w.upper() if r.random() < 0.3 else w for w in ws).replace(" w1", ", <b>w1", 1)))
    docs += [(500, None), (501, ""), (502, "  "), (503, " ".join(VOCABULARY * 200) + " " + items[3][1] + " " + "x " * 5000), (504, docs[1][1]), (1, docs[1][1])]
    d = spark.createDataFrame([(i, t, None, None, None, None, "t", "d") for i, t in docs], DOCS)
    x = spark.createDataFrame([(i, t, 7) for i, t in items], ITEMS)
    pairs = leaked(d, x)
    got = set(map(tuple, pairs.collect()))
    assert got == brute([(i, t or "") for i, t in docs], [(i, t or "") for i, t in items])
    assert leaked_items(pairs, x).count() == 23
    assert leaked(d.limit(0), x).count() == 0 and leaked(d, x.limit(0)).count() == 0


def test_leaks_in_blocks_equal_leaks_at_once(spark, monkeypatch):
    r = random.Random(2)
    items = [(i, " ".join(r.choices(VOCABULARY, k=40))) for i in range(6)]
    docs = [(i, f"before {t} after", None, None, None, None, "", "") for i, t in items]
    d, x = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(*i, 0) for i in items], ITEMS)
    whole = set(map(tuple, leaked(d, x).collect()))
    monkeypatch.setattr("terroir.llm.leakage.BLOCK_WINDOWS", 20)
    monkeypatch.setattr("terroir.llm.leakage.KEPT_BLOCKS", 1)
    assert set(map(tuple, leaked(d, x).collect())) == whole == {(i, i) for i in range(6)}


def test_altered_windows_are_found_with_the_target_recall():
    r = random.Random(3)
    block = ItemBlock([(i, r.choices(VOCABULARY, k=60)) for i in range(50)], 0.999, 5)
    found = {True: 0, False: 0}
    for k in range(1200):
        w, known = r.choice(block.windows), k % 2 == 0
        flat = block.flat[w : w + 12].copy()
        flat[k // 2 % 12] = (flat[k // 2 % 12] + r.randrange(1, len(block.vocabulary))) % len(block.vocabulary) if known else len(block.vocabulary)
        found[known] += any(len(m) for m, _ in block.matches(flat, np.zeros(1, dtype=np.int64)))
    assert min(found.values()) >= 595


def test_a_recall_out_of_reach_is_an_error(monkeypatch):
    monkeypatch.setattr("terroir.llm.leakage.MAX_WALKS", 1)
    with pytest.raises(ValueError, match="recall"):
        ItemBlock([(i, random.Random(i).choices(VOCABULARY, k=60)) for i in range(50)], 0.999, 5)


def test_marks():
    assert bare_end("A wine of… Read more") == ("A wine of", True) and bare_end("a [...]") == ("a", True) and bare_end("Read more") == ("Read more", False)


def test_censored_fit_recovers_the_distribution():
    x = np.random.default_rng(2).normal(5, 0.7, 20_000)
    at = 5.5
    mu, sd = fit_censored(x[x < at], np.ones((x < at).sum()), at, float((x >= at).sum()))
    assert abs(mu - 5) < 0.03 and abs(sd - 0.7) < 0.03


def corpus(n=1500):
    r = random.Random(9)
    said = ["The palate rises on {} and {}, then turns bright.", "Aged {} months in barrels, it smells of {}.", "Our panel found {}, {} and a trace of smoke.", "Serve it with {} or {} before the frost."]
    notes = ["lime zest", "cedar shavings", "wet slate", "blood orange", "pine resin", "dried thyme", "candied lemon", "forest moss", "12", "31"]
    docs, cut = [], set()
    for i in range(n):
        source = r.choice(["free", "limit", "free2"])
        t = " ".join(r.choice(said).format(r.choice(notes), r.choice(notes)) for _ in range(r.randint(1, 12)))
        if r.random() < 0.3:
            t += r.choice(["\n#wine #cellar", "\n92 points", " - the team"])
        if r.random() < 0.1:
            t = r.choice(["loved it", "Grape: Zemina\nSize: 750 ml"])
        if source == "limit" and len(t) > 255:
            t = t[:255].rstrip()
            if not t.endswith((".", "cellar", "points", "team")):
                cut.add(i)
        elif r.random() < 0.05 and ". " in t:
            at = r.randint(10, t.rindex(". ") - 1) if t.rindex(". ") > 12 else 11
            t = t[:at].rstrip()
            if not t.endswith("."):
                cut.add(i)
        docs.append((i, t, source))
    return docs, cut


def test_cut_texts(spark):
    docs, cut = corpus()
    docs += [(9000, None, "free"), (9001, "", "free"), (9002, "  ", None), (9003, "Whole sentence here. " * 3000, None), docs[0]]
    d = spark.createDataFrame([(i, t, s, "u", 1, 0.0, "t", "d") for i, t, s in docs], DOCS)
    got = {r.doc_id for r in truncated(d).collect()}
    assert len(got & cut) >= 0.9 * len(cut) and len(got - cut) <= 0.06 * len(got)
    by = {r.source: r for r in truncation_by_source(d).collect()}
    assert [tuple(x) for x in by["limit"].limits] == [(255, "chars")] and by["free"].limits is None
    assert truncated(d.limit(0)).count() == 0


def lengths(*parts):
    import pandas as pd

    lens, n = np.unique(np.concatenate(parts), return_counts=True)
    return pd.DataFrame({"source": "s", "unit": "chars", "len": lens, "n": n})


def drawn(mean, sd, n, seed=1):
    return np.round(np.exp(np.random.default_rng(seed).normal(mean, sd, n))).clip(5)


def highs(*parts):
    return sorted(source_limits(lengths(*parts))["high"].unique().tolist())


def test_limits_need_a_spike():
    assert all(highs(drawn(5, 0.8, 3000, seed)) == [] for seed in range(10))
    assert highs(np.minimum(drawn(5, 0.8, 3000), 300)) == [300]


def test_limits_below_the_longest_text_and_several_of_one_source():
    texts = drawn(8.6, 1.0, 2000)
    assert highs(np.minimum(texts, 10_000), [10_500]) == [10_000] == highs(np.minimum(texts, 10_000), [10_500, 20_000, 90_000])
    assert highs(np.minimum(drawn(10.8, 1.0, 2000), 100_000)) == [100_000]
    two = drawn(6, 1.0, 3000)
    assert highs(np.minimum(two[:1500], 300), np.minimum(two[1500:], 1000)) == [300, 1000]
    assert highs(np.minimum(two[:1000], 300), np.minimum(two[1000:2000], 1000), two[2000:]) == [300, 1000]
    # cut at a whole word: the lengths are spread below the limit
    assert highs(np.where(two > 500, 500 - np.random.default_rng(3).integers(0, 15, len(two)), two)) == [500]


def test_a_text_at_a_limit_above_65536_is_cut(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    docs = [(i, (f"{word()} {word()}. " * 9000)[: min(100_000, int(np.exp(r.gauss(11.3, 0.8))))], "s") for i in range(60)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    rows, limits = judged(d)
    assert [x.high for x in limits.select("high").distinct().collect()] == [100_000]
    at = {i for i, t, _ in docs if len(t) == 100_000}
    assert {x.doc_id for x in rows.where("p_limit > 0.5").collect()} == at and len(at) > 15


def test_an_ambiguous_ending_is_decided_by_the_limit(spark):
    r = random.Random(6)
    words = ["plum", "stone", "cedar", "slate", "lime", "smoke", "moss", "thyme", "peach", "amber", "resin", "clove"]
    docs = []
    for i in range(1600):
        remark = " ".join(r.choice(words) for _ in range(r.randint(1, 16)))  # whole remarks without a stop
        whole = i % 2 == 0
        docs.append((i, remark if whole else remark[:40], "free" if whole else "limit"))
    at = [(i, t) for i, t, s in docs if s == "limit" and len(t) == 40 and t.split(" ")[-1] in words]
    free = {i for i, _, s in docs if s == "free"}  # such remarks where no limit explains their ends
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    got = {x.doc_id for x in truncated(d).collect()}
    assert len(at) > 20 and len(got & {i for i, _ in at}) >= 0.9 * len(at) and len(got & free) <= 0.1 * len(free)


def test_copies_make_no_limit(spark):
    r = random.Random(8)
    docs = [(i, "x" * max(5, int(np.exp(r.gauss(5, 0.8)))), "s") for i in range(600)] + [(1000 + i, "loved this one", "s") for i in range(600)]
    assert find_limits(spark.createDataFrame(docs, "doc_id bigint, text string, source string")).count() == 0


def test_stars_take_only_neighbours_of_their_centre(spark):
    nodes = spark.createDataFrame([(s, w) for s, w in zip("abcde", (5, 4, 3, 2, 1))], "sig string, w int")
    links = spark.createDataFrame([(x, y) for p in ("ab", "bc", "ce") for x, y in (p, p[::-1])], "a string, b string")
    assert {r.sig: r.center for r in stars(nodes, links).collect()} == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "c"}
    assert {r.sig: r.center for r in stars(nodes, links.limit(0)).collect()} == {s: s for s in "abcde"}


def test_similar_signatures_equal_brute_force(spark):
    r = random.Random(12)
    base = ["sitetrozo", "owl harrow", "barrel 40", "une", "zenomalo", ""]
    rows = []
    for i in range(140):
        c = r.choice(base)
        if c and r.random() < 0.4:
            k = r.randrange(len(c))
            c = (c[:k] + r.choice("abcdefg") + c[k + 1 :]) if c[k].isalpha() else c
        rows.append((f"s{i:03}", 1, "2017", 750, "", " ".join(sorted(c.split())), r.sample([1, 2, 3], r.randint(0, 2)), r.randint(1, 9), r.randint(1, 9)))
    df = spark.createDataFrame(rows, "sig string, house bigint, vintage string, size bigint, designation string, cuvee string, grapes array<bigint>, n bigint, often bigint")
    got = {(x.a, x.b) for x in similar(df).collect()}
    # the same without the join: every pair of the cell by the exact rules
    a, b = (df.select(*[F.col(c).alias(f"{x}_{c}") for c in df.columns]) for x in "ab")
    fits = misspelled(F.col("a_cuvee"), F.col("b_cuvee"), F.col("a_often"), F.col("b_often"))
    grapes = F.arrays_overlap("a_grapes", "b_grapes") | (F.size("a_grapes") == 0) | (F.size("b_grapes") == 0)
    want = {(x.a_sig, x.b_sig) for x in a.join(b, F.col("a_sig") < F.col("b_sig")).where(fits & grapes).collect()}
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 500
