"""Full and incremental runs, list pages and files."""

import pytest

from terroir.plans import sync as S
from terroir.sources.html import Selector, parse_list_pages, routed

ATTRIBUTES = "attribute_id bigint, code string, datatype string, is_multivalue boolean, has_taxonomy boolean"
NODES = "id bigint, attribute_id bigint, parent_id bigint, name string"
RECORDS = "source_product_id bigint, source_id bigint, single_product_url string, name string, price string, qoh string, image string, sku string, brand string, foods string, reviews string, loaded_at int"


@pytest.fixture(scope="module")
def tables(spark):
    attributes = spark.createDataFrame([(2, "price", "currency", False, False), (5, "brand", "text", False, True), (30, "foods", "text", True, False)], ATTRIBUTES)
    nodes = spark.createDataFrame([(1, 5, 0, "all"), (11, 5, 1, "Warre")], NODES)
    rows = [(k, 1, f"u{k}", f"wine {k}", "$1,00%d.00" % k, "5", "i.jpg", "s", "WARRE", '["fish", "fish", " "]', None, 1) for k in range(1, 5)]
    rows += [(5, 2, "u5", "other", "12", "1", "i.jpg", "s", "nobody", "", "no json", 1), (6, 1, "u6", "3 Pack", "12", "1", "i.jpg", "s", None, None, None, 1), (7, 1, "u7", None, "0.5", "1", "i.jpg", "s", None, None, None, 1), (None, 1, "u", "n", "12", "1", "i", "s", None, None, None, 1)]
    rows += [(1, 1, "u1", "wine 1", "20.00", "5", "i.jpg", "s", "WARRE", '["fish"]', '[{"reviewer_name": "", "score_str": "92-94", "content": "good"}]', 2)]
    return S.full(spark.createDataFrame(rows, RECORDS), attributes, nodes)


def test_full(tables):
    assert sorted((r.source_product_id, r.price_cents, r.qoh) for r in tables["offers"].collect()) == [(1, 2000, 5), (2, 100200, 5), (3, 100300, 5), (4, 100400, 5), (5, 1200, 1)]
    one = [(r.attribute_id, r.datatype, r.value_node_id, r.value_text, r.value_cents) for r in tables["attributes"].where("source_product_id = 1").collect()]
    assert sorted(one) == [(2, "currency", None, None, 2000), (5, "node_id", 11, None, None), (30, "text", None, "fish", None)]
    assert [r.value_node_id for r in tables["attributes"].where("source_product_id = 5 and attribute_id = 5").collect()] == [-1]
    assert [(r.reviewer, r.score) for r in tables["reviews"].collect()] == [("Unknown", 94)]


def test_incremental_and_stored(spark, tables, tmp_path):
    S.store(tables, str(tmp_path))
    known = S.stored(spark, str(tmp_path))
    updates = spark.createDataFrame([(1, "u1", 2000, 5), (1, "u2", 99, None), (1, "u9", 1, 1)], "source_id bigint, single_product_url string, price_cents bigint, qoh int")
    judged = {r.single_product_url: (r.action, r.price_cents, r.qoh) for r in S.compare(known["offers"], updates).collect()}
    assert judged == {"u1": ("keep", 2000, 5), "u2": ("update", 99, 5), "u3": ("delete", 100300, 5), "u4": ("delete", 100400, 5), "u5": ("keep", 1200, 1), "u9": ("new", 1, 1)}
    after = S.incremental(known, updates)
    assert sorted((r.source_product_id, r.price_cents) for r in after["offers"].collect()) == [(1, 2000), (2, 99), (5, 1200)]
    assert sorted(r.source_product_id for r in after["products"].where("deleted").collect()) == [3, 4]
    assert {r.source_product_id for r in after["attributes"].collect()} == {1, 2, 5} and after["reviews"].count() == 1
    S.store(after, str(tmp_path / "next"))
    assert {t: df.count() for t, df in S.stored(spark, str(tmp_path / "next")).items()} == {t: df.count() for t, df in after.items()}
    assert {r.source_id for r in S.cleaned(known, 1)["offers"].collect()} == {2}
    assert S.compare(known["offers"], updates.limit(0)).where("action <> 'keep'").count() == 0


def test_list_pages(spark):
    html = "<ul><li class='item x'><a href='/1'>One &amp; a</a><span class=p>1.00</span><li class=item><a href='/2'>Two <b>bold</b><script>x</script></a><ul><li>inner</ul><li class=item><a>Three sold out</a><span class=p>3.00</span></ul><li>no item"
    pages = spark.createDataFrame([(1, html, "x"), (2, None, "x"), (3, "", "x")], "page int, html string, name string")
    rows = parse_list_pages(pages, "page", "html", Selector("item", "li", "item"), [Selector("name", "a"), Selector("price", "span", "p"), Selector("url", "a", attribute="href")])
    assert [(r.page, r.pos, r.name, r.price, r.url) for r in rows.orderBy("pos").collect()] == [(1, 0, "One & a", "1.00", "/1"), (1, 1, "Two bold", None, "/2"), (1, 2, "Three sold out", "3.00", None)]
    assert sorted(r.url for r in routed(rows, True).collect()) == ["/1", "/2"] and [r.url for r in routed(rows, False, ["two"]).collect()] == ["/1"]


def test_nothing_and_nulls(spark, tables, tmp_path):
    attributes = spark.createDataFrame([(2, "price", "currency", False, False), (None, "x", "text", False, True), (5, None, None, None, None)], ATTRIBUTES)
    nodes = spark.createDataFrame([(None, None, None, None)], NODES)
    empty = S.full(spark.createDataFrame([], RECORDS), attributes, nodes)
    assert {t: df.count() for t, df in empty.items()} == dict.fromkeys(S.TABLES, 0)
    row = (1, None, None, None, "2.00", "1", "i", "s", None, None, "[broken", 1)
    one = S.full(spark.createDataFrame([row, row, (None,) * 12], RECORDS), attributes, nodes)
    assert {t: df.count() for t, df in one.items()} == {"products": 1, "offers": 1, "attributes": 1, "reviews": 0}
    updates = spark.createDataFrame([], "source_id bigint, single_product_url string, price_cents bigint, qoh int")
    # nothing ran: everything stays, an offer without source and address too
    assert {t: df.count() for t, df in S.incremental(one, updates).items()} == {"products": 1, "offers": 1, "attributes": 1, "reviews": 0}
    assert S.stored(spark, str(tmp_path / "none")) == {}
