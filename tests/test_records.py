"""Record operators, text and field functions, readers, pages, streams, jobs: small cases."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from terroir.functions import fields as X
from terroir.functions import text as T
from terroir.functions.numbers import plain_digits, stated_number
from terroir.operators import records as R
from terroir.operators import summary as S
from terroir.plans import jobs
from terroir.sources import tables as S2
from terroir.sources.html import Selector, parse_pages, read_page
from terroir.streaming.feed import merge_latest, read_feed, run_once, run_to_folder, windowed_counts


def values(spark, expression, rows):
    df = spark.createDataFrame([(r,) for r in rows], "c string")
    return [r.v for r in df.select(expression(F.col("c")).alias("v")).collect()]


def test_numbers(spark):
    rows = ["1,283.76", "1.283,76", "22,44", "1,002", "0,375", "46.9700", "$5", "USD 5.09", "-3", "1e3", "N/A", "", None, "5 6"]
    got = values(spark, stated_number, rows)
    assert [None if x is None else float(x) for x in got] == [1283.76, 1283.76, 22.44, 1002, 0.375, 46.97, 5, 5.09, -3, 1000, None, None, None, None]
    assert values(spark, lambda c: plain_digits(c, False), ["1,234", "1,234.5", "1,234,567"]) == ["1.234", "1234.5", "1234567"]


def test_fields(spark):
    assert values(spark, X.listing_name, ["A (Elsewhere $52) B", None]) == ["A B", None]
    assert values(spark, X.last_year, ["1999 or 2016", "NV"]) == ["2016", None]
    assert values(spark, X.size_ladder, ["x half-bottle", "500 ML", "1 Liter", "x"]) == [375, 500, 1000, 750]
    assert values(spark, X.size_cell, ["1.5L", "750mL", "x"]) == [1500, 750, None]
    assert values(spark, X.score_number, ["92-94", "90+", "n/a"]) == [94, 90, None]
    assert values(spark, X.unquoted, ['"a"', "a"]) == ["a", "a"] and values(spark, X.wine_kind, ["ROSÉ Wine", "x"]) == ["Rose", None]
    assert values(spark, lambda c: X.image_address(c, "https://h"), ["//a/b", "http://a", "/p.png"]) == ["https://a/b", "http://a", "https://h/p.png"]
    assert values(spark, X.first_integer, ["12 left", "x"]) == [12, None] and values(spark, X.sku_code, ["SKU #77", "Sku: 8"]) == ["77", "8"]


def test_text(spark):
    assert values(spark, T.cleanup, ["Joe's J.J. 10-20 years, 1,234 wines?", "...", None]) == ["joes jj 10 to 20 years 1234 wines", "...", None]
    assert values(spark, T.space_before_period, ["5. Red 5.2"]) == ["5 . Red 5.2"]
    s = values(spark, T.without_common_words, ["the $5 & port"])[0]
    assert (s.text, s.removed) == ("dollar5 port", [0, 2])
    assert values(spark, T.sentences, ["Mr. X came. He J. R. left? Yes."]) == [["Mr. X came.", "He J. R. left?", "Yes."]]
    assert values(spark, T.without_links, ['a <a href="x">b</a>  c']) == ["a  c"]
    assert values(spark, T.without_accents, ["Ch&acirc;teau", "CafÃ©", "Straße", None]) == ["Chateau", "Cafe", "Strasse", None]
    assert values(spark, lambda c: T.first_line_matches(c, ".*points"), ["a\n9 points", "9 points\nb"]) == [False, True]
    assert values(spark, lambda c: T.prefixes(F.split(c, " ")), ["abcd ef"]) == [["abc", "ef"]]


def test_records(spark):
    df = spark.createDataFrame([(1, " a ", "5"), (1, " a ", "5"), (2, "", "x"), (3, None, None)], "k int, t string, n string")
    rows = R.shred(df, ["k"], [("t", "text", F.col("t")), ("n", "integer", F.col("n")), ("p", "currency", F.col("n"))]).collect()
    assert sorted((r.k, r.code, r.value_text, r.value_integer, r.value_cents) for r in rows) == [(1, "n", None, 5, None), (1, "p", None, None, 500), (1, "t", "a", None, None)]
    judged = R.with_reason(df, [("no text", F.col("t") == ""), ("two", F.col("k") == 2)]).collect()
    assert [r.drop_reason for r in judged] == [None, None, "no text", None]
    known = spark.createDataFrame([("a", 5), ("b", 9)], "key string, id bigint")
    new = spark.createDataFrame([("a",), ("c",), ("c",), ("d",), (None,)], "key string")
    got = {r.key: r.id for r in R.upsert(known, new, ["key"], "id").collect()}
    assert got["a"] == 5 and {got["c"], got["d"]} == {10, 11} and len(got) == 3
    assert R.upsert(known.limit(0), new, ["key"], "id").count() == 3
    runs = spark.createDataFrame([(1, *p) for p in [(0, 0), (1, 1), (2, 5), (3, 6), (4, 7), (5, 7), (6, None), (7, 1)]] + [(2, 0, 3)], "k int, a int, b int")
    assert sorted((r.k, r.longest, r.last) for r in R.run_lengths(runs, ["k"], "a", "b").collect()) == [(1, 3, 1), (2, 1, 1)]
    marked = R.mark_deleted(known, spark.createDataFrame([(5,), (5,), (None,)], "id bigint"), "id")
    assert {r.key: r.deleted for r in marked.collect()} == {"a": True, "b": False}
    vec = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (1, []), (2, None)], "k int, v array<double>")
    assert [(r.k, list(r.vector)) for r in R.mean_vector(vec, ["k"], "v").collect()] == [(1, [2.0, 3.0])]
    isl = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 3, "c")], "k int, pos int, w string")
    assert sorted((r.first_pos, r["items"]) for r in R.islands(isl, ["k"], "pos", "w").collect()) == [(0, "a b"), (3, "c")]


def test_combine_and_rating(spark):
    a = spark.createDataFrame([(1, "price", "5", 0, 1), (1, "price", "7", 3, 4), (1, "price", "5", 6, 7), (1, "brand", "x", 2, 2)], "k int, code string, value string, start int, end int")
    got = {r.code: (r["values"], r.start, r.end, r.relation) for r in R.combine_same_code(a, ["k"]).collect()}
    assert got == {"price": (["5", "7"], 0, 7, "$between"), "brand": (["x"], 2, 2, "$eq")}
    s = spark.createDataFrame([(1, 90.0, 1.0), (1, 80.0, None), (1, 0.0, 5.0), (2, None, 1.0)], "k int, s double, m double")
    assert [(r.k, r.rating, r.n_scores) for r in R.aggregate_score(s, ["k"], "s", "m").collect()] == [(1, 85.5, 2)]


def test_summary(spark):
    words = lambda n, w="w": " ".join([w] * n)
    rows = [("g", 1, [(words(30), 1.0), (words(25), 1.0), (words(10, "v"), 0.0)]), ("h", 1, [(words(50), 1.0)]), ("h", 2, []), ("i", 1, [("Fine. 92 points here. Good", 1.0)])]
    df = spark.createDataFrame(rows, "key string, ord int, sentences array<struct<text:string,score:double>>")
    got = {r.key: (r.summary, r.score) for r in S.summarize(df, "key").collect()}
    assert got == {"g": (words(30) + " " + words(10, "v"), 1.0), "h": ("", 0.0), "i": ("Fine. Good", 1.0)}


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,_reviews\n1,"A, ""B""","[{""x"": 1}]"\n2,"two\nlines",\n')
    rows = S2.read_csv_feed(spark, str(tmp_path / "a.csv"), ["id", "name", "_reviews"]).collect()
    assert [tuple(r) for r in rows] == [("1", 'A, "B"', '[{"x": 1}]'), ("2", "two\nlines", None)]
    (tmp_path / "a.jsonl").write_text('{"a": 1}\nbroken\n')
    assert [(r.a, r._corrupt_record) for r in S2.read_json_lines(spark, str(tmp_path / "a.jsonl"), "a int").collect()] == [(1, None), (None, "broken")]
    feed = spark.createDataFrame([("Red x $5.50 sku=9",), ("Red sku=9 $5.50",), ("Gin $5.50 sku=9",), ("Red $1.00 $2.00 sku=1",)], "line string")
    assert [(r.price, r.sku) for r in S2.parse_text_feed(feed, "line", ["Red"]).collect()] == [(5.5, "9")]
    n = spark.createDataFrame([(0,), (25,), (26,)], "n int")
    assert sorted((r.n, r.page, r.offset) for r in S2.pages(n, "n", 25).collect()) == [(25, 1, 0), (26, 1, 0), (26, 2, 25)]
    S2.append_fixed(n, str(tmp_path / "f"), [("n", "bigint"), ("x", "string")])
    assert spark.read.parquet(str(tmp_path / "f")).columns == ["n", "x"]


def test_pages(spark):
    html = "<h1 class='t'>A &amp; <b>B</h1><p>one<p>two<br>three</p><script>var x='<p>';</script><a href='/u'>go</a><img src='i.png'>"
    found, links, text = read_page(html, [Selector("t", "h1", "t"), Selector("i", "img", attribute="src"), Selector("p", "p")])
    assert found == {"t": ["A & B"], "i": ["i.png"], "p": ["one", "two three"]} and links == [("/u", "go")] and "var" not in text
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "k bigint, h string")
    assert sorted((r.k, len(r.links)) for r in parse_pages(df, "k", "h", [Selector("t", "h1")]).collect()) == [(1, 1), (3, 0)]


def test_streams(spark, tmp_path):
    t = datetime(2022, 1, 1)
    df = spark.createDataFrame([(i % 3, i, t + timedelta(minutes=20 * i)) for i in range(9)], "k int, v int, at timestamp")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    counts = run_to_folder(windowed_counts(read_feed(spark, str(tmp_path / "in"), 1), "at", ["k"], "1 hour", "10 days"), str(tmp_path / "c1"))
    assert sorted(r.n for r in counts.collect()) == [1] * 9
    run_once(read_feed(spark, str(tmp_path / "in"), 1), merge_latest(spark, str(tmp_path / "state"), ["k"], ["at"]), str(tmp_path / "c2"), "append")
    last = max(int(p.name) for p in (tmp_path / "state").iterdir())
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "state" / str(last))).collect()) == [(0, 6), (1, 7), (2, 8)]


def test_jobs(spark, tmp_path):
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    assert jobs.run(spark, 7, lambda: spark.range(5), out, log).rows == 5
    with pytest.raises(ZeroDivisionError):
        jobs.run(spark, 7, lambda: 1 / 0, out, log)
    assert sorted(r.state for r in spark.read.parquet(log).collect()) == ["error", "ready"]
    checks = {r.check_type: r.status for r in jobs.validate(spark.range(3), {"small": "id < 9", "never": "id > 1"}).collect()}
    assert checks == {"small": True, "never": False}
    with pytest.raises(ValueError):
        jobs.reader("unknown")
