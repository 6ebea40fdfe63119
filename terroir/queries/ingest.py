"""Queries of the readers: feeds, pages, JSON, paging, streams."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terroir.session import checkpoint_dir, table
from terroir.sources import tables as T
from terroir.sources.html import Selector, parse_list_pages, parse_pages
from terroir.streaming.feed import read_feed, run_to_folder, windowed_counts

ORACLE: dict[str, str] = {}
QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("SELECT DISTINCT source_product_id, replace(trim(name), chr(10), ' ') AS name, trim(brand) AS brand FROM products WHERE trim(brand) <> ''")
def csv_feed_parse(spark: SparkSession, d: str) -> DataFrame:
    """Rows written as quoted lines and read back by schema."""
    p = table(spark, d, "products").where("trim(brand) <> ''").select("source_product_id", F.replace(F.trim("name"), F.lit("\n"), F.lit(" ")).alias("name"), F.trim("brand").alias("brand")).distinct()
    line = F.to_csv(F.struct("source_product_id", "name", "brand"), {"quote": '"', "escape": '"', "quoteAll": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    return p.select(line.alias("line")).select(T.parse_csv_line(F.col("line"), "source_product_id bigint, name string, brand string").alias("r")).select("r.*")


@query("SELECT DISTINCT source_product_id, single_product_url AS url, TRY_CAST(msrp AS DOUBLE) AS price, source_product_id::VARCHAR AS sku FROM products WHERE regexp_matches(msrp, '^[0-9]+\\.[0-9]+$') AND wine_type IN ('Red', 'White')")
def text_feed_parse(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a text feed of the wanted kinds, with exactly one price and one sku."""
    p = table(spark, d, "products").where("wine_type is not null").select("source_product_id", F.col("single_product_url").alias("url"), F.concat_ws("\t", F.concat(F.lit("<"), "wine_type", F.lit(">")), F.when(F.col("msrp").rlike(r"^[0-9]+\.[0-9]+$"), F.concat(F.lit("$"), "msrp")), F.concat(F.lit("sku="), "source_product_id")).alias("line")).distinct()
    return T.parse_text_feed(p, "line", ["<Red>", "<White>"]).select("source_product_id", "url", "price", "sku")


@query("SELECT source_id, page, (page - 1) * 25 AS start FROM (SELECT source_id, unnest(generate_series(1, CAST(ceil(n / 25.0) AS BIGINT))) AS page FROM (SELECT source_id, count(DISTINCT source_product_id) AS n FROM products GROUP BY 1))")
def list_pages(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "products").groupBy("source_id").agg(F.countDistinct("source_product_id").alias("n"))
    return T.pages(n, "n", 25).select("source_id", F.col("page").cast("long").alias("page"), F.col("offset").cast("long").alias("start"))


@query("SELECT user_id, event_id, CAST(props->>'$.k' AS INTEGER) AS k, CAST(NULL AS VARCHAR) AS missing FROM events")
def json_functions(spark: SparkSession, d: str) -> DataFrame:
    """JSON read by schema; what isn't there is null."""
    j = F.from_json("props", "struct<k:int,missing:string>")
    return table(spark, d, "events").select("user_id", "event_id", j["k"].alias("k"), j["missing"].alias("missing"))


@query(
    """SELECT vec_id, len(embedding) AS n, CAST(ceil(len(embedding) / 10.0) AS BIGINT) AS n_chunks, round(list_sum(embedding[1:10]::DOUBLE[]), 4) AS first_sum, len(list_distinct(list_transform(embedding, lambda x: x > 0))) AS n_signs FROM embeddings"""
)
def array_functions(spark: SparkSession, d: str) -> DataFrame:
    """Arrays in slices of ten, flattened again, summed and made distinct."""
    e = F.col("embedding")
    chunks = F.transform(F.sequence(F.lit(0), F.size(e) - 1, F.lit(10)), lambda i: F.slice(e, i + 1, F.least(F.lit(10), F.size(e) - i)))
    total = F.aggregate(chunks[0], F.lit(0.0), lambda s, x: s + x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.size(F.flatten(chunks)).cast("long").alias("n"), F.size(chunks).cast("long").alias("n_chunks"), F.round(total, 4).alias("first_sum"), F.size(F.array_distinct(F.transform(e, lambda x: x > 0))).cast("long").alias("n_signs"))


@query("SELECT DISTINCT body, nullif(TRY_CAST(body AS DOUBLE), 0) AS number, TRY_CAST(body AS DOUBLE) IS NOT NULL AS is_number, CAST(round_even(TRY_CAST(body AS DOUBLE) * 10, 0) AS BIGINT) AS tenths FROM products")
def numeric_values(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("body").try_cast("double")
    return table(spark, d, "products").select("body", F.nullif(n, F.lit(0.0)).alias("number"), n.isNotNull().alias("is_number"), F.bround(n * 10, 0).cast("long").alias("tenths")).distinct()


@query("SELECT id, attribute_id, parent_id, name, row_number() OVER (PARTITION BY attribute_id ORDER BY parent_id, id) AS ord FROM domain_taxonomy_nodes")
def taxonomy_load(spark: SparkSession, d: str) -> DataFrame:
    """All nodes, numbered in load order (parents first) within their attribute."""
    nodes = table(spark, d, "domain_taxonomy_nodes").select("id", "attribute_id", "parent_id", "name")
    return nodes.withColumn("ord", F.row_number().over(W.partitionBy("attribute_id").orderBy("parent_id", "id")).cast("long"))


@query()
def html_text(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs, links and visible text of documents with markup."""
    pages = table(spark, d, "documents").where("text like '%<%'")
    out = parse_pages(pages, "doc_id", "text", [Selector("paragraphs", "p"), Selector("link", "a", attribute="href"), Selector("bold", "b")])
    return out.select("doc_id", F.size(F.col("fields")["paragraphs"]).alias("n_paragraphs"), F.size("links").alias("n_links"), "text")


SPACED = r"trim(regexp_replace({}, '[\s\pZ\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}]+', ' ', 'g'))"


def _escaped(c: str) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


@query(f"SELECT DISTINCT source_product_id, {SPACED.format('name')} AS name, '$' || coalesce({SPACED.format('msrp')}, '-') AS price, single_product_url AS url FROM products WHERE name IS NOT NULL")
def html_fields(spark: SparkSession, d: str) -> DataFrame:
    """Product pages read by selectors (no table holds pages, so they are made of listings)."""
    p = table(spark, d, "products").where("name is not null").select("source_product_id", "name", "msrp", "single_product_url").distinct()
    html = F.concat(F.lit("<html><body><h1 class='title'>"), _escaped("name"), F.lit("</h1><b>List <span class='price was'>$"), F.coalesce("msrp", F.lit("-")), F.lit("</span><script>var a = '<h1>';</script><a href='"), "single_product_url", F.lit("'>more</a><br></body>"))
    out = parse_pages(p.select("source_product_id", html.alias("html")), "source_product_id", "html", [Selector("name", "h1", "title"), Selector("price", "span", "price")])
    return out.select("source_product_id", F.col("fields")["name"][0].alias("name"), F.col("fields")["price"][0].alias("price"), F.col("links")[0]["href"].alias("url"))


@query(f"SELECT source_id, row_number() OVER (PARTITION BY source_id, g ORDER BY source_product_id) - 1 AS pos, {SPACED.format('name')} AS name, {SPACED.format('msrp')} AS price, single_product_url AS url FROM (SELECT DISTINCT source_id, source_product_id, source_product_id // 50 AS g, name, msrp, single_product_url FROM products WHERE name IS NOT NULL) QUALIFY count(*) OVER (PARTITION BY source_product_id) = 1")
def list_page_items(spark: SparkSession, d: str) -> DataFrame:
    """List pages of up to 50 products each, one row an item; prices that an item lacks are null."""
    p = table(spark, d, "products").where("name is not null").select("source_id", "source_product_id", "name", "msrp", "single_product_url").distinct()
    p = p.withColumn("k", F.count(F.lit(1)).over(W.partitionBy("source_product_id"))).where("k = 1")
    item = F.concat(F.lit("<li class='row item'><a class=title href='"), "single_product_url", F.lit("'>"), _escaped("name"), F.lit("</a>"), F.coalesce(F.concat(F.lit("<span class='price'>"), "msrp", F.lit("</span>")), F.lit("")))
    page = p.groupBy("source_id", F.floor(F.col("source_product_id") / 50).alias("g")).agg(F.array_sort(F.collect_list(F.struct("source_product_id", item.alias("h")))).alias("x"))
    page = page.select(F.struct("source_id", "g").alias("page"), F.concat(F.lit("<ul>"), F.array_join(F.transform("x", lambda x: x["h"]), "\n"), F.lit("</ul><li class=note>end")).alias("html"))
    items = parse_list_pages(page, "page", "html", Selector("item", "li", "item"), [Selector("name", "a", "title"), Selector("price", "span", "price"), Selector("url", "a", "title", "href")])
    return items.select("page.source_id", F.col("pos").cast("long").alias("pos"), "name", "price", "url")


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, where the readers' files are written."""
    return posixpath.join(checkpoint_dir(spark), f"{name}_{uuid.uuid4().hex}")


FEED = ["row_idx", "name", "price", "brand", "description", "_reviews"]


@query("SELECT DISTINCT source_product_id::VARCHAR AS row_idx, nullif(name, '') AS name, nullif(price, '') AS price, nullif(brand, '') AS brand, nullif(description, '') AS description, nullif(reviews, '') AS _reviews FROM products")
def read_csv_files(spark: SparkSession, d: str) -> DataFrame:
    """A CSV feed in files, with quoted line ends and JSON cells, read by the feed reader; empty cells are null."""
    p = table(spark, d, "products").select(F.col("source_product_id").cast("string").alias("row_idx"), "name", "price", "brand", "description", F.col("reviews").alias("_reviews")).distinct()
    path = _folder(spark, "feed")
    p.write.option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("nullValue", "").option("emptyValue", "").csv(path)
    return T.read_csv_feed(spark, path, FEED)


@query("SELECT DISTINCT source_product_id, name, price, TRY_CAST(json_array_length(CASE WHEN starts_with(trim(reviews), '[') THEN reviews ELSE '[]' END) AS INTEGER) AS n_reviews FROM products WHERE source_product_id IS NOT NULL")
def read_json_files(spark: SparkSession, d: str) -> DataFrame:
    """Records in JSON lines with nested reviews, read by schema; damaged lines are kept apart."""
    reviews = F.coalesce(F.from_json(F.when(F.trim("reviews").startswith("["), F.col("reviews")), T.REVIEW), F.array().cast(T.REVIEW))
    p = table(spark, d, "products").where("source_product_id is not null").select("source_product_id", "name", "price", reviews.alias("reviews")).distinct()
    path = _folder(spark, "records")
    p.select(F.to_json(F.struct("*")).alias("value")).unionByName(spark.range(3).select(F.concat(F.lit('{"source_product_id": '), "id", F.lit(', "name": "cut')).alias("value"))).write.text(path)
    rows = T.read_json_lines(spark, path, f"source_product_id bigint, name string, price string, reviews {T.REVIEW}")
    return rows.where("_corrupt_record is null").select("source_product_id", "name", "price", F.size("reviews").alias("n_reviews"))


@query("SELECT source, count(*) AS n_texts, sum(length(text))::BIGINT AS n_chars FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY 1")
def read_nested_json(spark: SparkSession, d: str) -> DataFrame:
    """JSON documents of blocks with up to 100 texts in them, in a folder a source, read by their nested schema."""
    docs = table(spark, d, "documents").where("text is not null and source is not null")
    one = docs.groupBy("source", F.floor(F.col("doc_id") / 100).alias("g")).agg(F.to_json(F.create_map(F.lit("blocks"), F.collect_list(F.struct("doc_id", "text")))).alias("value")).drop("g")
    path = _folder(spark, "nested")
    one.write.partitionBy("source").text(path)
    read = T.read_nested(spark, path, "map<string,array<struct<doc_id:bigint,text:string>>>")
    return read.select("source", F.inline(F.col("data")["blocks"])).groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"), F.sum(F.length("text")).alias("n_chars"))


@query("SELECT date_trunc('hour', observed_at) AS start, source_id, count(*) AS n FROM update_feed GROUP BY 1, 2")
def stream_feed_hours(spark: SparkSession, d: str) -> DataFrame:
    """Readings of each source by hour, counted by a stream over the feed's files."""
    name = f"feed_hours_{uuid.uuid4().hex}"
    feed = read_feed(spark, f"{d}/update_feed.parquet").withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    counts = windowed_counts(feed, "observed_at", ["source_id"], "1 hour", "60 days")
    return run_to_folder(counts, posixpath.join(checkpoint_dir(spark), name)).withColumn("start", F.col("start").cast("timestamp_ntz"))
