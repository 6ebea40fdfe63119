"""Queries over catalogue records: fields, filters, attribute rows, upserts, incremental runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terroir.functions import fields as X
from terroir.operators import records as R
from terroir.session import small, table

ORACLE: dict[str, str] = {}
QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


RULES_SQL = r"""CASE WHEN size_ml <> 750 THEN 'bottle size' WHEN image IS NULL OR image = '' OR image LIKE '%default_bottle%' THEN 'image'
 WHEN qoh_n IS NULL OR qoh_n = 0 THEN 'no stock' WHEN regexp_matches(lower(name), 'pre-arrival|pre-order|pre-sale') THEN 'pre-arrival'
 WHEN regexp_matches(lower(name), '[0-9] pack') THEN 'multipack' WHEN sku IS NULL OR sku = '' THEN 'no sku' END"""
LISTINGS_SQL = r"""SELECT DISTINCT source_product_id, source_id, name, brand, region, wine_type, image, sku,
 CASE WHEN regexp_matches(lower(name), 'half[- ]bottle|375 *ml') THEN 375 WHEN regexp_matches(lower(name), '500 *ml') THEN 500 WHEN regexp_matches(lower(name), 'lit(er|re)') THEN 1000 ELSE 750 END AS size_ml,
 TRY_CAST(qoh AS INTEGER) AS qoh_n, TRY_CAST(replace(replace(price, '$', ''), ',', '') AS DOUBLE) AS price_n FROM products"""


def _listings(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(spark, d, "products").select("source_product_id", "source_id", "name", "brand", "region", "wine_type", "image", "sku", X.size_ladder(c("name")).alias("size_ml"), c("qoh").try_cast("int").alias("qoh_n"), X.plain_price(c("price")).alias("price_n")).distinct()


def _judged(spark: SparkSession, d: str) -> DataFrame:
    c, name = F.col, F.lower(F.col("name"))
    return R.with_reason(
        _listings(spark, d),
        [
            ("bottle size", c("size_ml") != 750),
            ("image", c("image").isNull() | (c("image") == "") | c("image").contains("default_bottle")),
            ("no stock", c("qoh_n").isNull() | (c("qoh_n") == 0)),
            ("pre-arrival", name.rlike("pre-arrival|pre-order|pre-sale")),
            ("multipack", name.rlike("[0-9] pack")),
            ("no sku", c("sku").isNull() | (c("sku") == "")),
        ],
    )


@query(
    f"""WITH j AS (SELECT *, {RULES_SQL} AS drop_reason FROM ({LISTINGS_SQL})), k AS (SELECT * FROM j WHERE drop_reason IS NULL AND price_n >= 1),
 e AS (SELECT source_product_id, 'price' AS code, 'currency' AS datatype, NULL AS t, NULL::BIGINT AS i, CAST(round(CAST(price_n AS DECIMAL(20,6)) * 100) AS BIGINT) AS ct FROM k
 UNION ALL SELECT source_product_id, 'qoh', 'integer', NULL, qoh_n, NULL FROM k
 UNION ALL SELECT source_product_id, 'brand', 'text', nullif(trim(brand), ''), NULL, NULL FROM k UNION ALL SELECT source_product_id, 'region', 'text', nullif(trim(region), ''), NULL, NULL FROM k
 UNION ALL SELECT source_product_id, 'wine_type', 'text', nullif(trim(wine_type), ''), NULL, NULL FROM k)
 SELECT DISTINCT source_product_id, a.attribute_id, e.code, e.datatype, t AS value_text, i AS value_integer, ct AS value_cents FROM e JOIN domain_attributes a ON a.code = e.code WHERE coalesce(t, i::VARCHAR, ct::VARCHAR) IS NOT NULL"""
)
def catalog_filter_eav(spark: SparkSession, d: str) -> DataFrame:
    """Listings that pass the rules, as typed attribute rows."""
    c = F.col
    kept = _judged(spark, d).where(c("drop_reason").isNull() & (c("price_n") >= 1))
    rows = R.shred(kept, ["source_product_id"], [("price", "currency", c("price_n")), ("qoh", "integer", c("qoh_n")), ("brand", "text", c("brand")), ("region", "text", c("region")), ("wine_type", "text", c("wine_type"))])
    attrs = small(table(spark, d, "domain_attributes").select("attribute_id", "code"))
    return rows.join(attrs, "code").select("source_product_id", "attribute_id", "code", "datatype", "value_text", "value_integer", "value_cents")


@query(f"SELECT coalesce(drop_reason, 'kept') AS drop_reason, count(*) AS n FROM (SELECT {RULES_SQL} AS drop_reason FROM ({LISTINGS_SQL})) GROUP BY 1")
def drop_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    r"""SELECT DISTINCT source_product_id, regexp_replace(name, ' \((Elsewhere|Previously) \$\d*\)', '', 'g') AS clean_name, nullif(regexp_extract(replace(name, chr(10), ' '), '^.*([1-3][0-9]{3})', 1), '') AS year,
 CASE WHEN regexp_matches(lower(name), 'half[- ]bottle|375 *ml') THEN 375 WHEN regexp_matches(lower(name), '500 *ml') THEN 500 WHEN regexp_matches(lower(name), 'lit(er|re)') THEN 1000 ELSE 750 END AS size_ml,
 TRY_CAST(replace(replace(price, '$', ''), ',', '') AS DOUBLE) AS price, coalesce(TRY_CAST(msrp AS DOUBLE), TRY_CAST(replace(replace(price, '$', ''), ',', '') AS DOUBLE)) AS msrp,
 CASE WHEN starts_with(image, '//') THEN 'https:' || image WHEN starts_with(image, 'http') THEN image END AS image, trim(regexp_replace(sku, '(?i)sku ?[#:] ?', '', 'g')) AS sku FROM products"""
)
def site_fields(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    price = X.plain_price(c("price"))
    return table(spark, d, "products").select("source_product_id", X.listing_name(c("name")).alias("clean_name"), X.last_year(F.translate("name", "\n", " ")).alias("year"), X.size_ladder(c("name")).alias("size_ml"), price.alias("price"), F.coalesce(c("msrp").try_cast("double"), price).alias("msrp"), X.image_address(c("image"), "https://shop.example").alias("image"), X.sku_code(c("sku")).alias("sku")).distinct()


@query(
    """SELECT source_product_id, arg_max(CASE WHEN code = 'body' THEN v END, sav_id) FILTER (code = 'body') AS body, arg_max(CASE WHEN code = 'designation' THEN v END, sav_id) FILTER (code = 'designation') AS designation,
 arg_max(CASE WHEN code = 'closure' THEN v END, sav_id) FILTER (code = 'closure') AS closure FROM (SELECT s.*, a.code, nullif(trim(value), '') AS v FROM source_attribute_values s JOIN domain_attributes a USING (attribute_id)) WHERE v IS NOT NULL AND code IN ('body', 'designation', 'closure') GROUP BY 1"""
)
def kv_table_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Label-value rows into columns, the last row of a label counts."""
    attrs = small(table(spark, d, "domain_attributes").select("attribute_id", "code"))
    rows = table(spark, d, "source_attribute_values").withColumn("v", F.nullif(F.trim("value"), F.lit(""))).join(attrs, "attribute_id").where("v is not null and code in ('body', 'designation', 'closure')")
    return rows.groupBy("source_product_id").agg(*[F.max_by("v", F.when(F.col("code") == k, F.col("sav_id"))).alias(k) for k in ("body", "designation", "closure")])


@query(
    """SELECT kind, count(*) AS n FROM (SELECT CASE WHEN lower(wine_type) LIKE '%dessert%' THEN 'Dessert' WHEN lower(wine_type) LIKE '%sparkling%' THEN 'Sparkling' WHEN lower(wine_type) LIKE '%ros%' THEN 'Rose'
 WHEN lower(wine_type) LIKE '%white%' THEN 'White' WHEN lower(wine_type) LIKE '%red%' THEN 'Red' END AS kind FROM products) GROUP BY 1"""
)
def wine_type_canonical(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "products").groupBy(X.wine_kind(F.col("wine_type")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


REVIEWS_SQL = """SELECT DISTINCT source_product_id, j->>'$.reviewer_name' AS reviewer_name, j->>'$.score_str' AS score_str, j->>'$.content' AS content FROM
 (SELECT DISTINCT source_product_id, unnest(CAST(json_extract(reviews, '$[*]') AS JSON[])) AS j FROM products WHERE starts_with(trim(reviews), '['))"""
SCORE_SQL = "TRY_CAST(split_part(replace(score_str, '+', ''), '-', -1) AS INTEGER)"


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    parsed = F.from_json(F.trim("reviews"), "array<struct<reviewer_name:string,score_str:string,content:string>>")
    return table(spark, d, "products").where(F.trim("reviews").startswith("[")).select("source_product_id", F.inline(parsed)).distinct()


@query(f"SELECT source_product_id, coalesce(nullif(reviewer_name, ''), 'Unknown') AS reviewer, content, CASE WHEN s > 0 AND s < 70 THEN NULL ELSE coalesce(s, 0) END AS score FROM (SELECT *, {SCORE_SQL} AS s FROM ({REVIEWS_SQL}))")
def review_scores(spark: SparkSession, d: str) -> DataFrame:
    """Reviews with numeric scores: the upper end of a range; 1 to 69 is no score; unreadable is 0."""
    s = X.score_number(F.col("score_str"))
    return _reviews(spark, d).select("source_product_id", F.coalesce(F.nullif("reviewer_name", F.lit("")), F.lit("Unknown")).alias("reviewer"), "content", F.when((s > 0) & (s < 70), None).otherwise(F.coalesce(s, F.lit(0))).alias("score"))


#: Reviewers with aliases and score modifiers, as a small table in both engines.
REVIEWERS = [(1, "Cellar Gazette", ["gazette", "CG"], 0.5), (2, "The Corkboard", ["corkboard"], -1.0), (3, "Unknown", ["anonymous"], 0.0), (4, "Vine Post", ["post"], 0.25)]
REVIEWERS_SQL = "(VALUES " + ", ".join(f"({i}, '{n}', {a!r}, {m})" for i, n, a, m in REVIEWERS) + ") t(rid, rname, aliases, modifier)"


def _reviewers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REVIEWERS, "rid int, rname string, aliases array<string>, modifier double")


@query(
    f"""SELECT reviewer_name, coalesce(arg_min(rname, rid), reviewer_name) AS matched FROM (SELECT DISTINCT reviewer_name FROM ({REVIEWS_SQL})) LEFT JOIN (SELECT rid, rname, unnest(aliases) AS alias FROM {REVIEWERS_SQL}) r
 ON lower(alias) = lower(reviewer_name) OR lower(rname) = lower(reviewer_name) OR contains(lower(reviewer_name), lower(rname)) OR contains(lower(reviewer_name), lower(alias)) GROUP BY 1"""
)
def reviewer_alias_match(spark: SparkSession, d: str) -> DataFrame:
    """The reviewer (lowest id) whose name or alias is in the given name, else the name itself."""
    names = _reviews(spark, d).select("reviewer_name").distinct()
    r = F.broadcast(_reviewers(spark).select("rid", "rname", F.explode("aliases").alias("alias")))  # a few fixed rows
    given = F.lower("reviewer_name")
    hit = (F.lower("alias") == given) | (F.lower("rname") == given) | given.contains(F.lower("rname")) | given.contains(F.lower("alias"))
    return names.join(r, hit, "left").groupBy("reviewer_name").agg(F.min_by("rname", "rid").alias("m")).select("reviewer_name", F.coalesce("m", "reviewer_name").alias("matched"))


@query(f"SELECT source_product_id, round(avg(s + coalesce(modifier, 0)), 6) AS rating, count(*) AS n_scores FROM (SELECT *, {SCORE_SQL} AS s FROM ({REVIEWS_SQL})) LEFT JOIN {REVIEWERS_SQL} ON rname = reviewer_name WHERE s >= 70 GROUP BY 1")
def rating_by_product(spark: SparkSession, d: str) -> DataFrame:
    rows = _reviews(spark, d).withColumn("s", X.score_number(F.col("score_str"))).where("s >= 70").join(F.broadcast(_reviewers(spark).select("rname", "modifier")), F.col("rname") == F.col("reviewer_name"), "left")
    return R.aggregate_score(rows, ["source_product_id"], "s", "modifier").withColumn("rating", F.round("rating", 6))


@query(
    """SELECT DISTINCT source_product_id, CASE WHEN regexp_matches(name, '(?i)reserve|riserva') THEN 'reserve wine' WHEN regexp_matches(name, '(?i)old vines') THEN 'old vines wine' ELSE purpose END AS purpose FROM products"""
)
def override_values(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([("purpose", "old vines", "old vines wine", 1), ("purpose", "reserve|riserva", "reserve wine", 2), ("purpose", "", "never", 3), ("foods", "x", "y", 4)], "attr_code string, pattern string, attr_value string, ord int")
    return R.override(table(spark, d, "products").select("source_product_id", "name", "purpose"), "purpose", rules, "purpose", "name").select("source_product_id", "purpose").distinct()


@query("SELECT DISTINCT source_product_id, brand, coalesce(id, -1) AS node_id FROM products LEFT JOIN (SELECT lower(trim(name)) AS n, min(id) AS id FROM domain_taxonomy_nodes WHERE attribute_id = 5 AND parent_id <> 0 GROUP BY 1) ON n = lower(trim(brand))")
def node_value_resolve(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "domain_taxonomy_nodes").where("attribute_id = 5 and parent_id <> 0")
    return R.resolve(table(spark, d, "products").select("source_product_id", "brand"), "brand", entries, "name", "id").distinct()


@query(
    """WITH known AS (SELECT source_id, single_product_url, min(source_product_id) AS product_id FROM products GROUP BY 1, 2), n AS (SELECT DISTINCT source_id, single_product_url FROM update_products), m AS (SELECT n.*, product_id FROM n LEFT JOIN known USING (source_id, single_product_url))
 SELECT source_id, count(*) AS n_keys, count(product_id) AS n_known, count(*) - count(product_id) AS n_new, 0::BIGINT AS n_clashes FROM m GROUP BY 1"""
)
def upsert_master(spark: SparkSession, d: str) -> DataFrame:
    """Ids of listed products: known ones keep theirs, new ones get the next numbers; counted by source."""
    known = table(spark, d, "products").select("source_id", "single_product_url", F.col("source_product_id").alias("product_id"))
    top = known.agg(F.max("product_id")).first()[0]
    ids = R.upsert(known, table(spark, d, "update_products"), ["source_id", "single_product_url"], "product_id").withColumn("top", F.lit(top))
    clashes = ids.groupBy("product_id").agg(F.count(F.lit(1)).alias("k"), F.first("source_id").alias("source_id"), F.first("top").alias("top"))
    by = clashes.groupBy("source_id").agg(F.count_if((F.col("k") > 1) & (F.col("product_id") > F.col("top"))).alias("n_clashes"))
    return ids.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("product_id") <= F.col("top")).alias("n_known"), F.count_if(F.col("product_id") > F.col("top")).alias("n_new")).join(by, "source_id")


@query("SELECT source_id, max(sequence_id) AS sequence_id, count(*) AS n_runs FROM pipeline_sequence GROUP BY 1")
def latest_sequence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pipeline_sequence").groupBy("source_id").agg(F.max("sequence_id").alias("sequence_id"), F.count(F.lit(1)).alias("n_runs"))


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def first_per_group(spark: SparkSession, d: str) -> DataFrame:
    return R.first_per_group(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey"])


@query("SELECT user_id, event_type, CAST(sum(CAST(props->>'$.k' AS INTEGER)) AS BIGINT) AS k_sum, count(*) AS n FROM events GROUP BY 1, 2")
def vectors_unnest(spark: SparkSession, d: str) -> DataFrame:
    """Values read by path from JSON and regrouped."""
    return table(spark, d, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).groupBy("user_id", "event_type").agg(F.sum("k").alias("k_sum"), F.count(F.lit(1)).alias("n"))


@query(
    """WITH k AS (SELECT source_id, single_product_url, max(TRY_CAST(qoh AS INTEGER)) AS stored FROM products GROUP BY 1, 2), u AS (SELECT DISTINCT source_id, sequence_id, single_product_url, name, nullif(trim(qoh), '') AS q FROM update_products),
 r AS (SELECT u.*, CASE WHEN name IS NULL OR trim(name) = '' THEN 'drop' WHEN q IS NOT NULL THEN 'pass' WHEN k.single_product_url IS NULL THEN 'fetch_detail' WHEN coalesce(stored, 0) <= min_qoh_threshold THEN 'refetch_qoh' ELSE 'pass' END AS route
 FROM u LEFT JOIN k USING (source_id, single_product_url) LEFT JOIN sources USING (source_id)) SELECT source_id, route, count(*) AS n FROM r GROUP BY 1, 2"""
)
def incremental_route(spark: SparkSession, d: str) -> DataFrame:
    """What each row of an incremental run needs: pass, drop, a new detail page or a new stock reading."""
    k = table(spark, d, "products").groupBy("source_id", "single_product_url").agg(F.max(F.col("qoh").try_cast("int")).alias("stored")).withColumn("known", F.lit(True))
    u = table(spark, d, "update_products").select("source_id", "sequence_id", "single_product_url", "name", F.nullif(F.trim("qoh"), F.lit("")).alias("q")).distinct()
    s = small(table(spark, d, "sources").select("source_id", "min_qoh_threshold"))
    j = u.join(k, ["source_id", "single_product_url"], "left").join(s, "source_id", "left")
    route = F.when(F.col("name").isNull() | (F.trim("name") == ""), "drop").when(F.col("q").isNotNull(), "pass").when(F.col("known").isNull(), "fetch_detail").when(F.coalesce("stored", F.lit(0)) <= F.col("min_qoh_threshold"), "refetch_qoh").otherwise("pass")
    return j.groupBy("source_id", route.alias("route")).agg(F.count(F.lit(1)).alias("n"))


PRICE_SQL = "CAST(round(CAST(TRY_CAST(regexp_replace(trim(price), '^(\\$|USD )|,', '', 'g') AS DOUBLE) AS DECIMAL(20,6)) * 100) AS BIGINT)"


@query(
    f"""WITH u AS (SELECT source_id, single_product_url, sequence_id, arg_max({PRICE_SQL}, (loaded_at, price)) AS cents FROM update_products GROUP BY 1, 2, 3),
 w AS (SELECT *, lag(cents) OVER (PARTITION BY source_id, single_product_url ORDER BY sequence_id) AS before FROM u) SELECT source_id, sequence_id, single_product_url, before, cents FROM w WHERE before IS NOT NULL AND cents IS NOT NULL AND before <> cents"""
)
def price_change_detect(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    cents = F.round(F.regexp_replace(F.trim("price"), r"^(\$|USD )|,", "").try_cast("double").cast("decimal(20,6)") * 100).cast("long")
    u = table(spark, d, "update_products").groupBy("source_id", "single_product_url", "sequence_id").agg(F.max_by(cents, F.struct("loaded_at", "price")).alias("cents"))
    w = u.withColumn("before", F.lag("cents").over(W.partitionBy("source_id", "single_product_url").orderBy("sequence_id")))
    return w.where("before is not null and cents is not null and before <> cents").select("source_id", "sequence_id", "single_product_url", "before", "cents")


@query("SELECT DISTINCT source_product_id FROM products p WHERE NOT EXISTS (SELECT 1 FROM update_products u WHERE u.source_id = p.source_id AND u.single_product_url = p.single_product_url)")
def delete_stale(spark: SparkSession, d: str) -> DataFrame:
    """Products that no run lists any more."""
    return R.without_keys(table(spark, d, "products").select("source_id", "single_product_url", "source_product_id"), table(spark, d, "update_products"), ["source_id", "single_product_url"]).select("source_product_id").distinct()


@query("SELECT DISTINCT p.source_product_id, p.source_id IN (SELECT source_id FROM sources WHERE NOT is_active) AS deleted FROM products p")
def soft_delete(spark: SparkSession, d: str) -> DataFrame:
    return R.mark_deleted(table(spark, d, "products").select("source_product_id", "source_id"), table(spark, d, "sources").where("not is_active"), "source_id").select("source_product_id", "deleted").distinct()


@query("SELECT id, name FROM domain_taxonomy_nodes n WHERE EXISTS (SELECT 1 FROM products p WHERE lower(trim(p.brand)) = lower(n.name))")
def exists_semi(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "products").select(F.lower(F.trim("brand")).alias("b")).distinct()
    return table(spark, d, "domain_taxonomy_nodes").join(b, F.lower("name") == F.col("b"), "left_semi").select("id", "name")


@query("SELECT DISTINCT u.source_id, u.name FROM update_products u WHERE u.sequence_id = (SELECT max(sequence_id) FROM pipeline_sequence s WHERE s.source_id = u.source_id)")
def correlated_max(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "update_products").createOrReplaceTempView("terroir_updates")
    table(spark, d, "pipeline_sequence").createOrReplaceTempView("terroir_runs")
    return spark.sql("SELECT DISTINCT u.source_id, u.name FROM terroir_updates u WHERE u.sequence_id = (SELECT max(sequence_id) FROM terroir_runs s WHERE s.source_id = u.source_id)")


@query("SELECT datatype, count(popularity_weight) > 0 AS weighted, string_agg(code, ',' ORDER BY attribute_id) AS codes FROM domain_attributes GROUP BY 1")
def predicates_by_priority(spark: SparkSession, d: str) -> DataFrame:
    """Attribute codes of each type in the order of their ids."""
    g = table(spark, d, "domain_attributes").groupBy("datatype").agg(F.array_sort(F.collect_list(F.struct("attribute_id", "code"))).alias("c"), (F.count("popularity_weight") > 0).alias("weighted"))
    return g.select("datatype", "weighted", F.array_join(F.transform("c", lambda x: x["code"]), ",").alias("codes"))


@query("SELECT lower(alias) AS root, max(code) AS code FROM (SELECT code, unnest(CAST(aliases AS VARCHAR[])) AS alias FROM (SELECT code, CAST(aliases AS JSON) AS aliases FROM domain_attributes)) GROUP BY 1")
def root_words_map(spark: SparkSession, d: str) -> DataFrame:
    """Aliases to attribute codes; of several codes the last by name."""
    rows = table(spark, d, "domain_attributes").select("code", F.explode(F.from_json("aliases", "array<string>")).alias("alias"))
    return rows.groupBy(F.lower("alias").alias("root")).agg(F.max("code").alias("code"))


@query(
    """WITH a AS (SELECT source_product_id, code, value, sav_id FROM (SELECT DISTINCT source_product_id, attribute_id, value, sav_id FROM source_attribute_values WHERE trim(value) <> '') JOIN domain_attributes USING (attribute_id)),
 f AS (SELECT source_product_id, code, value, min(sav_id) AS s FROM a GROUP BY ALL) SELECT source_product_id, code, string_agg(value, '|' ORDER BY s, value) AS vals, (SELECT min(sav_id) FROM a WHERE a.source_product_id = f.source_product_id AND a.code = f.code) AS first_id,
 (SELECT max(sav_id) FROM a WHERE a.source_product_id = f.source_product_id AND a.code = f.code) AS last_id, CASE WHEN count(*) < 2 THEN '$eq' WHEN code = 'price' THEN '$between' ELSE '$in' END AS relation FROM f GROUP BY source_product_id, code"""
)
def combine_same_code(spark: SparkSession, d: str) -> DataFrame:
    attrs = small(table(spark, d, "domain_attributes").select("attribute_id", "code"))
    a = table(spark, d, "source_attribute_values").where(F.trim("value") != "").select("source_product_id", "attribute_id", "value", F.col("sav_id").alias("start"), F.col("sav_id").alias("end")).distinct().join(attrs, "attribute_id")
    return R.combine_same_code(a, ["source_product_id"]).select("source_product_id", "code", F.array_join("values", "|").alias("vals"), F.col("start").alias("first_id"), F.col("end").alias("last_id"), "relation")


@query("SELECT description, record_id, count(*) OVER (PARTITION BY description) AS n FROM (SELECT DISTINCT description, record_id FROM product_records WHERE trim(description) <> '' AND record_id IS NOT NULL)")
def grouped_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Records by their text, with how many share it: a row each, so that a text of very many records isn't one value."""
    rows = table(spark, d, "product_records").where(F.trim("description") != "").where("record_id is not null").select("description", "record_id").distinct()
    return rows.join(rows.groupBy("description").agg(F.count(F.lit(1)).alias("n")), "description")
