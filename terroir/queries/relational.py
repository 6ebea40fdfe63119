"""Queries of joins, sets, orders, metadata and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terroir.functions import fields as X
from terroir.functions.fields import first_stated
from terroir.functions.text import simple_words
from terroir.operators import dictionary as D
from terroir.operators import records as R
from terroir.operators.lookup import load, lookup
from terroir.plans.jobs import validate
from terroir.plans.sync import listed
from terroir.session import small, table

ORACLE: dict[str, str] = {}
QUERIES: dict = {}
WORDS = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("SELECT DISTINCT p.source_product_id, s.source_name, coalesce(s.trust_rank, 0) AS trust_rank, r.master_product_id FROM products p JOIN sources s USING (source_id) LEFT JOIN (SELECT sku, min(master_product_id) AS master_product_id FROM product_records GROUP BY 1) r ON r.sku = p.sku WHERE s.is_active")
def products_with_sources(spark: SparkSession, d: str) -> DataFrame:
    s = small(table(spark, d, "sources").where("is_active").select("source_id", "source_name", "trust_rank"))
    r = table(spark, d, "product_records").groupBy("sku").agg(F.min("master_product_id").alias("master_product_id"))
    return table(spark, d, "products").select("source_product_id", "source_id", "sku").join(s, "source_id").join(r, "sku", "left").select("source_product_id", "source_name", F.coalesce("trust_rank", F.lit(0)).alias("trust_rank"), "master_product_id").distinct()


@query("SELECT n.id, n.name, a.code, p.name AS parent FROM domain_taxonomy_nodes n JOIN domain_attributes a USING (attribute_id) LEFT JOIN domain_taxonomy_nodes p ON p.id = n.parent_id WHERE a.category_id = 1")
def dictionary_join(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "domain_taxonomy_nodes")
    a = small(table(spark, d, "domain_attributes").where("category_id = 1").select("attribute_id", "code"))
    p = n.select(F.col("id").alias("parent_id"), F.col("name").alias("parent"))
    return n.join(a, "attribute_id").join(p, "parent_id", "left").select("id", "name", "code", "parent")


@query("SELECT source_product_id, sav_id, value FROM (SELECT DISTINCT source_product_id, sav_id, value, attribute_id FROM source_attribute_values) JOIN domain_attributes USING (attribute_id) WHERE code = 'short_desc' AND length(value) > 5")
def attribute_texts(spark: SparkSession, d: str) -> DataFrame:
    a = small(table(spark, d, "domain_attributes").where("code = 'short_desc'").select("attribute_id"))
    return table(spark, d, "source_attribute_values").select("source_product_id", "sav_id", "value", "attribute_id").where("length(value) > 5").distinct().join(a, "attribute_id").select("source_product_id", "sav_id", "value")


A, B = "SELECT lower(trim(brand)) AS b FROM products WHERE brand IS NOT NULL", "SELECT lower(trim(brand)) AS b FROM product_records WHERE brand IS NOT NULL"


@query(f"SELECT 'both' AS side, count(*) AS n FROM ({A} INTERSECT {B}) UNION ALL SELECT 'first', count(*) FROM ({A} EXCEPT {B}) UNION ALL SELECT 'second', count(*) FROM ({B} EXCEPT {A}) UNION ALL SELECT 'any', count(*) FROM ({A} UNION {B})")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of intersection, differences and union, from one pass over both sides' distinct values."""
    side = lambda t, k: table(spark, d, t).where("brand is not null").select(F.lower(F.trim("brand")).alias("b"), F.lit(k).alias("k"))
    g = side("products", 1).unionByName(side("product_records", 2)).groupBy("b").agg(F.bit_or("k").alias("k"))
    n = g.agg(F.count_if(F.col("k") == 3).alias("both"), F.count_if(F.col("k") == 1).alias("first"), F.count_if(F.col("k") == 2).alias("second"), F.count("b").alias("any"))
    return n.select(F.inline(F.array(*[F.struct(F.lit(k).alias("side"), F.col(k).alias("n")) for k in ("both", "first", "second", "any")])))


@query(
    f"""WITH s AS (SELECT doc_id, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS w FROM (SELECT doc_id, {WORDS.format("text")} AS ws FROM documents)) SELECT doc_id, min(pos) AS lo, max(pos) AS hi, max(pos) - min(pos) + 1 = count(DISTINCT pos) AS contiguous FROM s WHERE w IN ('wine', 'palate', 'smells', 'notes') GROUP BY 1"""
)
def contiguity(spark: SparkSession, d: str) -> DataFrame:
    """Whether the positions of some words in a text have no gap."""
    k = table(spark, d, "documents").select("doc_id", F.posexplode(simple_words(F.col("text"))).alias("pos", "w")).where("w in ('wine', 'palate', 'smells', 'notes')")
    g = k.withColumn("pos", F.col("pos").cast("long")).groupBy("doc_id")
    return g.agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), (F.max("pos") - F.min("pos") + 1 == F.countDistinct("pos")).alias("contiguous"))


@query("SELECT name, length(name) AS n FROM (SELECT DISTINCT name FROM domain_taxonomy_nodes) ORDER BY n DESC, name LIMIT 25")
def longest_first(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "domain_taxonomy_nodes").select("name").distinct().select("name", F.length("name").cast("long").alias("n")).orderBy(F.desc("n"), "name").limit(25)


@query("SELECT v, arg_min(id, (o, id)) AS id FROM (SELECT lower(n.name) AS v, n.id, CASE a.code WHEN 'region' THEN 1 WHEN 'varietals' THEN 2 WHEN 'brand' THEN 3 ELSE 9 END AS o FROM domain_taxonomy_nodes n JOIN domain_attributes a USING (attribute_id)) GROUP BY 1")
def disambiguate_codes(spark: SparkSession, d: str) -> DataFrame:
    """Of entries with one name the one whose code comes first in a given order."""
    a = small(table(spark, d, "domain_attributes").select("attribute_id", "code"))
    at = F.array_position(F.array(*[F.lit(c) for c in ("region", "varietals", "brand")]), F.col("code"))
    n = table(spark, d, "domain_taxonomy_nodes").join(a, "attribute_id").withColumn("o", F.when(at > 0, at).otherwise(9))
    return n.groupBy(F.lower("name").alias("v")).agg(F.min_by("id", F.struct("o", "id")).alias("id"))


@query("SELECT doc_id, trim(doc_type) AS doc_type, trim(text) AS text FROM documents WHERE trim(doc_type) <> ''")
def training_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every text that has a class, with its class: a row each, of any length."""
    return table(spark, d, "documents").where("trim(doc_type) <> ''").select("doc_id", F.trim("doc_type").alias("doc_type"), F.trim("text").alias("text"))


@query("SELECT trim(doc_type) AS doc_type, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id, sum(length(text))::BIGINT AS n_chars FROM documents WHERE trim(doc_type) <> '' GROUP BY 1")
def training_classes(spark: SparkSession, d: str) -> DataFrame:
    """The classes of texts, with how much there is of each."""
    t = table(spark, d, "documents").where("trim(doc_type) <> ''")
    return t.groupBy(F.trim("doc_type").alias("doc_type")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.sum(F.length("text")).alias("n_chars"))


@query("SELECT code, datatype IN ('float', 'currency') AS is_numeric, datatype = 'float' AS is_scalar, NOT coalesce(has_taxonomy, FALSE) AS is_free, code IN ('price', 'qpr', 'qoh') AS is_offer FROM domain_attributes")
def metadata_predicates(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("datatype")
    return table(spark, d, "domain_attributes").select("code", t.isin("float", "currency").alias("is_numeric"), (t == "float").alias("is_scalar"), (~F.coalesce("has_taxonomy", F.lit(False))).alias("is_free"), F.col("code").isin("price", "qpr", "qoh").alias("is_offer"))


@query(f"SELECT doc_id, len(list_filter(ws, lambda w, i: w = 'wine' AND i <= 20)) > 0 AS early_wine FROM (SELECT doc_id, {WORDS.format('text')} AS ws FROM documents WHERE text IS NOT NULL)")
def position_intersections(spark: SparkSession, d: str) -> DataFrame:
    """Whether a word stands within a range of positions."""
    ws = simple_words(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.exists(F.slice(ws, 1, 20), lambda w: w == "wine").alias("early_wine"))


@query("SELECT event_id, props, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(props->>'$.k' AS INTEGER) END AS k FROM events")
def safe_decode(spark: SparkSession, d: str) -> DataFrame:
    """Base64 and JSON that may be damaged: null where they can't be read."""
    coded = F.when(F.col("event_id") % 3 == 0, F.lit("%%%")).otherwise(F.base64(F.encode("props", "utf-8")))
    plain = F.decode(F.try_to_binary(coded, F.lit("base64")), "utf-8")
    return table(spark, d, "events").select("event_id", "props", F.get_json_object(plain, "$.k").cast("int").alias("k"))


@query(
    """WITH v AS (SELECT source_product_id, attribute_id, arg_max(value, sav_id) AS v FROM source_attribute_values WHERE attribute_id IN (3, 4) AND trim(value) <> '' GROUP BY 1, 2) SELECT source_product_id, max(v) FILTER (attribute_id = 3) AS msrp, max(v) FILTER (attribute_id = 4) AS qoh, count(*) AS n FROM v GROUP BY 1"""
)
def vector_values(spark: SparkSession, d: str) -> DataFrame:
    """Attribute vectors put together as JSON, and two of their values read back by path."""
    v = table(spark, d, "source_attribute_values").where("attribute_id in (3, 4) and trim(value) <> ''").groupBy("source_product_id", "attribute_id").agg(F.max_by("value", "sav_id").alias("v"))
    j = v.groupBy("source_product_id").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("attribute_id").alias("attr_id"), F.array(F.struct(F.col("v").alias("v_orig"))).alias("values"))).alias("attributes"))).alias("vector"))
    read = F.from_json(F.get_json_object("vector", "$.attributes"), "array<struct<attr_id:bigint,values:array<struct<v_orig:string>>>>")
    x = j.select("source_product_id", F.explode(read).alias("a")).select("source_product_id", F.col("a.attr_id").alias("i"), F.col("a.values")[0]["v_orig"].alias("o"))
    return x.groupBy("source_product_id").agg(F.max(F.when(F.col("i") == 3, F.col("o"))).alias("msrp"), F.max(F.when(F.col("i") == 4, F.col("o"))).alias("qoh"), F.count(F.lit(1)).alias("n"))


@query("SELECT source_id, sequence_id, count(*) AS n FROM (SELECT DISTINCT v.*, s.sequence_id FROM source_attribute_values v JOIN (SELECT source_id, max(sequence_id) AS sequence_id FROM pipeline_sequence WHERE state = 'ready' GROUP BY 1) s USING (source_id)) GROUP BY 1, 2")
def copy_with_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Attribute rows stamped with their source's last finished run, counted."""
    s = small(table(spark, d, "pipeline_sequence").where("state = 'ready'").groupBy("source_id").agg(F.max("sequence_id").alias("sequence_id")))
    return table(spark, d, "source_attribute_values").distinct().join(s, "source_id").groupBy("source_id", "sequence_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'ids' AS check_type, coalesce(bool_and(coalesce(source_product_id > 0, FALSE)), FALSE) AS status FROM products UNION ALL SELECT 'brands', coalesce(bool_and(coalesce(brand <> '', FALSE)), FALSE) FROM products")
def validate_run(spark: SparkSession, d: str) -> DataFrame:
    return validate(table(spark, d, "products"), {"ids": "source_product_id > 0", "brands": "brand <> ''"})


@query("SELECT id, name FROM domain_taxonomy_nodes WHERE id NOT IN (SELECT vec_id + 1000000 FROM embeddings)")
def entities_without_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select((F.col("vec_id") + 1_000_000).alias("id")).distinct()
    return table(spark, d, "domain_taxonomy_nodes").join(v, "id", "left_anti").select("id", "name")


@query("SELECT datatype, count(*) AS n, string_agg(DISTINCT category_id::VARCHAR, ',') AS categories, string_agg(name, '|' ORDER BY name) AS names FROM domain_attributes GROUP BY 1")
def units_by_type(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "domain_attributes").groupBy("datatype")
    return g.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set(F.col("category_id").cast("string"))), ",").alias("categories"), F.array_join(F.array_sort(F.collect_list("name")), "|").alias("names"))


@query("SELECT DISTINCT source_product_id, coalesce(nullif(trim(description), ''), nullif(trim(highlights), ''), nullif(trim(characteristics), ''), 'none') AS about FROM products")
def fallback_chain(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(spark, d, "products").select("source_product_id", F.coalesce(first_stated(c("description"), c("highlights"), c("characteristics")), F.lit("none")).alias("about")).distinct()


def top_terms(texts: DataFrame) -> DataFrame:
    """doc_id, w, score of the three heaviest words of each text."""
    tf = texts.select("doc_id", F.explode(simple_words(F.col("text"))).alias("w")).groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    n = tf.agg(F.countDistinct("doc_id")).first()[0]
    s = tf.join(df, "w").select("doc_id", "w", F.round(F.col("tf") * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1), 6).alias("score"))
    return s.withColumn("r", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), "w"))).where("r <= 3").select("doc_id", "w", "score")


@query(
    f"""WITH w AS (SELECT doc_id, unnest({WORDS.format("text")}) AS w FROM documents), tf AS (SELECT doc_id, w, count(*) AS tf FROM w GROUP BY 1, 2), df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1),
 s AS (SELECT doc_id, w, round(tf * (ln((1 + (SELECT count(DISTINCT doc_id) FROM tf)) / (1.0 + df)) + 1), 6) AS score FROM tf JOIN df USING (w)), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, w) AS r FROM s) SELECT doc_id, w, score FROM r WHERE r <= 3"""
)
def tfidf_top_terms(spark: SparkSession, d: str) -> DataFrame:
    """The three heaviest words of each text, in all languages."""
    return top_terms(table(spark, d, "documents"))


@query()
def brand_of_name(spark: SparkSession, d: str) -> DataFrame:
    """The house that a name begins with first, for listings whose column names none."""
    index = load(D.build(table(spark, d, "domain_taxonomy_nodes"), table(spark, d, "domain_attributes")))
    p = table(spark, d, "products").where("brand is null or trim(brand) = ''").select("source_product_id", "name").distinct()
    found = lookup(p, "name", index, codes={"brand"}, single_brand=False)
    best = found.groupBy("name").agg(F.min_by("value", F.struct("start", "entity_id")).alias("brand"))
    return p.join(best, "name", "left").select("source_product_id", "brand")


@query()
def varietals_of_name(spark: SparkSession, d: str) -> DataFrame:
    """Grapes named in a listing's name, joined in their order; the column's text where there are none."""
    index = load(D.build(table(spark, d, "domain_taxonomy_nodes"), table(spark, d, "domain_attributes")))
    p = table(spark, d, "products").select("source_product_id", "name", "varietals").distinct()
    found = lookup(p, "name", index, codes={"varietals"})
    named = found.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "value"))), lambda x: x["value"]), ", ").alias("named"))
    return p.join(named, "name", "left").select("source_product_id", F.coalesce("named", "varietals").alias("varietals"))


@query()
def node_lookup_values(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of distinct values by lookup with their code, -1 where there is none."""
    index = load(D.build(table(spark, d, "domain_taxonomy_nodes"), table(spark, d, "domain_attributes")))
    v = table(spark, d, "products").select(F.col("region").alias("typed")).where("trim(typed) <> ''").distinct()
    found = lookup(v, "typed", index, codes={"region"}, fuzzy=True).groupBy("typed").agg(F.max_by("entity_id", F.struct("score", (-F.col("entity_id")).alias("m"))).alias("node_id"))
    return v.join(found, "typed", "left").select("typed", F.coalesce("node_id", F.lit(-1).cast("long")).alias("node_id"))


@query(
    r"""SELECT DISTINCT source_product_id, CASE WHEN n < 10 THEN CAST(n * 1000 AS INTEGER) ELSE CAST(trunc(n) AS INTEGER) END AS size_ml, TRY_CAST(nullif(regexp_extract(qoh, '(\d+)', 1), '') AS INTEGER) AS stock, CASE WHEN regexp_matches(lower(qoh), 'unavailable|inquire|sold out') THEN 0 WHEN qoh IS NOT NULL THEN 100 END AS some,
 coalesce(list_sum(list_transform(string_split(coalesce(qoh, '') || ',> 3,x', ','), lambda x: coalesce(TRY_CAST(regexp_replace(x, '[<> ]', '', 'g') AS INTEGER), 0))), 0)::INTEGER AS summed, concat_ws(' ', regexp_replace(description, '^"(.*)"$', '\1'), 'Foods: ' || nullif(trim(foods), ''), 'Body: ' || nullif(trim(body), '')) AS about
 FROM (SELECT *, TRY_CAST(regexp_replace(lower(bottle_size), 'ml|l', '', 'g') AS DOUBLE) AS n FROM products)"""
)
def site_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of product pages brought to one form: size, stock as a number, by words and as a sum, text with features."""
    c = F.col
    p = table(spark, d, "products")
    cells = F.split(F.concat(F.coalesce("qoh", F.lit("")), F.lit(",> 3,x")), ",")
    return p.select("source_product_id", X.size_cell(c("bottle_size")).alias("size_ml"), X.first_integer(c("qoh")).alias("stock"), X.stock_by_words(c("qoh")).alias("some"), X.stock_sum(cells).alias("summed"), X.with_features(c("description"), Foods=c("foods"), Body=c("body")).alias("about")).distinct()


@query(
    r"""SELECT DISTINCT source_product_id, coalesce(sku = source_product_id::VARCHAR OR (sku IS NULL AND source_product_id IS NULL), FALSE) AS same, len(CASE WHEN starts_with(trim(varietals), '[') AND json_valid(varietals) THEN CAST(CAST(varietals AS JSON) AS VARCHAR[]) ELSE [varietals] END) AS n_listed,
 array_to_string(string_split(name, ' ')[2:3], ' ') AS middle FROM products WHERE name IS NOT NULL AND varietals IS NOT NULL"""
)
def value_helpers(spark: SparkSession, d: str) -> DataFrame:
    """Values equal as they are or as text, single values as lists, and a slice of words joined."""
    c = F.col
    p = table(spark, d, "products").where("name is not null and varietals is not null")
    return p.select("source_product_id", X.equal_or_same_text(c("sku"), c("source_product_id").cast("string")).alias("same"), F.size(listed(c("varietals"))).cast("long").alias("n_listed"), X.words_between(F.split("name", " "), F.lit(1), F.lit(3)).alias("middle")).distinct()


#: Beginnings and words of questions and what they ask for.
ASKED = [("i want", "want", True), ("similar to", "similar", False), ("difference", "compare", False), ("compare", "compare", False), ("define", "define", False), ("does", "question-does", True), ("like", "similar", False), ("is", "question-is", True)]
ASKED_SQL = ", ".join(f"('{t}', '{i}', {str(b).upper()})" for t, i, b in ASKED)


@query(f"SELECT doc_id, arg_min(intent, (-length(t), t)) AS intent FROM documents, (VALUES {ASKED_SQL}) x(t, intent, first) WHERE CASE WHEN first THEN starts_with(lower(text), t || ' ') ELSE contains(lower(text), t) END GROUP BY 1")
def sub_intents(spark: SparkSession, d: str) -> DataFrame:
    """What a text asks for: of the phrases that it holds (or begins with) the longest counts."""
    ranked = sorted(ASKED, key=lambda a: (-len(a[0]), a[0]))
    low, hit = F.lower("text"), F.lit(None).cast("string")
    for t, intent, first in reversed(ranked):
        hit = F.when(low.startswith(t + " ") if first else low.contains(t), intent).otherwise(hit)
    return table(spark, d, "documents").select("doc_id", hit.alias("intent")).where("intent is not null")


@query(
    """WITH v AS (SELECT source_product_id, attribute_id, arg_max(value, sav_id) AS v FROM source_attribute_values WHERE attribute_id IN (2, 4) AND trim(value) <> '' GROUP BY 1, 2), p AS (SELECT source_product_id, max(v) FILTER (attribute_id = 2) AS price, max(v) FILTER (attribute_id = 4) AS qoh FROM v GROUP BY 1),
 o AS (SELECT source_product_id, max(qoh) AS n FROM products GROUP BY 1) SELECT source_product_id, price, coalesce(n, p.qoh) AS qoh FROM p LEFT JOIN o USING (source_product_id)"""
)
def vectors_updated(spark: SparkSession, d: str) -> DataFrame:
    """Products' vectors of price and stock put together, a new stock written into them, and read back."""
    keys = ["source_product_id"]
    v = table(spark, d, "source_attribute_values").where("attribute_id in (2, 4) and trim(value) <> ''").groupBy(*keys, "attribute_id").agg(F.max_by("value", "sav_id").alias("value"))
    vectors = R.assemble_vectors(v, keys)
    news = table(spark, d, "products").groupBy(*keys).agg(F.max("qoh").alias("value")).where("value is not null").withColumn("attribute_id", F.lit(4).cast("long"))
    read = R.vector_values(R.update_vectors(vectors, news, keys), keys)
    return read.groupBy(*keys).agg(F.max(F.when(F.col("attribute_id") == 2, F.col("value"))).alias("price"), F.max(F.when(F.col("attribute_id") == 4, F.col("value"))).alias("qoh"))
