"""Queries of the synchronisation jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terroir.plans import sync as S
from terroir.session import table

CENTS = r"CAST(round(TRY_CAST(regexp_replace(trim({}), '^(?:US\$|USD )|[$,]', '', 'g') AS DECIMAL(20,6)) * 100) AS BIGINT)"
#: Codes of the attributes that listings have a column of, by how their values are read.
NODES = "brand region varietals wine_type"
TEXTS = "sku bottle_size vintage description image foods highlights characteristics purpose flaw"
FLOATS = "alcohol_pct body tannin acidity discount_pct"
INTEGERS = "qoh drink_from drink_to"
MONEY = "price msrp"
KEPT = f"""SELECT * FROM (SELECT DISTINCT ON (source_product_id) * FROM products WHERE source_product_id IS NOT NULL ORDER BY source_product_id, loaded_at DESC) WHERE NOT (coalesce(trim(image), '') = '' OR image LIKE '%default_bottle%' OR coalesce(TRY_CAST(qoh AS INTEGER), 0) = 0
 OR regexp_matches(lower(coalesce(name, '')), 'pre-arrival|pre-order|pre-sale|[0-9] pack') OR coalesce(trim(sku), '') = '' OR NOT coalesce({CENTS.format('price')} >= 100, FALSE))"""
CELLS = " UNION ALL ".join(f"SELECT source_product_id, '{c}' AS code, '{k}' AS kind, CAST({c} AS VARCHAR) AS v FROM k" for k, codes in (("node", NODES), ("text", TEXTS), ("float", FLOATS), ("int", INTEGERS), ("money", MONEY)) for c in codes.split())
FULL = f"""WITH k AS ({KEPT}), c AS (SELECT DISTINCT source_product_id, code, kind, nullif(trim(e), '') AS v FROM (SELECT source_product_id, code, kind, unnest(CASE WHEN starts_with(trim(v), '[') AND json_valid(v) THEN CAST(CAST(v AS JSON) AS VARCHAR[]) ELSE [v] END) AS e FROM ({CELLS}))),
 n AS (SELECT a.code, lower(trim(n.name)) AS nm, min(n.id) AS id FROM domain_taxonomy_nodes n JOIN domain_attributes a USING (attribute_id) WHERE parent_id <> 0 GROUP BY 1, 2),
 t AS (SELECT DISTINCT c.source_product_id, c.code, CASE kind WHEN 'node' THEN coalesce(n.id, -1)::VARCHAR WHEN 'text' THEN v WHEN 'float' THEN TRY_CAST(v AS DOUBLE)::VARCHAR WHEN 'int' THEN TRY_CAST(v AS BIGINT)::VARCHAR ELSE ({CENTS.format('v')})::VARCHAR END AS x, kind FROM c LEFT JOIN n ON n.code = c.code AND n.nm = lower(v) WHERE v IS NOT NULL),
 a AS (SELECT source_product_id, count(*) AS n_values, count(*) FILTER (kind = 'node' AND x <> '-1') AS n_nodes FROM t WHERE x IS NOT NULL GROUP BY 1),
 r AS (SELECT source_product_id, count(*) AS n_reviews FROM (SELECT DISTINCT source_product_id, j->>'$.reviewer_name', j->>'$.score_str', j->>'$.content' FROM (SELECT source_product_id, unnest(CAST(json_extract(reviews, '$[*]') AS JSON[])) AS j FROM k WHERE starts_with(trim(reviews), '['))) GROUP BY 1)
 SELECT k.source_id, k.source_product_id, {CENTS.format('price')} AS price_cents, TRY_CAST(qoh AS INTEGER) AS qoh, coalesce(n_values, 0) AS n_values, coalesce(n_nodes, 0) AS n_nodes, coalesce(n_reviews, 0) AS n_reviews FROM k LEFT JOIN a USING (source_product_id) LEFT JOIN r USING (source_product_id)"""
UPDATES = f"""SELECT source_id, single_product_url, arg_max({CENTS.format('price')}, (loaded_at, price)) FILTER ({CENTS.format('price')} IS NOT NULL) AS p, arg_max(CAST(round(TRY_CAST(trim(qoh) AS DOUBLE)) AS INTEGER), (loaded_at, qoh)) FILTER (TRY_CAST(trim(qoh) AS DOUBLE) IS NOT NULL) AS q FROM update_products u
 JOIN (SELECT source_id, max(sequence_id) AS sequence_id FROM pipeline_sequence WHERE state = 'ready' GROUP BY 1) USING (source_id, sequence_id) GROUP BY 1, 2"""
INCREMENTAL = f"""WITH o AS (SELECT source_id, single_product_url, max(source_product_id) AS id, arg_max({CENTS.format('price')}, source_product_id) AS p, arg_max(TRY_CAST(qoh AS INTEGER), source_product_id) AS q FROM ({KEPT}) GROUP BY 1, 2), u AS ({UPDATES}),
 b AS (SELECT source_id, single_product_url, o.id, o.id IS NOT NULL AS known, u.single_product_url IS NOT NULL AS listed, source_id IN (SELECT source_id FROM u) AS ran, o.p AS op, o.q AS oq, coalesce(u.p, o.p) AS p, coalesce(u.q, o.q) AS q FROM o FULL JOIN u USING (source_id, single_product_url))
 SELECT source_id, single_product_url, id AS source_product_id, CASE WHEN NOT known THEN 'new' WHEN NOT ran THEN 'keep' WHEN NOT listed THEN 'delete' WHEN p IS DISTINCT FROM op OR q IS DISTINCT FROM oq THEN 'update' ELSE 'keep' END AS action, p AS price_cents, q AS qoh FROM b"""


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return S.full(table(spark, d, "products"), table(spark, d, "domain_attributes"), table(spark, d, "domain_taxonomy_nodes"))


def _updates(spark: SparkSession, d: str) -> DataFrame:
    """What the last finished run of each source lists: the last stated price and stock of each product."""
    runs = table(spark, d, "pipeline_sequence").where("state = 'ready'").groupBy("source_id").agg(F.max("sequence_id").alias("sequence_id"))
    u = table(spark, d, "update_products").join(runs, ["source_id", "sequence_id"], "left_semi")
    price, qoh = S.cents(F.col("price")), F.round(F.trim("qoh").try_cast("double")).cast("int")
    last = lambda v, c: F.max_by(v, F.when(v.isNotNull(), F.struct("loaded_at", c)))
    return u.groupBy("source_id", "single_product_url").agg(last(price, "price").alias("price_cents"), last(qoh, "qoh").alias("qoh"))


def sync_full(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue of a full run: each product with its offer and the numbers of its attribute rows, resolved nodes and reviews."""
    t = _tables(spark, d)
    key = ["source_id", "source_product_id"]
    values = t["attributes"].groupBy(*key).agg(F.count(F.lit(1)).alias("n_values"), F.count_if(F.col("value_node_id") >= 0).alias("n_nodes"))
    reviews = t["reviews"].groupBy(*key).agg(F.count(F.lit(1)).alias("n_reviews"))
    return t["offers"].drop("single_product_url").join(values, key, "left").join(reviews, key, "left").fillna(0, ["n_values", "n_nodes", "n_reviews"])


def sync_incremental(spark: SparkSession, d: str) -> DataFrame:
    """What an incremental run does with every known or listed product."""
    return S.compare(_tables(spark, d)["offers"], _updates(spark, d))


def sync_after(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each of the catalogue's tables after the incremental run, by source."""
    after = S.incremental(_tables(spark, d), _updates(spark, d))
    counts = [after[t].groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(t)) for t in ("products", "offers", "reviews")]
    gone = after["products"].where("deleted").groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("deleted"))
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(gone)


QUERIES = {f.__name__: f for f in (sync_full, sync_incremental, sync_after)}
ORACLE = {
    "sync_full": FULL,
    "sync_incremental": INCREMENTAL,
    "sync_after": f"""WITH x AS ({INCREMENTAL}), k AS ({KEPT}), g AS (SELECT k.source_id, k.source_product_id, action = 'delete' AS gone FROM k JOIN x USING (source_id, single_product_url)), r AS (SELECT DISTINCT source_id, source_product_id, j->>'$.reviewer_name' AS a, j->>'$.score_str' AS b, j->>'$.content' AS c FROM (SELECT source_id, source_product_id, unnest(CAST(json_extract(reviews, '$[*]') AS JSON[])) AS j FROM k WHERE starts_with(trim(reviews), '[')))
 SELECT source_id, 'products' AS kind, count(*) AS n FROM g GROUP BY 1 UNION ALL SELECT source_id, 'offers', count(*) FROM g WHERE NOT gone GROUP BY 1 UNION ALL SELECT source_id, 'deleted', count(*) FROM g WHERE gone GROUP BY 1 UNION ALL SELECT r.source_id, 'reviews', count(*) FROM r JOIN g USING (source_product_id) WHERE NOT gone GROUP BY 1""",
}
