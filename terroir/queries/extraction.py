"""Queries that take attributes out of free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terroir.functions.text import sentences
from terroir.operators import dictionary as D
from terroir.operators import extraction as E
from terroir.operators.lookup import Index, attribute_lookup, load, lookup
from terroir.queries import sqltext as Q
from terroir.queries import text as T
from terroir.session import table

#: Attributes by pattern, as (code, datatype, RE2 and Java pattern).
PATTERNS = [("barrel_months", "float", r"(\d+) months in barrels"), ("vine_age", "float", r"about (\d+) years old"), ("wild_yeast", "boolean", r"wild yeast"), ("whole_bunch", "boolean", r"whole bunches")]
NEAR = "SELECT doc_id, code, CASE WHEN dt = 'float' THEN TRY_CAST(regexp_extract(text, p, 1) AS DOUBLE) END AS value_float, CASE WHEN dt = 'boolean' THEN TRUE END AS value_boolean FROM documents, (VALUES {}) x(code, dt, p) WHERE regexp_matches(text, p)".format(", ".join(f"('{c}', '{t}', '{p}')" for c, t, p in PATTERNS))


def pattern_cells(text: str) -> Column:
    """Array of (code, value_float, value_boolean) of the patterns that occur in a text."""
    cells = F.array(*[F.when(F.col(text).rlike(p), F.struct(F.lit(c).alias("code"), (F.regexp_extract(text, p, 1).try_cast("double") if t == "float" else F.lit(None).cast("double")).alias("value_float"), (F.lit(True) if t == "boolean" else F.lit(None).cast("boolean")).alias("value_boolean"))) for c, t, p in PATTERNS])
    return F.filter(cells, lambda x: x.isNotNull())


def extract_typed_rows(spark: SparkSession, d: str) -> DataFrame:
    """One typed row for each attribute whose pattern occurs in a text."""
    return table(spark, d, "documents").select("doc_id", F.inline(pattern_cells("text")))


def named(texts: DataFrame, keys: list[str], index: Index) -> DataFrame:
    """keys, code, entity_id, value, n: houses, places and grapes that sentences name, in any language."""
    found = lookup(texts, "sentence", index, single_brand=False).where("code in ('brand', 'region', 'varietals')")
    return texts.join(found, "sentence").groupBy(*keys, "code", "entity_id", "value").agg(F.count(F.lit(1)).alias("n"))


def split(texts: DataFrame) -> DataFrame:
    """Sentences of more than five characters in place of text."""
    return texts.withColumn("sentence", F.explode(sentences(F.col("text")))).drop("text").where("length(sentence) > 5")


def extract_from_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Houses, places and grapes that the sentences of a text name, each once a document."""
    index = load(D.build(table(spark, d, "domain_taxonomy_nodes"), table(spark, d, "domain_attributes")))
    return named(split(table(spark, d, "documents").select("doc_id", "text")), ["doc_id"], index)


#: What the job looks for in the test tables' texts.
RULES = [
    E.Rule(21, "rating", "float"),
    E.Rule(13, "short_desc", "text"),
    E.Rule(25, "cases_made", "float", (r"(\d+) cases",)),
    E.Rule(10, "alcohol_pct", "float", (r"(\d+(?:\.\d+)?) ?%",), names=True),
    E.Rule(31, "styles", "boolean", ("whole bunch", "wild yeast")),
    E.Rule(28, "is_organic", "boolean", ("organic",), names=True),
    E.Rule(5, "brand", "text", dictionary=True),
    E.Rule(6, "region", "text", dictionary=True),
    E.Rule(7, "varietals", "text", dictionary=True, names=True),
]
#: Words left out before patterns and dictionary are tried.
STOP = ("with", "that", "this", "very")


def extract_from_products(spark: SparkSession, d: str) -> DataFrame:
    """The whole extraction job over reviews, names and descriptions, in any language, with the dictionary."""
    index = load(D.build(table(spark, d, "domain_taxonomy_nodes"), table(spark, d, "domain_attributes")))
    return E.extract(table(spark, d, "products"), RULES, index=index, stop=STOP)


def extract_job(spark: SparkSession, d: str) -> DataFrame:
    """The extraction job without the dictionary: patterns, rating and summary of each product."""
    out = E.extract(table(spark, d, "products"), RULES, stop=STOP)
    return out.drop("value_node_id").withColumn("value_float", F.round("value_float", 6))


def lookup_with_codes(spark: SparkSession, d: str) -> DataFrame:
    """Typed places and the words that no place of the list takes, for exact readings of the whole value."""
    index = load(D.build(table(spark, d, "domain_taxonomy_nodes"), table(spark, d, "domain_attributes")))
    v = table(spark, d, "products").select(F.col("region").alias("v")).where("trim(v) <> ''").distinct()
    return attribute_lookup(v, "v", index, codes=["region"]).select("v", F.to_json("attributes").alias("attributes"), F.array_join("extra_words", " ").alias("extra_words"))


QUERIES = {f.__name__: f for f in (extract_typed_rows, extract_from_sentences, extract_from_products, extract_job, lookup_with_codes)}
REVIEWED = "SELECT DISTINCT source_product_id, description, j, generate_subscripts(j, 1) - 1 AS block FROM (SELECT DISTINCT source_product_id, description, CAST(json_extract(reviews, '$[*]') AS JSON[]) AS j FROM products WHERE starts_with(trim(reviews), '['))"
BLOCKS = rf"""SELECT DISTINCT * FROM (SELECT source_product_id, block, 'review' AS origin, CASE WHEN coalesce(regexp_matches(r->>'$.content', '^["''\s]*$'), TRUE) THEN description ELSE r->>'$.content' END AS text FROM (SELECT *, j[block + 1] AS r FROM ({REVIEWED})) UNION ALL SELECT source_product_id, 1000000, 'description', description FROM products UNION ALL SELECT source_product_id, -1, 'name', name FROM products) WHERE trim(text) <> ''"""
CUT = f"SELECT *, CASE WHEN origin = 'name' THEN [text] ELSE ss END AS parts FROM ({Q.sentences(BLOCKS, 'text')})"
READ = f"SELECT source_product_id, block, origin, pos - 1 AS pos, parts[pos] AS sentence, array_to_string(list_filter(string_split_regex(lower(parts[pos]), '[\\s\\pZ]+'), lambda w: w <> '' AND w NOT IN ('with', 'that', 'this', 'very')), ' ') AS read FROM (SELECT *, unnest(generate_series(1, len(parts))) AS pos FROM ({CUT})) WHERE origin = 'name' OR length(parts[pos]) > 5"
TRIED = r"(VALUES (25, 'cases_made', 'float', '(\d+) cases', FALSE), (10, 'alcohol_pct', 'float', '(\d+(?:\.\d+)?) ?%', TRUE), (31, 'styles', 'boolean', 'whole bunch', FALSE), (31, 'styles', 'boolean', 'wild yeast', FALSE), (28, 'is_organic', 'boolean', 'organic', TRUE)) t(attribute_id, code, datatype, p, names)"
HITS = f"SELECT s.source_product_id, s.origin, s.block, s.pos, t.attribute_id, t.code, t.datatype, CASE WHEN datatype = 'float' THEN TRY_CAST(regexp_extract(read, '(?i)' || p, 1) AS DOUBLE) END AS value_float, CASE WHEN datatype = 'boolean' THEN TRUE END AS value_boolean FROM s JOIN {TRIED} ON regexp_matches(read, '(?i)' || p) AND (origin <> 'name' OR names)"
RATED = "SELECT source_product_id, avg(n) AS value_float FROM (SELECT DISTINCT source_product_id, j->>'$.reviewer_name' AS a, j->>'$.score_str' AS b, j->>'$.content' AS c, TRY_CAST(split_part(replace(j->>'$.score_str', '+', ''), '-', -1) AS INTEGER) AS n FROM (SELECT DISTINCT source_product_id, unnest(CAST(json_extract(reviews, '$[*]') AS JSON[])) AS j FROM products WHERE starts_with(trim(reviews), '['))) WHERE n >= 70 GROUP BY 1"
SCORED = "SELECT source_product_id AS key, block AS doc_id, list(sentence ORDER BY pos, sentence, hit) AS ss, list(hit ORDER BY pos, sentence, hit) AS scores FROM (SELECT s.source_product_id, s.block, s.pos, s.sentence, CAST(EXISTS (SELECT 1 FROM h WHERE h.source_product_id = s.source_product_id AND h.origin = s.origin AND h.block = s.block AND h.pos = s.pos) AS DOUBLE) AS hit FROM s WHERE origin <> 'name') GROUP BY 1, 2"
BEST = f"SELECT key, arg_max(text, (score, -doc_id)) AS text, max(score) AS score FROM (SELECT key, doc_id, array_to_string(list_transform(k, lambda j: ss[j]), ' ') AS text, coalesce(list_sum(list_transform(k, lambda j: scores[j])), 0) AS score FROM ({T.BLOCKS_SQL.format(SCORED)})) GROUP BY 1"
SHORTENED = f"SELECT key, CASE WHEN {T.FIT_SUMMARY_SQL} THEN text ELSE trim(array_to_string(list_transform(list_filter(ss, lambda s: {T.FIT_SENTENCE_SQL.format(s='s')}), lambda s: trim(s)), ' ')) END AS summary FROM ({Q.sentences(BEST, 'text', False)})"
JOB = f"""WITH s AS MATERIALIZED ({READ}), h AS MATERIALIZED ({HITS}) SELECT DISTINCT source_product_id, origin, attribute_id, code, datatype, round(value_float, 6) AS value_float, value_boolean, CAST(NULL AS VARCHAR) AS value_text FROM h
 UNION ALL SELECT source_product_id, 'product', 21, 'rating', 'float', round(value_float, 6), NULL, NULL FROM ({RATED}) UNION ALL SELECT key, 'product', 13, 'short_desc', 'text', NULL, NULL, summary FROM ({SHORTENED}) WHERE length(summary) > 0"""
ORACLE = {"extract_typed_rows": NEAR, "extract_job": JOB}
