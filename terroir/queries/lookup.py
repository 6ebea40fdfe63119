"""Queries over the dictionary and the attribute lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terroir.operators import dictionary as D
from terroir.operators.lookup import Index, count_candidates, find_attributes, load, lookup
from terroir.queries import sqltext as Q
from terroir.session import table

#: Entries and their words in SQL, by the cleaning steps written out there.
ENTRIES_SQL = f"""SELECT *, {Q.lookup_words("text")} AS words FROM (SELECT id AS entity_id, code, n.name AS base, unnest(list_concat([n.name], CAST(CAST(n.aliases AS JSON) AS VARCHAR[]))) AS text FROM domain_taxonomy_nodes n JOIN domain_attributes a USING (attribute_id) WHERE parent_id <> 0)"""
IDF_SQL = f"""SELECT token, count(*) AS df, ln((1 + (SELECT count(*) FROM ({ENTRIES_SQL}))) / (1.0 + count(*))) + 1 AS idf FROM (SELECT unnest(list_distinct(words)) AS token FROM ({ENTRIES_SQL})) GROUP BY 1"""
WEIGHED_SQL = f"""WITH e AS ({ENTRIES_SQL}), i AS ({IDF_SQL}), c AS (SELECT quantile_cont(idf::DOUBLE, 0.0007) AS cut FROM i), w AS (SELECT entity_id, code, text, unnest(words) AS token FROM e)
 SELECT entity_id, code, text, sum(idf) * 1.25 * CASE WHEN count(*) > 1 THEN 1 + 0.5 * count(*) ELSE 1 END AS max_idf,
 CASE WHEN count(DISTINCT token[1:3]) = count(DISTINCT token[1:3]) FILTER (idf < cut) THEN '' ELSE coalesce(string_agg(DISTINCT token[1:3], ',' ORDER BY token[1:3]) FILTER (idf < cut), '') END AS insufficient FROM w JOIN i USING (token), c GROUP BY 1, 2, 3"""
ORACLE: dict[str, str] = {}
QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return D.lookup_form(D.entries_of(table(spark, d, "domain_taxonomy_nodes"), table(spark, d, "domain_attributes")))


def _weighed(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d)
    return D.weigh(e, D.inverse_frequencies(e))


@query(f"SELECT token, df, round(idf, 9) AS idf FROM ({IDF_SQL})")
def dict_idf(spark: SparkSession, d: str) -> DataFrame:
    return D.inverse_frequencies(_entries(spark, d)).withColumn("idf", F.round("idf", 9))


@query(f"SELECT round(quantile_cont(idf::DOUBLE, 0.0007), 9) AS cutoff FROM ({IDF_SQL})")
def dict_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return D.cutoff(D.inverse_frequencies(_entries(spark, d))).select(F.round("cutoff", 9).alias("cutoff"))


@query(f"SELECT entity_id, code, text, round(max_idf, 6) AS max_idf, insufficient FROM ({WEIGHED_SQL})")
def dict_max_idf(spark: SparkSession, d: str) -> DataFrame:
    return _weighed(spark, d).select("entity_id", "code", "text", F.round("max_idf", 6).alias("max_idf"), F.array_join("insufficient", ",").alias("insufficient"))


@query(f"SELECT token[1:3] AS prefix, string_agg(DISTINCT entity_id::VARCHAR, ',' ORDER BY entity_id::VARCHAR) AS ids FROM (SELECT entity_id, unnest(words) AS token FROM ({ENTRIES_SQL})) GROUP BY 1")
def dict_index(spark: SparkSession, d: str) -> DataFrame:
    return D.prefix_index(_entries(spark, d)).select("prefix", F.array_join(F.array_sort(F.col("ids").cast("array<string>")), ",").alias("ids"))


@query(
    f"""WITH w AS ({WEIGHED_SQL}), t AS (SELECT array_to_string(e.words, ' ') AS tx, e.entity_id, e.code, w.max_idf FROM ({ENTRIES_SQL}) e JOIN w ON w.entity_id = e.entity_id AND w.code = e.code AND w.text = e.text),
 r AS (SELECT *, row_number() OVER o AS r, first_value(code) OVER o AS fc FROM t WINDOW o AS (PARTITION BY tx ORDER BY max_idf DESC, entity_id)) SELECT tx AS text, string_agg(entity_id::VARCHAR, ',' ORDER BY r) AS ids FROM r WHERE r = 1 OR code <> fc GROUP BY 1"""
)
def dict_text_ids(spark: SparkSession, d: str) -> DataFrame:
    return D.text_ids(_weighed(spark, d)).select("text", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


#: Distinct typed places with their words, common ones left out.
VALUES_SQL = f"SELECT v, list_filter(string_split_regex(replace({Q.cleanup('v')}, '$', 'dollar'), '[\\s\\pZ]+'), lambda w: w <> '' AND NOT list_contains([{Q.COMMON}], w)) AS words FROM (SELECT DISTINCT region AS v FROM products WHERE trim(region) <> '')"


def _dictionary(spark: SparkSession, d: str) -> D.Dictionary:
    return D.build(table(spark, d, "domain_taxonomy_nodes"), table(spark, d, "domain_attributes"))


def _index(spark: SparkSession, d: str) -> Index:
    return load(_dictionary(spark, d))


def _values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "products").select(F.col("region").alias("v")).where(F.trim("v") != "").distinct()


@query(
    f"""WITH e AS ({ENTRIES_SQL}), w AS ({WEIGHED_SQL}), x AS (SELECT array_to_string(e.words, ' ') AS t, e.entity_id, max_idf FROM e JOIN w ON w.entity_id = e.entity_id AND w.code = e.code AND w.text = e.text)
 SELECT v, arg_min(entity_id, (-max_idf, entity_id)) AS entity_id FROM ({VALUES_SQL}) q JOIN x ON array_to_string(q.words, ' ') = t WHERE len(q.words) > 0 GROUP BY 1"""
)
def lookup_exact(spark: SparkSession, d: str) -> DataFrame:
    """Values whose words are those of an entry, by the lookup's own cover: of several entries the weightiest, then the smallest id."""
    return lookup(_values(spark, d), "v", _index(spark, d)).where("score = 1000").select("v", "entity_id")


@query(
    f"""WITH e AS ({ENTRIES_SQL}), w AS ({WEIGHED_SQL}), v AS ({VALUES_SQL}), q AS (SELECT DISTINCT v, unnest(words)[1:3] AS p FROM v), x AS (SELECT DISTINCT entity_id, code, text, unnest(words) AS word FROM e),
 hit AS (SELECT v, entity_id FROM q JOIN x ON x.word[1:3] = q.p JOIN w USING (entity_id, code, text) WHERE NOT list_contains(string_split(w.insufficient, ','), p)),
 far AS (SELECT v, entity_id FROM v JOIN x ON x.word[1:1] = words[1][1:1] WHERE v NOT IN (SELECT v FROM hit)) SELECT v.v, count(DISTINCT h.entity_id) AS n_candidates FROM v LEFT JOIN (SELECT * FROM hit UNION ALL SELECT * FROM far) h USING (v) GROUP BY 1"""
)
def lookup_candidates(spark: SparkSession, d: str) -> DataFrame:
    """How many entities share a sufficient prefix with each value; if none, its first letter."""
    return count_candidates(_values(spark, d), "v", _index(spark, d))


@query()
def lookup_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Houses, places, grapes and kinds found in the names of all listings."""
    out = find_attributes(table(spark, d, "products"), "name", _dictionary(spark, d), fuzzy=True)
    return out.withColumn("score", F.round("score", 6))
