"""A weighted dictionary of entity names: inverse document frequencies, prefix index, text index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terroir.functions.text import cleanup, without_common_words
from terroir.session import small

#: Fixed values of the scoring.
PERFECT_BONUS, NGRAM_BONUS, CUTOFF_SHARE = 1.25, 0.5, 0.0007


@dataclass(frozen=True)
class Dictionary:
    """entries: entity_id, code, base, text, words, word_count, max_idf, insufficient (prefixes)."""

    entries: DataFrame
    idf: DataFrame
    index: DataFrame


def entries_of(nodes: DataFrame, attributes: DataFrame) -> DataFrame:
    """entity_id, code, text of every name and alias of the list; roots are left out."""
    a = small(attributes.select("attribute_id", "code"))
    names = F.concat(F.array("name"), F.coalesce(F.from_json("aliases", "array<string>"), F.array().cast("array<string>")))
    return nodes.where("parent_id <> 0").join(a, "attribute_id").select(F.col("id").alias("entity_id"), "code", F.col("name").alias("base"), F.explode(names).alias("text"))


def lookup_form(entries: DataFrame) -> DataFrame:
    """Adds words and word_count of the cleaned text; a text of nothing but common words stays as it is."""
    cleaned = without_common_words(cleanup(F.col("text")))["text"]
    words = F.split(F.coalesce(F.nullif(cleaned, F.lit("")), F.lower("text")), " ")
    return entries.withColumn("words", words).withColumn("word_count", F.size("words"))


def inverse_frequencies(entries: DataFrame) -> DataFrame:
    """token, df, idf = ln((1 + n) / (1 + df)) + 1 over entries with words."""
    n = entries.count()
    df = entries.select(F.explode(F.array_distinct("words")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.select("token", "df", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))


def cutoff(idf: DataFrame, share: float = CUTOFF_SHARE) -> DataFrame:
    return idf.agg(F.percentile("idf", F.lit(share)).alias("cutoff"))


def weigh(entries: DataFrame, idf: DataFrame, share: float = CUTOFF_SHARE) -> DataFrame:
    """Adds key, max_idf and the prefixes too frequent to find the entry by (none if all are)."""
    keyed = entries.withColumn("key", F.xxhash64("entity_id", "code", "text"))
    words = keyed.select("key", F.explode("words").alias("token")).join(idf, "token").withColumn("cutoff", F.lit(cutoff(idf, share).first()[0]))
    g = words.groupBy("key").agg(F.sum("idf").alias("s"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.when(F.col("idf") < F.col("cutoff"), F.substring("token", 1, 3)))).alias("low"), F.collect_set(F.substring("token", 1, 3)).alias("all"))
    bonus = PERFECT_BONUS * F.when(F.col("n") > 1, 1 + NGRAM_BONUS * F.col("n")).otherwise(1.0)
    g = g.select("key", (F.col("s") * bonus).alias("max_idf"), F.when(F.size("low") == F.size("all"), F.array().cast("array<string>")).otherwise(F.col("low")).alias("insufficient"))
    return keyed.join(g, "key")


def prefix_index(entries: DataFrame) -> DataFrame:
    """prefix, ids: the entities that have a word with these first three characters."""
    return entries.select(F.explode(F.array_distinct(F.transform("words", lambda w: F.substring(w, 1, 3)))).alias("prefix"), "entity_id").groupBy("prefix").agg(F.array_sort(F.collect_set("entity_id")).alias("ids"))


def text_ids(weighed: DataFrame) -> DataFrame:
    """text, ids: by max_idf; after the first only entities of another code than the first one's."""
    order = W.partitionBy("t").orderBy(F.desc("max_idf"), "entity_id")
    rows = weighed.select(F.array_join("words", " ").alias("t"), "entity_id", "code", "max_idf").withColumn("r", F.row_number().over(order)).withColumn("first", F.first("code").over(order))
    kept = rows.where((F.col("r") == 1) | (F.col("code") != F.col("first")))
    return kept.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("r", "entity_id"))).alias("x")).select(F.col("t").alias("text"), F.transform("x", lambda x: x["entity_id"]).alias("ids"))


def build(nodes: DataFrame, attributes: DataFrame) -> Dictionary:
    entries = lookup_form(entries_of(nodes, attributes))
    idf = inverse_frequencies(entries)
    return Dictionary(weigh(entries, idf), idf, prefix_index(entries))
