"""Attributes, ratings and a summary of products from their reviews, names and descriptions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terroir.functions.fields import score_number
from terroir.functions.text import sentences
from terroir.operators.lookup import Index, lookup
from terroir.operators.summary import summarize
from terroir.session import cut

REVIEW = "array<struct<reviewer_name:string,score_str:string,content:string>>"
#: Texts of up to so many characters say nothing.
SHORT = 5


@dataclass(frozen=True)
class Rule:
    """What is extracted for an attribute: by patterns (float: the first group; boolean: a match), by
    the dictionary (entries of that code), from sentences and from names or not."""

    attribute_id: int
    code: str
    datatype: str
    patterns: tuple[str, ...] = ()
    dictionary: bool = False
    sentences: bool = True
    names: bool = False

    def __post_init__(self) -> None:
        if self.patterns and self.datatype not in ("float", "boolean"):
            raise ValueError(f"patterns can't give a {self.datatype}: {self.code}")


def plan(rules: Sequence[Rule], needed: Sequence[str] = ("rating", "short_desc")) -> dict[str, Rule]:
    """Rules by code; an error if there are none or a needed attribute is missing."""
    out = {r.code: r for r in rules}
    missing = [c for c in needed if c not in out]
    if missing:
        raise ValueError(f"no attribute {', '.join(missing)}")
    return out


def without_stop_words(c: Column, stop: Sequence[str]) -> Column:
    """Lower-case words but the stop words, joined by single blanks."""
    words = F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda w: w != "")
    return F.array_join(F.filter(words, lambda w: ~w.isin(list(stop))) if stop else words, " ")


def blocks(products: DataFrame, key: str) -> DataFrame:
    """key, block, origin (review, description, name), text: what is read of each product.

    A review without content is read as the description. Products delivered twice with equal texts
    count once.
    """
    reviews = products.where(F.trim("reviews").startswith("[")).select(key, "description", F.posexplode(F.from_json(F.trim("reviews"), REVIEW)).alias("block", "r"))
    empty = F.col("r.content").isNull() | F.col("r.content").rlike("^[\"'\\s]*$")
    said = reviews.select(key, "block", F.lit("review").alias("origin"), F.when(empty, F.col("description")).otherwise(F.col("r.content")).alias("text"))
    about = products.select(key, F.lit(1_000_000).alias("block"), F.lit("description").alias("origin"), F.col("description").alias("text"))
    names = products.select(key, F.lit(-1).alias("block"), F.lit("name").alias("origin"), F.col("name").alias("text"))
    return said.unionByName(about).unionByName(names).where(F.length(F.trim("text")) > 0).distinct()


def split(texts: DataFrame) -> DataFrame:
    """One row a sentence (pos, sentence); a name is one sentence, short sentences are left out."""
    parts = F.when(F.col("origin") == "name", F.array("text")).otherwise(sentences(F.col("text")))
    return texts.select("*", F.posexplode(parts).alias("pos", "sentence")).drop("text").where((F.col("origin") == "name") | (F.length("sentence") > SHORT))


def _pattern_cells(rules: Sequence[Rule], text: Column) -> Column:
    cells = []
    for r in rules:
        for p in r.patterns:
            number = F.regexp_extract(text, f"(?i){p}", 1).try_cast("double") if r.datatype == "float" else F.lit(None).cast("double")
            truth = F.lit(True) if r.datatype == "boolean" else F.lit(None).cast("boolean")
            cells.append(F.when(text.rlike(f"(?i){p}"), F.struct(F.lit(r.attribute_id).cast("long").alias("attribute_id"), F.lit(r.code).alias("code"), F.lit(r.datatype).alias("datatype"), F.lit(None).cast("long").alias("value_node_id"), number.alias("value_float"), truth.alias("value_boolean"))))
    kind = "array<struct<attribute_id:bigint,code:string,datatype:string,value_node_id:bigint,value_float:double,value_boolean:boolean>>"
    return F.filter(F.array(*cells).cast(kind), lambda x: x.isNotNull()) if cells else F.array().cast(kind)


def extract(products: DataFrame, rules: Sequence[Rule], *, key: str = "source_product_id", index: Index | None = None, stop: Sequence[str] = (), reviewers: DataFrame | None = None, budget: int = 50) -> DataFrame:
    """key, origin, attribute_id, code, datatype, value_node_id, value_float, value_boolean, value_text.

    From each sentence of reviews and descriptions and from each name: attributes whose patterns
    occur and entries that the dictionary index finds, for the codes that the rules allow there; once
    a product and origin. Beside them (origin 'product') the mean review score, changed by each
    reviewer's modifier (reviewers: name, modifier), and a summary: the block whose sentences name
    most attributes, within the budget of words. Values of other codes are by-catch and left out.
    """
    by_code = plan(rules)
    texts = cut(split(blocks(products, key)).withColumn("read", without_stop_words(F.col("sentence"), stop)))
    at_name = F.col("origin") == "name"
    cells = F.when(at_name, _pattern_cells([r for r in rules if r.names], F.col("read"))).otherwise(_pattern_cells([r for r in rules if r.sentences], F.col("read")))
    place = [key, "origin", "block", "pos"]
    found = texts.select(*place, F.inline(cells))
    if index is not None:
        named = {r.code: r for r in rules if r.dictionary}
        allowed = F.lit(False)
        for where, codes in ((at_name, [c for c, r in named.items() if r.names]), (~at_name, [c for c, r in named.items() if r.sentences])):
            allowed = allowed | (where & F.col("code").isin(codes))
        ids = F.create_map(*[F.lit(x) for c, r in named.items() for x in (c, r.attribute_id)]) if named else F.create_map(F.lit(""), F.lit(-1))
        entries = lookup(texts, "read", index, codes=set(named), single_brand=False)
        hits = texts.join(entries, "read").where(allowed)
        found = found.unionByName(hits.select(*place, ids[F.col("code")].cast("long").alias("attribute_id"), "code", F.lit("node_id").alias("datatype"), F.col("entity_id").alias("value_node_id"), F.lit(None).cast("double").alias("value_float"), F.lit(None).cast("boolean").alias("value_boolean")))
    found = cut(found)
    values = found.drop("block", "pos").distinct().withColumn("value_text", F.lit(None).cast("string"))
    rated = products.where(F.trim("reviews").startswith("[")).select(key, F.inline(F.from_json(F.trim("reviews"), REVIEW))).distinct()
    score = score_number(F.col("score_str"))
    rated = rated.select(key, "reviewer_name", score.alias("score")).where((F.col("score") >= 70))
    if reviewers is not None:
        rated = rated.join(F.broadcast(reviewers.groupBy(F.col("name").alias("reviewer_name")).agg(F.max("modifier").alias("modifier"))), "reviewer_name", "left")
    else:
        rated = rated.withColumn("modifier", F.lit(0.0))
    mean = rated.groupBy(key).agg(F.avg(F.col("score") + F.coalesce("modifier", F.lit(0.0))).alias("value_float"))

    def whole(df: DataFrame, code: str, datatype: str, **value: Column) -> DataFrame:
        kinds = {"value_node_id": "long", "value_float": "double", "value_boolean": "boolean", "value_text": "string"}
        cols = [value.get(c, F.lit(None).cast(t)).alias(c) for c, t in kinds.items()]
        return df.select(key, F.lit("product").alias("origin"), F.lit(by_code[code].attribute_id).cast("long").alias("attribute_id"), F.lit(code).alias("code"), F.lit(datatype).alias("datatype"), *cols)

    marked = found.select(*place).distinct().withColumn("hit", F.lit(1.0))
    scored = texts.where(~at_name).join(marked, place, "left").groupBy(key, F.col("block").cast("long").alias("ord")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("sentence").alias("text"), F.coalesce("hit", F.lit(0.0)).alias("score")))), lambda x: F.struct(x["text"].alias("text"), x["score"].alias("score"))).alias("sentences"))
    short = summarize(scored, key, budget).where(F.length("summary") > 0)
    return values.unionByName(whole(mean, "rating", "float", value_float=F.col("value_float"))).unionByName(whole(short, "short_desc", "text", value_text=F.col("summary")))
