"""Operators on catalogue records: rule filters, entity-attribute-value rows, keys, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terroir.session import small


def with_reason(df: DataFrame, rules: Sequence[tuple[str, Column]], name: str = "drop_reason") -> DataFrame:
    """Adds the first rule that a row breaks (in the given order), null if none. A null test passes."""
    out = F.lit(None).cast("string")
    for reason, broken in reversed(rules):
        out = F.when(broken, F.lit(reason)).otherwise(out)
    return df.withColumn(name, out)


def shred(df: DataFrame, keys: Sequence[str], attributes: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """Wide rows into rows of keys, code, datatype and one value column per type.

    attributes: (code, datatype, expression). Values that are null, blank or unreadable have no
    row; equal rows occur once.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(t).alias("datatype"), F.nullif(F.trim(x.cast("string")), F.lit("")).alias("v")) for c, t, x in attributes])
    rows = df.select(*keys, F.inline(cells)).where("v is not null")
    typed = {"text": "string", "integer": "bigint", "float": "double", "boolean": "boolean"}
    values = [F.when(F.col("datatype") == t, F.col("v").try_cast(kind)).alias(f"value_{t}") for t, kind in typed.items()]
    cents = F.when(F.col("datatype") == "currency", F.round(F.col("v").try_cast("decimal(20,6)") * 100).cast("bigint")).alias("value_cents")
    out = rows.select(*keys, "code", "datatype", *values, cents)
    return out.where(F.coalesce(*[F.col(c).cast("string") for c in out.columns[len(keys) + 2 :]]).isNotNull()).distinct()


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], take: Sequence[str], last: bool = False) -> DataFrame:
    """keys and `take` of each group's first (or last) row by `order`; combined map-side."""
    pick = (F.max_by if last else F.min_by)(F.struct(*take), F.struct(*order))
    return df.groupBy(*keys).agg(pick.alias("__p")).select(*keys, *[F.col(f"__p.{c}").alias(c) for c in take])


def upsert(known: DataFrame, new: DataFrame, keys: Sequence[str], id_name: str) -> DataFrame:
    """keys and id of every new key: the known id, or one after the largest known, in key order.

    New ids are numbered in partitions by range, with the partitions' offsets added, so that no
    single task numbers all rows.
    """
    distinct = new.select(*keys).where(F.forall(F.array(*[F.col(k).isNotNull() for k in keys]), lambda x: x)).distinct()
    matched = distinct.join(known.groupBy(*keys).agg(F.min(id_name).alias(id_name)), list(keys), "left")
    top = known.agg(F.coalesce(F.max(id_name), F.lit(0))).first()[0]
    fresh = matched.where(F.col(id_name).isNull()).select(*keys)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(1024))
    fresh = fresh.withColumn("__b", bucket)
    sizes = fresh.groupBy("__b").count().withColumn("__off", F.sum("count").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1))).select("__b", F.coalesce("__off", F.lit(0)).alias("__off"))
    numbered = fresh.join(F.broadcast(sizes), "__b").withColumn("__n", F.row_number().over(W.partitionBy("__b").orderBy(*keys)))
    numbered = numbered.select(*keys, (F.lit(top) + F.col("__off") + F.col("__n")).alias(id_name))
    return matched.where(F.col(id_name).isNotNull()).unionByName(numbered)


def without_keys(df: DataFrame, kept: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key isn't among the kept ones (a null key is never kept)."""
    return df.join(kept.select(*on).distinct(), list(on), "left_anti")


def mark_deleted(df: DataFrame, gone: DataFrame, on: str, flag: str = "deleted") -> DataFrame:
    g = gone.select(F.col(on).alias("__g")).distinct().withColumn("__is", F.lit(True))
    return df.join(g, F.col(on) == F.col("__g"), "left").withColumn(flag, F.coalesce("__is", F.lit(False))).drop("__g", "__is")


def resolve(df: DataFrame, value: str, entries: DataFrame, name: str, node: str, missing: int = -1) -> DataFrame:
    """Adds node_id: the entry whose name equals the value apart from case, else `missing`."""
    e = small(entries.groupBy(F.lower(F.trim(name)).alias("__n")).agg(F.min(node).alias("__id")))
    return df.join(e, F.lower(F.trim(value)) == F.col("__n"), "left").withColumn("node_id", F.coalesce("__id", F.lit(missing).cast("long"))).drop("__n", "__id")


def override(df: DataFrame, code: str, rules: DataFrame, target: str, subject: str) -> DataFrame:
    """target replaced by the last rule (by ord) of the code whose pattern occurs in subject.

    rules: attr_code, pattern, attr_value, ord; any number. They are grouped into one value, of all
    rules in order, in which each row of df looks for the last that fits.
    """
    found = rules.where((F.col("attr_code") == code) & (F.col("pattern") != "")).agg(F.array_sort(F.collect_list(F.struct((-F.col("ord")).alias("o"), F.concat(F.lit("(?i)"), "pattern").alias("p"), F.col("attr_value").alias("v")))).alias("__rules"))
    hit = F.get(F.filter("__rules", lambda r: F.rlike(F.coalesce(F.col(subject), F.lit("")), r["p"])), F.lit(0))["v"]
    return df.withColumn("__rules", found.scalar()).withColumn(target, F.coalesce(hit, F.col(target))).drop("__rules")


def combine_same_code(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, code, values (distinct, in order), start, end, relation of attributes with equal code.

    df: keys, code, value, start, end. More than one value: $between for price, else $in.
    """
    g = df.groupBy(*keys, "code").agg(F.array_sort(F.collect_list(F.struct("start", "value"))).alias("__v"), F.min("start").alias("start"), F.max("end").alias("end"))
    values = F.array_distinct(F.transform("__v", lambda x: x["value"]))
    return g.select(*keys, "code", values.alias("values"), "start", "end").withColumn("relation", F.when(F.size("values") < 2, "$eq").when(F.col("code") == "price", "$between").otherwise("$in"))


def islands(df: DataFrame, keys: Sequence[str], pos: str, item: str) -> DataFrame:
    """keys, first_pos, items of each maximal run of consecutive positions."""
    over = W.partitionBy(*keys).orderBy(pos)
    runs = df.withColumn("__i", F.col(pos) - F.row_number().over(over))
    return runs.groupBy(*keys, "__i").agg(F.min(pos).alias("first_pos"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, item))), lambda x: x[item]), " ").alias("items")).drop("__i")


def run_lengths(df: DataFrame, keys: Sequence[str], pos: str, other: str) -> DataFrame:
    """keys, longest, last: lengths of the runs in which pos and other both go up by one from row to
    row (in the order of pos). Runs are keyed by where they start, so a group needs no array."""
    over = W.partitionBy(*keys).orderBy(pos)
    goes = (F.col(pos) == F.lag(pos).over(over) + 1) & (F.col(other) == F.lag(other).over(over) + 1)
    runs = df.withColumn("__new", (~F.coalesce(goes, F.lit(False))).cast("long")).withColumn("__run", F.sum("__new").over(over))
    n = runs.groupBy(*keys, "__run").agg(F.count(F.lit(1)).alias("__n"))
    return n.groupBy(*keys).agg(F.max("__n").alias("longest"), F.max_by("__n", "__run").alias("last"))


def aggregate_score(df: DataFrame, keys: Sequence[str], score: str, modifier: str) -> DataFrame:
    """Mean of score + modifier over scores that are neither null nor 0; groups without any have no row."""
    return df.where(F.col(score).isNotNull() & (F.col(score) != 0)).groupBy(*keys).agg(F.avg(F.col(score) + F.coalesce(modifier, F.lit(0.0))).alias("rating"), F.count(F.lit(1)).alias("n_scores"))


def mean_vector(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Element-wise mean of arrays (empty and null ones are left out), an element a row while it is computed."""
    cells = df.where(F.size(vector) > 0).select(*keys, F.posexplode(vector).alias("__i", "__x"))
    means = cells.groupBy(*keys, "__i").agg(F.avg("__x").alias("__m"))
    return means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__i", "__m"))).alias("__v")).select(*keys, F.transform("__v", lambda x: x["__m"]).alias("vector"))


VECTOR = "struct<attributes:array<struct<attr_id:bigint,values:array<struct<v_orig:string>>>>>"


def assemble_vectors(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, vector: the attribute values (attribute_id, value) of each entity as one JSON text."""
    one = values.where(F.col("value").isNotNull()).select(*keys, F.struct(F.col("attribute_id").cast("long").alias("attr_id"), F.array(F.struct(F.col("value").alias("v_orig"))).alias("values")).alias("a"))
    return one.groupBy(*keys).agg(F.to_json(F.struct(F.array_sort(F.collect_list("a")).alias("attributes"))).alias("vector"))


def update_vectors(vectors: DataFrame, news: DataFrame, keys: Sequence[str]) -> DataFrame:
    """vectors with the new values (attribute_id, value) of those entities that have a vector with the attribute."""
    new = news.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("attribute_id").cast("long"), "value"))).alias("__new"))
    both = vectors.join(new, list(keys), "left").withColumn("__v", F.from_json("vector", VECTOR))
    put = F.transform(F.col("__v.attributes"), lambda a: F.struct(a["attr_id"].alias("attr_id"), F.coalesce(F.when(F.col("__new").isNotNull() & F.map_contains_key("__new", a["attr_id"]), F.array(F.struct(F.col("__new")[a["attr_id"]].alias("v_orig")))), a["values"]).alias("values")))
    return both.select(*keys, F.to_json(F.struct(put.alias("attributes"))).alias("vector"))


def vector_values(vectors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, attribute_id, value: the first value of each attribute of the vectors."""
    rows = vectors.select(*keys, F.explode(F.from_json("vector", VECTOR)["attributes"]).alias("a"))
    return rows.select(*keys, F.col("a.attr_id").alias("attribute_id"), F.get("a.values", F.lit(0))["v_orig"].alias("value"))
