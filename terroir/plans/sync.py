"""Full and incremental synchronisation of a catalogue's sources, as DataFrame jobs.

A catalogue is a set of tables, each with source_id: products (the last record of each), offers
(price and stock), attributes (typed attribute rows) and reviews. A full run builds a source's
tables anew; an incremental one compares a list of offers with what is known, writes back the
changed ones and removes what is no longer listed. Tables are stored by source, so a run rewrites
the folders of its sources only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terroir.functions import fields as X
from terroir.operators import records as R
from terroir.operators.wide import attribute_list
from terroir.session import is_folder, small
from terroir.sources.tables import write_partitions

TABLES = ("products", "offers", "attributes", "reviews")
REVIEW = "array<struct<reviewer_name:string,score_str:string,content:string>>"


def cents(price: Column) -> Column:
    """A price in cents, dollar signs and commas off; null if the rest is no number."""
    return F.round(F.regexp_replace(F.trim(price), r"^(?:US\$|USD )|[$,]", "").try_cast("decimal(20,6)") * 100).cast("long")


def latest(records: DataFrame, key: str = "source_product_id", at: str = "loaded_at") -> DataFrame:
    """The last delivered record of each key (ties: the largest record); rows without key are left out."""
    columns = [c for c in records.columns if c != key]
    return records.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(at, *[c for c in columns if c != at])).alias("r")).select(key, "r.*")


def rules() -> list[tuple[str, Column]]:
    """What a record must not be: the reasons in their order. Null values fail where a value is needed."""
    c, name = F.col, F.lower(F.coalesce("name", F.lit("")))
    blank = lambda x: x.isNull() | (F.trim(x) == "")
    stock = c("qoh").try_cast("int")
    return [
        ("image", blank(c("image")) | c("image").contains("default_bottle")),
        ("no stock", stock.isNull() | (stock == 0)),
        ("pre-arrival", name.rlike("pre-arrival|pre-order|pre-sale")),
        ("multipack", name.rlike("[0-9] pack")),
        ("no sku", blank(c("sku"))),
        ("price", ~F.coalesce(cents(c("price")) >= 100, F.lit(False))),
    ]


def listed(c: Column) -> Column:
    """The elements of a JSON array of texts; any other text is one element."""
    parsed = F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>"))
    return F.coalesce(parsed, F.array(c))


def attribute_rows(records: DataFrame, keys: Sequence[str], domain_attributes: DataFrame, nodes: DataFrame) -> DataFrame:
    """keys, attribute_id, datatype, value_node_id, value_text, value_integer, value_float,
    value_cents, value_boolean: one row for each element of each attribute that the records have a
    column of. Attributes with a list get the node of that name (-1 if there is none). Blank and
    unreadable values have no row; equal rows of a record occur once.
    """
    taxonomy = {r.attribute_id for r in domain_attributes.where("has_taxonomy").select("attribute_id").distinct().toLocalIterator()}
    known = [a for a in attribute_list(domain_attributes) if a.code in records.columns and a.code not in keys]
    cells = F.array(*[F.struct(F.lit(a.attribute_id).cast("long").alias("attribute_id"), F.lit("node_id" if a.attribute_id in taxonomy else a.datatype).alias("datatype"), F.col(a.code).cast("string").alias("v")) for a in known])
    rows = records.select(*keys, F.inline(cells)).where("v is not null")
    rows = rows.select(*keys, "attribute_id", "datatype", F.explode(listed(F.col("v"))).alias("v")).withColumn("v", F.nullif(F.trim("v"), F.lit(""))).where("v is not null").distinct()
    names = nodes.where("parent_id <> 0").groupBy(F.col("attribute_id").alias("__a"), F.lower(F.trim("name")).alias("__n")).agg(F.min("id").alias("__id"))
    rows = rows.join(small(names), (F.col("datatype") == "node_id") & (F.col("attribute_id") == F.col("__a")) & (F.lower("v") == F.col("__n")), "left")
    v, kind = F.col("v"), F.col("datatype")
    typed = {"node_id": F.coalesce("__id", F.lit(-1).cast("long")), "text": v, "integer": v.try_cast("bigint"), "float": v.try_cast("double"), "cents": cents(v), "boolean": v.try_cast("boolean")}
    out = rows.select(*keys, "attribute_id", "datatype", *[F.when(kind.isin("text", "datetime") if t == "text" else kind == ("currency" if t == "cents" else t), x).alias(f"value_{t}") for t, x in typed.items()])
    return out.where(F.coalesce(*[F.col(f"value_{t}").cast("string") for t in typed]).isNotNull()).distinct()


def full(records: DataFrame, domain_attributes: DataFrame, nodes: DataFrame) -> dict[str, DataFrame]:
    """The tables of all sources in records. A record that breaks a rule isn't in the catalogue."""
    judged = R.with_reason(latest(records), rules())
    kept = judged.where("drop_reason is null").drop("drop_reason")
    keys = ["source_id", "source_product_id"]
    reviews = kept.where(F.trim("reviews").startswith("[")).select(*keys, F.inline(F.from_json(F.trim("reviews"), REVIEW))).distinct()
    score = X.score_number(F.col("score_str"))
    return {
        "products": kept.select(*keys, "single_product_url", "name", F.lit(False).alias("deleted")),
        "offers": kept.select(*keys, "single_product_url", cents(F.col("price")).alias("price_cents"), F.col("qoh").try_cast("int").alias("qoh")),
        "attributes": attribute_rows(kept, keys, domain_attributes, nodes),
        "reviews": reviews.select(*keys, F.coalesce(F.nullif("reviewer_name", F.lit("")), F.lit("Unknown")).alias("reviewer"), "content", F.when((score > 0) & (score < 70), None).otherwise(F.coalesce(score, F.lit(0))).alias("score")),
    }


def compare(offers: DataFrame, updates: DataFrame) -> DataFrame:
    """source_id, single_product_url, source_product_id, action, price_cents, qoh after the run.

    offers: what is known. updates: source_id, single_product_url, price_cents, qoh of one run of
    some sources. A price or stock that an update doesn't state stays. Actions: keep, update, new
    (listed but not known), delete (known but no longer listed); sources without any update keep all.
    """
    key = ["source_id", "single_product_url"]
    old = offers.groupBy(*key).agg(F.max("source_product_id").alias("source_product_id"), F.max_by("price_cents", "source_product_id").alias("old_price"), F.max_by("qoh", "source_product_id").alias("old_qoh"), F.lit(True).alias("known"))
    new = updates.select(*key, F.col("price_cents").alias("new_price"), F.col("qoh").alias("new_qoh"), F.lit(True).alias("listed"))
    both = old.join(new, key, "full").join(small(updates.select("source_id").distinct().withColumn("ran", F.lit(True))), "source_id", "left")
    price, qoh = F.coalesce("new_price", "old_price"), F.coalesce("new_qoh", "old_qoh")
    changed = ~(price.eqNullSafe(F.col("old_price")) & qoh.eqNullSafe(F.col("old_qoh")))
    action = F.when(F.col("known").isNull(), "new").when(F.col("ran").isNull(), "keep").when(F.col("listed").isNull(), "delete").when(changed, "update").otherwise("keep")
    return both.select(*key, "source_product_id", action.alias("action"), price.alias("price_cents"), qoh.alias("qoh"))


def incremental(tables: Mapping[str, DataFrame], updates: DataFrame) -> dict[str, DataFrame]:
    """The tables after an incremental run: changed offers written back, products that are no longer
    listed marked as deleted, and their offers, attributes and reviews removed. New listings need
    their full record first and aren't added here (see compare). Offers without source or address
    can't be compared and stay."""
    judged = compare(tables["offers"], updates)
    gone = judged.where("action = 'delete'").select("source_id", "single_product_url")
    ids = tables["offers"].join(gone, ["source_id", "single_product_url"], "left_semi").select("source_id", "source_product_id").distinct()
    out = {t: R.without_keys(tables[t], ids, ["source_id", "source_product_id"]) for t in ("attributes", "reviews")}
    kept = R.without_keys(tables["offers"], ids, ["source_id", "source_product_id"])
    news = judged.where("action = 'update'").select("source_id", "single_product_url", F.col("price_cents").alias("__price"), F.col("qoh").alias("__qoh"), F.lit(True).alias("__new"))
    both = kept.join(news, ["source_id", "single_product_url"], "left")
    written = {"price_cents": F.when(F.col("__new"), F.col("__price")).otherwise(F.col("price_cents")), "qoh": F.when(F.col("__new"), F.col("__qoh")).otherwise(F.col("qoh"))}
    out["offers"] = both.select(*[written.get(c, F.col(c)).alias(c) for c in tables["offers"].columns])
    marked = ids.withColumn("__gone", F.lit(True))
    out["products"] = tables["products"].join(marked, ["source_id", "source_product_id"], "left").withColumn("deleted", F.col("deleted") | F.coalesce("__gone", F.lit(False))).select(*tables["products"].columns)
    return out


def cleaned(tables: Mapping[str, DataFrame], source_id: int) -> dict[str, DataFrame]:
    """The tables without a source."""
    return {t: df.where((F.col("source_id") != source_id) | F.col("source_id").isNull()) for t, df in tables.items()}


def store(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Writes each table by source; folders of sources that a table doesn't have stay as they are."""
    for name, df in tables.items():
        write_partitions(df, f"{folder}/{name}", ["source_id"])


def stored(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{folder}/{t}") for t in TABLES if is_folder(spark, f"{folder}/{t}")}
