"""Attribute-value rows into a wide, typed table (problem 4).

Rows are first reduced to one cell per entity and attribute (map-side combined, so an entity that
holds a third of all rows is no hot group). The entity-by-attribute grid is then completed inside
each entity's row: attributes without a cell are added as empty cells, the cells are sorted by
attribute position, and fixed indices are projected through type-specific try casts. Completing
the grid in place joins the values without shuffling entities x attributes rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terroir.functions.numbers import AMOUNT, EXPONENT, blank_to_null, plain_digits, stated_number, trimmed

#: Attributes become columns, so their number is bounded; a longer list is refused.
MAX_ATTRIBUTES = 2_000
#: Formats in which dates are read.
DATE_FORMATS = {
    r"^\d{4}-\d{2}-\d{2}$": "yyyy-MM-dd",
    r"^\d{8}$": "yyyyMMdd",
    r"^\d{4}/\d{2}/\d{2}$": "yyyy/MM/dd",
    r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$": "yyyy-MM-dd HH:mm:ss",
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$": "yyyy-MM-dd'T'HH:mm:ss",
    r"^\d{2} [A-Za-z]{3} \d{4}$": "dd MMM yyyy",
    r"^\d{2}/\d{2}/\d{4}$": "dd/MM/yyyy",
    r"^\d{2}\.\d{2}\.\d{4}$": "dd.MM.yyyy",
}
TRUE_WORDS = ["1", "true", "t", "yes", "y", "on"]
FALSE_WORDS = ["0", "false", "f", "no", "n", "off"]
SQL_TYPES = {"text": "string", "integer": "bigint", "float": "double", "currency": "decimal(20,6)", "boolean": "boolean", "datetime": "timestamp"}


@dataclass(frozen=True)
class Attribute:
    attribute_id: int
    code: str
    datatype: str
    multivalued: bool


def read_as(value: Column, datatype: str) -> Column:
    """The trimmed text read as the type, null if it can't be."""
    v = blank_to_null(value)
    if datatype == "text":
        return v
    if datatype == "boolean":
        return F.when(F.lower(v).isin(TRUE_WORDS), F.lit(True)).when(F.lower(v).isin(FALSE_WORDS), F.lit(False))
    if datatype == "datetime":
        return F.coalesce(*[F.when(v.rlike(p), F.try_to_timestamp(v, F.lit(f))) for p, f in DATE_FORMATS.items()])
    if datatype == "currency":
        return stated_number(value)
    num = F.regexp_extract(trimmed(value), rf"^[+-]?{AMOUNT}{EXPONENT}$", 0)
    if datatype == "float":
        return plain_digits(num, comma_groups=False).try_cast("double")
    return F.regexp_extract(plain_digits(num), r"^([+-]?[0-9]+)(?:\.0*)?$", 1).try_cast("bigint")


def attribute_list(domain_attributes: DataFrame) -> list[Attribute]:
    """Attributes by id: the order of the columns. Codes that occur twice get the id as suffix."""
    rows = domain_attributes.where(F.col("attribute_id").isNotNull()).select("attribute_id", "code", "datatype", "is_multivalue").dropDuplicates(["attribute_id"]).orderBy("attribute_id").take(MAX_ATTRIBUTES + 1)
    if len(rows) > MAX_ATTRIBUTES:
        raise ValueError(f"more than {MAX_ATTRIBUTES} attributes can't become columns")
    seen: set[str] = {"source_product_id"}
    out = []
    for r in rows:
        code = r.code or f"attribute_{r.attribute_id}"
        code = f"{code}_{r.attribute_id}" if code.lower() in seen else code
        seen.add(code.lower())
        out.append(Attribute(r.attribute_id, code, r.datatype if r.datatype in SQL_TYPES else "text", bool(r.is_multivalue)))
    return out


def _ids(attributes: list[Attribute], **want: object) -> list[int]:
    return [a.attribute_id for a in attributes if all(getattr(a, k) == v for k, v in want.items())]


def fill_cells(values: DataFrame, attributes: list[Attribute]) -> DataFrame:
    """source_product_id, attribute_id, __cells: array of (sav_id, value), by sav_id.

    Only readable values of listed attributes. Single-valued: the row with the latest updated
    (null is earliest), then the largest sav_id. Multi-valued: for each distinct value, apart from
    case and outer blanks, the smallest sav_id.
    """
    attr = F.col("attribute_id")
    readable = F.lit(False)
    for t in SQL_TYPES:
        ids = _ids(attributes, datatype=t)
        if ids:
            readable = readable | (attr.isin(ids) & read_as(F.col("value"), t).isNotNull())
    multi = _ids(attributes, multivalued=True)
    distinct = F.when(attr.isin(multi), F.lower(blank_to_null(F.col("value")))) if multi else F.lit(None).cast("string")
    rows = values.where(F.col("source_product_id").isNotNull() & readable).select("source_product_id", "attribute_id", distinct.alias("__d"), F.struct("sav_id", "value").alias("__c"), "updated")
    one = rows.groupBy("source_product_id", "attribute_id", "__d").agg(F.max_by("__c", F.struct("updated", "__c")).alias("__last"), F.min("__c").alias("__least"))
    one = one.select("source_product_id", "attribute_id", F.when(F.col("__d").isNull(), F.col("__last")).otherwise(F.col("__least")).alias("__c"))
    return one.repartition("source_product_id").groupBy("source_product_id", "attribute_id").agg(F.array_sort(F.collect_list("__c")).alias("__cells"))


def wide_table(values: DataFrame, domain_attributes: DataFrame, keep_rows: bool = False) -> DataFrame:
    """One row per entity, one typed column per attribute (arrays for multi-valued ones).

    Entities without any readable value have no row. With keep_rows, __rows holds for each filled
    cell (attribute_id, sav_ids), to trace a cell to its rows. Null values, values that can't be
    read, unknown attributes and null entities fill nothing; an empty table gives an empty one.
    """
    attributes = attribute_list(domain_attributes)
    cells = fill_cells(values, attributes)
    whole = F.array(*[F.lit(a.attribute_id).cast("long") for a in attributes])
    got = F.collect_list(F.struct(F.col("attribute_id").cast("long").alias("attribute_id"), F.col("__cells").alias("cells")))
    rows = cells.groupBy("source_product_id").agg(got.alias("__got"))
    kind = "array<struct<attribute_id:bigint,cells:array<struct<sav_id:bigint,value:string>>>>"
    empty = F.transform(F.array_except(whole, F.transform("__got", lambda x: x["attribute_id"])), lambda i: F.struct(i.alias("attribute_id"), F.array().cast("array<struct<sav_id:bigint,value:string>>").alias("cells")))
    grid = rows.select("source_product_id", F.array_sort(F.concat(F.col("__got").cast(kind), empty.cast(kind))).alias("__grid"))

    def typed(datatype: str):
        return lambda x: read_as(x["value"], datatype)

    columns = []
    for i, a in enumerate(attributes):
        cell = F.col("__grid")[i]["cells"]
        if a.multivalued:
            col = F.when(F.size(cell) > 0, F.transform(cell, typed(a.datatype)))
        else:
            col = read_as(F.get(cell, F.lit(0))["value"], a.datatype)
        columns.append(col.alias(a.code))
    kept = [F.transform(F.filter("__grid", lambda g: F.size(g["cells"]) > 0), lambda g: F.struct(g["attribute_id"].alias("attribute_id"), F.transform(g["cells"], lambda x: x["sav_id"]).alias("sav_ids"))).alias("__rows")] if keep_rows else []
    return grid.select("source_product_id", *columns, *kept)


def filled_rows(values: DataFrame, domain_attributes: DataFrame) -> DataFrame:
    """source_product_id, attribute_id, sav_id of the rows that fill the wide table's cells."""
    wide = wide_table(values, domain_attributes, keep_rows=True).select("source_product_id", "__rows")
    return wide.select("source_product_id", F.inline("__rows")).select("source_product_id", "attribute_id", F.explode("sav_ids").alias("sav_id"))
