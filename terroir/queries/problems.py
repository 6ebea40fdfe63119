"""Queries of the core's training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terroir.functions.numbers import stated_number
from terroir.operators.history import attribute_history
from terroir.operators.snapshots import catalogue_changes
from terroir.operators.units import common_units
from terroir.operators.wide import attribute_list, filled_rows, wide_table
from terroir.session import table

FEED_TYPES = {"price": "decimal(20,6)", "qoh": "decimal(20,6)"}


def feed_history(spark: SparkSession, d: str) -> DataFrame:
    """The full price and stock history of every product of a source."""
    values = {v: stated_number(F.col(v)) for v in FEED_TYPES}
    return attribute_history(table(spark, d, "update_feed"), ["source_id", "single_product_url"], "observed_at", ["received_at", "update_id"], values, FEED_TYPES)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return feed_history(spark, d).select("source_id", "single_product_url", F.date_format("valid_from", "yyyy-MM-dd HH:mm:ss").alias("valid_from"))


def p2_history(spark: SparkSession, d: str) -> DataFrame:
    at = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("valid_from", "valid_to")]
    return feed_history(spark, d).select("source_id", "single_product_url", *at, F.round(F.col("price") * 100).cast("long").alias("price_cents"), F.col("qoh").cast("long").alias("qoh"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return filled_rows(table(spark, d, "source_attribute_values"), table(spark, d, "domain_attributes"))


def p4_wide(spark: SparkSession, d: str) -> DataFrame:
    return wide_table(table(spark, d, "source_attribute_values"), table(spark, d, "domain_attributes"))


def p4_wide_checked(spark: SparkSession, d: str) -> DataFrame:
    """The wide table with every typed value in a form that both engines write alike."""
    wide, attributes = p4_wide(spark, d), attribute_list(table(spark, d, "domain_attributes"))
    shown = []
    for a in attributes:
        c = F.col(a.code)
        if a.multivalued:
            c = F.array_join(c, "|")
        elif a.datatype in ("float", "currency"):
            c = F.round(c * (1_000_000 if a.datatype == "float" else 100)).cast("long")
        elif a.datatype == "datetime":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        shown.append(c.alias(a.code))
    return wide.select("source_product_id", *shown)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return catalogue_changes(table(spark, d, "update_products"), table(spark, d, "pipeline_sequence"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    out = common_units(table(spark, d, "products"), table(spark, d, "fx_rates"))
    return out.select("source_product_id", "field_name", F.round("amount", 0).cast("long").alias("amount"))


QUERIES = {f.__name__: f for f in (p2_found, p2_history, p4_found, p4_wide, p4_wide_checked, p5_found, p7_found)}

# -- the same in SQL ----------------------------------------------------------------------------

NUMBER = r"TRY_CAST(replace(regexp_extract(trim({}), '^(?:US\$|\$|USD)?\s*([0-9][0-9,]*(?:\.[0-9]*)?)$', 1), ',', '') AS DECIMAL(20,6))"
VERSIONS = f"""WITH r AS (SELECT source_id, single_product_url, observed_at, arg_max(struct_pack(p := {NUMBER.format("price")}, q := {NUMBER.format("qoh")}), (received_at, update_id)) AS v FROM update_feed WHERE observed_at IS NOT NULL GROUP BY 1, 2, 3),
 k AS (SELECT source_id, single_product_url, observed_at, last_value(v.p IGNORE NULLS) OVER o AS p, last_value(v.q IGNORE NULLS) OVER o AS q FROM r WINDOW o AS (PARTITION BY source_id, single_product_url ORDER BY observed_at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 c AS (SELECT *, row_number() OVER o AS n, lag(p) OVER o AS bp, lag(q) OVER o AS bq FROM k WINDOW o AS (PARTITION BY source_id, single_product_url ORDER BY observed_at)),
 s AS (SELECT * FROM c WHERE n = 1 OR p IS DISTINCT FROM bp OR q IS DISTINCT FROM bq) SELECT source_id, single_product_url, strftime(observed_at, '%Y-%m-%d %H:%M:%S') AS valid_from, strftime(lead(observed_at) OVER (PARTITION BY source_id, single_product_url ORDER BY observed_at), '%Y-%m-%d %H:%M:%S') AS valid_to, p, q FROM s"""
SAME = "lower(nullif(regexp_replace(regexp_replace(name, '\\s+', ' ', 'g'), '^ | $', '', 'g'), ''))"
CHANGES = f"""WITH runs AS (SELECT source_id, sequence_id, row_number() OVER o AS i, lag(sequence_id) OVER o AS before FROM (SELECT DISTINCT source_id, sequence_id, start_time FROM pipeline_sequence WHERE state = 'ready') WINDOW o AS (PARTITION BY source_id ORDER BY start_time, sequence_id)),
 u AS (SELECT sequence_id, single_product_url, arg_max(struct_pack(n := {SAME}, p := {NUMBER.format("price")}, q := {NUMBER.format("qoh")}), loaded_at) AS v FROM update_products GROUP BY 1, 2),
 b AS (SELECT r.source_id, r.sequence_id, u.single_product_url, u.v FROM runs r JOIN u ON u.sequence_id = r.before), a AS (SELECT r.source_id, r.sequence_id, u.single_product_url, u.v FROM runs r JOIN u USING (sequence_id) WHERE r.before IS NOT NULL)
 SELECT source_id, sequence_id, single_product_url, CASE WHEN b.v IS NULL THEN 'added' WHEN a.v IS NULL THEN 'removed' ELSE 'changed' END AS change_kind FROM a FULL JOIN b USING (source_id, sequence_id, single_product_url) WHERE a.v IS DISTINCT FROM b.v"""
DATES = ", ".join(f"try_strptime(v, '{f}')" for f in ("%Y-%m-%d", "%Y%m%d", "%Y/%m/%d", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%d %b %Y"))
CELLS = rf"""WITH r AS (SELECT DISTINCT s.source_product_id, s.attribute_id, s.sav_id, s.updated, a.is_multivalue, a.datatype, regexp_replace(s.value, '^\s+|\s+$', '', 'g') AS v FROM source_attribute_values s JOIN domain_attributes a USING (attribute_id)),
 g AS (SELECT * FROM r WHERE v <> '' AND CASE datatype WHEN 'text' THEN TRUE WHEN 'integer' THEN regexp_matches(v, '^[+-]?([0-9]+|[0-9]{{1,3}}(,[0-9]{{3}})+)(\.0*)?$') WHEN 'float' THEN regexp_matches(v, '^[+-]?[0-9]+([.,][0-9]*)?([eE][+-]?[0-9]+)?$')
 WHEN 'currency' THEN regexp_matches(v, '^(\$|USD|EUR|€)?\s*[0-9]+([.,][0-9]+)*\s*(\$|USD|EUR|€)?$') WHEN 'boolean' THEN lower(v) IN ('1', '0', 'true', 'false', 't', 'f', 'yes', 'no', 'y', 'n', 'on', 'off') WHEN 'datetime' THEN coalesce({DATES}) IS NOT NULL END)
 SELECT source_product_id, attribute_id, arg_max(sav_id, (updated, sav_id)) AS sav_id FROM g WHERE NOT is_multivalue GROUP BY 1, 2 UNION ALL SELECT source_product_id, attribute_id, min(sav_id) FROM g WHERE is_multivalue GROUP BY source_product_id, attribute_id, lower(v)"""
#: Codes of the attributes by type, as the table lists them; several values are joined.
CODES = {
    "text": "sku brand region wine_type bottle_size vintage description short_desc flaw designation closure",
    "several": "varietals image foods styles highlights characteristics purpose",
    "float": "alcohol_pct body tannin acidity sweetness popularity discount_pct rating color_intensity qpr",
    "currency": "price msrp",
    "integer": "qoh drink_from drink_to cases_made",
    "boolean": "is_blend fortified is_organic",
    "datetime": "date_added",
}
SHOWN = {
    "text": "max(v) FILTER (code = '{c}')",
    "several": "string_agg(v, '|' ORDER BY sav_id) FILTER (code = '{c}')",
    "float": "CAST(round(max(TRY_CAST(replace(v, ',', '.') AS DOUBLE)) FILTER (code = '{c}') * 1000000) AS BIGINT)",
    "currency": "CAST(round(max(TRY_CAST({n} AS DECIMAL(20,6))) FILTER (code = '{c}') * 100) AS BIGINT)",
    "integer": "max(TRY_CAST(split_part(replace(v, ',', ''), '.', 1) AS BIGINT)) FILTER (code = '{c}')",
    "boolean": "bool_or(lower(v) IN ('1', 'true', 't', 'yes', 'y', 'on')) FILTER (code = '{c}')",
    "datetime": "max(strftime(coalesce({d}), '%Y-%m-%d %H:%M:%S')) FILTER (code = '{c}')",
}


def number_sql(num: str, groups: bool) -> str:
    """A number's text with point decimals and no group marks."""
    commas = f"WHEN regexp_matches({num}, '^([1-9][0-9]{{0,2}}(,[0-9]{{3}})+)$') THEN replace({num}, ',', '')" if groups else f"WHEN regexp_matches({num}, '^[0-9]{{1,3}}(,[0-9]{{3}}){{2,}}$') THEN replace({num}, ',', '')"
    return f"CASE WHEN regexp_matches({num}, '^[0-9]{{1,3}}(,[0-9]{{3}})+\\.[0-9]*$') THEN replace({num}, ',', '') WHEN regexp_matches({num}, '^[0-9]{{1,3}}(\\.[0-9]{{3}})+,[0-9]+$') THEN replace(replace({num}, '.', ''), ',', '.') {commas} ELSE replace({num}, ',', '.') END"


PLAIN_MONEY = number_sql(r"regexp_replace(v, '[^0-9.,]', '', 'g')", True)
WIDE = f"SELECT source_product_id, {', '.join(SHOWN[t].format(c=c, d=DATES, n=PLAIN_MONEY) + ' AS ' + c for t, codes in CODES.items() for c in codes.split())} FROM (SELECT f.source_product_id, a.code, f.sav_id, s.v FROM ({CELLS}) f JOIN (SELECT DISTINCT sav_id, attribute_id, regexp_replace(value, '^\\s+|\\s+$', '', 'g') AS v FROM source_attribute_values) s USING (sav_id, attribute_id) JOIN domain_attributes a USING (attribute_id)) GROUP BY 1"
#: Amounts as written: a number with its unit, a name, or a bare number, whose unit is the source's.
AMT = r"(?:[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]{1,3}(?:\.[0-9]{3})+,[0-9]+|[0-9]+,[0-9]+|[0-9]+(?:\.[0-9]*)?|\.[0-9]+)"
SIZE_UNITS = r"fl\.?\s*oz\.?|fluid\s*ounces?|oz\.?|ounces?|ml\.?|m\.l\.|millilit(?:er|re)s?|cl\.?|centilit(?:er|re)s?|dl\.?|decilit(?:er|re)s?|l\.?|lit(?:er|re|ro)s?|lt\.?|ltr\.?"
SIZE_FACTOR = "CASE WHEN u = '' THEN NULL WHEN u[1:1] = 'f' OR u[1:1] = 'o' THEN 29.5735295625 WHEN u[1:1] = 'm' THEN 1 WHEN u[1:1] = 'c' THEN 10 WHEN u[1:1] = 'd' THEN 100 ELSE 1000 END"
SIZE_NAMED = r"CASE WHEN regexp_matches(s, 'double[\s-]*magnum|doppelmagnum|jeroboam') THEN 3000 WHEN contains(s, 'magnum') THEN 1500 WHEN regexp_matches(s, 'half|demi|1/2|halbe|mezza|media') THEN 375 WHEN regexp_matches(s, 'split|piccolo|quarter|1/4') THEN 187 WHEN regexp_matches(s, 'standard|std|full\s*bottle|^bottle$|^btl\.?$|^bouteille$|^flasche$|^botella$|^bottiglia$') THEN 750 END"
ALCOHOL_UNITS = r"°?\s*proof|‰|per\s*mille?|%|percent|per\s*cent|vol|°"
ALCOHOL_FACTOR = "CASE WHEN u = '' THEN CASE WHEN regexp_matches(s, '^[a-z]') THEN 100 END WHEN contains(u, 'proof') THEN 50 WHEN u = '‰' OR contains(u, 'mill') THEN 10 ELSE 100 END"


def _read_sql(field: str, units: str, factor: str, named: str) -> str:
    lowered = f"SELECT source_product_id, source_id, lower(regexp_replace({field}, '^\\s+|\\s+$', '', 'g')) AS s FROM products"
    united = f"SELECT *, regexp_extract(s, '(?:^|[^0-9.,])({AMT})\\s*({units})(?:[^a-z]|$)', 2) AS u, regexp_extract(s, '(?:^|[^0-9.,])({AMT})\\s*({units})(?:[^a-z]|$)', 1) AS a, regexp_extract(s, '^(?:(?:abv|alcohol|alc\\.?)[\\s:]*)?({AMT})$', 1) AS b FROM ({lowered})"
    read = f"SELECT *, TRY_CAST({number_sql('n', False)} AS DECIMAL(20,6)) AS d FROM (SELECT *, CASE WHEN u <> '' THEN a ELSE b END AS n FROM ({united}))"
    return f"SELECT source_product_id, source_id, '{field}' AS field_name, amount, CASE WHEN u = '' AND amount IS NULL THEN d END AS bare FROM (SELECT *, coalesce(CAST(d AS DOUBLE) * ({factor}), CASE WHEN d IS NULL THEN {named} END) AS amount FROM ({read}))"


MARKS = {"USD": "us$ usd dollar dollars $", "EUR": "€ eur euro euros", "GBP": "£ gbp pound pounds", "CHF": "chf sfr. sfr francs", "AUD": "a$ aud", "CENT": "ct ct. cts ¢ cent cents"}
MARK_LIST = "|".join(w.replace("$", r"\$").replace(".", r"\.") for w in sorted((w for ws in MARKS.values() for w in ws.split()), key=lambda w: -len(w)))
MARK_CODE = "CASE " + " ".join(f"WHEN m IN ({', '.join(repr(w) for w in ws.split())}) THEN '{c}'" for c, ws in MARKS.items()) + " END"
CASE_OF = r"\s*[(/]?\s*(?:case\s*of|for|per|/)\s*([0-9]+)\s*(?:bottles?|btls?)?\)?$"
PRICE_READ = rf"""SELECT source_product_id, source_id, 'price' AS field_name, CAST(d AS DOUBLE) * CASE WHEN cur = 'CENT' THEN 1 WHEN cur = 'USD' THEN 100 ELSE 100 * usd_per_unit END / per AS amount, CASE WHEN m = '' THEN CAST(d AS DOUBLE) / per END AS bare FROM
 (SELECT *, {MARK_CODE} AS cur, TRY_CAST({number_sql('n', True)} AS DECIMAL(20,6)) AS d FROM (SELECT *, regexp_extract(h, '^(?:{MARK_LIST})?\s*({AMT})\s*(?:{MARK_LIST})?$', 1) AS n, regexp_extract(h, '^({MARK_LIST})\s*[0-9]', 1) || regexp_extract(h, '[0-9.]\s*({MARK_LIST})$', 1) AS m FROM
 (SELECT *, coalesce(nullif(TRY_CAST(regexp_extract(s, '{CASE_OF}', 1) AS INTEGER), 0), 1) AS per, regexp_replace(s, '{CASE_OF}', '') AS h FROM (SELECT source_product_id, source_id, lower(regexp_replace(price, '^\s+|\s+$', '', 'g')) AS s FROM products)))) LEFT JOIN fx_rates ON currency = cur"""
AMOUNTS = f"""WITH r AS ({_read_sql("bottle_size", SIZE_UNITS, SIZE_FACTOR, SIZE_NAMED)} UNION ALL {_read_sql("alcohol_pct", ALCOHOL_UNITS, ALCOHOL_FACTOR, "NULL")} UNION ALL {PRICE_READ}), p AS (SELECT * FROM r WHERE coalesce(amount, bare) > 0),
 ref AS (SELECT field_name, avg(log10(amount)) AS ref FROM p WHERE amount IS NOT NULL GROUP BY 1), lev AS (SELECT source_id, field_name, avg(log10(bare)) AS lev FROM p WHERE bare IS NOT NULL GROUP BY 1, 2),
 opt AS (SELECT * FROM (VALUES ('bottle_size', 1.0, 1), ('bottle_size', 10.0, 2), ('bottle_size', 1000.0, 3), ('alcohol_pct', 100.0, 1), ('alcohol_pct', 50.0, 2), ('alcohol_pct', 10.0, 3), ('alcohol_pct', 10000.0, 4), ('price', 100.0, 1), ('price', 1.0, 2)) o(field_name, f, k)),
 fac AS (SELECT source_id, field_name, arg_min(f, (abs(lev + log10(f) - ref), k)) AS f FROM lev JOIN opt USING (field_name) JOIN ref USING (field_name) GROUP BY 1, 2)
 SELECT DISTINCT source_product_id, field_name, CAST(floor(coalesce(amount, bare * f) + 0.5 + 1e-9) AS BIGINT) AS amount FROM p LEFT JOIN fac USING (source_id, field_name)"""
ORACLE = {
    "p2_found": f"SELECT source_id, single_product_url, valid_from FROM ({VERSIONS})",
    "p2_history": f"SELECT source_id, single_product_url, valid_from, valid_to, CAST(round(p * 100) AS BIGINT) AS price_cents, CAST(q AS BIGINT) AS qoh FROM ({VERSIONS})",
    "p4_found": CELLS,
    "p5_found": CHANGES,
    "p4_wide_checked": WIDE,
    "p7_found": AMOUNTS,
}
