"""Queries of the llm operators, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terroir.llm.canonical import mapped_fields
from terroir.llm.leakage import leaked, leaked_items
from terroir.llm.listings import product_groups, product_pairs
from terroir.llm.survivors import survivors
from terroir.llm.tokens import decode_ids, encode_corpus
from terroir.llm.truncation import truncated, truncation_by_source
from terroir.session import table


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"), keep=["doc_id"])


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    return p8_ids(spark, d).select("doc_id", decode_ids(spark, F.col("ids")).alias("text"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(p9_found(spark, d), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncated(table(spark, d, "documents"))


def p10_sources(spark: SparkSession, d: str) -> DataFrame:
    return truncation_by_source(table(spark, d, "documents"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return mapped_fields(table(spark, d, "products"), table(spark, d, "domain_taxonomy_nodes"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every listing with the class of its bottle."""
    return product_groups(table(spark, d, "products"), table(spark, d, "domain_taxonomy_nodes"), table(spark, d, "fx_rates"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return product_pairs(p1_groups(spark, d))


def p3_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivors(table(spark, d, "product_records"), table(spark, d, "sources"), table(spark, d, "domain_taxonomy_nodes"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_survivors(spark, d).select("master_product_id", "field_name", "record_id")


# -- the same in SQL ----------------------------------------------------------------------------

LETTERS = [chr(c) for c in range(0xC0, 0x100)]


def _replaced(c: str, pairs: list[tuple[str, str]]) -> str:
    for old, new in pairs:
        c = f"replace({c}, '{old}', '{new}')"
    return c


def _misread(letter: str) -> list[str]:
    """A letter's UTF-8 bytes read as cp1252 or latin-1."""
    return list(dict.fromkeys(letter.encode().decode(code, "replace") for code in ("cp1252", "latin-1")))


def words_sql(c: str) -> str:
    """The words of a text: entities resolved (twice), tags and invisible marks out, misread UTF-8 repaired, no case and accents."""
    entities = [("&amp;", "&"), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), *[(f"&#{ord(x)};", x) for x in LETTERS]]
    tagless = f"regexp_replace({_replaced(c, entities)}, '</?[a-zA-Z][^<>]*>|<![^<>]*>', ' ', 'g')"
    repaired = _replaced(tagless, [(m, x) for x in LETTERS for m in _misread(x) if "\ufffd" not in m])
    seen = f"regexp_replace({repaired}, '[\\x{{AD}}\\x{{34F}}\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{2064}}\\x{{FE00}}-\\x{{FE0F}}\\x{{FEFF}}]', '', 'g')"
    plain = _replaced(f"strip_accents(lower({seen}))", [("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ø", "o")])
    return f"list_filter(string_split_regex({plain}, '[^\\pL\\pN]+'), lambda x: x <> '')"


#: Of twelve words with one altered, the first six or the last six are as they were.
LEAKS = f"""WITH d AS (SELECT doc_id, {words_sql("text")} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {words_sql("text")} AS w FROM eval_items WHERE text IS NOT NULL),
 dg AS (SELECT doc_id, w, p, array_to_string(w[p:p + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 5)) AS p FROM d)),
 ig AS (SELECT item_id, w, s, o, array_to_string(w[s + o:s + o + 5], ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 11)) AS s FROM i), (VALUES (0), (6)) t(o)),
 c AS (SELECT DISTINCT doc_id, item_id, dg.w AS dw, ig.w AS iw, p - o AS a, s FROM dg JOIN ig USING (g) WHERE p - o >= 1 AND p - o + 11 <= len(dg.w))
 SELECT DISTINCT doc_id, item_id FROM c WHERE len(list_filter(generate_series(0, 11), lambda k: dw[a + k] <> iw[s + k])) <= 1"""
QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p3_found, p3_survivors, p6_found, p8_ids, p8_decoded, p9_found, p9_items, p10_found, p10_sources)}
ORACLE = {
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p9_found": LEAKS,
    "p9_items": f"SELECT item_id, count(DISTINCT doc_id) AS n_documents FROM (SELECT DISTINCT item_id FROM eval_items) LEFT JOIN ({LEAKS}) USING (item_id) GROUP BY 1",
}
