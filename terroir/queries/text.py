"""Queries of the text functions over documents, names and values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terroir.functions import text as X
from terroir.operators import summary as S
from terroir.queries import sqltext as Q
from terroir.session import small, table

ORACLE: dict[str, str] = {}
QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"SELECT doc_id, i - 1 AS i, ss[i] AS sentence FROM (SELECT doc_id, ss, unnest(generate_series(1, len(ss))) AS i FROM ({Q.sentences('SELECT doc_id, text FROM documents WHERE text IS NOT NULL', 'text')})) WHERE length(ss[i]) > 5")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of more than five characters, numbered."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("i", "sentence")).where("length(sentence) > 5").withColumn("i", F.col("i").cast("long"))


@query(f"SELECT doc_id, i - 1 AS i, ss[i] AS sentence FROM (SELECT doc_id, ss, unnest(generate_series(1, len(ss))) AS i FROM ({Q.sentences('SELECT doc_id, text FROM documents WHERE text IS NOT NULL', 'text', False)}))")
def summary_sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(X.summary_sentences(F.col("text"))).alias("i", "sentence")).withColumn("i", F.col("i").cast("long"))


@query(f"SELECT name, {Q.cleanup('name')} AS cleaned FROM (SELECT DISTINCT name FROM products)")
def cleanup_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "products").select("name").distinct().select("name", X.cleanup(F.col("name")).alias("cleaned"))


COMMON_SQL = Q.COMMON


@query(
    rf"""SELECT DISTINCT name, array_to_string(list_filter(ws, lambda w: NOT list_contains([{COMMON_SQL}], w)), ' ') AS text, len(list_filter(ws, lambda w: list_contains([{COMMON_SQL}], w))) AS n_removed
 FROM (SELECT name, list_filter(string_split_regex(replace(replace(lower(name), '$', 'dollar'), '&', 'and'), '[\s\pZ]+'), lambda w: w <> '') AS ws FROM products WHERE name IS NOT NULL)"""
)
def common_words_removed(spark: SparkSession, d: str) -> DataFrame:
    s = X.without_common_words(F.lower("name"))
    return table(spark, d, "products").where("name is not null").select("name", s["text"].alias("text"), F.size(s["removed"]).cast("long").alias("n_removed")).distinct()


@query(r"SELECT doc_id, replace(regexp_replace(text, '<a href=\"[^\"]*\">.*?</a>', ' ', 'g'), '  ', ' ') AS text FROM documents")
def strip_anchor(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.without_links(F.col("text")).alias("text"))


@query()
def diacritics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "products").select("name").distinct().select("name", X.without_accents(F.col("name")).alias("plain"))


@query(r"SELECT DISTINCT region, translate(region, '''!()', ' ') AS query_text, ltrim(regexp_replace(region, '[^A-Za-z0-9$]+', ' ', 'g')) AS plain, regexp_replace(replace(replace(region, chr(13), ''), chr(10), ''), '^\s+|\s+$', '', 'g') AS clean FROM products")
def text_scrub(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("region")
    return table(spark, d, "products").select("region", X.query_text(c).alias("query_text"), X.plain_signs(c).alias("plain"), X.clean(c).alias("clean")).distinct()


PHRASES = [("old vines", "ancient plants"), ("estate selection", "house pick"), ("reserve", "kept")]


@query(r"SELECT DISTINCT name, regexp_replace(regexp_replace(regexp_replace(lower(name), '\bestate selection\b', 'house pick', 'g'), '\bold vines\b', 'ancient plants', 'g'), '\breserve\b', 'kept', 'g') AS synonyms, replace(replace(name, 'Estate Selection', 'Estate_Selection'), 'Old Vines', 'Old_Vines') AS joined FROM products")
def phrase_replacement(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "products").select("name", X.replace_phrases(F.col("name"), PHRASES).alias("synonyms"), X.join_phrases(F.col("name"), ["Estate Selection", "Old Vines"]).alias("joined")).distinct()


@query(r"SELECT lang, count(*) AS n, count(DISTINCT w) AS n_words FROM (SELECT lang, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM documents) GROUP BY 1")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("lang", F.explode(X.simple_words(F.col("text"))).alias("w"))
    return rows.groupBy("lang").agg(F.count("w").alias("n"), F.countDistinct("w").alias("n_words"))


#: Fixed values, written out as above.
FEATURES = "want question_does recommend question_is explain define compare what what_is what_does attribute attribute_unit category question_mark attribute_price predicate"
TOKENS_SQL = ", ".join(f"CAST(list_contains(ws, '{t}') AS INTEGER) AS f_{t}" for t in FEATURES.split())


@query(rf"SELECT doc_id, {TOKENS_SQL} FROM (SELECT doc_id, string_split_regex(lower(text), '[\s\pZ]+') AS ws FROM documents WHERE text IS NOT NULL)")
def keyword_features(spark: SparkSession, d: str) -> DataFrame:
    """1 where a fixed token is a word of the text, else 0."""
    ws = F.split(F.lower("text"), r"(?U)\s+")
    return table(spark, d, "documents").where("text is not null").select("doc_id", *[F.array_contains(ws, t).cast("int").alias(f"f_{t}") for t in X.FEATURE_TOKENS])


@query("SELECT doc_id, CASE WHEN len(list_intersect(string_split(lower(text), ' '), ['them', 'they', 'it'])) > 0 THEN 'local' ELSE 'global' END AS context FROM documents WHERE text IS NOT NULL")
def intent_context(spark: SparkSession, d: str) -> DataFrame:
    ws = F.split(F.lower("text"), " ")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.when(F.arrays_overlap(ws, F.array(*[F.lit(w) for w in ("them", "they", "it")])), "local").otherwise("global").alias("context"))


@query("SELECT user_id, arg_max(replace(event_type, '_', '-'), (n, event_type)) AS intent FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def intent_argmax(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("user_id").agg(F.max_by(F.replace("event_type", F.lit("_"), F.lit("-")), F.struct("n", "event_type")).alias("intent"))


@query(
    """SELECT user_id, CASE WHEN a >= 0.65 AND a >= b + 0.1 THEN 1 WHEN b >= 0.65 AND b >= a + 0.1 THEN 0 WHEN a > b * 1.8 THEN 1 WHEN b > a * 1.8 THEN 0 END AS choice
 FROM (SELECT user_id, avg((event_type = 'view')::INT) AS a, avg((event_type = 'click')::INT) AS b FROM events GROUP BY 1)"""
)
def intent_override(spark: SparkSession, d: str) -> DataFrame:
    """Which of two scores is clearly ahead: 1, 0 or neither."""
    s = table(spark, d, "events").groupBy("user_id").agg(F.avg((F.col("event_type") == "view").cast("int")).alias("a"), F.avg((F.col("event_type") == "click").cast("int")).alias("b"))
    a, b = F.col("a"), F.col("b")
    return s.select("user_id", F.when((a >= 0.65) & (a >= b + 0.1), 1).when((b >= 0.65) & (b >= a + 0.1), 0).when(a > b * 1.8, 1).when(b > a * 1.8, 0).alias("choice"))


@query(
    r"""SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '(\d+) months', 1), '') AS DOUBLE) AS months, TRY_CAST(nullif(regexp_extract(text, '(\d+) (?:points|pts)', 1), '') AS DOUBLE) AS points, CASE WHEN regexp_matches(text, '(?i)wild yeast') THEN TRUE END AS wild_yeast FROM documents WHERE text IS NOT NULL"""
)
def regex_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Attributes by pattern: a number by its group, a boolean by a match."""
    num = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit("")).try_cast("double")
    return table(spark, d, "documents").where("text is not null").select("doc_id", num(r"(\d+) months").alias("months"), num(r"(\d+) (?:points|pts)").alias("points"), F.when(F.col("text").rlike("(?i)wild yeast"), F.lit(True)).alias("wild_yeast"))


@query("SELECT doc_id, '{value} wine' AS template, CASE WHEN starts_with(title, title) THEN upper(left(title, 1)) || lower(substr(title, 2)) || ' wine' END AS definition FROM documents WHERE title <> ''")
def derived_definition(spark: SparkSession, d: str) -> DataFrame:
    """A template with the value put in; capitalised where it stands first."""
    t = F.lit("{value} wine")
    cap = F.concat(F.upper(F.substring("title", 1, 1)), F.lower(F.expr("substring(title, 2)")))
    return table(spark, d, "documents").where("title <> ''").select("doc_id", t.alias("template"), F.replace(t, F.lit("{value}"), F.when(F.instr(t, "{value}") == 1, cap).otherwise(F.col("title"))).alias("definition"))


def ratio_pairs(brands: DataFrame, names: DataFrame) -> DataFrame:
    """brand, name, ratio: begin with the same letter, differ in length by one at most, ratio above 80."""
    sides = [x.where(f"{c} <> ''").select(c, F.substring(c, 1, 1).alias("letter"), F.length(c).alias("n")) for x, c in ((brands, "brand"), (names, "name"))]
    b = sides[0].withColumn("at", F.explode(F.array(F.col("n") - 1, F.col("n"), F.col("n") + 1)))
    near = b.join(small(sides[1].withColumnRenamed("n", "at")), ["letter", "at"])
    # a ratio above 80 leaves at most 0.195 of the letters out, and no fewer than the edits there are
    near = near.where(F.levenshtein("brand", "name") <= 0.195 * (F.col("n") + F.col("at")))
    return near.select("brand", "name", X.ratio(F.col("brand"), F.col("name")).alias("ratio")).where("ratio > 80")


#: Longest common subsequence of b and n by rows of its table: each letter of b makes the next row.
LCS_SQL = "list_last(list_reduce(list_transform(string_split(b, ''), lambda c: [c]), lambda r, c: list_reduce(list_transform(generate_series(1, length(n)), lambda j: [j::VARCHAR]), lambda o, j: list_append(o, CASE WHEN n[j[1]::BIGINT] = c[1] THEN (coalesce(nullif(r[j[1]::BIGINT], ''), '0')::INT + 1)::VARCHAR ELSE greatest(r[j[1]::BIGINT + 1]::INT, list_last(o)::INT)::VARCHAR END), ['0']), list_transform(generate_series(0, length(n)), lambda j: '0')))::INT"
PAIRS_SQL = "SELECT DISTINCT lower(trim(p.brand)) AS b, lower(t.name) AS n FROM products p, domain_taxonomy_nodes t WHERE attribute_id = 5 AND parent_id <> 0 AND trim(p.brand) <> '' AND lower(trim(p.brand))[1] = lower(t.name)[1] AND abs(length(trim(p.brand)) - length(t.name)) <= 1 AND levenshtein(lower(trim(p.brand)), lower(t.name)) <= 0.2 * (length(trim(p.brand)) + length(t.name))"


@query(f"SELECT b AS brand, n AS name, CAST(round_even(200.0 * lcs / (length(b) + length(n)), 0) AS INTEGER) AS ratio FROM (SELECT *, {LCS_SQL} AS lcs FROM ({PAIRS_SQL})) WHERE round_even(200.0 * lcs / (length(b) + length(n)), 0) > 80")
def fuzzy_ratio_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Brands against list names that begin with the same letter and are about as long: ratio above 80."""
    b = table(spark, d, "products").select(F.lower(F.trim("brand")).alias("brand")).where("brand <> ''").distinct()
    n = table(spark, d, "domain_taxonomy_nodes").where("attribute_id = 5 and parent_id <> 0").select(F.lower("name").alias("name"))
    return ratio_pairs(b, n)


@query("SELECT name, levenshtein(lower(name), 'castelo') AS distance FROM (SELECT DISTINCT lower(string_split(name, ' ')[1]) AS name FROM domain_taxonomy_nodes WHERE parent_id <> 0) WHERE regexp_matches(name, '^[a-z]+$') ORDER BY 2, 1 LIMIT 10")
def fuzzy_levenshtein_topk(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "domain_taxonomy_nodes").where("parent_id <> 0").select(F.lower(F.split("name", " ")[0]).alias("name")).distinct()
    return w.where("name rlike '^[a-z]+$'").select("name", F.levenshtein(F.lower("name"), F.lit("castelo")).cast("long").alias("distance")).orderBy("distance", "name").limit(10)


def fuzzy_entries(entries: DataFrame, term: str, held: DataFrame) -> DataFrame:
    """entries (id, name) that begin like the term and are within one of it in letters and sound
    together, with distance; only those whose id is in held (value_node_id)."""
    low = F.lower("name")
    distance = F.levenshtein(low, F.lit(term)) + F.levenshtein(F.soundex(low), F.soundex(F.lit(term)))
    near = entries.where(low.startswith(term[:1].lower())).select("id", "name", distance.alias("distance")).where("distance < 2")
    return near.join(held.select(F.col("value_node_id").alias("__h")).distinct(), F.col("id") == F.col("__h"), "left_semi")


#: Sound codes: the first letter, then the digits of the others, neighbours of one digit once.
SOUND_SQL = "rpad(left(upper(w), 1) || substr(regexp_replace(list_reduce(list_transform(string_split(translate(regexp_replace(lower(w), '(.)[hw]+', '\\1', 'g'), 'bfpvcgjkqsxzdtlmnraeiouy', '111122222222334556000000'), ''), lambda x: x), lambda a, x: CASE WHEN right(a, 1) = x THEN a ELSE a || x END), '0', '', 'g'), CASE WHEN regexp_matches(lower(w[1]), '[aeiouyhw]') THEN 1 ELSE 2 END), 4, '0')[1:4]"


@query(
    f"""SELECT id, name, levenshtein(w, 'finca') + levenshtein(s, 'F520') AS distance FROM (SELECT *, {SOUND_SQL} AS s FROM (SELECT id, lower(string_split(name, ' ')[1]) AS w, string_split(name, ' ')[1] AS name FROM domain_taxonomy_nodes WHERE parent_id <> 0)) WHERE starts_with(w, 'f') AND levenshtein(w, 'finca') + levenshtein(s, 'F520') < 2
 AND EXISTS (SELECT 1 FROM products p WHERE lower(trim(p.brand)) = (SELECT lower(n.name) FROM domain_taxonomy_nodes n WHERE n.id = x.id)) ORDER BY 3, 1""".replace("domain_taxonomy_nodes WHERE parent_id <> 0)) WHERE", "domain_taxonomy_nodes WHERE parent_id <> 0)) x WHERE")
)
def fuzzy_soundex(spark: SparkSession, d: str) -> DataFrame:
    """Entries that some listing names whose first word is within one of 'finca' in letters and sound together."""
    nodes = table(spark, d, "domain_taxonomy_nodes").where("parent_id <> 0")
    brands = table(spark, d, "products").select(F.lower(F.trim("brand")).alias("b")).distinct()
    held = nodes.join(brands, F.lower("name") == F.col("b")).select(F.col("id").alias("value_node_id"))
    return fuzzy_entries(nodes.select("id", F.split("name", " ")[0].alias("name")), "finca", held).withColumn("distance", F.col("distance").cast("long"))


@query(
    """SELECT source_product_id, own, round(hits / (1 + ln(len(ws))), 9) AS rank FROM (SELECT source_product_id, source_id = 101 AS own, ws, len(list_intersect(ws, ['old', 'vines', 'reserve'])) AS hits
 FROM (SELECT DISTINCT source_product_id, source_id, list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM products)) WHERE hits > 0 ORDER BY own DESC, rank DESC, source_product_id LIMIT 50"""
)
def fulltext_top50(spark: SparkSession, d: str) -> DataFrame:
    """Names that share words with a query, own source first, by overlap over length."""
    p = table(spark, d, "products").select("source_product_id", (F.col("source_id") == 101).alias("own"), X.simple_words(F.col("name")).alias("ws")).distinct()
    hits = F.size(F.array_intersect("ws", F.array(F.lit("old"), F.lit("vines"), F.lit("reserve"))))
    return p.select("source_product_id", "own", F.round(hits / (1 + F.log(F.size("ws"))), 9).alias("rank")).where("rank > 0").orderBy(F.desc("own"), F.desc("rank"), "source_product_id").limit(50)


@query(
    r"""SELECT doc_id, NOT (regexp_matches(l, '[0-9][0-9]') OR regexp_matches(l, '\(.*\)') OR contains(l, 'points')) AS fit_summary,
 NOT (contains(l, 'points') OR regexp_matches(l, '^[0-9][0-9]\(.*\)') OR regexp_matches(l, '[4-9][0-9]\+') OR (l = text AND starts_with(l, '(') AND ends_with(l, ')') AND length(l) > 1)) AS fit_sentence
 FROM (SELECT doc_id, text, split_part(text, chr(10), 1) AS l FROM documents WHERE text IS NOT NULL)"""
)
def summary_fit(spark: SparkSession, d: str) -> DataFrame:
    """Whether a text would do as a whole summary, and as one of its sentences."""
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", S.is_fit_summary(t).alias("fit_summary"), S.is_fit_sentence(t).alias("fit_sentence"))


#: The fold over sentences by falling score: a sentence that would reach the budget is skipped.
SCORED_SQL = f"SELECT doc_id, source || '/' || lang AS key, list_transform(ss, lambda s: CAST(regexp_matches(s, '(?i)notes? of|months|aged|trace of') AS DOUBLE)) AS scores, ss FROM ({Q.sentences("SELECT doc_id, source, lang, text FROM documents WHERE trim(text) <> ''", 'text', False)})"
BLOCKS_SQL = """SELECT *, list_filter(generate_series(1, len(ss)), lambda i: list_contains(kept, i)) AS k FROM (SELECT *, list_reduce(list_transform(list_sort(list_transform(generate_series(1, len(ss)), lambda i: struct_pack(m := -scores[i], i := i))), lambda x: [x.i]),
 lambda a, x: CASE WHEN coalesce(list_sum(list_transform(a, lambda j: len(string_split(ss[j], ' ')))), 0) + len(string_split(ss[x[1]], ' ')) < 50 THEN a || x ELSE a END, CAST([] AS BIGINT[])) AS kept FROM ({}))"""
BEST_SQL = f"""SELECT key, arg_max(text, (score, -doc_id)) AS text, max(score) AS score FROM (SELECT key, doc_id, array_to_string(list_transform(k, lambda j: ss[j]), ' ') AS text, coalesce(list_sum(list_transform(k, lambda j: scores[j])), 0) AS score FROM ({BLOCKS_SQL.format(SCORED_SQL)})) GROUP BY 1"""
FIT_SENTENCE_SQL = r"NOT (contains(split_part({s}, chr(10), 1), 'points') OR regexp_matches(split_part({s}, chr(10), 1), '^[0-9][0-9]\(.*\)|[4-9][0-9]\+') OR (NOT contains({s}, chr(10)) AND starts_with({s}, '(') AND ends_with({s}, ')') AND length({s}) > 1))"
FIT_SUMMARY_SQL = r"NOT (regexp_matches(split_part(text, chr(10), 1), '[0-9][0-9]|\(.*\)') OR contains(split_part(text, chr(10), 1), 'points'))"


@query(
    f"""SELECT key, score, CASE WHEN {FIT_SUMMARY_SQL} THEN text ELSE trim(array_to_string(list_transform(list_filter(ss, lambda s: {FIT_SENTENCE_SQL.format(s='s')}), lambda s: trim(s)), ' ')) END AS summary FROM ({Q.sentences(BEST_SQL, 'text', False)})"""
)
def summary_best_block(spark: SparkSession, d: str) -> DataFrame:
    """For each source and language the summary of its best document; a sentence scores 1 if it names a flavour or an age."""
    score = lambda s: F.when(s.rlike("(?i)notes? of|months|aged|trace of"), 1.0).otherwise(0.0)
    rows = table(spark, d, "documents").where(F.trim("text") != "").select(F.concat("source", F.lit("/"), "lang").alias("key"), F.col("doc_id").alias("ord"), F.transform(X.summary_sentences(F.col("text")), lambda s: F.struct(s.alias("text"), score(s).alias("score"))).alias("sentences"))
    return S.summarize(rows, "key")


@query(
    r"""WITH s AS (SELECT doc_id, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS w FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM documents)), k AS (SELECT * FROM s WHERE len(w) > 4),
 g AS (SELECT doc_id, pos, w, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM k) SELECT doc_id, min(pos) AS first_pos, string_agg(w, ' ' ORDER BY pos) AS items FROM g GROUP BY doc_id, i"""
)
def unprocessed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Maximal runs of consecutive words of more than four letters."""
    from terroir.operators.records import islands

    k = table(spark, d, "documents").select("doc_id", F.posexplode(X.simple_words(F.col("text"))).alias("pos", "w")).where("length(w) > 4")
    return islands(k, ["doc_id"], "pos", "w").withColumn("first_pos", F.col("first_pos").cast("long"))


@query(
    """WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, CAST(props->>'$.k' AS INTEGER) // 25 AS k FROM events), x AS (SELECT *, coalesce(k = lag(k) OVER (PARTITION BY user_id ORDER BY r) + 1, FALSE) AS goes FROM p),
 y AS (SELECT *, sum((NOT goes)::INT) OVER (PARTITION BY user_id ORDER BY r) AS g FROM x), z AS (SELECT user_id, g, count(*) AS c FROM y GROUP BY 1, 2) SELECT user_id, max(c) AS longest, arg_max(c, g) AS last FROM z GROUP BY 1"""
)
def run_length_last(spark: SparkSession, d: str) -> DataFrame:
    """Length of each user's longest and last run of values that go up by one from event to event."""
    from terroir.operators.records import run_lengths

    p = table(spark, d, "events").select("user_id", "event_id", F.floor(F.get_json_object("props", "$.k").cast("int") / 25).cast("int").alias("k"))
    p = p.withColumn("r", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")))
    return run_lengths(p, ["user_id"], "r", "k")


@query(
    r"""SELECT doc_id, pos, w, start FROM (SELECT doc_id, pos, w, coalesce(sum(len(w) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM
 (SELECT doc_id, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS w FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM documents)))"""
)
def word_positions(spark: SparkSession, d: str) -> DataFrame:
    """Each word with the offset at which it starts in the text of words."""
    k = table(spark, d, "documents").select("doc_id", F.posexplode(X.simple_words(F.col("text"))).alias("pos", "w"))
    before = F.sum(F.length("w") + 1).over(W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    return k.select("doc_id", F.col("pos").cast("long").alias("pos"), "w", F.coalesce(before, F.lit(0)).alias("start"))


@query("SELECT label, i, round(avg(x), 5) AS mean FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2")
def mean_vector(spark: SparkSession, d: str) -> DataFrame:
    from terroir.operators.records import mean_vector as mean

    e = table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("embedding"))
    return mean(e, ["label"], "embedding").select("label", F.posexplode("vector").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round("x", 5).alias("mean"))
