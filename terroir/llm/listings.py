"""Listings of the same product (problem 1).

1. Read: house, cuvée words, designation, grapes, vintage and size are read from columns and name,
   and words that many houses put beside their cuvées (selling words, learned from the table) go.
2. Records that say the same become one signature, so copies (a third of all rows may be copies of
   one listing) meet as one row.
3. Signatures are joined by set similarity on their normalised tokens: the letter triples of the
   cuvée and the grapes, weighted by rarity. Tokens are ordered by rarity; the side of less weight
   looks up only the prefix that a match can't miss, and position and length filters drop
   candidates. Misspelled cuvées may have few or no triples in common, so they are joined a second
   way, by a prefix of their letters that no misspelling can miss. House, vintage, size and
   designation are stated by every listing (by default no vintage, 750 ml, none), so they split the
   postings instead of being tokens; a listing whose house may be one of several stands in the
   postings of each.
4. Exact verification: the weighted containment of the candidates' tokens, where a cuvée that is a
   misspelling of the other counts as the same; then the parts that both sides state must not
   contradict each other.
5. Star clustering: in rounds, the heaviest signature among its neighbours becomes a centre and
   takes its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terroir.llm.canonical import map_values, reference_entries
from terroir.llm.listing_parts import Reader
from terroir.operators.units import common_units
from terroir.session import Shared, cut, spread

#: Reference entries that a reader may hold in memory (about 1 kB each); a longer list is refused.
MAX_ENTRIES = 200_000
#: Least weighted containment of matches.
CONTAINMENT = 0.7
#: Letters, in any order, in which a misspelled cuvée differs from another at most.
DIFFERENT = 2
#: A short spelling is an error of another if that is at least so many times as frequent.
ERROR_RATIO = 2.0
#: A phrase of up to so many words is a selling phrase if it stands beside a cuvée that the house has
#: without it, and at least as often, at so many houses.
PHRASE, SELLING_HOUSES = 3, 5
#: Letters of a cuvée from which one error is seen through by itself, and two in one stated once.
ONE_ERROR, TWO_ERRORS = 5, 7
#: Cuvées of up to so many letters and spaces have pairs of letters as tokens too.
SHORT = 8
#: Cuvées of up to so many letters, in which one error leaves no triple.
TINY = 4
HOUSE, GRAPE = 5, 7
RECORD = "source_product_id bigint, house bigint, houses array<bigint>, words array<string>, designation string, grapes array<bigint>, vintage string, size bigint, said bigint"
CELL = ["house", "vintage", "size", "designation"]


def read_listings(products: DataFrame, nodes: DataFrame, fx_rates: DataFrame) -> DataFrame:
    """One record for each source_product_id: RECORD. houses: the house, or all that it may be (house is -1 then), or none. said: equal for copies of one text."""
    entries = [(n, a, name) for a in (HOUSE, GRAPE) for n, _, name in reference_entries(nodes, a)]
    if len(entries) > MAX_ENTRIES:
        raise ValueError(f"the reference list has more than {MAX_ENTRIES} names")
    shared = Shared(products.sparkSession, Reader(entries))
    columns = ["name", "brand", "vintage", "varietals"]
    # a listing delivered twice is one; of differing versions the last loaded counts
    one = products.where("source_product_id is not null").groupBy("source_product_id").agg(F.max_by(F.struct("source_id", "bottle_size", "price", "alcohol_pct", "scraped_at", *columns), F.struct("loaded_at", *columns)).alias("r")).select("source_product_id", "r.*")
    one = cut(one)  # read three times below
    brands = map_values(one.select(F.col("brand").alias("value")).where("value is not null"), nodes, "brand")
    sizes = common_units(one, fx_rates, fields=["bottle_size"]).select("source_product_id", F.col("amount").cast("double").alias("ml"))
    # rows without a brand have a key each, so that they don't meet in one task
    key = F.coalesce("brand", F.concat(F.lit("\0"), F.col("source_product_id").cast("string")))
    rows = one.select("source_product_id", *columns, key.alias("value"), F.xxhash64(*columns).alias("said")).join(brands, "value", "left").join(sizes, "source_product_id", "left")

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text = lambda x: x if isinstance(x, str) else None
        for pdf in it:
            out = []
            for r in pdf.itertuples(index=False):
                p = shared.value.read(text(r.name), int(r.node_id) if r.node_id == r.node_id and r.node_id is not None else -1, text(r.varietals), text(r.vintage), float(r.ml) if r.ml == r.ml and r.ml is not None else None)
                out.append((r.source_product_id, p.house, list(p.houses) if p.house < 0 else [p.house], list(p.cuvee), p.designation, sorted(p.grapes), p.vintage, p.size, r.said))
            yield pd.DataFrame(out, columns=["source_product_id", "house", "houses", "words", "designation", "grapes", "vintage", "size", "said"])

    return spread(rows.select("source_product_id", "name", "varietals", "vintage", F.col("node_id"), "ml", "said")).mapInPandas(read, RECORD)


def _phrases(cuvees: DataFrame) -> DataFrame:
    """Adds at, k and phrase (numbers as '#') for each run of up to PHRASE words; runs of numbers aren't phrases."""
    at = cuvees.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("words")))).withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(1, PHRASE + 1)])))
    at = at.where("at + k - 1 <= size(words)")
    phrase = F.array_join(F.transform(F.slice("words", F.col("at"), F.col("k")), lambda w: F.regexp_replace(w, "[0-9]+", "#")), " ")
    return at.withColumn("phrase", phrase).where("phrase rlike '[^# ]'")


def drop_selling_words(records: DataFrame) -> DataFrame:
    """Records without the selling phrases of the table itself, which no list has to name."""
    cuvees = records.where("size(words) > 0").groupBy("house", "words").agg(F.count(F.lit(1)).alias("n"))
    alone = cuvees.groupBy("house", F.array_join("words", " ").alias("rest")).agg(F.sum("n").alias("n_rest"))
    phrases = _phrases(cuvees)
    rest = F.concat(F.slice("words", F.lit(1), F.col("at") - 1), F.slice("words", F.col("at") + F.col("k"), F.size("words")))
    beside = phrases.where("k < size(words)").groupBy("house", "phrase", F.array_join(rest, " ").alias("rest")).agg(F.sum("n").alias("n"))
    counted = beside.join(alone, ["house", "rest"]).where("n_rest >= n").groupBy("phrase").agg(F.countDistinct("house").alias("houses"), F.sum("n").alias("n")).where(F.col("houses") >= SELLING_HOUSES)
    # what mostly stands by itself is a cuvée that selling phrases stand beside
    itself = phrases.where("k = size(words)").groupBy("phrase").agg(F.sum("n").alias("n_itself"))
    selling = counted.join(itself, "phrase", "left").where("n > coalesce(n_itself, 0)").select("phrase")
    places = F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("at"), F.col("at") + F.col("k") - 1))))
    held = phrases.join(selling, "phrase").groupBy("house", "words").agg(places.alias("sold"))
    out = records.join(held, ["house", "words"], "left")
    kept = F.filter(F.transform("words", lambda w, i: F.when(~F.array_contains("sold", i + 1), w)), lambda w: w.isNotNull())
    return out.withColumn("words", F.when(F.col("sold").isNotNull(), kept).otherwise(F.col("words"))).drop("sold")


def with_signature(records: DataFrame) -> DataFrame:
    """Adds cuvee (the words in the order of the alphabet, so that their order says nothing) and sig."""
    out = records.withColumn("cuvee", F.array_join(F.array_sort("words"), " ")).drop("words")
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    said = [listed("houses"), *[F.col(k).cast("string") for k in (*CELL[1:], "cuvee")]]
    return out.withColumn("sig", F.md5(F.concat_ws("\x1f", *said, listed("grapes"))))


def signatures(records: DataFrame) -> DataFrame:
    """Distinct records: sig, houses, CELL, cuvee, grapes, n (listings), often (listings of the house with this cuvée), texts (distinct ones of these)."""
    out = records.groupBy("sig", "houses", *CELL, "cuvee", "grapes").agg(F.count(F.lit(1)).alias("n"))
    often = records.groupBy("houses", "cuvee", "said").agg(F.count(F.lit(1)).alias("n")).groupBy("houses", "cuvee").agg(F.sum("n").alias("often"), F.count(F.lit(1)).alias("texts"))
    return out.join(often, ["houses", "cuvee"])


def tokens_of() -> Column:
    """A signature's distinct tokens: letter triples of the cuvée's words (of a short cuvée pairs too, of
    a tiny one pairs and what is left without one letter; one token if there is none) and grapes."""
    grams = lambda w, k: F.transform(F.sequence(F.lit(1), F.length(w) + 3 - k), lambda i: F.concat(F.lit("c:"), F.substring(F.concat(F.lit("^"), w, F.lit("$")), i, F.lit(k))))
    words = F.split("cuvee", " ")
    triples = F.flatten(F.transform(words, lambda w: grams(w, 3)))
    pairs = F.when(F.length("cuvee") <= SHORT, F.flatten(F.transform(words, lambda w: grams(w, 2)))).otherwise(F.array().cast("array<string>"))
    letters = F.replace("cuvee", F.lit(" "))
    without = F.transform(F.sequence(F.lit(1), F.length(letters)), lambda i: F.concat(F.lit("c:-"), F.substring(letters, F.lit(1), i - 1), F.substring(letters, i + 1, F.length(letters))))
    cuvee = F.when(F.col("cuvee") == "", F.array(F.lit("c:"))).when(F.length(letters) <= TINY, F.concat(pairs, without)).otherwise(F.concat(triples, pairs))
    return F.array_distinct(F.concat(cuvee, F.transform("grapes", lambda g: F.concat(F.lit("g:"), g.cast("string")))))


def misspelled(a: Column, b: Column, often_a: Column, often_b: Column, once: Column | None = None) -> Column:
    """Whether two cuvées (words in the order of the alphabet) are one: in their words that the other
    doesn't have, they are the same letters but for a space, one edit apart (a short cuvée only where
    one side is much rarer), or two edits in a long one that stands once.

    once: whether one side stands once (by default in one listing). A swap of neighbours is one edit. Numbers must be equal ('Barrl 40' is 'Barrel 40', never
    'Barrel 41').
    """
    own = [F.array_except(F.split(c, " "), F.split(d, " ")) for c, d in ((a, b), (b, a))]
    x, y = (F.array_join(w, "") for w in own)
    letters = F.least(*[F.length(F.regexp_replace(c, "[0-9 ]", "")) for c in (a, b)])
    distance = F.levenshtein(x, y, 4)
    bag = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    swapped = bag(x) == bag(y)
    one = (distance == 1) | ((distance == 2) & swapped & (F.length(x) == F.length(y)))
    two = (distance == 2) | ((distance == 4) & swapped) | ((distance == 3) & (F.levenshtein(bag(x), bag(y), 2) >= 0))
    rarer = F.greatest(often_a, often_b) >= F.least(often_a, often_b) * ERROR_RATIO
    numbers = lambda c: F.regexp_extract_all(c, F.lit("([0-9]+)"), F.lit(1))
    error = (one & ((letters >= ONE_ERROR) | rarer)) | (two & (letters >= TWO_ERRORS) & (F.least(often_a, often_b) == 1 if once is None else once))
    glued = swapped & (F.size(own[0]) != F.size(own[1])) & (F.least(F.size(own[0]), F.size(own[1])) == 1)
    return (a == b) | glued | ((F.length(x) > 0) & (F.length(y) > 0) & (numbers(a) == numbers(b)) & error)


def weighted_bags(sigs: DataFrame) -> DataFrame:
    """sig, cell, bag (array of (minus, t, before): rarest first, with the weight before each), total."""
    own = sigs.select("sig", F.xxhash64(*CELL).alias("cell"), F.explode(tokens_of()).alias("t"))
    frequency = own.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    n = F.lit(float(max(sigs.count(), 1)))
    weighed = own.join(frequency, "t").groupBy("sig", "cell").agg(F.array_sort(F.collect_list(F.struct((-F.log(1 + n / F.col("df"))).alias("minus"), "t"))).alias("b"))
    empty = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<struct<t:string,w:double,before:double>>").alias("bag"))
    run = F.aggregate("b", empty, lambda s, x: F.struct((s["sum"] - x["minus"]).alias("sum"), F.array_append(s["bag"], F.struct(x["t"].alias("t"), (-x["minus"]).alias("w"), s["sum"].alias("before"))).alias("bag")))
    return weighed.select("sig", "cell", run.alias("r")).select("sig", "cell", "r.bag", F.col("r.sum").alias("total"))


def letter_keys(sigs: DataFrame) -> DataFrame:
    """sig, cell, cuvee, size (its letters) and key: misspelled() cuvées of a cell have a key in common.

    The letters of the distinct words, numbered (the second e is another letter than the first), are a
    set, and misspelled cuvées have all letters in common but DIFFERENT of the larger set. So two of
    the first DIFFERENT + 2 letters in any one order are in common; here the rarest come first, and two
    marks follow the letters for cuvées that are shorter. The keys are the pairs of these letters.
    """
    of = sigs.select("sig", F.xxhash64(*CELL).alias("cell"), "cuvee", F.array_sort(F.regexp_extract_all(F.array_join(F.array_distinct(F.split("cuvee", " ")), ""), F.lit("(?s)."), F.lit(0))).alias("letters"))
    # any order is right, so rare letters needn't be told apart by their numbers
    common = F.lit("".join(r.c for r in of.select(F.explode("letters").alias("c")).groupBy("c").count().orderBy(F.desc("count"), "c").limit(64).collect()))
    rank = lambda c: F.when(F.instr(common, c) > 0, -F.instr(common, c)).otherwise(-1000)
    numbered = F.transform("letters", lambda c, i: F.struct((F.array_position("letters", c) - i).cast("int").alias("nth"), rank(c).alias("rank"), c.alias("c")))
    marks = F.array(*[F.struct(F.lit(2).alias("nth"), F.lit(0).alias("rank"), F.lit(m).alias("c")) for m in "12"])
    first = of.select("sig", "cell", "cuvee", F.size("letters").alias("size"), F.slice(F.array_sort(F.concat(numbered, marks)), 1, DIFFERENT + 2).alias("first"))
    keys = F.flatten(F.transform("first", lambda x, i: F.transform(F.slice("first", i + 2, DIFFERENT + 2), lambda y: F.xxhash64(x, y))))
    return first.select("sig", "cell", "cuvee", "size", F.explode(keys).alias("key"))


def similar(sigs: DataFrame) -> DataFrame:
    """a, b (a < b): signatures that pass the join and contradict each other in no part. A signature
    with several rows, of different cells, is compared in each; where sigs has no texts, each listing
    counts as one."""
    sigs = sigs if "texts" in sigs.columns else sigs.withColumn("texts", F.col("often"))
    # a signature that is alone in its cell can't meet another
    crowded = sigs.groupBy(*CELL).agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    sigs = cut(sigs.join(crowded.select(*CELL), CELL, "left_semi"))
    bags = cut(weighted_bags(sigs))
    left = bags.alias("l").select("cell", F.col("sig").alias("a"), F.col("total").alias("a_total"), F.explode("bag").alias("x"))
    # the prefix can't be missed: what stands behind it is less than a match needs
    left = left.where(F.col("x.before") <= F.col("a_total") * (1 - CONTAINMENT)).select("cell", "a", "a_total", F.col("x.t").alias("t"), (F.col("a_total") - F.col("x.before")).alias("a_rest"))
    right = bags.select("cell", F.col("sig").alias("b"), F.col("total").alias("b_total"), F.explode("bag").alias("x")).select("cell", "b", "b_total", F.col("x.t").alias("t"), (F.col("b_total") - F.col("x.before")).alias("b_rest"))
    # the side of less weight looks up; at the first token in common no more than both rests is in common
    order = F.struct("a_total", "a") < F.struct("b_total", "b")
    position = F.least("a_rest", "b_rest") >= F.col("a_total") * CONTAINMENT
    weighed = left.join(right, ["cell", "t"]).where(order & position).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # cuvées that aren't equal meet by their letters too, since an error in them may take all that is in common
    keys = letter_keys(sigs)
    x, y = (keys.select("cell", "key", *[F.col(c).alias(f"{x}_{c}" if c != "sig" else x) for c in ("sig", "cuvee", "size")]) for x in "ab")
    spelled = x.join(y, ["cell", "key"]).where((F.col("a") < F.col("b")) & (F.col("a_cuvee") != F.col("b_cuvee")) & (F.abs(F.col("a_size") - F.col("b_size")) <= DIFFERENT)).select("a", "b")
    pairs = weighed.unionByName(spelled).distinct()
    parts = bags.select("sig", "bag", "total").dropDuplicates(["sig"]).join(sigs.select("sig", "cuvee", "grapes", "often", "texts").dropDuplicates(["sig"]), "sig")
    both = pairs
    for x in "ab":
        both = both.join(parts.select(*[F.col(c).alias(f"{x}_{c}" if c != "sig" else x) for c in parts.columns]), x)
    # copies of a text don't make an error a spelling, however often a table holds them
    same = misspelled(F.col("a_cuvee"), F.col("b_cuvee"), F.col("a_often"), F.col("b_often"), F.least("a_texts", "b_texts") == 1)
    grapes = F.arrays_overlap("a_grapes", "b_grapes") | (F.size("a_grapes") == 0) | (F.size("b_grapes") == 0)
    less, more = (F.when(o, F.col("a_bag")).otherwise(F.col("b_bag")) for o in (order, ~order))
    kept = both.where(grapes).withColumn("same", same).where("same").select("a", "b", less.alias("less"), F.transform(more, lambda t: t["t"]).alias("more"), F.least("a_total", "b_total").alias("total"))
    # an error in the cuvée takes no letters from what is in common
    shared = F.aggregate(F.filter("less", lambda t: t["t"].startswith("c:") | F.array_contains("more", t["t"])), F.lit(0.0), lambda s, t: s + t["w"])
    return kept.where(shared >= F.col("total") * CONTAINMENT).select("a", "b")


def stars(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """sig, center of every node (sig, w): rounds in which a node heavier than all of its neighbours
    that are left becomes a centre and takes them. links: a, b in both directions."""
    weigh = lambda x: nodes.select(F.col("sig").alias(x), F.col("w").alias(f"w{x}"))
    left = cut(links.join(weigh("a"), "a").join(weigh("b"), "b"))
    done: list[DataFrame] = []
    while not left.isEmpty():
        best = left.groupBy("a").agg(F.max("wb").alias("best"), F.first("wa").alias("wa"))
        centers = best.where("wa > best").select(F.col("a").alias("b"))
        taken = left.join(centers, "b", "left_semi").groupBy("a").agg(F.max_by("b", "wb").alias("center"))
        new = cut(taken.select(F.col("a").alias("sig"), "center").unionByName(centers.select(F.col("b").alias("sig"), F.col("b").alias("center"))))
        done.append(new)
        gone = new.select("sig")
        left = cut(left.join(gone, F.col("a") == F.col("sig"), "left_anti").join(gone, F.col("b") == F.col("sig"), "left_anti"))
    placed = reduce(DataFrame.unionByName, done) if done else nodes.select("sig", F.col("sig").alias("center")).limit(0)
    return nodes.select("sig").join(placed, "sig", "left").select("sig", F.coalesce("center", "sig").alias("center"))


def joined(placed: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """placed (sig, center) and nodes (sig, w), each of which joins the only centre that it fits; those
    that fit none or several are clustered among themselves. links: a, b in both directions."""
    if nodes.isEmpty():
        return placed
    ends = [nodes.select(F.col("sig").alias(x)) for x in "ab"]
    fits = links.join(ends[0], "a", "left_semi").join(placed.withColumnRenamed("sig", "b"), "b").groupBy("a").agg(F.min("center").alias("lo"), F.max("center").alias("hi"))
    vague = nodes.join(fits, F.col("sig") == F.col("a"), "left").withColumn("one", F.coalesce(F.col("lo") == F.col("hi"), F.lit(False)))
    vague = cut(vague.select("sig", "w", "lo", "one"))
    rest = vague.where("not one").select("sig", "w")
    among = links.join(rest.select(F.col("sig").alias("a")), "a", "left_semi").join(rest.select(F.col("sig").alias("b")), "b", "left_semi")
    return placed.unionByName(vague.where("one").select("sig", F.col("lo").alias("center"))).unionByName(stars(rest, among))


def star_clusters(sigs: DataFrame, edges: DataFrame) -> DataFrame:
    """sig, center. Signatures with house and grapes are clustered first, so that none that leaves
    these open ties two that contradict each other; then those without grapes, then those whose
    house may be one of several."""
    links = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # the house's commonest spelling leads; by powers of two and then by hash, so that no chain of
    # falling weights makes many rounds. Of equals the one with most neighbours leads: fewest links
    # are cut, and the spelling that the others are errors of is the one near to all
    near = links.groupBy(F.col("a").alias("sig")).agg(F.count(F.lit(1)).alias("near"))
    power = lambda c: F.floor(F.log2(c))
    level = F.when(F.size("houses") == 1, F.when(F.size("grapes") > 0, 0).otherwise(1)).otherwise(F.when(F.size("grapes") > 0, 2).otherwise(3))
    nodes = cut(sigs.join(near, "sig", "left").select("sig", level.alias("level"), F.struct(power("often").alias("o"), power("n").alias("n"), power(F.coalesce("near", F.lit(1))).alias("near"), F.xxhash64("sig").alias("h")).alias("w")))
    told = [nodes.select(F.col("sig").alias(x), F.col("level").alias(f"{x}_level")) for x in "ab"]
    links = cut(links.join(told[0], "a").join(told[1], "b"))
    clusters = cut(stars(nodes.where("level = 0").select("sig", "w"), links.where("a_level = 0 and b_level = 0").select("a", "b")))
    for k in (1, 2, 3):
        clusters = joined(clusters, nodes.where(f"level = {k}").select("sig", "w"), links.where(f"a_level = {k} and b_level <= {k}").select("a", "b"))
    return clusters


def product_groups(products: DataFrame, nodes: DataFrame, fx_rates: DataFrame) -> DataFrame:
    """source_product_id, group_id (the centre's signature): every listing with its class.

    A listing that may be of several houses, since its name fits them all, joins the only group of
    theirs that it fits. A listing without any stated house is a group of its own, since it can't be
    told whose bottle it is. Rows without source_product_id are left out; repeated rows count once; extra columns
    are ignored; an empty table gives an empty one.
    """
    read = cut(read_listings(products, nodes, fx_rates))
    records = cut(with_signature(drop_selling_words(read)))
    told = records.where("size(houses) > 0")
    sigs = cut(signatures(told))
    clusters = star_clusters(sigs, cut(similar(sigs.withColumn("house", F.explode("houses")))))
    known = told.select("source_product_id", "sig").join(clusters, "sig").select("source_product_id", F.col("center").alias("group_id"))
    return known.unionByName(records.where("size(houses) = 0").select("source_product_id", F.concat(F.lit("listing "), F.col("source_product_id").cast("string")).alias("group_id")))


def product_pairs(groups: DataFrame) -> DataFrame:
    """source_product_id_a < source_product_id_b of every two listings of one group."""
    a, b = (groups.select("group_id", F.col("source_product_id").alias(f"source_product_id_{x}")) for x in "ab")
    return a.join(b, "group_id").where("source_product_id_a < source_product_id_b").select("source_product_id_a", "source_product_id_b")
