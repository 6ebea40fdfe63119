"""The best value of each field of a group of duplicate records (problem 3).

1. Usable values: a value must say something about this product. Texts that stand in many groups
   (with the shop's name masked), repetitions of the name, placeholders, missing pictures and
   impossible amounts are out.
2. Truth discovery: where the groups' values can contradict each other (regions, as places in a
   tree), the sources' reliability and the values' weighted votes are estimated in turns until they
   settle; a value outvoted by a contradicting one isn't true.
3. Of the true values of a field the one that its preference puts first survives: the longest
   visible text, the most trusted source's picture, the latest list price, the deepest region.
   These fields' values complement rather than contradict each other, so votes don't rank them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terroir.functions.numbers import stated_number
from terroir.llm.canonical import NONE, map_values
from terroir.llm.words import visible, words
from terroir.session import cut, small

#: A text is boilerplate if it stands in at least so many groups and this share of all groups, or in
#: so many groups of one shop and this share of the shop's groups, however large the table is.
BOILERPLATE_GROUPS, BOILERPLATE_SHARE, SHOP_SHARE = 3, 0.002, 0.01
#: Words of texts that stand for a missing one.
PLACEHOLDER = re.compile(r"^(?:tbd|tba|n a|na|null|none|nil|nan|test(?: test)*|unknown|undefined|lorem ipsum.*|(?:no|without) (?:description|notes?).*|(?:tasting )?(?:description|notes?) (?:coming soon|to follow|follow)|coming soon|see (?:winery|producer|our) (?:website|site).*|see label|description)$")
PICTURE_WORDS = r"(?i)default|placeholder|no[-_ ]?image|noimage|coming[-_ ]?soon|undefined|^null|^none|^n/?a\b|(?:^|[^0-9])1x1|spacer|blank\.|missing|dummy"
FIELDS = ("description", "image", "msrp", "region")


def _texts(records: DataFrame, sources: DataFrame) -> DataFrame:
    """record_id, visible length, hash of the masked words, and whether it only repeats the name."""
    shops = sources.select(F.col("source_id").alias("__s"), F.concat_ws(" ", "source_code", F.split("source_name", " ")[0]).alias("shop")).dropDuplicates(["__s"])
    rows = records.join(small(shops), F.col("source_id") == F.col("__s"), "left").select("record_id", "master_product_id", F.coalesce("source_id", F.lit(-1).cast("long")).alias("source_id"), "description", "name", "brand", "shop").where(F.length(F.trim("description")) > 0)

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for r in pdf.itertuples(index=False):
                text = " ".join(visible(r.description).split())
                text = re.sub(r"^[\"“”'«]+(.*?)[\"“”'»]+$", r"\1", text).strip()
                ws = words(text)
                shop = set(words(r.shop if isinstance(r.shop, str) else ""))
                masked = " ".join("*" if w in shop else w for w in ws)
                own = set(words(f"{r.name if isinstance(r.name, str) else ''} {r.brand if isinstance(r.brand, str) else ''}"))
                repeats = len(set(ws) - own) <= 1 and len(ws) <= len(own) + 2
                empty = not ws or bool(PLACEHOLDER.match(" ".join(ws)))
                out.append((r.record_id, r.master_product_id, r.source_id, len(text), masked, repeats or empty))
            yield pd.DataFrame(out, columns=["record_id", "master_product_id", "source_id", "visible", "masked", "worthless"])

    return rows.mapInPandas(read, "record_id bigint, master_product_id bigint, source_id bigint, visible int, masked string, worthless boolean").withColumn("text", F.md5("masked")).drop("masked")


def usable_texts(records: DataFrame, sources: DataFrame) -> DataFrame:
    """record_id, visible: the descriptions that tell something of their product."""
    texts = cut(_texts(records, sources))
    groups = records.select("master_product_id").distinct().count()
    shops = records.groupBy("source_id").agg(F.countDistinct("master_product_id").alias("all"))
    placed = texts.groupBy("text", "source_id", "master_product_id").agg(F.lit(1).alias("one"))
    anywhere = placed.groupBy("text", "master_product_id").agg(F.lit(1).alias("one")).groupBy("text").agg(F.count("one").alias("groups")).where(F.col("groups") >= max(BOILERPLATE_GROUPS, groups * BOILERPLATE_SHARE))
    at_shop = placed.groupBy("text", "source_id").agg(F.count("one").alias("groups")).where(F.col("groups") >= BOILERPLATE_GROUPS).join(small(shops), "source_id").where(F.col("groups") >= F.col("all") * SHOP_SHARE)
    common = cut(anywhere.select("text").unionByName(at_shop.select("text")).distinct())
    return texts.where("not worthless").join(small(common), "text", "left_anti").select("record_id", "visible")


def usable_picture(c: Column) -> Column:
    """An address of a file that isn't a stand-in."""
    file = F.regexp_extract(F.trim(c), r"^(?:https?:)?//[^/]+/(?:.*/)?([^/?#]+)(?:[?#].*)?$", 1)
    return (F.length(file) > 0) & ~file.rlike(PICTURE_WORDS)


def usable_amount(msrp: Column, price: Column) -> Column:
    """The amount, null if it can't be one: none, zero, negative, all nines, far from the price."""
    amount, paid = stated_number(msrp), stated_number(price)
    nines = F.regexp_replace(F.regexp_replace(msrp, r"[^0-9]", ""), r"0+$", "").rlike(r"^9{4,}$")
    far = F.coalesce((paid > 0) & ((amount > paid * 20) | (amount < paid / 20)), F.lit(False))
    return F.when((amount > 0) & ~F.coalesce(nines, F.lit(False)) & ~far, amount)


def true_places(claims: DataFrame, rounds: int = 30, tolerance: float = 1e-3) -> DataFrame:
    """group, node of the claimed places that aren't outvoted.

    claims: group, source, node, path (ids from the root to the node). A claim votes, by its
    source's reliability, for its node and all nodes above; at each depth the place with the most
    votes wins (ties: the smallest id), and a claim is true if all of its path won. A source's
    reliability is the smoothed share of its claims that are true. Rounds end when no reliability
    changes by more than the tolerance; where they swing to and fro, each is the mean of two rounds.
    """
    claims = cut(claims.groupBy("group", "source", "node").agg(F.first("path").alias("path")))
    # where all claims of a group lie on one path, all are true whatever the sources' reliability is:
    # they only count for their sources, and the rounds work on the other groups
    places = claims.select("group", F.posexplode("path").alias("depth", "place")).groupBy("group", "depth").agg((F.min("place") < F.max("place")).alias("split"))
    split = cut(places.where("split").select("group").distinct())
    if split.isEmpty():
        return claims.select("group", "node").distinct()
    sure = claims.join(split, "group", "left_anti")
    contested = cut(claims.join(split, "group", "left_semi"))
    agreed = sure.groupBy("source").agg(F.count(F.lit(1)).alias("sure"))
    reliability = contested.select("source").distinct().join(agreed, "source", "left").select("source", F.coalesce("sure", F.lit(0)).alias("sure"), F.lit(0.8).alias("r"))
    for k in range(rounds):
        votes = contested.join(small(reliability), "source").select("group", "r", F.posexplode("path").alias("depth", "place")).groupBy("group", "depth", "place").agg(F.sum("r").alias("v"))
        won = votes.groupBy("group", "depth").agg(F.max(F.struct("v", (-F.col("place")).alias("m"))).alias("w")).groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("depth", (-F.col("w.m")).alias("place")))).alias("won"))
        judged = contested.join(won, "group").withColumn("is_true", F.forall(F.transform("path", lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: F.col("won")[x["i"]] == x["p"]))
        counts = judged.groupBy("source").agg(F.count_if("is_true").alias("held"), F.count(F.lit(1)).alias("said")).join(small(reliability.withColumnRenamed("r", "old")), "source")
        r = (F.col("held") + F.col("sure") + 4) / (F.col("said") + F.col("sure") + 5)
        new = cut(counts.select("source", "sure", (r if k < 8 else (r + F.col("old")) / 2).alias("r"), F.abs(r - F.col("old")).alias("change")))
        change = new.agg(F.max("change")).first()[0]
        reliability = new.select("source", "sure", "r")
        if change is None or change < tolerance:
            break
    else:
        raise ValueError(f"the sources' reliability doesn't settle in {rounds} rounds")
    return sure.select("group", "node").unionByName(judged.where("is_true").select("group", "node")).distinct()


def usable_regions(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """record_id, depth: the records whose region is a place of the list and isn't outvoted."""
    stated = records.select("record_id", F.col("master_product_id").alias("group"), F.col("source_id").alias("source"), F.col("region").alias("value")).where(F.length(F.trim("value")) > 0)
    meant = cut(map_values(stated, nodes, "region").where(F.col("node_id") != NONE))
    path = nodes.select(F.col("id").alias("node"), F.array_append(F.from_json("ancestor_node_path", "array<bigint>"), F.col("id")).alias("path"))
    path = path.select("node", F.coalesce(F.array_distinct("path"), F.array("node")).alias("path")).dropDuplicates(["node"])
    # few values are most rows: the distinct ones are small, or AQE splits what is hot
    claims = cut(stated.join(small(meant), "value").withColumnRenamed("node_id", "node").join(small(path), "node").withColumn("source", F.coalesce("source", F.lit(-1).cast("long"))))
    true = true_places(claims.select("group", "source", "node", "path"))
    return claims.join(true, ["group", "node"], "left_semi").select("record_id", F.size("path").alias("depth"))


def survivors(records: DataFrame, sources: DataFrame, nodes: DataFrame) -> DataFrame:
    """master_product_id, field_name, record_id, value: the surviving value of each field.

    Groups of one record have no row, nor have fields without a usable value. Ties go to the
    latest scraped_at (null is earliest), then the largest record_id. A source without a trust
    rank is trusted least. Rows without master or record id are left out; repeated rows count once.
    """
    one = records.where("master_product_id is not null and record_id is not null").groupBy("record_id").agg(F.max(F.struct("scraped_at", "master_product_id", "source_id", "name", "brand", "price", "msrp", "region", "image", "description")).alias("r")).select("record_id", "r.*")
    one = cut(one)
    rank = sources.groupBy(F.col("source_id").alias("__s")).agg(F.min("trust_rank").alias("rank"))
    rows = one.join(usable_texts(one, sources), "record_id", "left").join(usable_regions(one, nodes), "record_id", "left").join(small(rank), F.col("source_id") == F.col("__s"), "left")
    tie = [F.col("scraped_at"), F.col("record_id")]
    trust = -F.coalesce("rank", F.lit(2_147_483_647))
    order = {"description": F.struct(F.col("visible").cast("long").alias("k"), *tie), "image": F.struct(F.when(usable_picture(F.col("image")), trust).cast("long").alias("k"), *tie), "msrp": F.struct(F.when(usable_amount(F.col("msrp"), F.col("price")).isNotNull(), 0).cast("long").alias("k"), *tie), "region": F.struct(F.col("depth").cast("long").alias("k"), *tie)}
    best = rows.groupBy("master_product_id").agg(F.count(F.lit(1)).alias("n"), *[F.max_by(F.struct("record_id", F.col(f).alias("value")), F.when(order[f]["k"].isNotNull(), order[f])).alias(f) for f in FIELDS]).where("n >= 2")
    out = best.select("master_product_id", F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f)["record_id"].alias("record_id"), F.col(f)["value"].alias("value")) for f in FIELDS])))
    return out.where("record_id is not null")
