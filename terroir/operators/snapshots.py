"""What changed between consecutive full snapshots (problem 5).

Each key is windowed by the index of its snapshots: a lagged hash that differs is a change, a gap
in the index is a removal and a later addition. A key has at most one row per snapshot after the
first aggregate, which is combined map-side, so no key can become a hot group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terroir.functions.numbers import blank_to_null, stated_number
from terroir.session import small


def same_text(c: Column) -> Column:
    """Text without case and without differences in blanks; blank is null."""
    return F.lower(blank_to_null(F.regexp_replace(c, r"(?U)[\s​﻿]+", " ")))


def same_number(c: Column) -> Column:
    """The number a text states, else the text itself; blank is null."""
    return F.coalesce(stated_number(c).cast("string"), same_text(c))


def index_runs(runs: DataFrame, group: str, run: str, start: str) -> DataFrame:
    """group, run, __idx (1..n by start), __n, __next (the next run's id)."""
    over = W.partitionBy(group).orderBy(start, run)
    whole = W.partitionBy(group)
    return runs.select(F.col(group).alias("__group"), F.col(run).alias("__run"), F.row_number().over(over).alias("__idx"), F.count(F.lit(1)).over(whole).alias("__n"), F.lead(run).over(over).alias("__next"))


def snapshot_changes(rows: DataFrame, runs: DataFrame, *, group: str, run: str, start: str, key: str, compared: dict[str, Column], latest: str) -> DataFrame:
    """group, run (the later one), key, change_kind: added, removed or changed.

    runs: the snapshots to compare, one row each; rows of other runs are left out. Of several rows
    of a key in one run the last by `latest` counts (ties: the largest compared values). A null
    key is a key like any other. A group's first run yields nothing.
    """
    index = index_runs(runs, group, run, start)
    vals = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(compared.values())])
    one = rows.select(F.col(run).alias("__run"), F.col(key).alias("__key"), F.col(latest).alias("__at"), vals.alias("__vals")).groupBy("__run", "__key").agg(F.max_by("__vals", F.struct("__at", "__vals")).alias("__vals"))
    seen = one.join(small(index), "__run").select("__group", "__key", "__run", "__idx", "__n", "__next", F.xxhash64("__vals").alias("__hash"))
    over = W.partitionBy("__group", "__key").orderBy("__idx")
    seen = seen.select("*", F.lag("__idx").over(over).alias("__before"), F.lag("__hash").over(over).alias("__was"), F.lead("__idx").over(over).alias("__after"))
    fresh = (F.col("__idx") > 1) & (F.col("__before").isNull() | (F.col("__before") < F.col("__idx") - 1))
    changed = (F.col("__before") == F.col("__idx") - 1) & (F.col("__was") != F.col("__hash"))
    gone = (F.col("__idx") < F.col("__n")) & (F.col("__after").isNull() | (F.col("__after") > F.col("__idx") + 1))
    said = F.array(
        F.when(fresh, F.struct(F.col("__run").alias("r"), F.lit("added").alias("k"))).when(changed, F.struct(F.col("__run").alias("r"), F.lit("changed").alias("k"))),
        F.when(gone, F.struct(F.col("__next").alias("r"), F.lit("removed").alias("k"))),
    )
    out = seen.select("__group", "__key", F.inline(F.filter(said, lambda x: x.isNotNull())))
    return out.select(F.col("__group").alias(group), F.col("r").alias(run), F.col("__key").alias(key), F.col("k").alias("change_kind"))


def catalogue_changes(update_products: DataFrame, pipeline_sequence: DataFrame) -> DataFrame:
    ready = pipeline_sequence.where(F.col("state") == "ready").select("source_id", "sequence_id", "start_time").dropDuplicates(["sequence_id"])
    compared: Sequence[tuple[str, Column]] = [("name", same_text(F.col("name"))), ("price", same_number(F.col("price"))), ("qoh", same_number(F.col("qoh")))]
    return snapshot_changes(update_products, ready, group="source_id", run="sequence_id", start="start_time", key="single_product_url", compared=dict(compared), latest="loaded_at")
