"""History of changing attributes from an event log (problem 2).

Each attribute keeps its own change log with its own intervals; the histories are then combined
by splitting at the union of their boundaries and coalescing neighbours that are equal.

One key may hold a third of all events, so keys with more than HOT_ROWS events are cut into time
slots: their rows are windowed within (key, slot), and one small row per (key, slot) is windowed
over the key to carry the last known values from slot to slot. Other keys are one slot. All steps
keep the partitioning by (key, slot), so the events are shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terroir.session import BROADCAST_ROWS, small

SLOT, HASH = "__slot", "__hash"
HOT_ROWS = 100_000


def _null_safe(a: DataFrame, b: DataFrame, on: Sequence[str], slots: int) -> DataFrame:
    """a left join b on columns that may be null; b's other columns are added.

    b has at most `slots` rows, which decides whether it is broadcast.
    """
    b = b.select(*[F.col(k).alias(f"__r_{k}") for k in on], *[c for c in b.columns if c not in on])
    b = F.broadcast(b) if slots <= BROADCAST_ROWS else b
    cond: Column | None = None
    for k in on:
        part = a[k].eqNullSafe(b[f"__r_{k}"])
        cond = part if cond is None else cond & part
    return a.join(b, cond, "left").drop(*[f"__r_{k}" for k in on])


def in_slots(df: DataFrame, keys: Sequence[str], at: str, slot_seconds: int, hot_rows: int) -> tuple[DataFrame, int]:
    """df with a slot column (null but for hot keys), and the most slots that hot keys have (0: none hot).

    Keys are counted by a hash of theirs, which shuffles a few bytes a key; that keys of equal
    hash are counted together does no harm.
    """
    seconds = F.col(at).cast("timestamp").cast("double")
    df = df.withColumn(HASH, F.xxhash64(*keys))
    hot = df.groupBy(HASH).agg(F.count(F.lit(1)).alias("n"), (F.max(seconds) - F.min(seconds)).alias("span")).where(F.col("n") > hot_rows)
    slots = hot.agg(F.sum(F.least(F.col("n"), F.floor(F.col("span") / slot_seconds) + 2))).first()[0]
    if not slots:
        return df.withColumn(SLOT, F.lit(None).cast("long")).drop(HASH), 0
    marked = df.join(small(hot.select(F.col(HASH).alias("__hot"))), F.col(HASH) == F.col("__hot"), "left")
    return marked.withColumn(SLOT, F.when(F.col("__hot").isNotNull(), F.floor(seconds / slot_seconds))).drop(HASH, "__hot"), int(slots)


def latest_received(df: DataFrame, keys: Sequence[str], at: str, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row for each (keys, slot, at): the values of the row that is last by `order` (nulls first)."""
    pick = F.max_by(F.struct(*values), F.struct(*order))
    return df.repartition(*keys, SLOT).groupBy(*keys, SLOT, at).agg(pick.alias("__v")).select(*keys, SLOT, at, *[F.col(f"__v.{v}").alias(v) for v in values])


def known_before(df: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], hot: int) -> DataFrame:
    """Adds before_<v>: the last non-null value of v in an earlier row of the key; and __first: true
    for the key's first row. Rows must be unique by (keys, slot, at)."""
    inside = W.partitionBy(*keys, SLOT).orderBy(at)
    rows = df.select("*", *[F.last(v, True).over(inside.rowsBetween(W.unboundedPreceding, -1)).alias(f"before_{v}") for v in values], (F.row_number().over(inside) == 1).alias("__first"))
    if not hot:
        return rows
    per_slot = df.where(F.col(SLOT).isNotNull()).groupBy(*keys, SLOT).agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col(at))).alias(f"__l_{v}") for v in values])
    over = W.partitionBy(*keys).orderBy(SLOT)
    carry = per_slot.select(*keys, SLOT, *[F.last(f"__l_{v}", True).over(over.rowsBetween(W.unboundedPreceding, -1)).alias(f"__c_{v}") for v in values], (F.row_number().over(over) > 1).alias("__later"))
    out = _null_safe(rows, carry.where("__later"), [*keys, SLOT], hot)
    kept = [c for c in df.columns]
    return out.select(*kept, *[F.coalesce(f"before_{v}", f"__c_{v}").alias(f"before_{v}") for v in values], (F.col("__first") & F.col("__later").isNull()).alias("__first"))


def next_start(df: DataFrame, keys: Sequence[str], at: str, hot: int) -> DataFrame:
    """Adds valid_to: the next row's `at` within the key, null for the last."""
    rows = df.withColumn("valid_to", F.lead(at).over(W.partitionBy(*keys, SLOT).orderBy(at)))
    if not hot:
        return rows
    per_slot = df.where(F.col(SLOT).isNotNull()).groupBy(*keys, SLOT).agg(F.min(at).alias("__m"))
    carry = per_slot.select(*keys, SLOT, F.lead("__m").over(W.partitionBy(*keys).orderBy(SLOT)).alias("__n"))
    return _null_safe(rows, carry, [*keys, SLOT], hot).withColumn("valid_to", F.coalesce("valid_to", "__n")).drop("__n")


def attribute_log(readings: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], hot: int) -> DataFrame:
    """The change log in long form: keys, slot, attribute, valid_from, value (as text), is_first.

    A row for each attribute and time at which its known value differs from the one before. The
    key's first reading is a row too (with null value if it states nothing), so that it starts
    the first version.
    """
    known = known_before(readings, keys, at, values, hot)
    changes = F.array(*[F.struct(F.lit(v).alias("attribute"), F.col(v).cast("string").alias("value"), (F.col(v).isNotNull() & ~F.col(v).eqNullSafe(F.col(f"before_{v}")) | F.col("__first")).alias("is_change")) for v in values])
    log = known.select(*keys, SLOT, at, "__first", F.inline(F.filter(changes, lambda x: x["is_change"])))
    return log.select(*keys, SLOT, "attribute", F.col(at).alias("valid_from"), "value", F.col("__first").alias("is_first"))


def combine(log: DataFrame, keys: Sequence[str], types: dict[str, str], hot: int) -> DataFrame:
    """Splits the attributes' intervals at the union of their boundaries and coalesces."""
    at = "valid_from"
    bounds = log.groupBy(*keys, SLOT, at).agg(*[F.max(F.when(F.col("attribute") == v, F.col("value"))).alias(v) for v in types], F.max("is_first").alias("__start"))
    known = known_before(bounds, keys, at, list(types), hot)
    differs = F.col("__start")
    for v in types:
        differs = differs | (F.col(v).isNotNull() & ~F.col(v).eqNullSafe(F.col(f"before_{v}")))
    out = known.where(differs).select(*keys, SLOT, at, *[F.coalesce(v, f"before_{v}").cast(t).alias(v) for v, t in types.items()])
    return next_start(out, keys, at, hot).select(*keys, at, "valid_to", *types)


def attribute_history(events: DataFrame, keys: Sequence[str], at: str, received: Sequence[str], values: dict[str, Column], types: dict[str, str], slot_seconds: int = 3_600, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Full history of several attributes: keys, valid_from, valid_to, one column per attribute.

    values: for each attribute the expression that reads it from an event (null: says nothing, the
    last known value goes on). Of events with the same keys and `at` the last by `received`
    counts. Events without `at` are left out: it is unknown when they were true. Null keys form a
    key of their own. An empty table gives an empty history. Extra columns are ignored.
    """
    names = {f"__ev_{i}": v for i, v in enumerate(values)}
    df = events.select(*keys, F.col(at).alias("__at"), *[F.col(r).alias(f"__rc_{i}") for i, r in enumerate(received)], *[values[v].cast(types[v]).alias(n) for n, v in names.items()])
    df, hot = in_slots(df.where(F.col("__at").isNotNull()), keys, "__at", slot_seconds, hot_rows)
    df = latest_received(df, keys, "__at", [f"__rc_{i}" for i in range(len(received))], list(names))
    log = attribute_log(df, keys, "__at", list(names), hot)
    out = combine(log, keys, {n: types[v] for n, v in names.items()}, hot)
    return out.select(*keys, "valid_from", "valid_to", *[F.col(n).alias(v) for n, v in names.items()])
