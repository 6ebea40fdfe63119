"""Quantities recorded in different units, brought to one unit (problem 7).

An amount with its unit in the text is converted directly. For amounts without a unit, each
source's history is segmented by exact penalised changepoint search on the logarithms of the
values; a segment's level against the level of all amounts with stated units tells which known
factor the source uses there, and the factor is reversed.

A source may hold a third of all rows, so a source's history is first reduced to one row of
sufficient statistics (count, sum, sum of squares) per time bin; the search is exact over the bins
and its input is bounded by the length of the time span, not by the number of rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terroir.functions.numbers import AMOUNT, plain_digits, trimmed
from terroir.session import cut

DEC, AMT = "decimal(20,6)", "decimal(38,10)"
#: One US fluid ounce in millilitres.
ML_PER_FL_OZ = 29.5735295625
#: Sizes known by name, in millilitres. The first pattern found counts.
NAMED_SIZES = [
    (r"double[\s-]*magnum|doppelmagnum|jeroboam", 3000),
    (r"magnum", 1500),
    (r"half|demi|1/2|halbe|mezza|media", 375),
    (r"split|piccolo|quarter|1/4", 187),
    (r"standard|std|full\s*bottle|^bottle$|^btl\.?$|^bouteille$|^flasche$|^botella$|^bottiglia$", 750),
]


@dataclass(frozen=True)
class Quantity:
    """One measured quantity: how its texts are read, and the units a bare number may be in."""

    name: str
    #: number pattern with unit -> factor to the common unit
    stated: list[tuple[str, float]]
    #: named amounts in the common unit
    named: list[tuple[str, float]] = field(default_factory=list)
    #: factors that a bare number may need
    bare: tuple[float, ...] = (1.0,)
    comma_groups: bool = False


BOTTLE_SIZE = Quantity(
    "bottle_size",
    [
        (r"(?:fl\.?\s*oz\.?|fluid\s*ounces?|oz\.?|ounces?)", ML_PER_FL_OZ),
        (r"(?:ml\.?|m\.l\.|millilit(?:er|re)s?)", 1.0),
        (r"(?:cl\.?|centilit(?:er|re)s?)", 10.0),
        (r"(?:dl\.?|decilit(?:er|re)s?)", 100.0),
        (r"(?:l\.?|lit(?:er|re|ro)s?|lt\.?|ltr\.?)", 1000.0),
    ],
    NAMED_SIZES,
    (1.0, 10.0, 1000.0),
)
ALCOHOL = Quantity(
    "alcohol_pct",
    [(r"°?\s*proof", 50.0), (r"(?:‰|per\s*mille?)", 10.0), (r"(?:%|percent|per\s*cent|vol\b|°)", 100.0)],
    [],
    (100.0, 50.0, 10.0, 10_000.0),
)
#: US cents; currencies are added from fx_rates.
PRICE = Quantity("price", [], [], (100.0, 1.0), True)


#: Currency marks and words.
CURRENCY_MARKS = {"USD": ["us$", "usd", "dollar", "dollars", "$"], "EUR": ["€", "eur", "euro", "euros"], "GBP": ["£", "gbp", "pound", "pounds"], "CHF": ["chf", "sfr.", "sfr", "francs"], "AUD": ["a$", "aud"]}
CENT_WORDS = ["ct", "ct.", "cts", "¢", "cent", "cents"]
CASE = r"\s*[(/]?\s*(?:case\s*of|for|per|/)\s*([0-9]+)\s*(?:bottles?|btls?)?\)?$"


def _first(s: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(s, pattern, group)


def read_quantity(df: DataFrame, c: str, q: Quantity) -> DataFrame:
    """Adds <c>_amount (decimal, common unit) and <c>_bare (decimal, no unit): at most one is set.

    Works in steps, so that no step's expression is copied into the next.
    """
    s, unit, digits = F.col(f"__{c}_s"), F.col(f"__{c}_u"), F.col(f"__{c}_n")
    units = "|".join(u for u, _ in q.stated)
    pattern = rf"(?:^|[^0-9.,])({AMOUNT})\s*({units})(?![a-z])"
    df = df.withColumn(f"__{c}_s", F.lower(trimmed(F.col(c))))
    df = df.withColumn(f"__{c}_u", _first(s, pattern, 2))
    df = df.withColumn(f"__{c}_n", plain_digits(F.when(unit != "", _first(s, pattern)).otherwise(_first(s, rf"^(?:(?:abv|alcohol|alc\.?)[\s:]*)?({AMOUNT})$")), q.comma_groups).try_cast(DEC))
    factor = F.lit(None).cast("decimal(16,10)")
    for u, f in reversed(q.stated):
        factor = F.when(unit.rlike(f"^{u}$"), F.lit(f).cast("decimal(16,10)")).otherwise(factor)
    if q.name == "alcohol_pct":
        factor = F.when((unit == "") & s.rlike("^[a-z]"), F.lit(100).cast("decimal(16,10)")).otherwise(factor)
    named = F.lit(None).cast(AMT)
    for words, amount in reversed(q.named):
        named = F.when(s.rlike(words), F.lit(amount).cast(AMT)).otherwise(named)
    df = df.withColumn(f"{c}_amount", F.coalesce((digits * factor).cast(AMT), F.when(digits.isNull(), named)))
    df = df.withColumn(f"{c}_bare", F.when((unit == "") & F.col(f"{c}_amount").isNull(), digits))
    return df.drop(*[f"__{c}_{x}" for x in "sun"])


def read_price(df: DataFrame, c: str, usd_per_unit: dict[str, float]) -> DataFrame:
    """As read_quantity, in US cents of one bottle."""
    s, head, mark, digits, count = (F.col(f"__{c}_{x}") for x in ("s", "h", "m", "n", "k"))
    known = {w: usd_per_unit[code] * 100 for code, words in CURRENCY_MARKS.items() if code in usd_per_unit for w in words} | dict.fromkeys(CENT_WORDS, 1.0)
    marks = "|".join(re.escape(w) for w in sorted(known, key=lambda w: (-len(w), w)))
    df = df.withColumn(f"__{c}_s", F.lower(trimmed(F.col(c))))
    df = df.withColumn(f"__{c}_k", _first(s, CASE).try_cast("decimal(10,0)")).withColumn(f"__{c}_h", F.regexp_replace(s, CASE, ""))
    df = df.withColumn(f"__{c}_n", plain_digits(_first(head, rf"^(?:{marks})?\s*({AMOUNT})\s*(?:{marks})?$"), True).try_cast(DEC))
    df = df.withColumn(f"__{c}_m", F.concat(_first(head, rf"^({marks})\s*[0-9]"), _first(head, rf"[0-9.]\s*({marks})$")))
    factor = F.lit(None).cast("decimal(16,8)")
    by_factor: dict[float, list[str]] = {}
    for w, f in known.items():
        by_factor.setdefault(f, []).append(w)
    for f, words in by_factor.items():
        factor = F.when(mark.isin(words), F.lit(f"{f:.8f}").cast("decimal(16,8)")).otherwise(factor)
    per = F.when(count > 0, count).otherwise(F.lit(1)).cast("decimal(10,0)")
    df = df.withColumn(f"{c}_amount", ((digits * factor).cast(AMT) / per).cast(AMT))
    df = df.withColumn(f"{c}_bare", F.when(mark == "", (digits / per).cast(DEC)))
    return df.drop(*[f"__{c}_{x}" for x in "shmnk"])


def changepoints(n: np.ndarray, s: np.ndarray, q: np.ndarray, penalty: float) -> list[int]:
    """Exact penalised least-squares segmentation (pruned dynamic programming).

    n, s, q: count, sum and sum of squares of each bin. Returns the starts of the segments.
    """
    N, S, Q = (np.concatenate([[0.0], np.cumsum(x)]) for x in (n, s, q))
    T = len(n)
    best = np.full(T + 1, np.inf)
    best[0], back = -penalty, np.zeros(T + 1, dtype=np.int64)
    live = np.array([0])
    for t in range(1, T + 1):
        m = N[t] - N[live]
        cost = (Q[t] - Q[live]) - (S[t] - S[live]) ** 2 / np.maximum(m, 1.0)
        total = best[live] + cost
        k = int(np.argmin(total))
        best[t], back[t] = total[k] + penalty, live[k]
        live = np.append(live[total <= best[t]], t)
    starts, t = [], T
    while t > 0:
        t = int(back[t])
        starts.append(t)
    return starts[::-1]


#: How far a shift of levels may be from the log ratio of two units.
TOLERANCE = 0.1


def reversed_units(levels: np.ndarray, n: np.ndarray, options: Sequence[float], ref: float) -> list[float]:
    """The factor of each segment of one source's history, from the levels (logs) and counts of its amounts.

    A shift between neighbours marks a change of unit only if it is a ratio of two known factors;
    any other shift is one of the amounts themselves. The factors are chosen together, so that the
    marked shifts vanish and the reversed levels lie close to the level known from stated units
    (ref; nan if there is none: then the first factor counts). An exact dynamic programme.
    """
    logs = np.log10(options)
    ratios = logs[:, None] - logs[None, :]  # how a level shifts when the unit goes from row to column
    share = n / n.sum()
    known = np.abs(levels[:, None] + logs[None, :] - ref) if ref == ref else np.tile(np.arange(len(options)) * 0.1, (len(levels), 1))
    own = known * share[:, None]
    cost, back = own[0], []
    for shift, at in zip(np.diff(levels), own[1:]):
        left = np.abs(shift - ratios)
        marked = left <= TOLERANCE
        np.fill_diagonal(marked, False)
        step = np.where(marked, left + 0.05, 10.0)
        np.fill_diagonal(step, abs(shift) if marked.any() else 0.0)
        total = cost[:, None] + step
        back.append(total.argmin(axis=0))
        cost = total.min(axis=0) + at
    k = int(cost.argmin())
    path = [k]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return [options[i] for i in reversed(path)]


def _segment(bins: pd.DataFrame, factors: dict[str, tuple[float, ...]], penalty: float) -> pd.DataFrame:
    bins = bins.sort_values("bin", kind="stable")
    n, s, q = (bins[c].to_numpy(float) for c in ("n", "s", "q"))
    total = n.sum()
    # noise from differences within bins and between neighbours, so that level shifts don't count
    inner = (q - s**2 / n).sum()
    means = s / n
    step = np.median(np.abs(np.diff(means))) if len(means) > 1 else 0.0
    var = max(inner / max(total - len(n), 1.0), (step / 0.954) ** 2 / 2 if total <= len(n) else 0.0, 1e-4)
    starts = changepoints(n, s, q, penalty * var * np.log(max(total, 2.0)))
    ref, field_name = bins["ref"].iloc[0], bins["field_name"].iloc[0]
    ends = [*starts[1:], len(n)]
    levels = np.array([s[a:b].sum() / n[a:b].sum() for a, b in zip(starts, ends)])
    counts = np.array([n[a:b].sum() for a, b in zip(starts, ends)])
    chosen = np.zeros(len(n))
    for a, b, f in zip(starts, ends, reversed_units(levels, counts, factors[field_name], ref)):
        chosen[a:b] = f
    return pd.DataFrame({"source_id": bins["source_id"].to_numpy(), "field_name": field_name, "bin": bins["bin"].to_numpy(), "factor": chosen})


FIELDS = (BOTTLE_SIZE.name, ALCOHOL.name, PRICE.name)


def common_units(products: DataFrame, fx_rates: DataFrame, *, fields: Sequence[str] = FIELDS, bin_seconds: int = 3600, penalty: float = 6.0) -> DataFrame:
    """source_product_id, field_name, amount (decimal, common unit): one row per stated amount.

    bottle_size in ml, alcohol_pct in hundredths of a percent by volume, price in US cents of one
    bottle. Values that state no amount, nulls and blanks give no row; a listing delivered twice
    with equal values gives one row. A bare number of a source without scraped_at is put in the
    source's first bin.
    """
    # only the currencies that can be read count; one row of each comes to the driver
    rates = fx_rates.where(F.col("currency").isin(list(CURRENCY_MARKS)) & F.col("usd_per_unit").isNotNull()).groupBy("currency").agg(F.max("usd_per_unit").alias("usd_per_unit"))
    fx = {r.currency: float(r.usd_per_unit) for r in rates.collect()}
    fx.setdefault("USD", 1.0)
    seconds = F.coalesce(F.col("scraped_at").cast("timestamp").cast("double"), F.lit(0.0))
    df = products.select("source_product_id", "source_id", F.floor(seconds / bin_seconds).alias("bin"), "bottle_size", "alcohol_pct", "price")
    for q in (BOTTLE_SIZE, ALCOHOL):
        df = read_quantity(df, q.name, q) if q.name in fields else df
    df = read_price(df, "price", fx) if "price" in fields else df
    stated = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"{f}_amount").alias("amount"), F.col(f"{f}_bare").alias("bare")) for f in fields])
    rows = df.select("source_product_id", "source_id", "bin", F.inline(stated)).where(F.coalesce("amount", "bare") > 0)
    factors = {q.name: q.bare for q in (BOTTLE_SIZE, ALCOHOL, PRICE)}
    log = F.log10(F.col("bare").cast("double"))
    said = F.log10(F.col("amount").cast("double"))
    # one pass for the sums of stated and of bare amounts; what follows works on them
    sums = cut(rows.groupBy("source_id", "field_name", "bin").agg(F.count("bare").cast("double").alias("n"), F.sum(log).alias("s"), F.sum(log * log).alias("q"), F.count("amount").alias("m"), F.sum(said).alias("t")))
    level = sums.groupBy("field_name").agg((F.sum("t") / F.nullif(F.sum("m"), F.lit(0))).alias("ref"))
    bins = sums.where("n > 0").drop("m", "t").join(F.broadcast(level), "field_name", "left")  # at most one row a field

    def each(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _segment(pdf, factors, penalty)

    segments = bins.groupBy("source_id", "field_name").applyInPandas(each, "source_id bigint, field_name string, bin bigint, factor double")
    segments = segments.withColumnRenamed("source_id", "__s")
    joined = rows.join(segments.withColumnRenamed("field_name", "__f").withColumnRenamed("bin", "__b"), F.col("bare").isNotNull() & F.col("source_id").eqNullSafe(F.col("__s")) & (F.col("field_name") == F.col("__f")) & (F.col("bin") == F.col("__b")), "left")
    amount = F.coalesce("amount", (F.col("bare") * F.col("factor").cast("decimal(16,8)")).cast("decimal(38,10)"))
    return joined.select("source_product_id", "field_name", amount.alias("amount")).where("amount is not null").distinct()


