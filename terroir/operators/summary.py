"""Short extractive summaries: the best block of reviews, cut to a word budget, cleaned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terroir.functions.text import first_line_matches, summary_sentences

#: What makes a whole summary unfit, and what a single sentence; all are matched from
#: the start and look at the first line only.
UNFIT_SUMMARY = [r".*[0-9][0-9].*", r".*\(.*\).*", r".*points.*", r"[0-9][0-9]\(.*\)"]
UNFIT_SENTENCE = [r".*points.*", r"[0-9][0-9]\(.*\)", r".*[4-9][0-9][+].*"]
#: Fixed value: a sentence that is one bracket from its first to its last sign is unfit too.
BRACKETED = r"(?d)\A\(.*\)\z"


def is_fit_summary(c: Column) -> Column:
    out = F.lit(True)
    for p in UNFIT_SUMMARY:
        out = out & ~first_line_matches(c, p)
    return out


def is_fit_sentence(c: Column) -> Column:
    out = ~c.rlike(BRACKETED)
    for p in UNFIT_SENTENCE:
        out = out & ~first_line_matches(c, p)
    return out


def block(scored: Column, budget: int = 50) -> Column:
    """Struct (text, score) of an array of (text, score): greedy by score within the word budget.

    A sentence that would reach the budget is skipped, later ones may still fit; the kept ones
    stand in their old order.
    """
    words = lambda t: F.size(F.split(t, " "))
    placed = F.transform(scored, lambda x, i: F.struct((-x["score"]).alias("minus"), i.alias("i"), x["text"].alias("text"), x["score"].alias("score")))
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<i:int,text:string,score:double>>").alias("kept"))
    fold = F.aggregate(
        F.array_sort(placed),
        start,
        lambda s, x: F.when(s["n"] + words(x["text"]) < budget, F.struct((s["n"] + words(x["text"])).alias("n"), F.array_append(s["kept"], F.struct(x["i"].alias("i"), x["text"].alias("text"), x["score"].cast("double").alias("score"))).alias("kept"))).otherwise(s),
    )
    kept = F.array_sort(fold["kept"])
    return F.struct(F.array_join(F.transform(kept, lambda x: x["text"]), " ").alias("text"), F.aggregate(kept, F.lit(0.0), lambda a, x: a + x["score"]).alias("score"))


def cleaned(c: Column) -> Column:
    """The text if it is a fit summary, else its fit sentences."""
    return F.when(is_fit_summary(c), c).otherwise(F.trim(F.array_join(F.transform(F.filter(summary_sentences(c), is_fit_sentence), lambda s: F.trim(s)), " ")))


def summarize(blocks: DataFrame, key: str, budget: int = 50) -> DataFrame:
    """key, summary, score: the block with the highest score (ties: the first by ord), cleaned.

    blocks: key, ord, sentences array<struct<text:string,score:double>>.
    """
    b = blocks.select(key, "ord", block(F.col("sentences"), budget).alias("b"))
    best = b.groupBy(key).agg(F.max_by("b", F.struct(F.col("b.score"), -F.col("ord"))).alias("b"))
    return best.select(key, cleaned(F.col("b.text")).alias("summary"), F.col("b.score").alias("score"))
