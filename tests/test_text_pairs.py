"""Pairs by ratio against every pair there is."""

import random

from terroir.functions.text import indel_ratio
from terroir.queries.text import ratio_pairs


def test_ratio_pairs_equal_brute_force(spark):
    rng = random.Random(7)
    names = ["bodegas betalación", "bodegas bagireda", "château vodamault", "finca talanera", "abc", "a"]
    brands = {"bodegas betalacion", "bodegas bagirea", "château vodamault®", "abd", "a", "b"}
    for n in names * 60:
        k = rng.randrange(len(n) + 1)
        brands.add(n[:k] + rng.choice(["", "x", "é", "®"]) + n[k + rng.randrange(2) :])
        brands.add("".join(rng.choice("xo") if rng.random() < 0.15 else c for c in n))
    brands.discard("")
    want = sorted((b, n, indel_ratio(b, n)) for b in brands for n in names if b[0] == n[0] and abs(len(b) - len(n)) <= 1 and indel_ratio(b, n) > 80)
    got = ratio_pairs(spark.createDataFrame([(b,) for b in brands], "brand string"), spark.createDataFrame([(n,) for n in names], "name string"))
    assert sorted(map(tuple, got.collect())) == want
    assert ("bodegas betalacion", "bodegas betalación", 94) in want and any(b.endswith("®") for b, _, _ in want)
