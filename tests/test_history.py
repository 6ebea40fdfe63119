import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from terroir.functions.numbers import stated_number
from terroir.operators.history import attribute_history

TYPES = {"price": "decimal(20,6)", "qoh": "decimal(20,6)"}
SCHEMA = "id bigint, source bigint, url string, price string, qoh string, at timestamp, got timestamp, value string, valid_from int"


def number(s):
    try:
        return float(s.replace("$", "").replace(",", "").strip()) if s else None
    except ValueError:
        return None


def brute(rows):
    latest = {}
    for r in sorted(rows, key=lambda r: (r[6], r[0])):
        if r[5] is not None:
            latest[(r[1], r[2], r[5])] = (number(r[3]), number(r[4]))
    out, now = [], {}
    for (s, u, t), (p, q) in sorted(latest.items(), key=lambda x: (str(x[0][0]), str(x[0][1]), x[0][2])):
        before = now.get((s, u))
        new = (before[0] if p is None and before else p, before[1] if q is None and before else q)
        if before != new:
            out.append([s, u, t, None, *new])
        now[(s, u)] = new
    for a, b in zip(out, out[1:]):
        if a[:2] == b[:2]:
            a[3] = b[2]
    return sorted(map(tuple, out), key=str)


def run(df, **options):
    values = {v: stated_number(F.col(v)) for v in TYPES}
    got = attribute_history(df, ["source", "url"], "at", ["got", "id"], values, TYPES, **options)
    num = lambda x: None if x is None else float(x)
    return sorted(((r.source, r.url, r.valid_from, r.valid_to, num(r.price), num(r.qoh)) for r in got.collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"hot_rows": 5, "slot_seconds": 3600}, {"hot_rows": 30, "slot_seconds": 60}])
def test_equals_brute_force(spark, options):
    r = random.Random(4)
    t0 = datetime(2021, 1, 1)
    rows = []
    for i in range(400):
        key = r.choice([(1, "a")] * 6 + [(1, "b"), (2, "a"), (None, "c"), (3, None)])
        at = t0 + timedelta(minutes=r.randrange(0, 900)) if r.random() > 0.03 else None
        price = r.choice(["10", "$10.00", " 11 ", "1,011.5", "N/A", "", None, "12"])
        rows.append((i, *key, price, r.choice(["1", "1.0", "2", "?", None]), at, t0 + timedelta(minutes=r.randrange(900, 990)), "x", 1))
    rows += rows[:40]
    assert run(spark.createDataFrame(rows, SCHEMA), **options) == brute(rows)


def test_empty_and_unreadable(spark):
    assert run(spark.createDataFrame([], SCHEMA)) == []
    t = datetime(2021, 1, 1)
    row = (1, 1, "u", "n/a", None, t, t, None, None)
    assert run(spark.createDataFrame([row], SCHEMA)) == [(1, "u", t, None, None, None)]
