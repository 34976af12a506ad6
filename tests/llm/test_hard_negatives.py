"""Hard negatives against a plain loop over all pairs."""

import math
import random

from pyspark.sql import functions as F

from fragloom.llm import hard_negatives as hard


def brute(rows, positives=5, k=10, low=30, high=90):
    live = [(i, key, label, [math.floor(256 * x) for x in v]) for i, (key, v, label) in enumerate(rows)
            if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, key, label, v in live:
        if key is None or key % 10:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), other is None, other or 0, j, m) for j, other, m, w in live if j != i))
        for s, none, p, _, _ in [x for x in scored if x[4] == label][:positives]:
            fits = [x for x in scored if x[4] != label and low * -s <= 100 * -x[0] <= high * -s][:k]
            out += [(key, None if none else p, r, None if x[1] else x[2], -s, -x[0]) for r, x in enumerate(fits, 1)]
    return sorted(out, key=repr)


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("row", F.lit("mine")).withColumn("id", F.lit(0))
    return sorted(map(tuple, hard.mine(df, F.col("vec_id") % 10 == 0, **options).collect()), key=repr)


def vectors(n, rng, dim=8):
    return [(i, [round(rng.uniform(-1, 1), 1) for _ in range(dim)], rng.randrange(3)) for i in range(n)]


def test_against_brute_force_in_one_cell_and_in_many(spark, monkeypatch):
    rows = vectors(300, random.Random(1))
    rows += [(301, None, 1), (302, [0.1, None], 1), (303, [float("nan")] * 8, 0), (304, [float("inf")] * 8, 0), (305, [0.2] * 8, None),
             (None, [0.9] * 8, 2), (310, [], 1), (320, [0.5], 0), (7, [0.9] * 8, 2), (10, [0.7] * 8, 1)]
    rows += rows[10:30]  # repeated rows, an anchor among them
    rows += [(400 + i, [0.5] * 8, i % 2) for i in range(150)]  # ties of a third of the rows
    rows = [(k, v and [None if x is None else float(x) for x in v], m) for k, v, m in rows]
    single = spark.createDataFrame(rows, "k long, v array<float>, l int").collect()  # the values as 32-bit floats
    want = brute([tuple(r) for r in single])
    assert want and mined(spark, rows) == want
    monkeypatch.setattr(hard, "ROWS", 40)
    monkeypatch.setattr(hard, "ANCHORS", 7)
    monkeypatch.setattr(hard, "CHUNK", 100)
    assert mined(spark, rows) == want


def test_other_windows_and_few_rows(spark):
    rows = vectors(60, random.Random(2), 3)
    single = [tuple(r) for r in spark.createDataFrame(rows, "k long, v array<float>, l int").collect()]
    assert mined(spark, rows, positives=2, k=3, low=10, high=50) == brute(single, 2, 3, 10, 50)
    assert mined(spark, rows[:1]) == [] and mined(spark, rows[1:9]) == [] and mined(spark, []) == []


def test_components_beyond_doubles_are_summed_exactly(spark):
    rows = [(0, [2.0 ** 22, 1.0, 2.0 ** 16], 0), (1, [2.0 ** 22, 1.0, 1.0], 0), (2, [2.0 ** 21, 3.0, 5.0], 1), (3, [2.0 ** 21, 3.0, 6.0], 1),
            (4, [3e38, 0.0, 0.0], 2)]
    assert mined(spark, rows[:4]) == brute(rows[:4])
    big = mined(spark, [*rows, (5, [3e38, 0.0, 0.0], 0)])  # scores are cut to the largest long
    assert all(abs(r[4]) < 2 ** 63 and abs(r[5]) < 2 ** 63 for r in big)
