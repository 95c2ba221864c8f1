import math
import random

import pytest
from pyspark.sql import functions as F

from tracefold.llm.nearest import nearest_in_time


def pair(spark, asks, items, tolerance=0.5):
    left = spark.createDataFrame([(*a, 0.0) for a in asks], "id string, who string, t double, _delta double")
    right = spark.createDataFrame([(*i, 0.0) for i in items], "no long, who string, t double, id double")
    out = nearest_in_time(left, right, "id", "who", F.col("t"), "no", "who", F.col("t"), tolerance)
    return {(r._left, r._entity, r._right) for r in out.collect()}


def test_random_against_brute_force(spark):
    rng = random.Random(5)
    asks = [(f"r{i}", rng.choice("aaab"), rng.uniform(-20, 60)) for i in range(300)]
    items = [(i, rng.choice("aaab"), rng.uniform(-20, 60)) for i in range(200)]
    want = set()
    for a, w, t in asks:
        near = [(abs(u - t), n) for n, v, u in items if v == w and abs(u - t) <= 0.5]
        if near:
            want.add((a, w, min(near)[1]))
    assert pair(spark, asks + asks[:40], items + items[:40]) == want


def test_ties_bounds_nulls_and_empty(spark):
    asks = [("a", "x", 1.0), ("b", "x", 5.0), ("c", None, 1.0), ("d", "x", None), ("e", "x", math.nan), (None, "x", 1.0)]
    items = [(7, "x", 1.5), (3, "x", 0.5), (9, None, 1.0), (4, "x", None), (5, "x", 5.6), (6, "x", math.nan)]
    assert pair(spark, asks, items) == {("a", "x", 3), (None, "x", 3)}
    assert pair(spark, [], items) == set() == pair(spark, asks, [])
    far = [("p", "x", math.inf), ("q", "x", -1e300), ("r", "x", 1e300)]
    assert pair(spark, far, [(1, "x", math.inf), (2, "x", -1e300), (3, "x", 1e300)]) == {("q", "x", 2), ("r", "x", 3)}
    with pytest.raises(ValueError):
        pair(spark, asks, items, 0)
