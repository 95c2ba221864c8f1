import random

from pyspark.sql import functions as F

from tracefold.operators.sequence import lagged, last_known, running_sums, with_halo

SCHEMA = "k string, t double, i long, v double"


def rows(seed=0, n=300):
    rng = random.Random(seed)
    return [(rng.choice(["a", "a", "a", None]), rng.uniform(-50, 50), i, rng.choice([None, rng.random()])) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def ordered(data):
    by = {}
    for r in sorted(data, key=lambda r: (r[1], r[2])):
        by.setdefault(r[0], []).append(r)
    return by


def test_lagged_sums_and_last_known_over_blocks(spark):
    data = rows()
    want_lag, want_sum, want_last = {}, {}, {}
    for held in ordered(data).values():
        last = total = None
        for j, r in enumerate(held):
            want_lag[r[2]] = held[j - 1][3] if j else None
            total = (total or 0) + (1 if r[3] is None else 0)
            want_sum[r[2]] = (j + 1, total)
            last = r[3] if r[3] is not None else last
            want_last[r[2]] = last
    for width in (1.0, 7.0, 1000.0):
        block = F.floor(F.col("t") / width)
        got = lagged(frame(spark, data), ["k"], ["t", "i"], block, {"was": F.col("v")}).collect()
        assert {r.i: r.was for r in got} == want_lag
        got = running_sums(frame(spark, data), ["k"], ["t", "i"], block, {"a": F.lit(1), "b": F.col("v").isNull().cast("int")}).collect()
        assert {r.i: (r.a, r.b) for r in got} == want_sum
        got = last_known(frame(spark, data), ["k"], ["t", "i"], block, F.col("v"), "known").collect()
        assert {r.i: r.known for r in got} == want_last


def test_halo_covers_neighbours(spark):
    df = spark.range(100).withColumnRenamed("id", "p")
    got = with_halo(df, "p", 10, 3).collect()
    chunks = {}
    for r in got:
        chunks.setdefault(r._chunk, set()).add(r.p)
    assert all({p for p in range(c * 10 - 3, c * 10 + 13) if 0 <= p < 100} == held for c, held in chunks.items() if c < 10)
    assert sorted(r.p for r in got if r._core) == list(range(100))


def test_empty(spark):
    df = frame(spark, [])
    assert lagged(df, ["k"], ["t"], F.lit(0), {"was": F.col("v")}).count() == 0
    assert last_known(df, ["k"], ["t"], F.lit(0), F.col("v"), "x").count() == 0
