import random

from pyspark.sql import functions as F

from tracefold.operators import temporal


def test_nearest_point_and_ties(spark):
    rng = random.Random(1)
    points = [("a", round(rng.uniform(-900, 900), 2), i) for i in range(60)]
    asks = [("a", round(rng.uniform(-1000, 1000), 2), i) for i in range(80)] + [("a", 5.0, 900), ("b", 1.0, 901)]
    points += [("a", 4.0, 100), ("a", 6.0, 101)]
    p = spark.createDataFrame(points, "k string, t double, n int")
    a = spark.createDataFrame(asks, "k string, at double, q int")
    got = {r.q: r.near_time for r in temporal.nearest_point(a, p, ["k"], "at", "t", ["n"]).collect()}
    for k, t, q in asks:
        mine = [x for kk, x, _ in points if kk == k]
        assert got[q] == (min(mine, key=lambda x: (abs(x - t), x)) if mine else None)


def test_targets_hold_the_end(spark):
    p = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("b", 2.0), ("c", None)], "k string, t double")
    got = sorted((r.k, round(r.target, 6)) for r in temporal.targets(p, ["k"], "t", 0.25).collect())
    assert got == [("a", 0.0), ("a", 0.25), ("a", 0.5), ("a", 0.75), ("a", 1.0), ("b", 2.0)]


def test_interval_join_equals_the_nested_loop(spark):
    rng = random.Random(2)
    make = lambda p, n: [(f"{p}{i}", rng.choice("ab"), s := rng.uniform(-100, 300), s + rng.choice([0, 1, 50, 200])) for i in range(n)]
    left, right = make("l", 60), make("r", 60)
    schema = "id string, k string, s double, e double"
    got = temporal.interval_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"], ("s", "e"), ("s", "e"), slack=2.0)
    rows = [(r._left.id, r._right.id) for r in got.collect()]
    want = {(a[0], b[0]) for a in left for b in right if a[1] == b[1] and a[2] - 2 <= b[3] and b[2] <= a[3] + 2}
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_windows_are_half_open_but_for_the_last(spark):
    w = spark.createDataFrame([("a", 1, 0.0, 10.0), ("a", 2, 10.0, 20.0)], "k string, no int, s double, e double")
    p = spark.createDataFrame([("a", 0.0), ("a", 10.0), ("a", 20.0), ("a", 20.1), ("b", 5.0)], "k string, t double")
    got = sorted((r.point.t, r.window.no) for r in temporal.assign_windows(p, w, ["k"], "t", "s", "e", "no").collect())
    assert got == [(0.0, 1), (10.0, 2), (20.0, 2)]
    got = {r.t: r.window_no for r in temporal.first_containing(p, w, ["k"], "t", "s", "e", "no").collect()}
    assert got == {0.0: 1, 10.0: 1, 20.0: 2, 20.1: None, 5.0: None}


def test_islands_and_threshold_intervals(spark):
    scores = [0.9, 0.1, 0.8, 0.1, 0.1, 0.1, 0.9, 0.9, 0.9, 0.1, 0.9]
    df = spark.createDataFrame([("a", i, i * 0.1, s) for i, s in enumerate(scores)], "k string, i int, t double, s double")
    out = temporal.threshold_intervals(df, ["k"], "i", "t", "s", F.lit(0.5), 2, F.lit(2)).collect()
    got = sorted((r.first_pos, r.last_pos, r.n_samples, r.n_hits, round(r.mean_score, 4)) for r in out)
    assert got == [(0, 2, 3, 2, 0.6), (6, 10, 5, 4, 0.74)]
    out = temporal.threshold_intervals(df, ["k"], "i", "t", "s", F.lit(0.5), 0, F.lit(2)).collect()
    assert [(r.first_pos, r.last_pos) for r in out] == [(6, 8)]
    assert temporal.threshold_intervals(df.limit(0), ["k"], "i", "t", "s", F.lit(0.5), 0, F.lit(2)).count() == 0


def test_sessions_use_the_end_of_the_row_before(spark):
    df = spark.createDataFrame([("a", 1, 0.0, 30.0), ("a", 2, 45.0, 46.0), ("a", 3, 67.0, 68.0)], "k string, id int, s double, e double")
    got = {r.id: r.session for r in temporal.sessions(df, ["k"], "s", "e", "id", 20.0).collect()}
    assert got == {1: 1, 2: 1, 3: 2}


def test_asof_latest(spark):
    left = spark.createDataFrame([("a", 1.0), ("a", 700.0), ("a", 0.5), ("b", 1.0)], "k string, t double")
    right = spark.createDataFrame([("a", 1.0, 10), ("a", 650.0, 20), ("a", 900.0, 30)], "k string, rt double, v int")
    got = {(r.k, r.t): r.latest.v if r.latest else None for r in temporal.asof_latest(left, right, ["k"], "t", "rt", ["v"]).collect()}
    assert got == {("a", 1.0): 10, ("a", 700.0): 20, ("a", 0.5): None, ("b", 1.0): None}


def test_kinds_together_equal_each_alone(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = [(k, i, i * 0.1, {"a": rng.choice([0.2, 0.9]), "b": rng.choice([None, 0.1, 0.6])} if rng.random() < 0.9 else None) for k in "xy" for i in range(2500) if rng.random() < 0.95]
    df = spark.createDataFrame(rows, "k string, p int, t double, s map<string,double>")
    got = {(r.k, r.kind, r.first_pos, r.last_pos, r.n_samples, r.n_hits, round(r.mean_score, 9)) for r in temporal.kind_intervals(df, ["k"], "p", "t", "s", {"a": (0.8, 5), "b": (0.5, 1)}, 2).collect()}
    want = set()
    for kind, thr, least in (("a", 0.8, 5), ("b", 0.5, 1)):
        one = df.select("k", "p", "t", F.col("s")[kind].alias("x"))
        want |= {(r.k, kind, r.first_pos, r.last_pos, r.n_samples, r.n_hits, round(r.mean_score, 9)) for r in temporal.threshold_intervals(one, ["k"], "p", "t", "x", F.lit(thr), 2, F.lit(least)).collect()}
    assert got == want and len(got) > 100
