import random

from tracefold.operators.intervals import periods_and_gaps, sweep

SCHEMA = "iid string, k string, s long, e long, start string, members int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def brute(rows):
    seen, by = {}, {}
    for i, k, s, e in rows:
        if s is not None and e is not None and e >= s:
            seen[i] = min(seen.get(i, (s, e, k)), (s, e, k))
    for s, e, k in seen.values():
        by.setdefault(k, []).append((s, e))
    out = set()
    for k, spans in by.items():
        merged = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
                merged[-1][2] += 1
            else:
                merged.append([s, e, 1])
        prev = None
        for s, e, n in merged:
            out.add((k, s, e, n, prev))
            prev = e
    return out


def test_random_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        s = rng.randrange(-500, 4000)
        rows.append((f"i{i}", rng.choice("aaab"), s, s + rng.choice([0, 0, 1, 3, 8, 40])))
    rows += rows[:50]
    rng.shuffle(rows)
    for block in (10, 700, 10**6):
        got = {(r.k, r.start, r.end, r.members, r.gap_start) for r in sweep(frame(spark, rows), "iid", ["k"], "s", "e", block=block).collect()}
        assert got == brute(rows)


def test_nesting_touching_points_and_most_at_once(spark):
    rows = [("1", "a", 0, 10), ("2", "a", 2, 3), ("3", "a", 10, 12), ("4", "a", 20, 20), ("5", "a", 21, 22)]
    got = sorted((r.start, r.end, r.members, r.max_active, r.gap_start) for r in sweep(frame(spark, rows), "iid", ["k"], "s", "e").collect())
    assert got == [(0, 12, 3, 2, None), (20, 20, 1, 1, 12), (21, 22, 1, 1, 20)]


def test_left_out_rows_nulls_and_empty(spark):
    rows = [("1", "a", 5, 1), ("2", "a", None, 3), ("3", "a", 3, None), (None, None, 1, 2), ("4", None, 4, 6)]
    got = {tuple(r) for r in periods_and_gaps(frame(spark, rows), "iid", ["k"], "s", "e").collect()}
    assert got == {(None, "period", 1, 2), (None, "period", 4, 6), (None, "gap", 2, 4)}
    assert periods_and_gaps(frame(spark, []), "iid", ["k"], "s", "e").count() == 0


def test_limits(spark):
    rows = [("1", "a", 0, 1), ("2", "a", 1, 2), ("3", "a", 5, 6), ("4", "a", 100, 101)]
    got = {tuple(r) for r in periods_and_gaps(frame(spark, rows), "iid", ["k"], "s", "e", min_members=2, max_gap=10).collect()}
    assert got == {("a", "period", 0, 2), ("a", "gap", 2, 5)}


def test_numbers_out_of_range_are_left_out(spark):
    df = spark.createDataFrame([("1", "a", float("inf"), 3.0), ("2", "a", 1.0, float("nan")), ("3", "a", 1.0, 2.0)], "iid string, k string, s double, e double")
    assert [tuple(r) for r in periods_and_gaps(df, "iid", ["k"], "s", "e").collect()] == [("a", "period", 1, 2)]
