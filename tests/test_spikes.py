import math

import pytest

from tracefold.operators.spikes import context_fences, flag_implausible

SCHEMA = "oid string, src string, t double, v double, reason string, _v int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def series(values, src="a", start=0):
    return [(f"{src}{i:05d}", src, float(i) * 0.5, v) for i, v in enumerate(values, start)]


def flags(df, **kw):
    out = flag_implausible(df, "oid", ["src"], "t", "v", **kw)
    assert out.columns == ["oid", "reason"]
    return {(r.oid, r.reason) for r in out.collect()}


WOBBLE = [0.1, -0.2, 0.05, 0.15, -0.1, 0.2, -0.15, 0.0, 0.12, -0.07]


def wobbling(level, n, phase=0):
    return [level + WOBBLE[(i * 7 + phase) % 10] + 0.001 * (i % 13) for i in range(n)]


def test_the_three_kinds(spark):
    values = wobbling(80, 30)
    values[4] = math.nan
    values[9] = 130.0
    values[15], values[16] = 60.0, 61.0
    values += [50.0] * 6 + wobbling(50, 20)
    got = flags(frame(spark, series(values)))
    assert got == {("a00004", "impossible"), ("a00009", "impossible"), ("a00015", "excursion"), ("a00016", "excursion")} | {(f"a{i:05d}", "frozen") for i in range(30, 36)}


def test_real_changes_and_constant_sources_pass(spark):
    rows = series(wobbling(80, 20) + wobbling(40, 20)) + series([70.0] * 30 + [20.0] * 30, "b")
    rows += series(wobbling(80, 20) + wobbling(60, 4) + wobbling(80, 20), "c")  # four readings are a change, not an excursion
    assert flags(frame(spark, rows)) == set()


def test_chunk_borders_do_not_matter(spark):
    values = wobbling(60, 200)
    for i in range(20, 180, 17):
        values[i] = 30.0
    df = frame(spark, series(values))
    whole = flags(df)
    assert len(whole) == 10
    assert flags(df, chunk=32, block_seconds=3.0) == whole


def test_nulls_repeats_and_empty(spark):
    values = wobbling(60, 30)
    values[12] = 20.0
    rows = series(values)
    rows += rows[10:14] * 3 + [("n1", "a", 6.1, None), (None, None, None, -5.0), ("z", "a", None, 50.0)]
    assert flags(frame(spark, rows)) == {("a00012", "excursion"), (None, "impossible")}
    assert flags(frame(spark, [])) == set()


def test_infinite_times_and_values(spark):
    values = wobbling(60, 30)
    values[12] = 20.0
    rows = [*series(values), ("i", "a", math.inf, 60.0), ("j", "a", -math.inf, 60.0), ("k", "a", math.nan, 60.0), ("l", "b", 1.0, math.inf), ("m", "b", 2.0, -math.inf)]
    assert flags(frame(spark, rows)) == {("a00012", "excursion"), ("l", "impossible"), ("m", "impossible")}


def test_ties_in_time_go_by_id(spark):
    rows = [(i, s, 0.0, v) for i, s, _, v in series(wobbling(60, 12) + [20.0] + wobbling(60, 12))]
    assert flags(frame(spark, rows)) == {("a00012", "excursion")}


def test_context_fences(spark):
    values = [50.0 + (i % 5) for i in range(100)] + [99.0, -3.0]
    out = context_fences(frame(spark, series(values)), "oid", ["src"], "t", "v").collect()
    assert len(out) == 1
    row = out[0]
    assert (row["n"], row["n_outside"], row["n_impossible"]) == (102, 1, 1)
    assert row["low_fence"] == pytest.approx(45, abs=3)
    assert context_fences(frame(spark, []), "oid", ["src"], "t", "v").count() == 0


def test_sparse_readings_keep_their_steps(spark):
    values = wobbling(80, 40)
    values[20], values[21] = 50.0, 50.5
    rows = [(f"a{i:05d}", "a", 700.0 * i, v) for i, v in enumerate(values)]
    want = {("a00020", "excursion"), ("a00021", "excursion")}
    assert flags(frame(spark, rows)) == want
    assert flags(frame(spark, rows), block_seconds=1e9) == want


def test_the_context_decides(spark):
    calm, rough = wobbling(60, 250), [60 + 25 * (v - 60) for v in wobbling(60, 250, 3)]
    calm[100], rough[100] = 75.0, 75.0
    rows = [(f"c{i:05d}", "a", 1.0 * i, v) for i, v in enumerate(calm)] + [(f"r{i:05d}", "a", 3600.0 + i, v) for i, v in enumerate(rough)]
    assert flags(frame(spark, rows)) == {("c00100", "excursion")}
    # with one context both hours share their fences, and contexts with too few steps take their source's
    merged = flags(frame(spark, rows), context_seconds=1e9)
    assert merged != {("c00100", "excursion")}
    assert flags(frame(spark, rows), context_least=10_000) == merged


def test_rates_go_by_elapsed_time(spark):
    values = wobbling(80, 60)
    values[20], values[40] = 60.0, 60.0
    rows = [(f"a{i:05d}", "a", 0.5 * i + (0 if i < 40 else 3600) + (3600 if i > 40 else 0), v) for i, v in enumerate(values)]
    got = flags(frame(spark, rows), rates=True, context_seconds=1e9)
    # both leave the level, but only the first does so faster than the source ever changes
    assert {r for r in got if r[1] == "rate"} == {("a00020", "rate")}
    assert {r for r in got if r[1] == "excursion"} == {("a00020", "excursion"), ("a00040", "excursion")}
