import math
import random

import pandas as pd
from pyspark.sql import functions as F

from tracefold.llm.collapse import RunMachine, collapse_runs, state_label

SCHEMA = "who string, i long, t double, state string, a double, b double, label string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def runs(df, **kw):
    out = collapse_runs(df, "who", "i", "t", state_label(F.col("state")), [F.col("a"), F.col("b")], 0.25, 0.02, **kw)
    return {(r.who, r.label, r.first, r.last, r.n) for r in out.collect()}


def brute(rows, anchor="previous"):
    seen = {}
    for who, i, t, s, a, b in rows:
        if i is not None:
            seen.setdefault((who, i), (t, s, a, b))
    out, run = set(), None
    for (who, i), (t, s, a, b) in sorted(seen.items(), key=lambda x: (x[0][0] or "", x[0][1])):
        def like(x, y):
            return (x is None and y is None) or (x is not None and y is not None and abs(x - y) <= 0.02 + 1e-9)

        if run:
            base = run["feats"] if anchor == "first" else run["prev"]
            both = (a is None and b is None) == (base[0] is None and base[1] is None)
            if run["who"] == who and t is not None and run["t"] is not None and abs(t - run["t"]) <= 0.25 + 1e-9 and run["s"] == s and like(a, base[0]) and like(b, base[1]) and both:
                run.update(t=t, last=i, n=run["n"] + 1, prev=(a, b))
                continue
            out.add((run["who"], run["s"], run["first"], run["last"], run["n"]))
        run = {"who": who, "s": s, "t": t, "first": i, "last": i, "n": 1, "feats": (a, b), "prev": (a, b)}
    if run:
        out.add((run["who"], run["s"], run["first"], run["last"], run["n"]))
    return out


def make(n=400, seed=1):
    rng = random.Random(seed)
    rows, t = [], 0.0
    a, s = 0.5, "A"
    for i in range(n):
        t += rng.choice([0.1, 0.1, 0.1, 0.2, 0.4])
        if rng.random() < 0.2:
            a = rng.random()
        if rng.random() < 0.1:
            s = rng.choice(["A", "B"])
        x = None if rng.random() < 0.2 else a + rng.choice([0, 0.01, -0.01])
        rows.append((rng.choice("pq") if i % 7 == 0 else "p", i, round(t, 3), s, x, x))
    return rows


def test_random_against_brute_force_at_any_block_size(spark):
    rows = make()
    for block in (4, 64, 8192):
        assert runs(frame(spark, rows + rows[::9]), block=block) == brute(rows)
    assert runs(frame(spark, rows), anchor="first") == brute(rows, "first")


def test_anchor_first_does_not_drift(spark):
    rows = [("p", i, i * 0.1, "A", i * 0.015, 0.0) for i in range(6)]
    assert runs(frame(spark, rows)) == {("p", "A", 0, 5, 6)}
    assert runs(frame(spark, rows), anchor="first") == {("p", "A", 0, 1, 2), ("p", "A", 2, 3, 2), ("p", "A", 4, 5, 2)}


def test_labels_however_written(spark):
    rows = [("p", i, i * 0.1, s, 0.1, 0.1) for i, s in enumerate(["MOVE_MENU", "move menu", "Move-Menu", " MOVE_MENU ", "MOVEMENU"])]
    assert runs(frame(spark, rows)) == {("p", "MOVE_MENU", 0, 3, 4), ("p", "MOVEMENU", 4, 4, 1)}


def test_nulls_and_empty(spark):
    rows = [(None, 0, 0.0, None, None, None), (None, 1, 0.1, None, None, None), (None, 2, 0.2, None, math.nan, 0.1), (None, 3, None, None, 0.1, 0.1), (None, None, 0.3, "A", 0.1, 0.1)]
    assert runs(frame(spark, rows)) == {(None, None, 0, 1, 2), (None, None, 2, 2, 1), (None, None, 3, 3, 1)}
    assert runs(frame(spark, [])) == set()


def test_machine_state_is_one_row():
    m = RunMachine(0.25, 0.02, "previous", ["_x0"])
    got = 0
    for k in range(50):
        batch = pd.DataFrame({"_e": "p", "_b": 0, "_o": range(k * 10, k * 10 + 10), "_t": [0.1 * (k * 10 + i) for i in range(10)], "_l": "A", "_x0": 0.5})
        got += len(m.push(batch))
        assert len(m.open) == 1
    last = m.finish()
    assert got == 0 and last["_n"].tolist() == [500] and last["_of"].tolist() == [0] and last["_oz"].tolist() == [499]
