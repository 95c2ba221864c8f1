import random

import pytest
from pyspark.sql import functions as F

from tracefold.operators.machines import notice_proposal
from tracefold.operators.text_machine import Layout, TextMachine, decisions, evidence_level, layout_distance, text_segments

NAMES = {"s": "strong", "w": "weak", ".": "negative"}
A, B, C = "00" * 8, "ff" * 8, "0000000000000007"


def segments(pattern, layouts=None, strength=0.0):
    machine, out = TextMachine(), []
    for i, c in enumerate(pattern):
        out += machine.feed(i, NAMES[c], Layout(layouts[i] if layouts else A, count=3), strength)
    out += machine.end(len(pattern) - 1)
    return [(x.first, x.last, x.opened, x.closed, len(x.gaps)) for x in out]


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        (".s..", [(1, 2, "strong_positive", "negative_gap_exceeded", 0)]),
        ("s.s", [(0, 2, "strong_positive", "end_of_stream", 0)]),
        ("ww.www", [(3, 5, "temporally_confirmed_weak_positive", "end_of_stream", 0)]),
        ("wws..", [(0, 3, "weak_confirmed_by_strong", "negative_gap_exceeded", 0)]),
        ("w.w.w", []),
        ("", []),
        # ten weak samples go on, the eleventh closes at the one after the strong one, and weak ones stay barred
        ("s" + "w" * 14, [(0, 1, "strong_positive", "weak_evidence_decay", 0)]),
        ("s" + "w" * 11 + ".www", [(0, 1, "strong_positive", "weak_evidence_decay", 0), (13, 15, "temporally_confirmed_weak_positive", "end_of_stream", 0)]),
        # the first negative after the segment still belongs to it, so the gap is one shorter
        ("s" + "." * 6 + "s..", [(0, 8, "strong_positive", "negative_gap_exceeded", 1)]),
        ("s" + "." * 5 + "s..", [(0, 1, "strong_positive", "negative_gap_exceeded", 0), (6, 7, "strong_positive", "negative_gap_exceeded", 0)]),
        ("s" + "." * 10 + "s", [(0, 1, "strong_positive", "negative_gap_exceeded", 0), (11, 11, "strong_positive", "end_of_stream", 0)]),
        ("s" + "..." + "w" + "..." + "s..", [(0, 1, "strong_positive", "negative_gap_exceeded", 0), (8, 9, "strong_positive", "negative_gap_exceeded", 0)]),
    ],
)
def test_cases(pattern, want):
    assert segments(pattern) == want


def test_layouts_split_and_bar_reopening():
    # a new layout that stays for three samples, once the first five have settled it
    assert segments("s" * 12, [A] * 6 + [B] * 6) == [(0, 5, "strong_positive", "persistent_layout_transition", 0), (6, 11, "persistent_layout_transition", "end_of_stream", 0)]
    assert len(segments("s" * 12, [A] * 6 + [B, B] + [A] * 4)) == 1
    assert len(segments("s" * 6, [A, A, B, B, B, B])) == 1
    # after one negative a smaller change is enough
    assert segments("ssssss.ss", [A] * 7 + ["000000000000ffff"] * 2)[1][:3] == (7, 8, "layout_transition_after_fade")
    assert len(segments("ssssss.ss", [A] * 7 + [C] * 2)) == 1
    assert len(segments("s" + "." * 6 + "s..", [A] * 7 + [B] * 3)) == 2


def test_structure_carries_weak_samples_further():
    assert segments("s" + "w" * 11, strength=0.4)[0][:2] == (0, 10)


def test_layout_distance():
    assert layout_distance(Layout(A), Layout(B)) == pytest.approx(0.55)
    assert layout_distance(Layout(None, (0.0, 1.0), (0.5,), (0, 0, 1, 1), 2), Layout(None, (1.0, 1.0), (0.0,), (0, 0, 1, 0), 4)) == pytest.approx(0.15 * 0.5 + 0.15 * 0.5 + 0.10 * 0.25 + 0.05 * 0.5)
    assert layout_distance(None, Layout(A)) == 0 and layout_distance(Layout("0"), Layout("00")) == 0


def frame(spark, patterns):
    rows = [(k, i * 2 + 5, NAMES[c], A if i % 37 < 20 else B, 3) for k, p in patterns.items() for i, c in enumerate(p)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, pos int, lv string, hash string, n int").repartition(5)
    none = F.lit(None).cast("array<double>")
    return df, (F.col("lv"), F.struct(F.col("hash"), none.alias("rows"), none.alias("columns"), none.alias("box"), F.col("n").alias("count")), F.lit(0.0))


def test_pieces_equal_one_pass(spark):
    rng = random.Random(2)
    draw = lambda n: "".join(rng.choice(rng.choice(["ssw", "sww.", "....", "s."])) * rng.choice([1, 1, 2, 6, 11]) for _ in range(n))
    patterns = {"a": draw(400), "b": draw(3), "c": "....", "d": draw(150)}
    df, args = frame(spark, patterns)
    got = sorted((r.k, r["first"], r["last"], r.trigger, r.n, r.opened, r.closed, r.split, r.reopened) for r in text_segments(df, ["k"], "pos", *args).collect())
    want = []
    for k, p in patterns.items():
        machine, out = TextMachine(), []
        for i, c in enumerate(p):
            out += machine.feed(i, NAMES[c], Layout(A if i % 37 < 20 else B, count=3), 0.0)
        out += machine.end(len(p) - 1)
        want += [(k, x.first * 2 + 5, x.last * 2 + 5, x.trigger * 2 + 5, x.last - x.first + 1, x.opened, x.closed, x.split, len(x.gaps)) for x in out]
    assert got == sorted(want) and {w[6] for w in want} >= {"negative_gap_exceeded", "weak_evidence_decay"}


def test_decisions_repeats_nulls_and_empty(spark):
    df, args = frame(spark, {"a": ".wss.s....", "b": "w.."})
    df = df.union(df).union(spark.createDataFrame([("a", None, "strong", A, 1), (None, 5, None, None, None)], df.schema))
    found = text_segments(df, ["k"], "pos", *args)
    assert [(r.k, r["first"], r["last"]) for r in found.collect()] == [("a", 7, 17)]
    made = {(r.k, (r.pos - 5) // 2): r.decision for r in decisions(df, found, ["k"], "pos", F.col("lv")).collect()}
    assert [made["a", i] for i in range(10)] == ["negative", "open_candidate", "continue_candidate", "continue_candidate", "bridged_gap", "continue_candidate", "bridged_gap", "close_candidate", "negative", "negative"]
    assert made["b", 0] == "unconfirmed" and made[None, 0] == "negative"
    assert text_segments(df.limit(0), ["k"], "pos", *args).count() == 0


def test_levels_and_proposals(spark):
    df = spark.createDataFrame([("strong", 0.0, 0.0), (None, 0.6, 0.7), ("", 0.6, 0.1), (None, 0.1, 0.9), (None, None, None)], "l string, s double, v double")
    assert [r[0] for r in df.select(evidence_level(F.col("l"), F.col("s"), F.col("v"), 0.5)).collect()] == ["strong", "strong", "weak", "negative", "negative"]
    rows = [(1.0, 0.5, 0.33, 0.5, 0.0, "strong", False), (0.5, 0.5, 0.33, 0.5, 0.0, "weak", False), (0.5, 0.5, 0.33, 0.5, 0.0, "none", True), (0.0, 0.0, 0.0, 0.9, 0.0, "weak", False), (0.2, 0.0, 0.0, 0.0, 0.0, "none", True)]
    df = spark.createDataFrame(rows, "t double, p double, c double, m double, i double, st string, su boolean")
    got = [r[0] for r in df.select(notice_proposal(*[F.col(c) for c in df.columns])).collect()]
    assert [g.level for g in got] == ["strong", "weak", "continuation", "strong", "negative"]
    assert [g.score for g in got] == [pytest.approx(0.77), 0.5, 0.499, 0.9, pytest.approx(0.49 * 0.112)]
