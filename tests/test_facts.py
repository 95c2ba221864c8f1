import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefold.functions import scores as sc
from tracefold.functions import text as tx
from tracefold.operators import facts, selection, voting

EVENT = "replay string, id string, kind string, f map<string,string>, targets array<string>, role string"


def test_participants(spark):
    rows = [
        ("r", "a", "MOVE", {"actor": "甲", "side": "opponent", "target": "乙"}, [], "x"),
        ("r", "b", "SWITCH", {"trainer": "紅", "actor": "甲", "side": "player"}, ["甲", "丙", "丙 "], "x"),
        ("r", "c", "STAT_CHANGE", {"side": "opponent"}, ["丁", "戊"], "x"),
        ("r", "d", "BATTLE_RESULT", {"loser": "藍"}, None, "x"),
        ("r", "e", "WEATHER", None, None, "x"),
        (None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, EVENT)
    got = {(r.id, r.role, r.name.strip(), r.being, r.side) for r in facts.participants(df, ["replay", "id"], "kind", "f", "targets").collect()}
    assert got == {
        ("a", "actor", "甲", "creature", "opponent"), ("a", "target", "乙", "creature", "unknown"),
        ("b", "actor", "甲", "creature", "player"), ("b", "actor", "丙", "creature", "player"), ("b", "trainer", "紅", "trainer", "unknown"),
        ("c", "target", "丁", "creature", "opponent"), ("c", "target", "戊", "creature", "opponent"),
        ("d", "loser", "藍", "trainer", "unknown"),
    }
    assert facts.participants(df.limit(0), ["replay", "id"], "kind", "f", "targets").count() == 0


def test_matching_and_status(spark):
    entities = spark.createDataFrame([("r", "p:甲", "甲", 1, "player"), ("r", "o:甲", "甲", 2, "opponent"), ("r", "p:x", "x", 3, "unknown"), ("q", "p:甲", "甲", 1, "player")], "k string, entity_id string, name_key string, species_id int, side string")
    asks = [("r", 1, "甲", None, "player", "creature"), ("r", 2, "甲", None, "unknown", "creature"), ("r", 3, "別名", 3, "opponent", "creature"), ("r", 4, "無", 9, "player", "creature"), ("r", 5, "無", None, "player", "creature"), ("r", 6, "甲", None, "player", "trainer")]
    asks = spark.createDataFrame(asks, "k string, ask int, name_key string, species_id int, side string, being string")
    matches = facts.entity_matches(asks, entities, ["k"], "ask")
    got = {r.ask: (r.status, r.entity_id, r.n_candidates) for r in facts.resolved(asks, matches, ["k"], "ask").collect()}
    assert got == {1: ("entity", "p:甲", 1), 2: ("ambiguous", None, 2), 3: ("entity", "p:x", 1), 4: ("species", None, 0), 5: ("name_only", None, 0), 6: ("observed_only", None, 1)}


def test_same_identity(spark):
    rows = [("e", "e", 1, 2, "a", "b"), ("e", "f", 1, 1, "a", "a"), (None, "f", 1, 1, "a", "b"), (None, None, 1, 2, "a", "a"), (None, None, None, 2, "A b", "a-B"), (None, None, None, None, None, "a"), (None, None, None, None, "?", "!")]
    df = spark.createDataFrame(rows, "e string, g string, s int, t int, n string, m string")
    c = F.col
    assert [r[0] for r in df.select(facts.same_identity((c("e"), c("g")), (c("s"), c("t")), (c("n"), c("m")))).collect()] == [True, False, True, False, True, False, False]


def test_relations_and_linked_rules(spark):
    edges = spark.createDataFrame([("a", "b", "RESULT_OF"), ("a", "c", "RESULT_OF"), ("a", "d", "TEMPORALLY_ADJACENT")], "source string, target string, relation string")
    reviews = spark.createDataFrame([("a", "c", "accepted", 1), ("a", "c", "rejected", 2)], "source string, target string, decision string, decided_at int")
    rows = facts.relations(edges, reviews, "source", "target", "relation")
    assert {(r.target, r.review, r.active, r.causal) for r in rows.collect()} == {("b", "auto_accepted", True, True), ("c", "rejected", False, False), ("d", "auto_accepted", True, False)}
    events = spark.createDataFrame([("a", "MOVE", {"actor": "甲", "action": "use"}), ("b", "MOVE_RESULT", {"target": "甲"}), ("c", "MOVE_RESULT", {"target": "甲"}), ("d", "MOVE_RESULT", {"target": "乙"})], "id string, kind string, f map<string,string>")
    schema = "rule string, source_kind string, target_kind string, relations array<string>, source_pairs map<string,string>, target_pairs map<string,string>, same boolean"
    rules = spark.createDataFrame([("any", "MOVE", "MOVE_RESULT", ["RESULT_OF", "TEMPORALLY_ADJACENT"], {"action": "use"}, {}, False), ("own", "MOVE", "MOVE_RESULT", ["RESULT_OF", "TEMPORALLY_ADJACENT"], {}, {}, True), ("other", "MOVE", "MOVE_RESULT", ["RESULT_OF"], {"action": "x"}, {}, False)], schema)
    got = {(r.rule, r.target) for r in facts.linked_rules(events, rows, rules, "id", "kind", "f").collect()}
    assert got == {("any", "b"), ("any", "d"), ("own", "b")}


def plain_consensus(rows, least):
    """One pass in order of the vote: clusters as lists."""
    clusters = []
    heaviest = lambda c: max(c, key=lambda r: r[2])
    for r in sorted(rows):
        for c in clusters:
            if voting.text_similarity(r[1], heaviest(c)[1]) >= least:
                c.append(r)
                break
        else:
            clusters.append([r])
    moments = len({r[3] for r in rows})

    def score(c):
        best = {}
        for _, _, w, m in c:
            best[m] = max(best.get(m, 0), w)
        return len(best) / moments, sum(best.values()) / len(best)

    def rank(c):
        support, conf = score(c)
        return round(0.58 * support + 0.42 * conf, 9), heaviest(c)[1]

    best = max(clusters, key=rank)
    support, conf = score(best)
    share = len(best) / len(rows)
    return heaviest(best)[1], round(0.45 * conf + 0.35 * support + 0.2 * share, 6), len(clusters)


def test_cluster_consensus_equals_one_pass(spark):
    rng = random.Random(5)
    rows = [(f"g{rng.randrange(6)}", f"v{i:04d}", "".join(rng.choice("甲乙丙丁戊己") if rng.random() < 0.2 else c for c in rng.choice(["甲乙丙丁戊", "己己丁丁乙"])), round(rng.random(), 3), rng.randrange(9)) for i in range(240)]
    df = spark.createDataFrame([*rows, ("g0", "x", "", 1.0, 1), ("g0", "y", None, 1.0, 1), (None, "z", "甲", 0.5, 1)], "g string, v string, t string, w double, m int").repartition(4)
    got = {r.g: r for r in facts.cluster_consensus(df, ["g"], "v", "t", "w", "m").collect() if r.g}
    for g in {r[0] for r in rows}:
        text, consensus, n = plain_consensus([r[1:] for r in rows if r[0] == g], 0.82)
        assert (got[g].best_text, got[g].n_clusters) == (text, n) and got[g].consensus == pytest.approx(consensus, abs=2e-6)
    assert facts.cluster_consensus(df.limit(0), ["g"], "v", "t", "w", "m").count() == 0


def test_edit_distance_equals_the_table():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(0, 9))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        assert voting.edit_distance(a, b) == row[-1], (a, b)


def test_lexicon_match_equals_brute_force(spark):
    rng = random.Random(9)
    draw = lambda n: "".join(rng.choice("火水木金土日月") for _ in range(n))
    names = sorted({draw(rng.randrange(2, 6)) for _ in range(60)})
    words = [draw(rng.randrange(1, 7)) for _ in range(150)] + names[:5]
    df = spark.createDataFrame([(w,) for w in words] + [(None,), (" ",)], "w string")
    got = [r.m for r in df.select(tx.lexicon_match(F.col("w"), names).alias("m")).collect()]
    for w, m in zip(words, got):
        best = max(((difflib.SequenceMatcher(None, w, n).ratio(), n) for n in names))
        want = (w, 1.0, "exact") if w in names else (best[1], round(best[0], 6), "fuzzy") if best[0] >= 0.66 else (None, 0.0, "unmatched")
        assert tuple(m) == want
    assert [m.method for m in got[-2:]] == ["empty", "empty"]


def test_templates_in_blocks_equal_one_block(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=5)]) for i in range(80)] + [(99, [0.0] * 5)], "id int, v array<double>")
    t = spark.createDataFrame([(f"t{i}", [float(x) for x in rng.normal(size=5)]) for i in range(30)], "label string, template array<double>")
    rows = lambda: {(r.id, r.label, None if r.score is None else round(r.score, 9)) for r in selection.best_template(df, "id", "v", t).collect()}
    whole = rows()
    monkeypatch.setattr(selection, "MOST_TEMPLATES", 7)
    assert rows() == whole and (99, None, None) in whole
    assert selection.best_template(df, "id", "v", t.limit(0)).where("label IS NOT NULL").count() == 0


def test_small_features(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).collect()[0].x
    lit = F.lit
    assert one(sc.extended_up(lit(100), lit(80))) == 40 and one(sc.extended_up(lit(10), lit(80))) == 0
    assert one(sc.picture_quality(lit(0.8), lit(0.4), lit(True))) == 0.66 and one(sc.picture_quality(lit(0.8), lit(0.4), lit(False))) == 0.68
    assert tuple(one(sc.brighter_slot(lit(0.5), lit(0.44)))) == ("left", 0.5) and tuple(one(sc.brighter_slot(lit(0.5), lit(0.51)))) == ("unknown", 0.4)
    assert tuple(one(sc.brighter_slot(lit(None).cast("double"), lit(0.5)))) == ("unknown", 0.0)
    assert [one(sc.multiplier_label(lit(x))) for x in (0.0, 0.5, 1.0, 2.0)] == ["immune", "not_very_effective", "neutral", "super_effective"]
    same = F.array(*[lit(float(x)) for x in (0, 1, 0, 1)])
    flat = F.array(*[lit(0.25)] * 4)
    assert one(sc.appearance(same, same, sc.steps(same), sc.steps(same), flat, flat, 1.0)) == pytest.approx(1.0)
