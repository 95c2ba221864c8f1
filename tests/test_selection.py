from pyspark.sql import functions as F

from tracefold.operators import selection


def test_templates(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.2]), (3, "b", [0.0, 1.0])], "id int, l string, v array<double>")
    t = selection.class_templates(df, "l", "v")
    assert {r.label: [round(x, 6) for x in r.template] for r in t.collect()} == {"a": [1.0, 0.1], "b": [0.0, 1.0]}
    got = {r.id: r.label for r in selection.best_template(df.drop("l"), "id", "v", t).collect()}
    assert got == {1: "a", 2: "a", 3: "b"}


def test_interval_frames(spark):
    i = spark.createDataFrame([("k", "i", 1.0, 3.0)], "k string, id string, s double, e double")
    f = spark.createDataFrame([("k", n, n * 1.0, x) for n, x in enumerate([0.9, 0.1, 0.5, 0.5, 0.9])], "k string, p int, t double, x double")
    r = selection.interval_frames(i, f, ["k"], ("s", "e"), "id", "t", "p", "x").collect()[0]
    assert (r.first_pos, r.last_pos, r.peak_pos, r.n) == (1, 3, 2, 3)


def test_longest_prefix(spark):
    texts = spark.createDataFrame([(1, "abcx"), (2, "abx"), (3, "x"), (4, None), (5, "")], "id int, t string")
    names = spark.createDataFrame([(7, "ab"), (8, "abc"), (9, "q")], "n int, name string")
    assert {(r.id, r.n, r.length) for r in selection.longest_prefix(texts, "id", "t", names, "name", "n").collect()} == {(1, 8, 3), (2, 7, 2)}


def test_greedy_assignment(spark):
    pairs = [("g", "a", "x", 0.9), ("g", "a", "y", 0.8), ("g", "b", "x", 0.85), ("g", "b", "z", 0.1), ("h", "a", "x", 0.5)]
    df = spark.createDataFrame(pairs, "k string, l string, r string, s double")
    got = {(r.k, r.left, r.right) for r in selection.greedy_assignment(df, ["k"], "l", "r", "s").collect()}
    assert got == {("g", "a", "x"), ("g", "b", "z"), ("h", "a", "x")}


def test_first_by_key_and_paths(spark):
    df = spark.createDataFrame([("a", 2, (1,)), ("a", 1, (2,)), ("b", 5, None)], "k string, o int, s struct<x:int>")
    assert {(r.k, r.o) for r in selection.first_by_key(df, ["k"], ["o"]).collect()} == {("a", 1), ("b", 5)}
    assert selection.null_paths(df) == ["k", "o", "s", "s.x"]
    assert selection.first_by_key(df.limit(0), ["k"], ["o"]).agg(F.count("*")).collect()[0][0] == 0
