import json

import pytest

from tracefold.sources.sinks import table_digest
from pyspark.sql import functions as F

from tracefold.operators import quality, review
from tracefold.sources import sinks, tables


def test_json_and_envelope(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps({"kind": "k", "count": 2, "rows": [{"a": 1}, {"a": 2}]}))
    head, rows = tables.artifact(spark, str(path), "rows", "kind string, count int, rows array<struct<a:int>>")
    assert head.collect()[0]["count"] == 2 and [r.a for r in rows.orderBy("_pos").collect()] == [1, 2]


def test_jsonl(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"a": 1}\n{bad\n')
    with pytest.raises(Exception):
        tables.jsonl(spark, str(path), "a int").collect()
    kept = tables.jsonl(spark, str(path), "a int", strict=False).collect()
    assert sorted((r.a is None, r._corrupt) for r in kept) == [(False, None), (True, "{bad")]
    assert tables.jsonl_if_present(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0


def test_csv_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("﻿id,note\n1,\"x, \"\"y\"\"\nz\"\n", encoding="utf-8")
    assert [tuple(r) for r in tables.csv(spark, str(path), ["id", "note"]).collect()] == [("1", 'x, "y"\nz')]
    with pytest.raises(ValueError):
        tables.csv(spark, str(path), ["id", "other"])


def test_scrapes(spark, tmp_path):
    (tmp_path / "p.html").write_text("<td>No 1</td><b>A &amp; B</b><td>No 2</td><b>C</b>")
    rows = tables.scrape(tables.pages(spark, str(tmp_path / "p.html")), "value", r"<td>No (\d+)</td><b>([^<]*)</b>", ["no", "name"])
    assert [(r.no, r.name) for r in rows.orderBy("_pos").collect()] == [("1", "A & B"), ("2", "C")]
    (tmp_path / "d.ts").write_text('abc: {num: 1, name: "Abc"},\nxyz: {num: 2},\nabc: {num: 9},')
    got = tables.literal_fields(tables.pages(spark, str(tmp_path / "d.ts")), "value", r"(\w+): \{([^}]*)\}", {"num": r"num: (\d+)", "name": r'name: "([^"]*)"'})
    assert sorted(tuple(r) for r in got.select("key", "num", "name").collect()) == [("abc", "1", "Abc"), ("xyz", "2", None)]


def test_images_and_catalogue(spark, tmp_path):
    (tmp_path / "r1").mkdir()
    (tmp_path / "r1" / "a.png").write_bytes(bytes.fromhex("89504E470D0A1A0A00"))
    (tmp_path / "r1" / "b.jpg").write_bytes(b"GIF89a")
    got = {r.path.rsplit("/", 1)[1]: (r.kind, r.agrees) for r in tables.images(spark, str(tmp_path / "r1" / "*")).collect()}
    assert got == {"a.png": ("png", True), "b.jpg": ("gif", False)}
    assert {(r.replay, r.file) for r in tables.catalogue(spark, str(tmp_path), r"/(r\d+)/(\w+)\.\w+$", ["replay", "file"]).collect()} == {("r1", "a"), ("r1", "b")}


def test_staged_outputs_swap_together(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    first = sinks.Staged(spark, root)
    first.write(df, f"{root}/x")
    first.write(df, f"{root}/y", "jsonl")
    first.commit()
    assert spark.read.parquet(f"{root}/x").count() == 2
    assert sorted(r.value for r in spark.read.text(f"{root}/y").collect()) == ['{"id":1,"t":"a"}', '{"id":2,"t":null}']
    second = sinks.Staged(spark, root)
    second.write(df.limit(1), f"{root}/x")
    with pytest.raises(ValueError):
        second.commit(lambda: quality.require({"rows": df}))
    assert spark.read.parquet(f"{root}/x").count() == 2 and sorted(p.name for p in tmp_path.iterdir()) == ["x", "y"]
    with pytest.raises(ValueError):
        second.write(df, "/elsewhere")


def test_digests(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    assert sinks.table_digest(df) == sinks.table_digest(df.orderBy(F.desc("id"))) != sinks.table_digest(df.limit(1))
    assert sinks.manifest(df, "id").count() == 2


def test_quality(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 0.5), ("a", 2, 2.0), ("b", 1, None)], "k string, i int, v double")
    assert quality.unique(df, ["k", "i"]).count() == 1
    assert quality.orphans(df, "k", df.where("k = 'a'").withColumnRenamed("k", "kk"), "kk").count() == 1
    assert quality.not_ascending(df.where("NOT (i = 2 AND v = 2.0)"), ["k"], "i", "v").count() == 1
    assert {r.side for r in quality.set_difference(df, df.limit(0)).collect()} == {"left"}
    fates = quality.additive(df.where("v = 1.0").select("k", "v"), spark.createDataFrame([("a", 3.0), ("c", 1.0)], "k string, v double"), "k")
    assert {r.k: r.fate for r in fates.collect()} == {"a": "changed", "c": "added"}
    with pytest.raises(ValueError, match="dup"):
        quality.require({"dup": quality.unique(df, ["k", "i"]), "fine": df.limit(0)})


def test_review(spark):
    records = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, t string")
    digest = {r.id: r.d for r in records.select("id", review.row_digest(["t"]).alias("d")).collect()}
    decisions = spark.createDataFrame([(1, digest[1], "yes", 1), (1, digest[1], "no", 2), (2, "old", "yes", 1), (9, "x", "yes", 1)], "id int, seen string, verdict string, decided_at int")
    got = {r.id: (r.outcome, r.decision) for r in review.apply_decisions(records, decisions, "id", ["t"], "seen", "verdict").collect()}
    assert got == {1: ("applied", "no"), 2: ("stale", None), 3: ("undecided", None), 9: ("unknown", None)}


def test_multiplier_and_names(spark):
    chart = spark.createDataFrame([("F", "G", 2.0), ("F", "W", 0.5)], "attack string, defence string, x double")
    asks = spark.createDataFrame([(1, "F", ["G", "W"]), (2, "F", ["G", "Z"])], "id int, a string, d array<string>")
    assert {r.id: (r.multiplier, r.known) for r in review.multiplier(asks, "id", "a", "d", chart).collect()} == {1: (1.0, True), 2: (None, False)}
    aliases = spark.createDataFrame([("s", "x", 1), ("s", "y", 1), ("s", "y", 2)], "block string, alias string, entry_id int")
    names = spark.createDataFrame([(1, "x", "s"), (2, "y", "s"), (3, "z", "s")], "id int, n string, b string")
    got = {r.id: (r.status, r.entry_id) for r in review.resolve_names(names, "id", "n", "b", aliases).collect()}
    assert got == {1: ("unique", 1), 2: ("ambiguous", None), 3: ("unresolved", None)}


def test_a_recogniser_gets_batches(spark):
    jobs = spark.createDataFrame([(1, "a"), (2, None)], "id int, image string")
    out = tables.recognise(jobs, lambda b: b.assign(text=b.image.str.upper(), error=b.image.isna().map({True: "no image", False: None}))[["id", "text", "error"]], "id int, text string, error string")
    assert sorted(tuple(r) for r in out.collect()) == [(1, "A", None), (2, None, "no image")]


def test_canonical_json_sorts_at_every_depth(spark):
    from tracefold.sources.sinks import canonical_json

    a = spark.sql("SELECT named_struct('b', 1, 'a', array(named_struct('y', 2, 'x', CAST(NULL AS INT)))) AS s, map('k', 1, 'c', 2) AS m, CAST(NULL AS STRUCT<q: INT>) AS n")
    b = spark.sql("SELECT CAST(NULL AS STRUCT<q: INT>) AS n, map('c', 2, 'k', 1) AS m, named_struct('a', array(named_struct('x', CAST(NULL AS INT), 'y', 2)), 'b', 1) AS s")
    texts = [d.select(canonical_json(d.columns, d.schema).alias("j")).collect()[0].j for d in (a, b)]
    assert texts[0] == texts[1] == '{"m":{"c":2,"k":1},"n":null,"s":{"a":[{"x":null,"y":2}],"b":1}}'
    assert table_digest(a) == table_digest(b)


def test_index_gates_and_trees(spark):
    from tracefold.sources.tables import index_gates, tree_files

    rows = [("r", 0, 0.0, 0.1), ("r", 1, 0.1, None), ("r", 2, 0.1, 0.1), ("r", 4, 0.05, 0.1), ("q", 0, 1.0, 0.1)]
    df = spark.createDataFrame(rows, "replay string, ordinal long, pts double, duration double")
    got = {(r.replay, r.ordinal, r.gate) for r in index_gates(df, ["replay"], "ordinal", "pts").collect()}
    assert got == {("r", 2, "not_after"), ("r", 4, "not_after"), ("r", 4, "missing_before")}
    trees = spark.createDataFrame([('{"tree": [{"path": "a/b.csv", "type": "blob"}, {"path": "a", "type": "tree"}, {"path": "a/b.csv", "type": "blob"}]}',), ("{",), (None,)], "value string")
    assert [r.path for r in tree_files(trees, "value").collect()] == ["a/b.csv"]
