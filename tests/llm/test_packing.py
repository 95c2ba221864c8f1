import os
import random

import pytest

from tracefold.llm import tokens
from tracefold.llm.packing import best_fit, pack

needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary file")


def check(items, out, capacity):
    boxes, parts = {}, {}
    for box, item, part, start, size in out:
        boxes.setdefault(box, []).append((item, size))
        parts.setdefault(item, []).append((part, start, size))
    for held in boxes.values():
        assert sum(s for _, s in held) <= capacity
        copies = [clusters[i] for i, _ in held if (clusters := {x[0]: x[3] for x in items})[i] is not None]
        assert len(copies) == len(set(copies))
    for item, size, *_ in items:
        got = sorted(parts.pop(item))
        assert sum(x[2] for x in got) == size and (len(got) == 1 or size > capacity)
        assert all(x[1] == i * capacity for i, x in enumerate(got))
    assert not parts
    return boxes


def test_random_items_keep_all_rules():
    rng = random.Random(8)
    items = [(i, rng.randrange(1, 130), rng.choice(["a", "a", "b", None]), rng.choice([None, rng.randrange(40)])) for i in range(500)]
    for sources in ("prefer", "never", "ignore"):
        out = best_fit(items, 100, sources)
        boxes = check(items, out, 100)
        if sources == "never":
            of = {x[0]: x[2] for x in items}
            for held in boxes.values():
                named = [of[i] for i, _ in held if of[i]]
                assert len(named) == len(set(named))
        else:
            assert len(boxes) <= sum(x[1] for x in items) / 100 * 1.02 + 1


def test_tightest_compatible_container_is_taken():
    items = [(1, 70, "a", None), (2, 60, "b", None), (3, 30, "a", None)]
    assert best_fit(items, 100, "never") == [(0, 1, 0, 0, 70), (1, 2, 0, 0, 60), (1, 3, 0, 0, 30)]
    assert best_fit([(1, 70, "a", None), (3, 30, "a", None)], 100)[1][0] == 0
    assert best_fit([(1, 50, None, 5), (2, 50, None, 5)], 100)[1][0] == 1


def test_oversized_items_fill_their_own():
    out = best_fit([(1, 250, "a", None), (2, 50, "b", None)], 100)
    assert sorted(out) == [(0, 1, 0, 0, 100), (1, 1, 1, 100, 100), (2, 1, 2, 200, 50), (2, 2, 0, 0, 50)]
    assert best_fit([], 100) == []


@needs_vocabulary
def test_pack(spark):
    texts = [(i, "對手的羽蜥倒下了! " * (i % 40), "hot" if i % 3 else f"s{i}", "x") for i in range(300)] + [(900, None, "a", "x"), (901, " \n", "a", "x"), (None, "abc", "a", "x"), (5, "對手的羽蜥倒下了! " * 5, "hot", "x")]
    df = spark.createDataFrame(texts, "id long, text string, source string, part string")
    got = pack(df, "id", "text", "source", {1: 64, 2: 512}, shard=100).collect()
    tok = tokens.load()
    want = {i: tok.count(t) for i, t, *_ in texts if i is not None and t and t.strip()}
    for limit, capacity in ((1, 64), (2, 512)):
        fill, size = {}, {}
        for r in got:
            if r.limit_id == limit:
                fill[r.container] = fill.get(r.container, 0) + r.n_tokens
                size[r.id] = size.get(r.id, 0) + r.n_tokens
        assert size == want and max(fill.values()) <= capacity
    named = pack(df.selectExpr("'d' || id AS id", "text", "source"), "id", "text", "source", {1: 64}).select("id").distinct().count()
    assert named == len(want)
    assert pack(df.limit(0), "id", "text", "source", {1: 64}).count() == 0
    with pytest.raises(ValueError):
        pack(df, "id", "text", "source", {1: 0})


@needs_vocabulary
def test_given_clusters_and_sources_keep_apart(spark):
    rows = [(i, f"word {i}", f"s{i % 3}" if i % 5 else None, f"c{i % 7}" if i % 4 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string, source string, copies string")
    of = {r[0]: r for r in rows}
    boxes = {}
    for r in pack(df, "id", "text", "source", {1: 30}, sources="never", cluster_col="copies").collect():
        boxes.setdefault(r.container, []).append(of[r.id])
    assert sum(map(len, boxes.values())) == 60
    for held in boxes.values():
        for at in (2, 3):
            named = [x[at] for x in held if x[at] is not None]
            assert len(named) == len(set(named))
