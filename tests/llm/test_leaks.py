import random

import numpy as np

import pytest

from tracefold.llm import leaks
from tracefold.llm.leaks import Batch, ItemIndex, ShortIndex, find_leaks, least_matches, least_share, letters, shingles

HAN = [chr(c) for c in range(0x4E00, 0x4E00 + 1500)]


def text(rng, n):
    return "".join(rng.choice(HAN) for _ in range(n))


def noisy(rng, t, p):
    return "".join(rng.choice(HAN) if rng.random() < p else c for c in t)


def test_plain_letters():
    assert (letters("Ａb, C!\n> é́") == letters("abce")).all()
    assert (letters("- ab\n12. cd\n[01:02.5] ef") == letters("abcdef")).all()
    assert len(letters("。，  \n")) == 0


def test_planted_stretches_are_found_and_short_ones_are_not(spark):
    rng = random.Random(11)
    items = [(i, text(rng, rng.randrange(80, 900))) for i in range(60)]
    docs, want, never = [], set(), set()
    for d in range(400):
        body, n = text(rng, rng.choice([50, 300, 3000, 20000])), 0
        for _ in range(rng.choice([0, 0, 1, 2])):
            i, t = rng.choice(items)
            share = rng.choice([1.0, 0.7, 0.55, 0.3])
            size = int(len(t) * share)
            a = rng.randrange(0, len(t) - size + 1)
            at = rng.randrange(0, len(body) + 1) if n == 0 else 0
            body, n = body[:at] + "\n".join(noisy(rng, t[a : a + size], 0.02)) + body[at:], n + 1
            (want if share > 0.5 else never).add((d, i))
        docs.append((d, body, 0.5))
    df = spark.createDataFrame(docs, "id long, text string, share double").repartition(4)
    it = spark.createDataFrame(items, "no int, text string")
    got = {(r.id, r.no) for r in find_leaks(df, "id", "text", it, "no", "text").collect()}
    assert len(want - got) <= 0.01 * len(want)
    assert not (got & (never - want)) and not got - want


def test_long_documents_nulls_and_repeats(spark):
    rng = random.Random(4)
    item = text(rng, 200)
    long = text(rng, 1_500_000)
    docs = [(None, "x"), (None, item), (1, long[:1_048_500] + item + long[1_048_500:]), (2, None), (3, ""), (4, "，。"), (5, item), (5, item), (6, item[:10])]
    df = spark.createDataFrame(docs, "id long, text string")
    it = spark.createDataFrame([(7, item), (8, None), (9, ""), (7, item), (10, "，")], "no int, text string")
    got = sorted(((r.id, r.no) for r in find_leaks(df, "id", "text", it, "no", "text").collect()), key=str)
    assert got == [(1, 7), (5, 7), (None, 7)]
    assert find_leaks(df.limit(0), "id", "text", it, "no", "text").count() == 0
    assert find_leaks(df, "id", "text", it.limit(0), "no", "text").count() == 0


def test_candidates_reach_the_recall_promised():
    rng = random.Random(9)
    items = [(i, text(rng, rng.randrange(80, 900))) for i in range(40)]
    index = ItemIndex(items, 0.5, 0.38, 64, 0.75, 1e-3)
    missed = n = 0
    for i, t in items:
        for _ in range(10):
            a = rng.randrange(0, len(t) // 2)
            doc = text(rng, rng.randrange(0, 3000)) + noisy(rng, t[a : a + len(t) // 2], 0.02) + text(rng, 1000)
            n += 1
            missed += i not in {index.ids[c] for c, _, _ in index.candidates(shingles(letters(doc)))}
    assert missed <= 0.01 * n


def test_least_matches():
    assert least_matches(0.3, 64, 1e-3) > 5 and least_matches(0.01, 64, 1e-3) == 1
    assert np.array_equal(shingles(letters("ab")), shingles(letters("A,b")))


def holds(doc, item):
    """The definition: a window of half the item, one letter in eight misread at most."""
    n = len(item)
    half = -(-n // 2)
    for d in range(-n, len(doc)):
        for a in range(n - half + 1):
            if d + a >= 0 and d + a + half <= len(doc) and sum(doc[d + a + i] != item[a + i] for i in range(half)) <= half // 8:
                return True
    return False


def test_short_items_equal_brute_force():
    rng = random.Random(21)
    few = HAN[:12]
    draw = lambda n: "".join(rng.choice(few) for _ in range(n))
    items = [(i, draw(rng.randrange(1, 40))) for i in range(40)]
    docs = []
    for _ in range(60):
        body = draw(rng.randrange(0, 60))
        _, t = rng.choice(items)
        a = rng.randrange(0, len(t))
        docs.append(body + "".join(rng.choice(few) if rng.random() < 0.05 else c for c in t[a:]) + draw(rng.randrange(0, 9)))
    index = ShortIndex([(i, letters(t)) for i, t in items], 0.5)
    got = {(d, i) for d, i, _ in index.leaks(Batch([letters(t) for t in docs]))}
    assert got == {(d, i) for d, doc in enumerate(docs) for i, t in items if holds(doc, t)}


@pytest.mark.parametrize("length", [6, 8, 10, 12, 16, 20, 24, 32, 40, 48, 63, 64, 80, 108])
def test_recall_by_length(length):
    rng = random.Random(length)
    items = [(i, text(rng, length)) for i in range(150)]
    docs, want = [], set()
    for i, t in items:
        for size in (length, -(-length // 2)):
            a = rng.randrange(0, length - size + 1)
            want.add((len(docs), i))
            docs.append(text(rng, rng.randrange(0, 400)) + t[a : a + size] + text(rng, 200))
    got = set()
    for index in leaks.indexes(items, 0.5, None, 64, 0.75, 1e-3):
        got |= {(d, i) for d, i, _ in index.leaks(Batch([letters(d) for d in docs]))}
    assert len(want & got) >= 0.99 * len(want)


def test_items_in_several_blocks_and_passes(spark, monkeypatch):
    rng = random.Random(5)
    items = [(i, text(rng, rng.choice([8, 30, 100, 300]))) for i in range(40)]
    docs = [(i, text(rng, 500) + t + text(rng, 100)) for i, t in items]
    df = spark.createDataFrame(docs, "id long, text string").repartition(3)
    it = spark.createDataFrame(items, "no int, text string")
    pairs = lambda: {(r.id, r.no) for r in find_leaks(df, "id", "text", it, "no", "text").collect()}
    whole = pairs()
    assert {(i, i) for i, _ in items} <= whole
    monkeypatch.setattr(leaks, "BLOCK_LETTERS", 700)
    assert len(leaks.indexes(sorted(items), 0.5, None, 64, 0.75, 1e-3)) > 3
    monkeypatch.setattr(leaks, "PASS_BLOCKS", 2)
    assert pairs() == whole


def test_an_item_longer_than_a_piece(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(leaks, "PIECE", 4096)
    item, doc = text(rng, 9000), text(rng, 120_000)
    doc = doc[:50_000] + item + doc[50_000:]
    parts = leaks._pieces(letters(doc), 2 * len(item))
    assert len(parts) < 20 and sum(map(len, parts)) <= 2.5 * len(doc)
    assert any(item in "".join(map(chr, p)) for p in parts)
    assert "".join(map(chr, parts[-1])).endswith(doc[-100:])


def test_least_share():
    assert least_share(103, 0.5, 0.75) == pytest.approx(0.75 * 49 / 103)
