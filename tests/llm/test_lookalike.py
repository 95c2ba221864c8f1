import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from tracefold.llm.lookalike import CLASSES, Canonical, alike_pairs, canonical, corpus_counts, fold, neighbour_counts, skeleton

COUNTS = neighbour_counts(["カタカナ ロニエカ", "力士出口二人工人", "Saxe Corp", "Москва", "八卜夕"])
FORM = Canonical(COUNTS)


def test_what_looks_the_same_gets_one_form():
    same = [
        ("ＨＰ　８７％", "HP 87%"),
        ("Bromé", "Bromé"),
        ("ab​c﻿­", "abc"),
        ("a b c", "a b c"),
        ("⼤林", "大林"),
        ("ｶﾞｴ", "ガエ"),
        ("力゙", "ガ"),
        ("Ѕахе Соrр", "Saxe Corp"),
        ("ロ二エ力", "ロニエカ"),
        ("a‐b－c", "a-b-c"),
        ("a\r\nb", "a\nb"),
        ("ⅬⅭ", "LC"),
    ]
    for a, b in same:
        assert FORM(a) == FORM(b), (a, b)
        assert skeleton(a) == skeleton(b)


def test_what_looks_different_stays_different():
    different = [("a b", "ab"), ("a\nb", "a b"), ("A", "a"), ("x²", "x2"), ("①", "1"), ("大", "太"), ("士", "土"), ("1", "l"), ("0", "O"), ("a  b", "a b"), ("リ", "り"), ("カ", "ガ")]
    for a, b in different:
        assert FORM(a) != FORM(b), (a, b)


def test_the_search_keeps_to_a_script():
    assert FORM("ロニエカ") == "ロニエカ"
    assert FORM("Mосkvа") == "Mockva"
    assert FORM("出ロ") == "出口"
    assert FORM("ホロカエ") == "ホロカエ"
    assert FORM("Иванοв") .startswith("Иван")


def test_classes_are_disjoint():
    letters = [c for word in CLASSES for c in word]
    assert len(letters) == len(set(letters)) < 200


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aаοo力カ二ニ \n-‐éé​ＡA1l", max_size=12))
def test_form_is_stable_and_keeps_the_look(text):
    form = FORM(text)
    assert FORM(form) == form
    assert skeleton(form) == skeleton(text)
    assert unicodedata.is_normalized("NFC", form)
    assert fold(fold(text)) == fold(text)


def test_pairs(spark):
    left = spark.createDataFrame([("c1", "ロニ倒下了！"), ("c2", "口二倒下了!"), ("c3", "口二 倒下了!"), ("c4", None), ("c1", "ロニ倒下了！")], "key string, text string")
    right = spark.createDataFrame([("a1", "ロ​ニ倒下了!"), ("a2", "ロ​ニ倒下了!"), ("z", "ロニ倒下了！"), ("y", ""), (None, "口二倒下了!")], "key string, text string")
    counts = corpus_counts(left.unionByName(right), "text")
    got = {tuple(r) for r in alike_pairs(left, right, counts).collect()}
    assert got == {("c1", "c2"), ("a1", "c1"), ("a1", "c2"), ("a2", "c1"), ("a2", "c2"), ("c2", "z")}
    empty = left.limit(0)
    assert alike_pairs(empty, empty, corpus_counts(empty, "text")).count() == 0


def test_null_empty_and_long_texts(spark):
    long = "口 а" * 200_000
    df = spark.createDataFrame([(None,), ("",), ("​",), (long,)], "text string")
    got = [r[0] for r in df.select(canonical(df.text, corpus_counts(df, "text"))).collect()]
    assert got[:3] == [None, "", ""] and len(got[3]) == len(long)


def test_bigrams_decide_within_a_script():
    from tracefold.llm.lookalike import Canonical, neighbour_counts

    # both letters are Han or both are kana, so only the letters beside them tell
    counts = neighbour_counts(["カロ"] * 30 + ["出口"] * 30 + ["エ力"] * 5)
    form = Canonical(counts)
    assert form("カ口") == form("力ロ") == "カロ"
    assert counts["ロ", "カ"] == 30 and counts["ロ", "Kana"] == 30
