import pytest
from pyspark.sql import functions as F

from tracefold.functions import scores as sc
from tracefold.functions import text as tx


def one(spark, col, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")])
    return df.select(col.alias("out")).collect()[0].out


@pytest.mark.parametrize(("s", "want"), [(0.0, "00:00:00.000"), (-3.0, "00:00:00.000"), (3661.0014, "01:01:01.001"), (59.9996, "00:01:00.000")])
def test_display_time(spark, s, want):
    assert one(spark, tx.display_time(F.lit(s))) == want


@pytest.mark.parametrize(("t", "want"), [("HP ９９/154", (99, 154)), ("99/ 98", None), ("0/0", None), ("x", None), ("5 / 9 z", (5, 9))])
def test_exact_fraction(spark, t, want):
    got = one(spark, tx.exact_fraction(F.lit(t)))
    assert (got and (got.current, got.most)) == want


def test_small_parsers(spark):
    assert one(spark, tx.percentage(F.lit("HP 87％"))) == 87.0
    assert one(spark, tx.percentage(F.lit("870%"))) is None
    assert one(spark, tx.status_word(F.lit("麻痺灼傷"))) == "灼傷"
    assert one(spark, tx.single_marker(F.lit("3 3"))) == 3 and one(spark, tx.single_marker(F.lit("13"))) is None
    assert one(spark, tx.shortest_name(F.lit("火焰鳥麻痺 12/40 水龜"))) == "水龜"
    assert one(spark, tx.shortest_name(F.lit("12"))) is None
    assert one(spark, tx.cjk_count(F.lit("a羽b蜥!"))) == 2
    assert one(spark, tx.line_count(F.lit("a\n \nb"))) == 2
    assert one(spark, tx.ellipsize(F.lit("abcdef"), 4)) == "abc…"
    assert one(spark, tx.clean_lines(F.lit(" a b \n\n c！"))) == "ab\nc!"
    got = one(spark, tx.subjects(F.lit("對手的羽蜥和龜牙")))
    assert (got.names, got.side) == (["羽蜥", "龜牙"], "opponent")
    assert one(spark, tx.line_targets(F.lit("甲和乙\n丙"))) == ["甲", "乙", "丙"]


def test_python_columns(spark):
    assert one(spark, tx.nfkc(F.lit("Ａ①"))) == "A1"
    assert one(spark, tx.alias_key(F.lit("Ｎidoran ♀!"), "♀")) == "nidoran♀"
    assert one(spark, tx.ratio(F.lit("abcd"), F.lit("bcde"))) == 0.75


def test_scores(spark):
    assert one(spark, sc.hex_hamming(F.lit("ff00"), F.lit("ff01"))) == 1 - 1 / 16
    assert one(spark, sc.hex_hamming(F.lit("f" * 64), F.lit("0" * 64))) == 0
    assert one(spark, sc.hex_hamming(F.lit("ff"), F.lit("f"))) == 0
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, sc.cosine(arr(1, 0), arr(1, 1))) == pytest.approx(0.5**0.5)
    assert one(spark, sc.correlation(arr(1, 2, 3), arr(2, 4, 6))) == pytest.approx(1)
    assert one(spark, sc.array_mae(arr(1, 2), arr(2, 4))) == 1.5
    assert one(spark, sc.histogram_intersection(arr(0.5, 0.5), arr(0.2, 0.8))) == pytest.approx(0.7)
    assert one(spark, sc.product(arr(2, 0.5, 4))) == 4
    assert one(spark, sc.weighted([(0.5, F.lit(1.0)), (0.25, F.lit(2.0))])) == 1
    assert one(spark, sc.rotation(F.lit(90))) == 270
    assert one(spark, sc.clamp(F.lit(9), -6, 6)) == 6
    scores = F.create_map(F.lit("A"), F.lit(0.6), F.lit("B"), F.lit(0.6), F.lit("C"), F.lit(0.9))
    assert one(spark, sc.best_label(scores, {"A": 0.5, "B": 0.5, "C": 0.95})) == "A"
    assert one(spark, sc.best_label(scores, {"A": 0.7})) == "UNKNOWN"
    have, want = F.create_map(F.lit("a"), F.lit("1")), F.create_map(F.lit("a"), F.lit("2"))
    assert one(spark, sc.has_pairs(have, have)) and not one(spark, sc.has_pairs(have, want))
