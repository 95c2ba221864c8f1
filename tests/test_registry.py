import pytest

from tracefold.functions.registry import Registry, register_sql
from tracefold.functions.text import TextRule
from tracefold.operators import quality


def test_names_are_taken_once():
    rules = Registry("rule")
    rules.register("a", TextRule("a", "K", "x", 1.0))

    @rules.step("b")
    def step(state, row):
        return []

    assert rules["b"] is step and [r.name for r in rules.rules()] == ["a"]
    with pytest.raises(ValueError, match="rule a"):
        rules.register("a", step)


def test_sql_names(spark):
    assert register_sql(spark) == ["nfkc", "alias_key"]
    row = spark.sql("SELECT nfkc('Ａ①') AS a, alias_key('Ｂ b!') AS b, nfkc(CAST(NULL AS STRING)) AS c").collect()[0]
    assert tuple(row) == ("A1", "bb", None)


def test_allow_list(spark):
    seen = spark.createDataFrame([("a", 1), ("a", 2), (None, 1)], "k string, v int")
    allowed = spark.createDataFrame([("a", 1), (None, 1)], "k string, v int")
    assert [tuple(r) for r in quality.not_allowed(seen, allowed, ["k", "v"]).collect()] == [("a", 2)]
