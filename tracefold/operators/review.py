"""Decisions of people carried beside the evidence, never over it; and matching by rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions.scores import has_pairs


def row_digest(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def apply_decisions(records: DataFrame, decisions: DataFrame, key: str, immutable: list[str], digest: str, decision: str) -> DataFrame:
    """Records with ``decision`` and ``outcome``: applied, undecided, stale (made for another digest) or unknown (no such record).

    Of several decisions for one record the latest ``decided_at`` counts.
    """
    last = decisions.groupBy(key).agg(F.max_by(F.struct(digest, decision), "decided_at").alias("_d"))
    rows = records.withColumn("_now", row_digest(immutable)).join(last, key, "full_outer")
    outcome = F.when(F.col("_now").isNull(), "unknown").when(F.col("_d").isNull(), "undecided").when(F.col(f"_d.{digest}") == F.col("_now"), "applied").otherwise("stale")
    return rows.withColumn("outcome", outcome).withColumn("decision", F.when(F.col("outcome") == "applied", F.col(f"_d.{decision}"))).drop("_now", "_d")


def matching_rules(facts: DataFrame, kind: str, fields: str, rules: DataFrame) -> DataFrame:
    """Facts with every rule (``rule, kind, pattern``) whose kind is theirs and whose pairs they hold; rules are a checked small table."""
    if rules.count() > 10_000:
        joined = facts.join(rules.withColumnRenamed("kind", "_k"), F.col(kind) == F.col("_k"))
    else:
        joined = facts.join(F.broadcast(rules.withColumnRenamed("kind", "_k")), F.col(kind) == F.col("_k"))
    return joined.where(has_pairs(F.col(fields), F.col("pattern"))).drop("_k")


def rule_coverage(rules: DataFrame, matched: DataFrame, rule: str, fact: str) -> DataFrame:
    """Every rule with the number of facts it matched and the first of them, 0 where there is none."""
    counts = matched.groupBy(rule).agg(F.count(F.lit(1)).alias("n_facts"), F.min(fact).alias("first_fact"))
    return rules.select(rule).distinct().join(counts, rule, "left").withColumn("n_facts", F.coalesce("n_facts", F.lit(0)))


def multiplier(pairs: DataFrame, key: str, attack: str, defences: str, chart: DataFrame) -> DataFrame:
    """Product of the chart's multipliers (``attack, defence, x``) over each row's array of defences; ``known`` is false if one is missing."""
    rows = pairs.select(key, F.col(attack).alias("attack"), F.explode(defences).alias("defence")).join(chart, ["attack", "defence"], "left")
    folded = rows.groupBy(key).agg(F.collect_list("x").alias("_xs"), F.bool_and(F.col("x").isNotNull()).alias("known"))
    return folded.select(key, F.when(F.col("known"), F.aggregate(F.array_sort("_xs"), F.lit(1.0), lambda s, x: s * x)).alias("multiplier"), "known")


def resolve_names(asks: DataFrame, key: str, name: str, block: str, aliases: DataFrame) -> DataFrame:
    """Each ask with the entries its name may mean (``block, alias, entry_id``): unique, ambiguous or unresolved."""
    hits = asks.select(key, F.col(name).alias("alias"), F.col(block).alias("block")).join(aliases.select("block", "alias", "entry_id").distinct(), ["block", "alias"], "left")
    out = hits.groupBy(key).agg(F.count("entry_id").alias("n"), F.min("entry_id").alias("_first"))
    status = F.when(F.col("n") == 0, "unresolved").when(F.col("n") == 1, "unique").otherwise("ambiguous")
    return out.select(key, status.alias("status"), F.when(F.col("n") == 1, F.col("_first")).alias("entry_id"), F.col("n").alias("n_candidates"))


def numbered_facts(parts: list[DataFrame], entity: str, time: str, priority: str, tie: str, prefix: str) -> DataFrame:
    """Parts put together in one total order per entity, with ``sequence`` and an id built from it."""
    from functools import reduce

    from tracefold.operators.sequence import running_sum

    rows = reduce(DataFrame.unionByName, parts)
    out = running_sum(rows, [entity], [time, priority, tie], F.floor(F.col(time) / 600), F.lit(1), "sequence")
    return out.withColumn("fact_id", F.concat(F.col(entity), F.lit(f":{prefix}-"), F.lpad(F.col("sequence").cast("string"), 6, "0")))


def fixed_counts(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Counts of each of ``values``, zeros included."""
    spark = df.sparkSession
    keys = spark.createDataFrame([(v,) for v in values], f"`{column}` string")
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return keys.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def validation(df: DataFrame, text: str, confidence: str, strength: Column) -> DataFrame:
    """Text readings in three classes with reasons: valid, no text, uncertain."""
    from tracefold.functions.text import cjk_count, line_count

    c = F.col(text)
    reasons = F.array_compact(
        F.array(
            F.when(cjk_count(c) < 2, "too_few_characters"),
            F.when(line_count(c) > 3, "too_many_lines"),
            F.when(F.col(confidence) < 0.65, "low_confidence"),
            F.when(strength < 0.5, "weak_picture"),
        )
    )
    rows = df.withColumn("reasons", F.when(c.isNull() | (F.trim(c) == ""), F.array(F.lit("empty"))).otherwise(reasons))
    label = F.when(F.array_contains("reasons", "empty"), "NO_TEXT").when(F.size("reasons") == 0, "VALID_TEXT").otherwise("UNCERTAIN")
    return rows.withColumn("label", label)
