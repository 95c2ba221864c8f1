"""Queries of the general data problems on the domain tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.operators.intervals import periods_and_gaps, sweep
from tracefold.operators.spikes import context_fences, flag_implausible
from tracefold.session import read

SOURCE = ["replay_id", "side", "slot"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "hp_observations")
    return flag_implausible(rows, "observation_id", SOURCE, "timestamp", "hp_percent").select("observation_id").distinct()


def p1_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings by reason, spikes in the rate of change included, which ``p1_found`` has no kind for."""
    rows = read(spark, sf_dir, "hp_observations")
    return flag_implausible(rows, "observation_id", SOURCE, "timestamp", "hp_percent", rates=True).groupBy("reason").agg(F.count(F.lit(1)).alias("n_readings"))


def p1_context_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_fences(read(spark, sf_dir, "hp_observations"), "observation_id", SOURCE, "timestamp", "hp_percent")


def _millis(df: DataFrame) -> DataFrame:
    return df.withColumns({"_start_ms": F.round(F.col("start_time") * 1000).try_cast("long"), "_end_ms": F.round(F.col("end_time") * 1000).try_cast("long")})


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["_id", "source_table", "replay_id", "type", "_start_ms", "_end_ms"]
    events = _millis(read(spark, sf_dir, "event_candidates")).withColumns({"_id": F.concat(F.lit("e:"), "event_id"), "source_table": F.lit("event_candidates")})
    groups = _millis(read(spark, sf_dir, "timeline_groups")).withColumns({"_id": F.concat(F.lit("g:"), "timeline_id"), "source_table": F.lit("timeline_groups"), "type": F.lit("GROUP")})
    return events.select(*cols).unionByName(groups.select(*cols))


KEYS4 = ["source_table", "replay_id", "type"]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = periods_and_gaps(_both(spark, sf_dir), "_id", KEYS4, "_start_ms", "_end_ms", min_members=2, max_gap=60_000)
    return made.select(*KEYS4, "kind", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"))


def p4_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every period with its number of members and greatest number of intervals at once, and the gap before it."""
    made = sweep(_both(spark, sf_dir), "_id", KEYS4, "_start_ms", "_end_ms")
    return made.select(*KEYS4, F.col("start").alias("start_ms"), F.col("end").alias("end_ms"), "members", "max_active", (F.col("start") - F.col("gap_start")).cast("double").alias("gap_ms"))


_CLEAN = """
WITH raw AS (
  SELECT DISTINCT 'event_candidates' AS source_table, event_id AS id, replay_id, type,
         CAST(round(start_time * 1000) AS BIGINT) AS s, CAST(round(end_time * 1000) AS BIGINT) AS e
  FROM event_candidates
  UNION ALL
  SELECT DISTINCT 'timeline_groups', timeline_id, replay_id, 'GROUP',
         CAST(round(start_time * 1000) AS BIGINT), CAST(round(end_time * 1000) AS BIGINT)
  FROM timeline_groups),
c AS (SELECT source_table, id, min(struct_pack(s, e, replay_id, type)) AS r FROM raw
      WHERE s IS NOT NULL AND e IS NOT NULL AND e >= s GROUP BY 1, 2),
i AS (SELECT source_table, id, r.replay_id AS replay_id, r.type AS type, r.s AS s, r.e AS e FROM c),
m AS (SELECT *, max(e) OVER (PARTITION BY source_table, replay_id, type ORDER BY s, e, id
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END)
                OVER (PARTITION BY source_table, replay_id, type ORDER BY s, e, id ROWS UNBOUNDED PRECEDING) AS no FROM m),
p AS (SELECT source_table, replay_id, type, no, min(s) AS a, max(e) AS b, count(*) AS members,
             min(CASE WHEN reach IS NULL OR s > reach THEN reach END) AS prev
      FROM n GROUP BY ALL)
"""

SQL = {
    "p4_found": _CLEAN
    + """SELECT source_table, replay_id, type, 'period' AS kind, a AS start_ms, b AS end_ms FROM p WHERE members >= 2
UNION ALL SELECT source_table, replay_id, type, 'gap', prev, a FROM p WHERE a - prev <= 60000""",
    "p4_periods": _CLEAN
    + """, x AS (SELECT source_table, replay_id, type, s AS t, 1 AS d FROM i UNION ALL SELECT source_table, replay_id, type, e, -1 FROM i),
y AS (SELECT *, sum(d) OVER (PARTITION BY source_table, replay_id, type ORDER BY t, d DESC ROWS UNBOUNDED PRECEDING) AS active FROM x)
SELECT p.source_table, p.replay_id, p.type, a AS start_ms, b AS end_ms, members, CAST(max(active) AS BIGINT) AS max_active, CAST(a - prev AS DOUBLE) AS gap_ms
FROM p JOIN y ON p.source_table = y.source_table AND p.replay_id = y.replay_id AND p.type = y.type AND y.t BETWEEN a AND b
GROUP BY ALL""",
}

QUERIES = {f.__name__: f for f in (p1_found, p1_reasons, p1_context_fences, p4_found, p4_periods)}
