"""The domain tables with repeated deliveries counted once, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.session import read

ENDS = "start_time IS NOT NULL AND end_time IS NOT NULL AND end_time >= start_time"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "event_candidates").dropDuplicates(["event_id"]).where(ENDS)


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "timeline_groups").dropDuplicates(["timeline_id"]).where(ENDS)


def hp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "hp_observations").dropDuplicates(["observation_id"])
    return rows.withColumn("hp", F.when(F.col("hp_percent").between(0, 100) & ~F.isnan("hp_percent"), F.col("hp_percent")))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "frame_scan").dropDuplicates(["replay_id", "sample_index"])


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "sample_plan").select("replay_id", "sample_index", F.coalesce("pts", "target_time").alias("t"))
    return rows.dropDuplicates(["replay_id", "sample_index"])


def ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "ocr_observations").dropDuplicates(["request_id"])


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "parser_regression").dropDuplicates(["candidate_id"])


# The same as common table expressions.
CTE = {
    "ev": f"SELECT DISTINCT ON (event_id) * FROM event_candidates WHERE {ENDS}",
    "gr": f"SELECT DISTINCT ON (timeline_id) * FROM timeline_groups WHERE {ENDS}",
    "hp": "SELECT *, CASE WHEN hp_percent BETWEEN 0 AND 100 AND NOT isnan(hp_percent) THEN hp_percent END AS hp FROM (SELECT DISTINCT ON (observation_id) * FROM hp_observations)",
    "fr": "SELECT DISTINCT ON (replay_id, sample_index) * FROM frame_scan",
    "pl": "SELECT DISTINCT ON (replay_id, sample_index) replay_id, sample_index, coalesce(pts, target_time) AS t FROM sample_plan",
    "oc": "SELECT DISTINCT ON (request_id) * FROM ocr_observations",
    "pr": "SELECT DISTINCT ON (candidate_id) * FROM parser_regression",
}


def with_tables(*names: str, rest: str = "") -> str:
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in names) + rest + "\n"
