"""Queries of the training-data problems, with the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm.canon_list import map_to_list
from tracefold.llm.collapse import collapse_runs, state_label
from tracefold.llm.leaks import find_leaks
from tracefold.llm.lookalike import alike_pairs, canonical, corpus_counts
from tracefold.llm.nearest import nearest_in_time
from tracefold.llm.packing import pack
from tracefold.llm.splitting import split_texts
from tracefold.session import read

SCORES = ("TEAM_PREVIEW", "SELECTED_FOUR", "MOVE_MENU", "BATTLE_TEXT", "TRIGGER_NOTIFICATION", "RESULT")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "frame_scan")
    scores = [F.col("candidate_scores")[k] for k in SCORES]
    return collapse_runs(rows, "replay_id", "sample_index", "pts", state_label(F.col("ui_state")), scores, max_gap=0.25, tolerance=0.02)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).where("n >= 2").select("replay_id", F.col("first").cast("int").alias("first_sample_index"), F.col("last").cast("int").alias("last_sample_index"))


def p2_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run, single samples too, with its sample count and duration."""
    return _runs(spark, sf_dir).select("replay_id", F.col("label").alias("ui_state"), F.col("first").alias("first_sample_index"), F.col("last").alias("last_sample_index"), F.col("n").alias("sample_count"), F.bround("duration", 6).alias("duration"))


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that name a species or a move, with the kind of entry; each request once."""
    rows = read(spark, sf_dir, "ocr_observations").where("role IN ('team_preview', 'move_menu') AND length(raw_text) > 0")
    kind = F.when(F.col("role") == "team_preview", "species").otherwise("move")
    return rows.groupBy("request_id").agg(F.min(F.struct(kind.alias("kind"), F.col("raw_text"))).alias("x")).select("request_id", "x.kind", "x.raw_text")


def _reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "match_reference")
    return rows.select(F.col("kind").alias("block"), "entry_id", F.explode(F.array("zh_tw", "en", "showdown_id")).alias("name"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    asks = _readings(spark, sf_dir)
    found = map_to_list(asks, "raw_text", "kind", _reference(spark, sf_dir))
    joined = asks.join(found.select(F.col("block").alias("kind"), F.col("value").alias("raw_text"), "entry_id"), ["kind", "raw_text"])
    return joined.select("request_id", F.coalesce("entry_id", F.lit(0)).cast("int").alias("entry_id"))


def p3_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct readings that stand for no entry, with the number of requests."""
    asks = _readings(spark, sf_dir)
    found = map_to_list(asks, "raw_text", "kind", _reference(spark, sf_dir)).where("entry_id IS NULL").select(F.col("block").alias("kind"), F.col("value").alias("raw_text"))
    counts = asks.groupBy("kind", "raw_text").agg(F.count(F.lit(1)).alias("n_requests"))
    return counts.join(found, ["kind", "raw_text"])


def _lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rules = read(spark, sf_dir, "parser_regression").select(F.col("candidate_id").alias("key"), F.col("raw_text").alias("text"))
    lines = read(spark, sf_dir, "ocr_observations").where("role = 'battle_text'").select(F.col("request_id").alias("key"), F.col("raw_text").alias("text"))
    return rules, lines


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, lines = _lines(spark, sf_dir)
    return alike_pairs(rules, lines, corpus_counts(rules.unionByName(lines), "text"))


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct line with its consistent form."""
    rules, lines = _lines(spark, sf_dir)
    both = rules.unionByName(lines).where("text IS NOT NULL")
    return both.select("text").distinct().withColumn("form", canonical(F.col("text"), corpus_counts(both, "text")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    asks, plan = read(spark, sf_dir, "ocr_observations"), read(spark, sf_dir, "sample_plan")
    near = nearest_in_time(asks, plan, "request_id", "replay_id", F.col("pts"), "sample_index", "replay_id", F.coalesce("pts", "target_time"), 0.12)
    return near.select(F.col("_left").alias("request_id"), F.col("_entity").alias("replay_id"), F.col("_right").alias("sample_index"))


def _limits(spark: SparkSession, sf_dir: str, purpose: str) -> list:
    """The few rows of size_limits with one purpose; a table of limits, so small by nature."""
    return sorted(read(spark, sf_dir, "size_limits").where(F.col("purpose") == purpose).select("limit_id", "max_tokens", F.coalesce("overlap_tokens", F.lit(0)).alias("overlap")).collect())


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacities = {r.limit_id: r.max_tokens for r in _limits(spark, sf_dir, "container")}
    return pack(read(spark, sf_dir, "documents"), "doc_id", "text", "source", capacities)


def p7_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers that never hold two documents of one source, whatever space that costs."""
    capacities = {r.limit_id: r.max_tokens for r in _limits(spark, sf_dir, "container")}
    return pack(read(spark, sf_dir, "documents"), "doc_id", "text", "source", capacities, sources="never")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and filled share by limit."""
    limits = read(spark, sf_dir, "size_limits").select("limit_id", "max_tokens")
    boxes = p7_containers(spark, sf_dir).groupBy("limit_id").agg(F.countDistinct("container").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    return boxes.join(limits, "limit_id").select("limit_id", "max_tokens", "n_containers", "n_tokens", F.bround(F.col("n_tokens") / (F.col("n_containers") * F.col("max_tokens")), 6).alias("filled"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items")
    return find_leaks(docs, "doc_id", "text", items, "item_id", "text").select("doc_id", F.col("item_id").cast("int").alias("item_id"))


def p8_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each test item that leaked, with the number of documents that hold it."""
    items = read(spark, sf_dir, "eval_items")
    counts = p8_found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))
    return items.select("item_id", "suite").join(counts, "item_id")


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = {r.limit_id: (r.max_tokens, r.overlap) for r in _limits(spark, sf_dir, "piece")}
    return split_texts(read(spark, sf_dir, "documents"), "doc_id", "text", limits)


def p9_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces by limit and kind of end."""
    limits = {r.limit_id: (r.max_tokens, r.overlap) for r in _limits(spark, sf_dir, "piece")}
    pieces = split_texts(read(spark, sf_dir, "documents"), "doc_id", "text", limits, with_text=False)
    return pieces.groupBy("limit_id", "ends_at").agg(F.count(F.lit(1)).alias("n_pieces"), F.max("n_tokens").alias("most_tokens"))


_P2 = """
WITH s AS (SELECT DISTINCT ON (replay_id, sample_index) replay_id, sample_index, pts,
             regexp_replace(upper(regexp_replace(ui_state, '^[\\s\\-_]+|[\\s\\-_]+$', '', 'g')), '[\\s\\-_]+', '_', 'g') AS state,
             candidate_scores AS m FROM frame_scan),
f AS (SELECT replay_id, sample_index, pts, state, """ + ", ".join(f"m['{k}'] AS x{i}" for i, k in enumerate(SCORES)) + """ FROM s),
g AS (SELECT *, CASE WHEN abs(pts - lag(pts) OVER w) <= 0.25 + 1e-9 AND state IS NOT DISTINCT FROM lag(state) OVER w
  AND ((""" + " AND ".join(f"x{i} IS NULL AND lag(x{i}) OVER w IS NULL" for i in range(6)) + """) OR (""" + " AND ".join(f"abs(x{i} - lag(x{i}) OVER w) <= 0.02 + 1e-9" for i in range(6)) + """))
  THEN 0 ELSE 1 END AS new FROM f WINDOW w AS (PARTITION BY replay_id ORDER BY sample_index)),
r AS (SELECT *, sum(new) OVER (PARTITION BY replay_id ORDER BY sample_index ROWS UNBOUNDED PRECEDING) AS no FROM g)
"""

SQL = {
    "p2_found": _P2 + "SELECT replay_id, min(sample_index) AS first_sample_index, max(sample_index) AS last_sample_index FROM r GROUP BY replay_id, no HAVING count(*) >= 2",
    "p2_events": _P2
    + "SELECT replay_id, min(state) AS ui_state, CAST(min(sample_index) AS BIGINT) AS first_sample_index, CAST(max(sample_index) AS BIGINT) AS last_sample_index, count(*) AS sample_count, round_even(max(pts) - min(pts), 6) AS duration FROM r GROUP BY replay_id, no",
    "p6_found": """
WITH q AS (SELECT DISTINCT request_id, replay_id, pts AS t FROM ocr_observations WHERE pts IS NOT NULL),
i AS (SELECT DISTINCT replay_id, sample_index, coalesce(pts, target_time) AS t FROM sample_plan)
SELECT q.request_id, q.replay_id, arg_min(i.sample_index, struct_pack(d := abs(i.t - q.t), s := i.sample_index)) AS sample_index
FROM q JOIN i ON q.replay_id = i.replay_id AND i.t BETWEEN q.t - 0.1200001 AND q.t + 0.1200001
WHERE abs(i.t - q.t) <= 0.12 + 1e-9 GROUP BY 1, 2""",
}

QUERIES = {f.__name__: f for f in (p2_found, p2_events, p3_found, p3_unmatched, p5_found, p5_forms, p6_found, p7_containers, p7_strict, p7_fill, p8_found, p8_leaked_items, p9_pieces, p9_ends)}
