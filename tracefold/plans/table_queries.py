"""Relational queries, quality gates, rule matching, vectors and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracefold.functions import scores as sc
from tracefold.functions import text as tx
from tracefold.operators import quality, review
from tracefold.operators.sequence import lagged
from tracefold.plans import tables
from tracefold.plans.event_queries import _EVENTS, narration
from tracefold.plans.tables import with_tables
from tracefold.session import checkpoint_dir, read
from tracefold.streaming import machines as streams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- star schema -------------------------------------------------------------


@query(
    "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round_even(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round_even(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '2000-09-02' GROUP BY ALL"
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").where("l_shipdate <= DATE '2000-09-02'")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.bround(F.sum(net), 2).alias("revenue"), F.bround(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query(
    """SELECT o_orderkey, round_even(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'HOUSEHOLD' AND o_orderdate < DATE '1999-03-15' AND l_shipdate > DATE '1999-03-15' GROUP BY o_orderkey, orders.o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10"""
)
def shipping_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten open orders of most value: the limit is the report."""
    c = read(spark, sf_dir, "customer").where("c_mktsegment = 'HOUSEHOLD'")
    o = read(spark, sf_dir, "orders").where("o_orderdate < DATE '1999-03-15'")
    li = read(spark, sf_dir, "lineitem").where("l_shipdate > DATE '1999-03-15'")
    rows = li.join(o.join(c, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    out = rows.groupBy("o_orderkey", "o_orderdate").agg(F.bround(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    return out.orderBy(F.desc("revenue"), "o_orderkey").limit(10).select("o_orderkey", "revenue", F.to_date("o_orderdate").cast("string").alias("o_orderdate"))


@query(
    """SELECT n_name, r_name, round_even(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"""
)
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    # added up by supplier before the dimension joins
    by_supplier = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("x"))
    rows = by_supplier.join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("n_name", "r_name").agg(F.bround(F.sum("x"), 2).alias("revenue"))


@query(
    "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round_even(sum(o_totalprice), 2) AS total, CAST(grouping(o_orderstatus) AS INT) AS all_status, CAST(grouping(o_orderpriority) AS INT) AS all_priority FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), (o_orderpriority), ())"
)
def grouping_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.bround(F.sum("o_totalprice"), 2).alias("total"), F.grouping("o_orderstatus").cast("int").alias("all_status"), F.grouping("o_orderpriority").cast("int").alias("all_priority")
    )


@query("SELECT group_type, review_status, count(*) AS n, CAST(grouping_id(group_type, review_status) AS BIGINT) AS gid FROM (SELECT DISTINCT ON (timeline_id) * FROM timeline_groups) GROUP BY GROUPING SETS ((group_type), (review_status), ())")
def timeline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "timeline_groups").dropDuplicates(["timeline_id"])
    return rows.groupingSets([["group_type"], ["review_status"], []], "group_type", "review_status").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))


@query(
    """SELECT 'union' AS op, count(*) AS n FROM (SELECT s_nationkey FROM supplier UNION SELECT c_nationkey FROM customer) UNION ALL SELECT 'intersect', count(*) FROM (SELECT s_nationkey FROM supplier INTERSECT SELECT c_nationkey FROM customer)
UNION ALL SELECT 'except', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'union_all', count(*) FROM (SELECT s_nationkey FROM supplier UNION ALL SELECT c_nationkey FROM customer)"""
)
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    named = lambda op, d: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n")
    return named("union", s.union(c).distinct()).unionByName(named("intersect", s.intersect(c))).unionByName(named("except", c.subtract(s))).unionByName(named("union_all", s.union(c)))


@query(
    "SELECT s_suppkey, rank() OVER w AS rnk, dense_rank() OVER w AS dense, CAST(ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS INT) AS quartile, round_even(percent_rank() OVER w, 6) AS pct FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal DESC)"
)
def rank_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"))
    rows = read(spark, sf_dir, "supplier")
    return rows.select("s_suppkey", F.rank().over(w).cast("long").alias("rnk"), F.dense_rank().over(w).cast("long").alias("dense"), F.ntile(4).over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")).alias("quartile"), F.bround(F.percent_rank().over(w), 6).alias("pct"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, CAST(sum((props::JSON ->> 'k')::BIGINT) AS BIGINT) AS sum_k, round_even(median(value), 4) AS median_value FROM events GROUP BY 1")
def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object(F.col("props").cast("string"), "$.k").cast("long")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_users"), F.sum(k).alias("sum_k"), F.bround(F.median("value"), 4).alias("median_value"))


@query()
def approximate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches: distinct users and value quantiles per event type, merged over days."""
    rows = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    daily = rows.groupBy("event_type", "day").agg(F.hll_sketch_agg("user_id").alias("h"), F.kll_sketch_agg_double(F.col("value").cast("double")).alias("q"))
    both = daily.groupBy("event_type").agg(F.hll_union_agg("h").alias("h"), F.kll_merge_agg_double("q").alias("q"))
    return both.select("event_type", F.hll_sketch_estimate("h").alias("n_users"), F.kll_sketch_get_quantile_double("q", F.lit(0.5)).alias("median_value"))


@query("SELECT kind, count(*) FILTER (l = 'ZH-TW') AS \"ZH-TW\", count(*) FILTER (l = 'EN') AS \"EN\", count(*) FILTER (l = 'JA') AS \"JA\" FROM (SELECT kind, upper(replace(lang, '_', '-')) AS l FROM documents WHERE lang IS NOT NULL) GROUP BY kind")
def language_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").where("lang IS NOT NULL").select("kind", F.upper(F.replace("lang", F.lit("_"), F.lit("-"))).alias("l"))
    out = rows.groupBy("kind").pivot("l", ["ZH-TW", "EN", "JA"]).agg(F.count(F.lit(1)))
    return out.fillna(0, ["ZH-TW", "EN", "JA"])


@query("SELECT doc_id, sha256(text) AS digest, length(text) AS n_chars FROM documents WHERE text IS NOT NULL")
def hash_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("digest"), F.length("text").cast("long").alias("n_chars"))


@query(
    with_tables("oc")
    + f"SELECT request_id, array_to_string(list_sort(list_distinct(regexp_extract_all(raw_text, '{tx.CJK}{{2,}}'))), '|') AS words FROM oc WHERE raw_text IS NOT NULL AND role = 'battle_text'"
)
def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_join(F.array_sort(F.array_distinct(tx.cjk_tokens(F.col("raw_text")))), "|")
    return tables.ocr(spark, sf_dir).where("raw_text IS NOT NULL AND role = 'battle_text'").select("request_id", words.alias("words"))


# --- vectors and pictures ----------------------------------------------------


@query(
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.vec_id, round_even(list_cosine_similarity(a.v, b.v), 5) AS cosine, round_even(list_avg(list_transform(list_zip(a.v, b.v), lambda p: abs(p[1] - p[2]))), 5) AS mae,
round_even(list_sum(list_transform(list_zip(a.v, b.v), lambda p: least(p[1], p[2]))), 4) AS overlap FROM e a JOIN e b ON b.vec_id = a.vec_id + 1"""
)
def vector_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")
    v, w = F.col("v"), F.col("w")
    return pairs.select("vec_id", F.bround(sc.cosine(v, w), 5).alias("cosine"), F.bround(sc.array_mae(v, w), 5).alias("mae"), F.bround(sc.histogram_intersection(v, w), 4).alias("overlap"))


@query(
    with_tables("fr")
    + """, l AS (SELECT replay_id, sample_index, frame_hash AS a, lag(frame_hash) OVER (PARTITION BY replay_id ORDER BY sample_index) AS b FROM fr)
SELECT replay_id, sample_index, round_even(1 - list_sum(list_transform(range(0, (length(a) + 11) // 12), lambda i: bit_count(xor(('0x' || a[i * 12 + 1:i * 12 + 12])::BIGINT, ('0x' || b[i * 12 + 1:i * 12 + 12])::BIGINT)))) / (4 * length(a)), 6) AS similarity FROM l WHERE b IS NOT NULL AND length(a) = length(b)"""
)
def frame_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lagged(tables.frames(spark, sf_dir).select("replay_id", "sample_index", "frame_hash"), ["replay_id"], ["sample_index"], F.floor(F.col("sample_index") / 4096), {"b": F.col("frame_hash")})
    rows = rows.where("b IS NOT NULL AND length(frame_hash) = length(b)")
    return rows.select("replay_id", "sample_index", F.bround(sc.hex_hamming(F.col("frame_hash"), F.col("b")), 6).alias("similarity"))


@query(
    with_tables("hp")
    + "SELECT observation_id, round_even(100.0::DOUBLE * bar_measurement.colored_run_px / bar_measurement.row_width_px, 3) AS bar_percent, CASE WHEN bar_measurement.quality >= 0.65 THEN 'usable' ELSE 'poor' END AS grade FROM hp WHERE bar_measurement IS NOT NULL AND bar_measurement.row_width_px > 0"
)
def bar_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = "bar_measurement"
    rows = tables.hp(spark, sf_dir).where(f"{b} IS NOT NULL AND {b}.row_width_px > 0")
    return rows.select("observation_id", F.bround(100.0 * F.col(f"{b}.colored_run_px") / F.col(f"{b}.row_width_px"), 3).alias("bar_percent"), F.when(F.col(f"{b}.quality") >= 0.65, "usable").otherwise("poor").alias("grade"))


@query("SELECT vec_id, CAST(least(greatest(floor(abs(embedding[1]::DOUBLE) * 1920), 0), 1920) AS INT) AS x, CAST(least(greatest(ceil(abs(embedding[2]::DOUBLE) * 1080), 0), 1080) AS INT) AS y FROM embeddings")
def pixel_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.abs(F.col("embedding")[i].cast("double"))
    box = sc.pixel_box(at(0), at(0), at(1), at(1), F.lit(1920), F.lit(1080))
    return read(spark, sf_dir, "embeddings").select("vec_id", box["left"].alias("x"), box["bottom"].alias("y"))


# --- rules and names ---------------------------------------------------------

_CHART = [(a, d, x) for a, d, x in (("Moss", "Tide", 2.0), ("Moss", "Ember", 0.5), ("Tide", "Ember", 2.0), ("Tide", "Moss", 0.5), ("Ember", "Moss", 2.0), ("Ember", "Tide", 0.5), ("Spark", "Tide", 2.0), ("Spark", "Gale", 2.0), ("Frost", "Moss", 2.0), ("Frost", "Gale", 2.0), ("Ore", "Frost", 2.0), ("Gloom", "Gloom", 0.5), ("Venom", "Moss", 2.0), ("Venom", "Venom", 0.5), ("Ore", "Ore", 0.5))]
_CHART_SQL = ", ".join(f"('{a}', '{d}', {x}::DOUBLE)" for a, d, x in _CHART)


@query(
    f"""WITH chart(attack, defence, x) AS (VALUES {_CHART_SQL}), s AS (SELECT entry_id, a.attack AS attack, unnest(types) AS defence FROM match_reference, (SELECT DISTINCT attack FROM chart) a WHERE kind = 'species'),
j AS (SELECT s.*, x FROM s LEFT JOIN chart ON s.attack = chart.attack AND s.defence = chart.defence)
SELECT entry_id, attack, CASE WHEN count(*) = count(x) THEN product(x) END AS multiplier, count(*) = count(x) AS known FROM j GROUP BY 1, 2"""
)
def dim_multiplier_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    chart = spark.createDataFrame(_CHART, "attack string, defence string, x double")
    attacks = F.array(*[F.lit(a) for a in sorted({r[0] for r in _CHART})])
    rows = read(spark, sf_dir, "match_reference").where("kind = 'species'").select(F.col("entry_id"), "types", F.explode(attacks).alias("attack")).withColumn("key", F.struct("entry_id", "attack"))
    return review.multiplier(rows, "key", "attack", "types", chart).select("key.entry_id", "key.attack", "multiplier", "known")


_PATTERNS = [("status.burn", "STATUS", {"status": "灼傷"}), ("status.poison", "STATUS", {"status": "中毒"}), ("damage.status", "DAMAGE_RESULT", {"status": "灼傷"}), ("result.super", "MOVE_RESULT", {"result": "super_effective"}), ("weather.rain", "WEATHER", {"weather": "雨"}), ("switch.any", "SWITCH", {})]


def _matched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rules = spark.createDataFrame(_PATTERNS, "rule string, kind string, pattern map<string,string>")
    return rules, review.matching_rules(narration(spark, sf_dir).drop("rule"), "kind", "fields", rules)


_MATCH_SQL = " UNION ALL ".join(f"SELECT '{r}' AS rule, id FROM e0 WHERE kind = '{k}'" + "".join(f" AND {f} = '{v}'" for f, v in p.items()) for r, k, p in _PATTERNS)


@query(_EVENTS + f", m AS ({_MATCH_SQL}), r(rule) AS (VALUES {', '.join(f'({r[0]!r})' for r in _PATTERNS)}) SELECT r.rule, count(id) AS n_facts, min(id) AS first_fact FROM r LEFT JOIN m ON r.rule = m.rule GROUP BY 1")
def rule_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, matched = _matched(spark, sf_dir)
    return review.rule_coverage(rules, matched, "rule", "event_id")


@query(
    with_tables("hp")
    + """, a AS (SELECT DISTINCT entry_id, lower(regexp_replace(unnest([zh_tw, en, showdown_id]), '[^\\p{L}\\p{N}]', '', 'g')) AS alias FROM match_reference WHERE kind = 'species'),
q AS (SELECT observation_id, lower(regexp_replace(identity_text, '[^\\p{L}\\p{N}]', '', 'g')) AS alias FROM hp WHERE identity_text IS NOT NULL)
SELECT observation_id, CASE count(entry_id) WHEN 0 THEN 'unresolved' WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS status, CASE WHEN count(entry_id) = 1 THEN min(entry_id)::DOUBLE END AS entry_id FROM q LEFT JOIN a ON q.alias = a.alias GROUP BY 1"""
)
def resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    aliases = read(spark, sf_dir, "match_reference").where("kind = 'species'").select(F.col("kind").alias("block"), "entry_id", F.explode(F.array("zh_tw", "en", "showdown_id")).alias("n")).select("block", "entry_id", key("n").alias("alias"))
    asks = tables.hp(spark, sf_dir).where("identity_text IS NOT NULL").select("observation_id", key("identity_text").alias("name"), F.lit("species").alias("block"))
    return review.resolve_names(asks, "observation_id", "name", "block", aliases).select("observation_id", "status", F.col("entry_id").cast("double").alias("entry_id"))


@query(
    _EVENTS.replace("WITH oc", "WITH " + with_tables("ev", "gr")[5:].strip() + ", oc", 1)
    + """, u AS (SELECT replay_id, id AS source, a AS t, 0 AS priority, kind AS fact FROM (SELECT e AS replay_id, id, a, kind FROM e0) UNION ALL SELECT replay_id, event_id, start_time, 1, type FROM ev UNION ALL SELECT replay_id, timeline_id, start_time, 2, group_type FROM gr),
n AS (SELECT *, row_number() OVER (PARTITION BY replay_id ORDER BY t, priority, source) AS sequence FROM u)
SELECT replay_id, source, fact, sequence, replay_id || ':fact-' || lpad(CAST(sequence AS VARCHAR), 6, '0') AS fact_id FROM n"""
)
def union_number_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = narration(spark, sf_dir).select("replay_id", F.col("event_id").alias("source"), F.col("start").alias("t"), F.lit(0).alias("priority"), F.col("kind").alias("fact"))
    seen = tables.events(spark, sf_dir).select("replay_id", F.col("event_id").alias("source"), F.col("start_time").alias("t"), F.lit(1).alias("priority"), F.col("type").alias("fact"))
    made = tables.groups(spark, sf_dir).select("replay_id", F.col("timeline_id").alias("source"), F.col("start_time").alias("t"), F.lit(2).alias("priority"), F.col("group_type").alias("fact"))
    return review.numbered_facts([said, seen, made], "replay_id", "t", "priority", "source", "fact").select("replay_id", "source", "fact", "sequence", "fact_id")


@query(
    with_tables("gr", "ev")
    + ", l AS (SELECT timeline_id, unnest(event_ids) AS event_id FROM gr) SELECT l.event_id, count(*) AS n_groups, min(timeline_id) AS first_group, min(type) AS type FROM l JOIN ev USING (event_id) GROUP BY 1"
)
def event_group_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = tables.groups(spark, sf_dir).select("timeline_id", F.explode("event_ids").alias("event_id"))
    rows = links.join(tables.events(spark, sf_dir).select("event_id", "type"), "event_id")
    return rows.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_groups"), F.min("timeline_id").alias("first_group"), F.min("type").alias("type"))


@query(
    with_tables("oc")
    + f""", c AS (SELECT request_id, raw_text AS x, confidence, length(regexp_replace(raw_text, '{tx.NOT_CJK}', '', 'g')) AS k, len(list_filter(string_split(raw_text, chr(10)), lambda y: trim(y) <> '')) AS l FROM oc WHERE role = 'battle_text')
SELECT request_id, CASE WHEN x IS NULL OR trim(x) = '' THEN 'NO_TEXT' WHEN k >= 2 AND l <= 3 AND confidence >= 0.65 THEN 'VALID_TEXT' ELSE 'UNCERTAIN' END AS label,
CASE WHEN x IS NULL OR trim(x) = '' THEN 'empty' ELSE array_to_string(list_filter([CASE WHEN k < 2 THEN 'too_few_characters' END, CASE WHEN l > 3 THEN 'too_many_lines' END, CASE WHEN confidence < 0.65 THEN 'low_confidence' END], lambda r: r IS NOT NULL), '|') END AS reasons FROM c"""
)
def acceptance_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.ocr(spark, sf_dir).where("role = 'battle_text'")
    return review.validation(rows, "raw_text", "confidence", F.lit(1.0)).select("request_id", "label", F.array_join("reasons", "|").alias("reasons"))


@query(with_tables("gr") + "SELECT timeline_id, CASE review_status WHEN 'auto_accepted' THEN 'applied' WHEN 'rejected' THEN 'stale' ELSE 'undecided' END AS outcome, CASE review_status WHEN 'auto_accepted' THEN 'accepted' END AS decision FROM gr")
def review_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on groups: those made for another digest than the group's are stale."""
    frozen = ["replay_id", "start_time", "end_time", "group_type"]
    rows = tables.groups(spark, sf_dir)
    digest = F.when(F.col("review_status") == "rejected", F.lit("other")).otherwise(review.row_digest(frozen))
    decisions = rows.where("review_status <> 'needs_review'").select("timeline_id", digest.alias("seen"), F.lit("accepted").alias("verdict"), F.lit(1).alias("decided_at"))
    return review.apply_decisions(rows, decisions, "timeline_id", frozen, "seen", "verdict").select("timeline_id", "outcome", "decision")


_STATUSES = ["auto_accepted", "needs_review", "rejected", "unlinked"]


@query(with_tables("gr") + f", k AS (SELECT unnest({_STATUSES}) AS review_status) SELECT k.review_status, count(timeline_id) AS n FROM k LEFT JOIN gr USING (review_status) GROUP BY 1")
def fixed_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.fixed_counts(tables.groups(spark, sf_dir), "review_status", _STATUSES)


# --- quality -----------------------------------------------------------------


@query(
    """SELECT 'event_id repeated' AS "check", count(*) AS violations FROM (SELECT event_id FROM event_candidates GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'end before start', count(*) FROM event_candidates WHERE NOT (end_time >= start_time)
UNION ALL SELECT 'group of unknown event', count(*) FROM (SELECT timeline_id, unnest(event_ids) AS ref FROM timeline_groups) WHERE ref NOT IN (SELECT event_id FROM event_candidates)
UNION ALL SELECT 'order without customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'sample out of order', count(*) FROM (SELECT t, lag(t) OVER (PARTITION BY replay_id ORDER BY sample_index) AS was FROM (SELECT DISTINCT ON (replay_id, sample_index) replay_id, sample_index, coalesce(pts, target_time) AS t FROM sample_plan)) WHERE t < was
UNION ALL SELECT 'percent out of range', count(*) FROM hp_observations WHERE hp_percent IS NOT NULL AND NOT isnan(hp_percent) AND NOT (hp_percent BETWEEN 0 AND 100)"""
)
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev, gr, hp = (read(spark, sf_dir, t) for t in ("event_candidates", "timeline_groups", "hp_observations"))
    return quality.report(
        {
            "event_id repeated": quality.unique(ev, ["event_id"]),
            "end before start": quality.broken(ev, F.col("end_time") >= F.col("start_time")),
            "group of unknown event": quality.array_orphans(gr, "timeline_id", "event_ids", ev, "event_id"),
            "order without customer": quality.orphans(read(spark, sf_dir, "orders"), "o_custkey", read(spark, sf_dir, "customer"), "c_custkey"),
            "sample out of order": quality.not_ascending(tables.plan(spark, sf_dir), ["replay_id"], "sample_index", "t"),
            "percent out of range": quality.broken(hp.where("NOT isnan(hp_percent)"), F.col("hp_percent").between(0, 100)),
        }
    )


@query(with_tables("gr") + "SELECT timeline_id, CASE review_status WHEN 'auto_accepted' THEN 'kept' WHEN 'needs_review' THEN 'changed' ELSE 'added' END AS fate FROM gr")
def additive_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = tables.groups(spark, sf_dir).select("timeline_id", "replay_id", "start_time", "confidence", "review_status")
    old = new.where("review_status <> 'rejected'").withColumn("confidence", F.when(F.col("review_status") == "needs_review", -1.0).otherwise(F.col("confidence")))
    return quality.additive(old, new, "timeline_id")


# --- streams -----------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table as a stream; the path is a pattern, as the file source takes a plain path for a folder."""
    return spark.readStream.schema(read(spark, sf_dir, table).schema).parquet(f"{sf_dir}/{table}.parque[t]")


def _drain(df: DataFrame) -> DataFrame:
    """A finite stream written to the shared folder, and read again; the query's log goes when it has ended."""
    spark = df.sparkSession
    where = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = df.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    log = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{where}/log")
    log.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(log, True)
    return spark.read.schema(df.schema).parquet(f"{where}/out")


@query("SELECT type, count(DISTINCT event_id) AS n FROM event_candidates GROUP BY 1")
def stream_deliver_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams.deliver_once(_stream(spark, sf_dir, "event_candidates").select("event_id", "type", "ingested_at"), "event_id", "ingested_at", "30 days")
    return _drain(rows.select("type", "event_id")).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH w AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, CAST(day AS VARCHAR) AS day, n FROM w WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"
)
def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts that the watermark has closed."""
    rows = _stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return _drain(streams.windowed_counts(rows, "ts", "event_type", "1 day", "1 hour")).select("event_type", F.to_date("start").cast("string").alias("day"), "n")


@query()
def stream_dead_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dead band as a stream; equal to the batch query (tested)."""
    rows = streams.deliver_once(_stream(spark, sf_dir, "hp_observations"), "observation_id", "ingested_at", "30 days")
    hp = F.when(F.col("hp_percent").between(0, 100) & ~F.isnan("hp_percent"), F.col("hp_percent"))
    rows = rows.withColumns({"hp": hp, "exact": F.col("value_type") != "visual_bar_estimate"}).select("replay_id", "side", "slot", "timestamp", "observation_id", "identity_text", "status", "hp", "exact")
    return _drain(streams.stream_dead_band(rows, ["replay_id", "side", "slot"], "timestamp", ["observation_id", "identity_text", "status", "hp", "exact"]))
