"""Queries of features, selection, coverage and overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions import scores as sc
from tracefold.functions import text as tx
from tracefold.operators import selection, temporal, voting, windows
from tracefold.operators.sequence import lagged
from tracefold.plans import tables
from tracefold.plans.event_queries import _EVENTS, narration
from tracefold.plans.fixed_values import FACT_TYPES, VARIANT_WEIGHTS
from tracefold.plans.tables import with_tables
from tracefold.plans.time_queries import _BY_HP, _HP, _WIN, SOURCE, _windows
from tracefold.session import read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(
    """WITH p AS (SELECT DISTINCT ON (replay_id, sample_index) replay_id, sample_index, pts FROM sample_plan),
l AS (SELECT *, lag(pts) OVER (PARTITION BY replay_id ORDER BY sample_index) AS was FROM p WHERE pts IS NOT NULL),
a AS (SELECT replay_id, count(*) AS n, count(*) - count(pts) AS n_missing FROM p GROUP BY 1),
b AS (SELECT replay_id, count(*) FILTER (pts = was) AS n_repeated, count(*) FILTER (pts < was) AS n_backward, round_even(max(pts - was), 6) AS longest_step FROM l GROUP BY 1)
SELECT a.*, coalesce(n_repeated, 0) AS n_repeated, coalesce(n_backward, 0) AS n_backward, longest_step FROM a LEFT JOIN b USING (replay_id)"""
)
def pts_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "sample_plan").dropDuplicates(["replay_id", "sample_index"]).select("replay_id", "sample_index", "pts")
    steps = lagged(rows.where("pts IS NOT NULL"), ["replay_id"], ["sample_index"], F.floor(F.col("sample_index") / 4096), {"was": F.col("pts")})
    b = steps.groupBy("replay_id").agg(F.count_if(F.col("pts") == F.col("was")).alias("n_repeated"), F.count_if(F.col("pts") < F.col("was")).alias("n_backward"), F.bround(F.max(F.col("pts") - F.col("was")), 6).alias("longest_step"))
    a = rows.groupBy("replay_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pts").isNull()).alias("n_missing"))
    return a.join(b, "replay_id", "left").fillna(0, ["n_repeated", "n_backward"])


def _bins(v: str) -> str:
    return f"list_transform(range(0, 8), lambda i: len(list_filter({v}, lambda z: least(7, greatest(0, CAST(floor((z + 1) / 2 * 8) AS INT))) = i)) / len({v}))"


@query(
    f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id, a.v AS v, b.v AS w FROM e a JOIN e b ON b.vec_id = a.vec_id + 1),
c AS (SELECT *, list_transform(v, lambda x: x - list_avg(v)) AS cv, list_transform(w, lambda x: x - list_avg(w)) AS cw, list_transform(list_zip(v[:-2], v[2:]), lambda p: abs(p[1] - p[2])) AS ev, list_transform(list_zip(w[:-2], w[2:]), lambda p: abs(p[1] - p[2])) AS ew, {_bins('v')} AS hv, {_bins('w')} AS hw FROM p),
d AS (SELECT *, 1 - list_avg(list_transform(list_zip(v, w), lambda p: abs(p[1] - p[2]))) / 2 AS near, 1 - list_avg(list_transform(list_zip(ev, ew), lambda p: abs(p[1] - p[2]))) / 2 AS edges, list_sum(list_transform(list_zip(hv, hw), lambda p: least(p[1], p[2]))) AS hist FROM c)
SELECT vec_id, round_even(least(1, greatest(0, 0.50::DOUBLE * near + 0.25::DOUBLE * ((list_cosine_similarity(cv, cw) + 1) / 2) + 0.15::DOUBLE * edges + 0.10::DOUBLE * hist)), 5) AS similarity FROM d"""
)
def appearance_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring vectors as pictures of values from -1 to 1."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    e = e.withColumns({"ev": sc.steps(F.col("v")), "hv": sc.histogram(F.col("v"), -1.0, 1.0, 8)})
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"), F.col("ev").alias("ew"), F.col("hv").alias("hw")), "vec_id")
    mixed = sc.appearance(F.col("v"), F.col("w"), F.col("ev"), F.col("ew"), F.col("hv"), F.col("hw"), 2.0)
    return pairs.select("vec_id", F.bround(mixed, 5).alias("similarity"))


@query(
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM e),
m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL), t AS (SELECT label, list(m ORDER BY i) AS w FROM m GROUP BY 1),
s AS (SELECT vec_id, t.label AS label, list_cosine_similarity(v, w) AS s FROM e, t), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS r FROM s)
SELECT vec_id, label, round_even(s, 5) AS score FROM r WHERE r = 1"""
)
def template_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    best = selection.best_template(e.drop("label"), "vec_id", "v", selection.class_templates(e, "label", "v"))
    return best.select("vec_id", "label", F.bround("score", 5).alias("score"))


@query(
    with_tables("fr")
    + """SELECT replay_id, sample_index, CASE WHEN b IS NULL THEN 'negative' WHEN b.strong_positive THEN 'strong' WHEN b.template_similarity >= 0.72 AND b.component_count >= 4 THEN 'weak' ELSE 'negative' END AS proposal
FROM (SELECT replay_id, sample_index, battle_text_evidence AS b FROM fr)"""
)
def text_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = "battle_text_evidence"
    weak = (F.col(f"{b}.template_similarity") >= 0.72) & (F.col(f"{b}.component_count") >= 4)
    level = F.when(F.col(b).isNull(), "negative").when(F.col(f"{b}.strong_positive"), "strong").when(weak, "weak").otherwise("negative")
    return tables.frames(spark, sf_dir).select("replay_id", "sample_index", level.alias("proposal"))


_KEYS = ("TEAM_PREVIEW", "SELECTED_FOUR", "MOVE_MENU", "BATTLE_TEXT", "TRIGGER_NOTIFICATION", "RESULT")


@query(
    with_tables("fr")
    + f""", v AS (SELECT replay_id, sample_index, frame_hash AS h, [{", ".join(f"candidate_scores['{k}']" for k in _KEYS)}] AS s FROM fr WHERE candidate_scores IS NOT NULL),
l AS (SELECT *, lag(h) OVER w AS g, lag(s) OVER w AS r FROM v WINDOW w AS (PARTITION BY replay_id ORDER BY sample_index)),
b AS (SELECT *, list_sum(list_transform(range(0, (length(h) + 11) // 12), lambda i: bit_count(xor(('0x' || h[i * 12 + 1:i * 12 + 12])::BIGINT, ('0x' || g[i * 12 + 1:i * 12 + 12])::BIGINT)))) AS bits FROM l WHERE g IS NOT NULL)
SELECT replay_id, sample_index, round_even(0.7::DOUBLE * (1 - bits / (4 * length(h))) + 0.3::DOUBLE * (list_sum(list_transform(list_zip(s, r), lambda p: least(p[1], p[2]))) / list_sum(s)), 10) AS similarity FROM b"""
)
def fingerprint_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of the hash and overlap of the score profile, weighted."""
    scores = F.array(*[F.col("candidate_scores")[k] for k in _KEYS])
    rows = tables.frames(spark, sf_dir).where("candidate_scores IS NOT NULL").select("replay_id", "sample_index", F.col("frame_hash").alias("h"), scores.alias("s"))
    near = lagged(rows, ["replay_id"], ["sample_index"], F.floor(F.col("sample_index") / 4096), {"g": F.col("h"), "r": F.col("s")}).where("g IS NOT NULL")
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x)
    overlap = sc.histogram_intersection(F.col("s"), F.col("r")) / total
    return near.select("replay_id", "sample_index", F.bround(sc.weighted([(0.7, sc.hex_hamming(F.col("h"), F.col("g"))), (0.3, overlap)]), 10).alias("similarity"))


@query(
    with_tables("oc")
    + f""", l AS (SELECT request_id, generate_subscripts(lines, 1) AS i, unnest(lines) AS l FROM oc WHERE lines IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY l.confidence DESC, i) AS r FROM l WHERE regexp_full_match(l.text, '{tx.CJK}{{2,8}}'))
SELECT request_id, l.text AS name, l.confidence AS confidence FROM r WHERE r = 1"""
)
def best_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a request's lines the surest that is one short CJK word; ties to the first."""
    short = F.filter("lines", lambda x: x["text"].rlike(f"^{tx.CJK}{{2,8}}$"))
    ranked = F.transform(short, lambda x, i: F.struct((-x["confidence"]).alias("c"), i.alias("i"), x["text"].alias("t")))
    return tables.ocr(spark, sf_dir).withColumn("_b", F.array_min(ranked)).where("_b IS NOT NULL").select("request_id", F.col("_b.t").alias("name"), (-F.col("_b.c")).alias("confidence"))


@query(
    with_tables("gr")
    + ", x AS (SELECT unnest(event_ids) AS event_id, review_status FROM gr) SELECT event_id, count(*) AS n, CASE WHEN bool_or(review_status = 'rejected') THEN 'rejected' WHEN bool_or(review_status = 'needs_review') THEN 'undecided' ELSE 'accepted' END AS policy FROM x GROUP BY 1"
)
def relation_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = tables.groups(spark, sf_dir).select(F.explode("event_ids").alias("event_id"), "review_status")
    by = ends.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("review_status") == "rejected").cast("int")).alias("r"), F.max((F.col("review_status") == "needs_review").cast("int")).alias("u"))
    return by.select("event_id", "n", F.when(F.col("r") == 1, "rejected").when(F.col("u") == 1, "undecided").otherwise("accepted").alias("policy"))


@query(
    with_tables("ev", "fr")
    + ", t AS (SELECT replay_id, event_id, start_time FROM ev WHERE type = 'RESULT') SELECT fr.replay_id, sample_index, count(*) AS n_targets, min(event_id) AS first_target FROM fr JOIN t ON t.replay_id = fr.replay_id AND abs(pts - start_time) <= 1 GROUP BY ALL"
)
def dense_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples within a second of a target."""
    marks = tables.events(spark, sf_dir).where("type = 'RESULT'").select("replay_id", "event_id", "start_time")
    near = F.explode(F.array(*[F.floor(F.col("start_time")) + d for d in (-1, 0, 1)])).alias("sec")
    rows = tables.frames(spark, sf_dir).select("replay_id", "sample_index", "pts", F.floor("pts").alias("sec"))
    hits = rows.join(marks.select("replay_id", "event_id", "start_time", near), ["replay_id", "sec"]).where("abs(pts - start_time) <= 1")
    return hits.groupBy("replay_id", "sample_index").agg(F.count(F.lit(1)).alias("n_targets"), F.min("event_id").alias("first_target"))


@query(with_tables("ev") + "SELECT type, count(*) AS n, round_even(avg(duration_sec), 4) AS mean_duration, round_even(median(duration_sec), 4) AS median_duration, count(*) FILTER (duration_sec < 0.5) AS n_short, count(*) FILTER (duration_sec > 5) AS n_long FROM ev GROUP BY 1")
def candidate_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("duration_sec")
    return tables.events(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg(d), 4).alias("mean_duration"), F.bround(F.median(d), 4).alias("median_duration"), F.count_if(d < 0.5).alias("n_short"), F.count_if(d > 5).alias("n_long"))


@query(
    with_tables("pl", "ev")
    + """, b AS (SELECT replay_id, min(t) AS a, max(t) AS z FROM pl GROUP BY 1), g AS (SELECT replay_id, a, unnest(range(0, CAST(floor((z - a + 1e-9) / 5.0) AS BIGINT) + 1)) AS k FROM b),
q AS (SELECT replay_id, k, a + k * 5.0::DOUBLE AS t FROM g) SELECT q.replay_id, k, count(event_id) AS n_events, min(event_id) AS first_event FROM q LEFT JOIN ev ON ev.replay_id = q.replay_id AND q.t BETWEEN start_time AND end_time GROUP BY ALL"""
)
def coverage_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample every five seconds with the candidates that cover it."""
    asks = temporal.targets(tables.plan(spark, sf_dir), ["replay_id"], "t", 5.0)
    points = asks.select("replay_id", F.col("tick").alias("k"), F.col("target").alias("s"), F.col("target").alias("e"))
    spans = tables.events(spark, sf_dir).select("replay_id", "event_id", "start_time", "end_time")
    hits = temporal.interval_join(points, spans, ["replay_id"], ("s", "e"), ("start_time", "end_time"))
    counts = hits.groupBy("replay_id", F.col("_left.k").alias("k")).agg(F.count(F.lit(1)).alias("n_events"), F.min("_right.event_id").alias("first_event"))
    return asks.select("replay_id", F.col("tick").alias("k")).join(counts, ["replay_id", "k"], "left").fillna(0, ["n_events"])


@query(
    with_tables("fr")
    + """, e AS (SELECT replay_id, sample_index AS p, battle_text_evidence.template_similarity AS x, battle_text_evidence.evidence_level = 'strong' AS hit FROM fr WHERE battle_text_evidence IS NOT NULL),
h AS (SELECT replay_id, p, p - row_number() OVER (PARTITION BY replay_id ORDER BY p) AS g FROM e WHERE hit), r AS (SELECT replay_id, max(n) AS longest FROM (SELECT replay_id, g, count(*) AS n FROM h GROUP BY ALL) GROUP BY 1)
SELECT e.replay_id, min(x) AS least, round_even(median(x), 6) AS middle, max(x) AS most, count(*) FILTER (hit) AS n_strong, coalesce(any_value(longest), 0) AS longest_run FROM e LEFT JOIN r USING (replay_id) GROUP BY 1"""
)
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range of a score and the longest run of strong samples, per replay."""
    b = "battle_text_evidence"
    rows = tables.frames(spark, sf_dir).where(f"{b} IS NOT NULL").select("replay_id", "sample_index", F.col(f"{b}.template_similarity").alias("x"), (F.col(f"{b}.evidence_level") == "strong").alias("hit"))
    runs = temporal.islands(rows.where("hit"), ["replay_id"], "sample_index", 1).groupBy("replay_id", "island").agg(F.count(F.lit(1)).alias("n"))
    longest = runs.groupBy("replay_id").agg(F.max("n").alias("longest_run"))
    stats = rows.groupBy("replay_id").agg(F.min("x").alias("least"), F.bround(F.median("x"), 6).alias("middle"), F.max("x").alias("most"), F.count_if("hit").alias("n_strong"))
    return stats.join(longest, "replay_id", "left").fillna(0, ["longest_run"])


_FIELDS = ("hp_percent", "species_id", "identity_text", "status", "current_hp", "max_hp")


@query(with_tables("hp") + "SELECT value_type, count(*) AS n, " + ", ".join(f"count({f}) AS n_{f}" for f in _FIELDS) + " FROM hp GROUP BY 1")
def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.hp(spark, sf_dir).groupBy("value_type").agg(F.count(F.lit(1)).alias("n"), *[F.count(f).alias(f"n_{f}") for f in _FIELDS])


@query(
    with_tables("hp")
    + """, u AS (SELECT unnest([CASE WHEN hp_percent IS NULL THEN 'hp_percent' END, CASE WHEN species_id IS NULL THEN 'species_id' END, CASE WHEN identity_text IS NULL THEN 'identity_text' END,
CASE WHEN bar_measurement.quality IS NULL THEN 'bar_measurement.quality' END]) AS path FROM hp) SELECT path, count(*) AS n FROM u WHERE path IS NOT NULL GROUP BY 1"""
)
def unknown_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = {"hp_percent", "species_id", "identity_text", "bar_measurement.quality"}
    rows = tables.hp(spark, sf_dir)
    paths = [p for p in selection.null_paths(rows) if p in wanted]
    empty = F.array_compact(F.array(*[F.when(F.col(p).isNull(), p) for p in paths]))
    return rows.select(F.explode(empty).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


# weights of the fields in a reading's completeness
_WEIGHTS = {"hp": 0.4, "species_id": 0.2, "identity_text": 0.2, "status": 0.1, "max_hp": 0.1}


@query(with_tables("hp") + "SELECT replay_id, side, slot, round_even(avg(" + " + ".join(f"CASE WHEN {f} IS NOT NULL THEN {w}::DOUBLE ELSE 0 END" for f, w in _WEIGHTS.items()) + "), 10) AS completeness, round_even(avg(confidence) FILTER (confidence > 0), 10) AS confidence FROM hp GROUP BY ALL")
def state_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = sc.weighted([(w, F.col(f).isNotNull().cast("double")) for f, w in _WEIGHTS.items()])
    return tables.hp(spark, sf_dir).groupBy(*SOURCE).agg(F.bround(F.avg(share), 10).alias("completeness"), F.bround(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), 10).alias("confidence"))


@query(
    """WITH d AS (SELECT replay_id, event_id, bool_or(NOT (end_time >= start_time)) AS bad, bool_or(start_time IS NULL OR end_time IS NULL) AS open FROM event_candidates GROUP BY ALL),
a AS (SELECT replay_id, bool_or(coalesce(bad, false)) AS bad, bool_or(open) AS open FROM d GROUP BY 1), g AS (SELECT replay_id, bool_or(review_status = 'needs_review') AS review FROM timeline_groups GROUP BY 1)
SELECT a.replay_id, CASE WHEN bad THEN 'invalid' WHEN open THEN 'incomplete' WHEN coalesce(review, false) THEN 'review' ELSE 'ready' END AS status FROM a LEFT JOIN g USING (replay_id)"""
)
def status_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev, gr = read(spark, sf_dir, "event_candidates"), read(spark, sf_dir, "timeline_groups")
    a = ev.groupBy("replay_id").agg(F.bool_or(F.coalesce(F.col("end_time") < F.col("start_time"), F.lit(False))).alias("bad"), F.bool_or(F.col("start_time").isNull() | F.col("end_time").isNull()).alias("open"))
    g = gr.groupBy("replay_id").agg(F.bool_or(F.col("review_status") == "needs_review").alias("review"))
    status = F.when(F.col("bad"), "invalid").when(F.col("open"), "incomplete").when(F.coalesce("review", F.lit(False)), "review").otherwise("ready")
    return a.join(g, "replay_id", "left").select("replay_id", status.alias("status"))


@query(
    with_tables("ev", "fr")
    + """, t AS (SELECT * FROM ev WHERE type = 'BATTLE_TEXT'), j AS (SELECT t.event_id, sample_index AS p, coalesce(candidate_scores['BATTLE_TEXT'], '-inf'::DOUBLE) AS x FROM t JOIN fr ON t.replay_id = fr.replay_id AND pts BETWEEN start_time AND end_time)
SELECT event_id, min(p) AS first_pos, max(p) AS last_pos, arg_min(p, struct_pack(x := -x, p := p)) AS peak_pos, count(*) AS n FROM j GROUP BY 1"""
)
def interval_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.frames(spark, sf_dir).withColumn("x", F.col("candidate_scores")["BATTLE_TEXT"])
    return selection.interval_frames(tables.events(spark, sf_dir).where("type = 'BATTLE_TEXT'"), rows, ["replay_id"], ("start_time", "end_time"), "event_id", "pts", "sample_index", "x")


@query(
    with_tables("oc")
    + """, q AS (SELECT request_id, regexp_replace(raw_text, '[ \\t\\r\\n]+', '', 'g') AS x FROM oc WHERE role = 'move_menu' AND raw_text IS NOT NULL), n AS (SELECT entry_id, zh_tw FROM match_reference WHERE kind = 'move'),
r AS (SELECT request_id, entry_id, length(zh_tw) AS l, row_number() OVER (PARTITION BY request_id ORDER BY length(zh_tw) DESC, entry_id) AS r FROM q JOIN n ON starts_with(x, zh_tw)) SELECT request_id, entry_id, CAST(l AS INT) AS length FROM r WHERE r = 1"""
)
def longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    asks = tables.ocr(spark, sf_dir).where("role = 'move_menu' AND raw_text IS NOT NULL").select("request_id", F.regexp_replace("raw_text", r"[ \t\r\n]+", "").alias("x"))
    names = read(spark, sf_dir, "match_reference").where("kind = 'move'").select("entry_id", "zh_tw")
    return selection.longest_prefix(asks, "request_id", "x", names, "zh_tw", "entry_id")


@query()
def greedy_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of a replay's sides assigned to species by summed confidence, each once; tested against its step."""
    rows = tables.hp(spark, sf_dir).where("species_id IS NOT NULL").groupBy("replay_id", "side", "track_id", "species_id").agg(F.bround(F.sum("confidence"), 6).alias("s"))
    return selection.greedy_assignment(rows, ["replay_id", "side"], "track_id", "species_id", "s")


@query(
    with_tables("ev")
    + ", r AS (SELECT *, row_number() OVER (PARTITION BY replay_id, type ORDER BY start_time, event_id) AS r FROM ev) SELECT replay_id, type, event_id, confidence FROM r WHERE r = 1"
)
def first_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.events(spark, sf_dir).select("replay_id", "type", "start_time", "event_id", "confidence")
    return selection.first_by_key(rows, ["replay_id", "type"], ["start_time", "event_id"]).select("replay_id", "type", "event_id", "confidence")


@query(
    _HP
    + f""", l AS (SELECT *, lag(hp) OVER w AS b, lag(timestamp) OVER w AS bt FROM hp WHERE hp IS NOT NULL WINDOW w AS {_BY_HP}),
c AS (SELECT observation_id, replay_id, (timestamp + bt) / 2 AS m FROM l WHERE abs(hp - b) >= 8 AND timestamp - bt <= 3), g AS (SELECT DISTINCT ON (timeline_id) * FROM timeline_groups WHERE {tables.ENDS})
SELECT observation_id, count(timeline_id) AS n_groups, min(timeline_id) AS first_group FROM c JOIN g ON g.replay_id = c.replay_id AND m + 2 >= start_time AND m - 2 <= end_time GROUP BY 1"""
)
def change_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of eight points or more with the groups within two seconds of their middle."""
    rows = windows.changes(tables.hp(spark, sf_dir), SOURCE, "timestamp", "frame_ordinal", "hp", 8.0, 3.0)
    middle = (F.col("timestamp") + F.col("before_time")) / 2
    points = rows.select("replay_id", "observation_id", middle.alias("s"), middle.alias("e"))
    spans = tables.groups(spark, sf_dir).select("replay_id", "timeline_id", "start_time", "end_time")
    hits = temporal.interval_join(points, spans, ["replay_id"], ("s", "e"), ("start_time", "end_time"), slack=2.0)
    return hits.groupBy("_left.observation_id").agg(F.count(F.lit(1)).alias("n_groups"), F.min("_right.timeline_id").alias("first_group"))


@query(
    with_tables("gr", "hp")
    + """, o AS (SELECT replay_id, side, slot, timestamp AS t, max(hp) AS hp FROM hp WHERE hp IS NOT NULL GROUP BY ALL),
q AS (SELECT gr.replay_id, timeline_id, start_time, side, slot FROM gr, (VALUES ('player', 'left'), ('player', 'right'), ('opponent', 'left'), ('opponent', 'right')) x(side, slot)),
s AS (SELECT q.*, o.hp AS hp FROM q ASOF LEFT JOIN o ON q.replay_id = o.replay_id AND q.side = o.side AND q.slot = o.slot AND q.start_time >= o.t),
d AS (SELECT *, lag(hp) OVER (PARTITION BY replay_id, side, slot ORDER BY start_time, timeline_id) AS was FROM s) SELECT timeline_id, side, slot, was, hp FROM d WHERE hp IS DISTINCT FROM was"""
)
def snapshot_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups at which the last reading of a slot, on either side, differs from that at the group before."""
    slots = F.array(*[F.struct(F.lit(a).alias("side"), F.lit(b).alias("slot")) for a in ("player", "opponent") for b in ("left", "right")])
    asks = tables.groups(spark, sf_dir).select("timeline_id", "replay_id", "start_time", F.explode(slots).alias("x")).select("timeline_id", "replay_id", "start_time", "x.*")
    shots = temporal.asof_latest(asks, tables.hp(spark, sf_dir).where("hp IS NOT NULL"), SOURCE, "start_time", "timestamp", ["hp"])
    shots = shots.select(*SOURCE, "timeline_id", "start_time", F.col("latest.hp").alias("hp"))
    rows = lagged(shots, SOURCE, ["start_time", "timeline_id"], F.floor(F.col("start_time") / 600), {"was": F.col("hp")})
    return rows.where(~F.col("hp").eqNullSafe(F.col("was"))).select("timeline_id", "side", "slot", "was", "hp")


@query(
    with_tables("fr", "ev", "pl")
    + """, a AS (SELECT replay_id, event_id, type, start_time, end_time, coalesce(visible_rois, [lower(type)]) AS shown FROM ev),
r AS (SELECT *, CASE WHEN type = 'TRIGGER_NOTIFICATION' THEN shown || list_transform(list_filter(shown, lambda x: x IN ('player_trigger_notification', 'opponent_trigger_notification')), lambda x: x || '_analysis_context') ELSE shown END AS rois FROM a),
h AS (SELECT r.replay_id, event_id, rois, sample_index, coalesce(candidate_scores[type], CAST('-inf' AS DOUBLE)) AS x FROM r JOIN fr ON fr.replay_id = r.replay_id AND pts BETWEEN start_time AND end_time),
g AS (SELECT replay_id, event_id, any_value(rois) AS rois, [min(sample_index), max(sample_index), arg_max(sample_index, struct_pack(x := x, o := -sample_index))] AS places FROM h GROUP BY 1, 2),
k AS (SELECT replay_id, rois, unnest(places) AS sample_index FROM g),
f AS (SELECT replay_id, pts, max(sample_index) AS sample_index FROM fr WHERE pts IS NOT NULL GROUP BY ALL),
b AS (SELECT replay_id, min(t) AS lo, max(t) AS hi FROM pl GROUP BY 1),
w AS (SELECT replay_id, lo + unnest(range(0, CAST(floor((hi - lo + 1e-9) / 5.0) AS BIGINT) + 1)) * 5.0::DOUBLE AS t, ['battle_text'] AS rois FROM b
  UNION ALL SELECT replay_id, unnest([start_time, end_time]), rois FROM r WHERE event_id NOT IN (SELECT event_id FROM h)),
m AS (SELECT w.*, f.pts AS p0, f.sample_index AS s0 FROM w ASOF LEFT JOIN f ON w.replay_id = f.replay_id AND w.t >= f.pts),
n AS (SELECT m.*, f.pts AS p1, f.sample_index AS s1 FROM m ASOF LEFT JOIN f ON m.replay_id = f.replay_id AND m.t <= f.pts),
z AS (SELECT replay_id, sample_index, rois FROM k
  UNION ALL SELECT replay_id, CASE WHEN p1 IS NULL OR t - p0 <= p1 - t THEN s0 ELSE s1 END, rois FROM n
  UNION ALL SELECT fr.replay_id, fr.sample_index, ['battle_text'] FROM fr JOIN ev ON ev.replay_id = fr.replay_id AND ev.type = 'RESULT' AND abs(fr.pts - ev.start_time) <= 1
  UNION ALL SELECT replay_id, sample_index, visible_rois FROM fr WHERE regexp_replace(upper(regexp_replace(ui_state, '^[\\s\\-_]+|[\\s\\-_]+$', '', 'g')), '[\\s\\-_]+', '_', 'g') = 'RESULT'),
u AS (SELECT replay_id, sample_index, unnest(rois) AS roi FROM z WHERE sample_index IS NOT NULL)
SELECT replay_id, sample_index, array_to_string(list_sort(list_distinct(list(roi))), '|') AS rois FROM u GROUP BY ALL"""
)
def evidence_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions to look at, by sample: those of each candidate at its first, best and last sample, narration every
    five seconds and beside results, and what a result screen shows.

    A candidate without a sample in its span asks for the nearest to its start and its end.
    """
    rows, found = tables.frames(spark, sf_dir), tables.events(spark, sf_dir)
    shown = F.coalesce("visible_rois", F.array(F.lower("type")))
    context = F.transform(F.filter(shown, lambda x: x.isin("player_trigger_notification", "opponent_trigger_notification")), lambda x: F.concat(x, F.lit("_analysis_context")))
    regions = F.when(F.col("type") == "TRIGGER_NOTIFICATION", F.concat(shown, context)).otherwise(shown)
    asked = found.select("replay_id", "event_id", "start_time", "end_time", regions.alias("rois"))
    points = selection.interval_frames(found, rows, ["replay_id"], ("start_time", "end_time"), "event_id", "pts", "sample_index", "candidate_scores", kind="type")
    at = points.select("event_id", F.explode(F.array_distinct(F.array("first_pos", "peak_pos", "last_pos"))).alias("sample_index"))
    held = asked.join(at, "event_id").select("replay_id", "sample_index", "rois")
    text = F.array(F.lit("battle_text")).alias("rois")
    ticks = temporal.targets(tables.plan(spark, sf_dir), ["replay_id"], "t", 5.0).select("replay_id", "target", text)
    bare = asked.join(points.select("event_id"), "event_id", "left_anti").select("replay_id", F.explode(F.array("start_time", "end_time")).alias("target"), "rois")
    near = temporal.nearest_point(ticks.unionByName(bare), rows.select("replay_id", "pts", "sample_index"), ["replay_id"], "target", "pts", ["sample_index"])
    near = near.where("sample_index IS NOT NULL").select("replay_id", "sample_index", "rois")
    dense = dense_audit(spark, sf_dir).select("replay_id", "sample_index", text)
    results = rows.where(tx.state_label(F.col("ui_state")) == "RESULT").select("replay_id", "sample_index", F.col("visible_rois").alias("rois"))
    wanted = held.unionByName(near).unionByName(dense).unionByName(results).select("replay_id", "sample_index", F.explode("rois").alias("roi"))
    return wanted.groupBy("replay_id", "sample_index").agg(F.array_join(F.array_sort(F.collect_set("roi")), "|").alias("rois"))


_ROW = r"\| (\d+) \| ([^|\n]+) \| ([^|\n]+) \| (\d+)% \|"


@query(
    f"""WITH h AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_ROW}')) AS hit FROM documents WHERE kind = 'table' AND text IS NOT NULL)
SELECT doc_id, count(*) AS n_rows, CAST(sum(CAST(regexp_extract(hit, '{_ROW}', 4) AS BIGINT)) AS BIGINT) AS total_hp, count(DISTINCT regexp_extract(hit, '{_ROW}', 2)) AS n_names FROM h GROUP BY 1"""
)
def table_scrape(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracefold.sources.tables import scrape

    docs = read(spark, sf_dir, "documents").where("kind = 'table' AND text IS NOT NULL").select("doc_id", "text")
    rows = scrape(docs, "text", _ROW, ["slot", "name", "move", "hp"])
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("hp").cast("long")).alias("total_hp"), F.countDistinct("name").alias("n_names"))


_OBJECT = r'\{"seq": \d+, [^{}\n]*\}'


@query(
    f"""WITH o AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_OBJECT}')) AS hit FROM documents WHERE kind = 'json' AND text IS NOT NULL)
SELECT doc_id, count(*) AS n_objects, count(*) FILTER (json_valid(hit)) AS n_valid, CAST(sum(CASE WHEN json_valid(hit) THEN CAST(hit ->> 'seq' AS BIGINT) END) AS DOUBLE) AS sum_seq FROM o GROUP BY 1"""
)
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects inside documents, read under a schema; those that do not parse are counted."""
    docs = read(spark, sf_dir, "documents").where("kind = 'json' AND text IS NOT NULL")
    hits = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_OBJECT), 0)).alias("hit"))
    rows = hits.withColumn("row", F.from_json("hit", "seq long, actor string, move string, hp double, note string"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_objects"), F.count("row.seq").alias("n_valid"), F.sum("row.seq").cast("double").alias("sum_seq"))


_FACT = "CASE " + " ".join(f"WHEN kind = '{k}' AND action = '{a}' THEN '{t}'" for (k, a), t in FACT_TYPES.items()) + " ELSE 'UNRESOLVED_EVENT' END"


@query(_EVENTS + f"SELECT {_FACT} AS fact_type, count(*) AS n, count(DISTINCT e) AS n_replays FROM e0 GROUP BY 1")
def fact_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the type of fact that they state; the type table is joined, what it lacks is unresolved."""
    table = spark.createDataFrame([(k, a, t) for (k, a), t in FACT_TYPES.items()], "kind string, action string, fact_type string")
    rows = narration(spark, sf_dir).withColumn("action", F.col("fields")["action"])
    typed = rows.join(F.broadcast(table), ["kind", "action"], "left").withColumn("fact_type", F.coalesce("fact_type", F.lit("UNRESOLVED_EVENT")))
    return typed.groupBy("fact_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("replay_id").alias("n_replays"))


@query(
    with_tables("oc")
    + f""", v AS (SELECT request_id, confidence AS c, generate_subscripts(preprocessing, 1) AS i, unnest(preprocessing) AS step FROM oc WHERE preprocessing IS NOT NULL)
SELECT step, count(*) AS n, round_even(sum(round_even(c * (0.45::DOUBLE + 0.35::DOUBLE * c + 0.2::DOUBLE * [{", ".join(map(str, VARIANT_WEIGHTS))}][least(i, {len(VARIANT_WEIGHTS)})]::DOUBLE), 9)), 4) AS weight FROM v GROUP BY 1"""
)
def variant_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of each preparation step by effective weight."""
    rows = tables.ocr(spark, sf_dir).where("preprocessing IS NOT NULL").select("confidence", F.posexplode("preprocessing").alias("i", "step"))
    quality = F.get(F.array(*[F.lit(w) for w in VARIANT_WEIGHTS]), F.least(F.col("i"), F.lit(len(VARIANT_WEIGHTS) - 1)))
    weight = voting.effective_weight(F.col("confidence"), F.col("confidence"), quality)
    return rows.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.bround(F.sum(F.bround(weight, 9)), 4).alias("weight"))


@query(
    with_tables("gr", "ev")
    + ", x AS (SELECT timeline_id, generate_subscripts(event_ids, 1) AS i, unnest(event_ids) AS event_id FROM gr) SELECT timeline_id, count(*) AS n_found, array_to_string(list(ev.type ORDER BY i), '>') AS types, round_even(min(ev.confidence), 6) AS confidence FROM x JOIN ev USING (event_id) GROUP BY 1"
)
def group_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each group in the group's order."""
    refs = tables.groups(spark, sf_dir).select("timeline_id", F.posexplode("event_ids").alias("i", "event_id"))
    rows = refs.join(tables.events(spark, sf_dir).select("event_id", "type", "confidence"), "event_id")
    out = rows.groupBy("timeline_id").agg(F.count(F.lit(1)).alias("n_found"), F.array_sort(F.collect_list(F.struct("i", "type"))).alias("x"), F.bround(F.min("confidence"), 6).alias("confidence"))
    return out.select("timeline_id", "n_found", F.array_join(F.transform("x", lambda s: s["type"]), ">").alias("types"), "confidence")


@query(
    _WIN
    + """, o AS (SELECT t.replay_id, 0 AS segment, count(*) AS n_texts, max(start_time) AS last_text FROM t LEFT JOIN (SELECT replay_id, min(a) AS a FROM w GROUP BY 1) f USING (replay_id) WHERE f.a IS NULL OR start_time < f.a GROUP BY 1),
s AS (SELECT w.replay_id, CAST(session AS BIGINT) AS segment, count(*) AS n_texts, max(start_time) AS last_text FROM w JOIN t ON t.replay_id = w.replay_id AND start_time >= a AND (start_time < z OR last) GROUP BY ALL)
SELECT replay_id, CAST(segment AS BIGINT) AS segment, n_texts, round_even(last_text, 6) AS last_text FROM (SELECT * FROM o UNION ALL SELECT * FROM s)"""
)
def turn_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narration by segment: the opening (0) before the first menu, then one for each menu window, the last without an end."""
    texts = tables.events(spark, sf_dir).where("type = 'BATTLE_TEXT'").select("replay_id", "event_id", "start_time")
    windows_ = _windows(spark, sf_dir).select("replay_id", "session", F.col("a").alias("start_time"))
    # a window's number carried forward over texts and window starts in one sequence
    marks = windows_.select("replay_id", "start_time", F.lit("").alias("event_id"), "session").unionByName(texts.withColumn("session", F.lit(None).cast("long")))
    rows = windows.last_per_key(marks, ["replay_id"], "start_time", "event_id", F.col("session"), "segment").where("event_id <> ''")
    return rows.groupBy("replay_id", F.coalesce("segment", F.lit(0).cast("long")).alias("segment")).agg(F.count(F.lit(1)).alias("n_texts"), F.bround(F.max("start_time"), 6).alias("last_text"))
