"""Queries of the temporal and sequence operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions.scores import best_label, change_class
from tracefold.functions.text import display_time
from tracefold.operators import temporal, windows
from tracefold.operators.sequence import lagged
from tracefold.plans import tables
from tracefold.plans.fixed_values import LEAST_SAMPLES, STATES
from tracefold.plans.tables import with_tables

SOURCE = ["replay_id", "side", "slot"]
_S = ", ".join(SOURCE)
r6 = lambda c: F.bround(c, 6)
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# written out for the SQL independently of the tables of fixed values
_LEAST = "CASE kind WHEN 'BATTLE_TEXT' THEN 1 WHEN 'TRIGGER_NOTIFICATION' THEN 2 ELSE 3 END"
_THR = "CASE kind WHEN 'TEAM_PREVIEW' THEN 0.84 WHEN 'SELECTED_FOUR' THEN 0.83 WHEN 'MOVE_MENU' THEN 0.80 WHEN 'RESULT' THEN 0.84 ELSE 0.50 END"


@query(
    with_tables("fr")
    + f""", s AS (SELECT replay_id, k.kind AS kind, sample_index AS pos, pts, candidate_scores[k.kind] AS score
       FROM fr, (SELECT unnest([{", ".join(repr(k) for k in STATES)}]) AS kind) k WHERE candidate_scores IS NOT NULL AND candidate_scores[k.kind] IS NOT NULL),
h AS (SELECT *, CASE WHEN pos - lag(pos) OVER w <= 3 THEN 0 ELSE 1 END AS new FROM s WHERE score >= {_THR} WINDOW w AS (PARTITION BY replay_id, kind ORDER BY pos)),
i AS (SELECT *, sum(new) OVER (PARTITION BY replay_id, kind ORDER BY pos ROWS UNBOUNDED PRECEDING) AS no FROM h),
p AS (SELECT replay_id, kind, no, min(pos) AS a, max(pos) AS b, count(*) AS n_hits FROM i GROUP BY ALL HAVING max(pos) - min(pos) + 1 >= min({_LEAST}))
SELECT p.replay_id, p.kind, CAST(a AS INT) AS first_pos, CAST(b AS INT) AS last_pos, count(*) AS n_samples, any_value(n_hits) AS n_hits, round_even(sum(score), 4) AS total_score
FROM p JOIN s ON s.replay_id = p.replay_id AND s.kind = p.kind AND s.pos BETWEEN a AND b GROUP BY p.replay_id, p.kind, a, b"""
)
def threshold_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.frames(spark, sf_dir).select("replay_id", "sample_index", "pts", "candidate_scores")
    out = temporal.kind_intervals(rows, ["replay_id"], "sample_index", "pts", "candidate_scores", {k: (t, LEAST_SAMPLES[k]) for k, t in STATES.items()}, 2)
    return out.select("replay_id", "kind", "first_pos", "last_pos", "n_samples", "n_hits", F.bround(F.col("mean_score") * F.col("n_samples"), 4).alias("total_score"))


_MENU = with_tables("ev") + """, m AS (SELECT *, lag(end_time) OVER (PARTITION BY replay_id ORDER BY start_time, event_id) AS prev FROM ev WHERE type = 'MOVE_MENU'),
n AS (SELECT *, sum(CASE WHEN prev IS NULL OR start_time - prev > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY replay_id ORDER BY start_time, event_id ROWS UNBOUNDED PRECEDING) AS session FROM m)"""


def _menus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = temporal.sessions(tables.events(spark, sf_dir).where("type = 'MOVE_MENU'"), ["replay_id"], "start_time", "end_time", "event_id", 20.0)
    return rows.groupBy("replay_id", "session").agg(F.min("start_time").alias("a"), F.max("end_time").alias("b"), F.count(F.lit(1)).alias("n_menus"))


@query(_MENU + "SELECT replay_id, CAST(session AS BIGINT) AS session, min(start_time) AS a, max(end_time) AS b, count(*) AS n_menus FROM n GROUP BY replay_id, session")
def session_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _menus(spark, sf_dir)


_NEAR = with_tables("pl") + """, b AS (SELECT replay_id, min(t) AS a, max(t) AS z FROM pl GROUP BY 1),
g AS (SELECT replay_id, a, unnest(range(0, CAST(floor((z - a + 1e-9) / 0.25) AS BIGINT) + 1)) AS k FROM b),
q AS (SELECT replay_id, k, a + k * 0.25::DOUBLE AS target FROM g),
x AS (SELECT q.*, l.t AS lt, l.sample_index AS ls FROM q ASOF LEFT JOIN pl l ON q.replay_id = l.replay_id AND q.target >= l.t),
y AS (SELECT x.*, r.t AS rt, r.sample_index AS rs FROM x ASOF LEFT JOIN pl r ON x.replay_id = r.replay_id AND x.target <= r.t),
nearest AS (SELECT replay_id, k, target, CASE WHEN rt IS NULL OR abs(target - lt) <= abs(rt - target) THEN lt ELSE rt END AS near_time,
  CASE WHEN rt IS NULL OR abs(target - lt) <= abs(rt - target) THEN ls ELSE rs END AS sample_index FROM y)"""


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = tables.plan(spark, sf_dir)
    asks = temporal.targets(points, ["replay_id"], "t", 0.25).withColumnRenamed("tick", "k")
    return temporal.nearest_point(asks, points, ["replay_id"], "target", "t", ["sample_index"])


@query(_NEAR + "SELECT replay_id, k, round_even(near_time, 6) AS near_time, sample_index FROM nearest")
def resample_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir).select("replay_id", "k", r6("near_time").alias("near_time"), "sample_index")


@query(_NEAR + ", d AS (SELECT *, lag(sample_index) OVER (PARTITION BY replay_id ORDER BY k) AS was FROM nearest) SELECT replay_id, k, sample_index FROM d WHERE was IS NULL OR was <> sample_index")
def resample_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lagged(_nearest(spark, sf_dir), ["replay_id"], ["k"], F.floor(F.col("k") / 4096), {"was": F.col("sample_index")})
    return rows.where("was IS NULL OR was <> sample_index").select("replay_id", "k", "sample_index")


@query(
    with_tables("gr", "hp")
    + """, s AS (SELECT gr.timeline_id, gr.replay_id, gr.start_time, v.side, v.slot FROM gr, (VALUES ('player','left'),('player','right'),('opponent','left'),('opponent','right')) v(side, slot)),
o AS (SELECT replay_id, side, slot, timestamp AS t, max(hp) AS hp FROM hp WHERE hp IS NOT NULL GROUP BY ALL)
SELECT s.timeline_id, s.side, s.slot, round_even(o.t, 6) AS hp_time, o.hp FROM s ASOF LEFT JOIN o ON s.replay_id = o.replay_id AND s.side = o.side AND s.slot = o.slot AND s.start_time >= o.t"""
)
def asof_latest_hp(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = F.array(*[F.struct(F.lit(a).alias("side"), F.lit(b).alias("slot")) for a in ("player", "opponent") for b in ("left", "right")])
    asks = tables.groups(spark, sf_dir).select("timeline_id", "replay_id", "start_time", F.explode(slots).alias("x")).select("timeline_id", "replay_id", "start_time", "x.*")
    known = tables.hp(spark, sf_dir).where("hp IS NOT NULL")
    out = temporal.asof_latest(asks, known, SOURCE, "start_time", "timestamp", ["hp"])
    return out.select("timeline_id", "side", "slot", r6("latest.t").alias("hp_time"), F.col("latest.hp").alias("hp"))


_PAIRS = with_tables("ev", "gr") + """, p AS (SELECT gr.timeline_id, ev.event_id, least(ev.end_time + 2, gr.end_time) - greatest(ev.start_time - 2, gr.start_time) AS overlap
FROM gr JOIN ev ON gr.replay_id = ev.replay_id AND ev.start_time - 2 <= gr.end_time AND gr.start_time <= ev.end_time + 2)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tables.events(spark, sf_dir).select("replay_id", "event_id", "start_time", "end_time")
    gr = tables.groups(spark, sf_dir).select("replay_id", "timeline_id", "start_time", "end_time")
    return temporal.interval_join(ev, gr, ["replay_id"], ("start_time", "end_time"), ("start_time", "end_time"), slack=2.0)


@query(_PAIRS + "SELECT timeline_id, count(*) AS n_events, min(event_id) AS first_event, round_even(sum(overlap), 6) AS overlap FROM p GROUP BY 1")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).groupBy("_right.timeline_id").agg(F.count(F.lit(1)).alias("n_events"), F.min("_left.event_id").alias("first_event"), r6(F.sum("overlap")).alias("overlap"))


@query(_PAIRS + "SELECT event_id, arg_min(timeline_id, struct_pack(o := -overlap, t := timeline_id)) AS best_id, round_even(max(overlap), 6) AS overlap FROM p GROUP BY 1")
def largest_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.largest_overlap(_pairs(spark, sf_dir), "event_id", "timeline_id").select("event_id", "best_id", r6("overlap").alias("overlap"))


_WIN = _MENU + """, c AS (SELECT replay_id, session, min(start_time) AS a, max(end_time) AS b FROM n GROUP BY ALL),
w AS (SELECT replay_id, session, a, coalesce(lead(a) OVER (PARTITION BY replay_id ORDER BY session), b) AS z, lead(a) OVER (PARTITION BY replay_id ORDER BY session) IS NULL AS last FROM c),
t AS (SELECT replay_id, event_id, start_time FROM ev WHERE type = 'BATTLE_TEXT')"""


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    menus = _menus(spark, sf_dir).withColumn("neg", -F.col("session"))
    rows = lagged(menus, ["replay_id"], ["neg"], F.floor(F.col("neg") / 4096), {"next": F.col("a")})
    return rows.select("replay_id", "session", "a", F.coalesce("next", "b").alias("z"))


@query(_WIN + "SELECT w.replay_id, CAST(session AS BIGINT) AS session, count(*) AS n_texts FROM w JOIN t ON t.replay_id = w.replay_id AND start_time >= a AND (start_time < z OR last AND start_time <= z) GROUP BY ALL")
def window_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = tables.events(spark, sf_dir).where("type = 'BATTLE_TEXT'").select("replay_id", "event_id", "start_time")
    held = temporal.assign_windows(points, _windows(spark, sf_dir), ["replay_id"], "start_time", "a", "z", "session")
    return held.groupBy("replay_id", "window.session").agg(F.count(F.lit(1)).alias("n_texts"))


@query(_WIN + "SELECT t.event_id, CAST(min(session) AS DOUBLE) AS window_no FROM t LEFT JOIN w ON t.replay_id = w.replay_id AND start_time BETWEEN a AND z GROUP BY 1")
def first_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = tables.events(spark, sf_dir).where("type = 'BATTLE_TEXT'").select("replay_id", "event_id", "start_time")
    return temporal.first_containing(points, _windows(spark, sf_dir), ["replay_id"], "start_time", "a", "z", "session").select("event_id", F.col("window_no").cast("double").alias("window_no"))


_HP = with_tables("hp")
_BY_HP = f"(PARTITION BY {_S} ORDER BY timestamp, frame_ordinal)"


@query(
    _HP
    + f""", l AS (SELECT *, lag(hp) OVER w AS b, lag(timestamp) OVER w AS bt FROM hp WHERE hp IS NOT NULL WINDOW w AS {_BY_HP})
SELECT observation_id, round_even(hp - b, 3) AS delta, CASE WHEN hp - b >= 0.5 THEN 'increase' ELSE 'decrease' END AS change FROM l WHERE abs(hp - b) >= 0.5 AND timestamp - bt <= 3"""
)
def hp_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.changes(tables.hp(spark, sf_dir), SOURCE, "timestamp", "frame_ordinal", "hp", 0.5, 3.0)
    return rows.select("observation_id", F.bround("delta", 3).alias("delta"), change_class(F.col("before"), F.col("hp")).alias("change"))


@query(_HP + f", l AS (SELECT *, lag(identity_text) OVER {_BY_HP} AS b FROM hp WHERE identity_text IS NOT NULL) SELECT observation_id, b AS before, identity_text FROM l WHERE b IS NULL OR b <> identity_text")
def identity_change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.change_log(tables.hp(spark, sf_dir), SOURCE, "timestamp", "frame_ordinal", "identity_text").select("observation_id", "before", "identity_text")


@query(
    _HP
    + f""", l AS (SELECT observation_id, hp, CASE WHEN abs(timestamp - lag(timestamp) OVER w) <= 0.6 THEN lag(hp) OVER w END AS a,
  CASE WHEN abs(lead(timestamp) OVER w - timestamp) <= 0.6 THEN lead(hp) OVER w END AS c FROM hp WINDOW w AS {_BY_HP}),
u AS (SELECT observation_id, hp, unnest([a, hp, c]) AS v FROM l)
SELECT observation_id, CASE WHEN any_value(hp) IS NOT NULL THEN round_even(median(v), 4) END AS smooth FROM u GROUP BY 1"""
)
def centred_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.centred_median(tables.hp(spark, sf_dir), SOURCE, "timestamp", "frame_ordinal", "hp", 0.6, "smooth")
    return rows.select("observation_id", F.bround("smooth", 4).alias("smooth"))


@query(
    with_tables("ev")
    + """, l AS (SELECT replay_id, round_even(start_time - lag(end_time) OVER (PARTITION BY replay_id, type ORDER BY start_time, event_id), 3) AS gap, type FROM ev),
g AS (SELECT replay_id, type, gap FROM l WHERE gap IS NOT NULL), s AS (SELECT replay_id, type, list_sort(list(gap)) AS v FROM g GROUP BY ALL)
SELECT replay_id, type, len(v) AS n_gaps, v[1] AS least, v[CAST(floor((len(v) - 1) * 0.5) AS BIGINT) + 1] AS median, v[CAST(floor((len(v) - 1) * 0.9::DOUBLE) AS BIGINT) + 1] AS p90, v[-1] AS most,
len(list_filter(v, lambda x: x < 0)) AS bucket_0, len(list_filter(v, lambda x: x >= 0 AND x < 5)) AS bucket_1, len(list_filter(v, lambda x: x >= 5 AND x < 20)) AS bucket_2, len(list_filter(v, lambda x: x >= 20)) AS bucket_3 FROM s"""
)
def gap_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.gap_distribution(tables.events(spark, sf_dir), ["replay_id", "type"], "start_time", "end_time", "event_id", [0.0, 5.0, 20.0])


@query(
    with_tables("pl")
    + """, l AS (SELECT replay_id, round_even(t - lag(t) OVER (PARTITION BY replay_id ORDER BY sample_index), 2) AS step FROM pl),
c AS (SELECT replay_id, step, count(*) AS n FROM l WHERE step IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY replay_id ORDER BY n DESC, step) AS rank FROM c)
SELECT replay_id, step, n, CAST(rank AS INT) AS rank FROM r WHERE rank <= 12"""
)
def delta_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.delta_buckets(tables.plan(spark, sf_dir), ["replay_id"], "t", "sample_index", 12, 2)


_CHANGE = "CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END"
_BY_USER = "(PARTITION BY user_id ORDER BY ts, event_id"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


@query(f"WITH n AS (SELECT event_id, sum({_CHANGE}) OVER {_BY_USER} ROWS UNBOUNDED PRECEDING) AS net FROM events) SELECT event_id, CAST(net AS BIGINT) AS net, CAST(greatest(-6, least(6, net)) AS BIGINT) AS stage FROM n")
def net_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.net_stage(_events(spark, sf_dir), ["user_id"], "s", "event_id", F.expr(_CHANGE), -6, 6).select("event_id", "net", "stage")


@query(
    _HP
    + f""", f AS (SELECT {_S}, arg_min(species_id, struct_pack(timestamp, frame_ordinal)) AS known FROM hp WHERE species_id IS NOT NULL GROUP BY ALL)
SELECT observation_id, known, species_id AS stated FROM hp JOIN f USING ({_S}) WHERE species_id <> known"""
)
def value_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.conflicts(tables.hp(spark, sf_dir), SOURCE, "timestamp", "frame_ordinal", "species_id").select("observation_id", "known", "stated")


@query(
    "WITH e AS (SELECT * FROM events WHERE event_type IN ('signup', 'purchase')), l AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nt, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ne FROM e) "
    "SELECT event_id, CAST(epoch_us(nt) - epoch_us(ts) AS DOUBLE) AS open_us, coalesce(ne = 'purchase', false) AS ended FROM l WHERE event_type = 'signup'"
)
def open_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.open_close(_events(spark, sf_dir), ["user_id"], "s", "event_id", F.col("event_type") == "signup", F.col("event_type") == "purchase")
    return out.select("event_id", F.round((F.col("closed") - F.col("s")) * 1e6).alias("open_us"), "ended")


@query(f"WITH f AS (SELECT event_id, user_id, ts, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 THEN 1 ELSE 0 END AS new FROM events) SELECT event_id, CAST(sum(new) OVER {_BY_USER} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n_seen FROM f")
def seen_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.seen_so_far(_events(spark, sf_dir), ["user_id"], "s", "event_id", "event_type").select("event_id", "n_seen")


@query(with_tables("gr") + "SELECT timeline_id, max(end_time) OVER (PARTITION BY replay_id ORDER BY start_time, timeline_id ROWS UNBOUNDED PRECEDING) AS projected FROM gr")
def running_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.running_peak(tables.groups(spark, sf_dir), ["replay_id"], "start_time", "timeline_id", "end_time", "projected").select("timeline_id", "projected")


@query(with_tables("hp") + f", l AS (SELECT observation_id, last_value(identity_text IGNORE NULLS) OVER {_BY_HP[:-1]} ROWS UNBOUNDED PRECEDING) AS identity FROM hp) SELECT * FROM l")
def carried_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.last_per_key(tables.hp(spark, sf_dir), SOURCE, "timestamp", "frame_ordinal", F.col("identity_text"), "identity").select("observation_id", "identity")


@query(
    with_tables("fr")
    + ", s AS (SELECT replay_id, sample_index, ["
    + ", ".join(f"struct_pack(s := candidate_scores['{k}'], o := {-i}, k := '{k}')" for i, k in enumerate(STATES))
    + "] AS a FROM fr) SELECT replay_id, sample_index, coalesce(list_sort(list_filter(a, lambda x: x.s >= CASE x.k WHEN 'TEAM_PREVIEW' THEN 0.84 WHEN 'SELECTED_FOUR' THEN 0.83 WHEN 'MOVE_MENU' THEN 0.80 WHEN 'RESULT' THEN 0.84 ELSE 0.50 END))[-1].k, 'UNKNOWN') AS state FROM s"
)
def best_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.frames(spark, sf_dir).select("replay_id", "sample_index", best_label(F.col("candidate_scores"), STATES).alias("state"))


def _clock(col: str) -> str:
    ms = f"greatest(0, CAST(round_even({col} * 1000, 0) AS BIGINT))"
    return f"printf('%02d:%02d:%02d.%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


@query(with_tables("ev") + f"SELECT event_id, {_clock('start_time')} AS shown, {_clock('start_time')} = start_timestamp AS agrees FROM ev")
def display_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = display_time(F.col("start_time"))
    return tables.events(spark, sf_dir).select("event_id", shown.alias("shown"), (shown == F.col("start_timestamp")).alias("agrees"))


@query(with_tables("ev") + "SELECT event_id, (row_number() OVER (PARTITION BY replay_id ORDER BY start_time, event_id) - 1) // 20 AS page FROM ev")
def pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.pages(tables.events(spark, sf_dir), ["replay_id"], "start_time", "event_id", 20).select("event_id", "page")


@query(
    with_tables("ev")
    + ", n AS (SELECT event_id, replay_id, type, row_number() OVER (PARTITION BY replay_id, type ORDER BY start_time, event_id) - 1 AS i, count(*) OVER (PARTITION BY replay_id, type) AS n FROM ev), "
    "k AS (SELECT DISTINCT replay_id, type, n, unnest(range(0, 10)) AS j FROM n WHERE n > 10) "
    "SELECT event_id FROM n WHERE n <= 10 UNION SELECT event_id FROM n JOIN k ON n.replay_id = k.replay_id AND n.type = k.type AND n.i = j * (n.n - 1) // 9"
)
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.even_sample(tables.events(spark, sf_dir), ["replay_id", "type"], "start_time", "event_id", 10).select("event_id")


@query(
    with_tables("fr")
    + """, l AS (SELECT replay_id, sample_index, lag(ui_state) OVER w AS a, ui_state AS b, lead(ui_state) OVER w AS c FROM fr WINDOW w AS (PARTITION BY replay_id ORDER BY sample_index))
SELECT replay_id, sample_index, CASE WHEN a = b OR a = c THEN a WHEN b = c THEN b ELSE coalesce(a, b, c) END AS voted FROM l"""
)
def rolling_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.frames(spark, sf_dir).select("replay_id", "sample_index", "ui_state")
    return windows.rolling_mode(rows, ["replay_id"], "sample_index", "ui_state", "voted").select("replay_id", "sample_index", "voted")
