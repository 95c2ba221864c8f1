"""Queries of facts: participants, identities, relations, evidence, rules over linked facts, and their gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions import scores as sc
from tracefold.functions import text as tx
from tracefold.operators import correlate, facts, quality, review, selection, temporal, windows
from tracefold.operators.sequence import lagged
from tracefold.plans import tables
from tracefold.plans.event_queries import _EVENTS, _PARENTS, _proposals, narration
from tracefold.plans.fixed_values import LINK_FROM
from tracefold.plans.tables import with_tables
from tracefold.plans.time_queries import _BY_HP, _HP, _MENU, SOURCE
from tracefold.session import cut_lineage, read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- participants and identities ----------------------------------------------

_ACTING = "('MOVE', 'ABILITY', 'ITEM', 'SWITCH', 'TRANSFORMATION')"
_KEY = "lower(regexp_replace({}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"
_PEOPLE = (
    _EVENTS
    + f""", pa AS (SELECT e AS replay_id, id AS event_id, kind, side AS said, [struct_pack(role := 'actor', name := actor, being := 'creature', at := 0), struct_pack(role := 'target', name := target, being := 'creature', at := 1)]
  || list_transform(list_filter(targets, lambda n: n IS DISTINCT FROM actor AND n IS DISTINCT FROM target), lambda n, i: struct_pack(role := CASE WHEN kind IN {_ACTING} THEN 'actor' ELSE 'target' END, name := n, being := 'creature', at := CAST(i + 1 AS INT)))
  || [struct_pack(role := 'trainer', name := trainer, being := 'trainer', at := 100), struct_pack(role := 'loser', name := loser, being := 'trainer', at := 101)] AS people FROM e0),
pb AS (SELECT replay_id, event_id, kind, said, unnest(list_filter(people, lambda x: x.name IS NOT NULL)) AS x FROM pa),
pc AS (SELECT DISTINCT ON (event_id, x.role, x.being, {_KEY.format('x.name')}) replay_id, event_id, kind, said, x FROM pb ORDER BY event_id, x.role, x.being, {_KEY.format('x.name')}, x.at),
people AS (SELECT replay_id, event_id, kind, x.role AS role, x.name AS name, x.being AS being, CASE WHEN (x.role = 'actor' AND kind IN {_ACTING}) OR (x.role = 'target' AND kind NOT IN {_ACTING}) THEN coalesce(said, 'unknown') ELSE 'unknown' END AS side FROM pc)"""
)


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.participants(narration(spark, sf_dir), ["replay_id", "event_id"], "kind", "fields", "targets")


@query(_PEOPLE + " SELECT * FROM people")
def fact_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _people(spark, sf_dir)


_KNOWN = f"""SELECT replay_id, side, {_KEY.format('identity_text')} AS k, min(species_id) AS species_id FROM hp WHERE length({_KEY.format('identity_text')}) > 0 GROUP BY ALL"""


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who was seen on which side of a match."""
    rows = tables.hp(spark, sf_dir).withColumn("name_key", facts.name_key(F.col("identity_text"))).where("length(name_key) > 0")
    by = rows.groupBy("replay_id", "side", "name_key").agg(F.min("species_id").alias("species_id"))
    return by.withColumn("entity_id", F.concat_ws(":", "side", "name_key"))


def _species(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that mean one species."""
    rows = read(spark, sf_dir, "match_reference").where("kind = 'species'").select("entry_id", F.explode(F.array("zh_tw", "en", "showdown_id")).alias("n"))
    by = rows.groupBy(facts.name_key(F.col("n")).alias("name_key")).agg(F.countDistinct("entry_id").alias("n"), F.min("entry_id").alias("species_id"))
    return by.where("n = 1").drop("n")


@query(
    _PEOPLE.replace("WITH oc", "WITH " + with_tables("hp")[5:].strip() + ", oc", 1)
    + f""", en AS ({_KNOWN}), al AS (SELECT {_KEY.format('unnest([zh_tw, en, showdown_id])')} AS k, entry_id FROM match_reference WHERE kind = 'species'),
sp AS (SELECT k, min(entry_id) AS species_id FROM al GROUP BY 1 HAVING count(DISTINCT entry_id) = 1),
q AS (SELECT people.*, {_KEY.format('name')} AS k, CASE WHEN being = 'creature' THEN sp.species_id END AS species_id FROM people LEFT JOIN sp ON sp.k = {_KEY.format('people.name')}),
h AS (SELECT q.event_id, q.role, q.being, q.k, count(DISTINCT en.side || ':' || en.k) AS n, min(en.side || ':' || en.k) AS one FROM q JOIN en ON en.replay_id = q.replay_id AND (q.side = 'unknown' OR en.side = 'unknown' OR en.side = q.side) AND (en.k = q.k OR en.species_id = q.species_id) GROUP BY ALL)
SELECT q.replay_id, q.event_id, q.role, q.name, coalesce(h.n, 0) AS n_candidates, CASE WHEN q.being <> 'creature' THEN 'observed_only' WHEN h.n = 1 THEN 'entity' WHEN h.n > 1 THEN 'ambiguous' WHEN q.species_id IS NOT NULL THEN 'species' ELSE 'name_only' END AS status,
CASE WHEN q.being = 'creature' AND h.n = 1 THEN one END AS entity_id FROM q LEFT JOIN h ON h.event_id = q.event_id AND h.role = q.role AND h.being = q.being AND h.k = q.k"""
)
def participant_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each participant with the entity of its match that it is: by species or name, on a side that fits."""
    people = _people(spark, sf_dir).withColumn("name_key", facts.name_key(F.col("name"))).withColumn("ask", F.struct("event_id", "role", "being", "name_key"))
    asks = people.join(_species(spark, sf_dir), "name_key", "left").withColumn("species_id", F.when(F.col("being") == "creature", F.col("species_id")))
    asks = cut_lineage(asks)
    matches = facts.entity_matches(asks, _entities(spark, sf_dir), ["replay_id"], "ask")
    return facts.resolved(asks, matches, ["replay_id"], "ask").select("replay_id", "event_id", "role", "name", "n_candidates", "status", "entity_id")


# --- relations, evidence, rules ------------------------------------------------


def _edges(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    best = correlate.best_parent(_proposals(spark, sf_dir, events), LINK_FROM)
    reviews = spark.createDataFrame([], "source string, target string, decision string, decided_at int")
    return facts.relations(best, reviews, "source", "target", "relation")


@query(_PARENTS + " SELECT source, target, rule, relation, 'auto_accepted' AS review, true AS active, relation IN ('DAMAGE_FROM', 'RESULT_OF', 'STATUS_FROM', 'STAT_CHANGE_FROM', 'TRIGGERED_BY') AS causal FROM parents")
def fact_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as relations of facts; adjacency alone is never a cause."""
    return _edges(spark, sf_dir).select("source", "target", "rule", "relation", "review", "active", "causal")


_LINKED = [
    ("move.resolved", "MOVE", "MOVE_RESULT", ["RESULT_OF", "TEMPORALLY_ADJACENT"], {"action": "use"}, {"action": "resolve"}, False),
    ("move.damaged", "MOVE", "DAMAGE_RESULT", ["DAMAGE_FROM", "TEMPORALLY_ADJACENT"], {}, {"action": "damage"}, False),
    ("move.own_stat", "MOVE", "STAT_CHANGE", ["STAT_CHANGE_FROM", "TEMPORALLY_ADJACENT"], {}, {"direction": "raise"}, True),
    ("status.batch", "DAMAGE_RESULT", "DAMAGE_RESULT", ["SAME_ACTION"], {"cause": "status"}, {"cause": "status"}, False),
]


@query(
    _PARENTS
    + f""", j AS (SELECT p.source, p.target, p.relation, s.kind AS sk, t.kind AS tk, s.action AS sa, t.action AS ta, t.direction AS td, s.cause AS sc, t.cause AS tc, coalesce(s.actor, s.target) AS who, coalesce(t.target, t.actor) AS whom FROM parents p JOIN e0 s ON s.id = p.source JOIN e0 t ON t.id = p.target)
SELECT 'move.resolved' AS rule, source, target, relation FROM j WHERE sk = 'MOVE' AND tk = 'MOVE_RESULT' AND relation IN ('RESULT_OF', 'TEMPORALLY_ADJACENT') AND sa = 'use' AND ta = 'resolve'
UNION ALL SELECT 'move.damaged', source, target, relation FROM j WHERE sk = 'MOVE' AND tk = 'DAMAGE_RESULT' AND relation IN ('DAMAGE_FROM', 'TEMPORALLY_ADJACENT') AND ta = 'damage'
UNION ALL SELECT 'move.own_stat', source, target, relation FROM j WHERE sk = 'MOVE' AND tk = 'STAT_CHANGE' AND relation IN ('STAT_CHANGE_FROM', 'TEMPORALLY_ADJACENT') AND td = 'raise' AND {_KEY.format('who')} = {_KEY.format('whom')}
UNION ALL SELECT 'status.batch', source, target, relation FROM j WHERE sk = 'DAMAGE_RESULT' AND tk = 'DAMAGE_RESULT' AND relation = 'SAME_ACTION' AND sc = 'status' AND tc = 'status'"""
)
def linked_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked facts that meet a rule's kinds, pairs and identity."""
    events = cut_lineage(narration(spark, sf_dir))
    rules = spark.createDataFrame(_LINKED, "rule string, source_kind string, target_kind string, relations array<string>, source_pairs map<string,string>, target_pairs map<string,string>, same boolean")
    return facts.linked_rules(events, _edges(spark, sf_dir, events), rules, "event_id", "kind", "fields")


@query(
    _EVENTS
    + """, d AS (SELECT e, id, a, target FROM e0 WHERE kind = 'DAMAGE_RESULT' AND cause = 'status' AND target IS NOT NULL), s AS (SELECT e, id, a, target, status FROM e0 WHERE kind = 'STATUS' AND target IS NOT NULL)
SELECT d.id AS event_id, arg_max(s.id, struct_pack(a := s.a, i := s.id)) AS status_event, arg_max(s.status, struct_pack(a := s.a, i := s.id)) AS status FROM d LEFT JOIN s ON s.e = d.e AND s.target = d.target AND s.a <= d.a GROUP BY 1"""
)
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage by a status with the last event, at or before it, that gave its target one."""
    rows = cut_lineage(narration(spark, sf_dir).select("replay_id", "event_id", "start", "kind", F.col("fields")["target"].alias("who"), F.col("fields")["cause"].alias("cause"), F.col("fields")["status"].alias("status")).where("who IS NOT NULL"))
    harm = rows.where("kind = 'DAMAGE_RESULT' AND cause = 'status'").select("replay_id", "who", "event_id", "start")
    given = rows.where("kind = 'STATUS'").select("replay_id", "who", "start", "event_id", "status")
    out = temporal.asof_latest(harm, given, ["replay_id", "who"], "start", "start", ["event_id", "status"])
    return out.select("event_id", F.col("latest.event_id").alias("status_event"), F.col("latest.status").alias("status"))


@query(
    _HP
    + f""", l AS (SELECT *, lag(hp) OVER w AS b, lag(timestamp) OVER w AS bt, lag(observation_id) OVER w AS bo, lag(confidence) OVER w AS bc FROM hp WHERE hp IS NOT NULL WINDOW w AS {_BY_HP})
SELECT replay_id || ':' || observation_id AS change_id, bo AS before_id, observation_id AS after_id, round_even((timestamp + bt) / 2, 7) AS middle, round_even(least(confidence, bc), 6) AS confidence FROM l WHERE abs(hp - b) >= 0.5 AND timestamp - bt <= 3"""
)
def hp_change_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of a reading with the two observations that show them."""
    rows = tables.hp(spark, sf_dir).where("hp IS NOT NULL")
    rows = lagged(rows, SOURCE, ["timestamp", "frame_ordinal"], F.floor(F.col("timestamp") / 600), {"b": F.col("hp"), "bt": F.col("timestamp"), "bo": F.col("observation_id"), "bc": F.col("confidence")})
    rows = rows.where((F.abs(F.col("hp") - F.col("b")) >= 0.5) & (F.col("timestamp") - F.col("bt") <= 3))
    return rows.select(F.concat_ws(":", "replay_id", "observation_id").alias("change_id"), F.col("bo").alias("before_id"), F.col("observation_id").alias("after_id"), F.bround((F.col("timestamp") + F.col("bt")) / 2, 7).alias("middle"), F.bround(F.least("confidence", "bc"), 6).alias("confidence"))


@query(_MENU + " SELECT replay_id, CAST(session AS BIGINT) AS session, string_agg(event_id, '|' ORDER BY start_time, event_id) AS menus, round_even(min(confidence), 6) AS confidence FROM n GROUP BY ALL")
def boundary_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session of menus with the menus that show it, in order."""
    rows = temporal.sessions(tables.events(spark, sf_dir).where("type = 'MOVE_MENU'"), ["replay_id"], "start_time", "end_time", "event_id", 20.0)
    items = F.sort_array(F.collect_list(F.struct("start_time", "event_id")))
    return rows.groupBy("replay_id", "session").agg(F.array_join(F.transform(items, lambda x: x["event_id"]), "|").alias("menus"), F.bround(F.min("confidence"), 6).alias("confidence"))


@query(
    _EVENTS
    + """, g AS (SELECT kind, action, list(DISTINCT id ORDER BY id) AS ids FROM e0 GROUP BY ALL) SELECT kind, action, len(ids) AS n_facts, ids[1] AS first_fact, ids[-1] AS last_fact, md5(array_to_string(ids, '|')) AS digest FROM g"""
)
def rule_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of each kind and action as one sorted set: its ends, size and digest."""
    rows = narration(spark, sf_dir).select("kind", F.col("fields")["action"].alias("action"), "event_id")
    by = rows.groupBy("kind", "action").agg(F.sort_array(F.collect_set("event_id")).alias("ids"))
    return by.select("kind", "action", F.size("ids").cast("long").alias("n_facts"), F.get("ids", 0).alias("first_fact"), F.element_at("ids", -1).alias("last_fact"), F.md5(F.array_join("ids", "|").cast("binary")).alias("digest"))


@query(
    _PARENTS.replace("WITH oc", "WITH " + with_tables("ev", "gr")[5:].strip() + ", oc", 1)
    + """, u AS (SELECT e AS replay_id, id, a AS t, 0 AS p FROM e0 UNION ALL SELECT replay_id, event_id, start_time, 1 FROM ev UNION ALL SELECT replay_id, timeline_id, start_time, 2 FROM gr), k(name) AS (VALUES ('fact stated twice'), ('relation of unknown fact'), ('two parents'), ('adjacency as cause'), ('fact without time'), ('parent after child by more than two seconds'), ('confidence out of range'))
SELECT name AS "check", CASE name WHEN 'fact stated twice' THEN (SELECT count(*) FROM (SELECT id, p FROM u GROUP BY ALL HAVING count(*) > 1)) WHEN 'relation of unknown fact' THEN (SELECT count(*) FROM parents WHERE source NOT IN (SELECT id FROM e0) OR target NOT IN (SELECT id FROM e0))
  WHEN 'fact without time' THEN (SELECT count(*) FROM u WHERE t IS NULL) WHEN 'two parents' THEN (SELECT count(*) FROM (SELECT target FROM parents GROUP BY 1 HAVING count(*) > 1)) WHEN 'confidence out of range' THEN (SELECT count(*) FROM parents WHERE NOT confidence BETWEEN 0 AND 1) WHEN 'parent after child by more than two seconds' THEN (SELECT count(*) FROM parents WHERE gap < -2) ELSE 0 END AS violations FROM k"""
)
def fact_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of facts and relations, with the number of violations."""
    events = cut_lineage(narration(spark, sf_dir))
    edges = cut_lineage(_edges(spark, sf_dir, events))
    part = lambda d, i, t, p: d.select(F.col(i).alias("id"), F.col(t).alias("t"), F.lit(p).alias("p"))
    every = part(events, "event_id", "start", 0).unionByName(part(tables.events(spark, sf_dir), "event_id", "start_time", 1)).unionByName(part(tables.groups(spark, sf_dir), "timeline_id", "start_time", 2))
    ends = edges.select("source", "target", F.explode(F.array("source", "target")).alias("end"))
    return quality.report(
        {
            "fact stated twice": quality.unique(every, ["id", "p"]),
            "relation of unknown fact": quality.orphans(ends, "end", events, "event_id").select("source", "target").distinct(),
            "two parents": quality.unique(edges, ["target"]),
            "adjacency as cause": edges.where("causal AND relation = 'TEMPORALLY_ADJACENT'"),
            "fact without time": every.where("t IS NULL"),
            "parent after child by more than two seconds": quality.broken(edges, F.col("gap") >= -2),
            "confidence out of range": quality.broken(edges, F.col("confidence").between(0, 1)),
        }
    )


# --- readings against lists, consensus, boxes ----------------------------------


@query()
def cluster_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus of similar names read on one track; order-dependent, so tested against one pass."""
    return facts.cluster_consensus(tables.hp(spark, sf_dir), [*SOURCE, "track_id"], "observation_id", "identity_text", "confidence", "frame_ordinal")


def _menu_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``request_id, place, token``: CJK words of each line of a menu reading, in order."""
    rows = tables.ocr(spark, sf_dir).where("role = 'move_menu'")
    texts = F.when(F.size("lines") > 0, F.transform("lines", lambda x: x["text"])).otherwise(F.array("raw_text"))
    words = F.flatten(F.transform(F.filter(texts, lambda t: t.isNotNull()), lambda t: tx.cjk_tokens(t)))
    return rows.select("request_id", F.posexplode(words).alias("place", "token"))


def _moves(spark: SparkSession, sf_dir: str) -> list[str]:
    """The names of moves: a reference list, fixed and checked to be small."""
    rows = read(spark, sf_dir, "match_reference").where("kind = 'move' AND zh_tw IS NOT NULL").select("zh_tw").distinct().limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("the list of moves is too long to be held by each task")
    return sorted(r.zh_tw for r in rows)


@query()
def lexicon_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of menus with the move that they are: the same, or like it by .66 of matching blocks; tested against brute force."""
    words = _menu_tokens(spark, sf_dir).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return words.withColumn("m", tx.lexicon_match(F.col("token"), _moves(spark, sf_dir))).select("token", "n", "m.*")


@query()
def visible_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to four moves of each menu reading, each once, in order; words beyond seven characters must be in the list."""
    rows = _menu_tokens(spark, sf_dir)
    known = rows.select("token").distinct().withColumn("m", tx.lexicon_match(F.col("token"), _moves(spark, sf_dir)))
    rows = rows.join(known, "token").withColumn("value", F.coalesce("m.name", "token")).where("m.name IS NOT NULL OR length(token) <= 7")
    first = rows.groupBy("request_id", "value").agg(F.min("place").alias("place"))
    return first.groupBy("request_id").agg(F.array_join(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]), 1, 4), "|").alias("moves"))


_BOXES = [("team_preview", 96, 120, 431, 803, 6, True, 0.07, 0.13), ("status", 55, 901, 733, 141, 2, False, 0.0, 0.0), ("menu", 1200, 400, 517, 601, 4, True, 0.0, 0.0)]


@query(
    "WITH b(name, x, y, w, h, n, down, top, bottom) AS (VALUES "
    + ", ".join(f"('{b[0]}', {b[1]}, {b[2]}, {b[3]}, {b[4]}, {b[5]}, {str(b[6]).lower()}, {b[7]}::DOUBLE, {b[8]}::DOUBLE)" for b in _BOXES)
    + """), m AS (SELECT *, CAST(round_even((CASE WHEN down THEN h ELSE w END) * top, 0) AS INT) AS t, CAST(round_even((CASE WHEN down THEN h ELSE w END) * bottom, 0) AS INT) AS u, unnest(range(0, n)) AS i FROM b),
e AS (SELECT *, (CASE WHEN down THEN h ELSE w END) - t - u AS room FROM m), f AS (SELECT *, t + CAST(round_even(i * room / n, 0) AS INT) AS lo, t + CAST(round_even((i + 1) * room / n, 0) AS INT) AS hi FROM e)
SELECT name || ':slot' || (i + 1) AS slot, CASE WHEN down THEN x ELSE x + lo END AS x, CASE WHEN down THEN y + lo ELSE y END AS y, CASE WHEN down THEN w ELSE hi - lo END AS width, CASE WHEN down THEN hi - lo ELSE h END AS height FROM f"""
)
def derived_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes cut into slots, with margins left out."""
    rows = spark.createDataFrame(_BOXES, "name string, x int, y int, w int, h int, n int, down boolean, top double, bottom double")
    return rows.select("name", F.explode(sc.slots(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("n"), F.col("down"), F.col("top"), F.col("bottom"))).alias("s")).select(F.concat(F.col("name"), F.lit(":slot"), F.col("s.no").cast("string")).alias("slot"), "s.x", "s.y", "s.width", "s.height")


@query(
    with_tables("ev", "fr")
    + """, t AS (SELECT replay_id, event_id, type, start_time FROM ev WHERE type IN ('TEAM_PREVIEW', 'RESULT')),
c AS (SELECT event_id, sample_index, candidate_scores[type] AS score FROM t JOIN fr ON fr.replay_id = t.replay_id AND pts BETWEEN start_time - 0.5 AND start_time + 0.5 WHERE candidate_scores IS NOT NULL)
SELECT event_id, arg_max(sample_index, struct_pack(s := score, o := -sample_index)) AS sample_index, max(score) AS score, count(*) AS n FROM c GROUP BY 1"""
)
def anchor_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample within half a second of a candidate's start that shows it best; ties to the earlier."""
    marks = tables.events(spark, sf_dir).where("type IN ('TEAM_PREVIEW', 'RESULT')").select("replay_id", "event_id", "type", (F.col("start_time") - 0.5).alias("s"), (F.col("start_time") + 0.5).alias("e"))
    rows = tables.frames(spark, sf_dir).where("candidate_scores IS NOT NULL").select("replay_id", "sample_index", "pts", "candidate_scores")
    best = selection.interval_frames(marks, rows, ["replay_id"], ("s", "e"), "event_id", "pts", "sample_index", "candidate_scores", kind="type")
    scored = best.join(marks.select("event_id", "replay_id", "type"), "event_id").join(rows.select("replay_id", F.col("sample_index").alias("peak_pos"), "candidate_scores"), ["replay_id", "peak_pos"])
    return scored.select("event_id", F.col("peak_pos").alias("sample_index"), F.col("candidate_scores")[F.col("type")].alias("score"), "n")


@query(
    """WITH d AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '"([A-Za-z_]+)" *:', 1), lambda k: lower(k))) AS keys FROM documents WHERE kind = 'json' AND text IS NOT NULL)
SELECT doc_id, len(keys) AS n_keys, len(list_filter(keys, lambda k: contains(k, 'seq'))) > 0 AS forbidden FROM d"""
)
def forbidden_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of objects with how many keys they use and whether one of them, at any depth, is of a kind not allowed."""
    docs = read(spark, sf_dir, "documents").where("kind = 'json' AND text IS NOT NULL")
    keys = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit('"([A-Za-z_]+)" *:'), 1), F.lower))
    return docs.select("doc_id", F.size(keys).cast("long").alias("n_keys"), F.exists(keys, lambda k: k.contains("seq")).alias("forbidden"))


@query(
    with_tables("hp")
    + """, o AS (SELECT DISTINCT replay_id, side, slot, identity_text, species_id, visual_identity FROM hp), x AS (SELECT *, row_number() OVER (PARTITION BY replay_id, side, slot ORDER BY identity_text NULLS LAST, species_id NULLS LAST, visual_identity NULLS LAST) AS r FROM o)
SELECT a.replay_id, a.side, a.slot, count(*) AS n_pairs, count(*) FILTER (CASE WHEN a.species_id IS NOT NULL AND b.species_id IS NOT NULL THEN a.species_id = b.species_id ELSE coalesce("""
    + f"{_KEY.format('a.identity_text')} = {_KEY.format('b.identity_text')} AND {_KEY.format('a.identity_text')} <> ''"
    + """, false) END) AS n_same FROM x a JOIN x b ON a.replay_id = b.replay_id AND a.side = b.side AND a.slot = b.slot AND b.r = a.r + 1 GROUP BY ALL"""
)
def same_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours, in order, among the distinct identities read in a slot, and how many of them are one and the same."""
    rows = tables.hp(spark, sf_dir).select(*SOURCE, "identity_text", "species_id", "visual_identity").distinct()
    rows = rows.withColumn("o", F.struct(F.col("identity_text").isNull(), "identity_text", F.col("species_id").isNull(), "species_id", F.col("visual_identity").isNull(), "visual_identity"))
    by = rows.groupBy(*SOURCE).agg(F.sort_array(F.collect_list("o")).alias("a"))
    pairs = by.select(*SOURCE, F.explode(F.when(F.size("a") > 1, F.arrays_zip(F.slice("a", 1, F.size("a") - 1).alias("l"), F.slice("a", 2, F.size("a") - 1).alias("r")))).alias("p"))
    none = F.lit(None).cast("string")
    same = facts.same_identity((none, none), (F.col("p.l.species_id"), F.col("p.r.species_id")), (F.col("p.l.identity_text"), F.col("p.r.identity_text")))
    return pairs.groupBy(*SOURCE).agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(same).alias("n_same"))
