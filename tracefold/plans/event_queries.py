"""Queries of text parsing, correlation, grouping, votes, folds and state."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions import text as tx
from tracefold.operators import correlate, machines, state, text_machine, voting
from tracefold.operators.sequence import lagged
from tracefold.plans import tables
from tracefold.plans.fixed_values import BARRIERS, BATCH_RULES, COMPLETENESS, FACTORS, LEAST_GAP, LINK_FROM, LOOK_BACK, NARRATION, RELATIONS, REQUIRED, SINGLES, STAGE_BOUNDS, STANDALONE, STATES, STATS
from tracefold.plans.tables import with_tables
from tracefold.session import cut_lineage

QUERIES: dict = {}
SQL: dict[str, str] = {}
SOURCE = ["replay_id", "side", "slot"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- text features -----------------------------------------------------------

_NARROW = f"translate(raw_text, '{tx.WIDE}', '{tx.NARROW}')"
# Compatibility forms of one character, by rule; the only longer one in the tables is that of the ellipsis.
_SINGLE = [(chr(c), n) for c in range(0x80, 0x30000) if len(n := unicodedata.normalize("NFKC", chr(c))) == 1 and n != chr(c)]
_COMPAT = "nfc_normalize(translate(replace(raw_text, '…', '...'), '{}', '{}'))".format(*("".join(x).replace("'", "''") for x in zip(*_SINGLE)))
_BARE = f"regexp_replace(regexp_replace({_COMPAT}, '{tx.INKLESS}', '', 'g'), '{tx.BLANKS}', '', 'g')"
_LINES = f"regexp_replace(regexp_replace({_BARE}, '[\\r\\n]+', chr(10), 'g'), '^\\n+|\\n+$', '', 'g')"
_COMPACT = f"replace({_LINES}, chr(10), '')"
_CJK = tx.CJK


@query(
    with_tables("oc")
    + f"""SELECT request_id, CAST(length(regexp_replace(raw_text, '{tx.NOT_CJK}', '', 'g')) AS INT) AS n_cjk,
CAST(len(list_filter(string_split(raw_text, chr(10)), lambda x: trim(x) <> '')) AS INT) AS n_lines, {_COMPACT} AS compacted,
translate(raw_text, '{tx.PUNCTUATION.replace("'", "''")}', '') AS plain, regexp_replace({_COMPACT}, '[!。.!]+$', '') AS bare FROM oc WHERE raw_text IS NOT NULL"""
)
def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("raw_text")
    rows = tables.ocr(spark, sf_dir).where(c.isNotNull())
    return rows.select("request_id", tx.cjk_count(c).alias("n_cjk"), tx.line_count(c).alias("n_lines"), tx.compact(c).alias("compacted"), tx.comparable(c).alias("plain"), tx.strip_terminal(tx.compact(c)).alias("bare"))


_A, _B = (f"nullif(regexp_extract({_NARROW}, '([0-9]{{1,6}}) */ *([0-9]{{1,6}})', {i}), '')::INT" for i in (1, 2))
_PCT = f"nullif(regexp_extract({_NARROW}, '([0-9]{{1,3}}) *%', 1), '')::INT"
_WORDS = " ".join(f"WHEN contains(raw_text, '{w}') THEN '{w}'" for w in tx.STATUS_WORDS)
_NAMES = f"regexp_extract_all(regexp_replace(regexp_replace(raw_text, '[0-9/% ]+', ' ', 'g'), '{'|'.join(tx.STATUS_WORDS)}', ' ', 'g'), '{_CJK}{{2,8}}')"


@query(
    with_tables("oc")
    + f""", p AS (SELECT request_id, {_A} AS a, {_B} AS b, {_PCT} AS pct, CASE {_WORDS} END AS status_word, {_NAMES} AS names,
  list_distinct(regexp_extract_all(raw_text, '[1234]')) AS marks FROM oc WHERE raw_text IS NOT NULL AND role = 'status_sample')
SELECT request_id, CASE WHEN a <= b AND b > 0 THEN a::DOUBLE END AS current_hp, CASE WHEN a <= b AND b > 0 THEN b::DOUBLE END AS max_hp, CASE WHEN pct <= 100 THEN pct::DOUBLE END AS percent, status_word,
list_filter(names, lambda x: length(x) = list_min(list_transform(names, lambda y: length(y))))[1] AS name, CASE WHEN len(marks) = 1 THEN marks[1]::DOUBLE END AS marker FROM p"""
)
def reading_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("raw_text")
    rows = tables.ocr(spark, sf_dir).where("raw_text IS NOT NULL AND role = 'status_sample'")
    exact = tx.exact_fraction(c)
    return rows.select("request_id", exact["current"].cast("double").alias("current_hp"), exact["most"].cast("double").alias("max_hp"), tx.percentage(c).alias("percent"), tx.status_word(c).alias("status_word"), tx.shortest_name(c).alias("name"), tx.single_marker(c).cast("double").alias("marker"))


def _parts_sql(phrase: str) -> str:
    return f"regexp_split_to_array(regexp_replace(regexp_replace(trim({phrase}), '[!！。.?？]+$', ''), '^{tx.NOT_CJK}+({_CJK})', '\\1'), '[和、]')"


def _names_sql(phrase: str) -> str:
    return f"list_filter(list_transform({_parts_sql(phrase)}, lambda x: regexp_replace(trim(regexp_replace(x, '^對手的', '')), '的+$', '')), lambda x: x <> '')"


def _side_sql(phrase: str) -> str:
    return f"CASE WHEN list_bool_or(list_transform({_parts_sql(phrase)}, lambda x: starts_with(x, '對手的'))) THEN 'opponent' END"


@query(with_tables("pr") + f", p AS (SELECT candidate_id, {_COMPACT} AS t FROM pr WHERE raw_text IS NOT NULL) SELECT candidate_id, {_side_sql('t')} AS side, array_to_string({_names_sql('t')}, '|') AS names FROM p")
def subject_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tx.subjects(tx.compact(F.col("raw_text")))
    return tables.lines(spark, sf_dir).where("raw_text IS NOT NULL").select("candidate_id", s["side"].alias("side"), F.array_join(s["names"], "|").alias("names"))


@query(
    "SELECT entry_id, round_even(1 - levenshtein(lower(en), showdown_id) / greatest(length(en), length(showdown_id)), 6) AS edit, CASE WHEN length(en) > 8 THEN en[1:7] || '…' ELSE en END AS short FROM match_reference"
)
def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/match_reference.parquet")
    return rows.select("entry_id", F.bround(tx.edit_similarity(F.lower("en"), F.col("showdown_id")), 6).alias("edit"), tx.ellipsize(F.col("en"), 8).alias("short"))


@query()
def name_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching-blocks ratio and weighted similarity of the two Latin names; tested against brute force."""
    rows = spark.read.parquet(f"{sf_dir}/match_reference.parquet")
    key = tx.alias_key(F.col("en"))
    return rows.select("entry_id", F.bround(tx.ratio(F.lower("en"), F.col("showdown_id")), 6).alias("ratio"), F.bround(tx.similarity(F.lower("en"), F.col("showdown_id")), 6).alias("similarity"), (key == F.col("showdown_id")).alias("same_key"))


@query(
    """WITH r AS (SELECT kind, entry_id, lower(regexp_replace(unnest([zh_tw, en, showdown_id]), '[^\\p{L}\\p{N}]', '', 'g')) AS alias FROM match_reference)
SELECT kind, alias, count(DISTINCT entry_id) AS n_entries, min(entry_id) AS entry_id FROM r GROUP BY ALL"""
)
def alias_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/match_reference.parquet").select("kind", "entry_id", F.explode(F.array("zh_tw", "en", "showdown_id")).alias("name"))
    named = rows.select("kind", "entry_id", F.lower(F.regexp_replace("name", r"[^\p{L}\p{N}]", "")).alias("alias"))
    return named.groupBy("kind", "alias").agg(F.countDistinct("entry_id").alias("n_entries"), F.min("entry_id").alias("entry_id"))


@query("SELECT unnest(types) AS type, count(*) AS n, count(*) FILTER (kind = 'species') AS n_species, count(*) FILTER (kind = 'move') AS n_moves FROM match_reference GROUP BY 1")
def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/match_reference.parquet").select("kind", F.explode("types").alias("type"))
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "species").alias("n_species"), F.count_if(F.col("kind") == "move").alias("n_moves"))


# --- ordered rules -----------------------------------------------------------

_RULE = "CASE " + " ".join(f"WHEN {'gate = ' + repr(r.gate[0]) + ' AND ' if r.gate else ''}regexp_full_match(t, '{r.pattern}') THEN '{r.name}'" for r in NARRATION) + " END"
_KIND = "CASE rule " + " ".join(f"WHEN '{r.name}' THEN '{r.kind}'" for r in NARRATION) + " ELSE 'UNKNOWN_EVENT' END"


@query(with_tables("pr") + f", c AS (SELECT *, {_COMPACT} AS t, input_event_type AS gate FROM pr), p AS (SELECT *, {_RULE} AS rule FROM c) SELECT candidate_id, rule, {_KIND} AS kind, {_KIND} = expected_type AS agrees FROM p WHERE raw_text IS NOT NULL")
def narration_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.lines(spark, sf_dir).where("raw_text IS NOT NULL")
    got = tx.first_match(tx.compact(F.col("raw_text")), F.col("input_event_type"), NARRATION, "UNKNOWN_EVENT")
    return rows.withColumn("got", got).select("candidate_id", "got.rule", "got.kind", (F.col("got.kind") == F.col("expected_type")).alias("agrees"))


def narration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read from the narration lines: one point in time each, with what they state (see ``text.stated``)."""
    rows = tables.ocr(spark, sf_dir).where("role = 'battle_text' AND raw_text IS NOT NULL AND pts IS NOT NULL")
    rows = rows.select("replay_id", F.col("request_id").alias("event_id"), F.col("pts").alias("start"), F.col("pts").alias("end"), "confidence", F.upper("role").alias("_gate"), tx.clean_lines(F.col("raw_text")).alias("_lines"))
    said = tx.stated(rows, "_lines", F.col("_gate"), NARRATION, "UNKNOWN_EVENT", SINGLES)
    return said.withColumn("confidence", F.least("confidence", "rule_confidence")).drop("_gate", "_lines", "rule_confidence")


def _group_sql(*names: str) -> str:
    """A named group of the rule's pattern, from ``t``; null where it is empty."""
    cases = [f"WHEN '{r.name}' THEN regexp_extract(t, '^(?:{r.pattern})$', {r.groups.index(n) + 1})" for r in NARRATION for n in names if n in r.groups]
    return f"nullif(trim(CASE rule {' '.join(cases)} END), '')"


# What each line states, written out for the SQL independently of the rule table's own metadata.
_ACTORS = "('move.used', 'item.activated', 'ability.activated', 'move_result.helping_hand', 'transformation.activated', 'transformation.completed')"
_SAID = {
    "actor": "CASE WHEN len(an) = 1 THEN an[1] WHEN len(gn) = 1 THEN gn[1] END",
    "target": "CASE WHEN len(tn) = 1 THEN tn[1] ELSE dn[1] END",
    "side": "coalesce(a_side, t_side, s_side, d_side, CASE WHEN rule = 'side_condition.tailwind_started' THEN CASE WHEN g_whose = '對手' THEN 'opponent' ELSE 'player' END WHEN rule = 'side_condition.tailwind_ended' THEN CASE WHEN g_whose = '對手的' THEN 'opponent' ELSE 'player' END END)",
    **{n: f"g_{n}" for n in ("move", "ability", "item", "trainer", "status", "stat", "weather", "terrain", "counter", "form", "device", "loser")},
    "cause": "CASE rule WHEN 'status.damage' THEN 'status' WHEN 'damage.recoil' THEN 'recoil' WHEN 'damage.hp_loss' THEN 'unspecified' END",
    "direction": "CASE WHEN rule = 'stat.changed' THEN CASE WHEN contains(g_change, '提高') THEN 'raise' ELSE 'lower' END END",
    "magnitude": "CASE WHEN rule = 'stat.changed' THEN CASE WHEN contains(g_change, '大幅') THEN '2' ELSE '1' END END",
    "effect": "CASE rule WHEN 'field.activated' THEN '滅亡之歌' WHEN 'side_condition.tailwind_started' THEN '順風' WHEN 'side_condition.tailwind_ended' THEN '順風' WHEN 'volatile.counter_updated' THEN '滅亡計時' WHEN 'volatile.effect_ended' THEN replace(g_ended, '狀態', '') WHEN 'volatile.protect_started' THEN '守住' WHEN 'volatile.encore_started' THEN '再來一次' WHEN 'move_result.protected' THEN '守住' WHEN 'volatile.move_disabled' THEN '定身法' WHEN 'move_result.prevented' THEN '定身法' WHEN 'transformation.completed' THEN 'form_change' END",
    "result": "CASE rule WHEN 'move_result.helping_hand' THEN 'helping_hand_ready' WHEN 'move_result.critical' THEN 'critical_hit' WHEN 'battle_result.forfeit' THEN 'forfeit' WHEN 'battle_result.win' THEN 'win' ELSE CASE WHEN kind = 'MOVE_RESULT' THEN split_part(rule, '.', 2) END END",
    "action": "CASE rule WHEN 'move.used' THEN 'use' WHEN 'faint.fell' THEN 'faint' WHEN 'status.inflicted' THEN 'inflict' WHEN 'stat.changed' THEN 'change' WHEN 'move_result.helping_hand' THEN 'prepare' WHEN 'move_result.protected' THEN 'block' WHEN 'volatile.move_disabled' THEN 'apply' WHEN 'volatile.counter_updated' THEN 'update' WHEN 'volatile.effect_ended' THEN 'end' WHEN 'transformation.completed' THEN 'change' WHEN 'weather.ended' THEN 'end' WHEN 'weather.started' THEN 'start' WHEN 'side_condition.tailwind_started' THEN 'start' WHEN 'side_condition.tailwind_ended' THEN 'end' WHEN 'volatile.protect_started' THEN 'start' WHEN 'volatile.encore_started' THEN 'start' WHEN 'terrain.changed' THEN CASE WHEN g_verb IN ('消失', '結束', '恢復原狀') THEN 'end' ELSE 'start' END ELSE CASE kind WHEN 'SWITCH' THEN 'switch_in' WHEN 'DAMAGE_RESULT' THEN 'damage' WHEN 'MOVE_RESULT' THEN 'resolve' WHEN 'BATTLE_RESULT' THEN 'end' ELSE 'activate' END END",
}
_GROUPS = ("move", "ability", "item", "trainer", "status", "stat", "weather", "terrain", "counter", "form", "device", "loser", "change", "verb", "whose", "ended", "sent", "aided")
_GO = "list_filter(flatten(list_transform(string_split(regexp_replace(l, '^上吧[!！]', ''), chr(10)), lambda x: regexp_split_to_array(regexp_replace(trim(x), '[!！。.?？]+$', ''), '[和、]'))), lambda x: x <> '')"


_CONF = "CASE rule " + " ".join(f"WHEN '{r.name}' THEN {r.confidence}::DOUBLE" for r in NARRATION) + " END"
_EVENTS = with_tables("oc") + f""", c0 AS (SELECT *, upper(role) AS gate, {_LINES} AS l FROM oc WHERE role = 'battle_text' AND raw_text IS NOT NULL AND pts IS NOT NULL),
c1 AS (SELECT *, replace(l, chr(10), '') AS t FROM c0),
p0 AS (SELECT *, {_RULE} AS rule FROM c1),
p1 AS (SELECT *, {_KIND} AS kind, {_group_sql("subject", "subjects", "target")} AS who, {", ".join(f"{_group_sql(n)} AS g_{n}" for n in _GROUPS)} FROM p0 WHERE rule IS NOT NULL),
p2 AS (SELECT *, CASE WHEN rule IN {_ACTORS} THEN who END AS ap, CASE WHEN rule NOT IN {_ACTORS} THEN who END AS tp FROM p1),
p3 AS (SELECT *, {_names_sql("ap")} AS an, {_names_sql("tp")} AS tn, {_names_sql("g_sent")} AS sn, {_names_sql("g_aided")} AS dn, CASE WHEN rule = 'switch.go' THEN {_GO} END AS gn,
  {_side_sql("ap")} AS a_side, {_side_sql("tp")} AS t_side, {_side_sql("g_sent")} AS s_side, {_side_sql("g_aided")} AS d_side FROM p2),
e0 AS (SELECT replay_id AS e, request_id AS id, pts AS a, kind, rule, least(confidence, {_CONF}) AS c, {", ".join(f"nullif(trim({_SAID[n]}), '') AS {n}" for n in SINGLES)},
  CASE WHEN len(an) > 1 THEN an WHEN len(tn) > 1 THEN tn WHEN rule = 'switch.sent_out' THEN sn WHEN rule = 'switch.go' THEN gn ELSE [] END AS targets FROM p3),
n0 AS (SELECT *, row_number() OVER w AS seq, CASE WHEN kind IN {BARRIERS} THEN 1 ELSE 0 END AS is_bar,
  sum(CASE WHEN kind IN {BARRIERS} THEN 1 ELSE 0 END) OVER (PARTITION BY e ORDER BY a, id ROWS UNBOUNDED PRECEDING) AS bars FROM e0 WINDOW w AS (PARTITION BY e ORDER BY a, id)),
pairs AS MATERIALIZED (SELECT s AS s, t AS t, t.a - s.a AS gap, t.bars - t.is_bar - s.bars AS between_ FROM n0 s JOIN n0 t ON s.e = t.e AND s.seq < t.seq AND t.a - s.a BETWEEN {LEAST_GAP} AND {LOOK_BACK})"""


def _list(side: str, key: str) -> str:
    names = ("actor", "target") if key == "participants" else (key,)
    one = f"[{', '.join(f'{side}.{n}' for n in names)}]"
    every = f"list_concat({one}, {side}.targets)" if key in ("participants", "target") else one
    return f"list_filter({every}, lambda x: x IS NOT NULL)"


def _rule_sql(i: int, rule: tuple) -> str:
    name, source, target, most, required, optional, relation, base, barred, mode, s_if, t_if = rule
    where = [f"s.kind = '{source}'", f"t.kind IN ({', '.join(repr(k) for k in target)})", f"gap <= {most}"]
    where += ["between_ <= 0"] if barred else []
    where += [f"{side}.{k} = '{v}'" for side, pairs in (("s", s_if), ("t", t_if)) for k, v in pairs]
    where += [f"list_has_any({_list('s', x)}, {_list('t', y)})" for x, y in required]
    bonus = ["0"]
    for x, y in optional:
        a, b = _list("s", x), _list("t", y)
        where.append(f"(len({a}) = 0 OR len({b}) = 0 OR list_has_any({a}, {b}))")
        bonus.append(f"list_has_any({a}, {b})::INT")
    return f"SELECT s.e AS replay_id, s.id AS source, t.id AS target, '{name}' AS rule, {i} AS rule_order, '{relation}' AS relation, '{mode}' AS mode, round_even((0.8::DOUBLE * least(0.99::DOUBLE, {base}::DOUBLE + 0.02::DOUBLE * ({' + '.join(bonus)})) + 0.2::DOUBLE * least(s.c, t.c)), 6) AS confidence, round_even(gap, 6) AS gap FROM pairs WHERE " + " AND ".join(where)


_PROPOSALS = _EVENTS + ", proposals AS (" + " UNION ALL ".join(_rule_sql(i, r) for i, r in enumerate(RELATIONS)) + ")"
_PARENTS = _PROPOSALS + f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY mode <> 'link', confidence DESC, rule_order, source) AS r FROM proposals WHERE mode = 'review' OR confidence >= {LINK_FROM}),
parents AS (SELECT * FROM ranked WHERE r = 1)"""
_ROOTS = _PARENTS.replace("WITH ", "WITH RECURSIVE ", 1) + """, links AS (SELECT target AS child, source AS parent FROM parents WHERE mode = 'link'),
up AS (SELECT child AS node, parent AS top FROM links UNION ALL SELECT up.node, links.parent FROM up JOIN links ON up.top = links.child),
found AS (SELECT node, top AS root FROM up WHERE top NOT IN (SELECT child FROM links))"""


def _proposals(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """``events``: the narration with its lineage cut, where the caller has it."""
    rows = narration(spark, sf_dir) if events is None else events
    return correlate.proposals(rows, RELATIONS, "replay_id", "start", "end", "event_id", "kind", "fields", "confidence", BARRIERS, LOOK_BACK, LEAST_GAP, "targets", events is not None)


@query(_EVENTS + f"SELECT e AS replay_id, id AS event_id, rule, kind, {', '.join(SINGLES)}, array_to_string(targets, '|') AS targets, round_even(c, 6) AS confidence FROM e0")
def narration_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narration(spark, sf_dir).select("replay_id", "event_id", "rule", "kind", *[F.col("fields")[k].alias(k) for k in SINGLES], F.array_join("targets", "|").alias("targets"), F.bround("confidence", 6).alias("confidence"))


@query(_PROPOSALS + "SELECT replay_id, source, target, rule, mode, confidence, gap FROM proposals")
def lookback_rule_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _proposals(spark, sf_dir).select("replay_id", "source", "target", "rule", "mode", "confidence", "gap")


@query(_PARENTS + "SELECT target, source, rule, mode, confidence FROM parents")
def best_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.best_parent(_proposals(spark, sf_dir), LINK_FROM).select("target", "source", "rule", "mode", "confidence")


@query(_ROOTS.replace("FROM parents WHERE mode = 'link'", "FROM parents") + "SELECT node, root FROM found UNION SELECT DISTINCT parent, parent FROM links WHERE parent NOT IN (SELECT child FROM links)")
def parent_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots over all best edges, those for review included."""
    links = correlate.best_parent(_proposals(spark, sf_dir), LINK_FROM)
    return correlate.roots(links.select(F.col("target").alias("child"), F.col("source").alias("parent")))


@query(
    _ROOTS
    + """, m AS (SELECT e0.*, coalesce(found.root, id) AS root FROM e0 LEFT JOIN found ON id = node),
x AS (SELECT p.*, a.root AS sr, b.root AS tr FROM parents p JOIN m a ON p.source = a.id JOIN m b ON p.target = b.id),
y AS (SELECT sr AS root, confidence, sr <> tr AS open FROM x UNION ALL SELECT tr, confidence, sr <> tr FROM x WHERE sr <> tr),
z AS (SELECT root, min(confidence) AS ec, max(open::INT) AS open FROM y GROUP BY 1),
g AS (SELECT e AS replay_id, root, count(*) AS n_events, min(a) AS start_time, max(a) AS end_time, min(c) AS c, array_to_string(list(kind ORDER BY a, id), '>') AS kinds FROM m GROUP BY ALL)
SELECT replay_id, g.root, n_events, round_even(start_time, 6) AS start_time, round_even(end_time, 6) AS end_time, round_even(coalesce(ec, c), 6) AS confidence, kinds,
CASE open WHEN 1 THEN 'needs_review' WHEN 0 THEN 'linked' ELSE 'alone' END AS status FROM g LEFT JOIN z ON g.root = z.root"""
)
def group_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = cut_lineage(narration(spark, sf_dir))
    parents = correlate.best_parent(_proposals(spark, sf_dir, events), LINK_FROM)
    out = correlate.grouped(events, parents, "replay_id", "start", "end", "event_id", "kind", "confidence")
    return out.select("replay_id", "root", "n_events", F.bround("start", 6).alias("start_time"), F.bround("end", 6).alias("end_time"), "confidence", F.array_join("kinds", ">").alias("kinds"), "status")


def stands_alone(kind, fields):
    """Whether an event needs no parent: a major one, an independent one, damage of a status, an effect's update or end."""
    return kind.isin(*STANDALONE) | F.coalesce((kind == "DAMAGE_RESULT") & (fields["cause"] == "status"), F.lit(False)) | F.coalesce((kind == "VOLATILE_STATUS") & fields["action"].isin("update", "end"), F.lit(False))


_GROUPED = _ROOTS + f""", m AS (SELECT e0.*, coalesce(found.root, id) AS root FROM e0 LEFT JOIN found ON id = node),
x AS (SELECT p.*, a.root AS sr, b.root AS tr FROM parents p JOIN m a ON p.source = a.id JOIN m b ON p.target = b.id),
y AS (SELECT sr AS root, sr <> tr AS open, rule FROM x UNION ALL SELECT tr, sr <> tr, rule FROM x WHERE sr <> tr),
z AS (SELECT root, max(open::INT) AS open, bool_and(rule IN {BATCH_RULES}) FILTER (NOT open) AS batch FROM y GROUP BY 1),
f AS (SELECT DISTINCT ON (root) root, kind, cause, action FROM m ORDER BY root, a, id),
g AS (SELECT e AS replay_id, root, count(*) AS n_events FROM m GROUP BY ALL)"""


@query(
    _GROUPED
    + f""", s AS (SELECT g.*, f.kind, CASE WHEN open = 1 THEN 'needs_review' WHEN open = 0 THEN 'auto_accepted'
  WHEN f.kind IN {STANDALONE} OR (f.kind = 'DAMAGE_RESULT' AND cause = 'status') OR (f.kind = 'VOLATILE_STATUS' AND action IN ('update', 'end')) THEN 'auto_accepted' ELSE 'unlinked' END AS review_status, batch
  FROM g JOIN f USING (root) LEFT JOIN z ON z.root = g.root)
SELECT replay_id, root, n_events, review_status, CASE WHEN review_status = 'unlinked' THEN 'UNLINKED_EVENT' WHEN n_events > 1 THEN CASE WHEN batch THEN 'EVENT_BATCH' ELSE 'ACTION_CHAIN' END
  WHEN kind IN {BARRIERS} THEN 'STANDALONE_ACTION' ELSE 'STANDALONE_EVENT' END AS group_type FROM s"""
)
def group_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group with its review status and type."""
    events = cut_lineage(narration(spark, sf_dir))
    parents = correlate.best_parent(_proposals(spark, sf_dir, events), LINK_FROM)
    out = correlate.grouped(events, parents, "replay_id", "start", "end", "event_id", "kind", "confidence", stands_alone(F.col("kind"), F.col("fields")))
    status = F.when(F.col("status") == "needs_review", "needs_review").when((F.col("status") == "linked") | F.col("stands"), "auto_accepted").otherwise("unlinked")
    batch = (F.size("rules") > 0) & F.forall("rules", lambda r: r.isin(*BATCH_RULES))
    kind = F.when(F.col("review_status") == "unlinked", "UNLINKED_EVENT").when((F.col("n_events") > 1) & batch, "EVENT_BATCH").when(F.col("n_events") > 1, "ACTION_CHAIN").when(F.get("kinds", 0).isin(*BARRIERS), "STANDALONE_ACTION").otherwise("STANDALONE_EVENT")
    return out.withColumn("review_status", status).select("replay_id", "root", "n_events", "review_status", kind.alias("group_type"))


# --- votes -------------------------------------------------------------------


@query(
    with_tables("hp")
    + """, v AS (SELECT replay_id, side, slot, track_id, identity_text AS text, frame_ordinal AS moment, confidence AS w FROM hp WHERE length(identity_text) > 0),
c AS (SELECT replay_id, side, slot, track_id, text, moment, max(w) AS w, count(*) AS n FROM v GROUP BY ALL),
t AS (SELECT replay_id, side, slot, track_id, text, count(*) AS moments, avg(w) AS conf, sum(n) AS votes FROM c GROUP BY ALL),
g AS (SELECT replay_id, side, slot, track_id, count(DISTINCT moment) AS all_, count(*) AS n_votes, count(DISTINCT text) AS n_texts FROM v GROUP BY ALL),
s AS (SELECT t.*, all_, n_votes, n_texts, row_number() OVER (PARTITION BY t.replay_id, t.side, t.slot, t.track_id ORDER BY round_even(0.58::DOUBLE * moments / all_ + 0.42::DOUBLE * conf, 9) DESC, text DESC) AS r FROM t JOIN g USING (replay_id, side, slot, track_id))
SELECT replay_id, side, slot, track_id, text AS best_text, round_even(moments / all_, 4) AS support, round_even(1 - votes / n_votes, 4) AS disagreement, n_votes, n_texts FROM s WHERE r = 1"""
)
def consensus_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [*SOURCE, "track_id"]
    out = voting.exact_consensus(tables.hp(spark, sf_dir), keys, "identity_text", "confidence", "frame_ordinal")
    return out.select(*keys, "best_text", F.bround("support", 4).alias("support"), F.bround("disagreement", 4).alias("disagreement"), "n_votes", "n_texts")


@query()
def similar_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy clusters of the names read on one track; order-dependent, so tested against its step function."""
    return voting.similar_clusters(tables.hp(spark, sf_dir), [*SOURCE, "track_id"], "identity_text", "confidence")


@query()
def duplicate_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring narration lines that repeat each other: character distances, which DuckDB counts in bytes."""
    rows = tables.ocr(spark, sf_dir).where("role = 'battle_text' AND pts IS NOT NULL").withColumn("t", tx.compact(F.col("raw_text")))
    out = voting.near_duplicates(rows, ["replay_id"], "pts", "pts", "request_id", "t", tx.similarity, 0.88, (-0.05, 0.8))
    return out.groupBy("replay_id", "group").agg(F.count(F.lit(1)).alias("n"), F.min("pts").alias("start"), F.max("pts").alias("end"))


# --- folds -------------------------------------------------------------------


_LEVELS = "SELECT replay_id, CAST(sample_index AS BIGINT) AS p, battle_text_evidence.evidence_level AS lv FROM fr"


def _hysteresis_sql(levels: str, confirm: int, gap: int) -> str:
    """Runs of samples at most ``gap`` misses apart; the part from the first strong sample, or the first of ``confirm`` weak ones in a row."""
    before = " AND ".join(f"lag(p, {i}) OVER k = p - {i} AND lag(lv, {i}) OVER k = 'weak'" for i in range(1, confirm))
    return f""", a AS ({levels}), s AS (SELECT * FROM a WHERE lv IN ('strong', 'weak', 'continuation')),
j AS (SELECT *, CASE WHEN p - lag(p) OVER k <= {gap + 1} THEN 0 ELSE 1 END AS new, CASE WHEN lv = 'strong' THEN p WHEN lv = 'weak' AND {before} THEN p - {confirm - 1} END AS opens FROM s WINDOW k AS (PARTITION BY replay_id ORDER BY p)),
i AS (SELECT *, sum(new) OVER (PARTITION BY replay_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS no FROM j),
o AS (SELECT replay_id, no, arg_min(opens, p) AS first, arg_min(lv, p) AS how, max(p) FILTER (true) AS _ FROM i WHERE opens IS NOT NULL GROUP BY ALL),
h AS (SELECT i.replay_id, o.first, max(p) AS last, count(*) FILTER (lv <> 'continuation') AS hits, any_value(how) AS how FROM i JOIN o USING (replay_id, no) WHERE p >= o.first GROUP BY i.replay_id, o.first)"""


@query(with_tables("fr") + _hysteresis_sql(_LEVELS, 3, 1) + " SELECT replay_id, first, last, hits, CASE how WHEN 'strong' THEN 'strong' ELSE 'weak_confirmed' END AS reason FROM h")
def hysteresis_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.frames(spark, sf_dir).select("replay_id", "sample_index", F.col("battle_text_evidence.evidence_level").alias("level"))
    return machines.hysteresis_segments(rows, ["replay_id"], "sample_index", "level", machines.Hysteresis(3, 1))


_TRIGGER = "CASE WHEN x >= 0.72 THEN 'strong' WHEN x >= 0.5 THEN 'weak' WHEN x >= 0.499 THEN 'continuation' END"


@query(
    with_tables("fr")
    + _hysteresis_sql(f"SELECT replay_id, CAST(sample_index AS BIGINT) AS p, {_TRIGGER} AS lv FROM (SELECT *, candidate_scores['TRIGGER_NOTIFICATION'] AS x FROM fr)", 2, 1)
    + """, c AS (SELECT h.*, fr.pts, fr.candidate_scores['TRIGGER_NOTIFICATION'] AS x FROM h JOIN fr ON fr.replay_id = h.replay_id AND fr.sample_index BETWEEN h.first AND h.last)
SELECT replay_id, first, last, any_value(hits) AS hits, last - first + 1 AS n_span, round_even(avg(x) FILTER (x >= 0.499), 9) AS confidence, round_even(greatest(0.1, max(pts) - min(pts) + 0.1), 6) AS duration FROM c GROUP BY replay_id, first, last"""
)
def trigger_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices shown: confidence over the samples that show one, length over all of the span."""
    x = F.col("candidate_scores")["TRIGGER_NOTIFICATION"]
    rows = tables.frames(spark, sf_dir).select("replay_id", F.col("sample_index").cast("long").alias("p"), "pts", x.alias("x"), machines.notice_level(x).alias("level"))
    found = machines.hysteresis_segments(rows, ["replay_id"], "p", "level", machines.Hysteresis(2, 1))
    return machines.with_span(found, rows, ["replay_id"], "p", "pts", "x", F.col("level") != "negative", 0.1)


def _shown(spark: SparkSession, sf_dir: str):
    """Frames, and the level, layout and strength that their text evidence gives."""
    e = F.col("battle_text_evidence")
    level = text_machine.evidence_level(e["evidence_level"], F.col("candidate_scores")["BATTLE_TEXT"], F.lit(0.0), STATES["BATTLE_TEXT"])
    none = F.lit(None).cast("array<double>")
    layout = F.struct(e["layout_hash"].alias("hash"), none.alias("rows"), none.alias("columns"), none.alias("box"), e["component_count"].alias("count"))
    rows = tables.frames(spark, sf_dir).select("replay_id", "sample_index", level.alias("level"), layout.alias("layout"))
    return rows, F.col("level"), F.col("layout"), F.lit(0.0)


@query()
def text_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of text shown, split where the layout changes and joined over short obstructions; tested against one pass and by cases."""
    rows, level, layout, strength = _shown(spark, sf_dir)
    return text_machine.text_segments(rows, ["replay_id"], "sample_index", level, layout, strength)


@query()
def text_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples by level and what they did to the segments of text."""
    rows, level, _, _ = _shown(spark, sf_dir)
    made = text_machine.decisions(rows, text_segments(spark, sf_dir), ["replay_id"], "sample_index", level)
    return made.groupBy("level", "decision").agg(F.count(F.lit(1)).alias("n"))


@query()
def deadband_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.hp(spark, sf_dir).withColumn("exact", F.col("value_type") != "visual_bar_estimate")
    return machines.dead_band(rows, SOURCE, ["timestamp", "frame_ordinal"], ["observation_id", "identity_text", "status", "hp", "exact"])


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the narration says about fields of entities, one row for each; ``part`` orders those of one event."""
    f = F.col("fields")
    who, stat = F.col("who"), F.col("stat")
    shift = F.when(f["direction"] == "lower", -f["magnitude"].cast("int")).otherwise(f["magnitude"].cast("int"))
    op = lambda entity, field, how, value: F.struct(entity.alias("entity"), field.alias("field"), F.lit(how).alias("op"), value.cast("string").alias("value"))
    made = (
        F.when(F.col("kind") == "SWITCH", op(who, F.lit("active"), "replace", F.lit("true")))
        .when(F.col("kind") == "FAINT", op(who, F.lit("active"), "replace", F.lit("false")))
        .when(F.col("kind") == "STATUS", op(who, F.lit("status"), "set", f["status"]))
        .when(F.col("kind") == "MOVE", op(who, F.lit("moves"), "add", f["move"]))
        .when(F.col("kind") == "STAT_CHANGE", op(who, F.concat(F.lit("stage."), stat), "shift", shift))
    )
    # a filter on the kind, not on the operation, so that it is not copied into the scan's filter
    rows = narration(spark, sf_dir).where(F.col("kind").isin("SWITCH", "FAINT", "STATUS", "MOVE", "STAT_CHANGE"))
    own = F.when(F.col("kind") == "MOVE", f["actor"]).otherwise(f["target"])
    rows = rows.select("*", F.posexplode(F.when(F.size("targets") > 0, F.col("targets")).otherwise(F.array(own))).alias("place", "who"))
    rows = rows.select("*", F.posexplode(F.when(F.col("kind") == "STAT_CHANGE", tx.stats(f["stat"])).otherwise(F.array(F.lit("")))).alias("_i", "stat")).withColumn("part", F.struct("place", "_i"))
    return rows.withColumn("o", made).select("replay_id", "event_id", "start", "part", "o.*")


@query()
def state_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = state.project(operations(spark, sf_dir), ["replay_id"], ["start", "event_id", "part"], ["event_id", "entity", "field", "op", "value"])
    return made.select("replay_id", "event_id", "seq", "entity", "field", "op", "before", "after", "status")


@query(
    _EVENTS
    + """, w AS (SELECT e AS replay_id, a, id, kind, status, move, direction, magnitude, stat, CASE WHEN len(targets) > 0 THEN targets ELSE [CASE kind WHEN 'MOVE' THEN actor ELSE target END] END AS names FROM e0 WHERE kind IN ('SWITCH', 'FAINT', 'STATUS', 'MOVE', 'STAT_CHANGE')),
v AS (SELECT * EXCLUDE (names, stat), unnest(names) AS entity, CASE WHEN kind = 'STAT_CHANGE' THEN string_split(stat, '、') ELSE [''] END AS stats FROM w),
o AS (SELECT * EXCLUDE (stats), unnest(stats) AS stat FROM v WHERE entity IS NOT NULL),
q AS (SELECT *, CASE kind WHEN 'STATUS' THEN 'status' WHEN 'MOVE' THEN 'moves' WHEN 'STAT_CHANGE' THEN 'stage.' || stat ELSE 'active' END AS field, CASE direction WHEN 'lower' THEN -CAST(magnitude AS INT) ELSE CAST(magnitude AS INT) END AS shift FROM o)
SELECT replay_id, entity, field, CASE any_value(kind) WHEN 'STATUS' THEN '"' || arg_min(status, struct_pack(a, id)) || '"' WHEN 'STAT_CHANGE' THEN CAST(sum(shift) AS VARCHAR)
  WHEN 'MOVE' THEN '[' || array_to_string(list_transform(list_sort(list_distinct(list(move))), lambda x: '"' || x || '"'), ', ') || ']'
  ELSE '"' || CASE arg_max(kind, struct_pack(a, id)) WHEN 'SWITCH' THEN 'true' ELSE 'false' END || '"' END AS value FROM q GROUP BY replay_id, entity, field"""
)
def state_at_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest(state_projection(spark, sf_dir), ["replay_id"])


# --- state of a whole match: entities, fields, deltas, snapshots -----------------

_WHERE = ["replay_id"]


def _place():
    return F.floor(F.col("start") / 600)


def _mentioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event once for each name that it mentions (once without one), and whether it states what it must."""
    f = F.col("fields")
    rows = narration(spark, sf_dir)
    lacks = F.lit(False)
    for kind, names in REQUIRED.items():
        lacks = lacks | ((F.col("kind") == kind) & F.exists(F.array(*[F.lit(n) for n in names]), lambda n: f[n].isNull()))
    lacks = lacks | ((F.col("kind") == "SWITCH") & (F.size("targets") == 0)) | ((F.col("kind") == "STAT_CHANGE") & (F.size("targets") == 0) & f["target"].isNull())
    one = F.when(F.col("kind").isin("TRANSFORMATION", "ABILITY", "ITEM", "MOVE"), f["actor"]).when(F.col("kind").isin("FAINT", "STATUS", "VOLATILE_STATUS", "MOVE_RESULT", "DAMAGE_RESULT", "STAT_CHANGE"), f["target"])
    named = F.when(F.col("kind").isin("SWITCH", "STAT_CHANGE") & (F.size("targets") > 0), F.col("targets")).otherwise(F.array(one))
    rows = rows.withColumn("lacks", lacks).select("replay_id", "event_id", "start", "kind", "fields", "confidence", "lacks", F.posexplode(F.when(F.col("lacks"), F.array(F.lit(None).cast("string"))).otherwise(named)).alias("place", "name"))
    # read several times by what follows
    return cut_lineage(rows.withColumn("said_side", F.when(f["side"].isin("player", "opponent"), f["side"])))


_AT = ["start", "event_id", "place"]


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations with their entity: ``entity, field, op, value, weight``, in order of ``_AT`` and ``part``."""
    f, kind, who = F.col("fields"), F.col("kind"), F.col("name")
    rows = state.resolve_mentions(_mentioned(spark, sf_dir), _WHERE, "name", "said_side", _AT)
    op = lambda entity, field, how, value: F.struct(entity.alias("entity"), field.alias("field"), F.lit(how).alias("op"), value.cast("string").alias("value"))
    lit, none = F.lit, F.lit(None).cast("string")
    shift = F.when(f["direction"] == "lower", -f["magnitude"].cast("int")).otherwise(f["magnitude"].cast("int"))
    names = F.create_map(*[lit(x) for kv in STATS.items() for x in kv])
    stats = F.transform(F.filter(tx.stats(f["stat"]), lambda x: names[x].isNotNull()), lambda x: op(who, F.concat(lit("stat_stages."), names[x]), "shift", shift))
    unknown_stat = F.exists(tx.stats(f["stat"]), lambda x: names[x].isNull())
    unresolved = F.array(op(none, none, "unresolved", none))
    field_of = lambda prefix, value: F.concat(lit(prefix), value)
    made = (
        F.when(F.col("lacks") | ((kind == "STAT_CHANGE") & unknown_stat), unresolved)
        .when(F.col("resolution") == "conflict", F.array(op(who, lit("side"), "side", F.col("said_side"))))
        .when(kind == "SWITCH", F.array(op(who, lit("active"), "replace", lit("true"))))
        .when(kind == "FAINT", F.array(op(who, lit("fainted"), "set", lit("true")), op(who, lit("active"), "replace", lit("false"))))
        .when(kind == "STATUS", F.array(op(who, lit("status"), "set", f["status"])))
        .when(kind == "VOLATILE_STATUS", F.array(op(who, field_of("volatile_statuses.", f["effect"]), "count", F.concat(F.when(f["action"] == "end", "false").otherwise("true"), lit("#"), F.coalesce(f["counter"], lit(""))))))
        .when(kind == "STAT_CHANGE", stats)
        .when((kind == "WEATHER") & (f["action"] == "start"), F.array(op(lit("field"), lit("weather"), "set", f["weather"])))
        .when(kind == "WEATHER", F.array(op(lit("field"), lit("weather"), "clear", lit("known"))))
        .when(kind == "SIDE_CONDITION", F.array(op(f["side"], field_of("side_conditions.", f["effect"]), "replace", F.when(f["action"] == "start", "true").otherwise("false"))))
        .when(kind == "FIELD_EFFECT", F.array(op(lit("field"), field_of("field_effects.", f["effect"]), "count", F.concat(lit("true#"), F.coalesce(f["counter"], lit(""))))))
        .when(kind == "TRANSFORMATION", F.array(op(who, lit("transformation"), "phase", F.when(f["action"] == "activate", F.concat_ws("|", lit("activated"), f["item"], f["device"])).otherwise(F.concat_ws("|", lit("completed"), f["form"])))))
        .when(kind == "ABILITY", F.array(op(who, lit("known_ability"), "add", f["ability"])))
        .when(kind == "ITEM", F.array(op(who, lit("known_item"), "add", f["item"])))
        .when((kind == "BATTLE_RESULT") & (f["result"] == "forfeit"), F.array(op(lit("battle"), lit("termination_reason"), "once", lit("forfeit"))))
        .when((kind == "BATTLE_RESULT") & f["loser"].isNotNull(), F.array(op(lit("battle"), lit("result"), "once", f["result"]), op(lit("battle"), lit("loser"), "once", f["loser"])))
        .when(kind == "BATTLE_RESULT", F.array(op(lit("battle"), lit("result"), "once", f["result"])))
    )
    is_new = F.col("resolution").isin("registered", "adopted")
    register = F.when(is_new & ~F.col("lacks"), F.array(op(who, lit("side"), "replace", F.coalesce("said_side", lit("unknown"))))).otherwise(F.array().cast("array<struct<entity:string,field:string,op:string,value:string>>"))
    rows = rows.select("replay_id", "event_id", "start", "place", "confidence", "resolution", F.posexplode(F.concat(register, F.coalesce(made, F.array().cast("array<struct<entity:string,field:string,op:string,value:string>>")))).alias("part", "o"))
    factor = F.when(F.col("o.op") == "unresolved", FACTORS["unresolved"]).when((F.col("o.field") == "side") & (F.col("resolution") == "adopted"), FACTORS["adopted"]).when((F.col("o.field") == "side") & (F.col("o.value") == "unknown"), FACTORS["no_side"]).otherwise(FACTORS["stated"])
    return rows.select("replay_id", "event_id", "start", "place", "part", "o.*", F.bround(F.col("confidence") * factor, 6).alias("weight"))


def state_changes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``replay_id, entity, field, event_id, seq, op, before, after, status, start, weight``."""
    asked = cut_lineage(state.sequenced(_requests(spark, sf_dir), _WHERE, [*_AT, "part"], _place(), "at"))
    clash = F.col("op") == "side"
    made = state.project(asked.where(~clash), _WHERE, ["start", "event_id", "place", "part"], ["event_id", "entity", "field", "op", "value"])
    # numbers of all requests, clashes of sides too
    numbered = state.sequenced(asked.where(~clash).drop("seq"), _WHERE, ["start", "event_id", "place", "part"], _place(), "seq").select("replay_id", "seq", "at", "start", "weight")
    folded = made.join(numbered, ["replay_id", "seq"]).drop("seq").withColumnRenamed("at", "seq")
    sides = asked.where(clash).select("replay_id", "entity", "field", "event_id", F.col("at").alias("seq"), "op", F.lit(None).cast("string").alias("before"), F.col("value").alias("after"), F.lit("conflict").alias("status"), "start", "weight")
    return folded.unionByName(sides)


_MENTION_SQL = _EVENTS + """, w AS (SELECT e AS replay_id, id AS event_id, a, c, kind, targets, COLUMNS('^(actor|target|side|move|ability|item|status|stat|direction|magnitude|weather|effect|counter|form|device|result|loser|action)$') FROM e0),
q AS (SELECT *, CASE kind WHEN 'SWITCH' THEN len(targets) = 0 WHEN 'FAINT' THEN target IS NULL WHEN 'STATUS' THEN target IS NULL OR status IS NULL WHEN 'VOLATILE_STATUS' THEN target IS NULL OR effect IS NULL
  WHEN 'STAT_CHANGE' THEN len(targets) = 0 AND target IS NULL WHEN 'TRANSFORMATION' THEN actor IS NULL WHEN 'ABILITY' THEN actor IS NULL WHEN 'ITEM' THEN actor IS NULL WHEN 'MOVE' THEN actor IS NULL
  WHEN 'DAMAGE_RESULT' THEN target IS NULL ELSE false END AS lacks FROM w),
r AS (SELECT *, CASE WHEN lacks THEN [NULL] WHEN kind IN ('SWITCH', 'STAT_CHANGE') AND len(targets) > 0 THEN targets WHEN kind IN ('TRANSFORMATION', 'ABILITY', 'ITEM', 'MOVE') THEN [actor]
  WHEN kind IN ('FAINT', 'STATUS', 'VOLATILE_STATUS', 'MOVE_RESULT', 'DAMAGE_RESULT', 'STAT_CHANGE') THEN [target] ELSE [NULL] END AS names FROM q),
n AS (SELECT * EXCLUDE (names), unnest(names) AS name, generate_subscripts(names, 1) AS place FROM r),
s AS (SELECT *, count(*) OVER k AS nth, first_value(side IGNORE NULLS) OVER k AS owner, count(side) OVER k AS sided FROM n WINDOW k AS (PARTITION BY replay_id, name ORDER BY a, event_id, place ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, CASE WHEN name IS NULL THEN 'missing' WHEN side <> owner THEN 'conflict' WHEN nth = 1 THEN 'registered' WHEN sided = 1 AND side IS NOT NULL THEN 'adopted' ELSE 'known' END AS resolution FROM s)"""


@query(_MENTION_SQL + " SELECT replay_id, event_id, place - 1 AS place, kind, name, CASE WHEN resolution NOT IN ('conflict', 'missing') THEN coalesce(owner, 'unknown') || ':' || name END AS entity_id, resolution, lacks FROM m")
def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who each event speaks of: names become entities with the first side that was stated of them."""
    rows = state.resolve_mentions(_mentioned(spark, sf_dir), _WHERE, "name", "said_side", _AT)
    return rows.select("replay_id", "event_id", F.col("place").cast("long").alias("place"), "kind", "name", "entity_id", "resolution", "lacks")


@query()
def state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of every field of a match, with its images and status; tested against one pass and by cases."""
    return state_changes_of(spark, sf_dir).select("replay_id", "seq", "event_id", "entity", "field", "op", "before", "after", "status")


@query(
    _MENTION_SQL
    + """, x AS (SELECT *, string_split(stat, '、') AS stats FROM m WHERE kind = 'STAT_CHANGE' AND NOT lacks AND resolution <> 'conflict'),
y AS (SELECT replay_id, name, a, unnest(stats) AS stat, CASE direction WHEN 'lower' THEN -CAST(magnitude AS INT) ELSE CAST(magnitude AS INT) END AS d, len(list_filter(stats, lambda z: z NOT IN ('攻擊', '防禦', '特攻', '特防', '速度', '命中', '閃避'))) AS odd FROM x)
SELECT replay_id, name AS entity, stat, CAST(sum(d) AS BIGINT) AS net, CAST(least(6, greatest(-6, sum(d))) AS BIGINT) AS clamped, count(*) AS n FROM y WHERE odd = 0 GROUP BY ALL"""
)
def stat_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net changes of each stat of an entity at the end, as they are and inside the bounds of a stage."""
    rows = state_changes_of(spark, sf_dir).where("field LIKE 'stat_stages.%' AND status IN ('applied', 'no_op')")
    last = rows.groupBy("replay_id", "entity", "field").agg(F.max_by("after", "seq").cast("long").alias("net"), F.count(F.lit(1)).alias("n"))
    back = F.create_map(*[F.lit(x) for k, v in STATS.items() for x in (f"stat_stages.{v}", k)])
    return last.select("replay_id", "entity", back[F.col("field")].alias("stat"), "net", F.greatest(F.lit(STAGE_BOUNDS[0]), F.least(F.lit(STAGE_BOUNDS[1]), "net")).cast("long").alias("clamped"), "n")


def _active_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = state.resolve_mentions(_mentioned(spark, sf_dir), _WHERE, "name", "said_side", _AT).where("NOT lacks AND resolution <> 'conflict' AND name IS NOT NULL")
    rows = cut_lineage(state.sequenced(rows, _WHERE, _AT, _place()).select("replay_id", "event_id", "seq", "name", "kind", "entity_id", "resolution"))
    gone = rows.where("kind = 'FAINT'").groupBy("replay_id", "name").agg(F.min("seq").alias("_gone"))
    rows = rows.join(gone, ["replay_id", "name"], "left").withColumn("fainted", F.coalesce(F.col("seq") > F.col("_gone"), F.lit(False)))
    # an entity whose side becomes known brings along whether it is active
    last = rows.where("kind IN ('SWITCH', 'FAINT')").select("replay_id", "name", F.col("seq").alias("_s"), (F.col("kind") == "SWITCH").alias("_in"))
    adopted = rows.where("resolution = 'adopted'").select("replay_id", "event_id", "name", "seq", "entity_id").join(last, ["replay_id", "name"]).where("_s < seq")
    adopted = adopted.groupBy("replay_id", "event_id", "name", "seq", "entity_id").agg(F.max_by("_in", "_s").alias("_in")).where("_in")
    pick = ["replay_id", F.split("entity_id", ":")[0].alias("side"), "event_id", "seq", "name"]
    moves = rows.where("kind IN ('SWITCH', 'FAINT')").select(*pick, F.when(F.col("kind") == "SWITCH", "in").otherwise("out").alias("what"), "fainted")
    return moves.unionByName(adopted.select(*pick, F.lit("adopt").alias("what"), F.lit(False).alias("fainted"))).where("side <> 'unknown'")


@query()
def active_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is active on each side after each change: two at most, and none that fainted; tested by cases."""
    return state.active_sets(_active_entries(spark, sf_dir), ["replay_id", "side"], ["event_id", "seq", "name", "what", "fainted"])


@query()
def state_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One delta for each event: what it changed, what it could not, and how sure that is."""
    events = narration(spark, sf_dir).select("replay_id", "event_id", "kind", "confidence")
    made = state.deltas(state_changes_of(spark, sf_dir), events, _WHERE, "event_id", "confidence")
    return made


@query()
def state_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after each event and at the start: cells known, entities, mean confidence and completeness."""
    changes = cut_lineage(state_changes_of(spark, sf_dir)).where("entity IS NOT NULL")
    inside = F.col("status").isin("applied", "no_op", "conflict")
    # a cell counts from the change that makes it known to the one that does not leave it so
    known = F.when(F.col("field") == "side", F.col("after") != '"unknown"').when(F.col("field").startswith("stat_stages."), F.lit(False)).otherwise(F.col("status").isin("applied", "no_op") | F.col("op").isin("once", "phase"))
    cells = changes.where(inside & (F.col("op") != "side")).withColumn("known", known.cast("int"))
    before = lagged(cells, ["replay_id", "entity", "field"], ["seq"], F.floor(F.col("seq") / 4096), {"was": F.col("known"), "was_weight": F.col("weight")})
    weight, was = F.col("known") * F.col("weight"), F.coalesce(F.col("was") * F.col("was_weight"), F.lit(0.0))
    turned = F.col("known") - F.coalesce("was", F.lit(0))
    core = F.col("field").isin("side", "active", "fainted", "status") & ~F.col("entity").isin("field", "battle")
    first = F.col("was").isNull()
    rows = before.select("replay_id", "event_id", "start", turned.alias("d_known"), (weight - was).alias("d_weight"), F.when(core, turned).otherwise(0).alias("d_core"), F.when(core & (F.col("field") == "side") & first, 1).otherwise(0).alias("d_entities"),
        F.when((F.col("entity") == "battle") & (F.col("field") == "result"), turned).otherwise(0).alias("d_result"), F.when(F.col("field") == "weather", turned).otherwise(0).alias("d_weather"),
        *[F.when((F.col("entity") == s) & F.col("field").startswith("side_conditions.") & first, 1).otherwise(0).alias(f"d_{s}") for s in ("player", "opponent")])
    names = ["d_known", "d_weight", "d_core", "d_entities", "d_result", "d_weather", "d_player", "d_opponent"]
    quiet = narration(spark, sf_dir).select("replay_id", "event_id", "start", *[F.lit(0.0 if n == "d_weight" else 0).alias(n) for n in names])
    made = state.snapshots(rows.unionByName(quiet), _WHERE, ["start", "event_id"], F.floor(F.col("start") / 600), {n[2:]: F.col(n) for n in names})
    has = lambda c: (F.col(c) > 0).cast("double")
    parts = {"result": has("result"), "player_conditions": has("player"), "opponent_conditions": has("opponent"), "weather": has("weather"), "core": F.coalesce(F.col("core") / F.nullif(4 * F.col("entities"), F.lit(0)), F.lit(0.0))}
    complete = sum((COMPLETENESS[k] * v for k, v in parts.items()), F.lit(0.0))
    return made.select("replay_id", "seq", "event_id", F.col("known").alias("n_known"), F.col("entities").alias("n_entities"), F.bround(F.coalesce(F.col("weight") / F.nullif(F.col("known"), F.lit(0)), F.lit(0.0)), 6).alias("confidence"), F.bround(complete, 6).alias("completeness"))
