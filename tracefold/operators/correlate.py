"""Events correlated with earlier ones inside a bounded look-back, and the groups that result.

Rules are data.  A rule joins source to target events of one entity by kind, gap
and shared values; a running count of barrier events tells in constant time
whether one lies between.  The look-back becomes a time bucket in the join key,
so no entity is joined with itself as a whole.  Each event takes its best
proposal as parent; roots follow by pointer jumping in logarithmically many
rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracefold.functions.scores import has_pairs
from tracefold.operators.sequence import running_sums
from tracefold.session import cut_lineage

# Weights of an edge's confidence (rule, events), what an agreeing optional pair adds to the rule's base,
# and the most that comes of it.
EDGE_WEIGHTS, OPTIONAL_BONUS, MOST_BASE = (0.8, 0.2), 0.02, 0.99

RULES = (
    "rule_order int, rule string, source_kind string, target_kind string, most double, barred boolean, relation string, mode string, base double, "
    "required array<struct<s:string,t:string>>, optional array<struct<s:string,t:string>>, s_if map<string,string>, t_if map<string,string>"
)


def _values(event: Column, key: Column) -> Column:
    """Stated values of a field of ``f``; ``participants`` are the actor and the target, and ``n`` names further targets."""
    clean = lambda name: F.nullif(F.trim(event["f"][name]), F.lit(""))
    one = F.when(key == "participants", F.array(clean("actor"), clean("target"))).otherwise(F.array(clean(key)))
    named = F.when(key.isin("participants", "target"), event["n"]).otherwise(F.array().cast("array<string>"))
    return F.array_compact(F.concat(one, F.coalesce(named, F.array().cast("array<string>"))))


def rule_rows(rules: list[tuple]) -> list[tuple]:
    """The rule table's rows, one for each target kind."""
    return [
        (i, rule, source, target, most, barred, relation, mode, base, list(required), list(optional), dict(s_if), dict(t_if))
        for i, (rule, source, targets, most, required, optional, relation, base, barred, mode, s_if, t_if) in enumerate(rules)
        for target in targets
    ]


def numbered(events: DataFrame, entity: str, start: str, end: str, event_id: str, kind: str, barriers: tuple[str, ...]) -> DataFrame:
    """Events with their position ``seq`` and the running count of barriers ``bars``, over blocks of ten minutes."""
    is_bar = F.col(kind).isin(*barriers).cast("int")
    rows = running_sums(events, [entity], [start, end, event_id], F.floor(F.col(start) / 600), {"seq": F.lit(1), "bars": is_bar})
    return rows.withColumn("is_bar", is_bar)


def proposals(events: DataFrame, rules: list[tuple], entity: str, start: str, end: str, event_id: str, kind: str, fields: str, confidence: str, barriers: tuple[str, ...], look_back: float, least_gap: float, targets: str | None = None, written: bool = False) -> DataFrame:
    """``entity, source, target, rule, rule_order, relation, mode, confidence, gap``: every rule that holds for a pair.

    ``targets`` is an array of names that an event has besides its ``target``
    field; ``written``: the events' lineage is cut already.
    """
    spark = events.sparkSession
    # both sides of the join and the numbering read the events, which are costly to make again
    names = F.col(targets) if targets else F.array().cast("array<string>")
    events = events.select(entity, start, end, event_id, kind, fields, confidence, names.alias("_names"))
    events = events if written else cut_lineage(events)
    seq = numbered(events, entity, start, end, event_id, kind, barriers)
    pick = [F.col(entity).alias("_e"), F.col(event_id).alias("id"), F.col(kind).alias("kind"), F.col(start).alias("a"), F.col(end).alias("z"), F.col(fields).alias("f"), F.col(confidence).alias("c"), F.col("_names").alias("n"), "seq", "bars", "is_bar"]
    rows = seq.select(*pick)
    # the gap runs from a source's end to a target's start, so those are bucketed
    src = rows.select("_e", F.struct("id", "kind", "z", "f", "n", "c", "seq", "bars").alias("s"), F.explode(F.sequence(F.floor((F.col("z") + least_gap) / look_back), F.floor((F.col("z") + look_back) / look_back))).alias("_bucket"))
    tgt = rows.select("_e", F.struct("id", "kind", "a", "f", "n", "c", "seq", "bars", "is_bar").alias("t"), F.floor(F.col("a") / look_back).alias("_bucket"))
    table = F.broadcast(spark.createDataFrame(rule_rows(rules), RULES))
    gap = F.col("t.a") - F.col("s.z")
    pairs = src.join(tgt, ["_e", "_bucket"]).where((F.col("s.seq") < F.col("t.seq")) & gap.between(least_gap, look_back))
    pairs = pairs.join(table, (F.col("s.kind") == F.col("source_kind")) & (F.col("t.kind") == F.col("target_kind")) & (gap <= F.col("most")))
    between = F.col("t.bars") - F.col("t.is_bar") - F.col("s.bars")
    source, target = F.col("s"), F.col("t")
    holds = ~(F.col("barred") & (between > 0)) & has_pairs(source["f"], F.col("s_if")) & has_pairs(target["f"], F.col("t_if"))
    holds = holds & F.forall("required", lambda m: F.arrays_overlap(_values(source, m["s"]), _values(target, m["t"])))
    agrees = lambda m: F.arrays_overlap(_values(source, m["s"]), _values(target, m["t"]))
    stated = lambda m: (F.size(_values(source, m["s"])) > 0) & (F.size(_values(target, m["t"])) > 0)
    made = pairs.where(holds & F.forall("optional", lambda m: ~stated(m) | agrees(m)))
    bonus = OPTIONAL_BONUS * F.size(F.filter("optional", agrees))
    strength = EDGE_WEIGHTS[0] * F.least(F.lit(MOST_BASE), F.col("base") + bonus) + EDGE_WEIGHTS[1] * F.least("s.c", "t.c")
    return made.select(F.col("_e").alias(entity), F.col("s.id").alias("source"), F.col("t.id").alias("target"), "rule", "rule_order", "relation", "mode", F.bround(strength, 6).alias("confidence"), F.bround(gap, 6).alias("gap"))


def best_parent(made: DataFrame, link_from: float) -> DataFrame:
    """One proposal per target: links at ``link_from`` or more before reviews, then confidence, rule order, source."""
    usable = made.where((F.col("mode") == "review") | (F.col("confidence") >= link_from))
    rank = Window.partitionBy("target").orderBy((F.col("mode") != "link").cast("int"), F.desc("confidence"), "rule_order", "source")
    return usable.withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r")


def roots(links: DataFrame, rounds: int = 30) -> DataFrame:
    """``node, root`` of a forest given as ``child, parent``: every node jumps to its parent's parent until nothing moves."""
    links = cut_lineage(links)
    if links.isEmpty():
        return links.select(F.col("child").alias("node"), F.col("parent").alias("root"))
    nodes = links.select(F.col("child").alias("node")).unionByName(links.select(F.col("parent").alias("node"))).distinct()
    at = nodes.join(links.select(F.col("child").alias("node"), "parent"), "node", "left").select("node", F.coalesce("parent", "node").alias("root"))
    for _ in range(rounds):
        up = at.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        nxt = cut_lineage(at.join(up, "root").select("node", F.col("_up").alias("root"), (F.col("_up") != F.col("root")).alias("_moved")))
        moved = nxt.where("_moved").limit(1).count()
        at = nxt.drop("_moved")
        if not moved:
            return at
    raise ValueError("the links are no forest, or deeper than the rounds allow")


def grouped(events: DataFrame, parents: DataFrame, entity: str, start: str, end: str, event_id: str, kind: str, confidence: str, stands: Column | None = None) -> DataFrame:
    """Groups: ``entity, root, n_events, start, end, confidence, event_ids, kinds, status, rules, stands``.

    Only links merge; an edge between two groups leaves both for review.
    ``rules`` are those of the group's inner edges; ``stands`` is the value of
    that expression for the group's first event.
    """
    parents = cut_lineage(parents)
    events = events.withColumn("_stands", F.lit(None).cast("boolean") if stands is None else stands)
    links = parents.where("mode = 'link'").select(F.col("target").alias("child"), F.col("source").alias("parent"))
    found = roots(links)
    rows = events.join(found.withColumnRenamed("node", event_id), event_id, "left").withColumn("root", F.coalesce("root", event_id))
    member = rows.select(F.col(event_id).alias("_id"), F.col("root").alias("_root"))
    edges = parents.select("source", "target", "mode", "rule", F.col("confidence").alias("_ec"))
    touched = edges.join(member.withColumnRenamed("_id", "source"), "source").withColumnRenamed("_root", "_sr").join(member.withColumnRenamed("_id", "target"), "target")
    by_root = touched.select(F.explode(F.array_distinct(F.array("_sr", "_root"))).alias("root"), "_ec", (F.col("_sr") != F.col("_root")).alias("_open"), "rule")
    by_root = by_root.groupBy("root").agg(F.min("_ec").alias("_ec"), F.max("_open").alias("_open"), F.sort_array(F.collect_set(F.when(~F.col("_open"), F.col("rule")))).alias("rules"))
    item = F.struct(F.col(start).alias("t"), F.col(event_id).alias("id"), F.col(kind).alias("k"), F.col("_stands").alias("s"))
    groups = rows.groupBy(entity, "root").agg(F.count(F.lit(1)).alias("n_events"), F.min(start).alias("start"), F.max(end).alias("end"), F.min(confidence).alias("_c"), F.sort_array(F.collect_list(item)).alias("_items"))
    out = groups.join(by_root, "root", "left")
    status = F.when(F.col("_open"), "needs_review").when(F.col("_open").isNotNull(), "linked").otherwise("alone")
    return out.select(entity, "root", "n_events", "start", "end", F.bround(F.coalesce("_ec", "_c"), 6).alias("confidence"), F.transform("_items", lambda x: x["id"]).alias("event_ids"), F.transform("_items", lambda x: x["k"]).alias("kinds"), status.alias("status"), F.coalesce("rules", F.array().cast("array<string>")).alias("rules"), F.get("_items", 0)["s"].alias("stands"))
