"""Event-sourced state: operations on the fields of entities, folded into change records, deltas and snapshots.

Operations: ``set`` (a different known value is a conflict: both are kept, and
the next one starts anew), ``replace``, ``clear``, ``add`` and ``remove``
(members of a set), ``shift`` (a running number), ``once`` (the first value
stays, a different one is a conflict), ``phase`` (``replace``, but a completed
phase does not go back) and ``count`` (a value with a number that is kept when
it is not stated again).  Every operation gives one change with the images
before and after; the state after any change follows from the changes alone.

Distribution: a field of an entity depends on its own operations only, so the
fold's key is the replay with the entity and the field, not the replay; what
remains sequential over more than one entity (how many may be active on a side)
is folded by side.  Entities are resolved, changes numbered and snapshots added
up with aggregates and block-wise running sums.

Nulls and odd input: an operation without an entity or field is ``unresolved``,
as is a shift by what is no number and an operation of another name; operations
without a place in the order come first; an empty table gives an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.operators.machines import fold
from tracefold.operators.sequence import join_on, running_sums

CHANGE = "event_id string, seq long, op string, before string, after string, status string"


def start() -> dict:
    return {"known": False, "value": None}


def _image(value) -> str | None:
    return None if value is None else json.dumps(sorted(value) if isinstance(value, set) else value, ensure_ascii=False, sort_keys=True)


def _number(value) -> int | None:
    try:
        return int(value)
    except (TypeError, ValueError):
        return None


def step(state: dict, row: tuple) -> list[tuple]:
    """``row``: event id, seq, entity, field, op, value.  Status: applied, no_op, conflict or unresolved."""
    event_id, seq, entity, name, op, value = row
    if entity is None or name is None:
        return [(event_id, seq, op, None, None, "unresolved")]
    have, known = state["value"], state["known"]
    before, new, status, holds = _image(have), have, "applied", True
    if op == "set" or op == "once":
        if known and have is not None and have != value:
            status, holds = "conflict", op == "once"
        else:
            new = value
    elif op == "replace":
        new = value
    elif op == "phase":
        if known and str(have).startswith("completed") and str(value).startswith("activated"):
            status = "conflict"
        else:
            new = value
    elif op == "clear":
        new, holds = None, value is not None
    elif op == "count":
        last, _, number = (value or "").partition("#")
        kept = (have or "").partition("#")[2]
        new = f"{last}#{number or kept}"
    elif op in ("add", "remove"):
        members = set(have) if isinstance(have, (set, list)) else set()
        new = members | {value} if op == "add" else members - {value}
    elif op == "shift" and _number(value) is not None:
        new = (have or 0) + _number(value)
    else:
        status = "unresolved"
    if status == "applied" and known and _image(new) == before:
        status = "no_op"
    after = json.dumps([have, value], ensure_ascii=False) if status == "conflict" else _image(new)
    if status in ("applied", "no_op"):
        state["value"], state["known"] = new, holds
    elif status == "conflict" and not holds:
        # both values are kept, neither is known
        state["value"], state["known"] = None, False
    return [(event_id, seq, op, before, after, status)]


def sequenced(rows: DataFrame, keys: list[str], order: list[str], block: Column, name: str = "seq") -> DataFrame:
    """``rows`` with their 1-based number in each of ``keys``, added up over blocks."""
    return running_sums(rows, keys, order, block, {name: F.lit(1)})


def project(operations: DataFrame, keys: list[str], order: list[str], columns: list[str], block: Column | None = None) -> DataFrame:
    """``keys, entity, field, event_id, seq, op, before, after, status``: the change of every operation.

    ``columns``: event id, entity, field, op, value (strings); ``block`` must not decrease along ``order``.
    """
    event_id, entity, name, op, value = columns
    numbered = sequenced(operations, keys, order, F.floor(F.col(order[0]) / 600) if block is None else block)
    rows = numbered.select(*keys, F.col(entity).cast("string").alias("entity"), F.col(name).cast("string").alias("field"), F.col(event_id).cast("string").alias("_id"), "seq", F.col(entity).cast("string").alias("_e"), F.col(name).cast("string").alias("_n"), F.col(op).alias("_op"), F.col(value).cast("string").alias("_v"))
    return fold(rows, [*keys, "entity", "field"], ["seq"], ["_id", "seq", "_e", "_n", "_op", "_v"], start, step, CHANGE)


def latest(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The state at the end: ``keys, entity, field, value`` of the last applied change, cleared fields left out."""
    rows = changes.where("status IN ('applied', 'no_op')").groupBy(*keys, "entity", "field").agg(F.max_by("after", "seq").alias("value"))
    return rows.where("value IS NOT NULL")


def resolve_mentions(mentions: DataFrame, keys: list[str], name: str, side: str, order: list[str]) -> DataFrame:
    """``mentions`` with ``entity_id, resolution``: who a name is, by all that was said of it before.

    An entity is known by its name; the first side stated is its side, and until
    then it is on none.  ``resolution``: registered, adopted (its side becomes
    known), known, conflict (another side is stated; no entity then) or missing.
    """
    at = F.struct(*order)
    first = mentions.where(F.col(name).isNotNull()).groupBy(*keys, name).agg(F.min(at).alias("_first"), F.min(F.when(F.col(side).isNotNull(), F.struct(at.alias("at"), F.col(side).alias("side")))).alias("_sided"))
    rows = join_on(mentions, first, [*keys, name], "left")
    known = F.coalesce(F.col("_sided.at") <= at, F.lit(False))
    owner = F.when(known, F.col("_sided.side"))
    clash = F.col(side).isNotNull() & known & (F.col(side) != owner)
    entity = F.when(F.col(name).isNotNull() & ~clash, F.concat_ws(":", F.coalesce(owner, F.lit("unknown")), F.col(name)))
    new = F.when(at == F.col("_first"), "registered").when(at == F.col("_sided.at"), "adopted").otherwise("known")
    resolution = F.when(F.col(name).isNull(), "missing").when(clash, "conflict").otherwise(new)
    return rows.withColumns({"entity_id": entity, "resolution": resolution}).drop("_first", "_sided")


MOST_ACTIVE = 2


def active_start() -> list:
    return []


def active_step(held: list, row: tuple) -> list[tuple]:
    """``row``: event id, seq, name, what (in, out, adopt), whether it fainted before.  Who is active on one side."""
    event_id, seq, name, what, fainted = row
    if what == "out":
        out = "applied" if name in held else "no_op"
        held[:] = [x for x in held if x != name]
    elif fainted:
        return [(event_id, seq, name, "fainted_returns", ",".join(held))] if what == "in" else []
    elif name in held:
        out = "no_op"
    elif len(held) >= MOST_ACTIVE:
        return [(event_id, seq, name, "overflow", ",".join(held))] if what == "in" else []
    else:
        held.append(name)
        held.sort()
        out = "applied"
    return [(event_id, seq, name, out, ",".join(held))]


def active_sets(entries: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``keys, event_id, seq, name, outcome, active``: at most two are active on a side, and none returns after it fainted.

    ``columns``: event id, seq, name, what, fainted; ``keys`` end with the side.
    """
    return fold(entries, keys, [columns[1], columns[2]], columns, active_start, active_step, "event_id string, seq long, name string, outcome string, active string")


def deltas(changes: DataFrame, events: DataFrame, keys: list[str], event_id: str, confidence: str) -> DataFrame:
    """One row for each of ``events``: its operations, conflicts and unresolved ones, status and confidence.

    Status: conflicted before partial, unresolved, applied and no_op; the
    confidence is the mean over operations and unresolved ones, else the event's.
    """
    n = lambda s: F.count_if(F.col("status").isin(*s))
    by = changes.groupBy(*keys, F.col("event_id").alias("_id")).agg(n(("applied", "no_op")).alias("n_operations"), n(("conflict",)).alias("n_conflicts"), n(("unresolved",)).alias("n_unresolved"), F.avg(F.when(F.col("status") != "conflict", F.col("weight"))).alias("_w"))
    rows = events.join(by.withColumnRenamed("_id", event_id), [*keys, event_id], "left").fillna(0, ["n_operations", "n_conflicts", "n_unresolved"])
    status = F.when(F.col("n_conflicts") > 0, "conflicted").when((F.col("n_unresolved") > 0) & (F.col("n_operations") > 0), "partial").when(F.col("n_unresolved") > 0, "unresolved").when(F.col("n_operations") > 0, "applied").otherwise("no_op")
    return rows.select(*keys, event_id, "n_operations", "n_conflicts", "n_unresolved", status.alias("status"), F.bround(F.coalesce("_w", confidence), 6).alias("confidence"))


def snapshots(cells: DataFrame, keys: list[str], order: list[str], block: Column, measures: dict[str, Column]) -> DataFrame:
    """Running state after each step, by sums of what each change adds: ``keys, seq`` and ``measures``; seq 0 is the start.

    ``cells`` has one row for each change or quiet event; steps are told apart by ``order``.
    """
    by_step = cells.groupBy(*keys, *order, block.alias("_place")).agg(*[F.sum(v).alias(n) for n, v in measures.items()])
    rows = running_sums(by_step, keys, order, F.col("_place"), {"seq": F.lit(1)} | {f"_{n}": F.col(n) for n in measures})
    states = rows.select(*keys, *order, "seq", *[F.col(f"_{n}").alias(n) for n in measures])
    first = states.select(*keys).distinct().select(*keys, *[F.lit(None).cast(states.schema[c].dataType).alias(c) for c in order], F.lit(0).cast("long").alias("seq"), *[F.lit(0).cast(states.schema[n].dataType).alias(n) for n in measures])
    return first.unionByName(states)
