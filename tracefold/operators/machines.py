"""Ordered folds: one pure step function each, run in batch and on streams.

Batch folds stream each task's sorted rows through the step and keep one state
per open entity, so memory does not grow with an entity.  Hysteresis is cut at
quiet stretches first: a run of negatives longer than the gap closes everything,
so the pieces are independent and a long entity is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.operators.temporal import islands


@dataclass(frozen=True)
class Hysteresis:
    """``strong`` opens at once and drops pending weak samples; ``confirm`` weak ones in a row open too; up to ``gap``
    negatives inside are bridged; ``continuation`` extends but never opens."""

    confirm: int = 2
    gap: int = 1


@dataclass
class _Open:
    pending: list = field(default_factory=list)
    start: int | None = None
    last: int = 0
    hits: int = 0
    reason: str = ""
    misses: int = 0


def hysteresis_step(state: _Open, config: Hysteresis, pos: int, level: str) -> list[tuple[int, int, int, str]]:
    """Finished segments ``(first, last, hits, reason)`` after one sample; changes ``state``."""
    done = []
    positive = level in ("strong", "weak")
    if state.start is not None:
        if positive or level == "continuation":
            state.last, state.misses = pos, 0
            state.hits += positive
        else:
            state.misses += 1
            if state.misses > config.gap:
                done.append((state.start, state.last, state.hits, state.reason))
                state.__init__()
        return done
    if level == "strong":
        state.start, state.last, state.hits, state.reason, state.pending, state.misses = pos, pos, 1, "strong", [], 0
    elif level == "weak":
        state.pending.append(pos)
        if len(state.pending) >= config.confirm:
            state.start, state.last, state.hits, state.reason, state.misses = state.pending[0], pos, len(state.pending), "weak_confirmed", 0
            state.pending = []
    else:
        state.pending = []
    return done


def hysteresis_end(state: _Open) -> list[tuple[int, int, int, str]]:
    return [] if state.start is None else [(state.start, state.last, state.hits, state.reason)]


def hysteresis_segments(samples: DataFrame, keys: list[str], pos: str, level: str, config: Hysteresis) -> DataFrame:
    """``keys, first, last, hits, reason``; a position that is missing counts as one negative sample."""
    active = samples.where(F.col(level).isin("strong", "weak", "continuation")).select(*keys, F.col(pos).cast("long").alias("_p"), F.col(level).alias("_l"))
    # further apart than this, nothing that is open or pending survives
    pieces = islands(active, keys, "_p", config.gap + 1)
    schema = ", ".join(f"`{k}` {samples.schema[k].dataType.simpleString()}" for k in keys) + ", first long, last long, hits long, reason string"
    names = [*keys, "first", "last", "hits", "reason"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, key, at = _Open(), None, None
        for batch in batches:
            out = []
            for row in batch[[*keys, "island", "_p", "_l"]].itertuples(index=False, name=None):
                if row[:-2] != key:
                    if key is not None:
                        out += [(*key[:-1], *s) for s in hysteresis_end(state)]
                    state, key, at = _Open(), row[:-2], None
                if at is not None:
                    for missing in range(at + 1, row[-2]):
                        out += [(*key[:-1], *s) for s in hysteresis_step(state, config, missing, "negative")]
                at = row[-2]
                out += [(*key[:-1], *s) for s in hysteresis_step(state, config, row[-2], row[-1])]
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame([(*key[:-1], *s) for s in hysteresis_end(state)] if key is not None else [], columns=names)

    return pieces.repartition(*keys, "island").sortWithinPartitions(*keys, "island", "_p").mapInPandas(run, schema)


# Least scores of a notice that is surely shown, proposed, or only going on.
NOTICE_STRONG, NOTICE_WEAK, NOTICE_GOES_ON = 0.72, 0.5, 0.499


def notice_level(score: Column) -> Column:
    """The level of a proposal by its score; null is negative."""
    return F.when(score >= NOTICE_STRONG, "strong").when(score >= NOTICE_WEAK, "weak").when(score >= NOTICE_GOES_ON, "continuation").otherwise("negative")


# Weights of a proposal's parts, and the floors of its levels.
NOTICE_WEIGHTS = {"text": 0.56, "panel": 0.18, "brightness": 0.12, "template": 0.09, "icon": 0.05}
STRONG_COMBINED, WEAK_COMBINED, GOES_ON_COMBINED, STRONG_TEMPLATE, WEAK_TEMPLATE = 0.68, 0.47, 0.46, 0.82, 0.76


def notice_proposal(text: Column, panel: Column, contrast: Column, template: Column, icon: Column, structure: Column, supported: Column) -> Column:
    """``level, combined, score`` of a proposal from its features: parts from 0 to 1, ``structure`` strong, weak or none,
    ``supported`` whether glyphs go on in its place."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    parts = {"text": text, "panel": panel, "brightness": unit((contrast - 0.08) / 0.25), "template": unit((template - 0.65) / 0.25), "icon": icon}
    combined = unit(sum((NOTICE_WEIGHTS[k] * v for k, v in parts.items()), F.lit(0.0)))
    some = structure.isin("strong", "weak")
    strong = ((structure == "strong") & (combined >= STRONG_COMBINED)) | ((template >= STRONG_TEMPLATE) & some)
    weak = some & ((combined >= WEAK_COMBINED) | (template >= WEAK_TEMPLATE))
    level = F.when(strong, "strong").when(weak, "weak").when(supported & (combined >= GOES_ON_COMBINED), "continuation").otherwise("negative")
    score = F.when(level == "strong", F.greatest(F.lit(NOTICE_STRONG), combined, template)).when(level == "weak", F.lit(NOTICE_WEAK)).when(level == "continuation", F.lit(NOTICE_GOES_ON))
    score = score.otherwise(F.least(F.lit(NOTICE_GOES_ON), F.greatest(F.lit(0.0), 0.49 * combined, 0.24 * template)))
    return F.struct(level.alias("level"), F.bround(combined, 6).alias("combined"), F.bround(score, 6).alias("score"))


def with_span(segments: DataFrame, samples: DataFrame, keys: list[str], pos: str, time: str, score: str, counts: Column, period: float, block: int = 1024) -> DataFrame:
    """``segments`` (``keys, first, last, hits``) with ``n_span``, the mean ``confidence`` of the samples that count and the
    ``duration`` with one ``period`` more; samples meet segments in blocks of positions."""
    rows = samples.select(*keys, F.col(pos).alias("_p"), F.col(time).alias("_t"), F.when(counts, F.col(score)).alias("_x"), F.floor(F.col(pos) / block).alias("_b"))
    cut = segments.withColumn("_b", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor(F.col("last") / block))))
    held = cut.join(rows, [*keys, "_b"]).where("_p BETWEEN first AND last")
    out = held.groupBy(*keys, "first", "last").agg(F.max("hits").alias("hits"), F.avg("_x").alias("_c"), F.min("_t").alias("_a"), F.max("_t").alias("_z"))
    return out.select(*keys, "first", "last", "hits", (F.col("last") - F.col("first") + 1).alias("n_span"), F.bround("_c", 9).alias("confidence"), F.bround(F.greatest(F.lit(period), F.col("_z") - F.col("_a") + period), 6).alias("duration"))


def fold(df: DataFrame, keys: list[str], order: list[str], columns: list[str], start: Callable[[], object], step: Callable[[object, tuple], list[tuple]], schema: str, end: Callable[[object], list[tuple]] | None = None) -> DataFrame:
    """Rows that ``step(state, row)`` emits over each entity's rows in order; ``schema`` is of what it emits, after the keys."""
    full = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", " + schema
    names = [part.split()[0].strip("`") for part in full.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, key = None, None
        for batch in batches:
            out = []
            rows = batch.astype(object).where(batch.notna(), None)
            for who, row in zip(rows[keys].itertuples(index=False, name=None), rows[columns].itertuples(index=False, name=None)):
                if who != key:
                    if key is not None and end:
                        out += [(*key, *x) for x in end(state)]
                    state, key = start(), who
                out += [(*key, *x) for x in step(state, row)]
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame([(*key, *x) for x in end(state)] if key is not None and end else [], columns=names)

    picked = df.select(*dict.fromkeys([*keys, *order, *columns]))
    return picked.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, full)


def dead_band_start() -> dict:
    return {"prior": None, "track": 0}


def dead_band_step(state: dict, row: tuple, width: float, exact_width: float) -> list[tuple]:
    """``row``: id, identity, status, value, whether the value is exact.  Emits ``(id, track)`` when the row differs
    enough from the last row emitted; a change of identity starts a new track."""
    oid, identity, status, value, exact = row
    if value is None:
        return []
    prior = state["prior"]
    changed = prior is not None and identity is not None and prior[0] is not None and identity != prior[0]
    if prior is None or changed:
        state["track"] += 1
    band = exact_width if exact else width
    emit = prior is None or changed or status != prior[1] or abs(value - prior[2]) >= band
    if emit:
        state["prior"] = (identity, status, value)
        return [(oid, state["track"])]
    return []


def dead_band(df: DataFrame, keys: list[str], order: list[str], columns: list[str], width: float = 5.0, exact_width: float = 2.0) -> DataFrame:
    """Rows of each entity that leave the dead band around the last row kept: ``keys, id, track``.

    ``columns``: id, identity, status, value, exact.
    """
    return fold(df, keys, order, columns, dead_band_start, lambda s, r: dead_band_step(s, r, width, exact_width), "id string, track int")
