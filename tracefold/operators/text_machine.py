"""Segments of shown text, from samples that say how sure it is and how it is laid out.

A sample is ``strong``, ``weak`` or ``negative``.  A strong one opens a segment,
also backwards over the weak ones just before it; weak ones alone open it when
enough come in a row.  Inside, a few weak samples and a short gap are bridged; a
layout that differs for long enough, or after a fade, splits the segment; weak
samples without end close it, and then bar weak ones from opening until a
negative or strong sample.  Two segments parted by a longer, wholly negative gap
are one again where their layouts are the same.

Distribution: samples are numbered by entity over blocks.  Negative samples say
nothing but that they are there, so only the others reach the machine, cut where
more negatives lie between them than any rule looks over; the pieces are
independent, whatever the entity's length.  Each piece streams through constant
state, but for the last segment and the samples after it.

Nulls and odd input: a null level is negative, a null layout is like any other,
a null strength is 0; samples without a position are left out; repeated
positions count once (the smallest by level and hash); an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.operators.sequence import running_sum
from tracefold.operators.temporal import islands


# The limits of the machine, in samples, shares of the layout distance and strength.
@dataclass(frozen=True)
class TextLimits:
    gap: int = 1
    weak_run: int = 10
    weak_tail: int = 1
    lined_tail: int = 10
    lined: float = 0.30
    confirm: int = 3
    changed: float = 0.38
    changed_after_fade: float = 0.20
    changed_after_gap: float = 0.07
    changed_after_gap_and_fade: float = 0.02
    reopen_from: int = 5
    reopen_to: int = 8
    reopen_distance: float = 0.01
    reopen_samples: int = 6
    persist: int = 3
    settled: int = 5


# Weights of the parts of a layout's distance.
LAYOUT_WEIGHTS = {"hash": 0.55, "rows": 0.15, "columns": 0.15, "box": 0.10, "count": 0.05}


@dataclass(frozen=True)
class Layout:
    """How text lies: bits of its mask in hex, row and column profiles, box, number of components."""

    hash: str | None = None
    rows: tuple[float, ...] = ()
    columns: tuple[float, ...] = ()
    box: tuple[float, ...] = ()
    count: int = 0


def _mean_gap(a: tuple[float, ...], b: tuple[float, ...]) -> float:
    return sum(abs(x - y) for x, y in zip(a, b)) / len(a) if a and len(a) == len(b) else 0.0


def layout_distance(a: Layout | None, b: Layout | None) -> float:
    """0 for the same layout to 1; parts that one side lacks do not count."""
    if a is None or b is None:
        return 0.0
    bits = (int(a.hash, 16) ^ int(b.hash, 16)).bit_count() / (4 * len(a.hash)) if a.hash and b.hash and len(a.hash) == len(b.hash) else 0.0
    parts = {"hash": bits, "rows": _mean_gap(a.rows, b.rows), "columns": _mean_gap(a.columns, b.columns), "box": _mean_gap(a.box, b.box), "count": abs(a.count - b.count) / max(1, a.count, b.count)}
    return min(1.0, sum(LAYOUT_WEIGHTS[k] * v for k, v in parts.items()))


@dataclass
class Segment:
    """A finished segment, its first and last strong layouts, and gaps that were closed again."""

    first: int
    last: int
    opened: str
    closed: str = ""
    trigger: int = -1
    split: bool = False
    gaps: list[tuple[int, int]] = field(default_factory=list)
    heads: list[tuple[int, Layout]] = field(default_factory=list)
    tails: list[tuple[int, Layout]] = field(default_factory=list)


@dataclass
class _Showing:
    """What the machine remembers of the segment that is open."""

    segment: Segment
    layout: Layout
    strength: float
    strong: int | None = None
    weak: int | None = None
    lined: int | None = None
    support: int = -1
    n_strong: int = 0
    weaks: int = 0
    negatives: int = 0
    faded: bool = False
    gapped: bool = False
    faded_in_gap: bool = False
    changes: list[tuple[int, int | None, Layout]] = field(default_factory=list)

    def tail(self, limits: TextLimits) -> int:
        """How far weak samples after the last strong one still belong."""
        reach = [self.segment.first if self.strong is None else self.strong, self.segment.first]
        for at, most in ((self.weak, limits.weak_tail), (self.lined, limits.lined_tail)):
            if at is not None:
                reach.append(at if self.strong is None else min(at, self.strong + most))
        return max(reach)


class TextMachine:
    """Feed samples in order of position; positions that are left out are negative.  ``end`` finishes the stream."""

    def __init__(self, limits: TextLimits = TextLimits()):
        self.limits = limits
        self.at: int | None = None
        self.showing: _Showing | None = None
        self.waiting: list[int] = []
        self.barred = False
        self.held: Segment | None = None
        self.seen_since: list[int] = []
        self.done: list[Segment] = []

    def feed(self, pos: int, level: str, layout: Layout = Layout(), strength: float = 0.0) -> list[Segment]:
        """The segments that are final after this sample."""
        if self.at is not None:
            for missing in range(self.at + 1, min(pos, self.at + self.limits.gap + 2)):
                self._negative(missing)
        self.at = pos
        if level == "strong":
            self._strong(pos, layout, strength)
        elif level == "weak":
            self._weak(pos, layout, strength)
        else:
            self._negative(pos)
        if level in ("strong", "weak"):
            self.seen_since.append(pos)
        out, self.done = self.done, []
        return out

    def end(self, last: int) -> list[Segment]:
        """``last``: the position of the entity's last sample."""
        if self.at is not None:
            for missing in range(self.at + 1, min(last, self.at + self.limits.gap + 1) + 1):
                self._negative(missing)
        if self.showing:
            s = self.showing
            places = [x for x in (s.strong, s.weak, s.support, s.segment.first) if x is not None]
            self._close(min(last, max(places)), "end_of_stream", last)
        out, self.done = self.done, []
        if self.held:
            out.append(self.held)
        self.__init__(self.limits)
        return out

    def _open(self, pos: int, first: int, reason: str, level: str, layout: Layout, strength: float, split: bool = False) -> None:
        s = self.showing = _Showing(Segment(first, first, reason, split=split), layout, strength, support=pos)
        self.waiting = []
        if level == "strong":
            s.strong, s.n_strong = pos, 1
            self._note(s, pos, layout)
        else:
            s.weak = pos
            if strength >= self.limits.lined:
                s.lined = pos

    def _note(self, s: _Showing, pos: int, layout: Layout) -> None:
        most = self.limits.reopen_samples
        if len(s.segment.heads) < most:
            s.segment.heads.append((pos, layout))
        s.segment.tails = [*s.segment.tails, (pos, layout)][-most - self.limits.persist :]

    def _strong(self, pos: int, layout: Layout, strength: float) -> None:
        limits, s = self.limits, self.showing
        if s is None:
            self.barred = False
            self._open(pos, self.waiting[0] if self.waiting else pos, "weak_confirmed_by_strong" if self.waiting else "strong_positive", "strong", layout, strength)
            return
        distance = layout_distance(s.layout, layout)
        settled = s.n_strong >= limits.settled
        least = limits.changed_after_fade
        if s.gapped:
            least = limits.changed_after_gap_and_fade if s.faded_in_gap else limits.changed_after_gap
        if settled and s.faded and distance >= least:
            self._close(s.segment.first if s.strong is None else s.strong, "layout_transition_after_fade", pos)
            self._open(pos, pos, "layout_transition_after_fade", "strong", layout, strength, split=True)
            return
        s.faded = s.gapped = s.faded_in_gap = False
        other = settled and distance >= limits.changed
        s.changes = [*s.changes, (pos, s.strong, layout)] if other else []
        if len(s.changes) >= limits.persist:
            start, before, _ = s.changes[0]
            self._close(before if before is not None else start - 1, "persistent_layout_transition", pos)
            self._open(pos, start, "persistent_layout_transition", "strong", layout, strength, split=True)
            self.showing.segment.heads = self.showing.segment.tails = [(at, shape) for at, _, shape in s.changes]
            return
        s.weaks = s.negatives = 0
        s.strong, s.support, s.weak, s.lined = pos, pos, None, None
        s.n_strong += 1
        self._note(s, pos, layout)
        if not other and strength > s.strength:
            s.layout, s.strength = layout, strength

    def _weak(self, pos: int, layout: Layout, strength: float) -> None:
        limits, s = self.limits, self.showing
        if s is None:
            if self.barred:
                return
            self.waiting = [*(self.waiting if self.waiting and self.waiting[-1] == pos - 1 else []), pos][-limits.confirm :]
            if len(self.waiting) == limits.confirm:
                self._open(pos, self.waiting[0], "temporally_confirmed_weak_positive", "weak", layout, strength)
            return
        s.changes = []
        s.faded = s.faded or s.strong is not None
        s.faded_in_gap = s.faded_in_gap or s.gapped
        s.negatives = 0
        s.weaks += 1
        if s.weaks > limits.weak_run:
            self._close(s.tail(limits), "weak_evidence_decay", pos)
            self.waiting, self.barred = [], True
            return
        s.weak = s.support = pos
        if strength >= limits.lined:
            s.lined = pos

    def _negative(self, pos: int) -> None:
        s = self.showing
        if s is None:
            self.waiting, self.barred = [], False
            return
        s.changes = []
        s.faded = s.faded or s.strong is not None
        s.gapped = True
        s.negatives += 1
        if s.negatives <= self.limits.gap:
            s.support = pos
            return
        self._close(max(s.tail(self.limits), s.support), "negative_gap_exceeded", pos)
        self.waiting = []

    def _close(self, last: int, reason: str, trigger: int) -> None:
        segment, self.showing = self.showing.segment, None
        segment.last, segment.closed, segment.trigger = max(segment.first, last), reason, trigger
        segment.tails = [x for x in segment.tails if x[0] <= segment.last][-self.limits.reopen_samples :]
        segment.heads = [x for x in segment.heads if x[0] <= segment.last]
        held = self.held
        if held and self._reopens(held, segment):
            gap = (held.last + 1, segment.first - 1)
            tails = [*held.tails, *segment.tails][-self.limits.reopen_samples :]
            segment = Segment(held.first, segment.last, held.opened, segment.closed, segment.trigger, held.split, [*held.gaps, gap, *segment.gaps], held.heads, tails)
        elif held:
            self.done.append(held)
        self.held = segment
        self.seen_since = [p for p in self.seen_since if p > segment.last]

    def _reopens(self, held: Segment, segment: Segment) -> bool:
        limits, size = self.limits, segment.first - held.last - 1
        if segment.split or held.closed != "negative_gap_exceeded" or not limits.reopen_from <= size <= limits.reopen_to:
            return False
        if any(held.last < p < segment.first for p in self.seen_since):
            return False
        return min((layout_distance(a, b) for _, a in held.tails for _, b in segment.heads), default=1.0) <= limits.reopen_distance


def evidence_level(level: Column, score: Column, structure: Column, threshold: float) -> Column:
    """The level that a sample states, or what its score and structure come to."""
    scored = F.when((score >= threshold) & (structure >= threshold), "strong").when(score >= threshold, "weak").otherwise("negative")
    return F.when(level.isin("strong", "weak", "negative"), level).otherwise(scored)


def numbered_samples(samples: DataFrame, keys: list[str], pos: str, level: Column, layout: Column, strength: Column) -> DataFrame:
    """``keys, pos`` with ``_i`` (0-based row number), ``_level, _layout, _strength``; each position once."""
    at = F.col(pos).cast("long")
    item = F.struct(F.coalesce(level, F.lit("negative")).alias("l"), layout["hash"].alias("h"), layout.alias("y"), F.coalesce(strength, F.lit(0.0)).alias("s"))
    rows = samples.where(at.isNotNull()).groupBy(*keys, at.alias(pos)).agg(F.min(item).alias("_m"))
    rows = running_sum(rows, keys, [pos], F.floor(F.col(pos) / 4096), F.lit(1), "_i")
    return rows.select(*keys, pos, (F.col("_i") - 1).alias("_i"), F.col("_m.l").alias("_level"), F.col("_m.y").alias("_layout"), F.col("_m.s").alias("_strength"))


def text_segments(samples: DataFrame, keys: list[str], pos: str, level: Column, layout: Column, strength: Column, limits: TextLimits = TextLimits()) -> DataFrame:
    """``keys, first, last, trigger`` (values of ``pos``)``, n, opened, closed, split, reopened`` for each segment.

    ``layout``: a struct of ``hash, rows, columns, box, count``.
    """
    rows = numbered_samples(samples, keys, pos, level, layout, strength)
    total = rows.groupBy(*keys).agg(F.max("_i").alias("_end"))
    active = rows.where("_level IN ('strong', 'weak')")
    # between pieces lie more negatives than the machine, and the search for reopened segments, look over
    pieces = islands(active, keys, "_i", max(limits.reopen_to, limits.gap) + 2).drop(pos)
    joined = pieces.join(total, keys) if keys else pieces.crossJoin(total)
    kinds = {k: samples.schema[k].dataType.simpleString() for k in keys}
    schema = ", ".join([*[f"`{k}` {t}" for k, t in kinds.items()], "_a long, _z long, _t long, opened string, closed string, split boolean, reopened int"])
    names = [*keys, "_a", "_z", "_t", "opened", "closed", "split", "reopened"]

    def made(key: tuple, segments: list[Segment]) -> list[tuple]:
        return [(*key, s.first, s.last, s.trigger, s.opened, s.closed, s.split, len(s.gaps)) for s in segments]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, piece, last = TextMachine(limits), None, 0
        for batch in batches:
            out = []
            ids = batch[[*keys, "island"]].itertuples(index=False, name=None)
            for who, i, lv, lay, strength, end in zip(ids, batch["_i"], batch["_level"], batch["_layout"], batch["_strength"], batch["_end"]):
                if who != piece:
                    if piece is not None:
                        out += made(piece[:-1], machine.end(last))
                    piece, last = who, int(end)
                shape = Layout() if lay is None else Layout(lay["hash"], *[tuple(lay[k]) if lay[k] is not None else () for k in ("rows", "columns", "box")], int(lay["count"] or 0))
                out += made(who[:-1], machine.feed(int(i), lv, shape, float(strength)))
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(made(piece[:-1], machine.end(last)) if piece is not None else [], columns=names)

    found = joined.repartition(*keys, "island").sortWithinPartitions(*keys, "island", "_i").mapInPandas(run, schema)
    # row numbers back to positions
    at = lambda name: rows.select(*keys, F.col("_i").alias(name), F.col(pos).cast("long").alias(f"{name}_pos"))
    for name in ("_a", "_z", "_t"):
        found = found.join(at(name), [*keys, name], "left")
    return found.select(*keys, F.col("_a_pos").alias("first"), F.col("_z_pos").alias("last"), F.col("_t_pos").alias("trigger"), (F.col("_z") - F.col("_a") + 1).alias("n"), "opened", "closed", "split", "reopened")


def decisions(samples: DataFrame, segments: DataFrame, keys: list[str], pos: str, level: Column, block: int = 1024) -> DataFrame:
    """``keys, pos, level, first, decision``: what each sample did; ``first`` names the segment that it lies in or closed.

    Samples meet segments in blocks of positions.
    """
    rows = samples.select(*keys, F.col(pos).cast("long").alias(pos), F.coalesce(level, F.lit("negative")).alias("level")).where(F.col(pos).isNotNull())
    rows = rows.groupBy(*keys, pos).agg(F.min("level").alias("level")).withColumn("_b", F.floor(F.col(pos) / block))
    cut = segments.select(*keys, F.struct("first", "last", "split", "reopened").alias("_s"), F.explode(F.sequence(F.floor(F.col("first") / block), F.floor(F.col("last") / block))).alias("_b"))
    inside = rows.join(cut, [*keys, "_b"], "left").withColumn("_s", F.when(F.col(pos).between(F.col("_s.first"), F.col("_s.last")), F.col("_s")))
    inside = inside.groupBy(*keys, pos, "level").agg(F.max("_s").alias("_s"))
    closing = segments.groupBy(*keys, F.col("trigger").alias(pos)).agg(F.max("first").alias("_closed"))
    both = inside.join(closing, [*keys, pos], "left")
    held = F.when(F.col(pos) == F.col("_s.first"), F.when(F.col("_s.split"), "split_on_layout_transition").otherwise("open_candidate"))
    held = held.when(F.col("level") == "negative", "bridged_gap").when(F.col("level") == "weak", "continue_weak").otherwise("continue_candidate")
    decision = F.when(F.col("_s").isNotNull(), held).when(F.col("_closed").isNotNull(), "close_candidate").when(F.col("level") == "negative", "negative").otherwise("unconfirmed")
    return both.select(*keys, pos, "level", F.coalesce("_s.first", "_closed").alias("first"), decision.alias("decision"))
