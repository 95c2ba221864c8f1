"""Runs of repeated events, collapsed by a sorted streaming state machine.

Each task reads its entities' events in order and keeps one anchor and one open
run; an event that is like the anchor within the tolerances extends the run,
any other closes it.  ``anchor="previous"`` compares with the event before it,
``anchor="first"`` with the first event of the run.

An entity is cut into blocks of the order column, so one that holds a third of
all rows is read by many tasks.  Within a block the machine emits finished runs;
with ``anchor="previous"`` the runs at block borders are then joined, over one
row per block and border.  With ``anchor="first"`` a run's extent depends on
everything before it, so whole entities are read in order (still streamed, with
constant state).

Nulls and odd input: events with a null order column are left out; labels that
are both null are alike; features are alike when all of them are null on both
sides or none differs by more than the tolerance (null against a value, or NaN
against a value, is a difference); a null time never continues a run; repeated
deliveries of one (entity, order) count once (the smallest by time, label and
features); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracefold.functions.text import state_label  # noqa: F401

EPS = 1e-9


def _alike(times, labels, feats, anchors, i, j, gap, tol) -> np.ndarray:
    """Whether event ``i`` is like ``j`` (index arrays); the features of ``j`` are taken from ``anchors``."""
    near = np.abs(times[i] - times[j]) <= gap + EPS
    a, b = feats[i], anchors[j]
    none_a, none_b = np.isnan(a).all(1), np.isnan(b).all(1)
    close = ((np.abs(a - b) <= tol + EPS) | (np.isnan(a) & np.isnan(b))).all(1) & (none_a == none_b)
    return near & (labels[i] == labels[j]) & close


class RunMachine:
    """Events of one task, in order; ``push`` takes a batch and returns the runs that it finished.

    The state is one row: the last event of the open run, with the run's count
    (``_c``) and its first event's order, time and features (``_of``, ``_tf``,
    ``_f0``...).
    """

    def __init__(self, gap: float, tol: float, anchor: str, features: list[str]):
        self.gap, self.tol, self.anchor, self.features = gap, tol, anchor, features
        self.first_of = {c: f"_f{i}" for i, c in enumerate(features)} | {"_o": "_of", "_t": "_tf"}
        self.open: pd.DataFrame | None = None

    def push(self, batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.assign(_c=1, **{first: batch[c] for c, first in self.first_of.items()})
        if self.open is not None:
            batch = pd.concat([self.open, batch], ignore_index=True)
        entity = pd.factorize(batch["_e"], use_na_sentinel=True)[0]
        block, order = batch["_b"].to_numpy(), batch["_o"].to_numpy()
        repeat = np.r_[False, (entity[1:] == entity[:-1]) & (block[1:] == block[:-1]) & (order[1:] == order[:-1])]
        if repeat.any():
            batch, entity, block = batch[~repeat].reset_index(drop=True), entity[~repeat], block[~repeat]
        n = len(batch)
        times = batch["_t"].to_numpy(float)
        labels = pd.factorize(batch["_l"], use_na_sentinel=True)[0]
        feats = batch[self.features].to_numpy(float).reshape(n, len(self.features))
        same_part = (entity[1:] == entity[:-1]) & (block[1:] == block[:-1])
        if self.anchor == "previous":
            at = np.arange(1, n)
            joins = same_part & _alike(times, labels, feats, feats, at, at - 1, self.gap, self.tol)
        else:
            anchors = batch[[self.first_of[c] for c in self.features]].to_numpy(float).reshape(n, len(self.features))
            joins, first = np.zeros(n - 1, bool), 0
            for i in range(1, n):
                near = same_part[i - 1] and abs(times[i] - times[i - 1]) <= self.gap + EPS
                joins[i - 1] = near and bool(_alike(times, labels, feats, anchors, np.array([i]), np.array([first]), np.inf, self.tol)[0])
                if not joins[i - 1]:
                    first = i
        starts = np.flatnonzero(np.r_[True, ~joins])
        tail = batch.iloc[starts[-1] :]
        self.open = tail.iloc[[-1]].reset_index(drop=True)
        for name in ("_of", "_tf", *[self.first_of[c] for c in self.features]):
            self.open[name] = tail[name].iloc[0]
        self.open["_c"] = tail["_c"].sum()
        return self._runs(batch.iloc[: starts[-1]], starts[:-1])

    def finish(self) -> pd.DataFrame:
        """The last run; the machine is empty after it."""
        last, self.open = self.open, None
        if last is None:
            columns = ["_e", "_b", "_l", "_c", "_o", "_t", *self.features, *self.first_of.values()]
            return self._runs(pd.DataFrame(columns=columns), np.array([], int))
        return self._runs(last, np.array([0]))

    def _runs(self, rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        ends = np.r_[starts[1:], len(rows)] - 1 if len(starts) else starts
        out = {c: rows[c].iloc[starts].to_numpy() for c in ("_e", "_b", "_l")}
        out["_n"] = np.add.reduceat(rows["_c"].to_numpy(np.int64), starts) if len(starts) else np.array([], np.int64)
        for c, name in (("_o", "_o"), ("_t", "_t"), *[(c, c) for c in self.features]):
            out[f"{name}f"] = rows[self.first_of[c]].iloc[starts].to_numpy()
            out[f"{name}z"] = rows[c].iloc[ends].to_numpy()
        return pd.DataFrame(out)


def collapse_runs(
    df: DataFrame,
    entity: str,
    order_col: str,
    time_col: str,
    label: Column,
    features: list[Column],
    max_gap: float,
    tolerance: float,
    anchor: str = "previous",
    block: int = 8192,
) -> DataFrame:
    """One row per maximal run: ``entity, label, first, last, n, start_time, end_time, duration``."""
    if anchor not in ("previous", "first"):
        raise ValueError("anchor must be previous or first")
    names = [f"_x{i}" for i in range(len(features))]
    order = F.col(order_col).try_cast("long")
    rows = df.where(order.isNotNull()).select(
        F.col(entity).cast("string").alias("_e"),
        (F.floor(order / block) if anchor == "previous" else F.lit(0).cast("long")).alias("_b"),
        order.alias("_o"),
        F.col(time_col).try_cast("double").alias("_t"),
        label.alias("_l"),
        *[c.try_cast("double").alias(n) for c, n in zip(features, names)],
    )
    rows = rows.repartition("_e", "_b").sortWithinPartitions("_e", "_b", "_o", "_t", "_l", *names)

    def machine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = RunMachine(max_gap, tolerance, anchor, names)
        for batch in batches:
            if len(batch):
                yield state.push(batch)
        yield state.finish()

    schema = "_e string, _b long, _l string, _n long"
    for side in "fz":
        schema += f", _o{side} long, _t{side} double" + "".join(f", _x{i}{side} double" for i in range(len(names)))
    runs = rows.mapInPandas(machine, schema)
    if anchor == "previous":
        runs = _stitch(runs, len(names), max_gap, tolerance)
    return runs.select(
        F.col("_e").alias(entity),
        F.col("_l").alias("label"),
        F.col("_of").alias("first"),
        F.col("_oz").alias("last"),
        F.col("_n").alias("n"),
        F.col("_tf").alias("start_time"),
        F.col("_tz").alias("end_time"),
        (F.col("_tz") - F.col("_tf")).alias("duration"),
    )


def _stitch(runs: DataFrame, k: int, gap: float, tol: float) -> DataFrame:
    """Join the runs that go on over block borders."""
    inside = Window.partitionBy("_e", "_b")
    marked = runs.withColumns({"_fst": F.col("_of") == F.min("_of").over(inside), "_lst": F.col("_oz") == F.max("_oz").over(inside)})
    ahead = Window.partitionBy("_e").orderBy("_of")
    edge = marked.where("_fst OR _lst")
    last = lambda c: F.lag(c).over(ahead)
    nan_null = lambda c: F.when(~F.isnan(c), F.col(c))
    close, none_a, none_b = F.lit(True), F.lit(True), F.lit(True)
    edge = edge.withColumns({f"_p{i}": last(f"_x{i}z") for i in range(k)} | {"_pt": last("_tz"), "_pl": last("_l"), "_pb": last("_b")})
    for i in range(k):
        a, b = nan_null(f"_x{i}f"), nan_null(f"_p{i}")
        close = close & (F.coalesce(F.abs(a - b) <= tol + EPS, F.lit(False)) | (a.isNull() & b.isNull()))
        none_a, none_b = none_a & a.isNull(), none_b & b.isNull()
    joins = F.col("_pb").isNotNull() & (F.col("_b") != F.col("_pb")) & F.coalesce(F.abs(F.col("_tf") - F.col("_pt")) <= gap + EPS, F.lit(False)) & F.col("_l").eqNullSafe(F.col("_pl")) & close & (none_a == none_b)
    edge = edge.withColumn("_no", F.sum(F.when(joins, 0).otherwise(1)).over(ahead.rowsBetween(Window.unboundedPreceding, 0)))
    pick = ["_e", "_l", "_n", "_of", "_oz", "_tf", "_tz"]
    joined = edge.groupBy("_e", "_no").agg(
        F.min_by("_l", "_of").alias("_l"),
        F.sum("_n").alias("_n"),
        F.min("_of").alias("_of"),
        F.max("_oz").alias("_oz"),
        F.min_by("_tf", "_of").alias("_tf"),
        F.max_by("_tz", "_oz").alias("_tz"),
    )
    return marked.where("NOT (_fst OR _lst)").select(*pick).unionByName(joined.select(*pick))
