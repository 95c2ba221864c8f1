"""Time: resampling, as-of and interval joins, islands, sessions, window assignment.

Entities are never sorted in one task: sequences are cut into blocks of time or
position (see ``sequence``), intervals into buckets that become join keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.operators.sequence import lagged, last_known, running_sum

BLOCK_SECONDS = 600.0


def islands(df: DataFrame, keys: list[str], pos: str, max_step: int, block: int = 4096) -> DataFrame:
    """Rows with ``island``: a number that grows when ``pos`` steps by more than ``max_step``."""
    place = F.floor(F.col(pos) / block)
    rows = lagged(df, keys, [pos], place, {"_was_pos": F.col(pos)})
    new = F.when(F.col("_was_pos").isNull() | (F.col(pos) - F.col("_was_pos") > max_step), 1).otherwise(0)
    return running_sum(rows, keys, [pos], place, new, "island").drop("_was_pos")


def threshold_intervals(samples: DataFrame, keys: list[str], pos: str, time: str, score: str, threshold: Column, max_gap: int, least: Column) -> DataFrame:
    """Candidate intervals: runs of samples at or above ``threshold`` at most ``max_gap`` missing positions apart.

    An interval shorter than ``least`` positions is dropped; ``mean_score`` is
    over all samples of its span, also those under the threshold.
    """
    base = samples.select(*keys, F.col(pos).alias("_pos"), F.col(time).alias("_time"), F.col(score).alias("_score"), threshold.alias("_thr"), least.alias("_least")).where("_score IS NOT NULL")
    hits = islands(base.where("_score >= _thr"), keys, "_pos", max_gap + 1)
    spans = hits.groupBy(*keys, "island").agg(F.min("_pos").alias("first_pos"), F.max("_pos").alias("last_pos"), F.count(F.lit(1)).alias("n_hits"), F.max("_least").alias("_least"))
    spans = spans.where("last_pos - first_pos + 1 >= _least").drop("_least")
    # the span's samples, met in blocks of positions
    cut = spans.withColumn("_block", F.explode(F.sequence(F.floor(F.col("first_pos") / 1024), F.floor(F.col("last_pos") / 1024))))
    inside = base.drop("_thr", "_least").withColumn("_block", F.floor(F.col("_pos") / 1024)).join(cut, [*keys, "_block"]).where("_pos BETWEEN first_pos AND last_pos")
    return inside.groupBy(*keys, "first_pos").agg(
        F.max("last_pos").alias("last_pos"),
        F.min("_time").alias("start_time"),
        F.max("_time").alias("end_time"),
        F.count(F.lit(1)).alias("n_samples"),
        F.max("n_hits").alias("n_hits"),
        F.avg("_score").alias("mean_score"),
    )


def kind_intervals(samples: DataFrame, keys: list[str], pos: str, time: str, scores: str, limits: dict[str, tuple[float, int]], max_gap: int) -> DataFrame:
    """``threshold_intervals`` for every kind of a map of scores; ``limits``: kind to threshold and least length.

    Only what reaches its threshold becomes a row; a span meets its samples, all kinds still together, in blocks of positions.
    """
    table = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(float(t)).alias("thr"), F.lit(n).alias("least"), F.col(scores)[k].alias("score")) for k, (t, n) in limits.items()])
    hits = samples.where(F.col(scores).isNotNull()).select(*keys, F.col(pos).alias("_pos"), F.explode(F.filter(table, lambda x: x["score"] >= x["thr"])).alias("_x")).select(*keys, "_pos", "_x.kind", "_x.least")
    hits = islands(hits, [*keys, "kind"], "_pos", max_gap + 1)
    spans = hits.groupBy(*keys, "kind", "island").agg(F.min("_pos").alias("first_pos"), F.max("_pos").alias("last_pos"), F.count(F.lit(1)).alias("n_hits"), F.max("least").alias("_least"))
    spans = spans.where("last_pos - first_pos + 1 >= _least").drop("_least", "island")
    cut = spans.withColumn("_block", F.explode(F.sequence(F.floor(F.col("first_pos") / 1024), F.floor(F.col("last_pos") / 1024))))
    rows = samples.select(*keys, F.col(pos).alias("_pos"), F.col(time).alias("_time"), F.col(scores).alias("_s"), F.floor(F.col(pos) / 1024).alias("_block")).where("_s IS NOT NULL")
    inside = rows.join(cut, [*keys, "_block"]).where("_pos BETWEEN first_pos AND last_pos").withColumn("_x", F.col("_s")[F.col("kind")]).where("_x IS NOT NULL")
    return inside.groupBy(*keys, "kind", "first_pos").agg(
        F.max("last_pos").alias("last_pos"), F.min("_time").alias("start_time"), F.max("_time").alias("end_time"), F.count(F.lit(1)).alias("n_samples"), F.max("n_hits").alias("n_hits"), F.avg("_x").alias("mean_score")
    )


def sessions(df: DataFrame, keys: list[str], start: str, end: str, tie: str, gap: float) -> DataFrame:
    """Rows with ``session``: it grows when a row starts more than ``gap`` after the end of the row before it."""
    place = F.floor(F.col(start) / BLOCK_SECONDS)
    rows = lagged(df, keys, [start, tie], place, {"_was_end": F.col(end)})
    new = F.when(F.col("_was_end").isNull() | (F.col(start) - F.col("_was_end") > gap), 1).otherwise(0)
    return running_sum(rows, keys, [start, tie], place, new, "session").drop("_was_end")


def targets(points: DataFrame, keys: list[str], time: str, interval: float) -> DataFrame:
    """``keys, tick, target``: every ``interval`` from an entity's first to its last time, the end included."""
    spans = points.where(F.col(time).isNotNull()).groupBy(*keys).agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    ks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_b") - F.col("_a") + 1e-9) / interval))
    return spans.select(*keys, "_a", F.explode(ks).alias("tick")).select(*keys, "tick", (F.col("_a") + F.col("tick") * interval).alias("target"))


def nearest_point(asks: DataFrame, points: DataFrame, keys: list[str], ask_time: str, point_time: str, payload: list[str]) -> DataFrame:
    """Each row of ``asks`` with the nearest point of its entity, however far; ties to the earlier point.

    The last point at or before and the first at or after come from two passes
    of ``last_known``, one of them on negated times.
    """
    p = points.where(F.col(point_time).isNotNull()).select(*keys, F.struct(F.col(point_time).alias("t"), *payload).alias("_p"), F.col(point_time).alias("_t"), F.lit(0).alias("_side"), *[F.lit(None).cast(asks.schema[c].dataType).alias(f"_a_{c}") for c in asks.columns])
    a = asks.select(*keys, F.lit(None).cast(p.schema["_p"].dataType).alias("_p"), F.col(ask_time).alias("_t"), F.lit(1).alias("_side"), *[F.col(c).alias(f"_a_{c}") for c in asks.columns])
    both = p.unionByName(a)
    place = F.floor(F.col("_t") / BLOCK_SECONDS)
    order = [f"_p.{c}" for c in payload]
    both = both.withColumn("_tie", F.struct(*order) if order else F.lit(0))
    left = last_known(both, keys, ["_t", "_side", "_tie"], place, F.col("_p"), "_before").withColumn("_neg", -F.col("_t"))
    right = last_known(left, keys, ["_neg", "_side", "_tie"], F.floor(F.col("_neg") / BLOCK_SECONDS), F.col("_p"), "_after").where("_side = 1")
    d0, d1 = F.abs(F.col("_t") - F.col("_before.t")), F.abs(F.col("_after.t") - F.col("_t"))
    best = F.when(F.col("_after").isNull() | (d0 <= d1), F.col("_before")).otherwise(F.col("_after"))
    out = right.withColumn("_best", best)
    return out.select(*[F.col(f"_a_{c}").alias(c) for c in asks.columns], F.col("_best.t").alias("near_time"), *[F.col(f"_best.{c}").alias(c) for c in payload])


def asof_latest(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, payload: list[str]) -> DataFrame:
    """Each left row with the latest right row of its entity at or before its time: struct ``latest``."""
    r = right.where(F.col(right_time).isNotNull()).select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(F.col(right_time).alias("t"), *payload).alias("_p"), *[F.lit(None).cast(left.schema[c].dataType).alias(f"_l_{c}") for c in left.columns])
    lft = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_p"].dataType).alias("_p"), *[F.col(c).alias(f"_l_{c}") for c in left.columns])
    both = lft.unionByName(r).withColumn("_tie", F.col("_p"))
    known = last_known(both, keys, ["_t", "_side", "_tie"], F.floor(F.col("_t") / BLOCK_SECONDS), F.col("_p"), "latest")
    return known.where("_side = 1").select(*[F.col(f"_l_{c}").alias(c) for c in left.columns], "latest")


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], slack: float = 0.0, bucket: float = 30.0) -> DataFrame:
    """Pairs of intervals of one entity that overlap when the left one is widened by ``slack``.

    Intervals are repeated into every time bucket that they touch; a pair is
    made in one bucket only, that of the later of the two starts.
    """
    (ls, le), (rs, re_) = left_span, right_span
    a = left.select(*keys, F.struct(*left.columns).alias("_left"), (F.col(ls) - slack).alias("_ls"), (F.col(le) + slack).alias("_le")).where("_ls IS NOT NULL AND _le >= _ls")
    b = right.select(*keys, F.struct(*right.columns).alias("_right"), F.col(rs).alias("_rs"), F.col(re_).alias("_re")).where("_rs IS NOT NULL AND _re >= _rs")
    cut = lambda d, s, e: d.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(s) / bucket), F.floor(F.col(e) / bucket))))
    pairs = cut(a, "_ls", "_le").join(cut(b, "_rs", "_re"), [*keys, "_bucket"])
    first = F.floor(F.greatest("_ls", "_rs") / bucket)
    return pairs.where((F.col("_bucket") == first) & (F.col("_ls") <= F.col("_re")) & (F.col("_rs") <= F.col("_le"))).select(*keys, "_left", "_right", F.greatest(F.lit(0.0), F.least("_le", "_re") - F.greatest("_ls", "_rs")).alias("overlap"))


def assign_windows(points: DataFrame, windows: DataFrame, keys: list[str], time: str, start: str, end: str, order: str, bucket: float = 60.0) -> DataFrame:
    """Points in windows ``[start, end)``; an entity's last window also holds its end."""
    last = windows.groupBy(*keys).agg(F.max(F.struct(order)).alias("_last")).select(*keys, F.col(f"_last.{order}").alias("_lo"))
    w = windows.join(last, keys).withColumn("_closed", F.col(order) == F.col("_lo")).where(F.col(start) <= F.col(end))
    w = w.select(*keys, F.struct(*windows.columns).alias("window"), "_closed", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))).alias("_bucket"))
    p = points.where(F.col(time).isNotNull()).select(*keys, F.struct(*points.columns).alias("point"), F.floor(F.col(time) / bucket).alias("_bucket"))
    t = F.col(f"point.{time}")
    held = (F.col(f"window.{start}") <= t) & ((t < F.col(f"window.{end}")) | (F.col("_closed") & (t <= F.col(f"window.{end}"))))
    return p.join(w, [*keys, "_bucket"]).where(held).select(*keys, "point", "window")


def first_containing(points: DataFrame, windows: DataFrame, keys: list[str], time: str, start: str, end: str, order: str, bucket: float = 60.0) -> DataFrame:
    """Each point with the first window, by ``order``, with ``start <= time <= end``; null where there is none."""
    w = windows.where(F.col(start) <= F.col(end)).select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(order).alias("_o"), F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))).alias("_bucket"))
    p = points.withColumn("_bucket", F.floor(F.col(time) / bucket))
    hit = p.join(w, [*keys, "_bucket"], "left").withColumn("_hit", F.when((F.col("_s") <= F.col(time)) & (F.col(time) <= F.col("_e")), F.col("_o")))
    return hit.groupBy(*points.columns).agg(F.min("_hit").alias("window_no"))


def largest_overlap(pairs: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Of the pairs of ``interval_join``, each left id with the right id that overlaps it most; ties to the smaller id."""
    rank = F.struct((-F.col("overlap")).alias("o"), F.col(f"_right.{right_id}").alias("r"))
    return pairs.groupBy(F.col(f"_left.{left_id}").alias(left_id)).agg(F.min(rank).alias("_b")).select(left_id, F.col("_b.r").alias("best_id"), (-F.col("_b.o")).alias("overlap"))
