"""Continuous periods and gaps from overlapping intervals, by a distributed sweep line.

Boundaries become plus and minus events, summed per entity and instant before
any shuffle.  The active count is a prefix sum: inside a block of time by a
window, across blocks through the blocks' net sums, so an entity with a third of
all rows is swept by many tasks.  A period starts where the count leaves zero
and ends where it returns; at one instant plus comes before minus, so touching
intervals form one period and an interval of no length is one.

Nulls and odd input: rows with a null start or end (or one that is no whole
number in range), or whose end lies before the start, are left out; a null id is one id, null keys are ordinary values; repeated
deliveries of one id count once (its smallest row); an empty table gives empty
results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracefold.operators.sequence import block_offsets


def clean_intervals(df: DataFrame, id_col: str, keys: list[str], start_col: str, end_col: str) -> DataFrame:
    """``_k0.., _s, _e`` of one row per id; ``start_col`` and ``end_col`` must be whole numbers."""
    row = F.struct(F.col(start_col).try_cast("long").alias("_s"), F.col(end_col).try_cast("long").alias("_e"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    rows = df.select(F.col(id_col).alias("_id"), row.alias("_row")).where("_row._s IS NOT NULL AND _row._e IS NOT NULL AND _row._e >= _row._s")
    return rows.groupBy("_id").agg(F.min("_row").alias("_row")).select("_row.*")


def _join_blocks(left: DataFrame, right: DataFrame, on_cols: list[str], extra: list[str]) -> DataFrame:
    right = right.select(*[F.col(c).alias(f"r{c}") for c in on_cols], *extra)
    on = F.lit(True)
    for c in on_cols:
        on = on & F.col(c).eqNullSafe(F.col(f"r{c}"))
    return left.join(right, on).drop(*[f"r{c}" for c in on_cols])


def sweep(df: DataFrame, id_col: str, keys: list[str], start_col: str, end_col: str, block: int = 600_000) -> DataFrame:
    """One row per period: ``keys, start, end, members, max_active, gap_start``.

    ``gap_start`` is the end of the period before it (null for the first), so
    the gap, if any, is ``gap_start .. start``.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    rows = clean_intervals(df, id_col, keys, start_col, end_col)
    edges = rows.select(*names, F.explode(F.array(F.struct(F.col("_s").alias("t"), F.lit(1).alias("p"), F.lit(0).alias("m")), F.struct(F.col("_e").alias("t"), F.lit(0).alias("p"), F.lit(1).alias("m")))).alias("_x"))
    instants = edges.select(*names, F.floor(F.col("_x.t") / block).alias("_block"), F.col("_x.t").alias("_t"), F.col("_x.p").alias("_p"), F.col("_x.m").alias("_m"))
    instants = instants.groupBy(*names, "_block", "_t").agg(F.sum("_p").alias("_p"), F.sum("_m").alias("_m"))

    by = [*names, "_block"]
    blocks = instants.groupBy(*by).agg(F.sum(F.col("_p") - F.col("_m")).alias("_net"), F.max("_t").alias("_last"))
    ahead = Window.partitionBy(*names).orderBy("_block")
    carried = blocks.withColumn("_act0", F.coalesce(F.sum("_net").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_prev0", F.lag("_last").over(ahead))
    inside = Window.partitionBy(*by).orderBy("_t")
    swept = _join_blocks(instants, carried, by, ["_act0", "_prev0"])
    swept = swept.withColumn("_after", F.col("_act0") + F.sum(F.col("_p") - F.col("_m")).over(inside)).withColumn("_before", F.col("_after") - F.col("_p") + F.col("_m"))
    swept = swept.withColumn("_open", (F.col("_before") == 0).cast("int")).withColumn("_prev", F.coalesce(F.lag("_t").over(inside), F.col("_prev0")))
    swept = swept.withColumn("_n", F.sum("_open").over(inside))

    opened = block_offsets(swept.groupBy(*by).agg(F.sum("_open").alias("_o")), names, "_block", {"_o": "_n0"})
    swept = _join_blocks(swept, opened, by, ["_n0"]).withColumn("_no", F.col("_n0") + F.col("_n"))
    periods = swept.groupBy(*names, "_no").agg(
        F.min("_t").alias("start"),
        F.max("_t").alias("end"),
        F.sum("_p").alias("members"),
        F.max(F.col("_before") + F.col("_p")).alias("max_active"),
        F.min(F.when(F.col("_open") == 1, F.col("_prev"))).alias("gap_start"),
    )
    return periods.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "start", "end", "members", "max_active", "gap_start")


def periods_and_gaps(df: DataFrame, id_col: str, keys: list[str], start_col: str, end_col: str, min_members: int = 1, max_gap: int | None = None, block: int = 600_000) -> DataFrame:
    """``keys, kind, start, end``: periods of ``min_members`` ids or more, and gaps of at most ``max_gap``."""
    swept = sweep(df, id_col, keys, start_col, end_col, block)
    gap = F.struct(F.lit("gap").alias("kind"), F.col("gap_start").alias("start"), F.col("start").alias("end"))
    period = F.struct(F.lit("period").alias("kind"), F.col("start"), F.col("end"))
    wide = F.lit(True) if max_gap is None else (F.col("start") - F.col("gap_start") <= max_gap)
    made = F.filter(F.array(F.when(F.col("members") >= min_members, period), F.when(F.col("gap_start").isNotNull() & wide, gap)), lambda x: x.isNotNull())
    return swept.select(*keys, F.explode(made).alias("_x")).select(*keys, "_x.kind", "_x.start", "_x.end")
