"""Ordered-sequence operators: changes, running values, medians, votes, gap statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracefold.operators.sequence import join_on, lagged, last_known, running_sum
from tracefold.operators.temporal import BLOCK_SECONDS


def _blocks(time: str) -> Column:
    return F.floor(F.col(time) / BLOCK_SECONDS)


def changes(df: DataFrame, keys: list[str], time: str, tie: str, value: str, least: float, max_gap: float) -> DataFrame:
    """Rows whose ``value`` differs by ``least`` or more from the row before, at most ``max_gap`` earlier: with ``before``, ``delta``, ``gap``."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    rows = lagged(rows, keys, [time, tie], _blocks(time), {"before": F.col(value), "before_time": F.col(time)})
    rows = rows.withColumns({"delta": F.col(value) - F.col("before"), "gap": F.col(time) - F.col("before_time")})
    return rows.where((F.abs("delta") >= least) & (F.col("gap") <= max_gap))


def change_log(df: DataFrame, keys: list[str], time: str, tie: str, value: str) -> DataFrame:
    """Rows at which ``value`` differs from the last value known; nulls are skipped."""
    rows = df.where(F.col(value).isNotNull())
    rows = lagged(rows, keys, [time, tie], _blocks(time), {"before": F.col(value)})
    return rows.where(F.col("before").isNull() | (F.col("before") != F.col(value)))


def centred_median(df: DataFrame, keys: list[str], time: str, tie: str, value: str, reach: float, name: str) -> DataFrame:
    """Median of a row and its two neighbours, those further away than ``reach`` left out; a null row stays null.

    Both neighbours come from ``lagged``, the later one on negated times and ties,
    so ``tie`` is a number.
    """
    rows = lagged(df, keys, [time, tie], _blocks(time), {"_v0": F.col(value), "_t0": F.col(time)})
    rows = rows.withColumns({"_neg": -F.col(time), "_negtie": -F.col(tie)})
    rows = lagged(rows, keys, ["_neg", "_negtie"], F.floor(F.col("_neg") / BLOCK_SECONDS), {"_v1": F.col(value), "_t1": F.col(time)})
    near = lambda v, t: F.when(F.abs(F.col(t) - F.col(time)) <= reach, F.col(v))
    three = F.array_sort(F.array_compact(F.array(near("_v0", "_t0"), F.col(value), near("_v1", "_t1"))))
    n = F.size(three)
    median = F.when(n == 3, F.get(three, 1)).when(n == 2, (F.get(three, 0) + F.get(three, 1)) / 2).otherwise(F.get(three, 0))
    return rows.withColumn(name, F.when(F.col(value).isNotNull(), median)).drop("_v0", "_t0", "_v1", "_t1", "_neg", "_negtie")


def rolling_mode(df: DataFrame, keys: list[str], pos: str, value: str, name: str, block: int = 4096) -> DataFrame:
    """Most frequent value of a row and its two neighbours; ties to the earliest in order; nulls do not vote."""
    rows = lagged(df, keys, [pos], F.floor(F.col(pos) / block), {"_v0": F.col(value)}).withColumn("_neg", -F.col(pos))
    rows = lagged(rows, keys, ["_neg"], F.floor(F.col("_neg") / block), {"_v1": F.col(value)})
    first, own, last = F.col("_v0"), F.col(value), F.col("_v1")
    voted = F.when((first == own) | (first == last), first).when(own == last, own).otherwise(F.coalesce(first, own, last))
    return rows.withColumn(name, voted).drop("_v0", "_v1", "_neg")


def gap_distribution(df: DataFrame, keys: list[str], time: str, end: str, tie: str, edges: list[float]) -> DataFrame:
    """Gaps between a row's time and the end of the row before: count, least, median, 90th percentile, most, and counts by bucket.

    Percentiles by lower index need all gaps of an entity, so gaps are first
    counted by value (rounded to milliseconds): the array holds distinct gaps.
    """
    rows = lagged(df, keys, [time, tie], _blocks(time), {"_e": F.col(end)})
    gaps = rows.where("_e IS NOT NULL").select(*keys, F.bround(F.col(time) - F.col("_e"), 3).alias("gap"))
    by_value = gaps.groupBy(*keys, "gap").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys).orderBy("gap")
    upto = by_value.withColumns({"_upto": F.sum("n").over(order), "_all": F.sum("n").over(Window.partitionBy(*keys))})
    at = lambda p: F.min(F.when(F.col("_upto") > F.floor((F.col("_all") - 1) * p), F.col("gap")))
    bucket = lambda lo, hi: F.sum(F.when((F.lit(True) if lo is None else F.col("gap") >= lo) & (F.lit(True) if hi is None else F.col("gap") < hi), F.col("n")).otherwise(0))
    bounds = list(zip([None, *edges], [*edges, None]))
    return upto.groupBy(*keys).agg(F.sum("n").alias("n_gaps"), F.min("gap").alias("least"), at(0.5).alias("median"), at(0.9).alias("p90"), F.max("gap").alias("most"), *[bucket(lo, hi).alias(f"bucket_{i}") for i, (lo, hi) in enumerate(bounds)])


def delta_buckets(df: DataFrame, keys: list[str], time: str, pos: str, top: int, digits: int = 3) -> DataFrame:
    """The ``top`` most frequent rounded steps of ``time`` per entity, by count, then step."""
    rows = lagged(df, keys, [pos], F.floor(F.col(pos) / 4096), {"_t": F.col(time)})
    steps = rows.where("_t IS NOT NULL").groupBy(*keys, F.bround(F.col(time) - F.col("_t"), digits).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    rank = Window.partitionBy(*keys).orderBy(F.desc("n"), "step")
    return steps.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top)


def net_stage(df: DataFrame, keys: list[str], time: str, tie: str, change: Column, low: int, high: int) -> DataFrame:
    """Running net change, and the same held between ``low`` and ``high`` for display: ``net``, ``stage``."""
    rows = running_sum(df, keys, [time, tie], _blocks(time), change, "net")
    return rows.withColumn("stage", F.greatest(F.lit(low), F.least(F.lit(high), F.col("net"))))


def conflicts(df: DataFrame, keys: list[str], time: str, tie: str, value: str) -> DataFrame:
    """Rows that state another value than the first one known of their entity: ``known``, ``stated``."""
    first = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, F.struct(time, tie)).alias("known"))
    rows = df.where(F.col(value).isNotNull()).join(first, keys)
    return rows.where(F.col(value) != F.col("known")).withColumnRenamed(value, "stated")


def open_close(df: DataFrame, keys: list[str], time: str, tie: str, is_open: Column, is_close: Column) -> DataFrame:
    """Openings with ``closed``, the time of the next opening or closing of their entity, and ``ended``: whether that is a closing.

    ``tie`` is a number: the next row comes from ``lagged`` on negated times.
    """
    rows = df.where(is_open | is_close).withColumns({"_neg": -F.col(time), "_negtie": -F.col(tie), "_o": is_open})
    rows = lagged(rows, keys, ["_neg", "_negtie"], F.floor(F.col("_neg") / BLOCK_SECONDS), {"closed": F.col(time), "_next_open": F.col("_o")})
    return rows.where("_o").withColumn("ended", F.coalesce(~F.col("_next_open"), F.lit(False))).drop("_neg", "_negtie", "_o", "_next_open")


def seen_so_far(df: DataFrame, keys: list[str], time: str, tie: str, value: str) -> DataFrame:
    """Rows with ``n_seen``: how many different values their entity has shown up to then."""
    first = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(F.struct(time, tie)).alias("_f"))
    rows = df.join(first, [*keys, value], "left")
    return running_sum(rows, keys, [time, tie], _blocks(time), F.coalesce((F.col("_f") == F.struct(time, tie)).cast("int"), F.lit(0)), "n_seen").drop("_f")


def running_peak(df: DataFrame, keys: list[str], time: str, tie: str, value: str, name: str, block: Column | None = None) -> DataFrame:
    """Rows with the largest ``value`` up to then."""
    place = _blocks(time) if block is None else block
    rows = df.withColumn("_b", place)
    top = rows.groupBy(*keys, "_b").agg(F.max(value).alias("_m"))
    carry = top.withColumn("_m0", F.max("_m").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).drop("_m")
    inside = Window.partitionBy(*keys, "_b").orderBy(time, tie).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(carry, [*keys, "_b"]).withColumn(name, F.greatest(F.max(value).over(inside), F.col("_m0"))).drop("_b", "_m0")


def last_per_key(df: DataFrame, keys: list[str], time: str, tie: str, value: Column, name: str) -> DataFrame:
    """Rows with the last value known of their entity."""
    return last_known(df, keys, [time, tie], _blocks(time), value, name)


def even_sample(df: DataFrame, keys: list[str], time: str, tie: str, most: int) -> DataFrame:
    """At most ``most`` rows of each entity, evenly spaced from first to last."""
    rows = running_sum(df, keys, [time, tie], _blocks(time), F.lit(1), "_i").withColumn("_i", F.col("_i") - 1)
    rows = join_on(rows, df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys)
    slot = F.floor((F.col("_i") * (most - 1) + (F.col("_n") - 2)) / F.greatest(F.lit(1), F.col("_n") - 1))
    wanted = F.floor(slot * (F.col("_n") - 1) / F.lit(max(1, most - 1)))
    return rows.where((F.col("_n") <= most) | (wanted == F.col("_i"))).drop("_i", "_n")


def pages(df: DataFrame, keys: list[str], time: str, tie: str, size: int) -> DataFrame:
    """Rows with a page number: positions in their entity divided by ``size``."""
    rows = running_sum(df, keys, [time, tie], _blocks(time), F.lit(1), "_i")
    return rows.withColumn("page", F.floor((F.col("_i") - 1) / size)).drop("_i")
