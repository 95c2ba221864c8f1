"""Pairs of records of two tables that lie nearest in time, per entity, within a tolerance.

Times fall into buckets as wide as the tolerance, so a partner can only lie in
the same bucket or in one beside it: the left side is repeated into three
buckets and joined on (entity, bucket), the difference is checked and the
smallest kept.  Ties go to the smallest right key.  The join key is as fine as
the tolerance, so an entity with a third of all rows is spread by its buckets;
repeated deliveries are dropped before the join.

Nulls and odd input: rows with a null, NaN or infinite time, or a null entity,
have no partner and give no row; repeated rows count once; a left key delivered with
several times keeps its smallest; an empty table gives an empty result; other
columns are ignored, and those kept get the names asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FARTHEST = 1.7e308


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    left_entity: str,
    left_time: Column,
    right_key: str,
    right_entity: str,
    right_time: Column,
    tolerance: float,
) -> DataFrame:
    """``_left, _entity, _right, _delta``: each left key with its nearest right key and the time difference (right minus left)."""
    if tolerance <= 0:
        raise ValueError("tolerance must be positive")
    ok = F.abs("_t").between(0, _FARTHEST) & F.col("_entity").isNotNull()
    asks = left.select(F.col(left_key).alias("_left"), F.struct(F.col(left_entity).alias("_entity"), left_time.try_cast("double").alias("_t")).alias("_x"))
    asks = asks.where(F.abs("_x._t").between(0, _FARTHEST) & F.col("_x._entity").isNotNull())
    asks = asks.groupBy("_left").agg(F.min(F.struct("_x._t", "_x._entity")).alias("_x")).select("_left", "_x._entity", "_x._t")
    bucket = F.floor(F.col("_t") / tolerance)
    step = lambda n: F.coalesce(F.try_add(bucket, F.lit(n)), bucket)
    asks = asks.withColumn("_bucket", F.explode(F.array_distinct(F.array(step(-1), bucket, step(1)))))
    items = right.select(F.col(right_key).alias("_right"), F.col(right_entity).alias("_entity"), right_time.try_cast("double").alias("_t")).where(ok)
    items = items.withColumn("_bucket", F.floor(F.col("_t") / tolerance)).repartition("_entity", "_bucket").dropDuplicates(["_entity", "_bucket", "_t", "_right"]).withColumnRenamed("_t", "_rt")
    delta = F.col("_rt") - F.col("_t")
    near = asks.join(items, ["_entity", "_bucket"]).where(F.abs(delta) <= tolerance + 1e-9)
    best = near.groupBy("_left", "_entity").agg(F.min(F.struct(F.abs(delta).alias("d"), F.col("_right").alias("r"), delta.alias("s"))).alias("_b"))
    return best.select("_left", "_entity", F.col("_b.r").alias("_right"), F.col("_b.s").alias("_delta"))
