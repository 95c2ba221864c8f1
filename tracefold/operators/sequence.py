"""Exact positions in long sequences, without one task per entity.

A plain ``row_number() over (partition by entity order by t)`` puts an entity
that holds a third of all rows into one task.  Here rows are numbered inside
blocks of the order column and the counts of the blocks (a table smaller by the
block's size) give each block its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def block_offsets(blocks: DataFrame, keys: list[str], block: str, sums: dict[str, str]) -> DataFrame:
    """Exclusive running sums over the blocks of each entity: ``sums`` maps column to new name."""
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(*keys, block, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for c, n in sums.items()])


def with_halo(df: DataFrame, position: str, size: int, halo: int, chunk: str = "_chunk", core: str = "_core") -> DataFrame:
    """Cut 0-based exact ``position`` into chunks of ``size`` rows; the ``halo`` rows on either side come along.

    Each row appears once with ``core`` true, and again, with ``core`` false, in
    the neighbour chunk whose edge is at most ``halo`` rows away.
    """
    if halo * 2 > size:
        raise ValueError("halo must be at most half of size")
    at, inside = F.col(position), F.col(position) % size
    own = F.floor(at / size)
    places = F.filter(
        F.array(own, F.when(inside < halo, own - 1), F.when(inside >= size - halo, own + 1)),
        lambda c: c.isNotNull() & (c >= 0),
    )
    return df.withColumn(chunk, F.explode(places)).withColumn(core, F.col(chunk) == F.floor(F.col(position) / size))


def join_on(left: DataFrame, right: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``cols`` in which null equals null; the columns of ``left`` are kept once."""
    named = right.select(*[F.col(c).alias(f"_r_{c}") if c in cols else F.col(c) for c in right.columns])
    on = F.lit(True)
    for c in cols:
        on = on & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(named, on, how).drop(*[f"_r_{c}" for c in cols])


def lagged(df: DataFrame, keys: list[str], order: list[str], block: Column, prior: dict[str, Column]) -> DataFrame:
    """``df`` with the value of each column of ``prior`` on the row before, per entity in ``order``.

    ``block`` must not decrease along ``order``.  Rows are compared inside
    blocks; a block's first row gets the last row of the block before it, from
    one row per block.
    """
    rows = df.withColumn("_block", block).withColumn("_now", F.struct(*[c.alias(n) for n, c in prior.items()]))
    at = F.struct(*order)
    ahead = Window.partitionBy(*keys).orderBy("_block")
    edges = rows.groupBy(*keys, "_block").agg(F.max_by("_now", at).alias("_end"))
    edges = edges.withColumn("_carry", F.lag("_end").over(ahead)).drop("_end")
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    first = F.row_number().over(inside) == 1
    rows = join_on(rows, edges, [*keys, "_block"])
    rows = rows.withColumn("_was", F.when(first, F.col("_carry")).otherwise(F.lag("_now").over(inside)))
    return rows.withColumns({n: F.col("_was")[n] for n in prior}).drop("_now", "_carry", "_was", "_block")


def running_sums(df: DataFrame, keys: list[str], order: list[str], block: Column, values: dict[str, Column]) -> DataFrame:
    """``df`` with running sums (new name to what is summed) up to each row, per entity in ``order``, added up over blocks."""
    rows = df.withColumn("_block", block).withColumns({f"_x_{n}": v for n, v in values.items()})
    blocks = rows.groupBy(*keys, "_block").agg(*[F.sum(f"_x_{n}").alias(f"_s_{n}") for n in values])
    offsets = block_offsets(blocks, keys, "_block", {f"_s_{n}": f"_0_{n}" for n in values})
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = join_on(rows, offsets, [*keys, "_block"])
    rows = rows.withColumns({n: F.col(f"_0_{n}") + F.sum(f"_x_{n}").over(inside) for n in values})
    return rows.drop("_block", *[f"_{k}_{n}" for n in values for k in "x0"])


def running_sum(df: DataFrame, keys: list[str], order: list[str], block: Column, value: Column, name: str) -> DataFrame:
    return running_sums(df, keys, order, block, {name: value})


def last_known(df: DataFrame, keys: list[str], order: list[str], block: Column, value: Column, name: str) -> DataFrame:
    """``df`` with the last value of ``value`` that is not null, at or before each row."""
    rows = df.withColumn("_block", block).withColumn("_x", value)
    at = F.struct(*order)
    ahead = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    edges = rows.groupBy(*keys, "_block").agg(F.max_by("_x", F.when(F.col("_x").isNotNull(), at)).alias("_end"))
    edges = edges.withColumn("_carry", F.last("_end", True).over(ahead)).drop("_end")
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = join_on(rows, edges, [*keys, "_block"])
    return rows.withColumn(name, F.coalesce(F.last("_x", True).over(inside), F.col("_carry"))).drop("_x", "_carry", "_block")
