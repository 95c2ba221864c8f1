"""Data-quality expectations: each is a name and a DataFrame of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.operators.sequence import lagged


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child values that no parent row has; nulls are not references."""
    wanted = child.where(F.col(column).isNotNull())
    return wanted.join(parent.select(F.col(parent_column).alias(column)).distinct(), column, "left_anti")


def array_orphans(child: DataFrame, child_id: str, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    refs = child.select(child_id, F.explode(column).alias("ref"))
    return orphans(refs, "ref", parent, parent_column)


def broken(df: DataFrame, rule: Column) -> DataFrame:
    """Rows for which ``rule`` is false; unknown is not broken."""
    return df.where(~rule)


def not_ascending(df: DataFrame, keys: list[str], order: str, value: str, block: int = 4096) -> DataFrame:
    """Rows whose value lies below that of the row before."""
    rows = lagged(df.where(F.col(value).isNotNull()), keys, [order], F.floor(F.col(order) / block), {"was": F.col(value)})
    return rows.where(F.col(value) < F.col("was"))


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side only, with the side."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def additive(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys by what happened to them: kept, changed, removed or added (values are compared null-safely)."""
    rest = [c for c in old.columns if c != key]
    digest = lambda d, n: d.select(key, F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256).alias(n))
    both = digest(old, "_a").join(digest(new, "_b"), key, "full_outer")
    fate = F.when(F.col("_b").isNull(), "removed").when(F.col("_a").isNull(), "added").when(F.col("_a") == F.col("_b"), "kept").otherwise("changed")
    return both.select(key, fate.alias("fate"))


def not_allowed(observed: DataFrame, allowed: DataFrame, columns: list[str]) -> DataFrame:
    """Observed rows whose ``columns`` match no allowed row exactly; null matches null."""
    on = F.lit(True)
    a, b = observed.alias("a"), allowed.select(*columns).distinct().alias("b")
    for c in columns:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, on, "left_anti")


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """``check, violations`` of all expectations, those without violations too."""
    counts = [df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations") for name, df in checks.items()]
    return reduce(DataFrame.unionByName, counts)


def require(checks: dict[str, DataFrame]) -> None:
    """Raise one error that names every expectation with violations."""
    failed = {r["check"]: r["violations"] for r in report(checks).where("violations > 0").collect()}
    if failed:
        raise ValueError(f"expectations broken: {failed}")
