"""Sinks: canonical JSON lines, CSV and Parquet written beside the target and swapped in, with a manifest of digests."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _ordered(value: Column, kind: T.DataType) -> Column:
    """The value with the fields of its structs, at any depth, in order of name, and maps in order of key."""
    if isinstance(kind, T.StructType):
        fields = [_ordered(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _ordered(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), _ordered(e["value"], kind.valueType).alias("value")))))
    return value


def canonical_json(columns: list[str], schema: T.StructType | None = None) -> Column:
    """One JSON object with nulls written and keys sorted; at every depth where the table's ``schema`` is given."""
    value = lambda c: _ordered(F.col(c), schema[c].dataType).alias(c) if schema else F.col(c)
    return F.to_json(F.struct(*[value(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def manifest(df: DataFrame, key: str) -> DataFrame:
    """``key, digest``: SHA-256 of each row's canonical JSON."""
    return df.select(key, F.sha2(canonical_json([c for c in df.columns if c != key], df.schema), 256).alias("digest"))


def table_digest(df: DataFrame) -> str:
    """An order-free digest of a whole table: sums of row hashes and the row count."""
    h = F.xxhash64(canonical_json(df.columns, df.schema)).cast("decimal(38,0)")
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("s")).collect()[0]
    return f"{row.n}:{row.s}"


def check_target(path: str, allowed_root: str) -> str:
    """The path, if it lies strictly inside ``allowed_root``; anything else is refused."""
    full, root = os.path.abspath(path), os.path.abspath(allowed_root)
    if full == root or os.path.commonpath([full, root]) != root:
        raise ValueError(f"{path} is not inside {allowed_root}")
    return full


class Staged:
    """Outputs written to staging folders and swapped in together; if one swap fails, all are put back."""

    def __init__(self, spark: SparkSession, allowed_root: str):
        self.spark, self.root = spark, allowed_root
        self.outputs: list[tuple[str, str]] = []
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(allowed_root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, path: str, kind: str = "parquet", **options) -> None:
        """Stage a table; ``jsonl`` writes canonical JSON lines."""
        target = check_target(path, self.root)
        staging = f"{target}.staging-{uuid.uuid4().hex}"
        if kind == "jsonl":
            df.select(canonical_json(df.columns, df.schema)).write.text(staging)
        else:
            df.write.format(kind).options(**({"header": True} | options if kind == "csv" else options)).save(staging)
        self.outputs.append((staging, target))

    def _rename(self, a: str, b: str) -> None:
        if not self._fs.rename(self._path(a), self._path(b)):
            raise OSError(f"{a} can't be renamed to {b}")

    def _exists(self, a: str) -> bool:
        return self._fs.exists(self._path(a))

    def commit(self, checks=None) -> None:
        """Run ``checks()`` (it raises on failure), then swap all outputs in."""
        moved: list[tuple[str, str | None]] = []
        try:
            if checks:
                checks()
            for staging, target in self.outputs:
                old = f"{target}.old-{uuid.uuid4().hex}" if self._exists(target) else None
                if old:
                    self._rename(target, old)
                moved.append((target, old))
                self._rename(staging, target)
        except BaseException:
            for target, old in reversed(moved):
                if self._exists(target) and (old is None or self._exists(old)):
                    self._fs.delete(self._path(target), True)
                if old:
                    self._rename(old, target)
            self.discard()
            raise
        for _, old in moved:
            if old:
                self._fs.delete(self._path(old), True)
        self.outputs = []

    def discard(self) -> None:
        for staging, _ in self.outputs:
            if self._exists(staging):
                self._fs.delete(self._path(staging), True)
        self.outputs = []
