"""Choosing rows: best template, frames of an interval, longest prefix, greedy assignment, first by key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.operators.machines import fold

MOST_TEMPLATES = 10_000


def class_templates(df: DataFrame, label: str, vector: str) -> DataFrame:
    """``label, template``: the mean vector of each label, added up element by element."""
    cells = df.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.posexplode(vector).alias("_i", "_x"))
    means = cells.groupBy("label", "_i").agg(F.avg("_x").alias("_m"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("template"))


def best_template(df: DataFrame, key: str, vector: str, templates: DataFrame) -> DataFrame:
    """Each row with the template most like it by cosine: ``key, label, score``; ties to the smaller label, null for a zero vector.

    Up to ``MOST_TEMPLATES`` templates, counted, each batch of rows meets them as one matrix product; beyond, templates go
    through that product in blocks of so many, by a hash of their label, and the best of each block is kept.
    """
    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("_k"), F.col(vector).alias("_v"))
    count = templates.count()
    blocks = max(1, -(-count // MOST_TEMPLATES))
    found = None
    for b in range(blocks):
        block = templates if blocks == 1 else templates.where(F.pmod(F.xxhash64("label"), F.lit(blocks)) == b)
        part = _best_of(rows, block)
        found = part if found is None else found.unionByName(part)
    if found is None or blocks == 1:
        best = found
    else:
        # the greatest score, then the smaller label
        best = found.groupBy("_k").agg(F.min(F.struct(F.coalesce(-F.col("score"), F.lit(float("inf"))).alias("s"), F.col("label"), F.col("score"))).alias("_b")).select("_k", "_b.label", "_b.score")
    return best.select(F.col("_k").alias(key), "label", "score")


def _best_of(rows: DataFrame, templates: DataFrame) -> DataFrame:
    kind = templates.schema["label"].dataType.simpleString()
    stated = sorted((r.label, list(r.template)) for r in templates.collect())
    shared = rows.sparkSession.sparkContext.broadcast(stated)

    @F.pandas_udf(f"label {kind}, score double")
    def best(vectors: pd.Series) -> pd.DataFrame:
        labels = [r[0] for r in shared.value]
        if not labels:
            return pd.DataFrame({"label": [None] * len(vectors), "score": np.full(len(vectors), np.nan)})
        table = np.array([r[1] for r in shared.value])
        with np.errstate(invalid="ignore", divide="ignore"):
            table = table / np.linalg.norm(table, axis=1, keepdims=True)
            got = np.stack([np.asarray(v, float) for v in vectors])
            scores = got @ table.T / np.linalg.norm(got, axis=1, keepdims=True)
        scores = np.where(np.isnan(scores), -np.inf, scores)
        at = scores.argmax(1)
        top = scores[np.arange(len(at)), at]
        return pd.DataFrame({"label": [labels[i] for i in at], "score": np.where(np.isinf(top), np.nan, top)})

    out = rows.select("_k", best(F.col("_v")).alias("_b"))
    return out.select("_k", F.when(F.col("_b.score").isNotNull() & ~F.isnan("_b.score"), F.col("_b.label")).alias("label"), F.nanvl("_b.score", F.lit(None).cast("double")).alias("score"))


def interval_frames(intervals: DataFrame, samples: DataFrame, keys: list[str], span: tuple[str, str], interval_id: str, time: str, position: str, score: str, bucket: float = 30.0, kind: str | None = None) -> DataFrame:
    """Per interval its first, last and best sample: ``interval_id, first_pos, last_pos, peak_pos, n``; ties to the earlier.

    With ``kind``, a column of the intervals, ``score`` is a map and an interval's score is the one of its kind.
    """
    start, end = span
    cut = intervals.select(*keys, F.col(interval_id).alias("_id"), F.col(start).alias("_s"), F.col(end).alias("_e"), (F.col(kind) if kind else F.lit(None).cast("string")).alias("_kind"), F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))).alias("_b"))
    rows = samples.select(*keys, F.col(position).alias("_p"), F.col(time).alias("_t"), F.col(score).alias("_x"), F.floor(F.col(time) / bucket).alias("_b"))
    held = cut.join(rows, [*keys, "_b"]).where("_t BETWEEN _s AND _e")
    if kind:
        held = held.withColumn("_x", F.col("_x")[F.col("_kind")])
    return held.groupBy(F.col("_id").alias(interval_id)).agg(F.min("_p").alias("first_pos"), F.max("_p").alias("last_pos"), F.max_by("_p", F.struct(F.coalesce("_x", F.lit(float("-inf"))), -F.col("_p"))).alias("peak_pos"), F.count(F.lit(1)).alias("n"))


def longest_prefix(texts: DataFrame, key: str, text: str, names: DataFrame, name: str, name_id: str) -> DataFrame:
    """Each text with the longest name that it begins with; prefixes become join keys, as far as names are long."""
    longest = names.agg(F.max(F.length(name))).collect()[0][0] or 0
    cut = texts.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(text), F.lit(longest)))), lambda i: F.substring(text, F.lit(1), i))).alias("_p"))
    hits = cut.join(names.select(F.col(name).alias("_p"), F.col(name_id).alias("_n")), "_p")
    return hits.groupBy(key).agg(F.max(F.struct(F.length("_p").alias("l"), (-F.col("_n")).alias("n"))).alias("_b")).select(key, (-F.col("_b.n")).alias(name_id), F.col("_b.l").alias("length"))


def assign(items: list[tuple[str, str, float]]) -> list[tuple[str, str, float]]:
    """Greedy one-to-one assignment of ``(left, right, score)``: best score first, then left, then right."""
    left, right, out = set(), set(), []
    for a, b, s in sorted(items, key=lambda x: (-x[2], x[0], x[1])):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            out.append((a, b, s))
    return out


def greedy_assignment(pairs: DataFrame, keys: list[str], left: str, right: str, score: str) -> DataFrame:
    """``assign`` for each group; a group is the few candidates of one decision."""
    rows = pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull() & F.col(score).isNotNull())
    rows = rows.select(*keys, F.col(left).cast("string").alias("_l"), F.col(right).cast("string").alias("_r"), F.col(score).cast("double").alias("_s"))

    def step(held: list, row: tuple) -> list[tuple]:
        held.append(row)
        return []

    return fold(rows, keys, ["_l", "_r"], ["_l", "_r", "_s"], list, step, "left string, right string, score double", assign)


def first_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in order; map-side, without a window."""
    row = F.struct(*order, *[c for c in df.columns if c not in order])
    return df.groupBy(*keys).agg(F.min(row).alias("_row")).select("_row.*")


def null_paths(df: DataFrame, prefix: str = "") -> list[str]:
    """Names of all fields, those inside structs with their path."""
    out = []
    for f in df.schema.fields:
        out.append(f.name)
        if f.dataType.typeName() == "struct":
            out += [f"{f.name}.{x.name}" for x in f.dataType.fields]
    return out
