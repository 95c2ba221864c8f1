"""Items packed into containers of fixed capacity, by conflict-constrained best fit.

Items go largest first.  Open containers are ordered by the space left; the
search starts at the tightest container that an item fits and moves to its
successors until one is compatible: containers carry a bitmap of the sources and
one of the duplicate clusters that they hold, and an item whose bit is set is not
put there.  With ``sources="prefer"`` an item that every container turns down for
its source alone goes to the tightest that its cluster allows, so that variety
costs no space; ``"never"`` opens a new container instead, ``"ignore"`` does not
look at sources.  A duplicate never joins its copy.  An item larger than the
capacity fills containers of its own; only its rest is packed.  No other item is
split, and none is dropped.

Scale: items are spread over shards by a hash of their id, ``SHARD`` items to a
shard, and each shard is packed on its own, so a source or cluster with a third
of all items is spread like any other; a shard's last containers are the only
space that packing as one whole could save.

Nulls and odd input: null and blank texts have no size and are left out, and so
are rows without an id, which could not be told apart; a null source or cluster
conflicts with nothing; repeated ids count once (the smallest
size, source and cluster); ties in size are ordered by id; an empty table gives
an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm import tokens

SHARD = 4096


def sizes(df: DataFrame, id_col: str, text_col: str, source_col: str, vocabulary: str = tokens.VOCABULARY, cluster_col: str | None = None) -> DataFrame:
    """``_id, _size, _source, _cluster`` of every text that is not blank.

    The duplicate cluster is ``cluster_col`` where one is given, and else that of
    texts equal up to case, blanks and punctuation.
    """
    plain = F.regexp_replace(F.lower(text_col), r"[\s\p{P}\p{Z}\p{C}]+", "")
    rows = df.select(
        F.col(id_col).alias("_id"),
        F.col(text_col).alias("_t"),
        F.col(source_col).cast("string").alias("_source"),
        (F.when(F.col(cluster_col).isNotNull(), F.xxhash64(cluster_col)) if cluster_col else F.when(plain != "", F.xxhash64(plain))).cast("string").alias("_cluster"),
    ).where("_t IS NOT NULL AND _id IS NOT NULL")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokens.load(vocabulary)
        for batch in batches:
            batch = batch[batch["_t"].str.strip().str.len() > 0]
            yield pd.DataFrame({"_id": batch["_id"], "_size": [tok.count(t) for t in batch["_t"]], "_source": batch["_source"], "_cluster": batch["_cluster"]})

    return rows.mapInPandas(measure, f"_id {rows.schema['_id'].dataType.simpleString()}, _size long, _source string, _cluster string")


def best_fit(items: list[tuple[int, int, str | None, int | None]], capacity: int, sources: str = "prefer") -> list[tuple[int, int, int, int, int]]:
    """``(container, id, part, start, size)`` for items ``(id, size, source, cluster)``."""
    out, todo, number = [], [], 0
    for item, size, source, cluster in items:
        full, rest = divmod(size, capacity)
        if size <= capacity:
            full, rest = 0, size
        for part in range(full):
            out.append((number, item, part, part * capacity, capacity))
            number += 1
        if rest:
            todo.append((-rest, item, full, source, cluster))
    todo.sort(key=lambda x: x[:3])
    source_bit = {s: 1 << i for i, s in enumerate(sorted({x[3] for x in todo if x[3] is not None}))} if sources != "ignore" else {}
    shared = Counter(x[4] for x in todo if x[4] is not None)
    cluster_bit = {c: 1 << i for i, c in enumerate(sorted(c for c, n in shared.items() if n > 1))}
    open_: list[tuple[int, int]] = []
    held: dict[int, tuple[int, int]] = {}
    smallest = -todo[-1][0] if todo else 0
    for minus, item, part, source, cluster in todo:
        size, s, c = -minus, source_bit.get(source, 0), cluster_bit.get(cluster, 0)
        at = bisect_left(open_, (size, -1))
        second = len(open_)
        while at < len(open_):
            have = held[open_[at][1]]
            if not have[1] & c:
                if not have[0] & s:
                    break
                second = min(second, at)
            at += 1
        if at == len(open_) and sources == "prefer":
            at = second
        if at < len(open_):
            left, box = open_.pop(at)
            have = held[box]
        else:
            left, box, have = capacity, number, (0, 0)
            number += 1
        out.append((box, item, part, part * capacity, size))
        held[box] = (have[0] | s, have[1] | c)
        if left - size >= smallest:
            insort(open_, (left - size, box))
        else:
            del held[box]
    return out


def pack(
    df: DataFrame,
    id_col: str,
    text_col: str,
    source_col: str,
    capacities: dict[int, int],
    vocabulary: str = tokens.VOCABULARY,
    shard: int = SHARD,
    sources: str = "prefer",
    cluster_col: str | None = None,
) -> DataFrame:
    """``limit_id, container, id_col, part, start_token, n_tokens`` for each of the ``capacities`` (limit id to tokens)."""
    if sources not in ("prefer", "never", "ignore"):
        raise ValueError("sources must be prefer, never or ignore")
    if any(c < 1 for c in capacities.values()):
        raise ValueError("capacities must be positive")
    shards = max(1, -(-df.count() // shard))
    measured = sizes(df, id_col, text_col, source_col, vocabulary, cluster_col)
    measured = measured.withColumn("_shard", F.pmod(F.xxhash64("_id"), F.lit(shards)).cast("int"))
    limits = sorted(capacities.items())

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["_id", "_size", "_source", "_cluster"]).drop_duplicates("_id")
        source = batch["_source"].astype(object).where(batch["_source"].notna(), None)
        cluster = batch["_cluster"].astype(object).where(batch["_cluster"].notna(), None)
        items = list(zip(batch["_id"].tolist(), batch["_size"].tolist(), source.tolist(), cluster.tolist()))
        at = int(batch["_shard"].iloc[0])
        rows = [(limit, f"{limit}-{at}-{box}", item, part, start, size) for limit, capacity in limits for box, item, part, start, size in best_fit(items, capacity, sources)]
        return pd.DataFrame(rows, columns=["limit_id", "container", "_id", "part", "start_token", "n_tokens"])

    packed = measured.groupBy("_shard").applyInPandas(run, f"limit_id int, container string, _id {measured.schema['_id'].dataType.simpleString()}, part int, start_token long, n_tokens long")
    return packed.withColumnRenamed("_id", id_col)
