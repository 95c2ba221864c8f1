"""Votes of noisy readings: consensus of exact texts, and of clusters of similar texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracefold.operators.machines import fold


def effective_weight(confidence: Column, frame_quality: Column, variant_quality: Column) -> Column:
    return confidence * (0.45 + 0.35 * frame_quality + 0.2 * variant_quality)


def exact_consensus(votes: DataFrame, keys: list[str], text: str, weight: str, moment: str) -> DataFrame:
    """Per group the text with the best score ``.58 support + .42 confidence``: a text's support is the share of the
    group's moments at which it was read, its confidence the mean of the best weight of each.

    ``keys, best_text, support, consensus, disagreement, n_votes, n_texts``.
    """
    usable = votes.where(F.length(text) > 0)
    cell = usable.groupBy(*keys, text, moment).agg(F.max(weight).alias("_w"), F.count(F.lit(1)).alias("_n"))
    by_text = cell.groupBy(*keys, text).agg(F.count(F.lit(1)).alias("_moments"), F.avg("_w").alias("_conf"), F.sum("_n").alias("_votes"))
    total = usable.groupBy(*keys).agg(F.countDistinct(F.struct(moment)).alias("_all"), F.count(F.lit(1)).alias("n_votes"), F.countDistinct(text).alias("n_texts"))
    scored = by_text.join(total, keys).withColumn("_support", F.col("_moments") / F.col("_all"))
    score = F.bround(0.58 * F.col("_support") + 0.42 * F.col("_conf"), 9)
    rank = Window.partitionBy(*keys).orderBy(F.desc(score), F.desc(text))
    best = scored.withColumn("_r", F.row_number().over(rank)).where("_r = 1")
    dominant = F.col("_votes") / F.col("n_votes")
    return best.select(
        *keys,
        F.col(text).alias("best_text"),
        F.bround("_support", 6).alias("support"),
        F.bround(0.45 * F.col("_conf") + 0.35 * F.col("_support") + 0.2 * dominant, 6).alias("consensus"),
        F.bround(1 - dominant, 6).alias("disagreement"),
        "n_votes",
        "n_texts",
    )


def cluster_texts(items: list[tuple[str, float]], least: float) -> list[int]:
    """Greedy clusters of ``(text, weight)`` in order: the first cluster whose heaviest text is similar enough takes it."""
    heads: list[tuple[str, float]] = []
    out = []
    for text, weight in items:
        for k, (head, best) in enumerate(heads):
            if text_similarity(text, head) >= least:
                out.append(k)
                if weight > best:
                    heads[k] = (text, weight)
                break
        else:
            out.append(len(heads))
            heads.append((text, weight))
    return out


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, with one bit for each character of ``a``."""
    if not a:
        return len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for c in b:
        here = places.get(c, 0)
        stay = here | down
        carry = (((here & up) + up) ^ up) | here
        more, less = (down | ~(carry | up)) & full, up & carry
        distance += bool(more & top) - bool(less & top)
        more = (more << 1 | 1) & full
        less = less << 1 & full
        up, down = (less | ~(stay | more)) & full, more & stay
    return distance


def text_similarity(a: str, b: str) -> float:
    """The Python twin of ``functions.text.similarity``."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    distance = edit_distance(a, b)
    bag = 2 * sum(min(a.count(c), b.count(c)) for c in set(a)) / (len(a) + len(b))
    return 0.72 * (1 - distance / max(len(a), len(b))) + 0.28 * bag


def similar_clusters(votes: DataFrame, keys: list[str], text: str, weight: str, least: float = 0.82) -> DataFrame:
    """``keys, text, n, weight, cluster``: distinct texts of each group in greedy clusters, in order of text.

    Votes are added up by text before the fold, so a group's size is that of its
    distinct texts, not of its rows.
    """
    by_text = votes.where(F.length(text) > 0).groupBy(*keys, text).agg(F.count(F.lit(1)).alias("n"), F.max(weight).alias("weight"))
    rows = by_text.withColumn("weight", F.col("weight").cast("double"))

    def step(held: list, row: tuple) -> list[tuple]:
        held.append(row)
        return []

    def end(held: list) -> list[tuple]:
        return [(*row, cluster) for row, cluster in zip(held, cluster_texts([(t, w) for t, _, w in held], least))]

    return fold(rows, keys, [text], [text, "n", "weight"], list, step, f"`{text}` string, n long, weight double, cluster int", end)


def near_duplicates(rows: DataFrame, keys: list[str], time: str, end: str, tie: str, text: str, similarity, least: float, gap: tuple[float, float]) -> DataFrame:
    """Rows with ``group``: it stays the same while neighbours lie within ``gap`` and are similar by ``least``."""
    from tracefold.operators.sequence import lagged, running_sum

    place = F.floor(F.col(time) / 600)
    near = lagged(rows, keys, [time, tie], place, {"_e": F.col(end), "_x": F.col(text)})
    alike = (F.col(time) - F.col("_e")).between(*gap) & (similarity(F.col(text), F.col("_x")) >= least)
    return running_sum(near, keys, [time, tie], place, F.when(F.coalesce(alike, F.lit(False)), 0).otherwise(1), "group").drop("_e", "_x")
