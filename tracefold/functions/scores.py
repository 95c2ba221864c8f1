"""Numeric feature columns: fingerprints, weighted scores, thresholds, geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(col: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def hex_hamming(a: Column, b: Column) -> Column:
    """Similarity of two hex strings: 1 minus the share of bits that differ; 0 if one is missing or lengths differ."""
    width = 12
    chunks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(a) - 1) / width).cast("int")))
    part = lambda s, i: F.conv(F.substring(s, i * width + 1, F.lit(width)), 16, 10).cast("long")
    bits = F.aggregate(chunks, F.lit(0), lambda s, i: s + F.bit_count(part(a, i).bitwiseXOR(part(b, i))))
    usable = a.isNotNull() & b.isNotNull() & (F.length(a) == F.length(b)) & (F.length(a) > 0)
    return F.when(usable, 1 - bits / (4 * F.length(a))).otherwise(F.lit(0.0))


def array_mae(a: Column, b: Column) -> Column:
    """Mean absolute difference of two arrays of equal length."""
    parts = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def histogram_intersection(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def correlation(a: Column, b: Column) -> Column:
    # the mean is bound once, as the element of an array of its own, not summed again for each value
    mean = lambda x: F.array(F.aggregate(x, F.lit(0.0), lambda s, w: s + w) / F.size(x))
    centred = lambda x: F.get(F.transform(mean(x), lambda m: F.transform(x, lambda v: v - m)), 0)
    return cosine(centred(a), centred(b))


def weighted(parts: list[tuple[float, Column]]) -> Column:
    out = F.lit(0.0)
    for weight, col in parts:
        out = out + weight * col
    return out


def best_label(scores: Column, thresholds: dict[str, float], unknown: str = "UNKNOWN") -> Column:
    """The label with the largest score among those at or above their threshold; ties to the order of ``thresholds``."""
    rows = F.array(*[F.struct(scores[k].alias("s"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, k in enumerate(thresholds)])
    over = F.filter(rows, lambda r: F.coalesce(r["s"] >= F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv])[r["k"]], F.lit(False)))
    return F.coalesce(F.array_max(over)["k"], F.lit(unknown))


def pixel_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """A normalised box in pixels: starts down, ends up, inside the frame."""
    inside = lambda v, most: F.greatest(F.lit(0), F.least(v, most)).cast("int")
    return F.struct(
        inside(F.floor(x0 * width), width).alias("left"),
        inside(F.floor(y0 * height), height).alias("top"),
        inside(F.ceil(x1 * width), width).alias("right"),
        inside(F.ceil(y1 * height), height).alias("bottom"),
    )


def rotation(col: Column) -> Column:
    """Counter-clockwise degrees to clockwise, 0 to 359."""
    return F.pmod(-col, F.lit(360))


def change_class(before: Column, after: Column, dead: float = 0.5) -> Column:
    return F.when(before.isNull() | after.isNull(), "unknown").when(after - before >= dead, "increase").when(before - after >= dead, "decrease").otherwise("steady")


def product(values: Column) -> Column:
    return F.aggregate(values, F.lit(1.0), lambda s, x: s * x)


def has_pairs(have: Column, wanted: Column) -> Column:
    """Whether map ``have`` holds every pair of map ``wanted``."""
    return F.forall(F.map_entries(wanted), lambda e: have[e["key"]].eqNullSafe(e["value"]))


# Weights of the parts of an appearance's similarity.
APPEARANCE = {"near": 0.50, "correlation": 0.25, "edges": 0.15, "histogram": 0.10}


def appearance(a: Column, b: Column, edges_a: Column, edges_b: Column, histogram_a: Column, histogram_b: Column, scale: float) -> Column:
    """Similarity of two pictures as arrays: mean differences of values and edges over ``scale``, correlation and histograms."""
    flat = F.coalesce(clamp(correlation(a, b), -1, 1), F.lit(0.0))
    parts = {"near": 1 - array_mae(a, b) / scale, "correlation": (flat + 1) / 2, "edges": 1 - array_mae(edges_a, edges_b) / scale, "histogram": histogram_intersection(histogram_a, histogram_b)}
    return clamp(weighted([(APPEARANCE[k], v) for k, v in parts.items()]), 0, 1)


def steps(values: Column) -> Column:
    """Absolute differences of neighbours: the edges of a one-dimensional picture."""
    return F.zip_with(F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values) - 1), lambda x, y: F.abs(x - y))


def histogram(values: Column, low: float, high: float, bins: int) -> Column:
    """Shares of the values in equal bins; what lies outside counts in the first or last."""
    at = lambda v: clamp(F.floor((v - low) / (high - low) * bins), 0, bins - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.size(F.filter(values, lambda v: at(v) == i)) / F.size(values))


def slots(x: Column, y: Column, width: Column, height: Column, count: Column, down: Column, top: Column, bottom: Column) -> Column:
    """A box cut into ``count`` slots along one side, its margins (shares of that side) left out: ``no, x, y, width, height``."""
    side = F.when(down, height).otherwise(width)
    lead, trail = F.bround(side * top).cast("int"), F.bround(side * bottom).cast("int")
    edge = lambda i: (lead + F.bround(i * (side - lead - trail) / count)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.struct(
            (i + 1).alias("no"),
            F.when(down, x).otherwise(x + edge(i)).alias("x"),
            F.when(down, y + edge(i)).otherwise(y).alias("y"),
            F.when(down, width).otherwise(edge(i + 1) - edge(i)).alias("width"),
            F.when(down, edge(i + 1) - edge(i)).otherwise(height).alias("height"),
        ),
    )


def extended_up(top: Column, height: Column, share: float = 0.75) -> Column:
    """A box's top moved up by a share of its height, not above the frame."""
    return F.greatest(F.lit(0), F.bround(top - height * share).cast("int"))


def picture_quality(proposal: Column, structure: Column, is_text: Column) -> Column:
    """How good a frame shows a candidate: its proposal and its structure, weighted by kind."""
    return F.bround(F.when(is_text, 0.65 * proposal + 0.35 * structure).otherwise(0.7 * proposal + 0.3 * structure), 6)


def brighter_slot(left: Column, right: Column) -> Column:
    """``slot, confidence`` of the brighter of two, unknown where they differ by too little."""
    margin = F.abs(left - right)
    known = margin >= 0.025
    slot = F.when(known & (left > right), "left").when(known, "right").otherwise("unknown")
    return F.struct(slot.alias("slot"), F.bround(F.coalesce(F.when(known, F.least(F.lit(1.0), margin / 0.12)).otherwise(margin / 0.025), F.lit(0.0)), 6).alias("confidence"))


def multiplier_label(x: Column) -> Column:
    """What a multiplier comes to in words."""
    return F.when(x == 0, "immune").when(x > 1, "super_effective").when(x < 1, "not_very_effective").when(x == 1, "neutral")
