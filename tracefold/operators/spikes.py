"""Implausible readings in measured series, judged against each source's normal behaviour.

Kinds of reading that are flagged:

``impossible``  not a number, or outside ``[low, high]``;
``excursion``   part of at most ``max_run`` readings in a row that all leave the
                level held by ``hold`` readings before and after, by at least
                ``min_jump``, and that all lie outside the expanded
                interquartile fences around that level;
``frozen``      part of ``frozen_run`` or more identical readings in a row in a
                source whose readings otherwise change (no variance there);
``rate``        (with ``rates``) reached and left, in opposite directions, by
                steps of at least ``min_jump`` whose change for each unit of
                time lies outside the expanded fences of the source's rates.

Fences.  The steps from one possible reading to the next go into quantile
sketches (KLL), one for each source and context (hour of the order column),
built map-side and merged across partitions, and again merged into one for each
source.  A context with at least ``context_least`` steps, which are not mostly
equal, is judged by its own sketch, any other by its source's.  Steps inside a
level spread by the square root of two more than the readings around it; real
changes of level are too rare to move the quartiles.  So the fences around a
level lie at the quartiles of the steps, over the square root of two, moved out
by ``fence`` interquartile ranges; 6.9 of them come to ten times the scatter of
a normal source.  ``context_fences`` gives the fences of the readings themselves.

Scale: rows are numbered exactly through block offsets and cut into chunks of
``CHUNK`` readings with a halo, so a source with a third of all rows is spread
over many tasks; a step needs only the halo, so every step is in the sketches
whatever the time between readings.  Only candidate rows meet the fences.

Nulls and odd input: readings with a null value are skipped; a null id, key or
time is an ordinary value (null times sort first); repeated deliveries of one id
count once (the smallest by time, value, keys); ties in time are ordered by id
and have no rate; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracefold.operators.sequence import block_offsets, with_halo

CHUNK = 4096
IQR_TO_SIGMA = 1.3489795
SKETCH = 800
#: Interquartile ranges between quartile and fence; with it a fence lies ten times a normal source's scatter from its level.
FENCE = 10 / IQR_TO_SIGMA - 0.5


def _readings(df: DataFrame, id_col: str, keys: list[str], order_col: str, value_col: str) -> DataFrame:
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.where(F.col(value_col).try_cast("double").isNotNull()).select(
        F.col(id_col).alias("_id"),
        F.struct(F.col(order_col).try_cast("double").alias("_t"), F.col(value_col).try_cast("double").alias("_v"), *[F.col(k).alias(n) for k, n in zip(keys, names)]).alias("_row"),
    )
    return rows.groupBy("_id").agg(F.min("_row").alias("_row")).select("_id", "_row.*")


def _bad(low: float, high: float):
    return F.isnan("_v") | (F.col("_v") < low) | (F.col("_v") > high)


def _blocked(rows: DataFrame, low: float, high: float, block_seconds: float) -> DataFrame:
    return rows.withColumn("_bad", _bad(low, high).cast("int")).withColumn("_block", F.coalesce(F.floor(F.col("_t") / block_seconds), F.lit(-(2**62))))


def _numbered(rows: DataFrame, keys: list[str], low: float, high: float, block_seconds: float) -> DataFrame:
    """Possible readings with their exact 0-based position ``_at`` and the number of impossible ones before them."""
    rows = _blocked(rows, low, high, block_seconds)
    blocks = rows.groupBy(*keys, "_block").agg(F.sum(1 - F.col("_bad")).alias("_g"), F.sum("_bad").alias("_b"))
    offsets = block_offsets(blocks, keys, "_block", {"_g": "_g0", "_b": "_b0"})
    right = offsets.select(*[F.col(k).alias(f"r{k}") for k in [*keys, "_block"]], "_g0", "_b0")
    on = F.lit(True)
    for k in [*keys, "_block"]:
        on = on & F.col(k).eqNullSafe(F.col(f"r{k}"))
    joined = rows.join(right, on).drop(*[f"r{k}" for k in [*keys, "_block"]])
    upto = Window.partitionBy(*keys, "_block").orderBy("_t", "_id").rowsBetween(Window.unboundedPreceding, 0)
    counted = joined.withColumn("_at", F.col("_g0") + F.sum(1 - F.col("_bad")).over(upto) - 1).withColumn("_seen", F.col("_b0") + F.sum("_bad").over(upto))
    return counted.where("_bad = 0").drop("_bad", "_block", "_g0", "_b0")


def _same(left: list[str], right: list[str]):
    on = F.lit(True)
    for a, b in zip(left, right):
        on = on & F.col(a).eqNullSafe(F.col(b))
    return on


def _quartiles(sketch: str):
    q = lambda p: F.kll_sketch_get_quantile_double(sketch, F.lit(p))
    return F.struct(q(0.25).alias("l"), q(0.75).alias("h"))


def context_quartiles(rows: DataFrame, keys: list[str], context: str, values: dict[str, str], least: int, k: int = SKETCH) -> DataFrame:
    """``keys, context`` with, for each of ``values`` (column to name), the quartiles ``name`` ``{l, h}`` that hold there
    and those of the whole source, ``name_all``.

    One sketch for each source and context, merged over contexts for the source;
    a context with fewer than ``least`` values, or whose quartiles are equal, has
    the source's quartiles.
    """
    by_context = rows.groupBy(*keys, context).agg(*[x for c, n in values.items() for x in (F.kll_sketch_agg_double(c, k).alias(f"_s_{n}"), F.count(c).alias(f"_n_{n}"))])
    by_source = by_context.groupBy(*[F.col(c).alias(f"_a{c}") for c in keys]).agg(*[x for n in values.values() for x in (F.kll_merge_agg_double(F.when(F.col(f"_n_{n}") > 0, F.col(f"_s_{n}")), k).alias(f"_m_{n}"), F.sum(f"_n_{n}").alias(f"_t_{n}"))])
    both = by_context.join(by_source, _same(keys, [f"_a{c}" for c in keys]))
    for n in values.values():
        both = both.withColumn(f"{n}_all", F.when(F.col(f"_t_{n}") > 0, _quartiles(f"_m_{n}")))
        both = both.withColumn("_own", F.when(F.col(f"_n_{n}") >= max(1, least), _quartiles(f"_s_{n}")))
        both = both.withColumn(n, F.when(F.col("_own.h") > F.col("_own.l"), F.col("_own")).otherwise(F.col(f"{n}_all")))
    return both.select(*keys, context, *[x for n in values.values() for x in (n, f"{n}_all")])


def flag_implausible(
    df: DataFrame,
    id_col: str,
    keys: list[str],
    order_col: str,
    value_col: str,
    low: float = 0.0,
    high: float = 100.0,
    hold: int = 5,
    max_run: int = 3,
    min_jump: float = 5.0,
    fence: float = FENCE,
    frozen_run: int = 6,
    level_scatter: float = 4.0,
    hold_scatter: float = 8.0,
    context_seconds: float = 3600.0,
    context_least: int = 200,
    rates: bool = False,
    block_seconds: float = 600.0,
    chunk: int = CHUNK,
) -> DataFrame:
    """Rows ``(id_col, reason)``, distinct; an id may have several reasons.

    ``hold_scatter``: the readings that hold a level span at most so many times
    the scatter (interquartile range of the steps over 1.349 and the square root
    of two); ``level_scatter``: the levels before and after differ by at most so
    many times the scatter.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    rows = _readings(df, id_col, keys, order_col, value_col)
    impossible = rows.where(_bad(low, high)).select("_id", F.lit("impossible").alias("reason"))

    halo = max(hold + max_run, frozen_run) + 1
    placed = with_halo(_numbered(rows, names, low, high, block_seconds), "_at", chunk, halo).withColumn("_ctx", F.floor(F.col("_t") / context_seconds))
    order = Window.partitionBy(*names, "_chunk").orderBy("_at")
    step, took = F.col("_v") - F.lag("_v").over(order), F.col("_t") - F.lag("_t").over(order)
    rate = F.when(took > 0, step / took)

    same = F.coalesce((F.col("_v") == F.lag("_v").over(order)) & (F.col("_seen") == F.lag("_seen").over(order)), F.lit(False))
    feats = placed.withColumn("_break", F.when(~same, F.col("_at")))
    # the readings from this one on; those before it, and those after an excursion, are the same of other rows
    ahead = order.rowsBetween(0, hold - 1)
    feats = feats.withColumn("_span", F.struct(F.count("_v").over(ahead).alias("n"), F.min("_v").over(ahead).alias("l"), F.max("_v").over(ahead).alias("h"), F.avg("_v").over(ahead).alias("a")))
    feats = feats.withColumns(
        {
            "_b": F.lag("_span", hold).over(order),
            # length of the run of equal readings that holds this row, as far as the halo shows it
            "_left": F.coalesce(F.col("_at") - F.max("_break").over(order.rowsBetween(1 - frozen_run, 0)), F.lit(frozen_run - 1)),
            "_right": F.coalesce(F.min("_break").over(order.rowsBetween(1, frozen_run - 1)) - F.col("_at") - 1, F.least(F.lit(frozen_run - 1), F.count("_v").over(order.rowsBetween(1, frozen_run - 1)))),
        }
    )
    one = F.struct(F.col("_id").alias("id"), F.col("_v").alias("v"))
    feats = feats.withColumns({f"_m{i}": F.lead(one, i).over(order) if i else one for i in range(max_run)} | {f"_s{m}": F.lead("_span", m).over(order) for m in range(1, max_run + 1)})
    if rates:
        feats = feats.withColumns({"_step": step, "_rate": rate}).withColumn("_next", F.lead(F.struct("_step", "_rate")).over(order))
    tries = [F.struct(F.array(*[F.col(f"_m{i}") for i in range(m)]).alias("members"), F.col(f"_s{m}").alias("s")) for m in range(1, max_run + 1)]
    feats = feats.withColumn("_tries", F.array(*tries)).where("_core")

    level = lambda t: (F.col("_b.a") + t["s"]["a"]) / 2
    away = lambda t: F.array_min(F.transform(t["members"], lambda x: F.abs(x["v"] - level(t))))
    hopeful = F.filter(F.col("_tries"), lambda t: (t["s"]["n"] == hold) & (away(t) >= min_jump))
    long_run = F.col("_left") + F.col("_right") + 1 >= frozen_run
    swift = F.lit(False)
    if rates:
        swift = F.coalesce((F.least(F.abs("_step"), F.abs("_next._step")) >= min_jump) & (F.signum("_rate") == -F.signum("_next._rate")), F.lit(False))
    # the levels on both sides differ by little against the jump, so the side before tells already what cannot be one
    jump_scatter = (fence + 0.5) * IQR_TO_SIGMA
    least = min_jump * max(0.0, 1 - level_scatter / (2 * jump_scatter)) - 1e-9
    candidates = feats.where((F.col("_b.n") == hold) & (F.abs(F.col("_v") - F.col("_b.a")) >= least) | long_run | swift)
    candidates = candidates.withColumn("_tries", F.when(F.col("_b.n") == hold, hopeful)).withColumns({"_frozen": long_run, "_swift": swift})
    candidates = candidates.where("_frozen OR _swift OR size(_tries) > 0").select(*names, "_ctx", "_id", "_frozen", "_tries", "_b", "_swift", *(["_rate", "_next"] if rates else []))

    measured = {"_step": "step"} | ({"_rate": "rate"} if rates else {})
    # always true, and names what only the other branch needs, so that both have one shuffle of the same columns
    alike = F.coalesce(F.length(F.col("_id").cast("string")) + F.col("_seen") >= 0, F.lit(True))
    steps = placed.withColumns({"_step": step} | ({"_rate": rate} if rates else {})).where(F.col("_core") & F.col("_step").isNotNull() & alike).select(*names, "_ctx", *measured)
    quartiles = context_quartiles(steps, names, "_ctx", measured, context_least)
    right = quartiles.select(*[F.col(n).alias(f"q{n}") for n in [*names, "_ctx"]], *[x for n in measured.values() for x in (n, f"{n}_all")])
    judged = candidates.join(right, _same([*names, "_ctx"], [f"q{n}" for n in [*names, "_ctx"]]), "left")

    wide = lambda q: F.coalesce(F.col(f"{q}.h") - F.col(f"{q}.l"), F.lit(0.0))
    outside = lambda x, q, over: (x <= (F.col(f"{q}.l") - fence * wide(q)) / over + small) | (x >= (F.col(f"{q}.h") + fence * wide(q)) / over - small)
    small, root = F.lit(1e-9), 2**0.5
    s = wide("step") / (IQR_TO_SIGMA * root)
    held = F.filter(
        F.col("_tries"),
        lambda t: F.forall(t["members"], lambda x: F.coalesce(outside(x["v"] - level(t), "step", root), F.lit(True)))
        & (F.col("_b.h") - F.col("_b.l") <= hold_scatter * s + small)
        & (t["s"]["h"] - t["s"]["l"] <= hold_scatter * s + small)
        & (F.abs(F.col("_b.a") - t["s"]["a"]) <= level_scatter * s + small),
    )
    mark = lambda ids, reason: F.transform(ids, lambda x: F.struct(x.alias("id"), F.lit(reason).alias("reason")))
    own = lambda when, reason: mark(F.when(when, F.array("_id")), reason)
    found = [mark(F.flatten(F.transform(held, lambda t: F.transform(t["members"], lambda x: x["id"]))), "excursion"), own(F.col("_frozen") & (wide("step_all") > 0), "frozen")]
    if rates:
        found.append(own(F.col("_swift") & outside(F.col("_rate"), "rate", 1.0) & outside(F.col("_next._rate"), "rate", 1.0), "rate"))
    flat = F.flatten(F.array_compact(F.array(*found)))
    flagged = judged.select(F.explode(flat).alias("_f")).select(F.col("_f.id").alias("_id"), "_f.reason")
    return impossible.unionByName(flagged).distinct().select(F.col("_id").alias(id_col), "reason")


def context_fences(
    df: DataFrame,
    id_col: str,
    keys: list[str],
    order_col: str,
    value_col: str,
    low: float = 0.0,
    high: float = 100.0,
    fence: float = 3.0,
    context_seconds: float = 3600.0,
    k: int = 800,
) -> DataFrame:
    """Fences per source and context: ``keys, context, n, low_fence, high_fence, n_outside, n_impossible``.

    The fences lie ``fence`` interquartile ranges outside the quartiles of the
    context's sketch.  Contexts without a possible reading have null fences.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    rows = _readings(df, id_col, keys, order_col, value_col).withColumn("_ctx", F.floor(F.col("_t") / context_seconds)).withColumn("_bad", _bad(low, high))
    sketches = rows.groupBy(*names, "_ctx").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("_bad").alias("n_impossible"),
        F.kll_sketch_agg_double(F.when(~F.col("_bad"), F.col("_v")), k).alias("_s"),
    )
    full = F.col("n") > F.col("n_impossible")
    q = lambda p: F.when(full, F.kll_sketch_get_quantile_double("_s", F.lit(p)))
    fences = sketches.withColumns({"_q1": q(0.25), "_q3": q(0.75)})
    fences = fences.withColumns({"low_fence": F.col("_q1") - fence * (F.col("_q3") - F.col("_q1")), "high_fence": F.col("_q3") + fence * (F.col("_q3") - F.col("_q1"))})
    r = fences.select(*[F.col(n).alias(f"r{n}") for n in [*names, "_ctx"]], "n", "n_impossible", "low_fence", "high_fence")
    on = F.lit(True)
    for n in [*names, "_ctx"]:
        on = on & F.col(n).eqNullSafe(F.col(f"r{n}"))
    outside = rows.where("NOT _bad").join(r.drop("n", "n_impossible"), on).where("_v < low_fence OR _v > high_fence").groupBy(*names, "_ctx").agg(F.count(F.lit(1)).alias("_out"))
    out = outside.select(*[F.col(n) for n in [*names, "_ctx"]], "_out")
    return r.join(out, on, "left").select(
        *[F.col(f"r{n}").alias(k) for n, k in zip(names, keys)],
        F.col("r_ctx").alias("context"),
        "n",
        "low_fence",
        "high_fence",
        F.coalesce("_out", F.lit(0)).alias("n_outside"),
        "n_impossible",
    )
