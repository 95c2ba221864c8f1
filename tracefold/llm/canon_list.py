"""Free-entered values mapped to the closest entry of a reference list.

A prefix-filter set-similarity join.  Values and names become sets of tokens:
numbered characters where there is a CJK one, numbered letter pairs of what is
not CJK; a text of both scripts is compared in both ways.  Tokens are
ordered by global rarity; two sets whose Jaccard similarity is ``threshold`` or
more share a token among the first ``n - ceil(threshold * n) + 1`` of each, so
only those prefixes are joined.  Length and positional filters follow, then the
exact Jaccard value, then an exact check that the value keeps enough of the name
in order, and the best name is kept.

Scale: distinct values only, so one value with a third of all rows is compared
once; values longer than any name allows are answered by the length filter
before they are taken apart.  The reference's tokens are broadcast only up to
``BROADCAST_NAMES`` names (counted), and joined by shuffle beyond.

Nulls and odd input: a null or empty value, and one without letters, is
unmatched; a null block matches nothing; ties go to the larger share kept, then
the fewer edits, then the smaller entry id; an empty list leaves all unmatched.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracefold.llm.lookalike import skeleton
from tracefold.session import cut_lineage

BROADCAST_NAMES = 100_000
_SCREEN = re.compile(r"pp\s*\d+(?:\s*/\s*\d+)?|(?<![a-z])lv\s*\.?\s*\d+|\d+\s*/\s*\d+|^\s*\d+\s*[.):]?\s+|^\s*\d+[.):]")
_CJK = re.compile(r"[⺀-鿿가-힯豈-﫿]")


def plain_name(text: str) -> str:
    """A value without screen marks (counters, levels, list numbers), blanks, symbols and case."""
    text = _SCREEN.sub(" ", skeleton(text).casefold())
    return "".join(c for c in text if c.isalnum())


def _numbered(units: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for u in units:
        seen[u] = seen.get(u, 0) + 1
        out.append(u if seen[u] == 1 else f"{u}{seen[u]}")
    return out


def character_tokens(name: str) -> list[str]:
    """Numbered characters of a text with a CJK character in it; nothing for any other."""
    return _numbered(list(name)) if _CJK.search(name) else []


def pair_tokens(name: str) -> list[str]:
    """Numbered letter pairs of what is not CJK in a text."""
    name = _CJK.sub("", name)
    return _numbered([a + b for a, b in zip("^" + name, name + "$")]) if name else []


def kept_share(value: str, name: str) -> float:
    """Longest common subsequence over the name's length, one bit for each letter of the name."""
    if not name:
        return 0.0
    places: dict[str, int] = {}
    for j, c in enumerate(name):
        places[c] = places.get(c, 0) | 1 << j
    full = rows = (1 << len(name)) - 1
    for c in value:
        hit = rows & places.get(c, 0)
        rows = ((rows + hit) | (rows - hit)) & full
    return (len(name) - rows.bit_count()) / len(name)


def _plain(col: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(plain_name, na_action="ignore")

    return run(col)


def _tokens(col: Column) -> Column:
    """Both kinds of tokens: ``c`` and ``p``."""
    @F.pandas_udf("c array<string>, p array<string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"c": texts.map(character_tokens, na_action="ignore"), "p": texts.map(pair_tokens, na_action="ignore")})

    return run(col)


def _kept(value: Column, name: Column) -> Column:
    @F.pandas_udf("double")
    def run(values: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([kept_share(v, n) for v, n in zip(values, names)], dtype="float64")

    return run(value, name)


def similarity_join(values: DataFrame, names: DataFrame, threshold: float, small: bool, held: float = 0.0) -> DataFrame:
    """``block, value, name, jaccard`` of all pairs of the same block at ``threshold`` or more in which the value holds
    at least the share ``held`` of the name's tokens.

    Both inputs have distinct ``block, text, tokens``.  A name of ``n`` tokens shares at least the greater of
    ``threshold * n`` and ``held * n``, which shortens its prefix.
    """
    hint = F.broadcast if small else (lambda d: d)
    name_sizes = names.groupBy("block").agg(F.min(F.size("tokens")).alias("_lo"), F.max(F.size("tokens")).alias("_hi"))
    values = values.join(hint(name_sizes), "block").where((F.size("tokens") * threshold <= F.col("_hi") + 1e-9) & (F.size("tokens") >= F.col("_lo") * threshold - 1e-9)).drop("_lo", "_hi")
    known = names.select("block", F.explode("tokens").alias("token")).groupBy("block", "token").agg(F.count(F.lit(1)).alias("_f0"))
    # rarity over values and names; a token that no name has counts as rarest of all, as it can't match
    exploded = values.select("block", "text", "tokens", F.explode("tokens").alias("token")).join(hint(known.drop("_f0")).withColumn("_in", F.lit(1)), ["block", "token"], "left")
    in_values = exploded.where("_in = 1").groupBy("block", "token").agg(F.count(F.lit(1)).alias("_f1"))
    rarity = known.join(in_values, ["block", "token"], "left").select("block", "token", (F.col("_f0") + F.coalesce("_f1", F.lit(0))).alias("_f"))

    def prefixes(side: DataFrame, share: float) -> DataFrame:
        flat = side.select("block", "text", "tokens", F.explode("tokens").alias("token")).join(hint(rarity), ["block", "token"], "left")
        order = Window.partitionBy("block", "text").orderBy(F.coalesce("_f", F.lit(0)), "token")
        n = F.size("tokens")
        return flat.withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", n).where(F.col("_i") < n - F.ceil(n * share - 1e-9) + 1)

    v = prefixes(values, threshold).select("block", "token", F.col("text").alias("value"), F.col("tokens").alias("_vt"), F.col("_n").alias("_vn"), F.col("_i").alias("_vi"))
    v = v.join(hint(known.select("block", "token")), ["block", "token"], "left_semi")
    r = prefixes(names, max(threshold, held)).select("block", "token", F.col("text").alias("name"), F.col("tokens").alias("_nt"), F.col("_n").alias("_nn"), F.col("_i").alias("_ni"))
    least = F.greatest((F.col("_vn") + F.col("_nn")) * threshold / (1 + threshold), F.col("_nn") * held) - 1e-9
    pairs = v.join(hint(r), ["block", "token"]).where(
        (F.col("_nn") >= F.col("_vn") * threshold - 1e-9)
        & (F.col("_vn") >= F.col("_nn") * threshold - 1e-9)
        & (1 + F.least(F.col("_vn") - F.col("_vi") - 1, F.col("_nn") - F.col("_ni") - 1) >= least)
    )
    pairs = pairs.select("block", "value", "name", "_vt", "_nt").dropDuplicates(["block", "value", "name"])
    both = F.size(F.array_intersect("_vt", "_nt"))
    exact = both / (F.size("_vt") + F.size("_nt") - both)
    return pairs.withColumn("jaccard", exact).where((F.col("jaccard") >= threshold - 1e-9) & (both >= F.size("_nt") * held - 1e-9)).select("block", "value", "name", "jaccard")


def map_to_list(
    df: DataFrame,
    value_col: str,
    block_col: str,
    reference: DataFrame,
    cjk_threshold: float = 1 / 3,
    latin_threshold: float = 0.2,
    least_kept: float = 0.58,
) -> DataFrame:
    """``block, value, entry_id, name, jaccard, kept`` for every distinct (block, value) of ``df``; no entry: nulls.

    ``reference`` has columns ``block, entry_id, name``; an entry may have several names.
    """
    # values and names pass Python once; what follows reads the written rows
    names = reference.select(F.col("block").cast("string").alias("block"), "entry_id", _plain(F.col("name")).alias("text")).where("block IS NOT NULL AND length(text) > 0")
    names = cut_lineage(names.groupBy("block", "text").agg(F.min("entry_id").alias("entry_id")).withColumn("_t", _tokens(F.col("text"))))
    small = names.count() <= BROADCAST_NAMES
    hint = F.broadcast if small else (lambda d: d)
    # values too long for any name are settled by their length, before tokens are made
    longest = names.agg(F.max(F.length("text"))).collect()[0][0] or 0
    asked = df.select(F.col(block_col).cast("string").alias("block"), F.col(value_col).alias("value")).distinct()
    values = asked.withColumn("plain", _plain(F.col("value")))
    fits = (F.length("plain") > 0) & (F.length("plain") <= (longest + 1) / min(cjk_threshold, latin_threshold) + 1)
    values = cut_lineage(values.withColumn("_t", _tokens(F.when(fits & F.col("block").isNotNull(), F.col("plain")))))
    forms = values.where("_t IS NOT NULL AND block IS NOT NULL").select("block", F.col("plain").alias("text"), "_t").dropDuplicates(["block", "text"])
    near = None
    # a text of both scripts is compared in both ways
    # letters kept in order are letters held; pairs of letters may break and bound nothing
    for kind, threshold, held in (("c", cjk_threshold, least_kept), ("p", latin_threshold, 0.0)):
        side = lambda d: d.select("block", "text", F.col(f"_t.{kind}").alias("tokens")).where("size(tokens) > 0")
        part = similarity_join(side(forms), side(names), threshold, small, held)
        near = part if near is None else near.unionByName(part)
    names = names.drop("_t")
    near = near.groupBy("block", "value", "name").agg(F.max("jaccard").alias("jaccard"))
    kept = near.withColumn("kept", _kept(F.col("value"), F.col("name"))).where(F.col("kept") >= least_kept)
    kept = kept.join(hint(names.withColumnRenamed("text", "name")), ["block", "name"])
    rank = F.struct(-F.col("jaccard"), -F.col("kept"), F.levenshtein("value", "name"), F.col("entry_id"), F.col("name"), F.col("jaccard").alias("j"), F.col("kept").alias("k"))
    best = kept.groupBy("block", "value").agg(F.min(rank).alias("_b")).select(F.col("block").alias("_bb"), F.col("value").alias("_bv"), "_b")
    found = values.join(best, (F.col("block") == F.col("_bb")) & (F.col("plain") == F.col("_bv")), "left")
    return found.select("block", "value", F.col("_b.entry_id").alias("entry_id"), F.col("_b.name").alias("name"), F.col("_b.j").alias("jaccard"), F.col("_b.k").alias("kept"))
