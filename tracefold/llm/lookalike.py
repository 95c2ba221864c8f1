"""One consistent form for text that looks the same.

1. Compatibility folding, character by character: width forms, composed and
   decomposed accents, kinds of blank (one for one), compatibility forms of
   ideographs; characters without ink are deleted.  Forms that look different
   (superscripts, circled or squared letters, fractions) are kept.
2. Every letter then stands for its class of letters drawn alike in other
   scripts; between two separators these classes form a lattice.
3. A Viterbi search picks the path with the best script-consistent character
   n-gram score: the log counts of each letter after that very letter (bigrams)
   and after one of that script, both counted over the whole corpus, plus a bonus
   where scripts agree.

The search sees only the classes, so texts that look the same get the same form,
and a form's classes are those of its text, so texts that look different stay
different.  Line breaks, a blank or none, case, digits and different ideographs
are visible differences and are kept.

Nulls and odd input: null stays null, an empty text and one without ink become
empty; texts of any length are treated whole; lone surrogates are kept.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters drawn alike, one class per word; a class's first letter stands for it.
CLASSES = (
    "AΑА BΒВ CСϹ EΕЕ FϜ GԌ HΗН IΙІӀ JЈͿ KΚК MΜМ NΝ OΟОՕ PΡР QԚ SЅՏ TΤТ UՍ VѴ WԜ XΧХ YΥҮ ZΖ "
    "aа cсϲ dԁ eе gɡ hһ iі jјϳ lӏ nո oοоօ pрρ qԛ sѕ uս vνѵ wԝ xх yуү "
    "ΓГ ΠП ΦФ "
    "エ工 カ力 ロ口 ニ二 ハ八 ト卜 タ夕 ノ丿 ヌ又 ム厶 オ才 ヘへ ー一—―─━ㅡ -‐‑‒–−﹣˗⁃"
).split()
KEPT_FORMS = ("super", "sub", "circle", "square", "fraction", "vertical", "small", "font", "initial", "medial", "final", "isolated")
# Default-ignorable characters that are not of category Cf.
INKLESS = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
BREAKS = {0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0x2028, 0x2029}
SAME_SCRIPT = 3.0
SALT = 16


class _Fold(dict):
    """Code point to its folded, decomposed text; filled as characters come up."""

    def __missing__(self, cp: int) -> str:
        self[cp] = out = self.fold(cp)
        return out

    def fold(self, cp: int) -> str:
        ch = chr(cp)
        if cp in BREAKS:
            return "\n"
        kind = unicodedata.category(ch)
        if kind == "Zs" or cp in (0x09, 0x2800):
            return " "
        if kind in ("Cf", "Cc") or cp in INKLESS:
            return ""
        parts = unicodedata.decomposition(ch).split()
        if not parts:
            return unicodedata.normalize("NFD", ch)
        if parts[0][0] == "<":
            tag, parts = parts[0][1:-1], parts[1:]
            letters = 0x2160 <= cp <= 0x217F or 0xFB00 <= cp <= 0xFB06 or 0x01C4 <= cp <= 0x01CC or 0x0132 <= cp <= 0x0133
            if tag in KEPT_FORMS or tag == "compat" and len(parts) > 1 and not letters:
                return ch
        return "".join(self[int(p, 16)] for p in parts)


_FOLD = _Fold()
_CLASS_OF = {ord(c): word[0] for word in CLASSES for c in word}
_MEMBERS = {word[0]: tuple(word) for word in CLASSES}


def fold(text: str) -> str:
    """Step 1, in decomposed form with marks in canonical order."""
    if text.isascii() and text.isprintable():
        return text
    if "\r" in text:
        text = text.replace("\r\n", "\n")
    return unicodedata.normalize("NFD", text.translate(_FOLD))


def skeleton(text: str) -> str:
    """Step 2: equal for texts that look the same, and only for those."""
    return fold(text).translate(_CLASS_OF)


@lru_cache(1 << 14)
def script_of(ch: str) -> str:
    """Latin, Greek, Cyrillic, Armenian, Han, Kana, Hangul, or empty for what all scripts share."""
    if ch.isascii():
        return "Latin" if ch.isalpha() else ""
    name = unicodedata.name(ch, "")
    for start, script in (("LATIN", "Latin"), ("GREEK", "Greek"), ("CYRILLIC", "Cyrillic"), ("ARMENIAN", "Armenian"), ("CJK", "Han"), ("KATAKANA", "Kana"), ("HIRAGANA", "Kana"), ("HANGUL", "Hangul")):
        if name.startswith(start):
            return script
    return ""


AMBIGUOUS = frozenset(_CLASS_OF.values())
_PART = re.compile(r"[^\W\d_\-]+|-+", re.UNICODE)


def _context(ch: str) -> str:
    """What of a neighbour is counted beside its script: the letter itself, where it is one of a class or ASCII."""
    return ch if ord(ch) in _CLASS_OF or ch.isascii() and ch.isalpha() else ""


def neighbour_counts(texts: Iterable[str]) -> dict[tuple[str, str], int]:
    """Counts of each letter of a class after a letter (bigrams) and after a letter of a script; at a start, by the script after it."""
    counts: dict[tuple[str, str], int] = {}
    for text in texts:
        letters = [c for c in fold(text) if not unicodedata.combining(c)]
        for i, c in enumerate(letters):
            if ord(c) in _CLASS_OF:
                script = script_of(letters[i - 1]) if i else ""
                script = script or (script_of(letters[i + 1]) if i + 1 < len(letters) else "")
                before = _context(letters[i - 1]) if i else ""
                for key in (script, before) if before else (script,):
                    counts[c, key] = counts.get((c, key), 0) + 1
    return counts


class Canonical:
    """Steps 2 and 3 under the neighbour counts of a corpus."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        self.scores = {k: math.log1p(n) for k, n in counts.items()}
        self.best = lru_cache(1 << 16)(self._best)

    def _best(self, part: str) -> str:
        # one path for each script and last letter: (score, path)
        paths: dict[tuple[str, str], tuple[float, str]] = {("", ""): (0.0, "")}
        for c in part:
            step: dict[tuple[str, str], tuple[float, str]] = {}
            for alt in _MEMBERS.get(c, (c,)):
                script, context = script_of(alt), _context(alt)
                for (before, last), (score, path) in paths.items():
                    total = score
                    if c in _MEMBERS:
                        total += self.scores.get((alt, before or script), 0.0)
                        total += self.scores.get((alt, last), 0.0) if last else 0.0
                    if script and before:
                        total += SAME_SCRIPT if script == before else -SAME_SCRIPT
                    at = (script or before, context)
                    old = step.get(at)
                    # ties: the alternative listed first
                    if old is None or total > old[0] + 1e-12:
                        step[at] = (total, path + alt)
            paths = step
        return max(paths.items(), key=lambda p: (p[1][0], p[0]))[1][1]

    def __call__(self, text: str) -> str:
        skel = skeleton(text)
        return unicodedata.normalize("NFC", _PART.sub(lambda m: self.best(m[0]) if not AMBIGUOUS.isdisjoint(m[0]) else m[0], skel))


def corpus_counts(df: DataFrame, text_col: str) -> dict[tuple[str, str], int]:
    """Neighbour counts over all distinct texts of a table.

    What reaches the driver is bounded by the alphabet: at most (letters in
    classes) x (scripts, letters in classes and ASCII letters) rows.
    """
    def count(batches):
        total: dict[tuple[str, str], int] = {}
        for batch in batches:
            for key, n in neighbour_counts(t for t in batch["t"] if t).items():
                total[key] = total.get(key, 0) + n
        yield pd.DataFrame([(c, s, n) for (c, s), n in total.items()], columns=["c", "s", "n"])

    texts = df.select(F.col(text_col).alias("t")).where("t IS NOT NULL").distinct()
    rows = texts.mapInPandas(count, "c string, s string, n long").groupBy("c", "s").agg(F.sum("n").alias("n")).collect()
    return {(r.c, r.s): r.n for r in sorted(rows)}


def canonical(col: Column, counts: dict[tuple[str, str], int]) -> Column:
    """The consistent form of a text column."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        form = Canonical(counts)
        return texts.map(form, na_action="ignore")

    return run(col)


def looks(col: Column) -> Column:
    """The class skeleton of a text column, for comparisons that need no readable form."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(skeleton, na_action="ignore")

    return run(col)


def alike_pairs(left: DataFrame, right: DataFrame, counts: dict[tuple[str, str], int]) -> DataFrame:
    """``key_a, key_b`` of texts that look the same but are not the same characters, the smaller key first.

    ``left`` and ``right`` have columns ``key, text``; pairs are within ``left``
    and between ``left`` and ``right``, never within ``right``, so ``left``
    should be the small side.  Each distinct text is brought to its form once.
    """
    stated = "key IS NOT NULL AND text IS NOT NULL"
    rows = left.select("key", "text", F.lit(True).alias("_l")).unionByName(right.select("key", "text", F.lit(False).alias("_l"))).where(stated).distinct()
    # texts are paired before keys, so that a text with many keys is met only where it has a pair
    texts = rows.groupBy("text").agg(F.bool_or("_l").alias("_l")).withColumn("form", canonical(F.col("text"), counts))
    a = texts.where("_l").select(F.col("text").alias("ta"), "form")
    alike = a.join(texts.select(F.col("text").alias("tb"), "form"), "form").where("ta <> tb").select("ta", "tb")
    keyed = alike.join(rows.where("_l").select(F.col("key").alias("a"), F.col("text").alias("ta")), "ta").select("a", "tb")
    # the keys of a text with many are spread over SALT tasks
    keyed = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    other = rows.select(F.col("key").alias("b"), F.col("text").alias("tb"), F.pmod(F.xxhash64("key"), F.lit(SALT)).cast("int").alias("_salt"))
    pairs = keyed.join(other, ["tb", "_salt"]).where("a <> b")
    return pairs.select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b")).distinct()
