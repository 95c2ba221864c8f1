"""Text columns: normal forms, similarities, small parsers, ordered rule tables.

All but ``alias_key`` and ``ratio``, and ``nfkc`` for texts with rare characters,
are plain Spark expressions.
"""

from __future__ import annotations

import difflib
import re
import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Punctuation that does not count in comparisons, status words in order of precedence.
PUNCTUATION = "!！?？。．.,，、:：;；「」『』()（）[]【】…·・'\"-—~～ 　\t\n"
STATUS_WORDS = ("灼傷", "中毒", "劇毒", "麻痺", "睡眠", "冰凍", "混亂")
WIDE, NARROW = "！％，：（）／　０１２３４５６７８９", "!%,:()/ 0123456789"
CJK = "[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{2FA1F}]"
NOT_CJK = CJK.replace("[", "[^", 1)


# Characters whose compatibility form is themselves, or one character by the rule of WIDTH, and that join with no other.
PLAIN = "^[\\x{00}-\\x{7F}\\x{3000}-\\x{3002}\\x{3041}-\\x{3096}\\x{30A1}-\\x{30FC}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{FF01}-\\x{FF5E}]*$"
WIDTH = ("".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000", "".join(map(chr, range(0x21, 0x7F))) + " ")
# Characters without ink that may stand anywhere in a text.
INKLESS = "[\\p{Cf}\\x{034F}\\x{115F}\\x{1160}\\x{17B4}\\x{17B5}\\x{180B}-\\x{180F}\\x{3164}\\x{FE00}-\\x{FE0F}\\x{FFA0}\\x{E0100}-\\x{E01EF}]"
BLANKS = "[\\t\\x0B\\f \\x{85}\\x{A0}\\x{1680}\\x{2028}\\x{2029}\\x{3000}]+"


def nfkc(col: Column) -> Column:
    """Unicode compatibility form; only texts with characters beyond ``PLAIN`` pass Python."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    plain = col.rlike(PLAIN)
    return F.when(plain, F.translate(col, *WIDTH)).otherwise(run(F.when(~plain, col)))


def alias_key(col: Column, keep: str = "") -> Column:
    """Compatibility form, case-folded, letters and digits (and ``keep``) only."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: "".join(c for c in unicodedata.normalize("NFKC", t).casefold() if c.isalnum() or c in keep), na_action="ignore")

    return run(col)


def ratio(a: Column, b: Column) -> Column:
    """Matching-blocks ratio of two strings (not an edit distance)."""
    @F.pandas_udf("double")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(left, right)], dtype="float64")

    return run(a, b)


# Fixed value: the least matching-blocks ratio at which a word stands for a listed name.
LEAST_RATIO = 0.66


def best_name(word: str, names: list[str], places: dict[str, list[int]]) -> tuple[str | None, float]:
    """The listed name most like ``word`` by matching blocks, and the ratio; ``places``: names by character.

    Only names with enough of the word's characters can reach the ratio, so few are compared.
    """
    shared: dict[int, int] = {}
    for c in set(word):
        n = word.count(c)
        for i in places.get(c, ()):
            shared[i] = shared.get(i, 0) + min(n, names[i].count(c))
    best: tuple[float, str] | None = None
    for i, n in shared.items():
        name = names[i]
        if 2 * n / (len(word) + len(name)) >= max(LEAST_RATIO, best[0] if best else 0.0) - 1e-12:
            score = difflib.SequenceMatcher(None, word, name).ratio()
            if score >= LEAST_RATIO and (best is None or (score, name) > best):
                best = (score, name)
    return (best[1], best[0]) if best else (None, 0.0)


def lexicon_match(word: Column, names: list[str]) -> Column:
    """``name, score, method`` for a word without blanks: exact, fuzzy, unmatched or empty; ties to the greater name."""
    exact = set(names)
    places: dict[str, list[int]] = {}
    for i, name in enumerate(names):
        for c in set(name):
            places.setdefault(c, []).append(i)

    @F.pandas_udf("name string, score double, method string")
    def run(words: pd.Series) -> pd.DataFrame:
        out = []
        for w in words:
            w = "".join((w or "").split())
            if not w:
                out.append((None, 0.0, "empty"))
            elif w in exact:
                out.append((w, 1.0, "exact"))
            else:
                name, score = best_name(w, names, places)
                out.append((name, round(score, 6), "fuzzy" if name else "unmatched"))
        return pd.DataFrame(out, columns=["name", "score", "method"])

    return run(word)


def narrow(col: Column) -> Column:
    """Wide punctuation and digits to their ASCII forms."""
    return F.translate(col, WIDE, NARROW)


def clean_lines(col: Column) -> Column:
    """Compatibility form without ink-less characters, blanks and empty lines; lines are kept."""
    text = F.regexp_replace(F.regexp_replace(nfkc(col), INKLESS, ""), BLANKS, "")
    return F.regexp_replace(F.regexp_replace(text, r"[\r\n]+", "\n"), r"^\n+|\n+$", "")


def compact(col: Column) -> Column:
    return F.replace(clean_lines(col), F.lit("\n"), F.lit(""))


def comparable(col: Column) -> Column:
    return F.translate(col, PUNCTUATION, "")


def strip_terminal(col: Column) -> Column:
    return F.regexp_replace(col, "[!。.!]+$", "")


def cjk_count(col: Column) -> Column:
    return F.length(F.regexp_replace(col, NOT_CJK, ""))


def line_count(col: Column) -> Column:
    return F.size(F.filter(F.split(col, "\n"), lambda x: F.trim(x) != ""))


def cjk_tokens(col: Column, least: int = 2, most: int | None = None) -> Column:
    return F.regexp_extract_all(col, F.lit(f"{CJK}{{{least},{most or ''}}}"), 0)


# The mark of the other side's names, and what parts the names of a phrase.
OPPONENT, BETWEEN = "對手的", "[和、]"


def subjects(phrase: Column) -> Column:
    """``names`` of a participant phrase and its ``side``: ``opponent`` where a name has its mark, else null.

    End marks, and what stands before the first CJK character, do not belong to a name.
    """
    bare = F.regexp_replace(F.trim(phrase), "[!！。.?？]+$", "")
    bare = F.regexp_replace(bare, f"^{NOT_CJK}+(?={CJK})", "")
    parts = F.split(bare, BETWEEN)
    names = F.transform(parts, lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, f"^{OPPONENT}", "")), "的+$", ""))
    marked = F.exists(parts, lambda x: x.startswith(OPPONENT))
    return F.struct(F.filter(names, lambda x: x != "").alias("names"), F.when(marked, F.lit("opponent")).alias("side"))


def line_targets(col: Column) -> Column:
    """Names of several lines, each without its end marks and split at 和 and 、."""
    split = lambda x: F.split(F.regexp_replace(F.trim(x), "[!！。.?？]+$", ""), BETWEEN)
    return F.filter(F.flatten(F.transform(F.split(col, "\n"), split)), lambda x: x != "")


def go_targets(lines: Column) -> Column:
    """Names of a 上吧 line in its clean form: line breaks part names there."""
    return line_targets(F.regexp_replace(lines, "^上吧[!！]", ""))


def stats(col: Column) -> Column:
    """Names of a compound stat, parted by 、 or a comma."""
    return F.filter(F.transform(F.split(col, "[、,]"), lambda x: F.trim(x)), lambda x: x != "")


def state_label(col: Column) -> Column:
    """A state's name however it is written: case, and blanks, hyphens and underscores between words, do not count."""
    return F.regexp_replace(F.upper(F.regexp_replace(col, r"^[\s\-_]+|[\s\-_]+$", "")), r"[\s\-_]+", "_")


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def bag_overlap(a: Column, b: Column) -> Column:
    """Dice overlap of two strings' characters, with multiplicity."""
    x, y = F.filter(F.split(a, ""), lambda c: c != ""), F.filter(F.split(b, ""), lambda c: c != "")
    many = lambda arr, c: F.size(F.filter(arr, lambda d: d == c))
    both = F.aggregate(F.array_distinct(x), F.lit(0), lambda s, c: s + F.least(many(x, c), many(y, c)))
    return F.when(F.length(a) + F.length(b) == 0, F.lit(0.0)).otherwise(2 * both / (F.length(a) + F.length(b)))


def similarity(a: Column, b: Column, edit_weight: float = 0.72) -> Column:
    """Edit and bag similarity, weighted; equal texts 1, an empty one 0."""
    both = edit_weight * edit_similarity(a, b) + (1 - edit_weight) * bag_overlap(a, b)
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(both)


def exact_fraction(col: Column) -> Column:
    """``current``, ``most``, ``percent`` of a reading ``a/b`` with 0 <= a <= b and b > 0."""
    text = narrow(col)
    current = F.regexp_extract(text, r"([0-9]{1,6}) */ *([0-9]{1,6})", 1)
    most = F.regexp_extract(text, r"([0-9]{1,6}) */ *([0-9]{1,6})", 2)
    a, b = F.nullif(current, F.lit("")).cast("int"), F.nullif(most, F.lit("")).cast("int")
    return F.when((a <= b) & (b > 0), F.struct(a.alias("current"), b.alias("most"), F.bround(100 * a / b, 6).alias("percent")))


def percentage(col: Column) -> Column:
    value = F.nullif(F.regexp_extract(narrow(col), r"([0-9]{1,3}) *%", 1), F.lit("")).cast("int")
    return F.when(value <= 100, value.cast("double"))


def status_word(col: Column) -> Column:
    return F.coalesce(*[F.when(F.contains(col, F.lit(w)), F.lit(w)) for w in STATUS_WORDS])


def shortest_name(col: Column) -> Column:
    """The shortest CJK word of 2 to 8 characters, without numbers and status words; ties to the first."""
    bare = F.regexp_replace(F.regexp_replace(col, "[0-9/% ]+", " "), "|".join(STATUS_WORDS), " ")
    words = cjk_tokens(bare, 2, 8)
    least = F.array_min(F.transform(words, lambda w: F.length(w)))
    return F.get(F.filter(words, lambda w: F.length(w) == least), 0)


def single_marker(col: Column, digits: str = "1234") -> Column:
    """The one distinct digit of ``digits`` in a text; null for none or several."""
    found = F.array_distinct(F.regexp_extract_all(col, F.lit(f"[{digits}]"), 0))
    return F.when(F.size(found) == 1, F.get(found, 0).try_cast("int"))


def ellipsize(col: Column, limit: int) -> Column:
    return F.when(F.length(col) > limit, F.concat(F.substring(col, 1, limit - 1), F.lit("…"))).otherwise(col)


def display_time(seconds: Column) -> Column:
    """``HH:MM:SS.mmm``, rounded to milliseconds, never below zero."""
    ms = F.greatest(F.lit(0), F.bround(seconds * 1000).cast("long"))
    part = lambda div, mod: F.floor(ms / div) % mod
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000), part(60_000, 60), part(1000, 60), ms % 1000)


@dataclass(frozen=True)
class TextRule:
    """One row of an ordered rule table: the first rule whose whole pattern matches wins.

    ``phrases``: roles (actor, target, targets, aided) to the groups with their
    names; ``lookups``: fields to a group and what its values stand for, the
    empty value for any other.
    """

    name: str
    kind: str
    pattern: str
    confidence: float
    gate: tuple[str, ...] = ()
    constants: dict[str, str] = field(default_factory=dict)
    phrases: dict[str, str] = field(default_factory=dict)
    lookups: dict[str, tuple[str, dict[str, str]]] = field(default_factory=dict)

    @property
    def groups(self) -> list[str]:
        return re.findall(r"\(\?P<(\w+)>", self.pattern)

    @property
    def java(self) -> str:
        return f"^(?:{self.pattern.replace('(?P<', '(?<')})$"


def first_match(text: Column, gate: Column, rules: list[TextRule], unknown: str) -> Column:
    """``rule, kind, confidence, fields``; ``CASE`` stops at the first rule that matches."""
    out = None
    for rule in rules:
        hit = text.rlike(rule.java)
        if rule.gate:
            hit = hit & gate.isin(*rule.gate)
        pairs = [(g, F.regexp_extract(text, rule.java, i)) for i, g in enumerate(rule.groups, 1)] + [(k, F.lit(v)) for k, v in rule.constants.items()]
        fields = F.create_map(*[x for k, v in pairs for x in (F.lit(k), F.nullif(v, F.lit("")))]) if pairs else F.create_map().cast("map<string,string>")
        made = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.kind).alias("kind"), F.lit(rule.confidence).alias("confidence"), fields.cast("map<string,string>").alias("fields"))
        out = F.when(hit, made) if out is None else out.when(hit, made)
    none = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(unknown).alias("kind"), F.lit(0.0).alias("confidence"), F.create_map().cast("map<string,string>").alias("fields"))
    return none if out is None else out.otherwise(none)


def stated(lines: DataFrame, text: str, gate: Column, rules: list[TextRule], unknown: str, singles: tuple[str, ...]) -> DataFrame:
    """``lines`` with ``rule, kind, rule_confidence, fields, targets``: what each text states by the first rule that matches.

    ``text`` is a column of clean lines.  ``fields`` holds a value for each of
    ``singles``, or null; a phrase of one name is the field ``actor`` or
    ``target``, one of several names is in ``targets``; the mark of the other
    side becomes the field ``side``.  Texts that no rule knows are left out.
    """
    got = first_match(F.replace(F.col(text), F.lit("\n"), F.lit("")), gate, rules, unknown)
    # generated rows keep the rules from being copied into filters
    rows = lines.withColumn("_g", F.explode(F.array(got))).where(F.col("_g.kind") != unknown)
    raw, rule = F.col("_g.fields"), F.col("_g.rule")

    def by_rule(pairs: list[tuple[str, Column]]) -> Column:
        out = F.lit(None).cast("string")
        for name, value in pairs:
            out = F.when(rule == name, value).otherwise(out)
        return out

    phrase = lambda role: subjects(by_rule([(r.name, raw[r.phrases[role]]) for r in rules if role in r.phrases]))
    rows = rows.withColumns({f"_{role}": phrase(role) for role in ("actor", "target", "targets", "aided")})
    go = F.when(rule.isin(*[r.name for r in rules if r.phrases.get("lines")]), go_targets(F.col(text)))
    rows = rows.withColumn("_go", go)
    one = lambda c: F.when(F.size(c) == 1, F.get(c, 0))
    several = lambda c: F.when(F.size(c) > 1, c)
    looked: dict[str, list[tuple[str, Column]]] = {}
    for r in rules:
        for name, (group, values) in r.lookups.items():
            value = F.lit(values.get(""))
            for k, v in values.items():
                if k:
                    value = F.when(raw[group] == k, v).otherwise(value)
            looked.setdefault(name, []).append((r.name, value))
    derived = {
        "actor": F.coalesce(one(F.col("_actor.names")), one(F.col("_go"))),
        "target": F.coalesce(one(F.col("_target.names")), F.get(F.col("_aided.names"), 0)),
        "side": F.coalesce("_actor.side", "_target.side", "_targets.side", "_aided.side", by_rule(looked.pop("side", []))),
    }
    for name in singles:
        if name not in derived:
            derived[name] = F.coalesce(by_rule(looked.get(name, [])), raw[name])
    none = F.array().cast("array<string>")
    targets = F.coalesce(several(F.col("_actor.names")), several(F.col("_target.names")), F.col("_targets.names"), F.col("_go"), none)
    fields = F.create_map(*[x for n in singles for x in (F.lit(n), F.nullif(F.trim(derived[n]), F.lit("")))])
    made = F.struct(rule.alias("rule"), F.col("_g.kind").alias("kind"), F.col("_g.confidence").alias("rule_confidence"), fields.alias("fields"), targets.alias("targets"))
    return rows.select(*lines.columns, F.explode(F.array(made)).alias("_said")).select(*lines.columns, "_said.*")
