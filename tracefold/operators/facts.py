"""Facts: who took part, which entity that is, what follows from what, and rules over linked facts.

Matching by one key or another is the union of two equi-joins; rules are a small
table that meets facts by kind.  Nulls: a name, entity or species that is not
known matches nothing; repeated participants of a fact count once, the first by
role and place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions.scores import has_pairs
from tracefold.operators.machines import fold
from tracefold.operators.voting import text_similarity

# Kinds whose subject acts; roles of a line in order; relations that state a cause.
ACTING = ("MOVE", "ABILITY", "ITEM", "SWITCH", "TRANSFORMATION")
CAUSAL = ("DAMAGE_FROM", "RESULT_OF", "STATUS_FROM", "STAT_CHANGE_FROM", "TRIGGERED_BY")


def name_key(name: Column) -> Column:
    """A name without case, blanks and symbols."""
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]", ""))


def participants(events: DataFrame, keys: list[str], kind: str, fields: str, targets: str) -> DataFrame:
    """``keys, kind, role, name, being, side``: everyone a line names, once for each role; the stated side belongs to the subject."""
    f, acts = F.col(fields), F.col(kind).isin(*ACTING)
    role = lambda r, name, being: F.struct(F.lit(r).alias("role"), name.alias("name"), F.lit(being).alias("being"))
    acting = F.when(acts, F.lit("actor")).otherwise(F.lit("target"))
    more = F.transform(F.filter(F.coalesce(targets, F.array().cast("array<string>")), lambda n: ~F.coalesce((n == f["actor"]) | (n == f["target"]), F.lit(False))), lambda n: F.struct(acting.alias("role"), n.alias("name"), F.lit("creature").alias("being")))
    every = F.concat(F.array(role("actor", f["actor"], "creature"), role("target", f["target"], "creature")), more, F.array(role("trainer", f["trainer"], "trainer"), role("loser", f["loser"], "trainer")))
    rows = events.withColumns({"_kind": F.col(kind), "_side": f["side"], "_every": F.filter(every, lambda x: x["name"].isNotNull())})
    rows = rows.select(*keys, "_kind", "_side", F.posexplode("_every").alias("_at", "x")).withColumnRenamed("_kind", "kind")
    first = rows.groupBy(*keys, "kind", F.col("x.role").alias("role"), F.col("x.being").alias("being"), name_key(F.col("x.name")).alias("_key")).agg(F.min_by(F.struct("x.name", "_side"), "_at").alias("_v"))
    own = ((F.col("role") == "actor") & F.col("kind").isin(*ACTING)) | ((F.col("role") == "target") & ~F.col("kind").isin(*ACTING))
    return first.select(*keys, "kind", "role", F.col("_v.name").alias("name"), "being", F.when(own, F.coalesce("_v._side", F.lit("unknown"))).otherwise("unknown").alias("side"))


def same_identity(entities: tuple[Column, Column], species: tuple[Column, Column], names: tuple[Column, Column]) -> Column:
    """By entity where both have one, else by species, else by name."""
    by = lambda a, b: a.isNotNull() & b.isNotNull()
    a, b = (name_key(n) for n in names)
    return F.when(by(*entities), entities[0] == entities[1]).when(by(*species), species[0] == species[1]).otherwise(F.coalesce((a == b) & (a != ""), F.lit(False)))


def entity_matches(asks: DataFrame, entities: DataFrame, keys: list[str], ask: str) -> DataFrame:
    """``keys, ask, entity_id``: entities of the same key whose side fits and whose species or name is the ask's.

    ``asks``: ``name_key, species_id, side``; ``entities``: ``entity_id, name_key, species_id, side``.
    """
    e = entities.select(*keys, "entity_id", F.col("name_key").alias("_n"), F.col("species_id").alias("_s"), F.col("side").alias("_side"))
    fits = (F.col("side") == "unknown") | (F.col("_side") == "unknown") | (F.col("side") == F.col("_side"))
    named = asks.join(e.drop("_s").withColumnRenamed("_n", "name_key"), [*keys, "name_key"]).where(fits)
    like = asks.join(e.drop("_n").withColumnRenamed("_s", "species_id"), [*keys, "species_id"]).where(fits)
    pick = [*keys, ask, "entity_id"]
    return named.select(*pick).unionByName(like.select(*pick)).distinct()


def resolved(asks: DataFrame, matches: DataFrame, keys: list[str], ask: str) -> DataFrame:
    """``asks`` with ``status, entity_id, n_candidates``: one entity, several, a species only, or a name only."""
    by = matches.groupBy(*keys, ask).agg(F.count(F.lit(1)).alias("n_candidates"), F.min("entity_id").alias("_one"))
    rows = asks.join(by, [*keys, ask], "left").fillna(0, ["n_candidates"])
    n = F.col("n_candidates")
    status = F.when(F.col("being") != "creature", "observed_only").when(n == 1, "entity").when(n > 1, "ambiguous").when(F.col("species_id").isNotNull(), "species").otherwise("name_only")
    return rows.withColumn("status", status).withColumn("entity_id", F.when(F.col("status") == "entity", F.col("_one"))).drop("_one")


def relations(edges: DataFrame, reviews: DataFrame, source: str, target: str, relation: str) -> DataFrame:
    """``edges`` with ``review``, ``active`` (not rejected) and ``causal``; a pair without review counts as accepted by itself."""
    said = reviews.groupBy(source, target).agg(F.max_by("decision", "decided_at").alias("review"))
    rows = edges.join(said, [source, target], "left").withColumn("review", F.coalesce("review", F.lit("auto_accepted")))
    rows = rows.withColumn("active", F.col("review") != "rejected")
    return rows.withColumn("causal", F.col("active") & F.col(relation).isin(*CAUSAL))


def linked_rules(facts: DataFrame, links: DataFrame, rules: DataFrame, fact: str, kind: str, fields: str) -> DataFrame:
    """``rule, source, target``: active links whose two facts have the kinds and hold the pairs that a rule asks for.

    ``rules``: ``rule, source_kind, target_kind, relations, source_pairs, target_pairs, same`` (whether the source's actor,
    or target, must be the target's target, or actor); a table of the code, broadcast.
    """
    side = lambda p: facts.select(F.col(fact).alias(p), F.col(kind).alias(f"_{p}_kind"), F.col(fields).alias(f"_{p}"))
    rows = links.where("active").select("source", "target", "relation").join(side("source"), "source").join(side("target"), "target")
    rows = rows.join(F.broadcast(rules), (F.col("_source_kind") == F.col("source_kind")) & (F.col("_target_kind") == F.col("target_kind")))
    who, whom = F.coalesce(F.col("_source")["actor"], F.col("_source")["target"]), F.coalesce(F.col("_target")["target"], F.col("_target")["actor"])
    alike = ~F.col("same") | F.coalesce(name_key(who) == name_key(whom), F.lit(False))
    holds = has_pairs(F.col("_source"), F.col("source_pairs")) & has_pairs(F.col("_target"), F.col("target_pairs")) & F.array_contains("relations", F.col("relation"))
    return rows.where(holds & alike).select("rule", "source", "target", "relation")


def stream_clusters(votes: DataFrame, keys: list[str], order: str, text: str, weight: str, moment: str, least: float = 0.82) -> DataFrame:
    """Each vote with its ``cluster``: the first whose heaviest text so far is similar enough, in ``order``; only those
    texts are held.  A null weight is 0, votes without text are left out."""
    rows = votes.where(F.length(text) > 0).select(*keys, F.col(order).cast("string").alias("_o"), F.col(text).alias("_t"), F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("_w"), F.col(moment).cast("long").alias("_m"))

    def step(heads: list, row: tuple) -> list[tuple]:
        o, t, w, m = row
        for k, (head, best) in enumerate(heads):
            if text_similarity(t, head) >= least:
                if w > best:
                    heads[k] = (t, w)
                return [(o, t, w, m, k)]
        heads.append((t, w))
        return [(o, t, w, m, len(heads) - 1)]

    return fold(rows, keys, ["_o"], ["_o", "_t", "_w", "_m"], list, step, "vote string, text string, weight double, moment long, cluster int")


def cluster_consensus(votes: DataFrame, keys: list[str], order: str, text: str, weight: str, moment: str, least: float = 0.82) -> DataFrame:
    """Consensus of clusters of similar texts: ``keys, best_text, best_confidence, consensus, disagreement, n_votes, n_texts, n_clusters``.

    A cluster's score is ``.58`` of the share of moments that support it and ``.42`` of the mean of their best weights;
    ties go to the greater text.  Its text is the heaviest, the first of equals.
    """
    rows = stream_clusters(votes, keys, order, text, weight, moment, least)
    cell = rows.groupBy(*keys, "cluster", "moment").agg(F.max("weight").alias("_w"), F.count(F.lit(1)).alias("_n"), F.min(F.struct((-F.col("weight")).alias("w"), F.col("vote"), F.col("text"))).alias("_first"))
    by = cell.groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("_moments"), F.avg("_w").alias("_conf"), F.sum("_n").alias("_votes"), F.min("_first").alias("_first"))
    total = rows.groupBy(*keys).agg(F.countDistinct("moment").alias("_all"), F.count(F.lit(1)).alias("n_votes"), F.countDistinct("text").alias("n_texts"))
    scored = by.join(total, keys).withColumn("_support", F.col("_moments") / F.col("_all"))
    score = F.bround(0.58 * F.col("_support") + 0.42 * F.col("_conf"), 9)
    best = scored.groupBy(*keys).agg(F.max_by(F.struct("*"), F.struct(score.alias("s"), F.col("_first.text").alias("t"))).alias("_b"), F.count(F.lit(1)).alias("n_clusters"))
    b = lambda c: F.col(f"_b.{c}")
    dominant = b("_votes") / b("n_votes")
    return best.select(*keys, b("_first.text").alias("best_text"), F.bround(-b("_first.w"), 6).alias("best_confidence"), F.bround(0.45 * b("_conf") + 0.35 * b("_support") + 0.2 * dominant, 6).alias("consensus"), F.bround(1 - dominant, 6).alias("disagreement"), b("n_votes").alias("n_votes"), b("n_texts").alias("n_texts"), "n_clusters")
