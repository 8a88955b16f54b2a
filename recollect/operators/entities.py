"""Entities: names and aliases, resolution, merging, contradictions and beliefs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.predicates import entity_name
from recollect.operators.graph import components
from recollect.operators.vectors import search


def resolve(names: DataFrame, entities: DataFrame, aliases: DataFrame, vectors: DataFrame, known: DataFrame, match: float = 0.92, near: float = 0.80) -> DataFrame:
    """id, entity_id, candidate, tier of each name (columns id, name): the first tier that finds one.

    exact, then alias (of several the least entity_id), then embedding: the nearest of ``known``
    (id of an entity, embedding) to the name's own of ``vectors``, taken from ``match`` on and
    noted as a candidate from ``near`` on; else new. Only names that no name or alias resolves
    are searched. ``entities`` has entity_id and name, ``aliases`` entity_id and alias.
    """
    exact = entities.groupBy(entity_name(F.col("name")).alias("key")).agg(F.min("entity_id").alias("exact"))
    other = aliases.groupBy(entity_name(F.col("alias")).alias("key")).agg(F.min("entity_id").alias("by_alias"))
    found = names.withColumn("key", entity_name(F.col("name"))).join(exact, "key", "left").join(other, "key", "left")
    open_ = found.filter("exact is null and by_alias is null").select("id")
    nearest = search(known, vectors.join(open_, "id", "left_semi"), 1).select(F.col("query_id").alias("id"), F.col("id").alias("nearest"), "similarity")
    found = found.join(nearest, "id", "left")
    by_vector = F.when(F.col("similarity") >= match, F.col("nearest"))
    candidate = F.when((F.col("similarity") < match) & (F.col("similarity") >= near), F.col("nearest"))
    tier = F.when(F.col("exact").isNotNull(), "exact").when(F.col("by_alias").isNotNull(), "alias").when(by_vector.isNotNull(), "embedding").when(candidate.isNotNull(), "candidate").otherwise("new")
    return found.select("id", F.coalesce("exact", "by_alias", by_vector).alias("entity_id"), candidate.alias("candidate"), tier.alias("tier"))


def representatives(roots: DataFrame, sizes: DataFrame) -> DataFrame:
    """node, representative: of each component the node of most members, then of least id.

    ``roots`` has node and root, ``sizes`` node and members.
    """
    known = roots.join(sizes, "node", "left").withColumn("members", F.coalesce("members", F.lit(0)))
    best = known.groupBy("root").agg(F.min_by("node", F.struct(-F.col("members"), F.col("node"))).alias("representative"))
    return known.join(best, "root").select("node", "representative")


def reassign(members: DataFrame, merged: DataFrame) -> DataFrame:
    """Members after entities are merged: those whose memory and role the target has already go.

    ``merged`` has entity_id and target.
    """
    moved = members.join(merged, "entity_id", "left").withColumn("entity_id", F.coalesce("target", "entity_id"))
    return moved.select("entity_id", "memory_id", "role").distinct()


def with_aliases(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    known = aliases.groupBy("entity_id").agg(F.sort_array(F.collect_set("alias")).alias("aliases"))
    return entities.join(known, "entity_id", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def superseded(contradictions: DataFrame) -> DataFrame:
    """id of the older side of each unresolved contradiction (a, b, newer, resolved)."""
    sides = contradictions.filter("not resolved").select("newer", F.explode(F.array("a", "b")).alias("id"))
    return sides.filter("id <> newer").select("id").distinct()


def belief(confidence: Column, support: Column, known: Column, unresolved: Column) -> tuple[Column, Column, Column]:
    """The confidence within 0 and 1; the support ids that are known, each once, in order; whether any is unresolved."""
    kept = F.array_intersect(support, known)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)), kept, F.coalesce(F.arrays_overlap(kept, unresolved), F.lit(False))


def merges(same: Column, confidence: Column, least: float = 0.85) -> Column:
    """Whether a verdict merges two entities."""
    return same & (confidence >= least)


def merged(rows: DataFrame, key: str) -> DataFrame:
    """key, id, revision, history: of rows that are alike the newest id, how many there are, and all their ids."""
    return rows.groupBy(key).agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("revision"), F.sort_array(F.collect_list("id")).alias("history"))


def nli(label: Column, score: Column, gate: float = 0.5, contradictions: bool = True) -> Column:
    out = F.when(score < gate, "neutral").when(label == "entailment", "supports")
    return (out.when(label == "contradiction", "contradicts") if contradictions else out).otherwise("neutral")


def relation_upsert(evidence: DataFrame) -> DataFrame:
    """source, target, relationship, evidence, confidence: evidence counts once a span and hash, null spans alike."""
    key = ["source", "target", "relationship", "span", "hash"]
    one = evidence.withColumn("span", F.coalesce("span", F.lit(-1))).withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("confidence")))).filter("_n = 1")
    return one.groupBy("source", "target", "relationship").agg(F.count(F.lit(1)).alias("evidence"), F.round(F.avg("confidence"), 6).alias("confidence"))


def reconcile(relations: DataFrame, merged: DataFrame) -> DataFrame:
    """Relations after entities are merged (id, to): source, target, relationship, evidence, confidence, active.

    Both ends are re-pointed. Relations that become equal join their evidence, each counted once;
    one that now points to itself isn't active.
    """
    moved = relations
    for end in ("source", "target"):
        to = merged.select(F.col("id").alias(end), F.col("to").alias(f"{end}_to"))
        moved = moved.join(to, end, "left").withColumn(end, F.coalesce(f"{end}_to", end)).drop(f"{end}_to")
    return relation_upsert(moved).withColumn("active", F.col("source") != F.col("target"))


def lookup(entities: DataFrame, kind: str) -> DataFrame:
    """name, alias, exact_id, any_id: of each name the least id of ``kind``, the least of any kind, persons first, and its least alias.

    ``entities`` has id, name, kind and alias.
    """
    first = F.struct(F.col("kind") != "person", F.col("id"))
    return entities.groupBy("name").agg(F.min("alias").alias("alias"), F.min(F.when(F.col("kind") == kind, F.col("id"))).alias("exact_id"), F.min_by("id", first).alias("any_id"))


def by_alias(names: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """id, entity_id of each name (columns id, name) that is an active entity's alias: persons before others, then the least entity.

    ``entities`` has entity_id and kind, active ones only; ``aliases`` entity_id and alias.
    """
    order = F.struct((F.col("kind") != "person").cast("int"), "entity_id")
    best = aliases.join(entities, "entity_id").groupBy(entity_name(F.col("alias")).alias("key")).agg(F.min_by("entity_id", order).alias("entity_id"))
    return names.select("id", entity_name(F.col("name")).alias("key")).join(best, "key").select("id", "entity_id")


def merged_near(memories: DataFrame, links: DataFrame) -> DataFrame:
    """id, revision, content_hash, importance, history of each memory that stays after near-duplicates merge.

    ``memories`` has id, content_hash and importance, ``links`` src and dst of near-duplicates,
    which merge along chains of links. In the order of ids each replaces the content before it:
    the last one's stays, with the greatest importance. ``history`` says of each step before
    which id and content it replaced. A memory without links stays as it is, at revision 1.
    """
    roots = components(links).select(F.col("node").alias("id"), "root")
    rows = memories.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    steps = F.sort_array(F.collect_list(F.struct("id", "content_hash")))  # what became one memory
    out = rows.groupBy("root").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("revision"), F.max_by("content_hash", "id").alias("content_hash"), F.max("importance").alias("importance"), steps.alias("s"))
    return out.select("id", "revision", "content_hash", "importance", F.slice("s", 1, F.size("s") - 1).alias("history"))
