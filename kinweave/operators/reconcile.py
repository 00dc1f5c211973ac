"""Links of one observation to one entity, reconciled and reduced to one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.names import derived_id

#: The factor of a conflict, and the version that audit rows carry.
PENALTY, VERSION = 0.5, "resolver-v1.0"


def reconcile(links: DataFrame, facets: DataFrame | None = None, penalty: float = PENALTY) -> DataFrame:
    """Lowers and flags conflicting links (observation_id, entity_id, seed_index, posterior, role, flags).

    An entity that is both subject and context, and one with contradicting ``facets`` (observation_id,
    entity_id, seed_index, facet, value), has all its links lowered; of several links to it all
    but the best are lowered once more.  Adds conflicts: how many kinds its entity had.
    """
    pair = Window.partitionBy("observation_id", "entity_id")
    has = lambda role: F.max((F.col("role") == role).cast("int")).over(pair) == 1
    several = F.count(F.lit(1)).over(pair) > 1
    rows = links
    if facets is not None:
        # Only values that differ from the entity's first one contradict it.
        first = Window.partitionBy("observation_id", "entity_id", "facet").orderBy("seed_index")
        clash = facets.withColumn("_first", F.first("value").over(first)).where("value <> _first").select("observation_id", "entity_id").distinct().withColumn("clash", F.lit(True))
        rows = rows.join(clash, ["observation_id", "entity_id"], "left").withColumn("clash", F.coalesce("clash", F.lit(False)))
    else:
        rows = rows.withColumn("clash", F.lit(False))
    rows = rows.withColumn("_roles", several & has("subject") & has("context")).withColumn("_clash", several & F.col("clash")).withColumn("_several", several)
    lowered = F.col("posterior") * F.when(F.col("_roles"), penalty).otherwise(1.0) * F.when(F.col("_clash"), penalty).otherwise(1.0)
    rows = rows.withColumn("posterior", lowered)
    rank = F.row_number().over(pair.orderBy(F.col("posterior").desc(), "seed_index"))
    rows = rows.withColumn("_other", F.col("_several") & (rank > 1))
    new = F.array_compact(F.array(F.when(F.col("_roles"), "multi_seed_role_conflict"), F.when(F.col("_clash"), "multi_seed_facet_conflict"), F.when(F.col("_other"), "duplicate_entity_link")))
    kinds = F.col("_roles").cast("int") + F.col("_clash").cast("int") + F.col("_several").cast("int")
    return rows.select(*(c for c in links.columns if c not in ("posterior", "flags")), F.when(F.col("_other"), F.col("posterior") * penalty).otherwise(F.col("posterior")).alias("posterior"), F.array_distinct(F.concat("flags", new)).alias("flags"), kinds.alias("conflicts"))


def deduplicated(links: DataFrame) -> DataFrame:
    """The best link of each observation and entity; the first seed's on ties. An aggregation, so combined before the shuffle."""
    rest = [c for c in links.columns if c not in ("observation_id", "entity_id")]
    best = F.min_by(F.struct(*rest), F.struct(-F.col("posterior"), F.col("seed_index")))
    return links.groupBy("observation_id", "entity_id").agg(best.alias("b")).select("observation_id", "entity_id", "b.*")


def canonicalised(links: DataFrame, canonical: DataFrame) -> DataFrame:
    """Moves links to the entity that theirs was merged into (id, root), and makes those that now meet one."""
    moved = links.join(canonical.select(F.col("id").alias("entity_id"), "root"), "entity_id", "left").withColumn("entity_id", F.coalesce("root", "entity_id")).drop("root")
    return deduplicated(moved)


def above(links: DataFrame, least: float) -> DataFrame:
    return links.where(F.col("posterior") >= least)


def audit(links: DataFrame, link_threshold: float = 0.85) -> DataFrame:
    """One audit row of each link decision."""
    return links.select(derived_id("evolution", "observation_id", "entity_id").alias("evolution_id"), F.lit("link").alias("kind"), "entity_id", "observation_id", F.col("posterior").alias("score"), F.lit(link_threshold).alias("threshold"), F.lit(VERSION).alias("version"))
