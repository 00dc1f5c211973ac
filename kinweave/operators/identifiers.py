"""Deterministic identifiers: union, namespaces, lookup, creation on a miss, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.names import derived_id, resolve_namespace

KEY = ("id_type", "id_value", "id_namespace")


def normalized(ids: DataFrame, context: Column | str) -> DataFrame:
    """Adds the resolved namespace as id_namespace, the proposed one as original_namespace, and the reason of an override."""
    r = resolve_namespace("id_type", "id_namespace", context)
    rows = ids.withColumn("_r", r).withColumn("original_namespace", F.col("id_namespace"))
    strength = F.when(F.col("strength").isin("strong", "weak"), F.col("strength")).otherwise("strong") if "strength" in ids.columns else F.lit("strong")
    return rows.withColumn("id_namespace", F.col("_r.namespace")).withColumn("reason", F.col("_r.reason")).withColumn("strength", strength).drop("_r")


def overrides(normal: DataFrame) -> DataFrame:
    """The evidence of namespaces that were replaced, one row for each proposed identifier, before any are merged."""
    return normal.where("reason is not null")


def union_ids(extracted: DataFrame, proposed: DataFrame, owner: str, context: Column | str) -> DataFrame:
    """owner, key, strength, origin of the identifiers of both sources, each once; extracted ones come first."""
    both = normalized(extracted, context).withColumn("origin", F.lit(0)).unionByName(normalized(proposed, context).withColumn("origin", F.lit(1)), allowMissingColumns=True)
    best = both.groupBy(owner, *KEY).agg(F.min(F.struct("origin", "strength")).alias("b"))
    return best.select(owner, *KEY, "b.strength", F.when(F.col("b.origin") == 0, "extracted").otherwise("proposed").alias("origin"))


def lookup(ids: DataFrame, bindings: DataFrame) -> DataFrame:
    """Adds entity_id of the binding with the same key, NULL if there is none. Merge chains are followed later."""
    known = bindings.groupBy(*KEY).agg(F.min("entity_id").alias("entity_id"))
    return ids.join(known, list(KEY), "left")


def resolve_ids(ids: DataFrame, bindings: DataFrame, owner: str = "observation_id") -> tuple[DataFrame, DataFrame]:
    """Links of owners to entities by identifier, and the bindings to create.

    Every identifier gives a HARD link with posterior 1; one that isn't bound yet makes an entity,
    the same for all rows with that key in any order, as its id follows from the key.
    """
    found = lookup(ids, bindings)
    made = derived_id("entity", *KEY)
    links = found.select(owner, F.coalesce("entity_id", made).alias("entity_id"), F.lit(1.0).alias("posterior"), F.lit("hard").alias("status"), F.lit("subject").alias("role"), F.when(F.col("entity_id").isNull(), F.array(F.lit("from_observation_det_id"), F.lit("entity_created"))).otherwise(F.array(F.lit("from_observation_det_id"))).alias("flags"), *KEY)
    weak = F.max((F.col("strength") == "strong").cast("int")) if "strength" in ids.columns else F.max(F.lit(1))
    new = found.where("entity_id is null").groupBy(*KEY).agg(weak.alias("_s")).select(*KEY, made.alias("entity_id"), F.concat_ws(":", "id_type", "id_value").alias("name"), F.lit("proto").alias("status"), F.when(F.col("_s") == 1, 1.0).otherwise(0.8).alias("confidence"))
    return links, new


def conflicts(bindings: DataFrame) -> DataFrame:
    """Keys that are bound to more than one entity, with how many and the smallest and greatest of them."""
    grouped = bindings.where("entity_id is not null").groupBy(*KEY).agg(F.min("entity_id").alias("first_entity"), F.max("entity_id").alias("last_entity"), F.count(F.lit(1)).alias("bindings"))
    return grouped.where("first_entity <> last_entity")


def fallback_seeds(observations: DataFrame, seeds: DataFrame, ids: DataFrame) -> DataFrame:
    """One individual seed, of confidence 1, for each identifier of an observation without seeds."""
    without = observations.select("observation_id").join(seeds.select("observation_id"), "observation_id", "left_anti")
    order = Window.partitionBy("observation_id").orderBy(*KEY)
    return ids.join(without, "observation_id", "left_semi").select("observation_id", (F.row_number().over(order) - 1).alias("seed_index"), F.lit("individual").alias("entity_nature"), F.concat_ws(":", "id_type", "id_value").alias("suggested_name"), *KEY, F.lit(1.0).alias("confidence"))


def strip_gps(ids: Column) -> Column:
    """An array of identifiers without those of type gps: a place identifies no entity."""
    return F.filter(ids, lambda x: F.lower(x["id_type"]) != "gps")
