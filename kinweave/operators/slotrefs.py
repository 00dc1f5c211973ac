"""Symbolic references in slots, resolved to entities or to ones to be made."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.names import derived_id, parse_ref_name

#: Natures; namespaces that name one; the confidence of an entity made for a reference.
NATURES, CLASS_SPACES, MADE_CONFIDENCE = ("individual", "class", "group", "event"), ("species", "category"), 0.7


def nature_of(explicit: Column, namespace: Column) -> Column:
    """The given nature, else the namespace if it names one, else class for species and categories."""
    known = lambda c: F.when(F.lower(c).isin(*NATURES), F.lower(c))
    return F.coalesce(known(explicit), known(namespace), F.when(namespace.isin(*CLASS_SPACES), "class"))


def symbolic(entities: DataFrame) -> DataFrame:
    """entity_id, slot_name, namespace, ref_value, nature, raw of the references by name held in ``slots``; those with an id already aren't symbolic."""
    each = entities.select("entity_id", F.explode("slots").alias("slot_name", "s")).where("s.kind = 'reference' and s.ref_name is not null and coalesce(trim(s.ref_entity_id), '') = ''")
    parsed = each.select("entity_id", "slot_name", F.col("s.ref_nature").alias("given"), parse_ref_name("s.ref_name").alias("r"), F.col("s.ref_name").alias("raw"))
    return parsed.select("entity_id", "slot_name", F.col("r.namespace").alias("namespace"), F.col("r.name").alias("ref_value"), nature_of(F.col("given"), F.col("r.namespace")).alias("nature"), "raw")


def resolve(refs: DataFrame, bindings: DataFrame, natures: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """Adds target_id and outcome: resolved, created, invalid_name, missing_nature or nature_conflict.

    A reference is an identifier of type ref.  ``bindings``: id_type, id_value, id_namespace, entity_id;
    ``canonical`` (id, root) moves targets along merge chains.  The entity made for a name that
    isn't bound follows from the name, so equal references meet in it, whatever the order.
    """
    bound = bindings.where("id_type = 'ref'").groupBy(F.col("id_value").alias("ref_value"), F.col("id_namespace").alias("namespace")).agg(F.min("entity_id").alias("bound"))
    rows = refs.join(bound, ["ref_value", "namespace"], "left")
    if canonical is not None:
        rows = rows.join(canonical.select(F.col("id").alias("bound"), "root"), "bound", "left").withColumn("bound", F.coalesce("root", "bound")).drop("root")
    rows = rows.join(natures.select(F.col("entity_id").alias("bound"), F.col("entity_nature").alias("bound_nature")), "bound", "left")
    cases = [
        (F.col("ref_value").isNull() | (F.col("ref_value") == ""), "invalid_name"),
        (F.col("bound").isNotNull() & F.col("nature").isNotNull() & F.col("bound_nature").isNotNull() & (F.col("bound_nature") != F.col("nature")), "nature_conflict"),
        (F.col("bound").isNotNull(), "resolved"),
        (F.col("nature").isNull(), "missing_nature"),
    ]
    outcome = reduce(lambda rest, c: F.when(c[0], F.lit(c[1])).otherwise(rest), reversed(cases), F.lit("created"))
    target = F.when(outcome == "resolved", F.col("bound")).when(outcome == "created", derived_id("entity", F.lit("ref"), "ref_value", "namespace"))
    return rows.select("entity_id", "slot_name", "namespace", "ref_value", "nature", "raw", target.alias("target_id"), outcome.alias("outcome"))


def created(resolved: DataFrame) -> DataFrame:
    """The entities to be made, each once."""
    return resolved.where("outcome = 'created'").groupBy("target_id").agg(F.min("nature").alias("entity_nature"), F.min("ref_value").alias("name"), F.count(F.lit(1)).alias("references_to")).withColumn("confidence", F.lit(MADE_CONFIDENCE))
