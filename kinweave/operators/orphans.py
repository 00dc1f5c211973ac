"""References to records that do not exist, are deleted, or arrive too late.

Parents and children are brought into one long form, grouped by the referenced key, and the
groups without a living parent are kept.  The children are first reduced to one row for each
key, so a key that a third of all rows refer to reaches its group as one row from each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.sources.tables import current_rows

#: Days that a parent may arrive after the row that refers to it.
GRACE_DAYS = 30


def plain_id(column: Column | str) -> Column:
    """An id without dashes, outer white space and letter case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.col(column) if isinstance(column, str) else column, r"^\s+|\s+$", ""), "-", ""))


def slot_references(entities: DataFrame) -> DataFrame:
    """ref_id, slot_name, target_id, created_at, arrived of each reference held in current ``slots``.

    NULL slots, NULL elements and blank ids hold no reference; symbolic references have no id.
    """
    rows = current_rows(entities, "entity_id", "slots", "created_at", "ingested_at")
    slots = rows.select("entity_id", "created_at", "ingested_at", F.explode("slots").alias("slot_name", "s")).where("s.kind in ('reference', 'reference_list')")
    ids = F.when(F.col("s.kind") == "reference", F.array("s.ref_entity_id")).otherwise(F.col("s.items"))
    return slots.select(F.col("entity_id").alias("ref_id"), "slot_name", "created_at", F.col("ingested_at").alias("arrived"), F.explode(ids).alias("target_id")).select("ref_id", "slot_name", plain_id("target_id").alias("target_id"), "created_at", "arrived").where("target_id <> ''")


def id_references(ids: DataFrame) -> DataFrame:
    """The same of ``entity_id`` in current identifier rows; the slot name is ''."""
    rows = current_rows(ids, "id", "entity_id", "created_at", "ingested_at")
    return rows.select(F.col("id").alias("ref_id"), F.lit("").alias("slot_name"), plain_id("entity_id").alias("target_id"), "created_at", F.col("ingested_at").alias("arrived")).where("target_id <> ''")


def orphan_keys(parents: DataFrame, children: DataFrame, grace_days: int = GRACE_DAYS) -> DataFrame:
    """target_id and ``bad_before`` of the keys without a parent for at least one child.

    ``parents``: key, seq, deleted_at, arrived, one row for each version.  ``children``: target_id,
    arrived.  A child of a listed key is an orphan if bad_before is NULL (no parent, or a deleted
    one) or if it arrived earlier than bad_before (the parent came too late).  The verdict takes
    one grouping of parents and children together; only the keys that fail come out.
    """
    first, last = F.min(F.struct("seq", "arrived")), F.max(F.struct("seq", "deleted_at"))
    p = parents.where("key is not null").groupBy("key").agg(first.alias("first"), last.alias("last")).select(F.col("key").alias("target_id"), F.lit(1).alias("is_parent"), F.col("last.deleted_at").isNotNull().cast("int").alias("deleted"), F.col("first.arrived").alias("parent_arrived"), F.lit(None).cast("timestamp").alias("child_arrived"))
    c = children.select("target_id", F.lit(0).alias("is_parent"), F.lit(0).alias("deleted"), F.lit(None).cast("timestamp").alias("parent_arrived"), F.col("arrived").cast("timestamp").alias("child_arrived"))
    grace = F.expr(f"interval {int(grace_days)} days")
    groups = p.withColumn("is_child", F.lit(0)).unionByName(c.withColumn("is_child", F.lit(1))).groupBy("target_id").agg(F.max("is_child").alias("is_child"), F.max("is_parent").alias("is_parent"), F.max("deleted").alias("deleted"), F.max("parent_arrived").alias("parent_arrived"), F.min("child_arrived").alias("child_arrived"))
    gone = (F.col("is_parent") == 0) | (F.col("deleted") == 1)
    late = F.coalesce(F.col("parent_arrived") - grace > F.col("child_arrived"), F.lit(False))
    return groups.where((F.col("is_child") == 1) & (gone | late)).select("target_id", F.when(~gone, F.col("parent_arrived") - grace).alias("bad_before"), F.when(F.col("is_parent") == 0, "missing").when(F.col("deleted") == 1, "deleted").otherwise("late").alias("reason"))


def entity_parents(entities: DataFrame) -> DataFrame:
    return entities.select(plain_id("entity_id").alias("key"), F.col("ingest_seq").alias("seq"), "deleted_at", F.col("ingested_at").alias("arrived"))


def orphans(entities: DataFrame, ids: DataFrame, grace_days: int = GRACE_DAYS) -> DataFrame:
    """tbl, ref_id, slot_name, target_id, ref_month, reason of each reference without a parent; equal rows once.

    An unknown arrival (NULL) is never late.  Clashing extra columns don't matter: only the named
    ones are read.  Empty tables give no rows; without entities every reference is an orphan.
    """
    children = slot_references(entities).withColumn("tbl", F.lit("entities")).unionByName(id_references(ids).withColumn("tbl", F.lit("entity_deterministic_ids")))
    keys = orphan_keys(entity_parents(entities), children, grace_days)
    bad = children.join(keys, "target_id").where(F.col("bad_before").isNull() | (F.col("arrived") < F.col("bad_before")))
    month = F.coalesce(F.date_format("created_at", "yyyy-MM"), F.lit(""))
    return bad.select("tbl", "ref_id", "slot_name", "target_id", month.alias("ref_month"), "reason").distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """The number of orphans of each table, month and reason."""
    return found.groupBy("tbl", "ref_month", "reason").agg(F.count(F.lit(1)).alias("orphans"), F.approx_count_distinct("target_id").alias("about_targets"))
