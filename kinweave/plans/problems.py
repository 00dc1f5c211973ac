"""The general problems' queries: references without records (4) and hierarchies (7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators.hierarchy import descendants, type_links, unfold
from kinweave.operators.orphans import orphan_report, orphans
from kinweave.sources.tables import table
from kinweave.storage import Scratch


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    return orphans(table(spark, folder, "entities"), table(spark, folder, "entity_deterministic_ids"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).drop("reason")


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(_orphans(spark, folder)).drop("about_targets")


def _unfolded(spark: SparkSession, folder: str, paths: bool = False) -> DataFrame:
    links = type_links(table(spark, folder, "types"))
    nodes = unfold(links, Scratch(spark, "hierarchy"), paths)
    listed = links.where("tree = 'parent' or parent is not null").select("tree", "id")
    return nodes.join(listed, ["tree", "id"], "left_semi")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _unfolded(spark, folder).select(F.col("tree").alias("link_kind"), F.col("id").alias("type_id"), F.coalesce("root", F.lit("")).alias("root_type_id"), F.col("depth").alias("node_depth"))


def p7_nested_sets(spark: SparkSession, folder: str) -> DataFrame:
    return _unfolded(spark, folder).select(F.col("tree").alias("link_kind"), F.col("id").alias("type_id"), F.coalesce("root", F.lit("")).alias("root_type_id"), F.col("depth").alias("node_depth"), "subtree_size", "preorder")


def p7_paths(spark: SparkSession, folder: str) -> DataFrame:
    return _unfolded(spark, folder, True).select(F.col("tree").alias("link_kind"), F.col("id").alias("type_id"), F.array_join("path", "/").alias("full_path"), F.col("depth").alias("node_depth"), "subtree_size")


def p7_descendants(spark: SparkSession, folder: str) -> DataFrame:
    scratch = Scratch(spark, "hierarchy")
    nodes = scratch.save(unfold(type_links(table(spark, folder, "types")), scratch), "nested")
    return descendants(nodes, nodes).select(F.col("tree").alias("link_kind"), F.col("id").alias("type_id"), F.col("descendant").alias("descendant_id"), "distance")


QUERIES = {f.__name__: f for f in (p4_found, p4_report, p7_found, p7_nested_sets, p7_paths, p7_descendants)}

_CURRENT = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY ingest_seq DESC) AS rn FROM {t} WHERE {k} IS NOT NULL) WHERE rn = 1)"
_PLAIN = "lower(replace(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '-', ''))"

_ORPHANS = f"""
WITH e AS {_CURRENT.format(k="entity_id", t="entities")},
d AS {_CURRENT.format(k="id", t="entity_deterministic_ids")},
s AS (SELECT entity_id, created_at, ingested_at, unnest(map_keys(slots)) AS k, unnest(map_values(slots)) AS v FROM e),
c AS (
  SELECT 'entities' AS tbl, entity_id AS ref_id, k AS slot_name, v.ref_entity_id AS t, created_at, ingested_at FROM s WHERE v.kind = 'reference'
  UNION ALL SELECT 'entities', entity_id, k, unnest(v['items']), created_at, ingested_at FROM s WHERE v.kind = 'reference_list'
  UNION ALL SELECT 'entity_deterministic_ids', id, '', entity_id, created_at, ingested_at FROM d),
r AS (SELECT *, {_PLAIN.format(c="t")} AS target_id FROM c WHERE t IS NOT NULL),
p AS (SELECT {_PLAIN.format(c="entity_id")} AS target_id, arg_min(ingested_at, ingest_seq) AS first_at, max(ingest_seq) AS last_seq FROM entities GROUP BY 1),
q AS (SELECT p.target_id, p.first_at, l.deleted_at FROM p JOIN entities l ON l.ingest_seq = p.last_seq),
o AS (SELECT DISTINCT r.tbl, r.ref_id, r.slot_name, r.target_id, coalesce(strftime(r.created_at, '%Y-%m'), '') AS ref_month,
  CASE WHEN q.target_id IS NULL THEN 'missing' WHEN q.deleted_at IS NOT NULL THEN 'deleted' ELSE 'late' END AS reason
  FROM r LEFT JOIN q USING (target_id)
  WHERE r.target_id <> '' AND (q.target_id IS NULL OR q.deleted_at IS NOT NULL OR q.first_at - INTERVAL 30 DAY > r.ingested_at))
"""

_TREE = f"""
WITH RECURSIVE cur AS {_CURRENT.format(k="type_id", t="types")},
raw AS (SELECT 'parent' AS tree, type_id AS id, trim(parent_type_id) AS p FROM cur UNION ALL SELECT 'merged', type_id, trim(merged_into_type_id) FROM cur),
n AS (SELECT tree, id, CASE WHEN p <> '' THEN p END AS pointed, CASE WHEN p IN (SELECT type_id FROM cur) THEN p END AS parent FROM raw),
w AS (SELECT tree, id, id AS at, id AS root, 0 AS depth, id AS full_path FROM n WHERE parent IS NULL
  UNION ALL SELECT n.tree, n.id, n.id, w.root, w.depth + 1, w.full_path || '/' || n.id FROM w JOIN n ON n.tree = w.tree AND n.parent = w.at),
listed AS (SELECT n.tree, n.id, w.root, w.depth, w.full_path FROM n LEFT JOIN w ON w.tree = n.tree AND w.id = n.id WHERE n.tree = 'parent' OR n.pointed IS NOT NULL)
"""

ORACLES = {
    "p4_found": _ORPHANS + "SELECT DISTINCT tbl, ref_id, slot_name, target_id, ref_month FROM o",
    "p4_report": _ORPHANS + "SELECT tbl, ref_month, reason, count(*) AS orphans FROM o GROUP BY ALL",
    "p7_found": _TREE + "SELECT tree AS link_kind, id AS type_id, coalesce(root, '') AS root_type_id, coalesce(depth, -1)::INTEGER AS node_depth FROM listed",
    "p7_nested_sets": _TREE + ", up AS (SELECT tree, id, unnest(string_split(full_path, '/')) AS anc FROM w), sizes AS (SELECT tree, anc, count(*) AS n FROM up GROUP BY ALL),"
    " places AS (SELECT tree, id, row_number() OVER (PARTITION BY tree, root ORDER BY full_path) - 1 AS preorder FROM w)"
    " SELECT l.tree AS link_kind, l.id AS type_id, coalesce(l.root, '') AS root_type_id, coalesce(l.depth, -1)::INTEGER AS node_depth, s.n AS subtree_size, p.preorder"
    " FROM listed l LEFT JOIN sizes s ON s.tree = l.tree AND s.anc = l.id LEFT JOIN places p ON p.tree = l.tree AND p.id = l.id",
    "p7_descendants": _TREE + ", up AS (SELECT tree, id, depth, unnest(string_split(full_path, '/')) AS anc FROM w)"
    " SELECT u.tree AS link_kind, u.anc AS type_id, u.id AS descendant_id, (u.depth - a.depth)::INTEGER AS distance FROM up u JOIN w a ON a.tree = u.tree AND a.id = u.anc WHERE u.id <> u.anc",
    "p7_paths": _TREE + ", up AS (SELECT tree, id, unnest(string_split(full_path, '/')) AS anc FROM w), sizes AS (SELECT tree, anc, count(*) AS n FROM up GROUP BY ALL)"
    " SELECT l.tree AS link_kind, l.id AS type_id, l.full_path, coalesce(l.depth, -1)::INTEGER AS node_depth, s.n AS subtree_size FROM listed l LEFT JOIN sizes s ON s.tree = l.tree AND s.anc = l.id",
}
