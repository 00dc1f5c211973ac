"""Pairwise matches consolidated into groups, by randomised contraction.

In each round every vertex hooks to the vertex with the smallest hash among itself and its
neighbours, under a fresh hash; edges are relabelled and deduplicated, and the rounds go on until
no edge is left.  About a third of the vertices or more goes in each round, whatever the shape of
the graph, so chains of any length and stars of any size take O(log n) rounds.  The mappings of
the rounds are then expanded from the last to the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.storage import Scratch


def contract(edges: DataFrame, scratch: Scratch, seed: int = 0) -> DataFrame:
    """v, root of each vertex of ``edges`` (a, b): vertices linked directly or indirectly share one root.

    NULL ends, loops and repeated edges are dropped; a vertex without any edge isn't listed.
    """
    a, b = F.least("a", "b"), F.greatest("a", "b")
    live = edges.where("a is not null and b is not null and a <> b").select(a.alias("a"), b.alias("b")).distinct()
    live, rounds = scratch.save(live, "edges0"), 0
    while not live.isEmpty():
        h = lambda c: F.xxhash64(F.lit(seed + rounds), c)  # noqa: B023, E731
        both = live.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(live.select(F.col("b").alias("v"), F.col("a").alias("w")))
        best = both.groupBy("v").agg(F.min(F.struct(h("w").alias("h"), F.col("w").alias("w"))).alias("n"))
        own = F.struct(h("v").alias("h"), F.col("v").alias("w"))
        hooks = scratch.save(best.select("v", F.least("n", own)["w"].alias("w")), f"hooks{rounds}")
        moved = live.join(hooks.select(F.col("v").alias("a"), F.col("w").alias("ra")), "a").join(hooks.select(F.col("v").alias("b"), F.col("w").alias("rb")), "b")
        live = moved.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        rounds += 1
        live = scratch.save(live, f"edges{rounds}")
        scratch.drop(f"edges{rounds - 1}")
    if rounds == 0:
        return live.select(F.col("a").alias("v"), F.col("b").alias("root"))
    roots = scratch.load(f"hooks{rounds - 1}").select("v", F.col("w").alias("root"))
    for k in range(rounds - 2, -1, -1):
        ahead = roots.select(F.col("v").alias("w"), "root")
        roots = scratch.load(f"hooks{k}").join(ahead, "w", "left").select("v", F.coalesce("root", "w").alias("root"))
        if k % 4 == 0:  # bounds the depth of the plan
            roots = scratch.save(roots, f"roots{k}")
    return roots


def group_ids(edges: DataFrame, listed: DataFrame, scratch: Scratch, seed: int = 0) -> DataFrame:
    """tbl, id, group_id of the ``listed`` records (tbl, id) whose group holds at least two of them.

    ``edges``: tbl, a, b.  group_id is the smallest listed id of the group.  Ends that aren't
    listed join the records that point at them but don't come out.
    """
    node = lambda c: F.struct("tbl", F.col(c).alias("id"))
    roots = contract(edges.where("a is not null and b is not null").select(node("a").alias("a"), node("b").alias("b")), scratch, seed)
    members = roots.select("v.tbl", "v.id", "root").join(listed.select("tbl", "id").distinct(), ["tbl", "id"])
    members = scratch.save(members, "members")
    groups = members.groupBy("root").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return members.join(groups, "root").select("tbl", "id", "group_id")


def pointers(df: DataFrame, tbl: str, key: str, pointer: str) -> tuple[DataFrame, DataFrame]:
    """The links (tbl, a, b) and the listed records (tbl, id) of all rows of a table; blank pointers link nothing."""
    rows = df.select(F.lit(tbl).alias("tbl"), F.col(key).alias("a"), F.trim(pointer).alias("b")).where("a is not null")
    return rows.where("b <> ''"), rows.select("tbl", F.col("a").alias("id"))
