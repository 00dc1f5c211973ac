"""Parent-child links unfolded to nested sets, and root, depth, path and descendants out of these.

Subtree sizes are summed upward, siblings get offsets by prefix sums in the order of their ids, and
the offsets are summed downward: every node then holds a range of numbers, ``[place, place +
subtree_size)``, that encloses the ranges of the nodes below it and no others.  A node's depth is
the number of ranges that enclose its own, its root is the outermost of these, and its descendants
are the nodes whose places lie in its range.  Both sums double the distance that they span in each
round, so a chain of 1,000 nodes takes 10 rounds and not 1,000.  A node on a loop, or below one,
never reaches a root: its walk is still open when no other is, and it gets no range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.storage import Scratch

#: Places whose enclosing ranges are counted by one window, and places that meet their ancestors in one group.
SWEEP, BUCKET = 1 << 16, 64


def _linked(links: DataFrame) -> DataFrame:
    """tree, id, parent: one row for each id, with a parent only where that has a row."""
    own = links.where("id is not null").groupBy("tree", "id").agg(F.min("parent").alias("parent"))
    known = own.select("tree", F.col("id").alias("parent"), F.lit(True).alias("known"))
    return own.join(known, ["tree", "parent"], "left").select("tree", "id", F.when(F.col("known"), F.col("parent")).alias("parent"))


def _named(name: str, parts: list[DataFrame]) -> list:
    """The arguments of Scratch.load for the parts ``name``0, ``name``1 and so on."""
    return [f"{name}0", parts[0], *(f"{name}{i}" for i in range(1, len(parts)))]


def _sizes(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """tree, id, parent, size of the nodes whose walk upward ends: how many nodes each has below it, with itself.

    Before round k, ``up`` is the ancestor at exactly 2**k steps and ``size`` counts the nodes
    below at fewer steps; each walk hands its count to ``up``, and only walks with an ancestor
    that far go on.  Depths leave no gaps, so a round in which no walk ended leaves only loops.
    """
    parts = [scratch.save(nodes.where("parent is not null").select("tree", "id", F.col("parent").alias("up"), F.lit(1).cast("long").alias("size")), "up0")]
    left, before = parts[0].count(), None
    while left and left != before:
        walks = parts[-1]
        handed = walks.groupBy("tree", F.col("up").alias("id")).agg(F.sum("size").alias("more"))
        ahead = walks.select("tree", F.col("id").alias("up"), F.col("up").alias("far"))
        on = walks.join(ahead, ["tree", "up"]).join(handed, ["tree", "id"], "left").select("tree", "id", F.col("far").alias("up"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        parts.append(scratch.save(on, f"up{len(parts)}"))
        before, left = left, parts[-1].count()
    if left:
        nodes = nodes.join(parts[-1].select("tree", "id"), ["tree", "id"], "left_anti")
    below = scratch.load(*_named("up", parts)).groupBy("tree", F.col("up").alias("id")).agg(F.sum("size").alias("below"))
    return nodes.join(below, ["tree", "id"], "left").select("tree", "id", "parent", (F.coalesce("below", F.lit(0)) + 1).alias("size"))


def _offsets(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds ``value``: the sizes of the earlier siblings, and 1 for the parent; roots are siblings too.

    The nodes are sorted into ranges of parent and id, however many children a parent has: a window
    sums within a parent's part of a range, another one over its ranges.
    """
    family = ["tree", "below", "of"]
    kids = nodes.select("tree", "id", "parent", "size", F.col("parent").isNotNull().alias("below"), F.coalesce("parent", F.lit("")).alias("of"))
    kept = scratch.save(kids.repartitionByRange(*family, "id").withColumn("part", F.spark_partition_id()), "siblings")
    before = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = kept.groupBy(*family, "part").agg(F.sum("size").alias("size"))
    skipped = parts.select(*family, "part", before(Window.partitionBy(*family).orderBy("part")).alias("skipped"))
    here = kept.select("tree", "id", "parent", "size", "below", "of", "part", before(Window.partitionBy(*family, "part").orderBy("id")).alias("here"))
    return here.join(skipped, [*family, "part"]).select("tree", "id", "parent", "size", (F.col("here") + F.col("skipped") + F.col("below").cast("int")).alias("value"))


def _walked(nodes: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """tree, id, root, steps, total of each node (tree, id, parent, value) whose walk to a root ends; total sums value over the walk.

    Walks that ended are written once; each round only moves the open ones, to where the walk
    that they have reached got to by then.
    """
    start = nodes.select("tree", "id", F.coalesce("parent", "id").alias("up"), F.col("parent").isNull().alias("done"), F.col("parent").isNotNull().cast("long").alias("steps"), F.col("value").cast("long").alias("total"))
    parts, left, k = [scratch.save(start, f"{name}0")], None, 0
    while True:
        walks = parts[-1].where("not done")
        before, left = left, walks.count()
        if left in (0, before):
            return scratch.load(*_named(name, parts)).where("done").select("tree", "id", F.col("up").alias("root"), "steps", "total")
        reached = parts[-1] if k == 0 else parts[-1].unionByName(scratch.load(*_named(name, parts[:-1])).where("done"))
        ahead = reached.select("tree", F.col("id").alias("up"), F.col("up").alias("far"), F.col("done").alias("over"), F.col("steps").alias("further"), F.col("total").alias("more"))
        k += 1
        parts.append(scratch.save(walks.join(ahead, ["tree", "up"]).select("tree", "id", F.col("far").alias("up"), F.col("over").alias("done"), (F.col("steps") + F.col("further")).alias("steps"), (F.col("total") + F.col("more")).alias("total")), f"{name}{k}"))


def _enclosed(ranges: DataFrame) -> DataFrame:
    """Adds root and depth to nodes (tree, id, parent, size, place) by a sweep over the places.

    Each place begins one range, so the ranges that enclose a place are those begun before it less
    those ended by then.  The root is the last begun range that nothing encloses.  Windows sweep
    SWEEP places; the totals of all earlier ones come in by a window over one row of each.
    """
    keep = F.struct("id", "parent", "size")
    begun = ranges.select("tree", "place", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("ended"), F.when(F.col("parent").isNull(), F.struct("place", "id")).alias("top"), keep.alias("node"))
    ended = ranges.groupBy("tree", (F.col("place") + F.col("size")).alias("place")).agg(F.count(F.lit(1)).alias("ended")).select("tree", "place", F.lit(0).alias("kind"), "ended", F.lit(None).cast(begun.schema["top"].dataType).alias("top"), F.lit(None).cast(begun.schema["node"].dataType).alias("node"))
    events = begun.unionByName(ended).withColumn("sweep", F.floor(F.col("place") / SWEEP))
    all_before = Window.partitionBy("tree").orderBy("sweep").rowsBetween(Window.unboundedPreceding, -1)
    totals = events.groupBy("tree", "sweep").agg(F.sum("ended").alias("e"), F.max("top").alias("t")).select("tree", "sweep", F.coalesce(F.sum("e").over(all_before), F.lit(0)).alias("e"), F.max("t").over(all_before).alias("t"))
    so_far = Window.partitionBy("tree", "sweep").orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.withColumn("_e", F.sum("ended").over(so_far)).withColumn("_t", F.max("top").over(so_far)).where("kind = 1").join(totals, ["tree", "sweep"])
    return swept.select("tree", "node.*", "place", F.coalesce("_t", "t")["id"].alias("root"), (F.col("place") - F.col("_e") - F.col("e")).cast("int").alias("depth"), F.coalesce("_t", "t")["place"].alias("_first"))


def chain_ends(links: DataFrame, scratch: Scratch) -> DataFrame:
    """tree, id, root, steps of each node of ``links`` (tree, id, parent; see unfold); root NULL and steps -1 on a loop or below one."""
    nodes = scratch.save(_linked(links), "nodes")
    ends = _walked(nodes.withColumn("value", F.lit(0)), scratch, "walk").drop("total")
    return nodes.select("tree", "id").join(ends, ["tree", "id"], "left").select("tree", "id", "root", F.coalesce("steps", F.lit(-1)).cast("int").alias("steps"))


def unfold(links: DataFrame, scratch: Scratch, paths: bool = False) -> DataFrame:
    """tree, id, parent, root, depth, subtree_size, preorder[, path] of each node of ``links`` (tree, id, parent).

    ``tree`` names independent link kinds.  Rows without an id are dropped; of rows with the same
    id the smallest parent counts.  A parent that is NULL or isn't an id of the tree makes its child a root.  On a loop
    or below one: root NULL, depth -1, and NULL size, preorder and path.  Preorder counts from 0
    at each root, siblings in the order of their ids.  ``path`` holds the ids from the root down to
    the node.  Other columns are ignored.
    """
    nodes = scratch.save(_linked(links), "nodes")
    offsets = scratch.save(_offsets(scratch.save(_sizes(nodes, scratch), "sizes"), scratch), "offsets")
    places = _walked(offsets, scratch, "down").select("tree", "id", F.col("total").alias("place"))
    swept = _enclosed(offsets.select("tree", "id", "parent", "size").join(places, ["tree", "id"]))
    found = swept.select("tree", "id", "root", "depth", F.col("size").alias("subtree_size"), (F.col("place") - F.col("_first")).alias("preorder"))
    out = nodes.join(found, ["tree", "id"], "left").withColumn("depth", F.coalesce("depth", F.lit(-1)))
    if not paths:
        return out
    out = scratch.save(out, "unfolded")
    step = F.struct(F.col("distance").alias("far"), F.col("id").alias("id"))
    above = descendants(out, out).groupBy("tree", F.col("descendant").alias("id")).agg(F.sort_array(F.collect_list(step), asc=False).alias("p"))
    path = F.concat(F.coalesce(F.transform("p", lambda s: s["id"]), F.array().cast("array<string>")), F.array("id"))
    return out.join(above, ["tree", "id"], "left").withColumn("path", F.when(F.col("root").isNotNull(), path)).drop("p")


def _each(first: Column, last: Column, step: int) -> Column:
    return F.explode(F.sequence(first, last, F.lit(step).cast("long")))


def descendants(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """tree, id, descendant, distance for each node of ``of`` (tree, id), by the ranges of ``nodes`` (see unfold).

    A range is cut into buckets of BUCKET places, where it meets the nodes of its own root; all but
    its first and last bucket hold descendants only, so little more is compared than comes out.
    """
    placed = nodes.where("root is not null")
    a = placed.where("subtree_size > 1").join(of.select("tree", "id").distinct(), ["tree", "id"], "left_semi")
    a = a.select("tree", "id", "root", (F.col("preorder") + 1).alias("lo"), (F.col("preorder") + F.col("subtree_size")).alias("hi"), F.col("depth").alias("top"), F.floor((F.col("preorder") + 1) / BUCKET).alias("_b"), F.floor((F.col("preorder") + F.col("subtree_size") - 1) / BUCKET).alias("_z"))
    # In two steps, as one array of all buckets of a range may not fit.
    a = a.select("*", _each(F.col("_b"), F.col("_z"), SWEEP).alias("_from")).select("tree", "id", "root", "lo", "hi", "top", _each(F.col("_from"), F.least("_z", F.col("_from") + SWEEP - 1), 1).alias("bucket"))
    b = placed.select("tree", F.col("id").alias("descendant"), "root", "preorder", "depth", F.floor(F.col("preorder") / BUCKET).alias("bucket"))
    return a.join(b, ["tree", "root", "bucket"]).where("preorder >= lo and preorder < hi").select("tree", "id", "descendant", (F.col("depth") - F.col("top")).alias("distance"))


def type_links(types: DataFrame) -> DataFrame:
    """tree (parent or merged), id, parent of the current row of each type; a blank pointer is NULL."""
    from kinweave.sources.tables import current_rows

    rows = current_rows(types, "type_id", "parent_type_id", "merged_into_type_id")
    kinds = F.array(F.struct(F.lit("parent").alias("tree"), F.trim("parent_type_id").alias("parent")), F.struct(F.lit("merged").alias("tree"), F.trim("merged_into_type_id").alias("parent")))
    return rows.select(F.col("type_id").alias("id"), F.explode(kinds).alias("k")).select("k.tree", "id", F.when(F.col("k.parent") != "", F.col("k.parent")).alias("parent"))
