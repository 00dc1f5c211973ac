"""The most similar vectors of every vector, by vantage-point trees.

Vectors become unit directions in 16-bit fixed point (132 bytes of 64 numbers; a cosine is off by
about 5e-6), and exact copies become one direction with its members, so that a group of copies of
any size is searched once.  A few routing trees, each fitted to a bounded sample, deal all
directions into shards; in each shard a tree over all its directions is searched, with the
triangle inequality relaxed by ``factor`` (see vptree).  Where a field needs more shards than a sample can
tell apart, each shard is dealt once more, by a tree fitted to a sample of its own, so that shards
stay as large as a worker can hold.  The best partners of all shards are merged and the members of equal directions are put back.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.vptree import VPTree, shard_search
from kinweave.storage import Scratch

#: Routing trees; directions in a shard with its visitors (by memory: a worker that searches 100,000 peaks at 292 MB, 200,000 at 532 MB); directions in a leaf of a shard's tree.
TREES, SHARD, LEAF = 2, 100_000, 256
#: Relaxation of the triangle inequality within a shard and between shards; 1 and 1 give exact search.
FACTOR, SHARD_FACTOR = 10.0, 10.0
#: Directions, with visitors of other shards, that a shard is made for, for each of its own: 4.5 in 64 shards a field of check_l, 7.5 in 256.
VISITS = 8
#: Directions to which the routing trees of a field are fitted, all of them in the driver; every direction is then indexed.
ROUTING_SAMPLE = 12_000
#: Most shards of a routing tree: each needs some points of the sample. Beyond, each is dealt into as many again at most.
MOST_SHARDS = 2048
#: Points for each leaf of the second trees.
LEAF_SAMPLE = 16


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable rows of a list column and their row numbers: exactly ``dim`` finite numbers, not all zero."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == dim)
    if not len(rows):
        return np.empty((0, dim)), rows
    values = column.take(pa.array(rows)).flatten().cast(pa.float64())
    v = values.to_numpy(zero_copy_only=False).reshape(-1, dim)  # NULL becomes NaN
    good = np.isfinite(v).all(axis=1) & (v != 0).any(axis=1)
    return v[good], rows[good]


def encode(v: np.ndarray) -> list[bytes]:
    """Directions in fixed point; the same for all positive multiples of a vector, up to rounding."""
    with np.errstate(over="ignore"):
        unit = v / np.abs(v).max(axis=1, keepdims=True)
    return [row.tobytes() for row in np.rint(unit * 32767).astype("<i2")]


def decode(codes: list[bytes]) -> np.ndarray:
    v = np.frombuffer(b"".join(codes), dtype="<i2").reshape(len(codes), -1).astype(np.float32)
    return v / np.sqrt((v.astype(np.float64) ** 2).sum(axis=1, keepdims=True)).astype(np.float32)


def directions(df: DataFrame, key: str, columns: dict[str, str], dim: int = 64) -> DataFrame:
    """key, order and, for each column, the direction of its vector or NULL if it can't be used.

    ``columns``: names of vector columns and of the results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [batch.column(0), batch.column(1)]
            for i in range(2, batch.num_columns):
                codes: list[bytes | None] = [None] * batch.num_rows
                v, rows = _matrix(batch.column(i), dim)
                for row, code in zip(rows, encode(v) if len(v) else []):
                    codes[row] = code
                out.append(pa.array(codes, pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names=["id", "seq", *columns.values()])

    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("seq", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in columns.values())])
    return df.select(F.col(key).cast("string"), F.col("ingest_seq").cast("long"), *columns).mapInArrow(run, schema)


def packed(c: Column) -> Column:
    """An id as bytes: 16 and a mark for 32 lower-case hexadecimal digits, else its text and another mark."""
    return F.when(c.rlike("^[0-9a-f]{32}$"), F.concat(F.lit(b"\x01"), F.unhex(c))).otherwise(F.concat(F.lit(b"\x00"), F.encode(c, "UTF-8")))


def unpacked(c: Column) -> Column:
    rest = F.substring(c, 2, 1 << 30)
    return F.when(F.substring(c, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))


def current_directions(df: DataFrame, key: str, columns: dict[str, str], dim: int = 64) -> DataFrame:
    """field, id (packed), code of the current row of each id, where its vector can be used."""
    coded = directions(df.where(F.col(key).isNotNull()), key, columns, dim).withColumn("id", packed(F.col("id")))
    latest = coded.groupBy("id").agg(F.max_by(F.struct(*columns.values()), F.coalesce("seq", F.lit(-1))).alias("r"))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"r.{c}").alias("code")) for c in columns.values())))
    return latest.select("id", each.alias("e")).select("e.field", "id", "e.code").where("code is not null")


def _wanted(n: int, shard: int) -> int:
    """The shards of a tree for ``n`` directions: a power of two, 1 if all fit into one."""
    return 1 if n <= shard else 1 << math.ceil(math.log2(VISITS * n / shard))


def _routers(points: DataFrame, counts: dict[str, int], trees: int, shard: int, sample: int, most: int = MOST_SHARDS) -> dict[str, list[VPTree]]:
    """The routing trees of each field, from at most ``sample`` directions of it: those with the smallest hash."""
    routers = {}
    for field, n in counts.items():
        if _wanted(n, shard) == 1:
            routers[field] = [VPTree.build(np.zeros((0, 1), np.float32), 1)] * trees  # one shard, searched with a tree of its own each time
            continue
        shards = min(most, _wanted(n, shard))
        share = min(1.0, 1.3 * sample / n)
        part = points.where((F.col("field") == field) & (F.pmod(F.xxhash64("code"), F.lit(1 << 30)) < int(share * (1 << 30)))).select("code").orderBy(F.xxhash64("code")).limit(sample)
        v = decode(sorted(bytes(r[0]) for r in part.collect()))  # in an order that doesn't depend on tasks, as in each shard
        routers[field] = [VPTree.build(v, max(1, math.ceil(len(v) / shards)), seed) for seed in range(trees)]  # rounded up, so that there are no more leaves than shards
    return routers


def _dealt_again(routed: DataFrame, fields: dict[int, tuple[int, int]], span: int, parts: int, margin: float, scratch: Scratch) -> DataFrame:
    """Shards dealt into ``parts`` each, with the visitors that the margin asks for: shard, pid, home, code.

    ``fields``: for the number of a field (``span`` shard numbers each) its directions and first
    shards.  A tree is fitted to a sample of each shard's own directions, where those are; the rows of
    a shard then stream past its tree.  Shards of other fields keep to one part.
    """
    field = F.floor(F.col("shard") / span).cast("int")
    routed = scratch.save(routed, "routed")
    deep = routed.where(field.isin(list(fields)))
    share = F.create_map(*(F.lit(x) for f, (n, shards) in fields.items() for x in (f, int(min(1.0, LEAF_SAMPLE * parts * shards / n) * (1 << 30)))))

    def fitted(table: pa.Table) -> pa.Table:
        v = decode(sorted(table.column("code").to_pylist()))
        tree = VPTree.build(v, max(1, math.ceil(len(v) / parts)), 1)
        return pa.table({"shard": table.column("shard")[:1], "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    sampled = deep.where("home").where(F.pmod(F.xxhash64("code"), F.lit(1 << 30)) < share[field]).select("shard", "code")
    trees = scratch.save(sampled.groupBy("shard").applyInArrow(fitted, "shard long, tree binary"), "trees")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree = None, None
        for batch in batches:
            numbers = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1), len(numbers)] if len(numbers) else [0]
            for a, b in zip(cuts, cuts[1:]):
                rows = batch.slice(a, b - a)
                if numbers[a] != at:
                    at, tree = numbers[a], None
                if rows.column("pid")[0].as_py() is None:  # the shard's tree comes before its rows
                    tree, rows = pickle.loads(rows.column("code")[0].as_py()), rows.slice(1)
                if not rows.num_rows:
                    continue
                row, leaf, own = (np.arange(rows.num_rows), np.zeros(rows.num_rows, np.int64), np.ones(rows.num_rows, bool)) if tree is None else tree.route(decode(rows.column("code").to_pylist()), margin)
                home = rows.column("home").to_numpy(zero_copy_only=False)[row] & own
                yield pa.RecordBatch.from_arrays([pa.array(at * parts + leaf, pa.int64()), rows.column("pid").take(pa.array(row)), pa.array(home), rows.column("code").take(pa.array(row))], names=["shard", "pid", "home", "code"])

    both = trees.select("shard", F.lit(None).cast("long").alias("pid"), F.lit(True).alias("home"), F.col("tree").alias("code")).unionByName(deep)
    tasks = min(4096, sum(shards for _, shards in fields.values()))
    again = both.repartition(max(1, tasks), "shard").sortWithinPartitions("shard", F.col("pid").asc_nulls_first()).mapInArrow(route, "shard long, pid long, home boolean, code binary")
    return again.unionByName(routed.where(~field.isin(list(fields))).withColumn("shard", F.col("shard") * parts))


def all_nearest(vectors: DataFrame, scratch: Scratch, k: int = 5, least: float = 0.92, factor: float = FACTOR, shard_factor: float = SHARD_FACTOR, trees: int = TREES, shard: int = SHARD, leaf: int = LEAF, sample: int = ROUTING_SAMPLE, most: int = MOST_SHARDS) -> DataFrame:
    """field, a, b, cos: the k vectors most similar to each vector a of its field, of cosine ``least`` or more.

    ``vectors``: field, id (packed), code (see current_directions), one row for each field and id.
    Ties go to the smaller id.  No field, no vector or a single one gives no rows.
    """
    vectors = scratch.save(vectors, "vectors")
    points = scratch.save(vectors.groupBy("field", "code").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("pid", F.monotonically_increasing_id()), "points")
    counts = {r["field"]: r["n"] for r in points.groupBy("field").agg(F.count(F.lit(1)).alias("n")).collect()}
    routers = scratch.spark.sparkContext.broadcast(_routers(points, counts, trees, shard, sample, most))
    radius, names = math.sqrt(2 - 2 * least), sorted(counts)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = np.array(batch.column("field").to_pylist())
            for field in np.unique(fields):
                own = np.flatnonzero(fields == field)
                codes = batch.column("code").take(pa.array(own))
                pid = batch.column("pid").to_numpy()[own]
                v = decode(codes.to_pylist())
                for t, tree in enumerate(routers.value[field]):
                    row, at, home = tree.route(v, radius / shard_factor)
                    number = (names.index(field) * trees + t) * most + at
                    yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(pid[row], pa.int64()), pa.array(home), codes.take(pa.array(row))], names=["shard", "pid", "home", "code"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        numbers = table.column("shard").to_numpy()
        for number in np.unique(numbers):
            own = table.filter(pa.array(numbers == number)).sort_by("code")
            pid = own.column("pid").to_numpy()
            v = decode(own.column("code").to_pylist())
            a, b, cos = shard_search(v, own.column("home").to_numpy(), k, least, factor, leaf, int(number))
            # A pair that both sides found goes out once.
            pair, once = np.unique(np.minimum(a, b) * len(v) + np.maximum(a, b), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(pid[pair // len(v)], pa.int64()), pa.array(pid[pair % len(v)], pa.int64()), pa.array(cos[once].astype(np.float64))], names=["a", "b", "cos"])

    routed = points.select("field", "pid", "code").mapInArrow(route, "shard long, pid long, home boolean, code binary")
    shards = sum(trees * _wanted(n, shard) for n in counts.values())
    parts = min(most, max((-(-_wanted(n, shard) // most) for n in counts.values()), default=1))
    if parts > 1:
        deep = {names.index(f): (n, trees * most) for f, n in counts.items() if _wanted(n, shard) > most}
        # Each direction is at home once in every tree.
        routed = _dealt_again(routed, {i: (n * trees, m) for i, (n, m) in deep.items()}, trees * most, parts, radius / shard_factor, scratch)
    dealt = routed.repartition(max(1, min(shards, 1 << 16)), "shard")
    near = dealt.mapInArrow(search, "a long, b long, cos double")
    pairs = scratch.save(near.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("cos").alias("cos")), "pairs")
    # A pair that one side found serves the other too.
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "cos"))
    best = both.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.col("cos").desc(), "b"))).where(F.col("rank") <= k).drop("rank")
    return _members(vectors, points, best, scratch, k)


def _members(vectors: DataFrame, points: DataFrame, best: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """Puts ids in the place of directions.

    Of equal directions only the k + 1 members with the smallest ids can be anyone's partner, and
    every member has the same list of partners but for itself.
    """
    key = F.unhex(F.md5("code")).alias("key")  # in the place of the longer code
    several = points.where("n > 1").select("field", key, "pid")
    copies = scratch.save(vectors.select("field", "id", key).join(several, ["field", "key"]).select("field", "id", "pid"), "copies")
    smallest = Window.partitionBy("pid").orderBy(unpacked(F.col("id")))
    first = copies.withColumn("rank", F.row_number().over(smallest)).where(F.col("rank") <= k + 1).groupBy("pid").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    alone = points.where("n = 1").select("pid", "field", "n", F.array("rep").alias("ids"))
    names = scratch.save(alone.unionByName(points.where("n > 1").select("pid", "field", "n").join(first, "pid")), "names")
    partner = F.struct(F.round(-F.col("cos"), 7).alias("far"), F.col("ids").alias("ids"))
    others = best.join(names.select(F.col("pid").alias("b"), "ids"), "b").groupBy("a").agg(F.sort_array(F.collect_list(partner)).alias("others"))
    lists = names.join(others.withColumnRenamed("a", "pid"), "pid", "left").where("n > 1 or others is not null")
    none = F.array().cast("array<struct<far:double,ids:array<binary>>>")
    own = F.when(F.col("n") > 1, F.array(F.struct(F.lit(-1.0).alias("far"), F.col("ids").alias("ids")))).otherwise(none)
    flat = lambda g: F.transform(g["ids"], lambda i: F.struct(g["far"].alias("far"), unpacked(i).alias("id")))
    ranked = lists.select("pid", "field", "n", "ids", F.array_sort(F.flatten(F.transform(F.concat(own, F.coalesce("others", none)), flat))).alias("p"))
    single = ranked.where("n = 1").select("field", unpacked(F.col("ids")[0]).alias("a"), "p")
    many = copies.select("pid", "id").join(ranked.where("n > 1").select("pid", "field", "p"), "pid").select("field", unpacked(F.col("id")).alias("a"), "p")
    out = single.unionByName(many).select("field", "a", F.explode(F.slice(F.filter("p", lambda x: x["id"] != F.col("a")), 1, k)).alias("x"))
    return out.select("field", "a", F.col("x.id").alias("b"), (-F.col("x.far")).alias("cos"))


def similar_pairs(nearest: DataFrame) -> DataFrame:
    """field, id_a, id_b with id_a < id_b of each pair of which one is among the other's most similar."""
    pair = lambda f: packed(f("a", "b"))
    once = nearest.select("field", pair(F.least).alias("id_a"), pair(F.greatest).alias("id_b")).distinct()
    return once.select("field", unpacked(F.col("id_a")).alias("id_a"), unpacked(F.col("id_b")).alias("id_b"))
