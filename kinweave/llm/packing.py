"""Items put into containers of fixed capacity, by minimum bin slack.

Only the number of items of each length decides the packing, and there are no more lengths than
the capacity, so the plan is made from that histogram in the driver, whatever the number of
items: the longest length left opens a container, a subset-sum over the lengths left, held as the
bits of one integer, finds the fullest combination, and the combination is used as often as the
histogram allows.  The items then take their places by their rank within their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.storage import Scratch

#: Tokens of a window.
CAPACITY = 2048


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length fill ``room`` best; at most ``counts`` of each."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        for _ in range(min(counts[length], room // length)):
            wider = (reach | reach << length) & mask
            if wider == reach:
                break
            steps.append((length, reach))
            reach = wider
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        if not before >> at & 1:
            at -= length
            used[length] = used.get(length, 0) + 1
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths and how many containers have each; together they hold the histogram exactly."""
    left = {n: c for n, c in histogram.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("lengths lie between 1 and the capacity")
    out = []
    while left:
        first = max(left)
        rest = {n: c - (n == first) for n, c in left.items()}
        used = fullest({n: c for n, c in rest.items() if c}, capacity - first)
        used[first] = used.get(first, 0) + 1
        times = min(left[n] // m for n, m in used.items())
        for n, m in used.items():
            left[n] -= m * times
            if not left[n]:
                del left[n]
        out.append((used, times))
    return out


def places(combinations: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first rank of each run of containers, the first container, and items in each container."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    container = 0
    for used, times in combinations:
        for n, m in used.items():
            runs.setdefault(n, []).append((taken.get(n, 0), container, m))
            taken[n] = taken.get(n, 0) + m * times
        container += times
    return {n: tuple(np.array(x, dtype=np.int64) for x in zip(*r)) for n, r in runs.items()}


def pieces(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """id, start, length of each piece of ``sizes`` (id, n): only an item longer than the capacity is split.

    NULL sizes count as 0.  An item of size 0 is one piece of length 0.
    """
    n = F.coalesce(F.col("n"), F.lit(0))
    cuts = F.when(n > capacity, F.sequence(F.lit(0).cast("long"), n - 1, F.lit(capacity).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return sizes.select("id", n.alias("n"), F.explode(cuts).alias("start")).select("id", "start", F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("start")).alias("length"))


def packed(sizes: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """window_id, id, start, length: the window of each piece of ``sizes`` (id, n).

    Windows are numbered from 0; a piece that fills one alone has a window of its own, and a
    piece of length 0 takes no room and has the window NULL.  Equal ids are different items.
    """
    # Items are ranked within their length by the task that measured them, so that no window holds all items of one length.
    items = scratch.save(pieces(sizes, capacity).withColumn("part", F.spark_partition_id()), "pieces")
    counts = {int(r["length"]): int(r["n"]) for r in items.where("length > 0").groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    table = scratch.spark.sparkContext.broadcast(places(plan(counts, capacity)))
    dealt = items.where("length > 0")
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("id", "start")) - 1
    ranked = dealt.join(offsets, ["length", "part"]).select("id", "start", "length", (F.col("offset") + within).cast("long").alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            window = np.empty(len(length), dtype=np.int64)
            for n in np.unique(length):
                own = length == n
                first, container, each = table.value[int(n)]
                run = np.searchsorted(first, rank[own], side="right") - 1
                window[own] = container[run] + (rank[own] - first[run]) // each[run]
            yield pa.RecordBatch.from_arrays([pa.array(window), batch.column("id"), batch.column("start"), batch.column("length")], names=["window_id", "id", "start", "length"])

    kind = dict(items.dtypes)["id"]
    put = ranked.mapInArrow(place, f"window_id long, id {kind}, start long, length long")
    return put.unionByName(items.where("length = 0").select(F.lit(None).cast("long").alias("window_id"), "id", "start", "length"))


def usage(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """windows, tokens, unused_share of a packing, and the least number of windows that could hold the tokens."""
    total = placed.where("window_id is not null").agg(F.countDistinct("window_id").alias("windows"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"))
    return total.select("windows", "tokens", F.ceil(F.col("tokens") / capacity).alias("least_windows"), F.round(1 - F.col("tokens") / (F.col("windows") * capacity), 6).alias("unused_share"))
