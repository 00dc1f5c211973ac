"""Running-average prototypes of entities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The most weight of a soft link, and the least posterior with which one counts.
SOFT_WEIGHT, SOFT_LEAST = 0.5, 0.85
#: Keys whose sums a task holds before it hands them on.
PARTIAL_KEYS = 8192


def eligible(links: DataFrame, least: float = SOFT_LEAST) -> DataFrame:
    """Adds weight; keeps hard links, and soft ones of posterior ``least`` or more."""
    hard = F.col("status") == "hard"
    return links.where(hard | ((F.col("status") == "soft") & (F.col("posterior") >= least))).withColumn("weight", F.when(hard, 1.0).otherwise(F.least("posterior", F.lit(SOFT_WEIGHT))))


def takes_image(slots: Column, name: Column) -> Column:
    """Whether an entity's image prototype is updated: it has a place, or no name."""
    has = lambda k: F.coalesce(F.array_contains(F.map_keys(slots), k), F.lit(False))
    return has("latitude") | has("gps_latitude") | (F.coalesce(name, F.lit("")) == "")


def summed(rows: DataFrame, key: str, vector: str, factor: str | None = None) -> DataFrame:
    """key, total, n: the sum of each key's vectors, times ``factor`` if given, and how many there are; NULL elements add nothing.

    Tasks add up the vectors of a key before any shuffle, so a key of any size gives a few rows of each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}

        def out() -> pa.RecordBatch:
            keys = pa.array([k for k, _ in sums], kind)
            return pa.RecordBatch.from_arrays([keys, pa.array([t.tolist() for t, _ in sums.values()], pa.list_(pa.float64())), pa.array([n for _, n in sums.values()], pa.int64())], names=[key, "total", "n"])

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            coded = batch.column(0).dictionary_encode()
            names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            lengths, factors = batch.column(1).value_lengths().to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            for length in np.unique(lengths):
                own = np.flatnonzero(lengths == length)
                v = batch.column(1).take(pa.array(own)).flatten().cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False).reshape(len(own), -1) * factors[own, None]
                found, at = np.unique(codes[own], return_inverse=True)
                totals, counts = np.zeros((len(found), v.shape[1])), np.bincount(at, minlength=len(found))
                np.add.at(totals, at, v)
                for code, total, n in zip(found, totals, counts):
                    held = sums.setdefault((names[code], int(length)), [np.zeros(len(total)), 0])
                    held[0] += total
                    held[1] += int(n)
            if len(sums) >= PARTIAL_KEYS:
                yield out()
                sums.clear()
        if sums:
            yield out()

    given = rows.select(key, vector, (F.col(factor).cast("double") if factor else F.lit(1.0)).alias("factor")).where(F.col(key).isNotNull() & F.col(vector).isNotNull() & F.col("factor").isNotNull())
    kind = rows.schema[key].dataType.simpleString()
    parts = given.mapInArrow(run, f"{key} {kind}, total array<double>, n long").groupBy(key).agg(F.collect_list("total").alias("t"), F.sum("n").alias("n"))
    rest = F.slice("t", F.lit(2), F.size("t"))
    return parts.select(key, F.aggregate(rest, F.col("t")[0], lambda x, y: F.zip_with(x, y, lambda p, q: p + q)).alias("total"), "n")


def _coefficients(vectors: DataFrame) -> DataFrame:
    """entity_id, seq, factor, _kept: with a count of c before an update, the prototype becomes (p c + v w) / (c + w).

    An update keeps c / (c + w) of what was there, so each ends up with w / (c + w) times the
    product of what the later ones keep.  The product is a sum of logarithms over a window.
    """
    order = Window.partitionBy("entity_id").orderBy("seq")
    rows = vectors.withColumn("_c", F.coalesce("before", F.col("prototype_count") + F.row_number().over(order) - 1).cast("double")).withColumn("_sets", F.col("empty") & (F.row_number().over(order) == 1))
    # At count 0, and where there is nothing yet, nothing earlier is kept.
    kept = F.when(~F.col("_sets") & (F.col("_c") > 0), F.log(F.col("_c") / (F.col("_c") + F.col("weight")))).otherwise(F.lit(float("-inf")))
    latest = Window.partitionBy("entity_id").orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = F.coalesce(F.sum(kept).over(latest), F.lit(0.0))
    share = F.when(F.col("_sets") | (F.col("_c") <= 0), 1.0).otherwise(F.col("weight") / (F.col("_c") + F.col("weight")))
    return rows.withColumn("factor", share * F.exp(later)).withColumn("_kept", kept).select("entity_id", "seq", "factor", "_kept")


def updated(vectors: DataFrame) -> DataFrame:
    """entity_id, prototype, prototype_count after the updates ``vectors`` (entity_id, current, prototype_count, seq, vector, weight[, before]).

    Updates apply in the order of seq, each by (current * count + vector * weight) / (count + weight)
    with a count that grows by one, or with the count ``before`` it if that is given; without a
    current prototype the first vector is taken as it is.  The order only sets each vector's factor, so the
    vectors themselves are summed in the tasks before the shuffle, however many observations an entity has.
    """
    empty = F.col("current").isNull()
    given = vectors.withColumn("_stored", F.coalesce("prototype_count", F.lit(0))).withColumn("prototype_count", F.when(empty, 0).otherwise(F.coalesce("prototype_count", F.lit(0)))).withColumn("empty", empty)
    given = given if "before" in vectors.columns else given.withColumn("before", F.lit(None).cast("long"))
    # Only narrow rows are ordered within an entity; the vectors meet their factors by entity and seq.
    factors = _coefficients(given.select("entity_id", "seq", "prototype_count", "weight", "before", "empty"))
    rows = given.join(factors, ["entity_id", "seq"])
    rest = rows.groupBy("entity_id").agg(F.exp(F.sum("_kept")).alias("kept"), F.first("_stored").alias("stored"), F.first("current").alias("current"))
    sums = summed(rows, "entity_id", "vector", "factor")
    old = F.when(F.col("current").isNull() | (F.col("kept") == 0), F.col("total")).otherwise(F.zip_with("current", "total", lambda c, a: c.cast("double") * F.col("kept") + a))
    return sums.join(rest, "entity_id").select("entity_id", old.alias("prototype"), (F.col("stored") + F.col("n")).cast("int").alias("prototype_count"))


def centroid(vectors: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """key, centroid, members: the mean vector of each group."""
    return summed(vectors, key, vector).select(key, F.transform("total", lambda x: x / F.col("n")).alias("centroid"), F.col("n").alias("members"))


def coherence(vectors: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """key, members, coherence: the mean cosine over all pairs of a group, by (|sum of units|^2 - n) / (n (n - 1)), without pairing."""
    square = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    total = summed(vectors.withColumn("_f", F.when(square > 0, 1 / F.sqrt(square))), key, vector, "_f")
    q = F.aggregate("total", F.lit(0.0), lambda s, x: s + x * x)
    return total.select(key, F.col("n").alias("members"), F.when(F.col("n") > 1, (q - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("coherence"))


def exemplars(vectors: DataFrame, centroids: DataFrame, key: str, member: str, k: int = 5) -> DataFrame:
    """key, member, cosine, rank: the k members nearest to their group's centroid, and the group's spread is the mean of 1 - cosine."""
    from kinweave.functions.vectors import cosine

    near = vectors.join(centroids.select(key, "centroid"), key).select(key, member, cosine("vector", "centroid").alias("cosine"))
    order = Window.partitionBy(key).orderBy(F.col("cosine").desc(), member)
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def spread(vectors: DataFrame, centroids: DataFrame, key: str) -> DataFrame:
    from kinweave.functions.vectors import cosine

    return vectors.join(centroids.select(key, "centroid"), key).groupBy(key).agg(F.avg(1 - cosine("vector", "centroid")).alias("spread"))
