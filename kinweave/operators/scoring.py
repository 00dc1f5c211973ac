"""Multi-signal scores of candidates, and the decision to link, to ask or to make an entity."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The weight of each signal by entity nature.
WEIGHTS = {
    "individual": {"image": 0.35, "signature": 0.25, "location": 0.15, "timestamp": 0.10, "det_id": 0.15},
    "class": {"text": 0.40, "facet": 0.30, "name": 0.20, "det_id": 0.10},
    "group": {"member_overlap": 0.35, "location": 0.25, "temporal_proximity": 0.25, "det_id": 0.15},
    "event": {"timestamp": 0.30, "participants": 0.30, "location": 0.20, "duration": 0.10, "det_id": 0.10},
}


#: Fixed value: a signal below it contradicts an uncertain match.
MISMATCH = 0.3


@dataclass(frozen=True)
class Thresholds:
    """The least score of a link, of a candidate, the margin, and those of images."""

    link: float = 0.85
    new: float = 0.60
    margin: float = 0.10
    image: float = 0.75
    image_margin: float = 0.08
    single: float = 0.95


def combined_score(nature: str, signals: dict[str, Column]) -> Column:
    """score, coverage, flags from signals that are NULL where unavailable.

    The weights of the available signals are scaled to one.  Of three or more signals that
    together weigh under a half, the score is lowered; coverage is the root of their weight.
    """
    own = {s: w for s, w in WEIGHTS[nature].items() if s in signals}
    add = lambda xs: reduce(lambda a, b: a + b, xs, F.lit(0.0))
    weight = add(F.when(signals[s].isNotNull(), w).otherwise(0.0) for s, w in own.items())
    n = add(signals[s].isNotNull().cast("int") for s in own)
    mean = add(F.coalesce(signals[s], F.lit(0.0)) * w for s, w in own.items()) / weight
    score = F.when(n == 0, 0.0).when((n >= 3) & (weight < 0.5), mean * (0.7 + 0.3 * F.sqrt(weight))).otherwise(mean)
    flags = F.array_compact(F.array(F.when(n == 0, "no_signals_available"), F.when(n == 1, "single_signal"), F.when(n == 2, "sparse_signals"), F.when((n < 2) & (n > 0), "low_evidence")))
    return F.struct(score.alias("score"), F.sqrt(weight).alias("coverage"), flags.alias("flags"))


def facet_agreement(facets: Column, slots: Column, matches) -> Column:
    """The share of common keys whose values match; 0 without common keys, NULL if a side is empty.

    ``facets`` and ``slots`` are maps, ``matches`` compares two of their values.
    """
    common = F.array_intersect(F.map_keys(facets), F.map_keys(slots))
    same = F.filter(common, lambda k: F.coalesce(matches(facets[k], slots[k]), F.lit(False)))
    filled = lambda m: F.coalesce(F.size(m), F.lit(0)) > 0
    return F.when(filled(facets) & filled(slots), F.when(F.size(common) == 0, 0.0).otherwise(F.size(same) / F.size(common)))


def with_margin(scored: DataFrame, *seed: str) -> DataFrame:
    """The best candidate of each seed: adds second, margin and pool_size; ties go to the nearer, then the smaller id.

    One shuffle and one sort of the scores; a seed has at most as many candidates as are kept of a pool.
    """
    own = Window.partitionBy(*seed)
    by = own.orderBy(F.col("score").desc(), F.coalesce(F.col("rank").cast("long"), F.lit(0)), "entity_id")
    rows = scored.withColumn("second", F.lead("score", 1, 0.0).over(by)).withColumn("pool_size", F.count(F.lit(1)).over(own)).withColumn("_n", F.row_number().over(by))
    return rows.where("_n = 1").drop("_n").withColumn("second", F.coalesce("second", F.lit(0.0))).withColumn("margin", F.col("score") - F.col("second"))


def with_margin_in_order(scored: DataFrame, key: str) -> DataFrame:
    """As with_margin, of rows that lie together in one partition for each ``key``, as nearest gives them: they are read once, without a shuffle or a sort."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def best(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            number = lambda c, none: rows.column(c).cast(pa.float64()).fill_null(none).to_numpy()
            score, rank = number("score", float("-inf")), number("rank", 0.0)
            size = np.diff([*starts, rows.num_rows])
            # Spark counts NaN as the greatest number.
            order = np.lexsort((rank, np.where(np.isnan(score), -np.inf, -score), np.repeat(np.arange(len(starts)), size)))
            second = np.where(size > 1, score[order[np.minimum(starts + 1, rows.num_rows - 1)]], 0.0)
            second = np.where(np.isneginf(second), 0.0, second)
            picked = rows.take(pa.array(order[starts])).combine_chunks()
            for batch in picked.append_column("second", pa.array(second)).append_column("pool_size", pa.array(size, pa.int64())).to_batches():
                yield batch

        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if not rows.num_rows:
                continue
            names = rows.column(key).combine_chunks()
            starts = np.concatenate([[0], np.flatnonzero(pa.compute.not_equal(names.slice(1), names.slice(0, len(names) - 1)).to_numpy(zero_copy_only=False)) + 1]).astype(np.int64)
            rest = rows.slice(starts[-1])  # more of its rows may follow
            if len(starts) > 1:
                yield from best(rows.slice(0, starts[-1]), starts[:-1])
        if rest is not None and rest.num_rows:
            yield from best(rest, np.zeros(1, np.int64))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scored.schema)
    return scored.mapInArrow(run, f"{kinds}, second double, pool_size long").withColumn("margin", F.col("score") - F.col("second"))


def decide(best: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Adds decision (link, candidate or new), posterior and flags to best candidates (see with_margin).

    Needs score, margin, pool_size, nature, image (NULL if unavailable) and sparse; of location,
    timestamp and low_evidence, which only set flags, those that are there.
    A seed without a query vector or pool has no row here: it makes a new entity (see links_of).
    """
    visual = (F.col("nature") == "individual") & F.col("image").isNotNull()
    single = visual & (F.col("pool_size") == 1)
    guard = ~visual | ((F.col("image") >= t.image) & ~(single & (F.col("score") < t.single)))
    link, asks = (F.col("score") >= t.link) & guard, F.col("score") >= t.new
    decision = F.when(link, "link").when(asks, "candidate").otherwise("new")
    posterior = F.when(link | asks, F.col("score")).otherwise(0.8)
    uncertain, given = ~link & asks, set(best.columns)
    far = lambda signal: uncertain & (F.col(signal) < MISMATCH) if signal in given else F.lit(False)
    flags = F.array_compact(F.array(
        F.when(link & (F.col("margin") < t.margin), "margin_review"),
        F.when(link & visual & F.col("sparse") & (F.col("margin") < t.image_margin), "low_image_margin"),
        F.when(link & single, "single_candidate"),
        F.when(uncertain, "uncertain_match"),
        F.when(uncertain & (F.col("image") >= 0.85), "high_visual_similarity"),
        F.when(far("location"), "context_mismatch_gps"),
        F.when(far("timestamp"), "context_mismatch_time"),
        F.when(uncertain & F.col("low_evidence") if "low_evidence" in given else F.lit(False), "low_evidence"),
        F.when(~link & ~asks, "no_match_found"),
    ))
    return best.withColumn("decision", decision).withColumn("posterior", posterior).withColumn("flags", flags)


def links_of(decided: DataFrame, proto_id: Column, *seed: str) -> DataFrame:
    """The one or two links of each decision: to the candidate, and to the entity to be made."""
    to = lambda entity, p, status, flags: F.struct(entity.alias("entity_id"), p.alias("posterior"), F.lit(status).alias("status"), flags.alias("flags"))
    old = F.col("entity_id")
    alternative = F.array(F.lit("proto_alternative"))
    links = (
        F.when(F.col("decision") == "link", F.array(to(old, F.col("posterior"), "soft", F.col("flags"))))
        .when(F.col("decision") == "candidate", F.array(to(old, F.col("posterior"), "candidate", F.col("flags")), to(proto_id, 1 - F.col("posterior"), "candidate", alternative)))
        .otherwise(F.array(to(proto_id, F.lit(0.8), "soft", F.col("flags"))))
    )
    return decided.select(*seed, F.explode(links).alias("l")).select(*seed, "l.*", F.lit("subject").alias("role"))


def unmatched(seeds: DataFrame, decided: DataFrame, proto_id: Column, reason: str, *seed: str) -> DataFrame:
    """Links to new entities of seeds that have no candidates: ``reason`` is no_candidates_found or no_embedding_available."""
    rest = seeds.join(decided.select(*seed), list(seed), "left_anti")
    return rest.select(*seed, proto_id.alias("entity_id"), F.lit(0.8).alias("posterior"), F.lit("soft").alias("status"), F.array(F.lit(reason)).alias("flags"), F.lit("subject").alias("role"))
