"""One ranking from several differently-scaled scores, by distance to ideal points (TOPSIS).

Each criterion is winsorised at two quantiles over all rows and divided by the norm of its column.
Its weight makes the way from its worst to its best value as long as that of any other, times the
say that it is given.  An item's closeness is d- / (d+ + d-), its weighted distances to the worst
and to the best point over the criteria that it has; a missing score gives no say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.storage import Scratch

#: Quantiles beyond which scores are pulled in, and the accuracy of their sketch.
WINSOR, ACCURACY = (0.01, 0.99), 20_000
#: Criteria up to which their statistics, a row each, are sent to all tasks; beyond, they are joined by shuffle.
MOST_BROADCAST = 10_000


def long_scores(results: DataFrame) -> DataFrame:
    """item, group_id, member, criterion, score of the scores that have a say; rows with one result_id count once.

    Unlisted, unavailable, NULL and NaN scores are left out.
    """
    once = results.where("result_id is not null").groupBy("result_id").agg(F.min(F.struct("observation_id", "entity_id", "image_similarity", "text_similarity", "signals")).alias("r")).select("result_id", "r.*")
    fixed = F.array(F.struct(F.lit("image_similarity").alias("criterion"), F.col("image_similarity").cast("double").alias("score")), F.struct(F.lit("text_similarity").alias("criterion"), F.col("text_similarity").cast("double").alias("score")))
    signals = F.transform(F.filter(F.coalesce("signals", F.array()), lambda s: s["available"]), lambda s: F.struct(F.concat(F.lit("signal "), s["signal_name"]).alias("criterion"), s["score"].cast("double").alias("score")))
    scores = once.select(F.col("result_id").alias("item"), F.col("observation_id").alias("group_id"), F.col("entity_id").alias("member"), F.explode(F.concat(fixed, signals)).alias("s"))
    return scores.select("item", "group_id", "member", "s.criterion", "s.score").where("criterion is not null and score is not null and not isnan(score) and group_id is not null and member is not null")


def limits(scores: DataFrame) -> DataFrame:
    """criterion, lo, hi: the limits to which its scores are winsorised."""
    found = scores.groupBy("criterion").agg(F.percentile_approx("score", list(WINSOR), ACCURACY).alias("q"), F.min("score").alias("least"), F.max("score").alias("most"))
    # A criterion that is flat between the quantiles keeps its full range.
    flat = F.col("q")[0] >= F.col("q")[1]
    return found.select("criterion", F.when(flat, F.col("least")).otherwise(F.col("q")[0]).alias("lo"), F.when(flat, F.col("most")).otherwise(F.col("q")[1]).alias("hi"))


def _joined(scores: DataFrame, stats: DataFrame, few: bool) -> DataFrame:
    """The scores with the statistics of their criterion, and winsorised."""
    return scores.join(F.broadcast(stats) if few else stats, "criterion").withColumn("x", F.least(F.greatest("score", "lo"), "hi"))


def closeness(scores: DataFrame, scratch: Scratch, say: dict[str, float] | None = None) -> DataFrame:
    """group_id, member, closeness of each item; members that have several items take their best one.

    ``say``: the say of criteria, 1 for those that aren't listed.  The scores are read once; their
    statistics are a row for each criterion.  A criterion without any spread puts all items in the middle.
    """
    scores = scratch.save(scores, "scores")
    found = scratch.save(limits(scores), "limits")
    few = found.count() <= MOST_BROADCAST
    norms = scratch.save(_joined(scores, found, few).groupBy("criterion").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.first("lo").alias("lo"), F.first("hi").alias("hi")), "norms")
    given = F.create_map(*(F.lit(x) for kv in (say or {}).items() for x in kv)) if say else None
    own = F.coalesce(given[F.col("criterion")], F.lit(1.0)).cast("double") if say else F.lit(1.0)
    v = lambda c: F.col(c) / F.col("norm")
    # Where the values differ the norm isn't 0 and neither is the way between the ideal points.
    weight = 1 / (v("hi") - v("lo"))
    spread = F.col("hi") > F.col("lo")
    up, down = F.when(spread, weight * (v("x") - v("lo"))).otherwise(0.5), F.when(spread, weight * (v("hi") - v("x"))).otherwise(0.5)
    each = _joined(scores, norms, few).select("item", "group_id", "member", own.alias("say"), up.alias("up"), down.alias("down"))
    far = lambda c: F.sqrt(F.sum(F.col("say") * F.col(c) * F.col(c)) / F.sum("say"))
    items = each.where("say > 0").groupBy("item", "group_id", "member").agg(far("up").alias("minus"), far("down").alias("plus"))
    return items.groupBy("group_id", "member").agg(F.max(F.col("minus") / (F.col("minus") + F.col("plus"))).alias("closeness"))


def first_of_each(ranked: DataFrame) -> DataFrame:
    """group_id, member with the greatest closeness; ties go to the smaller member.

    An aggregation, so that a group of any size is combined before the shuffle.
    """
    order = F.struct(-F.round("closeness", 12), F.col("member"))
    return ranked.groupBy("group_id").agg(F.min_by("member", order).alias("member"))


def full_ranking(ranked: DataFrame) -> DataFrame:
    """group_id, member, closeness, place."""
    order = Window.partitionBy("group_id").orderBy(F.round("closeness", 12).desc(), "member")
    return ranked.select("group_id", "member", "closeness", F.row_number().over(order).alias("place"))
