"""Type labels: candidates by normal name, aliases, and the data side of merges and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.names import derived_id, normalize_type_name

INACTIVE = ("deprecated", "merged_into")


def candidates_of(proposals: DataFrame, name: str, order: str) -> DataFrame:
    """One candidate of each normal name: the first proposed spelling, and how often the name was proposed."""
    rows = proposals.select(F.col(name).alias("proposed_name"), F.col(order).alias("_o"), normalize_type_name(name).alias("normalized_name")).where("normalized_name <> ''")
    grouped = rows.groupBy("normalized_name").agg(F.min_by("proposed_name", F.struct("_o", "proposed_name")).alias("proposed_name"), F.count(F.lit(1)).alias("evidence_count"))
    return grouped.select(derived_id("candidate", "normalized_name").alias("candidate_id"), "proposed_name", "normalized_name", "evidence_count")


def best_candidates(candidates: DataFrame, names: DataFrame, statuses: tuple[str, ...] = ("proposed", "promoted")) -> DataFrame:
    """normalized_name and the candidate of each of ``names`` with the most evidence; ties go to the smaller id."""
    live = candidates.where(F.col("status").isin(*statuses))
    best = F.min_by("candidate_id", F.struct(-F.col("evidence_count"), F.col("candidate_id")))
    return live.join(names.select("normalized_name").distinct(), "normalized_name", "left_semi").groupBy("normalized_name").agg(best.alias("candidate_id"), F.max("evidence_count").alias("evidence_count"))


def similar_prefix(candidates: DataFrame, length: int = 5, limit: int = 10) -> DataFrame:
    """candidate_id, other_id, rank: proposed candidates whose names begin alike, the most evident first; a top-k report.

    Each candidate is compared with the ``limit`` + 1 most evident of its prefix only, so a prefix of any size costs rows times limit.
    """
    live = candidates.where("status = 'proposed' and normalized_name <> ''").select("candidate_id", "evidence_count", F.substring("normalized_name", 1, length).alias("prefix"))
    order = Window.partitionBy("prefix").orderBy(F.col("evidence_count").desc(), "candidate_id")
    top = live.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit + 1).select("prefix", F.col("candidate_id").alias("other_id"), F.col("evidence_count").alias("other_evidence"))
    pairs = live.select("candidate_id", "prefix").join(top, "prefix").where("candidate_id <> other_id")
    rank = F.row_number().over(Window.partitionBy("candidate_id").orderBy(F.col("other_evidence").desc(), "other_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= limit).select("candidate_id", "other_id", "rank")


def find_by_name(types: DataFrame, names: DataFrame) -> DataFrame:
    """name, type_id, via: active types called so by their name, else by an alias, without case and outer space."""
    active = types.where(~F.coalesce(F.col("status"), F.lit("")).isin(*INACTIVE))
    plain = lambda c: F.lower(F.trim(c))
    called = active.select("type_id", plain("canonical_name").alias("k"), F.lit(0).alias("via")).unionByName(active.select("type_id", F.explode("aliases").alias("a")).select("type_id", plain("a").alias("k"), F.lit(1).alias("via")))
    found = names.select("name", plain("name").alias("k")).distinct().join(called.where("k <> ''"), "k")
    return found.groupBy("name").agg(F.min(F.struct("via", "type_id")).alias("b")).select("name", "b.type_id", F.when(F.col("b.via") == 0, "name").otherwise("alias").alias("via"))


def united_aliases(target: Column, source_name: Column, source: Column) -> Column:
    """The target's aliases, the source's name, and the source's aliases that aren't among them in any case."""
    base = F.concat(F.coalesce(target, F.array().cast("array<string>")), F.array(source_name))
    return F.concat(base, F.filter(F.coalesce(source, F.array().cast("array<string>")), lambda a: ~F.exists(base, lambda b: F.lower(b) == F.lower(a))))


def merge(types: DataFrame, pairs: DataFrame) -> DataFrame:
    """The types after merging each source into its target (source_type_id, target_type_id; each source once).

    Aliases are united, evidence is summed, the source points to the target.  A pair of one type,
    or with an unknown or inactive side, changes nothing.
    """
    side = types.select("type_id", "canonical_name", "aliases", "evidence_count", "status")
    active = side.where(~F.coalesce(F.col("status"), F.lit("")).isin(*INACTIVE))
    good = pairs.where("source_type_id <> target_type_id").join(active.select(F.col("type_id").alias("source_type_id"), F.col("canonical_name").alias("sn"), F.col("aliases").alias("sa"), F.col("evidence_count").alias("se")), "source_type_id").join(active.select(F.col("type_id").alias("target_type_id")), "target_type_id")
    into = good.groupBy(F.col("target_type_id").alias("type_id")).agg(F.sum("se").alias("more"), F.array_sort(F.collect_list(F.struct("sn", "sa"))).alias("sources"))
    gone = good.select(F.col("source_type_id").alias("type_id"), F.col("target_type_id").alias("into"))
    rows = types.join(into, "type_id", "left").join(gone, "type_id", "left")
    aliases = F.aggregate("sources", F.coalesce("aliases", F.array().cast("array<string>")), lambda acc, s: united_aliases(acc, s["sn"], s["sa"]))
    return rows.withColumn("aliases", F.when(F.col("sources").isNotNull(), aliases).otherwise(F.col("aliases"))).withColumn("evidence_count", (F.col("evidence_count") + F.coalesce("more", F.lit(0))).cast("int")).withColumn("status", F.when(F.col("into").isNotNull(), "merged_into").otherwise(F.col("status"))).withColumn("merged_into_type_id", F.coalesce("into", "merged_into_type_id")).drop("more", "sources", "into")


def split(types: DataFrame, specs: DataFrame, keep_source: bool) -> DataFrame:
    """The types made by splitting: specs (source_type_id, name[, parent_type_id]), one row for each.

    A source that is unknown or inactive, or of whose names one is blank, given twice or taken,
    isn't split at all.  Kept sources become the parents; else the new types have the given parent or the source's.
    """
    named = specs if "parent_type_id" in specs.columns else specs.withColumn("parent_type_id", F.lit(None).cast("string"))
    named = named.select("source_type_id", "name", F.col("parent_type_id").alias("given"))
    taken = types.select(F.col("canonical_name").alias("name"), F.lit(True).alias("taken")).distinct()
    again = named.groupBy("name").agg((F.count(F.lit(1)) > 1).alias("again"))
    bad = named.join(taken, "name", "left").join(again, "name", "left").where("name is null or trim(name) = '' or taken or again").select("source_type_id").distinct()
    sources = types.where(~F.coalesce(F.col("status"), F.lit("")).isin(*INACTIVE)).select(F.col("type_id").alias("source_type_id"), "parent_type_id", "created_via")
    new = named.join(bad, "source_type_id", "left_anti").join(sources, "source_type_id")
    parent = F.col("source_type_id") if keep_source else F.coalesce("given", "parent_type_id")
    return new.select(derived_id("type", "name").alias("type_id"), F.col("name").alias("canonical_name"), parent.alias("parent_type_id"), F.lit("provisional").alias("status"), F.lit(0).alias("evidence_count"), "created_via", "source_type_id")


def after_split(types: DataFrame, specs: DataFrame, keep_source: bool) -> DataFrame:
    """All types after splitting: the new ones, and the sources deprecated unless they are kept."""
    new = split(types, specs, keep_source)
    gone = new.select(F.col("source_type_id").alias("type_id"), F.lit(not keep_source).alias("_gone")).distinct()
    rows = types.join(gone, "type_id", "left").withColumn("status", F.when(F.col("_gone"), "deprecated").otherwise(F.col("status"))).drop("_gone")
    return rows.unionByName(new.drop("source_type_id"), allowMissingColumns=True)


def redistributed(observations: DataFrame, types: DataFrame, assignment: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Observations and types after a split type's observations move: assignment (observation_id, type_id).

    Only observations of the source move, only to active types; each target's evidence grows by those it gets.
    """
    active = types.where(~F.coalesce(F.col("status"), F.lit("")).isin(*INACTIVE)).select(F.col("type_id").alias("_to"))
    goals = assignment.select("observation_id", F.col("type_id").alias("_to")).join(active, "_to", "left_semi").groupBy("observation_id").agg(F.min("_to").alias("_to"))
    rows = observations.join(goals, "observation_id", "left").withColumn("_to", F.when(F.col("stable_type_id") == source, F.col("_to")))
    moved = rows.where("_to is not null").groupBy(F.col("_to").alias("type_id")).agg(F.count_distinct("observation_id").alias("_more"))
    after = types.join(moved, "type_id", "left").withColumn("evidence_count", (F.col("evidence_count") + F.coalesce("_more", F.lit(0))).cast("int")).drop("_more")
    return rows.withColumn("stable_type_id", F.coalesce("_to", "stable_type_id")).drop("_to"), after


def deprecated(types: DataFrame, specs: DataFrame) -> DataFrame:
    """The types after deprecating those of specs (type_id, replacement_type_id or NULL; each type once), with ``moves_to`` where what refers to one moves.

    A type that is unknown or inactive, or whose replacement is itself, unknown, inactive or about
    to be deprecated too, stays as it is.  The replacement gets the evidence.
    """
    active = types.where(~F.coalesce(F.col("status"), F.lit("")).isin(*INACTIVE)).select("type_id")
    goals = active.join(specs.select("type_id"), "type_id", "left_anti").select(F.col("type_id").alias("replacement_type_id"), F.lit(True).alias("_ok"))
    good = specs.select("type_id", "replacement_type_id").join(active, "type_id", "left_semi").join(goals, "replacement_type_id", "left").where("replacement_type_id is null or _ok")
    more = good.join(types.select("type_id", "evidence_count"), "type_id").where("replacement_type_id is not null").groupBy(F.col("replacement_type_id").alias("type_id")).agg(F.sum("evidence_count").alias("_more"))
    rows = types.join(good.select("type_id", F.col("replacement_type_id").alias("moves_to"), F.lit(True).alias("_gone")), "type_id", "left").join(more, "type_id", "left")
    return rows.withColumn("status", F.when(F.col("_gone"), "deprecated").otherwise(F.col("status"))).withColumn("evidence_count", (F.col("evidence_count") + F.coalesce("_more", F.lit(0))).cast("int")).drop("_gone", "_more")


def recorded(candidates: DataFrame, proposals: DataFrame, name: str, order: str) -> DataFrame:
    """The candidates after proposals: the best live one of a normal name gets their number as evidence, a new name makes a candidate.

    Where several live candidates have one name the most evident counts, as in best_candidates.
    """
    new = candidates_of(proposals, name, order)
    best = best_candidates(candidates, new).select("normalized_name", F.col("candidate_id").alias("_best"))
    met = new.join(best, "normalized_name", "left")
    more = met.where("_best is not null").select(F.col("_best").alias("candidate_id"), F.col("evidence_count").alias("_more"))
    old = candidates.join(more, "candidate_id", "left").withColumn("evidence_count", (F.col("evidence_count") + F.coalesce("_more", F.lit(0))).cast("int")).drop("_more")
    fresh = met.where("_best is null").select("candidate_id", "proposed_name", "normalized_name", F.lit("proposed").alias("status"), F.col("evidence_count").cast("int").alias("evidence_count"))
    return old.unionByName(fresh, allowMissingColumns=True)


def types_named(types: DataFrame, names: DataFrame, created_via: str = "llm_proposed") -> DataFrame:
    """name, type_id, is_new for each different name: the type called exactly so, else one to make (get or create)."""
    own = types.groupBy(F.col("canonical_name").alias("name")).agg(F.min("type_id").alias("known"))
    rows = names.select("name").where("trim(name) <> ''").distinct().join(own, "name", "left")
    return rows.select("name", F.coalesce("known", derived_id("type", "name")).alias("type_id"), F.col("known").isNull().alias("is_new"), F.lit(created_via).alias("created_via"))


def backfilled(observations: DataFrame, promoted: DataFrame) -> DataFrame:
    """Observations without a stable type get that of their candidate (candidate_id, type_id)."""
    own = promoted.select(F.col("candidate_id").alias("candidate_type_id"), F.col("type_id").alias("_t"))
    return observations.join(own, "candidate_type_id", "left").withColumn("stable_type_id", F.coalesce("stable_type_id", "_t")).drop("_t")


def evolution(kind: str, source: str, target: str | None, reason: str, details: str) -> Column:
    """A row of type_evolution, as a struct; its id follows from what it says and when."""
    now = F.current_timestamp()
    return F.struct(derived_id("type_evolution", F.lit(kind), F.lit(source), F.lit(target or ""), now).alias("evolution_id"), F.lit(kind).alias("kind"), F.lit(source).alias("source_type_id"), F.lit(target).cast("string").alias("target_type_id"), F.lit(reason).alias("reason"), F.lit(details).alias("details"), now.alias("created_at"))


def repointed(rows: DataFrame, column: str, moves: DataFrame) -> DataFrame:
    """Rows with ``column`` moved by ``moves`` (old, new)."""
    return rows.join(moves.select(F.col("old").alias(column), F.col("new").alias("_new")), column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def alias_added(types: DataFrame, additions: DataFrame) -> DataFrame:
    """type_id, alias, outcome for each addition: added, not_found, inactive, exists or conflict (another type's name)."""
    plain = lambda c: F.lower(F.trim(c))
    named = types.groupBy(plain("canonical_name").alias("k")).agg(F.min("type_id").alias("owner"))
    rows = additions.select("type_id", "alias", plain("alias").alias("k")).join(types.select("type_id", "status", "aliases", F.lit(True).alias("known")), "type_id", "left").join(named, "k", "left")
    outcome = F.when(F.col("known").isNull(), "not_found").when(F.col("status").isin(*INACTIVE), "inactive").when(F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(F.trim(a)) == F.col("k")), "exists").when(F.col("owner").isNotNull(), "conflict").otherwise("added")
    return rows.select("type_id", "alias", outcome.alias("outcome"))


def alias_removed(types: DataFrame, removals: DataFrame) -> DataFrame:
    """The types without the aliases to remove (type_id, alias), compared without case and outer space."""
    gone = removals.groupBy("type_id").agg(F.collect_set(F.lower(F.trim("alias"))).alias("_gone"))
    left = F.filter("aliases", lambda a: ~F.array_contains(F.coalesce("_gone", F.array().cast("array<string>")), F.lower(F.trim(a))))
    return types.join(gone, "type_id", "left").withColumn("aliases", left).drop("_gone")


def candidates_merged(candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """The candidates after merging each source into its target (source_id, target_id); evidence is summed.

    A pair of one candidate, with an unknown side, or whose target is itself a source, changes
    nothing: the target must be the end of its chain.
    """
    side = candidates.select("candidate_id", "evidence_count")
    pairs = pairs.where("source_id <> target_id")
    good = pairs.join(side.select(F.col("candidate_id").alias("source_id"), F.col("evidence_count").alias("more")), "source_id").join(side.select(F.col("candidate_id").alias("target_id")), "target_id")
    good = good.join(pairs.select(F.col("source_id").alias("target_id")).distinct(), "target_id", "left_anti")
    into = good.groupBy(F.col("target_id").alias("candidate_id")).agg(F.sum("more").alias("_more"))
    gone = good.select(F.col("source_id").alias("candidate_id"), F.col("target_id").alias("_into"))
    rows = candidates.join(into, "candidate_id", "left").join(gone, "candidate_id", "left")
    return rows.withColumn("evidence_count", (F.col("evidence_count") + F.coalesce("_more", F.lit(0))).cast("int")).withColumn("status", F.when(F.col("_into").isNotNull(), "merged").otherwise(F.col("status"))).withColumn("merged_into_candidate_id", F.coalesce("_into", "merged_into_candidate_id")).drop("_more", "_into")
