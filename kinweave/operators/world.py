"""The read surface: totals, links of entities, matrices, searches and look-ups by the start of an id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tables of a world, with their columns.
SCHEMAS = {
    "blobs": "blob_id string, sha256 string, size_bytes long, storage_path string, created_at timestamp",
    "observations": "observation_id string, medium string, source_id string, blob_id string, observation_kind string, slots map<string,string>, facets map<string,string>, deterministic_ids array<struct<id_type:string,id_value:string,id_namespace:string>>, candidate_type_id string, stable_type_id string, status string, created_at timestamp",
    "observation_entity_links": "observation_id string, entity_id string, posterior double, status string, role string, flags array<string>",
    "signatures": "signature_id string, observation_id string, signature_type string, hash_value string, text_embedding array<float>, image_embedding array<float>, clip_text_embedding array<float>, extra string",
    "entities": "entity_id string, type_id string, entity_nature string, name string, canonical_entity_id string, status string, confidence double, slots map<string,struct<kind:string,value_str:string,value_num:double,unit:string,ref_entity_id:string,ref_type:string,ref_name:string,ref_nature:string,items:array<string>>>, prototype_image_embedding array<float>, prototype_text_embedding array<float>, prototype_count int",
    "entity_deterministic_ids": "id string, entity_id string, id_type string, id_value string, id_namespace string, confidence double",
    "entity_evolutions": "evolution_id string, kind string, entity_id string, observation_id string, score double, threshold double, version string",
    "identity_conflicts": "conflict_id string, id_type string, id_value string, id_namespace string, first_entity string, last_entity string, status string",
    "event_participants": "event_id string, participant_id string, observation_id string, role string, confidence double",
    "evidence": "evidence_id string, subject_kind string, subject_id string, predicate string, target_id string, source string, score double, details string",
    "type_candidates": "candidate_id string, proposed_name string, normalized_name string, status string, merged_into_candidate_id string, evidence_count int, coherence_score double, created_at timestamp, updated_at timestamp",
    "types": "type_id string, canonical_name string, aliases array<string>, parent_type_id string, embedding array<float>, status string, merged_into_type_id string, evidence_count int, created_via string, created_at timestamp",
    "type_evolution": "evolution_id string, kind string, source_type_id string, target_type_id string, reason string, details string, created_at timestamp",
}


def init_world(spark: SparkSession, folder: str, reset: bool = False) -> list[str]:
    """Writes the tables that aren't there yet, empty; ``reset`` empties all. The names of those written."""
    written = []
    for name, schema in SCHEMAS.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        if reset or not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
            written.append(name)
    return written


def replace(spark: SparkSession, folder: str, name: str, df: DataFrame) -> None:
    """Puts a table in the place of the one that it may have been made from: written beside it, then renamed."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    new, old = f"{folder}/{name}.parquet.new", f"{folder}/{name}.parquet"
    df.write.mode("overwrite").parquet(new)
    files = hadoop.Path(old).getFileSystem(conf)
    files.delete(hadoop.Path(old), True)
    if not files.rename(hadoop.Path(new), hadoop.Path(old)):
        raise OSError(f"{new} can't be renamed to {old}")
    spark.catalog.refreshByPath(old)


def fetch(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose ``key`` is among ``wanted`` (a column of that name)."""
    return rows.join(wanted.select(key), key, "left_semi")


def counts(df: DataFrame, column: str) -> DataFrame:
    """The rows of each value and, with the value NULL and is_total 1, of all: one pass."""
    return df.rollup(column).agg(F.grouping(column).alias("is_total"), F.count(F.lit(1)).alias("n"))


def links_per_entity(links: DataFrame, least: int = 1) -> DataFrame:
    """entity_id, observations, hard_links of the entities with at least ``least`` observations."""
    return links.groupBy("entity_id").agg(F.count_distinct("observation_id").alias("observations"), F.sum((F.col("status") == "hard").cast("long")).alias("hard_links")).where(F.col("observations") >= least)


def shared_entities(links: DataFrame, entities: DataFrame, least: int = 2) -> DataFrame:
    """Entities of several observations whose name isn't that of a serial number or unique id."""
    technical = F.lower(F.coalesce("name", F.lit(""))).rlike("serial|unique_id")
    return links_per_entity(links, least).join(entities.select("entity_id", "name").where(~technical), "entity_id")


def link_matrix(links: DataFrame, observations: list[str]) -> DataFrame:
    """A row for each entity and a column for each of the listed observations: ``role/status posterior``."""
    cell = F.concat(F.col("role"), F.lit("/"), F.col("status"), F.lit(" "), F.format_number("posterior", 2))
    return links.where(F.col("observation_id").isin(observations)).groupBy("entity_id").pivot("observation_id", observations).agg(F.min(cell))


def by_nature(entities: DataFrame) -> DataFrame:
    """entity_id, nature, nature_rank, name; shown in the order of nature_rank, name and entity_id."""
    natures = ("event", "individual", "class", "group")
    nature = F.coalesce("entity_nature", F.lit("unknown"))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, natures)), nature), F.lit(0))
    return entities.select("entity_id", nature.alias("nature"), F.when(rank == 0, len(natures) + 1).otherwise(rank).cast("int").alias("nature_rank"), F.col("name"))


def search_sources(observations: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """The first ``limit`` observations, by source, whose source holds the text in any case."""
    return observations.where(F.col("source_id").ilike(f"%{query}%")).orderBy("source_id", "observation_id").limit(limit)


def by_id_start(rows: DataFrame, key: str, starts: DataFrame) -> DataFrame:
    """start, key, outcome for each start of an id: found, not_found, or ambiguous with the smallest of several ids."""
    length = F.length("start")
    lengths = starts.where("start <> ''").select("start", length.alias("n")).distinct()
    # An equi-join for each length of start, of which there are no more than an id has characters; longer starts begin none.
    keys = rows.select(F.col(key).alias("k")).distinct()
    longest = rows.agg(F.max(F.length(key))).first()[0] or 0
    sizes = [r[0] for r in lengths.select("n").distinct().where(F.col("n") <= longest).collect()]
    cut = keys.select("k", F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.substring("k", 1, n).alias("start")) for n in sizes)) if sizes else F.array(F.struct(F.lit(0).alias("n"), F.lit("").alias("start")))).alias("c")).select("k", "c.n", "c.start")
    hits = lengths.join(cut, ["start", "n"]).groupBy("start").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("hits"))
    return lengths.select("start").join(hits, "start", "left").select("start", F.col("k").alias(key), F.when(F.col("hits").isNull(), "not_found").when(F.col("hits") > 1, "ambiguous").otherwise("found").alias("outcome"))


def review(candidates: DataFrame, status: str | None = None, limit: int = 20) -> DataFrame:
    """The most evident candidates, of one status if given; ties by id."""
    rows = candidates.where(F.col("status") == status) if status else candidates
    return rows.orderBy(F.col("evidence_count").desc(), "candidate_id").limit(limit)


def history(evolution: DataFrame, type_id: str, limit: int = 20) -> DataFrame:
    """The newest changes that a type took part in on either side."""
    return evolution.where((F.col("source_type_id") == type_id) | (F.col("target_type_id") == type_id)).orderBy(F.col("created_at").desc(), "evolution_id").limit(limit)


def show(kind: str, identifier: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A record and what belongs to it, as one table each: kind is observation, entity, event or type."""
    key = {"observation": "observation_id", "entity": "entity_id", "event": "entity_id", "type": "type_id"}[kind]
    home = {"observation": "observations", "entity": "entities", "event": "entities", "type": "types"}[kind]
    out = {home: tables[home].where(F.col(key) == identifier)}
    for name, df in tables.items():
        columns = [c for c in ([key] if kind != "event" else [key, "event_id"]) if c in df.columns]
        if kind == "type":
            columns = [c for c in ("stable_type_id", "type_id", "source_type_id", "target_type_id") if c in df.columns]
        if name != home and columns:
            out[name] = df.where(reduce(lambda a, b: a | b, (F.col(c) == F.lit(identifier) for c in columns)))
    return out
