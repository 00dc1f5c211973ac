"""Contents as they arrive: each batch is hashed, skipped if known, probed, and its identifiers are linked.

What is known is keyed state: a content, an observation and an identifier are a key each, whose
first sighting passes and whose later ones are dropped, by a state store on disk that is
partitioned by key and checkpointed.  So a batch costs what it brings, however much came before.
The results are a folder of tables; a batch writes under its own number and replaces itself if it
is run again, so a broken run goes on without doubles; readers take all batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.documents import json_features
from kinweave.functions.names import derived_id
from kinweave.operators.extraction import namespaced
from kinweave.operators.identifiers import KEY, normalized, resolve_ids
from kinweave.operators.ingest import blobs_of, content_hash, new_blobs, new_observations
from kinweave.operators.world import SCHEMAS

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
TABLES = ("blobs", "observations", "bindings", "links")
_STATE = {
    "blobs": "blob_id string, sha256 string, size_bytes long, storage_path string, copies long",
    "observations": "observation_id string, blob_id string, source_id string, ingest_seq long",
    "bindings": "id_type string, id_value string, id_namespace string, entity_id string, name string, status string, confidence double",
    "links": SCHEMAS["observation_entity_links"] + ", id_type string, id_value string, id_namespace string",
}


def state(spark: SparkSession, folder: str, name: str, before: int | None = None) -> DataFrame:
    """A table of the state, of the batches before one, or of all."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _STATE[name])
    rows = spark.read.schema(_STATE[name] + ", batch long").parquet(f"{folder}/{name}")
    return (rows if before is None else rows.where(F.col("batch") < before)).drop("batch")


def ingest_batch(batch: DataFrame, known: dict[str, DataFrame], context: str = "source:stream") -> dict[str, DataFrame]:
    """The new rows of each table for a batch (source_id, content text, ingest_seq), given all that is known; rows without content are left out."""
    batch = batch.where("content is not null")
    blobs = blobs_of(batch, "content")
    rows = batch.select("source_id", "ingest_seq", "content", derived_id("blob", content_hash("content")).alias("blob_id"))
    fresh = new_observations(rows, known["observations"]).withColumn("observation_id", derived_id("observation", "blob_id", "source_id"))
    ids = fresh.select("observation_id", json_features("content").alias("f")).select("observation_id", F.explode("f.ids").alias("i")).select("observation_id", "i.*").withColumn("strength", F.lit("strong"))
    links, bindings = resolve_ids(normalized(ids, F.lit(context)).select("observation_id", *KEY, "strength").distinct(), known["bindings"])
    return {"blobs": new_blobs(blobs, known["blobs"]).select("blob_id", "sha256", "size_bytes", "storage_path", "copies"), "observations": fresh.select("observation_id", "blob_id", "source_id", "ingest_seq"), "bindings": bindings, "links": links}


def _sightings(stream: DataFrame, context: str) -> DataFrame:
    """kind, key and what is known of it, for the content, the observation and each identifier of every row; JSON is parsed once."""
    rows = stream.where("content is not null").select("source_id", "ingest_seq", content_hash("content").alias("sha256"), F.octet_length("content").cast("long").alias("size_bytes"), json_features("content")["ids"].alias("ids"))
    ids = F.array_distinct(namespaced(F.col("ids"), F.lit(context)))
    rows = rows.select("source_id", "ingest_seq", "sha256", "size_bytes", ids.alias("ids"), derived_id("blob", "sha256").alias("blob_id")).withColumn("observation_id", derived_id("observation", "blob_id", "source_id"))
    none = F.array().cast("array<struct<id_type:string,id_value:string,id_namespace:string>>")
    seen = lambda kind, key, ids: F.struct(F.lit(kind).alias("kind"), key.alias("key"), ids.alias("ids"))
    keys = F.concat(F.array(seen("blob", F.col("blob_id"), none), seen("observation", F.col("observation_id"), F.col("ids"))), F.transform("ids", lambda i: seen("binding", derived_id("entity", *(i[k] for k in KEY)), F.array(i))))
    return rows.select("source_id", "ingest_seq", "sha256", "size_bytes", "blob_id", F.explode(keys).alias("s")).select("s.kind", "s.key", "s.ids", "source_id", "ingest_seq", "sha256", "size_bytes", "blob_id")


def _first_rows(new: DataFrame) -> dict[str, DataFrame]:
    """The rows of each table for the first sightings of a batch."""
    own = lambda kind: new.where(F.col("kind") == kind)
    bindings = own("binding").select(F.explode("ids").alias("i"), F.col("key").alias("entity_id")).select("i.*", "entity_id", F.concat_ws(":", "i.id_type", "i.id_value").alias("name"), F.lit("proto").alias("status"), F.lit(1.0).alias("confidence"))
    each = own("observation").select(F.col("key").alias("observation_id"), F.explode("ids").alias("i")).select("observation_id", "i.*")
    links = each.join(bindings.select(*KEY, F.lit(True).alias("made")), list(KEY), "left")
    flags = F.array_compact(F.array(F.lit("from_observation_det_id"), F.when(F.col("made"), "entity_created")))
    return {
        "blobs": own("blob").select(F.col("key").alias("blob_id"), "sha256", "size_bytes", F.col("source_id").alias("storage_path"), F.lit(1).cast("long").alias("copies")),
        "observations": own("observation").select(F.col("key").alias("observation_id"), "blob_id", "source_id", "ingest_seq"),
        "bindings": bindings,
        "links": links.select("observation_id", derived_id("entity", *KEY).alias("entity_id"), F.lit(1.0).alias("posterior"), F.lit("hard").alias("status"), F.lit("subject").alias("role"), flags.alias("flags"), *KEY),
    }


def run(stream: DataFrame, folder: str, checkpoint: str, context: str = "source:stream") -> None:
    """Ingests all that a stream (source_id, content, ingest_seq) holds, then stops; later runs go on from there.

    Rows without content are left out.  Of equal keys in one batch any row may be the first; their ids are the same.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        first = f"{folder}/sightings/batch={number}"
        batch.write.mode("overwrite").parquet(first)
        for name, rows in _first_rows(spark.read.schema(batch.schema).parquet(first)).items():
            rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        news = _sightings(stream, context).dropDuplicates(["kind", "key"])
        news.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, end, events of each session, for a batch or a stream.

    A stream's sessions come out once the watermark has passed their end; later events than
    ``late`` are dropped.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    sessions = rows.where("user_id is not null and ts is not null").groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return sessions.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
