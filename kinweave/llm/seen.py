"""Has this key been seen before?

A streaming aggregation holds one entry for each key, its lowest order of arrival, in RocksDB
state that is partitioned by key, kept on disk and checkpointed to the shared folder.  There is
no watermark, so nothing expires.  Tasks combine the rows of a key before the shuffle: a key
that a third of all rows carry reaches its state as one row from each task.  The stream's
output is, for each key that a batch touched, the order of its first sighting; a row whose own
order isn't among these is a repeat.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.storage import Scratch

#: Bytes of SHA-256 kept of each key.
KEY_BYTES = 16
#: Settings of the state store, for the time of a run.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
    "spark.sql.streaming.metricsEnabled": "false",
}

_OUTER = r"^\s+|\s+$"


def _trimmed(column: str) -> Column:
    return F.regexp_replace(F.col(column), _OUTER, "")


def blob_key(sha256: str = "sha256") -> Column:
    """The digest in lower case without outer white space and ``sha256:``; NULL if blank."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(_trimmed(sha256)), "^sha256:", ""), _OUTER, "")
    return F.when(plain != "", plain)


def identifier_key(id_type: str = "id_type", id_value: str = "id_value", id_namespace: str = "id_namespace") -> Column:
    """Type and namespace in lower case and trimmed (NULL equals ''), the trimmed value as it is; NULL if the value is blank."""
    value = _trimmed(id_value)
    parts = [F.coalesce(F.lower(_trimmed(id_type)), F.lit("")), F.coalesce(F.lower(_trimmed(id_namespace)), F.lit("")), value]
    # Each part is preceded by its length, so that no two triples give one string.
    return F.when(value != "", F.concat_ws("|", *(F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts)))


def digest(key: Column) -> Column:
    return F.substring(F.unhex(F.sha2(key, 256)), 1, KEY_BYTES)


def wrong_answer_bound(keys: int) -> float:
    """The chance that any of ``keys`` different keys is taken for another: at most n^2 / 2^(bits + 1)."""
    return min(1.0, float(keys) ** 2 / 2.0 ** (8 * KEY_BYTES + 1))


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def keyed(df: DataFrame, tbl: str, key: Column, order: str = "ingest_seq") -> DataFrame:
    """tbl, key, seq of the rows that have a key and an order."""
    return df.select(F.lit(tbl).alias("tbl"), digest(key).alias("key"), F.col(order).cast("long").alias("seq")).where("key is not null and seq is not null")


def first_sightings(stream: DataFrame, scratch: Scratch, name: str = "seen", on_batch: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Runs the stream (tbl, key, seq) over all that its sources hold; tbl, key, seq of the first sighting of each key.

    The checkpoint under ``scratch`` lets a broken run, or a later one with new files, go on from
    where the last one ended.  Batches may come in any order: the state keeps the lowest order,
    and a key whose first sighting changes later comes out once, with the lowest.  ``on_batch``
    gets the first sightings that a batch touched: with them ``repeats`` tells the batch's own rows
    apart, without reading earlier ones.
    """
    spark, out, state = scratch.spark, scratch.path(f"{name}-firsts"), scratch.path(f"{name}-state")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a batch that is run again replaces itself
        if on_batch:
            on_batch(batch, number)

    firsts = stream.groupBy("tbl", "key").agg(F.min("seq").alias("seq"))
    with _settings(spark, STATE):
        query = firsts.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", state).foreachBatch(write).start()
        query.awaitTermination()
    try:
        log = spark.read.parquet(out)
    except Exception as e:  # no batch: the sources were empty
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], firsts.schema)
    if log.select("batch").distinct().count() > 1:
        return log.groupBy("tbl", "key").agg(F.min("seq").alias("seq"))
    return log.drop("batch")


def repeats(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """tbl, seq of the rows (see keyed) that aren't the first sighting of their key.

    Joined by the row's own order, which no two rows share, so that frequent keys don't meet.
    """
    return rows.select("tbl", "seq").join(firsts.select("tbl", "seq"), ["tbl", "seq"], "left_anti")


def rates(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """tbl, keyed_rows, first_rows, repeat_rows, wrong_rate of each table.

    Each state entry stands for one key, so the only wrong answers are digests shared by two keys;
    ``wrong_rate`` bounds their chance.
    """
    total = rows.groupBy("tbl").agg(F.count(F.lit(1)).alias("keyed_rows"))
    first = firsts.groupBy("tbl").agg(F.count(F.lit(1)).alias("first_rows"))
    n = F.coalesce("first_rows", F.lit(0))
    return total.join(first, "tbl", "left").select("tbl", "keyed_rows", n.alias("first_rows"), (F.col("keyed_rows") - n).alias("repeat_rows"), F.least(F.lit(1.0), F.pow(n.cast("double"), F.lit(2.0)) / F.lit(2.0 ** (8 * KEY_BYTES + 1))).alias("wrong_rate"))
