"""Contents and observations: scan, hash, create if absent, skip what is known."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.media import affordances, probe_medium
from kinweave.functions.names import derived_id

#: Extensions of the files that a folder scan takes.
SCANNED = (
    "jpg", "jpeg", "png", "gif", "webp", "bmp", "tiff", "tif",
    "raw", "arw", "cr2", "cr3", "nef", "nrw", "orf", "rw2", "pef", "srw", "x3f", "raf", "dng", "dcr", "kdc", "mrw", "3fr", "mef", "mos", "erf", "rwl",
    "txt", "md", "rst", "csv",
    "json",
)


def scan_files(spark: SparkSession, path: str, recursive: bool = False, single: bool = False) -> DataFrame:
    """source_id, content of the files under a folder; a single path is taken whatever its extension.

    Other files are left out when the folder is listed, before any of their bytes are read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if not single:
        anycase = ("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in SCANNED)
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(anycase) + "}")
    return reader.load(path).select(F.col("path").alias("source_id"), "content")


def content_hash(content: Column | str) -> Column:
    return F.sha2(F.col(content) if isinstance(content, str) else content, 256)


def blobs_of(contents: DataFrame, content: str = "content", source: str = "source_id", order: str = "ingest_seq") -> DataFrame:
    """One blob of each different content: blob_id, sha256, size_bytes, storage_path of its first source.

    Combined before the shuffle, so that any number of copies of one content costs one row of each task.
    """
    hashed = contents.where(F.col(content).isNotNull()).select(content_hash(content).alias("sha256"), F.octet_length(content).cast("long").alias("size_bytes"), F.col(source).alias("storage_path"), F.col(order).alias("_order"))
    first = hashed.groupBy("sha256").agg(F.min(F.struct("_order", "storage_path", "size_bytes")).alias("f"), F.count(F.lit(1)).alias("copies"))
    return first.select(derived_id("blob", "sha256").alias("blob_id"), "sha256", "f.size_bytes", "f.storage_path", "copies")


def new_blobs(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """The candidates whose content isn't known yet."""
    return candidates.join(known.select("sha256"), "sha256", "left_anti")


def new_observations(incoming: DataFrame, known: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """Rows of ``incoming`` (blob_id, source_id, ...) whose content at that source is new; of equal ones the first.

    The same content elsewhere is a new observation of the shared blob, NULL sources are one.  ``order`` differs from row
    to row.  Only the keys are grouped; the rows, which may carry contents, are met by order after.
    """
    keys = ["blob_id", "source_id"]
    same = lambda *columns: reduce(lambda x, y: x & y, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns))
    firsts = incoming.groupBy(*keys).agg(F.min(order).alias(order)).alias("a").join(known.select(*keys).alias("b"), same(*keys), "left_anti")
    return incoming.alias("a").join(firsts.alias("b"), same(*keys, order), "left_semi")


def probed(contents: DataFrame, content: str = "content", source: str = "source_id") -> DataFrame:
    """Adds medium and affordances."""
    return contents.withColumn("medium", probe_medium(content, source)).withColumn("affordances", affordances("medium"))
