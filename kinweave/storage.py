"""Tables that cut a lineage, written to the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHARED = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder.  Where none is named, a local session gets one of its own; a cluster has to name one."""
    folder = spark.conf.get(SHARED, None) or spark.sparkContext.getConf().get(SHARED)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set {SHARED} to a folder that all executors of {master} share")
        folder = "file://" + tempfile.mkdtemp(prefix="kinweave-")
        spark.conf.set(SHARED, folder)
    return folder.rstrip("/")


class Scratch:
    """Intermediate tables of one run, each written once and read back from the shared folder.

    A written table outlives any executor, so a lost one costs only its running tasks.  All of
    them go when the driver ends, as results may read them until then; see ``drop`` and ``clear``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}".rstrip("/")

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.load(name, df)

    def load(self, name: str, like: DataFrame | None = None, *more: str) -> DataFrame:
        """A table, or several of one schema read as one."""
        reader = self.spark.read if like is None else self.spark.read.schema(like.schema)
        return reader.parquet(self.path(name), *map(self.path, more))

    def drop(self, *names: str) -> None:
        """Frees the disk of tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)

    def collect(self) -> None:
        """Frees the disk of shuffles that no plan needs any more, which else wait until the driver happens to collect its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def clear(self) -> None:
        """Frees all of them, once the result that reads them is stored elsewhere."""
        self.drop("")
