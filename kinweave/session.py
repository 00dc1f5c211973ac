"""The session that tests, the benchmark and small runs use; a cluster brings its own."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that the plans rely on; none of them depends on the machine.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 4, app: str = "kinweave", **more: str) -> SparkSession:
    """A local session; ``more`` overrides settings (dots written as double underscores)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = SETTINGS | {"spark.sql.shuffle.partitions": str(cores), "spark.driver.memory": "6g", "spark.driver.host": "127.0.0.1"}
    for key, value in (settings | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
