"""Readers of the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def current_rows(df: DataFrame, key: str, *columns: str | Column, order: str = "ingest_seq") -> DataFrame:
    """One row for each ``key``: ``columns`` of its row with the highest ``order``.

    An aggregation, so that older versions and redelivered copies are combined before the
    shuffle, however many rows a single id has.  Rows without a key are dropped, rows without
    an order come before all others.
    """
    picked = F.struct(*columns)
    latest = F.max_by(picked, F.coalesce(F.col(order), F.lit(-(1 << 62))))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(latest.alias("_row")).select(key, "_row.*")
