"""Merge chains: the record that each record was merged into in the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.hierarchy import chain_ends
from kinweave.storage import Scratch


def canonical(records: DataFrame, key: str, pointer: str, scratch: Scratch) -> DataFrame:
    """id, root, steps of each record; the walk ends at the last record that exists.

    On a chain that runs into a loop: root NULL and steps -1.  Blank pointers end a chain.
    Chains of any length take a number of joins that grows with its logarithm.
    """
    links = records.select(F.lit("chain").alias("tree"), F.col(key).alias("id"), F.when(F.trim(pointer) != "", F.trim(pointer)).alias("parent"))
    return chain_ends(links, scratch).select("id", "root", "steps")


def compressed(records: DataFrame, chains: DataFrame, key: str, pointer: str) -> DataFrame:
    """The records with every pointer of two or more steps moved to the end of its chain; loops keep theirs."""
    ends = chains.where("steps > 1").select(F.col("id").alias(key), F.col("root").alias("_root"))
    return records.join(ends, key, "left").withColumn(pointer, F.coalesce("_root", pointer)).drop("_root")


def strict(chains: DataFrame) -> DataFrame:
    """Chains that end; callers that may not go on with a loop take these."""
    return chains.where("root is not null")
