"""Helpers shared by the corpus operators: table access, lineage cuts, checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.sources.scratch import keep, shared_dir, short_batches

__all__ = ["BROADCAST_ROWS", "ascii_lower", "keep", "shared_dir", "short_batches", "shuffle_partitions", "small", "table"]

#: Rows of at most some thirty bytes each: the largest side that is ever broadcast has some 3 MB.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is counted to have ``most`` rows at most, else as it is (a shuffle join follows)."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= most else df


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
