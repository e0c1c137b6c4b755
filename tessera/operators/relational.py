"""Operators over relations that Spark has in no single call."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import materialise


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows in a total order: partial top-k in each partition, then a merge."""
    return df.orderBy(*order).limit(k)


def top_per_key(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each key; Spark limits each group before its shuffle."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("__rank") <= k).drop("__rank")


def dedupe(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key, the first in the given order."""
    return top_per_key(df, keys, 1, *order)


def exists_all(df: DataFrame, events: DataFrame, key: str, conditions: list[Column]) -> DataFrame:
    """Rows of df for which each condition holds for some event of the same key.

    One conditional aggregation over the events and one semi join stand for a semi join a condition.
    """
    flags = [F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(f"__c{k}") for k, c in enumerate(conditions)]
    wanted = reduce(lambda a, b: a | b, conditions)
    held = events.where(wanted).groupBy(key).agg(*flags)
    for k in range(len(conditions)):
        held = held.where(F.col(f"__c{k}") == 1)
    return df.join(held.select(key), key, "left_semi")


def row_numbers(df: DataFrame, *order: str, name: str = "row_number") -> DataFrame:
    """1-based numbers in a global order, without moving all rows to one task.

    Rows are range-partitioned and sorted; each partition's count gives the next one's start.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    numbered = materialise(ranged.withColumn("__p", F.spark_partition_id()).withColumn("__k", F.monotonically_increasing_id()), "row-numbers")
    counts = numbered.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"), F.min("__k").alias("__first"))
    # one row a partition
    starts = counts.withColumn("__before", F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).select("__p", "__first", "__before")
    out = numbered.join(F.broadcast(starts), "__p")
    return out.withColumn(name, F.col("__before") + F.col("__k") - F.col("__first") + 1).drop("__p", "__k", "__first", "__before")


def split_by_position(df: DataFrame, share: float, *order: str) -> tuple[DataFrame, DataFrame]:
    """The first ``share`` of the rows in a global order, and the rest."""
    numbered = row_numbers(df, *order, name="__row")
    edge = int(df.count() * share)
    return numbered.where(F.col("__row") <= edge).drop("__row"), numbered.where(F.col("__row") > edge).drop("__row")


def min_max(df: DataFrame, column: str, name: str, least_range: float = 1e-6) -> DataFrame:
    """``column`` scaled to 0..1 over the whole frame; a range of 0 counts as ``least_range``."""
    ends = df.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    spread = F.when(F.col("__hi") == F.col("__lo"), F.lit(least_range)).otherwise(F.col("__hi") - F.col("__lo"))
    return df.crossJoin(F.broadcast(ends)).withColumn(name, (F.col(column) - F.col("__lo")) / spread).drop("__lo", "__hi")
