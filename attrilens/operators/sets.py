"""Set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import keep_first


def union_all(*frames: DataFrame) -> DataFrame:
    """By name, missing columns as null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_distinct(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of the first table win."""
    both = union_all(a.withColumn("_from", F.lit(0)), b.withColumn("_from", F.lit(1)))
    return keep_first(both, [key], "_from").drop("_from")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """U4 over rows"""
    return a.exceptAll(b)


def drop_repeats(rows: DataFrame, subset: list[str]) -> DataFrame:
    """U5"""
    return rows.dropDuplicates([c for c in subset if c in rows.columns])


def ordered_unique(rows: DataFrame, column: str, order: str) -> DataFrame:
    """U6"""
    return rows.groupBy(column).agg(F.min(order).alias(order)).orderBy(order)
