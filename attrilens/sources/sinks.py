"""Sinks: tables, request files, resumable appends, rendered reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import format_percent
from .scans import as_written


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Columns in a fixed order, null as blank."""
    df.select(*[as_written(F.col(c)).alias(c) for c in columns]).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose keys are not done."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def append_pending(work: DataFrame, path: str, keys: list[str], process) -> None:
    """K2, K3, K7, K8: process what is not in the table yet and append it; a failed run resumes here."""
    spark = work.sparkSession
    try:
        done = spark.read.parquet(path)
    except Exception as e:  # the table starts with the first append
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = None
    todo = work if done is None else pending(work, done, keys)
    process(todo).write.mode("append").parquet(path)


def completed_prefix(results: DataFrame, index: str = "idx") -> DataFrame:
    """K7: the rows before the first missing index, for checkpoints of ordered work."""
    have = results.select(index).distinct()
    gap = have.select((F.col(index) + 1).alias(index)).join(have, index, "left_anti").agg(F.min(index).alias("stop"))
    starts = have.agg((F.min(index) == 0).alias("from_zero"))
    stop = gap.first()["stop"] if starts.first()["from_zero"] else 0
    return results.where(F.col(index) < F.lit(stop))


def request_lines(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """K4: one JSON document a row, as column value."""
    return df.select(F.to_json(F.struct(*(columns or df.columns))).alias("value"))


def write_text(lines: DataFrame, path: str) -> None:
    """K4: request lines (column value) as a text file."""
    lines.select("value").write.mode("overwrite").text(path)


def write_lines(df: DataFrame, path: str) -> None:
    write_text(request_lines(df), path)


def write_json(spark: SparkSession, path: str, payload: dict) -> None:
    """K5"""
    spark.createDataFrame([(json.dumps(payload, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_vectors(df: DataFrame, path: str) -> None:
    """K6"""
    df.select("hash", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("append").parquet(path)


def write_shards(df: DataFrame, path: str, order: str, rows_per_shard: int) -> None:
    """Files of at most so many rows, in order."""
    df.withColumn("shard", F.floor(F.col(order) / rows_per_shard).cast("int")).repartition("shard").sortWithinPartitions("shard", order).write.mode("overwrite").partitionBy("shard").option("header", True).csv(path)


def fingerprint(paths: DataFrame, version: str) -> DataFrame:
    """A key for cached results from path, time, size and version."""
    return paths.select("path", F.sha1(F.to_json(F.struct("path", F.col("modificationTime").cast("string").alias("time"), "length", F.lit(version).alias("version")))).alias("cache_key"))


def markdown_table(df: DataFrame, percents: tuple[str, ...] = (), limit: int = 2000) -> str:
    """K9: a report table of at most limit rows as Markdown, rendered on the driver; larger tables are an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report table has at most {limit} rows")
    cell = lambda r, c: format_percent(r[c]) if c in percents else "" if r[c] is None else str(r[c])
    head = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join(cell(r, c) for c in df.columns) + " |" for r in rows])


def text_report(sections: list[tuple[str, DataFrame]], limit: int = 200) -> str:
    """Titled sections of small aggregates."""
    return "\n\n".join(f"{title}\n{'=' * len(title)}\n{markdown_table(df, limit=limit)}" for title, df in sections)


def versioned(path: str, version: str) -> str:
    """A fresh place for each run instead of moving earlier output away."""
    return f"{path.rstrip('/')}/run={version}"
