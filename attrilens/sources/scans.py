"""Scans of the files that the pipeline's stages exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import nested, text


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with quoted, multi-line text and doubled quotes; blanks as null."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "").option("emptyValue", "")
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def csv_tolerant(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """S3: rows that do not fit the schema are left out."""
    return spark.read.option("header", header).option("multiLine", True).option("escape", '"').option("mode", "DROPMALFORMED").schema(schema).csv(path)


def dirty_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) with NUL bytes dropped and bad UTF-8 replaced; line_no orders the lines of a file.

    Files are read by line, so large ones split.
    """
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
    clean = F.replace(F.expr("make_valid_utf8(value)"), F.lit("\x00"), F.lit(""))
    return lines.select(F.col("file_path").alias("path"), F.struct(F.col("file_block_start").alias("block"), "n").alias("line_no"), clean.alias("line"))


def with_index(df: DataFrame, name: str = "_idx") -> DataFrame:
    """An explicit row order in file order, from 0: rows are numbered within partitions, whose sizes are counted first."""
    marked = df.withColumn(name, F.monotonically_increasing_id())
    place = F.shiftright(name, 33).cast("int")
    # One number a partition.
    sizes = {r["p"]: r["n"] for r in marked.groupBy(place.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, at = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(at)
        at += sizes.get(p, 0)
    start = F.get(F.array(*[F.lit(x).cast("long") for x in before or [0]]), place)
    return marked.withColumn(name, start + F.col(name).bitwiseAND(F.lit((1 << 33) - 1)))


def require_columns(df: DataFrame, columns: list[str]) -> None:
    """Fail on columns that are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def pick_populated(df: DataFrame, candidates: list[str]) -> str | None:
    """The first candidate with any non-blank value, else the first that exists; one pass."""
    there = [c for c in candidates if c in df.columns]
    if not there:
        return None
    row = df.agg(*[F.max(F.length(text.strip(F.col(c).cast("string")))).alias(c) for c in there]).first()
    return next((c for c in there if (row[c] or 0) > 0), there[0])


def resolved(df: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Columns under their canonical names."""
    out = {k: pick_populated(df, v) for k, v in names.items()}
    return df.select("*", *[F.col(v).alias(k) for k, v in out.items() if v and v != k and k not in df.columns])


def dataset(df: DataFrame, order: str, smoke_rows: int | None = None) -> DataFrame:
    """Rows with a quote_id (their position where it is missing), head by order."""
    if "quote_id" not in df.columns:
        df = df.withColumn("quote_id", F.col(order).cast("string"))
    return df.orderBy(order).limit(smoke_rows) if smoke_rows else df


def fame_cache(rows: DataFrame, order: str) -> DataFrame:
    """Successful rows, the last of each author."""
    hits = F.expr("try_cast(try_cast(google_hits as double) as bigint)")
    good = rows.where(text.strict_true(F.col("success"))).withColumn("google_hits", F.when(text.cell(F.col("google_hits")) == "", F.lit(0)).otherwise(hits)).where("google_hits is not null")
    last = good.groupBy(text.cell(F.col("author")).alias("author")).agg(F.max_by(F.struct("google_hits", "timestamp"), order).alias("x"))
    return last.select("author", "x.google_hits", "x.timestamp")


def unique_sorted(rows: DataFrame, column: str) -> DataFrame:
    """S6"""
    return rows.select(text.strip(F.col(column)).alias(column)).where(F.length(column) > 0).distinct().orderBy(column)


def unique_first_seen(rows: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct values in order of first appearance."""
    return rows.select(text.strip(F.col(column)).alias(column), order).where(F.length(column) > 0).groupBy(column).agg(F.min(order).alias("first_seen")).orderBy("first_seen")


def reference_hits(rows: DataFrame, order: str) -> DataFrame:
    """Success and a count; the first row of each author."""
    good = rows.where(text.safe_bool(F.col("success")) & F.col("google_hits").isNotNull())
    return good.groupBy("author").agg(F.min_by("google_hits", order).alias("google_hits"))


def batch_results(lines: DataFrame) -> DataFrame:
    """One row for each line of a batch result file; column value holds the line."""
    x = F.from_json("value", nested.BATCH_LINE)
    body = F.get_json_object("value", "$.response.body")
    return lines.select(
        x["custom_id"].alias("custom_id"),
        nested.output_text(x["response"]["body"]).alias("llm_output"),
        nested.error_text(F.get_json_object("value", "$.error"), x["response"]["status_code"], body).alias("error"),
        x["response"]["status_code"].alias("http_status"),
        F.coalesce(body, F.lit("")).alias("raw_response_body"),
    )


def indexed_results(lines: DataFrame) -> DataFrame:
    """(idx, text) of ids like req_12; other ids are left out."""
    idx = F.expr("try_cast(regexp_extract(get_json_object(value, '$.custom_id'), '^req_([0-9]+)$', 1) as bigint)")
    x = F.from_json("value", nested.BATCH_LINE)
    content = F.coalesce(F.get_json_object("value", "$.response.body.choices[0].message.content"), nested.output_text(x["response"]["body"]))
    return lines.select(idx.alias("idx"), content.alias("text")).where("idx is not null")


def claude_results(lines: DataFrame) -> DataFrame:
    """Text of succeeded results, an error named by type otherwise."""
    kind = F.get_json_object("value", "$.result.type")
    content = F.from_json(F.get_json_object("value", "$.result.message.content"), "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(content, lambda p: p["type"] == "text"), lambda p: p["text"]), "")
    return lines.select(
        F.get_json_object("value", "$.custom_id").alias("custom_id"),
        F.when(kind == "succeeded", F.coalesce(joined, F.lit(""))).otherwise("").alias("llm_output"),
        F.when(kind == "succeeded", F.lit("")).when(kind == "errored", F.coalesce(F.get_json_object("value", "$.result.error"), F.lit("errored"))).otherwise(kind).alias("error"),
    )


def gemini_results(lines: DataFrame) -> DataFrame:
    """N5, D3"""
    body = F.get_json_object("value", "$.response")
    return lines.select(F.get_json_object("value", "$.key").alias("custom_id"), nested.candidate_text(body).alias("llm_output"), F.coalesce(F.get_json_object("value", "$.error"), F.lit("")).alias("error"))


def json_config(spark: SparkSession, path: str) -> DataFrame:
    """S12"""
    return spark.read.option("multiLine", True).json(path)


def vector_cache(spark: SparkSession, path: str) -> DataFrame:
    """(hash, embedding) kept as Parquet."""
    return spark.read.schema("hash string, embedding array<float>").parquet(path)


def markdown_rows(lines: DataFrame) -> DataFrame:
    """Rows (path, line_no, header, cells, file) of Markdown tables; lines has (path, line_no, line).

    A row counts if it has as many cells as the header before it; file is a path in backticks.
    """
    cells = F.transform(F.split(F.regexp_replace(F.col("line"), r"^\s*\||\|\s*$", ""), r"\|"), text.strip)
    rows = lines.where(F.col("line").rlike(r"^\s*\|")).withColumn("cells", cells)
    rule = F.forall("cells", lambda c: c.rlike("^:?-+:?$"))
    order = Window.partitionBy("path").orderBy("line_no")
    marked = rows.withColumns({"is_rule": rule, "before_rule": F.lead(rule).over(order)})
    headed = marked.withColumn("header", F.last(F.when(F.col("before_rule"), F.col("cells")), True).over(order))
    return headed.where("not is_rule and not coalesce(before_rule, false) and size(cells) = size(header)").select("path", "line_no", "header", "cells", F.regexp_extract("line", "`([^`]+)`", 1).alias("file"))


def sectioned_metrics(lines: DataFrame, section: str = r"^([A-Za-z][^:]*):\s*$", metric: str = r"^\s+(.*?):\s*(-?[0-9.]+)%") -> DataFrame:
    """(path, section, name, value) of a report; a section's title is carried forward."""
    order = Window.partitionBy("path").orderBy("line_no")
    title = F.when(F.col("line").rlike(section), F.regexp_extract("line", section, 1))
    carried = lines.withColumn("section", F.last(title, True).over(order))
    return carried.where(F.col("line").rlike(metric)).select("path", "section", text.strip(F.regexp_extract("line", metric, 1)).alias("name"), F.regexp_extract("line", metric, 2).cast("double").alias("value"))


def latest_path(spark: SparkSession, pattern: str) -> str | None:
    """The newest file that matches a pattern."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern)
    return files.agg(F.max_by("path", "modificationTime")).first()[0]


def row_count(df: DataFrame) -> DataFrame:
    """N15"""
    return df.agg(F.count(F.lit(1)).alias("n"))


def as_written(c: Column) -> Column:
    """Null as blank, for CSV sinks."""
    return F.coalesce(c.cast("string"), F.lit(""))
