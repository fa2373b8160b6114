"""Ranking and windows, written so that a window's partition is a group of bounded size or a mergeable rank limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_rows(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark limits groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def quota_fill(rows: DataFrame, targets: DataFrame, bin_column: str, order: list[Column]) -> DataFrame:
    """The first target_n rows of each bin, in order; targets has a row a bin."""
    # The greatest target limits bins before the shuffle.
    most = targets.agg(F.max("target_n")).first()[0] or 0
    w = Window.partitionBy(bin_column).orderBy(*order)
    first = rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= F.lit(most))
    return first.join(targets, bin_column).where(F.col("_rn") <= F.col("target_n")).drop("_rn", "target_n")


def keep_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """W2, W3, U2"""
    return _one(rows, keys, order, F.min_by)


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """W2"""
    return _one(rows, keys, order, F.max_by)


def _one(rows: DataFrame, keys: list[str], order: str, pick) -> DataFrame:
    # An aggregate, so rows combine before the shuffle.
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_x")).select(*[F.col(c) if c in keys else F.col(f"_x.{c}").alias(c) for c in rows.columns])


def average_rank(x: str, keys: list[str] | None = None, ascending: bool = True) -> Column:
    """Rank with ties at their mean; for small tables (runs of a matcher)."""
    w = Window.partitionBy(*(keys or []))
    return F.rank().over(w.orderBy(F.asc(x) if ascending else F.desc(x))) + (F.count(F.lit(1)).over(Window.partitionBy(*(keys or []), x)) - 1) / 2


def average_ranks(rows: DataFrame, column: str, alias: str) -> DataFrame:
    """W9 for large tables: ranks from counts of distinct values, joined back; rows without a value go.

    Values are sorted by range and numbered from partition totals, so no task sees all rows.
    A value that over a partition's share of the rows have would meet them all in one task of
    the join: there are fewer such values than partitions, so their ranks are sent to the rows.
    """
    spark = rows.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.where(F.col(column).isNotNull())
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_total(counts, column, "_n", "_upto").withColumn(alias, F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2)
    share = counts.agg(F.sum("_n")).first()[0]
    frequent = ranked.where(F.col("_n") > F.lit(share or 0) / parts).select(column, alias)
    values = {r[column]: r[alias] for r in frequent.collect()}  # fewer than parts
    if not values:
        return rows.join(ranked.select(column, alias), column)
    known = spark.createDataFrame(list(values.items()), frequent.schema)
    hot = rows.join(F.broadcast(known), column)
    rest = rows.join(F.broadcast(known.select(column)), column, "left_anti")
    return hot.unionByName(rest.join(ranked.select(column, alias), column))


def running_total(rows: DataFrame, order: str, value: str, alias: str) -> DataFrame:
    """Running sum over a total order of distinct keys: sums by range bucket, then within buckets."""
    spark = rows.sparkSession
    buckets = max(1, min(1000, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    kind = dict(rows.dtypes)[order]
    # Strings are dealt by their first seven bytes as a number, in their own order.
    code = F.conv(F.rpad(F.hex(F.substring(F.col(order).cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long") if kind == "string" else F.col(order).cast("int") if kind == "boolean" else F.col(order)
    # At most 1000 numbers.
    bounds = rows.agg(F.percentile_approx(code, [k / buckets for k in range(1, buckets)], 10 * buckets) if buckets > 1 else F.array().cast("array<double>")).first()[0] or []
    bounds = sorted(set(bounds))
    bucket = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < code)) if bounds else F.lit(0)
    cut = rows.withColumn("_bucket", bucket)
    sums = {r["_bucket"]: r["s"] for r in cut.groupBy("_bucket").agg(F.sum(value).alias("s")).collect()}
    before, at = [], 0
    for b in range(len(bounds) + 1):
        before.append(at)
        at += sums.get(b, 0) or 0
    start = F.get(F.array(*[F.lit(x) for x in before]), F.col("_bucket"))
    w = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn(alias, F.sum(value).over(w) + start).drop("_bucket")


def rank_runs(stats: DataFrame, criteria: list[tuple[str, bool]]) -> DataFrame:
    """Sum of average ranks over criteria (name, ascending); best first, ties by the criteria in order."""
    ranked = stats.withColumns({f"rank_{c}": average_rank(c, ascending=a) for c, a in criteria})
    total = sum([F.col(f"rank_{c}") for c, _ in criteria[1:]], F.col(f"rank_{criteria[0][0]}"))
    return ranked.withColumn("rank_sum", total).orderBy("rank_sum", *[F.asc(c) if a else F.desc(c) for c, a in criteria])


def pilot(rows: DataFrame, keys: list[str], fame: str, tie: str, n: int) -> DataFrame:
    """The n most and the n least famous of each subgroup; a row that is both is there once."""
    least = top_rows(rows, keys, [F.asc(fame), F.asc(tie)], n)
    # Each side is limited before the shuffle; what is left are a few rows a group.
    return least.union(top_rows(rows, keys, [F.desc(fame), F.asc(tie)], n).exceptAll(least))


def ordered_by_list(column: str, values: list[str], unknown: int = 99) -> Column:
    """O2: place in a list, others last."""
    return F.when(F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column)) > 0, F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column)) - 1).otherwise(unknown)


def shuffled(options: Column, *seed: Column) -> Column:
    """Answer options in an order that the seed fixes (by MD5, so other engines can repeat it)."""
    keyed = F.transform(options, lambda o: F.struct(F.md5(F.concat_ws(":", o, *[s.cast("string") for s in seed])).alias("k"), o.alias("o")))
    return F.transform(F.array_sort(keyed), lambda x: x["o"])


def chunk(idx: Column, size: int) -> Column:
    """O8"""
    return F.floor(idx / size).cast("int")


def split_plan(spark, rows: int, prompts: int, runs: int, most: int, most_runs: int | None = None) -> DataFrame:
    """Shards of rows and chunks of runs so that no batch has more than most requests."""
    runs_each = max(1, min(runs, most_runs or runs, most // max(1, prompts)))
    rows_each = max(1, most // (prompts * runs_each))
    shards, chunks = -(-rows // rows_each), -(-runs // runs_each)
    plan = spark.range(shards * chunks).select((F.col("id") / chunks).cast("int").alias("shard"), (F.col("id") % chunks).cast("int").alias("chunk"))
    first_row, first_run = F.col("shard") * rows_each, F.col("chunk") * runs_each
    n_rows, n_runs = F.least(F.lit(rows) - first_row, F.lit(rows_each)), F.least(F.lit(runs) - first_run, F.lit(runs_each))
    return plan.select("shard", "chunk", first_row.alias("first_row"), n_rows.alias("n_rows"), (first_run + 1).alias("first_run"), n_runs.alias("n_runs"), (n_rows * n_runs * prompts).alias("requests"))
