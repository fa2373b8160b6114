"""Aggregates: author universe, deciles, rates by subgroup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import maths
from .statistics import exact_quantiles, group_medians


def universe(rows: DataFrame, order: str, author="author_clean", race="race", gender="gender", fame="log10_hits") -> DataFrame:
    """A1: one row an author: values of the first row, and the number of quotes."""
    return rows.groupBy(author).agg(*[F.min_by(c, order).alias(c) for c in (race, gender, fame)], F.count(F.lit(1)).alias("count"))


def ambiguous(rows: DataFrame, author="author_clean", race="race", gender="gender") -> DataFrame:
    """A2: authors with more than one race or gender."""
    counted = rows.groupBy(author).agg(F.count_distinct(race).alias("n_race"), F.count_distinct(gender).alias("n_gender"))
    return counted.where("n_race > 1 or n_gender > 1")


def subgroup_table(spark: SparkSession, subgroups: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(r, g, k) for k, (r, g) in enumerate(subgroups)], "race string, gender string, ord int")


def subgroup_counts(rows: DataFrame, groups: DataFrame, author="author_clean", hits="google_hits", keys=("race", "gender")) -> DataFrame:
    """A3: authors, quotes and authors with hits; groups without rows have zeros."""
    agg = rows.groupBy(*keys).agg(F.count_distinct(author).alias("authors"), F.count(F.lit(1)).alias("quotes"), F.count_distinct(F.when(F.col(hits).isNotNull(), F.col(author))).alias("with_hits"))
    return groups.join(agg, list(keys), "left").fillna(0, ["authors", "quotes", "with_hits"])


def decile_grid(rows: DataFrame, groups: DataFrame, decile: str, author: str, keys: list[str], bins: int = 10) -> DataFrame:
    """A4: authors for each decile and subgroup, dense."""
    agg = rows.groupBy(decile, *keys).agg(F.count_distinct(author).alias("authors"))
    grid = groups.select(*keys).withColumn(decile, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(agg, [decile, *keys], "left").fillna(0, ["authors"])


def joined_names(rows: DataFrame, key: str, name: str, alias: str = "names") -> DataFrame:
    """A5: distinct names, sorted, joined by '; '. Names of one author are few."""
    return rows.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(F.when(F.col(name) != "", F.col(name)))), "; ").alias(alias))


def rising(edges: list[float]) -> list[float]:
    """Edges that never fall."""
    out: list[float] = []
    for e in edges:
        out.append(max(e, out[-1]) if out else e)
    return out


def open_edges(values: list[float], step: float = 1e-9) -> list[float]:
    """Edges made strictly rising, with open ends."""
    out = list(values)
    for i in range(1, len(out)):
        out[i] = max(out[i], out[i - 1] + step)
    return [float("-inf"), *out[1:-1], float("inf")]


def decile_targets(rows: DataFrame, hits: str = "google_hits", bins: int = 10) -> DataFrame:
    """How many reference authors each decile of log10(hits + 1) has, dense from 0 to 9."""
    spark = rows.sparkSession
    logs = rows.select(maths.log10p1(F.col(hits)).alias("x")).where("x is not null")
    found = exact_quantiles(logs, "x", [k / bins for k in range(bins + 1)])
    if not found:
        return spark.range(bins).select(F.col("id").cast("int").alias("decile"), F.lit(0).cast("long").alias("target_n"))
    edges = F.array(*[F.lit(e) for e in open_edges(found)])
    counted = logs.groupBy(maths.decile_left_closed(F.col("x"), edges).alias("decile")).agg(F.count(F.lit(1)).alias("target_n"))
    return spark.range(bins).select(F.col("id").cast("int").alias("decile")).join(counted, "decile", "left").fillna(0, ["target_n"])


def quartet(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """N, mean, std and median of each metric; medians from counted distinct values, so no buffer holds a group."""
    found = rows.groupBy(*keys).agg(*[a for m in metrics for a in (F.count(m).alias(f"n_{m}"), F.avg(m).alias(f"mean_{m}"), F.stddev_samp(m).alias(f"std_{m}"))])
    for m in metrics:
        found = found.join(group_medians(rows, keys, m, f"median_{m}"), keys, "left")
    return found


def first_known(rows: DataFrame, key: str, order: str, first: list[str], most: list[str]) -> DataFrame:
    """The first non-blank value of some columns, the greatest of others."""
    known = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col(order)))
    return rows.groupBy(key).agg(*[known(c).alias(c) for c in first], *[F.max(c).alias(c) for c in most])


def pivot_counts(rows: DataFrame, key: str, column: str, values: list[str], prefix: str) -> DataFrame:
    """Counts as columns with 0 for none, and flags of presence."""
    counts = rows.groupBy(key).agg(*[F.count_if(F.col(column) == v).alias(f"{prefix}{v}") for v in values])
    return counts.select("*", *[(F.col(f"{prefix}{v}") > 0).alias(f"in_{v}") for v in values])


def quote_level(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Means over runs; null keys are groups too."""
    return rows.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics])


def quote_level_spread(rows: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Mean and std over runs, std 0 for one run; rows with a null key go."""
    return rows.dropna(subset=keys).groupBy(*keys).agg(F.avg(metric).alias("mean"), F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("std"))


def summary_stats(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One pass for all metrics: n, mean, variance, std and standard error."""
    out = [F.count(F.lit(1)).alias("n_quotes")]
    for m in metrics:
        out += [F.avg(m).alias(f"mean_{m}"), F.var_samp(m).alias(f"variance_{m}"), F.stddev_samp(m).alias(f"std_{m}"), F.try_divide(F.stddev_samp(m), F.sqrt(F.count(m).cast("double"))).alias(f"se_{m}")]
    return rows.groupBy(*keys).agg(*out)


def comparison(rows: DataFrame, row: str, column: str, values: list[str], metric: str) -> DataFrame:
    """Means with one column for each prompt."""
    return rows.groupBy(row).agg(*[F.avg(F.when(F.col(column) == v, F.col(metric))).alias(v) for v in values])


def crosstab(rows: DataFrame, a: str, b: str, bins: int = 10, first: int = 1) -> DataFrame:
    """Counts of b within a on a dense grid, and their share of the row."""
    spark = rows.sparkSession
    counted = rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    steps = F.sequence(F.lit(first), F.lit(first + bins - 1))
    grid = spark.range(1).select(F.explode(steps).alias(a)).withColumn(b, F.explode(steps))
    dense = grid.join(counted, [a, b], "left").fillna(0, ["n"])
    total = dense.groupBy(a).agg(F.sum("n").alias("total"))
    return dense.join(total, a).select(a, b, "n", (F.col("n") / F.greatest(F.col("total"), F.lit(1))).alias("share"))


def outcome_rates(rows: DataFrame, sets: list[tuple[str, ...]]) -> DataFrame:
    """Rates of correct, wrong and none, and of correct given a name, for several groupings at once.

    Rows have correct and any_name. Columns not in a grouping are null; grouping_bits tells the groupings apart.
    """
    columns = list(dict.fromkeys(c for s in sets for c in s))
    correct, named = F.col("correct").cast("double"), F.col("any_name").cast("double")
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.avg(correct).alias("p_correct"),
        F.avg(F.when(~F.col("correct") & F.col("any_name"), 1.0).otherwise(0.0)).alias("p_wrong"),
        F.avg(F.when(~F.col("correct") & ~F.col("any_name"), 1.0).otherwise(0.0)).alias("p_none"),
        F.try_divide(F.sum(correct * named), F.sum(named)).alias("p_correct_given_name"),
    ]
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(F.grouping_id().alias("grouping_bits"), *aggs)


def no_name_rates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A24"""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("any_name")).alias("no_name"), F.avg((~F.col("any_name")).cast("double")).alias("no_name_rate"))


def given_direct_correct(rows: DataFrame, keys: list[str], direct: str = "direct", prompt: str = "prompt_type") -> DataFrame:
    """Rates of the other prompts among quotes that the direct prompt got right."""
    right = rows.where((F.col(prompt) == direct) & F.col("correct")).select("quote_id").distinct()
    others = rows.where(F.col(prompt) != direct).join(right, "quote_id", "left_semi")
    return outcome_rates(others, [tuple(keys)]).drop("grouping_bits")


def final_given_reasoning(rows: DataFrame, reasoning: str, final: str) -> DataFrame:
    """A27"""
    return rows.where(F.col(reasoning)).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(final).cast("double")).alias("p_final"))


def misattribution(pairs: DataFrame) -> DataFrame:
    """How often a wrong name shares gender, race or both with the right one."""
    race, gender = F.col("true_race") == F.col("named_race"), F.col("true_gender") == F.col("named_gender")
    return pairs.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c.cast("double")).alias(k) for k, c in (("same_race", race), ("same_gender", gender), ("same_both", race & gender))])


def confusions(errors: DataFrame, right: str, named: str, order: str, top: int = 50) -> DataFrame:
    """Most frequent pairs; ties by first appearance."""
    return errors.groupBy(right, named).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(top)


def response_lengths(rows: DataFrame, prompt: str, output: str, no_answer: str) -> DataFrame:
    """A33"""
    return rows.groupBy(prompt).agg(F.avg(F.coalesce(F.length(output), F.lit(0))).alias("mean_length"), F.avg(F.col(no_answer).cast("double")).alias("no_answer_rate"))


def gaps(rates: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """Best and worst by value, and the distance between them; ties by name."""
    ordered = rates.where(F.col(value).isNotNull())
    best, worst = F.max(F.struct(value, name)), F.min(F.struct(value, name))
    return ordered.groupBy(*keys).agg(best[name].alias("best"), worst[name].alias("worst"), (F.max(value) - F.min(value)).alias("gap"))


def complete_units(rows: DataFrame, unit: list[str], prompt: str, output: str, prompts: int = 3) -> DataFrame:
    """Units whose prompts all have a non-blank output."""
    return rows.where(F.trim(F.coalesce(output, F.lit(""))) != "").groupBy(*unit).agg(F.count_distinct(prompt).alias("n")).where(F.col("n") == prompts).select(*unit)


def complete_units_wide(rows: DataFrame, unit: list[str], outputs: list[str]) -> DataFrame:
    """A36 for wide rows, N7: the best of repeated rows has every output."""
    filled = sum([(F.trim(F.coalesce(F.col(o), F.lit(""))) != "").cast("int") for o in outputs], F.lit(0))
    return rows.groupBy(*unit).agg(F.max(filled).alias("n")).where(F.col("n") == len(outputs)).select(*unit)


def pending_count(expected: Column, complete: Column) -> Column:
    """A38"""
    return F.greatest(expected - complete, F.lit(0))


def agreement(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """How often two labels agree, letter case and outer white space apart; and all of them together."""
    same = {k: F.coalesce(F.lower(F.trim(a)) == F.lower(F.trim(b)), F.lit(False)) for k, (a, b) in pairs.items()}
    every = F.lit(True)
    for c in same.values():
        every = every & c
    return rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c.cast("double")).alias(f"agree_{k}") for k, c in same.items()], F.avg(every.cast("double")).alias("agree_all"))


def wrong_percent(correct: Column, none: Column) -> Column:
    """A40"""
    return F.round(100 - correct - none, 3)


def error_count(rows: DataFrame, column: str = "error") -> DataFrame:
    """A41"""
    return rows.agg(F.count_if(F.length(F.trim(F.col(column))) > 0).alias("errors"))
