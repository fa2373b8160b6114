"""Quote metrics to subgroup tables with intervals and tests against the best subgroup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import maths
from .aggregates import quote_level, summary_stats

THRESHOLD = 1.96


def quote_metrics(scored: DataFrame, keys: list[str], with_context: bool = False) -> DataFrame:
    """Accuracy and suppression of each quote as means over runs. scored has correct and any_name."""
    rows = scored.withColumns({"accuracy": F.col("correct").cast("double"), "suppression": (~F.col("correct") if with_context else ~F.col("any_name")).cast("double")})
    return quote_level(rows, keys, ["accuracy", "suppression"])


def subgroup_metrics(quotes: DataFrame, keys: list[str]) -> DataFrame:
    """A17"""
    return summary_stats(quotes, keys, ["accuracy", "suppression"])


def annotate(rows: DataFrame, group: list[str], metric: str) -> DataFrame:
    """Each subgroup against the best mean of its group.

    The reference is the greatest mean (accuracy) or the least (suppression); where several tie, each other row takes its
    smallest z against any of them, which is that against the one with the largest error, as the means are equal. A
    reference row is compared with itself. The star on the reference asks for one reference, another row, and all other
    rows significant; a missing z counts as not significant.
    """
    best = {"accuracy": F.max, "suppression": F.min}[metric]
    w = Window.partitionBy(*group)
    mean, se = F.col(f"mean_{metric}"), F.col(f"se_{metric}")
    marked = rows.withColumn("reference_mean", best(mean).over(w)).withColumn("is_reference", F.coalesce(mean == F.col("reference_mean"), F.lit(False)))
    # The smallest z is that with the largest sum of squared errors; a zero sum gives no z.
    other_se = F.max(F.when(F.col("is_reference"), se)).over(w)
    reference_se = F.when(F.col("is_reference"), se).otherwise(other_se)
    z = F.when(F.sqrt(reference_se * reference_se + se * se) > 0, maths.z_score(F.col("reference_mean") - mean, reference_se, se))
    low, high = maths.interval(mean, se)
    marked = marked.withColumns({"ci_low": low, "ci_high": high, "difference": F.col("reference_mean") - mean, "z": z})
    marked = marked.withColumn("not_significant", F.col("is_reference") | F.coalesce(F.col("z") <= THRESHOLD, F.lit(False)))
    others = F.count_if(~F.col("is_reference")).over(w)
    significant = F.count_if(~F.col("is_reference") & F.coalesce(F.col("z") > THRESHOLD, F.lit(False))).over(w)
    alone = F.count_if(F.col("is_reference")).over(w) == 1
    return marked.withColumn("star_on_reference", F.col("is_reference") & alone & (others > 0) & (significant == others))


def variance_table(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The wanted columns that exist."""
    return rows.select(*[c for c in keep if c in rows.columns])
