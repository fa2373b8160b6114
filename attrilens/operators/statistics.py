"""Correlation, distribution distance and fits, without driver-side arrays."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import scratch
from .windows import average_ranks, running_total


def both_known(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))


def pearson(rows: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """N and r over rows with both values; null below three rows."""
    found = both_known(rows, x, y).groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("r"))
    return found.withColumn("r", F.when((F.col("n") >= 3) & ~F.isnan("r"), F.col("r")))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """A10: Pearson over average ranks."""
    # Ranks take several passes, over two numbers a row and not over what made them.
    known = scratch.stored(both_known(rows, x, y).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))
    return pearson(average_ranks(scratch.stored(average_ranks(known, "x", "rx")), "y", "ry"), "rx", "ry")


def correlation_scopes(rows: DataFrame, x: str, y: str, author: str, subgroup: str, order: str) -> DataFrame:
    """R over all quotes, over authors (first row of each), and within each subgroup."""
    all_rows = rows.select(F.lit("all_quotes").alias("scope"), x, y)
    authors = rows.groupBy(author).agg(F.min_by(x, order).alias(x), F.min_by(y, order).alias(y)).select(F.lit("all_authors").alias("scope"), x, y)
    groups = rows.select(F.col(subgroup).cast("string").alias("scope"), x, y)
    return pearson(all_rows.union(authors).union(groups), x, y, ["scope"])


def r_p_value(r: float, n: int) -> float:
    """Two-sided p of a correlation by Student's t, in closed form through the incomplete beta function."""
    if n < 3 or r is None or abs(r) > 1:
        return float("nan")
    if abs(r) == 1:
        return 0.0
    return incomplete_beta((n - 2) / 2, 0.5, 1 - r * r)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + step * d), 1 + step / c
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def ks_statistic(rows: DataFrame, value: str, group: str, a: str, b: str) -> DataFrame:
    """Greatest distance of two samples' cumulative shares, and the difference of their means."""
    known = rows.where(F.col(group).isin(a, b) & F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x"), (F.col(group) == a).alias("first"))
    # Two counts and two means.
    totals = known.agg(F.count_if("first").alias("na"), F.count_if(~F.col("first")).alias("nb"), F.avg(F.when(F.col("first"), F.col("x"))).alias("ma"), F.avg(F.when(~F.col("first"), F.col("x"))).alias("mb")).first()
    na, nb = totals["na"], totals["nb"]
    if not na or not nb:
        return known.agg(F.lit(None).cast("double").alias("ks"), F.lit(None).cast("double").alias("mean_difference"), F.lit(na).cast("long").alias("n_a"), F.lit(nb).cast("long").alias("n_b"))
    step = F.sum(F.when(F.col("first"), 1.0 / na).otherwise(-1.0 / nb)).alias("step")
    gaps = running_total(known.groupBy("x").agg(step), "x", "step", "gap")
    return gaps.agg(F.max(F.abs("gap")).alias("ks"), F.lit(totals["ma"] - totals["mb"]).alias("mean_difference"), F.lit(na).cast("long").alias("n_a"), F.lit(nb).cast("long").alias("n_b"))


def ks_p_value(d: Column, na: Column, nb: Column, terms: int = 100) -> Column:
    """Asymptotic p of the two-sample statistic."""
    # As doubles: the product of two counts may pass the range of whole numbers.
    na, nb = na.cast("double"), nb.cast("double")
    e = F.sqrt(na * nb / (na + nb))
    t = d * (e + 0.12 + 0.11 / e)
    # The lambdas take t as an argument: a column named inside one would be looked up among new aliases first.
    each = F.zip_with(F.sequence(F.lit(1), F.lit(terms)), F.array_repeat(t, terms), lambda k, t: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * t * t))
    series = F.aggregate(each, F.lit(0.0), lambda s, x: s + x)
    return F.when(t > 0.2, F.greatest(F.lit(0.0), F.least(F.lit(1.0), series))).otherwise(1.0)


def exact_ks_p(d: float, na: int, nb: int) -> float:
    """Probability that two samples of these sizes from one continuous distribution lie d or further apart.

    A random order of the pooled values is a path from (0, 0) to (na, nb). Steps
    are taken diagonal by diagonal; what leaves the band |i / na - j / nb| < d
    is added up, so small results keep their digits.
    """
    g = math.gcd(na, nb)
    a, b = na // g, nb // g
    limit = round(d * a * nb)
    if limit <= 0:
        return 1.0
    inside, out = np.ones(1), 0.0
    low = 0  # inside[k] is the chance to be at (low + k, t - low - k), never outside before
    for t in range(na + nb):
        i = np.arange(low, low + len(inside))
        up = inside * ((na - i) / (na + nb - t))
        step = np.zeros(len(inside) + 1)
        step[1:] += up
        step[:-1] += inside - up
        i = np.arange(low, low + len(step))
        ok = np.abs(i * b - (t + 1 - i) * a) < limit
        out += step[~ok].sum()
        at = np.flatnonzero(ok)
        if not len(at):
            break
        inside = step[at[0] : at[-1] + 1]
        low += int(at[0])
    return min(1.0, float(out))


#: Size up to which the two-sample p is exact.
EXACT_SIZE = 10_000


@F.pandas_udf(T.DoubleType())
def _exact_ks_ps(d: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) or not a or not b else exact_ks_p(float(x), int(a), int(b)) for x, a, b in zip(d, na, nb)], dtype="float64")


def with_ks_p(found: DataFrame) -> DataFrame:
    """Results (n_a, n_b, ks) with p: exact where neither sample has over EXACT_SIZE values, else asymptotic."""
    size = F.greatest("n_a", "n_b")
    small = found.where(size <= EXACT_SIZE).withColumn("p", _exact_ks_ps("ks", "n_a", "n_b"))
    return small.unionByName(found.where(size > EXACT_SIZE).withColumn("p", ks_p_value(F.col("ks"), F.col("n_a"), F.col("n_b"))))


def ks_pairs(rows: DataFrame, group: str, metrics: list[str], groups: list[str], buckets: int = 256) -> DataFrame:
    """A11 with J21: (metric, group_a, group_b, n_a, n_b, mean_difference, ks) of each pair of the listed groups, in their order.

    One pass for all pairs and metrics. Values are counted by group, dealt to
    buckets by range and summed there; running counts of all groups start from
    the sums of the buckets before, and every value gives its distance for each
    pair. Pairs with an empty group have no distance.
    """
    value = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics]))
    known = rows.where(F.col(group).isin(groups)).select(F.col(group).cast("string").alias("grp"), value.alias("v")).select("grp", "v.*").where("x is not null and not isnan(x)")
    counts = known.groupBy("metric", "x").pivot("grp", groups).agg(F.count(F.lit(1)))
    names = [f"c{k}" for k in range(len(groups))]
    counts = counts.select("metric", "x", *[F.coalesce(F.col(f"`{g}`"), F.lit(0)).alias(c) for g, c in zip(groups, names)])
    # At most `buckets` bounds a metric; the accuracy is about one bucket.
    cuts = counts.groupBy("metric").agg(F.percentile_approx("x", [k / buckets for k in range(1, max(2, buckets))], 10 * buckets).alias("cuts"))
    placed = counts.join(F.broadcast(cuts), "metric").withColumn("bucket", F.size(F.filter(F.array_distinct("cuts"), lambda b: b < F.col("x")))).drop("cuts")
    sums = placed.groupBy("metric", "bucket").agg(*[F.sum(c).alias(c) for c in names])
    # A row a metric and bucket.
    upto, all_ = Window.partitionBy("metric").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("metric")
    starts = sums.select("metric", "bucket", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"before_{c}") for c in names], *[F.sum(c).over(all_).alias(f"all_{c}") for c in names])
    within = Window.partitionBy("metric", "bucket").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    running = placed.withColumns({c: F.sum(c).over(within) for c in names}).join(F.broadcast(starts), ["metric", "bucket"])
    share = [(F.col(c) + F.col(f"before_{c}")) / F.nullif(F.col(f"all_{c}"), F.lit(0)) for c in names]
    pairs = [(i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))]
    shares = running.select("metric", F.array(*share).alias("s"))
    gap = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.abs(F.get("s", F.lit(i)) - F.get("s", F.lit(j))).alias("d")) for i, j in pairs]))
    widest = shares.select("metric", gap.alias("g")).groupBy("metric", "g.i", "g.j").agg(F.max("g.d").alias("ks"))
    of = known.groupBy("metric", "grp").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"))
    side = lambda x, k: of.select("metric", F.col("grp").alias(f"group_{x}"), F.col("n").alias(f"n_{x}"), F.col("mean").alias(f"mean_{x}"))
    named = widest.withColumns({f"group_{x}": F.get(F.array(*[F.lit(g) for g in groups]), F.col(k)) for x, k in (("a", "i"), ("b", "j"))})
    out = named.join(side("a", "i"), ["metric", "group_a"], "left").join(side("b", "j"), ["metric", "group_b"], "left")
    zero = F.lit(0).cast("long")
    return out.select("metric", "group_a", "group_b", F.coalesce("n_a", zero).alias("n_a"), F.coalesce("n_b", zero).alias("n_b"), (F.col("mean_a") - F.col("mean_b")).alias("mean_difference"), "ks")


def decile_shifts(rows: DataFrame, a: str, b: str) -> DataFrame:
    """How far two decile assignments of the same rows lie apart."""
    d = F.abs(F.col(a) - F.col(b))
    share = lambda k: F.avg((d <= k).cast("double"))
    return rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.count(F.lit(1)).alias("n"), share(0).alias("same"), share(1).alias("within_1"), share(2).alias("within_2"), F.avg(d.cast("double")).alias("mean_abs"), F.max(d).alias("max_abs"))


def line_fit(rows: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Least-squares line, r and the x range by group."""
    return rows.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"), F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.avg(y).alias("y_mean"))


def densities(rows: DataFrame, value: str, group: str, points: int = 100, factor: float | None = None, bins: int = 1 << 16) -> DataFrame:
    """(group, place, x, density) of each group's Gaussian kernel density at points places from its least to its greatest value.

    The bandwidth is Scott's: n ** (-1/5) standard deviations, or factor of them.
    Distinct values are counted first; a group with more than ``bins`` of them is
    counted in that many bins of its range, each with the mean of its values,
    which is far below the bandwidth. Each count goes to all points: a row a count
    and point, summed before the shuffle. Groups of one value have no density.
    """
    known = rows.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_x")).where("not isnan(_x)")
    stats = known.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), F.stddev("_x").alias("_sd"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.approx_count_distinct("_x").alias("_kinds"))
    width = (F.lit(factor) if factor else F.pow("_n", F.lit(-0.2))) * F.col("_sd")
    stats = stats.withColumn("_h", width).where("_n > 1 and _sd > 0")
    bin_ = F.when(F.col("_kinds") > bins, F.least(F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)))
    # A row a group on the smaller side.
    counts = known.join(stats, "_g").groupBy("_g", F.coalesce(bin_.cast("double"), "_x").alias("_b")).agg(F.count(F.lit(1)).alias("_c"), F.avg("_x").alias("_m"))
    at = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("place")
    spread = counts.join(stats, "_g").select("*", at).withColumn("x", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("place") / (points - 1))
    kernel = F.col("_c") * F.exp(-F.pow((F.col("x") - F.col("_m")) / F.col("_h"), F.lit(2)) / 2) / (F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi))
    return spread.groupBy(F.col("_g").alias(group), "place").agg(F.first("x").alias("x"), F.sum(kernel).alias("density"))


def exact_quantiles(rows: DataFrame, column: str, probabilities: list[float]) -> list[float]:
    """Exact quantiles with linear interpolation, as a few numbers on the driver.

    Distinct values are counted and numbered by range bucket, so no task and no aggregate buffer holds all values.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return []
    places = [p * (total - 1) for p in probabilities]
    wanted = sorted({math.floor(p) for p in places} | {math.ceil(p) for p in places})
    upto = running_total(counts, "x", "n", "upto")
    found = upto.agg(*[F.min(F.when(F.col("upto") > k, F.col("x"))).alias(str(k)) for k in wanted]).first().asDict()
    at = lambda k: found[str(k)]
    return [at(math.floor(p)) if p == math.floor(p) else (math.ceil(p) - p) * at(math.floor(p)) + (p - math.floor(p)) * at(math.ceil(p)) for p in places]


def group_medians(rows: DataFrame, keys: list[str], column: str, alias: str) -> DataFrame:
    """Exact medians by group. Distinct values of all groups are dealt by range and summed by bucket, then within buckets."""
    spark = rows.sparkSession
    buckets = max(1, min(1000, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    counts = rows.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    # At most 1000 numbers.
    bounds = sorted(set(counts.agg(F.percentile_approx("_x", [k / buckets for k in range(1, buckets)], 10 * buckets) if buckets > 1 else F.array().cast("array<double>")).first()[0] or []))
    cut = counts.withColumn("_bucket", F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col("_x"))) if bounds else F.lit(0))
    sums = cut.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_s"))
    group = Window.partitionBy(*keys)
    # A row a group and bucket.
    starts = sums.withColumns({"_before": F.sum("_s").over(group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s"), "_all": F.sum("_s").over(group)}).drop("_s")
    within = Window.partitionBy(*keys, "_bucket").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    upto = cut.withColumn("_upto", F.sum("_n").over(within)).join(starts, [*keys, "_bucket"]).withColumn("_upto", F.col("_upto") + F.col("_before"))
    at = lambda k: F.min(F.when(F.col("_upto") > k, F.col("_x")))
    return upto.groupBy(*keys).agg(((at(F.floor((F.col("_all") - 1) / 2)) + at(F.floor(F.col("_all") / 2))) / 2).alias(alias))


@F.pandas_udf(T.DoubleType())
def r_p_values(r: pd.Series, n: pd.Series) -> pd.Series:
    """P of each correlation; for rows of results."""
    return pd.Series([None if pd.isna(a) else r_p_value(float(a), int(b)) for a, b in zip(r, n)], dtype="float64")


def with_p_value(found: DataFrame) -> DataFrame:
    """Results (n, r) with their two-sided p."""
    return found.withColumn("p", r_p_values(F.col("r"), F.col("n")))
