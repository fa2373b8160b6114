"""Two-sample distances: exact p against all orders, all pairs against plain code, aliases beside p."""

import itertools
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from attrilens.operators import statistics


def plain_distance(a, b):
    return max((abs(Fraction(sum(x <= v for x in a), len(a)) - Fraction(sum(x <= v for x in b), len(b))) for v in {*a, *b}), default=None)


def all_orders(na, nb, d):
    """Share of the orders of the pooled values that lie d apart or more."""
    hit = total = 0
    for at in itertools.combinations(range(na + nb), na):
        at, i, far = set(at), 0, Fraction(0)
        for k in range(na + nb):
            i += k in at
            far = max(far, abs(Fraction(i, na) - Fraction(k + 1 - i, nb)))
        hit, total = hit + (far >= d), total + 1
    return Fraction(hit, total)


def by_recursion(na, nb, d):
    """The same by counting paths inside the band in whole numbers."""
    row = {}
    for i in range(na + 1):
        for j in range(nb + 1):
            if abs(Fraction(i, na) - Fraction(j, nb)) >= d:
                row[i, j] = 0
            else:
                row[i, j] = 1 if i == j == 0 else row.get((i - 1, j), 0) + row.get((i, j - 1), 0)
    return 1 - Fraction(row[na, nb], math.comb(na + nb, na))


@pytest.mark.parametrize("na,nb", [(1, 1), (1, 5), (3, 4), (4, 6), (5, 5), (6, 8)])
def test_exact_p_is_the_share_of_orders(na, nb):
    for k in range(1, na * nb + 1):
        d = Fraction(k, na * nb)
        if (d * math.lcm(na, nb)).denominator == 1:
            want = all_orders(na, nb, d)
            assert by_recursion(na, nb, d) == want
            assert math.isclose(statistics.exact_ks_p(float(d), na, nb), want, rel_tol=1e-11)


@pytest.mark.parametrize("na,nb,h", [(60, 60, 20), (48, 90, 250), (97, 31, 1500), (120, 80, 200)])
def test_exact_p_of_larger_samples(na, nb, h):
    d = Fraction(h, math.lcm(na, nb))
    assert math.isclose(statistics.exact_ks_p(float(d), na, nb), by_recursion(na, nb, d), rel_tol=1e-9)


def test_exact_p_keeps_small_results_and_nears_the_series(spark):
    assert math.isclose(statistics.exact_ks_p(1.0, 200, 200), 2 / math.comb(400, 200), rel_tol=1e-9)
    assert statistics.exact_ks_p(0.0, 3, 4) == 1.0
    near = spark.range(1).select(statistics.ks_p_value(F.lit(0.03), F.lit(5000), F.lit(6000))).first()[0]
    assert math.isclose(statistics.exact_ks_p(0.03, 5000, 6000), near, rel_tol=0.03)


def test_p_beside_a_rounded_column_of_its_input(spark):
    row = spark.createDataFrame([(0.123456789, 150, 170)], "ks double, n_a long, n_b long")
    p = statistics.ks_p_value(F.col("ks"), F.col("n_a"), F.col("n_b"))
    beside = row.select(F.round("ks", 2).alias("ks"), (F.col("n_a") * 0).alias("n_a"), p.alias("p")).first()["p"]
    assert beside == row.select(p).first()[0]


def test_p_of_counts_with_a_large_product(spark):
    sizes = spark.range(1).select(F.lit(0.005).alias("ks"), F.lit(180_000).alias("n_a"), F.lit(170_000).alias("n_b"))
    e = math.sqrt(180_000 * 170_000 / 350_000)
    t = 0.005 * (e + 0.12 + 0.11 / e)
    want = sum(2 * (-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101))
    got = sizes.select(statistics.ks_p_value(F.col("ks"), F.col("n_a"), F.col("n_b"))).first()[0]
    assert math.isclose(got, want, rel_tol=1e-9)


@pytest.mark.parametrize("buckets", [256, 7, 1])
def test_pairs_against_plain(spark, buckets):
    rng = random.Random(11)
    groups = ["b", "a", "d.d", "empty", "c"]
    rows = [(rng.choice(["a", "b", "c", "d.d", "other"]), rng.choice([None, float("nan"), round(rng.gauss(0, 1), 2)]) if rng.random() < 0.2 else round(rng.gauss(0, 1), 1), rng.choice([1, 1, 1, 2, 3, None])) for _ in range(700)]
    rows += [(None, 1.0, 1), ("a", None, None)]
    df = spark.createDataFrame(rows, "g string, x double, n int")
    got = {(r["metric"], r["group_a"], r["group_b"]): r for r in statistics.with_ks_p(statistics.ks_pairs(df, "g", ["x", "n"], groups, buckets)).collect()}
    assert len(got) == 2 * 10
    for (metric, a, b), r in got.items():
        assert groups.index(a) < groups.index(b)
        va, vb = ([v for v in (row[1 if metric == "x" else 2] for row in rows if row[0] == g) if v is not None and v == v] for g in (a, b))
        assert (r["n_a"], r["n_b"]) == (len(va), len(vb))
        if not va or not vb:
            assert r["ks"] is None and r["p"] is None and r["mean_difference"] is None
            continue
        d = plain_distance(va, vb)
        assert math.isclose(r["ks"], d, rel_tol=1e-12)
        assert math.isclose(r["mean_difference"], sum(va) / len(va) - sum(vb) / len(vb), abs_tol=1e-12)
        assert math.isclose(r["p"], by_recursion(len(va), len(vb), d), rel_tol=1e-8)


def test_pairs_of_an_empty_table(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert statistics.ks_pairs(df, "g", ["x"], ["a", "b"]).count() == 0


@pytest.mark.parametrize("bins,tolerance", [(1 << 16, 1e-9), (200, 1e-3)])
def test_densities_against_direct_sums(spark, bins, tolerance):
    rng = random.Random(4)
    groups = {"a": [rng.gauss(0, 1) for _ in range(400)], "b": [rng.choice([1.0, 2.0, 2.5]) for _ in range(50)], "same": [3.0] * 5, "one": [1.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), (None, 1.0), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {}
    for r in statistics.densities(df, "x", "g", points=40, bins=bins).collect():
        got.setdefault(r["g"], {})[r["place"]] = (r["x"], r["density"])
    assert set(got) == {"a", "b"}
    for g, curve in got.items():
        vs = groups[g]
        mean = sum(vs) / len(vs)
        h = len(vs) ** -0.2 * math.sqrt(sum((v - mean) ** 2 for v in vs) / (len(vs) - 1))
        assert sorted(curve) == list(range(40))
        for k, (x, d) in curve.items():
            assert math.isclose(x, min(vs) + (max(vs) - min(vs)) * k / 39, abs_tol=1e-12)
            assert math.isclose(d, sum(math.exp(-(((x - v) / h) ** 2) / 2) for v in vs) / (len(vs) * h * math.sqrt(2 * math.pi)), rel_tol=tolerance)
