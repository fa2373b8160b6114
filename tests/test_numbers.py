"""Deciles, ranks, correlations, matching and neighbours against pandas and numpy."""

import math
import statistics as st

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from attrilens.functions import maths
from attrilens.operators import aggregates, matching, retrieval, significance, statistics, windows


def test_right_closed_deciles(spark):
    values = [1.0, 1.0, 1.0, 2.0, 3.0, 5.0, 8.0, 13.0, 21.0, 34.0, 55.0]
    q = st.quantiles(values, n=10, method="inclusive")
    edges = [values[0], *q, values[-1]]
    want = [next(i - 1 for i in range(1, 11) if v <= edges[i] or i == 10) for v in values]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got_edges = aggregates.rising(statistics.exact_quantiles(df, "x", [k / 10 for k in range(11)]))
    assert np.allclose(got_edges, edges)
    got = [r[0] for r in df.select(maths.decile_right_closed(F.col("x"), F.array(*[F.lit(e) for e in edges]))).collect()]
    assert got == want


def test_left_closed_deciles(spark):
    hits = list(range(0, 200, 3)) + [5, 5, 5]
    df = spark.createDataFrame([(h,) for h in hits], "google_hits long")
    logs = np.log10(np.array(hits) + 1.0)
    edges = np.array(aggregates.open_edges(np.percentile(logs, np.arange(0, 101, 10)).tolist()))
    want = np.bincount(np.clip(np.searchsorted(edges, logs, side="right") - 1, 0, 9), minlength=10)
    got = [r["target_n"] for r in aggregates.decile_targets(df).orderBy("decile").collect()]
    assert got == want.tolist()


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(hs.lists(hs.integers(0, 12), min_size=11, max_size=11))
def test_quantile_bins_equal_pandas(spark, values):
    if len(set(values)) < 2:
        return
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, x double")
    edges = statistics.exact_quantiles(df, "x", [k / 10 for k in range(11)])
    got = [r[0] for r in df.orderBy("i").select(maths.quantile_bin(F.col("x"), F.array(*[F.lit(e) for e in edges]))).collect()]
    # Edges of eleven values are the values, so pandas cuts at whole numbers.
    cuts = sorted(set(values))
    want = (pd.cut(pd.Series(values, dtype=float), cuts, labels=False, include_lowest=True) + 1).tolist()
    assert got == want


def test_exact_quantiles(spark):
    rng = np.random.default_rng(2)
    for values in (rng.normal(0, 1, 157), rng.integers(0, 6, 90).astype(float), np.array([4.0])):
        df = spark.createDataFrame(pd.DataFrame({"v": values}))
        probabilities = [k / 10 for k in range(11)]
        assert np.allclose(statistics.exact_quantiles(df, "v", probabilities), np.quantile(values, probabilities))
    assert statistics.exact_quantiles(df.where("v < 0"), "v", [0.5]) == []


def test_average_rank(spark):
    values = [3.0, 1.0, 3.0, 2.0, 3.0, 1.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    want = pd.Series(values).rank().tolist()
    assert [r["r"] for r in df.withColumn("r", windows.average_rank("x")).orderBy("i").collect()] == want
    assert [r["r"] for r in windows.average_ranks(df, "x", "r").orderBy("i").collect()] == want


def test_correlations(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 30, 200).astype(float)
    y = x + rng.normal(0, 9, 200)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    assert math.isclose(statistics.pearson(df, "x", "y").first()["r"], np.corrcoef(x, y)[0, 1])
    want = np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1]
    assert math.isclose(statistics.spearman(df, "x", "y").first()["r"], want)
    assert statistics.pearson(df.limit(2), "x", "y").first()["r"] is None


def test_p_values(spark):
    p = spark.range(1).select(statistics.ks_p_value(F.lit(0.5), F.lit(50), F.lit(50))).first()[0]
    assert 0 < p < 1e-4
    assert math.isclose(statistics.r_p_value(0.5, 12), 0.0978, abs_tol=2e-4)
    assert math.isclose(statistics.incomplete_beta(2, 3, 0.4), 0.5248, abs_tol=1e-4)


def test_ks(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(0, 1, 80).round(1), rng.normal(0.5, 1, 60).round(1)
    df = spark.createDataFrame(pd.DataFrame({"x": np.r_[a, b], "g": ["a"] * 80 + ["b"] * 60}))
    points = np.unique(np.r_[a, b])
    want = max(abs((a <= p).mean() - (b <= p).mean()) for p in points)
    row = statistics.ks_statistic(df, "x", "g", "a", "b").first()
    assert math.isclose(row["ks"], want) and math.isclose(row["mean_difference"], a.mean() - b.mean())


def authors(spark, n=60):
    rng = np.random.default_rng(11)
    rows = [(g, f"{g}{i}", float(rng.normal(4, 0.4)), int(rng.integers(1, 11))) for g in ("r", "a", "b") for i in range(n)]
    return spark.createDataFrame(rows, "grp string, author string, log10_hits double, count long")


def test_matching_invariants(spark):
    got = matching.matched_runs(authors(spark), "r", ["a", "b"], runs=3).toPandas()
    for _, run in got.groupby("run_id"):
        assert run.author.is_unique
        assert run.groupby("grp").size().nunique() == 1
        for _, m in run.groupby("match_idx"):
            ref = m[m.grp == "r"].log10_hits.iloc[0]
            assert ((m.log10_hits - ref) ** 2).sum() < 2
            assert (m.to_sample == m["count"].min()).all()
    again = matching.matched_runs(authors(spark), "r", ["a", "b"], runs=3).toPandas()
    key = ["run_id", "grp", "match_idx"]
    assert got.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    stats = matching.run_stats(matching.matched_runs(authors(spark), "r", ["a", "b"], runs=3), "r")
    assert windows.rank_runs(stats, matching.CRITERIA).count() == 3


def plain_matches(reference, others, limit=1.0):
    """The matcher as it is told: remaining authors in order of fame, the nearest from the target on by octave, else the last."""
    left = {g: sorted(rows) for g, rows in others.items()}
    offsets, out, total = dict.fromkeys(others, 0.0), [], 0.0
    for row in reference:
        picked = {}
        for g, rows in left.items():
            if not rows:
                return out, total
            above = [r for r in rows if r[0] >= row[0] - offsets[g]]
            tiers = [[r for r in above if int(math.log2(r[1])) == b] for b in range(int(math.log2(row[1])), -1, -1)]
            picked[g] = next((t[0] for t in tiers if t), above[0] if above else rows[-1])
        error = sum((p[0] - row[0]) ** 2 for p in picked.values())
        if error < len(others) * limit:
            out.append((row, picked, min([row[1], *(p[1] for p in picked.values())])))
            total += error
            for g, p in picked.items():
                offsets[g] += p[0] - row[0]
                left[g].remove(p)
    return out, total


def test_matching_equals_a_plain_matcher():
    rng = np.random.default_rng(4)
    for limit in (0.05, 1.0, 9.0):
        for _ in range(30):
            make = lambda g, n: [(float(rng.integers(20, 60)) / 10, int(rng.integers(1, 40)), f"{g}{i}") for i in range(n)]
            reference, others = make("r", 30), {g: make(g, int(rng.integers(1, 40))) for g in "abc"}
            assert matching.match_once(reference, others, limit) == plain_matches(reference, others, limit)


def test_run_metrics(spark):
    """A35, M11 of each run, recomputed from its matches."""
    got = matching.matched_runs(authors(spark), "r", ["a", "b"], runs=3)
    runs = got.toPandas()
    for r in matching.run_stats(got, "r").collect():
        run = runs[runs.run_id == r["run_id"]]
        ref = run[run.grp == "r"].set_index("match_idx")
        fame = run.groupby("grp").log10_hits.mean()
        gaps = [(x.log10_hits - ref.log10_hits[x.match_idx]) ** 2 for x in run[run.grp != "r"].itertuples()]
        assert r["authors_per_group"] == len(ref) and r["quotes_per_group"] == ref.to_sample.sum()
        assert math.isclose(r["avg_fame"], fame.mean()) and math.isclose(r["fame_range"], fame.max() - fame.min())
        assert math.isclose(r["rms_error"], math.sqrt(np.mean(gaps)))


def test_group_medians(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"g": rng.choice(list("abc"), 301), "x": rng.integers(0, 40, 301).astype(float)})
    got = {r["g"]: r["m"] for r in statistics.group_medians(spark.createDataFrame(pdf), ["g"], "x", "m").collect()}
    assert got == pdf.groupby("g").x.median().to_dict()


def test_running_total_of_strings(spark):
    rng = np.random.default_rng(9)
    keys = sorted({"".join(rng.choice(list("abé\u00ff日"), rng.integers(0, 12))) for _ in range(200)}, key=lambda x: x.encode())
    df = spark.createDataFrame([(k, i + 1) for i, k in enumerate(keys)], "k string, v long")
    got = {r["k"]: r["t"] for r in windows.running_total(df, "k", "v", "t").collect()}
    assert got == dict(zip(keys, np.cumsum(np.arange(1, len(keys) + 1)).tolist()))


def test_pilot_and_index(spark):
    df = spark.createDataFrame([("g", float(v), i) for i, v in enumerate([5, 1, 3, 3, 2, 9])] + [("h", 1.0, 9)], "g string, f double, t int")
    got = sorted((r["g"], r["t"]) for r in windows.pilot(df, ["g"], "f", "t", 2).collect())
    assert got == [("g", 0), ("g", 1), ("g", 4), ("g", 5), ("h", 9)]
    from attrilens.sources import scans

    rows = scans.with_index(spark.range(0, 1000, 1, 7), "n").collect()
    assert sorted(r["n"] for r in rows) == list(range(1000)) and all(r["n"] == r["id"] for r in rows)


def test_matching_bin_fallback():
    found, _ = matching.match_once([(3.0, 8, "r")], {"a": [(3.0, 1, "low"), (2.0, 8, "below")]}, 10)
    assert found[0][1]["a"][2] == "low"
    found, _ = matching.match_once([(9.0, 8, "r")], {"a": [(3.0, 1, "low")]}, 100)
    assert found[0][1]["a"][2] == "low"
    assert matching.match_once([(9.0, 8, "r")], {"a": []}) == ([], 0.0)


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(0, 1, (90, 8)).astype(np.float32)
    v[7] = v[8]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<float>")
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -np.inf)
    want = {i: sorted(range(90), key=lambda j: (-round(s[i, j], 9), j))[:4] for i in range(90)}
    for got in (retrieval.neighbours(df, df, "id", "v", 4, block_bytes=32 * 4 * len(df.first()["v"])), retrieval.neighbours_small(df, df, "id", "v", 4)):
        rows = got.orderBy("query", "rank").collect()
        assert {i: [r["neighbour"] for r in rows if r["query"] == i] for i in range(90)} == want


def test_significance_edges(spark):
    rows = [("p", "a", 0.9, 0.01, 5), ("p", "b", 0.9, 0.2, 5), ("p", "c", 0.5, 0.01, 5), ("q", "a", 0.9, 0.0, 5), ("q", "b", 0.2, 0.0, 5), ("q", "c", 0.1, 0.05, 5), ("s", "a", 0.5, None, 1), ("t", "a", 0.8, 0.01, 9), ("t", "b", 0.1, 0.01, 9)]
    df = spark.createDataFrame(rows, "prompt string, g string, mean_accuracy double, se_accuracy double, n long")
    got = {(r["prompt"], r["g"]): r for r in significance.annotate(df, ["prompt"], "accuracy").collect()}
    assert got["p", "a"]["is_reference"] and got["p", "b"]["is_reference"]
    assert math.isclose(got["p", "c"]["z"], 0.4 / math.hypot(0.2, 0.01))
    assert not got["p", "a"]["star_on_reference"]
    assert got["q", "b"]["z"] is None and not got["q", "b"]["not_significant"]
    assert not got["q", "a"]["star_on_reference"]
    assert not got["s", "a"]["star_on_reference"]
    assert got["t", "a"]["star_on_reference"]


def test_unit_and_dot(spark):
    df = spark.sql("select array(3f, 4f) a, array(0f, 0f) b")
    row = df.select(maths.unit(F.col("a")), maths.unit(F.col("b")), maths.dot(maths.unit(F.col("a")), maths.unit(F.col("a")))).first()
    assert np.allclose(row[0], [0.6, 0.8]) and row[1] == [0.0, 0.0] and math.isclose(row[2], 1.0)


def test_neighbours_skip_pairs_of_blocks(spark):
    """On clustered vectors most pairs of blocks never meet, and the result is that of all scores."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 12))
    m = (centres[rng.integers(0, 20, 1500)] + 0.02 * rng.normal(size=(1500, 12))).astype(np.float32)
    m[700:760] = m[5]  # copies tie
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<float>")
    met: list = []
    got = {}
    for r in retrieval.neighbours(df, df, "id", "v", 5, block_bytes=48 * 25, skipped=met).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["neighbour"], r["score"]))
    unit = m.astype(np.float64) / np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True)
    scores = unit @ unit.T
    np.fill_diagonal(scores, -np.inf)
    for i in range(1500):
        want = sorted(range(1500), key=lambda j: (-round(scores[i, j], 12), j))[:5]
        assert np.allclose([x[2] for x in sorted(got[i])], scores[i, want], atol=1e-12)
    assert [x[1] for x in sorted(got[5])] == [700, 701, 702, 703, 704]
    assert met[1] > 1000 and met[0] < 0.5 * met[1]


def test_neighbours_of_empty_tables_and_fewer_rows_than_k(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "id long, v array<float>")
    assert retrieval.neighbours(df.limit(0), df, "id", "v", 5).count() == 0
    assert retrieval.neighbours(df, df.limit(0), "id", "v", 5).count() == 0
    assert sorted((r["query"], r["neighbour"], r["rank"]) for r in retrieval.neighbours(df, df, "id", "v", 5).collect()) == [(1, 2, 1), (1, 3, 2), (2, 1, 1), (2, 3, 2), (3, 1, 1), (3, 2, 2)]


def test_cosine_bound_holds():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = (rng.normal(size=3) + 0.3 * rng.normal(size=(20, 3)) for _ in range(2))
        a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
        ca, cb = a.mean(axis=0), b.mean(axis=0)
        ra, rb = (np.linalg.norm(x - c, axis=1).max() for x, c in ((a, ca), (b, cb)))
        assert (a @ b.T).max() <= retrieval.cosine_bound(ca, ra, cb[None], np.array([rb]))[0] + 1e-12


def test_average_ranks_with_a_frequent_value(spark):
    values = [5.0] * 60 + [float(v) for v in range(40)] + [7.0] * 30 + [None, None]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double").repartition(5)
    known = pd.Series([v for v in values if v is not None]).rank()
    got = {r["i"]: r["r"] for r in windows.average_ranks(df, "x", "r").collect()}
    assert got == {i: known[i] for i, v in enumerate(values) if v is not None}
    plan = windows.average_ranks(df, "x", "r")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan


def test_matcher_streams_the_reference_and_packs_the_others():
    import tracemalloc

    import pyarrow as pa

    n = 20_000
    side = lambda k: pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.array([k] * n, pa.int32()), pa.array([j / n for j in range(n)]), pa.array([1 + j % 3 for j in range(n)]), pa.array([f"author {j:08}" for j in range(n)])], names=["run_id", "side", "f", "c", "a"])

    def batches():
        for k in range(3):
            b = side(k)
            yield from (b.slice(at, 500) for at in range(0, n, 500))

    tracemalloc.start()
    rows = sum(b.num_rows for b in matching._matcher("r", ["a", "b"], 1.0, 500)(batches()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 3 * n
    assert peak < 2 * n * 80 + 3_000_000


def test_matcher_goes_on_after_a_run_that_ends_early(spark):
    rows = [("r", f"r{i}", 3.0, 1) for i in range(5)] + [("a", "a0", 3.0, 1), ("a", "a1", 3.0, 1)]
    df = spark.createDataFrame(rows, "grp string, author string, log10_hits double, count long").repartition(1)
    got = matching.matched_runs(df, "r", ["a"], runs=4).groupBy("run_id").count().collect()
    assert sorted((r["run_id"], r["count"]) for r in got) == [(k, 4) for k in range(4)]


def test_tiles_of_scores_are_bounded_in_bytes():
    for columns in (1, 64, 16_384, 1 << 24):
        rows = retrieval.tile_rows(columns, 1024)
        assert 1 <= rows <= 1024 and (rows == 1 or rows * columns * 8 <= retrieval.TILE_BYTES)
