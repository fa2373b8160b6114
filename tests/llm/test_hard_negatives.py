"""Hard negatives: the operator against all scores on clustered, repeated and odd rows; intervals against real products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from attrilens.llm import common, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, source string, cell long, salt string, v string"


def plain(rows, is_anchor, positives=5, negatives=10, least=30, greatest=90):
    """Rows of the result from all scores; anchors are (id, label, vector) once each."""
    kept = []
    for i, e, lab, *_ in rows:
        if i is None or lab is None or e is None or any(x is None or not np.isfinite(x) for x in e):
            continue
        kept.append((i, lab, tuple(np.floor(256 * np.array(e, np.float32).astype(np.float64)))))
    out = []
    for i, lab, v in {r for r in kept if is_anchor(r[0])}:
        scored = sorted((-float(np.dot(v, w)), j, other) for j, other, w in kept if len(w) == len(v))
        for p, pid, _ in [x for x in scored if x[2] == lab and x[1] != i][:positives]:
            fits = [x for x in scored if x[2] != lab and least * -p <= 100 * -x[0] <= greatest * -p][:negatives]
            out += [(i, pid, k + 1, x[1], int(-p), int(-x[0])) for k, x in enumerate(fits)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    vectors = common.stored(hard_negatives.whole_vectors(df))
    return sorted(tuple(r) for r in hard_negatives.mine(vectors, vectors.where("vec_id % 10 = 0")).collect())


def clustered(rng, n, dim=16, labels=4, spread=0.15):
    centres = rng.normal(size=(12, dim))
    v = centres[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return [(i, x.astype(np.float32).tolist(), int(rng.integers(0, labels)), "s", 1, "x", None) for i, x in enumerate(v)]


@pytest.mark.parametrize("block", [8192, 64])
def test_against_all_scores(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(hard_negatives, "ASK_ROWS", min(block, 32))
    rng = np.random.default_rng(4)
    rows = clustered(rng, 700)
    # A third of all rows is one vector, with several labels.
    rows += [(1000 + i, rows[5][1], i % 3, None, None, None, None) for i in range(350)]
    got = mined(spark, rows)
    assert got == plain(rows, lambda i: i % 10 == 0) and len(got) > 3000


def test_edge_rows(spark):
    rng = np.random.default_rng(8)
    rows = clustered(rng, 60, dim=4, labels=2)
    nan, inf = float("nan"), float("inf")
    rows += [
        (None, [0.1] * 4, 1, None, None, None, None), (70, None, 1, None, None, None, None), (80, [0.1] * 4, None, None, None, None, None), (90, [0.1, None, 0.2, 0.3], 1, None, None, None, None),
        (100, [0.1, nan, 0.2, 0.3], 1, None, None, None, None), (110, [inf, 0.1, 0.2, 0.3], 1, None, None, None, None), (120, [0.5, 0.5], 1, None, None, None, None), (121, [0.25, 0.5], 1, None, None, None, None),
        (122, [0.25, 0.25], 0, None, None, None, None), (130, [], 1, None, None, None, None), (131, [], 0, None, None, None, None), (140, [0.0] * 4, 1, None, None, None, None), (141, [0.0] * 4, 0, None, None, None, None),
        (150, [-0.3, -0.2, 0.1, 0.4], 5, None, None, None, None), (7, [0.9, 0.1, 0.1, 0.1], 1, None, None, None, None), (20, rows[20][1], rows[20][2], None, None, None, None), (20, [0.4] * 4, 0, None, None, None, None), (33, rows[33][1], rows[33][2], None, None, None, None),
    ]
    got = mined(spark, rows)
    assert got == plain(rows, lambda i: i % 10 == 0)
    assert {120} <= {r[0] for r in got}
    assert mined(spark, []) == []
    assert mined(spark, [(10, [0.1], 1, None, None, None, None)]) == []


def test_intervals_hold_all_products():
    rng = np.random.default_rng(2)
    a, c = rng.normal(size=(200, 8)), rng.normal(size=(300, 8)) + 0.5
    a, c = a[hard_negatives.tree_order(a)], c[hard_negatives.tree_order(c)]
    ta, tc = hard_negatives.Tree(a, np.zeros(200, np.int64)), hard_negatives.Tree(c, np.ones(300, np.int64))
    for i, (x, y) in enumerate(ta.bounds):
        for j, (s, t) in enumerate(tc.bounds):
            lo, hi = hard_negatives.interval(ta.centre[i], ta.norm[i], ta.radius[i], tc.centre[j], tc.norm[j], tc.radius[j])
            products = a[x:y] @ c[s:t].T
            assert lo <= products.min() and products.max() <= hi


def test_roots_prune_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 128)
    rng = np.random.default_rng(6)
    vectors = common.stored(hard_negatives.whole_vectors(spark.createDataFrame(clustered(rng, 2400, dim=8, spread=0.02), SCHEMA)))
    cells = hard_negatives.fit_cells(vectors)
    placed = hard_negatives.with_cell(vectors, cells)
    blocks = common.stored(hard_negatives._blocks(placed, hard_negatives._n_of(placed), False))
    asks = hard_negatives.with_cell(vectors.where("vec_id % 10 = 0"), cells).withColumn("a_key", F.lit(0).cast("long"))
    # Anchors of unit vectors (256 squared) that ask for nearly equal ones only.
    asks = asks.withColumns({"lows": F.array(F.lit(60_000.0)), "highs": F.array(F.lit(1e9))})
    open_ = hard_negatives._blocks(asks, hard_negatives._n_of(asks, 32), True)
    assert hard_negatives._open_pairs(open_, blocks, False).count() < 0.5 * open_.count() * blocks.count()
