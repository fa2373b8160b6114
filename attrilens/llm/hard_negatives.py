"""Hard negatives by dual-tree search (operator 13).

A splitting tree fitted on a bounded sample deals every vector to a cell; cells
are cut into blocks of bounded bytes, and each block is a balanced ball tree
(centre, radius and label mask of each node). Anchors form blocks of their own
in the same way. Two nodes bound all inner products between them by an
interval, so a pair of nodes is dropped for its whole group of anchors at once
when the interval misses what every one of them still asks for. Blocks of one
cell meet first, which gives each anchor a bound from below; other pairs of
blocks meet only if the interval of their roots passes it. Within a pair of
blocks the two trees are descended together, and leaf pairs that are left are
scored exactly, the most promising first, with bounds that rise as hits come in.

An anchor asks through windows: (low, high, k) wants the first k scores from
low to high. Positives are the window of all scores among rows of the same
label; every positive then opens one window among rows of other labels.

Scores are exact while they stay below 2**53. Defined results: rows with a null
id, label or vector, or a null or non-finite component, take no part; vectors
of different length do not meet; rows that share the anchor's id are not
"other" rows; an anchor row that is repeated counts once, any other repeated
row as often as it stands; ties go by the smaller id; an anchor without
positives, and a positive whose window is empty, give no rows; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Vectors that the splitting tree is fitted on, most bytes of a block's vectors, most rows of a block, of a leaf, and of a block of anchors.
SAMPLE, BLOCK_BYTES, BLOCK_ROWS, LEAF_ROWS, ASK_ROWS = 8192, 4 << 20, 8192, 64, 1024
#: Positives of an anchor, negatives of a positive, and the least and greatest share of the positive's score in hundredths.
POSITIVES, NEGATIVES, LEAST, GREATEST = 5, 10, 30, 90
#: Root summaries compared in one step.
SUMMARIES = 1024


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label", scale: int = 256) -> DataFrame:
    """(vec_id, label, v, dim, salt) of the rows that take part; components become floor(scale * x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            lists = batch.column("v")
            sizes = np.diff(lists.offsets.to_numpy())
            x = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            row = np.repeat(np.arange(len(sizes)), sizes)
            good = np.bincount(row[~np.isfinite(x)], minlength=len(sizes)) == 0
            kept = pa.array(np.flatnonzero(good))
            sizes_kept = sizes[good]
            v = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes_kept)]).astype(np.int32)), pa.array(x[good[row]]))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(kept), batch.column("label").take(kept), v, pa.array(sizes_kept.astype(np.int32)), pa.array(at + np.arange(len(sizes_kept)))], names=["vec_id", "label", "v", "dim", "salt"])
            at += len(sizes_kept)

    found = rows.select(F.col(id_col).cast("long").alias("vec_id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    return found.where("vec_id is not null and label is not null and v is not null").mapInArrow(run, "vec_id long, label long, v array<double>, dim int, salt long")


def _halves(v: np.ndarray) -> np.ndarray:
    """Places of rows along the line between two far rows."""
    a = v[np.argmax(((v - v.mean(axis=0)) ** 2).sum(axis=1))]
    b = v[np.argmax(((v - a) ** 2).sum(axis=1))]
    return b - a


class Cells:
    """Splitting tree over vectors of one length: a cell number for each vector."""

    def __init__(self, sample: np.ndarray, n_cells: int):
        self.nodes: list[tuple] = []
        self.n = 0
        self._split(sample, n_cells)

    def _split(self, v: np.ndarray, n_cells: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if n_cells > 1 and len(v) >= 64:
            line = _halves(v)
            place = v @ line
            middle = np.sort(place)[int(0.3 * len(v)) : int(0.7 * len(v)) + 1]
            cut = middle[np.argmax(np.diff(middle))]  # the widest gap keeps clusters whole
            low = place <= cut
            if 0 < low.sum() < len(v):
                self.nodes[at] = (line, cut, self._split(v[low], n_cells // 2), self._split(v[~low], n_cells - n_cells // 2))
                return at
        self.nodes[at] = (self.n,)
        self.n += 1
        return at

    def of(self, v: np.ndarray) -> np.ndarray:
        out = np.zeros(len(v), np.int64)
        open_ = [(0, np.arange(len(v)))]
        while open_:
            at, rows = open_.pop()
            node = self.nodes[at]
            if len(node) == 1:
                out[rows] = node[0]
                continue
            line, cut, left, right = node
            low = v[rows] @ line <= cut
            open_ += [(left, rows[low]), (right, rows[~low])]
        return out


def block_rows(dim: int) -> int:
    return max(LEAF_ROWS, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, dim))))


def fit_cells(rows: DataFrame) -> dict[int, Cells]:
    """A splitting tree for each length of vectors, from at most SAMPLE vectors and some 16 MB."""
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).limit(64).collect()}
    if not sizes:
        return {}
    limit = max(64, min(SAMPLE, (16 << 20) // (8 * max(1, *sizes))))
    got = common.hashed_below(rows, limit, "vec_id", "v").orderBy("h").limit(limit).select("v").collect()
    by_dim: dict[int, list] = {}
    for r in got:
        by_dim.setdefault(len(r["v"]), []).append(r["v"])
    return {d: Cells(np.array(v, np.float64).reshape(len(v), d), min(-(-sizes.get(d, 1) // block_rows(d)), len(v) // 32)) for d, v in by_dim.items()}


def with_cell(rows: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """rows with cell: the vector's length and its place in the splitting tree of that length (0 where none was fitted)."""
    shared = rows.sparkSession.sparkContext.broadcast(cells)  # at most SAMPLE / 32 planes a length, 64 lengths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
            lists, cell = batch.column(batch.schema.get_field_index("v")), dims.astype(np.int64) << 32
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                if d and int(d) in shared.value:
                    v = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)
                    cell[at] += shared.value[int(d)].of(v)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(run, f"{schema}, cell long")


class Tree:
    """Balanced ball tree over rows in tree order: node i has children 2i + 1 and 2i + 2, and each node is a range of rows."""

    def __init__(self, v: np.ndarray, labels: np.ndarray):
        n = len(v)
        self.depth = max(0, int(np.ceil(np.log2(max(1, n) / LEAF_ROWS))))
        bounds = [(0, n)]
        for _ in range(self.depth):
            bounds += [x for a, b in bounds[len(bounds) // 2 :] for x in ((a, (a + b) // 2), ((a + b) // 2, b))]
        self.bounds = np.array(bounds)
        self.centre = np.array([v[a:b].mean(axis=0) if b > a else np.zeros(v.shape[1]) for a, b in bounds]).reshape(len(bounds), v.shape[1])
        self.radius = np.sqrt([((v[a:b] - c) ** 2).sum(axis=1).max(initial=0.0) for (a, b), c in zip(bounds, self.centre)])
        self.norm = np.sqrt((self.centre**2).sum(axis=1))
        bits = np.left_shift(np.uint64(1), (labels & 63).astype(np.uint64))
        self.mask = np.array([np.bitwise_or.reduce(bits[a:b]) if b > a else 0 for a, b in bounds], np.uint64)
        self.first_leaf = (1 << self.depth) - 1


def tree_order(v: np.ndarray) -> np.ndarray:
    """An order of the rows in which each node's range falls into two near halves."""
    order = np.arange(len(v))
    open_ = [(0, len(v), max(0, int(np.ceil(np.log2(max(1, len(v)) / LEAF_ROWS)))))]
    while open_:
        a, b, depth = open_.pop()
        mid = (a + b) // 2
        if depth and a < mid < b:
            part = v[order[a:b]]
            order[a:b] = order[a:b][np.argpartition(part @ _halves(part), mid - a)]
        if depth:
            open_ += [(a, mid, depth - 1), (mid, b, depth - 1)]
    return order


def interval(ac, an, ar, cc, cn, cr) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products between two balls (centres, their norms, radii), with room for rounding."""
    mid = (ac * cc).sum(axis=-1)
    wide = an * cr + ar * cn + ar * cr
    wide = wide + 1e-9 * (wide + an * cn) + 1e-9
    return mid - wide, mid + wide


_BLOCK = "cell long, sub long, ids binary, labels binary, v binary, centre array<double>, radius double, mask long"
_ASKS = "a_keys binary, lows binary, highs binary, low double, high double"


def _blocks(rows: DataFrame, n_of: DataFrame, asks: bool) -> DataFrame:
    """Rows with cell and salt as blocks in tree order; n_of tells into how many a cell is cut."""
    schema = f"{_BLOCK}, {_ASKS}" if asks else _BLOCK
    target = common.arrow_schema(schema)

    def build(table: pa.Table) -> pa.Table:
        n, dim = table.num_rows, table.column("dim")[0].as_py()
        flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        v = flat("v") if dim else np.zeros((n, 0))
        order = tree_order(v)
        v = np.ascontiguousarray(v[order])
        ids, labels = (table.column(c).to_numpy()[order] for c in ("vec_id", "label"))
        centre = v.mean(axis=0)
        out = {
            "cell": table.column("cell")[0].as_py(), "sub": table.column("sub")[0].as_py(), "ids": ids.tobytes(), "labels": labels.tobytes(), "v": v.tobytes(),
            "centre": centre.tolist(), "radius": float(np.sqrt(((v - centre) ** 2).sum(axis=1).max())), "mask": int(np.bitwise_or.reduce(np.left_shift(np.uint64(1), (labels & 63).astype(np.uint64))).view(np.int64)),
        }
        if asks:
            lows, highs = flat("lows")[order], flat("highs")[order]
            out |= {"a_keys": table.column("a_key").to_numpy()[order].tobytes(), "lows": lows.tobytes(), "highs": highs.tobytes(), "low": float(lows.min()), "high": float(highs.max())}
        return pa.Table.from_pylist([out], schema=target)

    cut = rows.join(F.broadcast(n_of), "cell").withColumn("sub", F.pmod(F.xxhash64("salt", "vec_id"), F.col("n_sub")))
    return cut.groupBy("cell", "sub").applyInArrow(build, schema)


def _n_of(rows: DataFrame, most: int | None = None) -> DataFrame:
    """(cell, n_sub): a row for each cell, at most SAMPLE / 32 a length of vectors."""
    per_dim = F.greatest(F.lit(LEAF_ROWS), F.least(F.lit(BLOCK_ROWS), F.floor(F.lit(BLOCK_BYTES) / (8 * F.greatest(F.lit(1), F.first("dim"))))))
    bound = F.least(F.lit(most), per_dim) if most else per_dim
    return rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / bound).alias("n_sub"))


class _Asks:
    """An anchors' block: its tree, and the windows that are still open."""

    def __init__(self, row: dict):
        self.ids, self.keys, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "a_keys", "labels"))
        n = len(self.ids)
        self.v = np.frombuffer(row["v"]).reshape(n, -1)
        self.lows, self.highs = (np.frombuffer(row[c]).reshape(n, -1).copy() for c in ("lows", "highs"))
        self.tree = Tree(self.v, self.labels)


def meet(asks: _Asks, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, ...]:
    """(place of the anchor, window, id, score) of the first k of each window in one block, by descending both trees."""
    a, c = asks.tree, Tree(v, labels)
    n_windows = asks.lows.shape[1]
    low = np.array([asks.lows[x:y].min(initial=np.inf) for x, y in a.bounds])
    high = np.array([asks.highs[x:y].max(initial=-np.inf) for x, y in a.bounds])
    left, right = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(max(a.depth, c.depth) + 1):
        lo, hi = interval(a.centre[left], a.norm[left], a.radius[left], c.centre[right], c.norm[right], c.radius[right])
        open_ = (hi >= low[left]) & (lo <= high[left])
        if same:
            open_ &= (a.mask[left] & c.mask[right]) != 0
        left, right, hi = left[open_], right[open_], hi[open_]
        if level < a.depth:
            left, right = np.concatenate([2 * left + 1, 2 * left + 2]), np.tile(right, 2)
        if level < c.depth:
            left, right = np.tile(left, 2), np.concatenate([2 * right + 1, 2 * right + 2])
    found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    if not len(left):
        return tuple(found)
    order = np.lexsort((-hi, left))
    left, right, hi = left[order], right[order], hi[order]
    starts = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]]))
    out = []
    for s, e in zip(starts, [*starts[1:], len(left)]):
        x, y = a.bounds[left[s]]
        lows, highs, hits = asks.lows[x:y], asks.highs[x:y], found
        for t in range(s, e, 16):
            leaves = right[t : min(e, t + 16)][hi[t : min(e, t + 16)] >= lows.min()]
            if not len(leaves):
                break
            at = np.concatenate([np.arange(*c.bounds[j]) for j in leaves])
            scores = asks.v[x:y] @ v[at].T
            fits = asks.labels[x:y, None] == labels[at] if same else asks.labels[x:y, None] != labels[at]
            if same:
                fits &= asks.ids[x:y, None] != ids[at]
            new = [hits]
            for w in range(n_windows):
                i, j = np.nonzero(fits & (scores >= lows[:, w, None]) & (scores <= highs[:, w, None]))
                new.append([i, np.full(len(i), w), ids[at[j]], scores[i, j]])
            i, w, other, score = (np.concatenate(z) for z in zip(*new))
            order = np.lexsort((other, -score, w, i))
            key = (i * n_windows + w)[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))[: len(key)]
            place = np.arange(len(key)) - np.repeat(first, np.diff([*first, len(key)]))
            kept = order[place < k]
            last = order[place == k - 1]
            lows[i[last], w[last]] = np.maximum(lows[i[last], w[last]], score[last])
            hits = [i[kept], w[kept], other[kept], score[kept]]
        out.append([hits[0] + x, *hits[1:]])
    return tuple(np.concatenate(z) for z in zip(*out))


_HITS = "anchor_id long, a_key long, window int, other_id long, score double"


def _searched(pairs: DataFrame, k: int, same: bool) -> DataFrame:
    """Hits of rows that hold a block of anchors (a) and a block of candidates (c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, c = (batch.column(side)[i].as_py() for side in ("a", "c"))
                asks, ids = _Asks(a), np.frombuffer(c["ids"], np.int64)
                at, window, other, score = meet(asks, ids, np.frombuffer(c["labels"], np.int64), np.frombuffer(c["v"]).reshape(len(ids), -1), k, same)
                yield pa.RecordBatch.from_arrays([pa.array(asks.ids[at]), pa.array(asks.keys[at]), pa.array(window.astype(np.int32)), pa.array(other), pa.array(score)], names=["anchor_id", "a_key", "window", "other_id", "score"])

    return pairs.select("a", "c").mapInArrow(run, _HITS)


def _first(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("anchor_id", "a_key", "window").orderBy(F.desc("score"), "other_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _open_pairs(asks: DataFrame, blocks: DataFrame, same: bool) -> DataFrame:
    """(a_cell, a_sub, cell, sub): pairs of blocks of different cells whose roots' interval passes a window."""
    n = max(1, -(-blocks.count() // SUMMARIES))
    roots = blocks.select(F.pmod(F.xxhash64("cell", "sub"), F.lit(n)).alias("part"), F.struct("cell", "sub", "centre", "radius", "mask").alias("root"))
    parts = roots.groupBy("part").agg(F.collect_list("root").alias("roots"))  # about SUMMARIES a row
    asking = asks.select("cell", "sub", "centre", "radius", "mask", "low", "high", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                others = [x for x in r["roots"] if x["cell"] != r["cell"] and len(x["centre"]) == len(r["centre"]) and (not same or x["mask"] & r["mask"])]
                if not others:
                    continue
                c, a = np.array([x["centre"] for x in others]).reshape(len(others), -1), np.array(r["centre"])
                lo, hi = interval(a, np.sqrt((a * a).sum()), r["radius"], c, np.sqrt((c * c).sum(axis=1)), np.array([x["radius"] for x in others]))
                met = [x for x, ok in zip(others, (hi >= r["low"]) & (lo <= r["high"])) if ok]
                yield pa.RecordBatch.from_pylist([{"a_cell": r["cell"], "a_sub": r["sub"], "cell": x["cell"], "sub": x["sub"]} for x in met], schema=target)

    target = common.arrow_schema("a_cell long, a_sub long, cell long, sub long")
    return asking.join(parts, "part").drop("part").mapInArrow(run, "a_cell long, a_sub long, cell long, sub long")


def search(asks: DataFrame, blocks: DataFrame, k: int, same: bool) -> DataFrame:
    """(anchor_id, a_key, window, other_id, score, rank): the first k of each window of each anchor.

    asks: (vec_id, a_key, label, v, dim, salt, cell, lows, highs); blocks of candidates as ``_blocks`` makes them.
    """
    sides = lambda a, c, on: a.join(c, on).select("a", "c")
    packed = lambda df, name, *keys: df.select(*[F.col(x).alias(y) for x, y in keys], F.struct(*[c for c in ("ids", "a_keys", "labels", "v", "lows", "highs") if c in df.columns]).alias(name))
    n_of = common.cut(_n_of(asks, ASK_ROWS))
    theirs = packed(blocks, "c", ("cell", "cell"), ("sub", "sub"))
    # Neighbours of the own cell first.
    own = packed(_blocks(asks, n_of, True), "a", ("cell", "cell"))
    near = common.stored(_first(_searched(sides(own, theirs, "cell"), k, same), k))
    full = near.where(F.col("rank") == k).select("anchor_id", "a_key", F.struct("window", "score").alias("w"))
    best = full.groupBy("anchor_id", "a_key").agg(F.map_from_entries(F.collect_list("w")).alias("best"))  # a row a window at most
    raised = asks.join(best, (asks["vec_id"] == best["anchor_id"]) & asks["a_key"].eqNullSafe(best["a_key"]), "left").select(*[asks[c] for c in asks.columns if c != "lows"], F.transform("lows", lambda x, i: F.greatest(x, F.coalesce(F.element_at("best", i), F.lit(float("-inf"))))).alias("lows"))
    open_ = common.stored(_blocks(raised, n_of, True))
    pairs = _open_pairs(open_, blocks, same)
    met = pairs.join(packed(open_, "a", ("cell", "a_cell"), ("sub", "a_sub")), ["a_cell", "a_sub"])
    far = _searched(sides(met, theirs, ["cell", "sub"]), k, same)
    return _first(near.drop("rank").union(far), k)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, greatest: int = GREATEST) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from ``whole_vectors`` and some of its rows.

    A negative's score is from least to greatest hundredths of the positive's.
    """
    cells = fit_cells(rows)
    placed = with_cell(rows, cells)
    blocks = common.stored(_blocks(placed, common.cut(_n_of(placed)), False))
    keyed = anchors.select("vec_id", "label", "v", "dim").distinct().withColumn("a_key", F.xxhash64("label", "v"))
    asks = common.stored(with_cell(keyed.withColumn("salt", F.col("a_key")), cells))
    window = lambda x: F.array(F.lit(float(x)))
    first = common.stored(search(asks.withColumns({"lows": window("-inf"), "highs": window("inf")}), blocks, positives, True))
    of = F.sort_array(F.collect_list(F.struct("rank", "score")))  # at most `positives`
    bound = lambda share, empty: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(share * F.get("p", i)["score"] / 100, F.lit(float(empty))))
    windows = first.groupBy("anchor_id", "a_key").agg(of.alias("p")).select(F.col("anchor_id").alias("vec_id"), "a_key", bound(least, "inf").alias("lows"), bound(greatest, "-inf").alias("highs"))
    found = search(asks.join(windows, ["vec_id", "a_key"]), blocks, negatives, False)
    wanted = first.select("anchor_id", "a_key", (F.col("rank") - 1).alias("window"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(wanted, ["anchor_id", "a_key", "window"]).select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), F.col("positive_score").cast("long").alias("positive_score"), F.col("score").cast("long").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings")
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    vectors = common.stored(whole_vectors(rows, label=label))
    return mine(vectors, vectors.where("vec_id % 100 = 0"))


OP13_SQL = f"""
WITH vectors AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (SELECT a.vec_id AS anchor_id, a.label AS a_label, a.v AS a_v, r.vec_id, r.label, list_dot_product(a.v, r.v) AS score FROM (SELECT DISTINCT vec_id, label, v FROM vectors WHERE vec_id % 100 = 0) a JOIN vectors r ON len(a.v) = len(r.v)),
positives AS (SELECT *, row_number() OVER (PARTITION BY anchor_id, a_label, a_v ORDER BY score DESC, vec_id) AS p FROM scored WHERE label = a_label AND vec_id <> anchor_id QUALIFY p <= {POSITIVES}),
negatives AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.a_label, p.a_v, p.p ORDER BY n.score DESC, n.vec_id) AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND p.a_label = n.a_label AND p.a_v = n.a_v AND n.label <> p.a_label AND 100 * n.score BETWEEN {LEAST} * p.score AND {GREATEST} * p.score QUALIFY rank <= {NEGATIVES})
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, CAST(positive_score AS BIGINT) AS positive_score, CAST(negative_score AS BIGINT) AS negative_score FROM negatives
"""
