"""Exact nearest neighbours by cosine, and the context they render to.

Vectors are dealt to cells by the nearest of some sampled pivots, and cells are
cut into blocks of bounded bytes. A block has a centre and a radius, so the
triangle inequality bounds the cosine between two blocks from above. Queries
meet the blocks of their own cell first, which gives each its k-th best so far;
of the other pairs of blocks only those meet whose bound reaches the least of
these. One matrix product for each tile of a pair gives its scores, and only its
best k go on. The k best of all blocks are a rank limit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import maths, text
from ..sources import scratch


def neighbours_small(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int, most_rows: int = 20_000, exclude_self: bool = True) -> DataFrame:
    """J15 for a corpus of at most most_rows vectors, in the JVM: every row meets the broadcast corpus."""
    if corpus.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"over {most_rows} vectors: use neighbours()")
    a = queries.select(F.col(key).alias("query"), maths.unit(F.col(vector)).alias("a"))
    b = F.broadcast(corpus.select(F.col(key).alias("neighbour"), maths.unit(F.col(vector)).alias("b")))
    pairs = a.join(b, F.col("query") != F.col("neighbour")) if exclude_self else a.crossJoin(b)
    return _best(pairs.select("query", "neighbour", maths.dot(F.col("a"), F.col("b")).alias("score")), k)


def _best(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("score"), "neighbour")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Most bytes of a block's vectors, most pivots and most of their bytes, and summaries compared in one step.
BLOCK_BYTES, PIVOTS, PIVOT_BYTES, SUMMARIES = 4 << 20, 1024, 8 << 20, 1024
#: Most bytes of the scores of a tile, of which a task holds a few copies.
TILE_BYTES = 16 << 20


def tile_rows(columns: int, tile: int) -> int:
    """Queries that meet so many vectors at once."""
    return max(1, min(tile, TILE_BYTES // (8 * max(1, columns))))


def _unit_rows(lists: pa.Array) -> np.ndarray:
    m = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _pivots(rows: DataFrame, vector: str, n: int, dim: int) -> np.ndarray:
    """About n unit vectors with the least hashes, a bounded sample."""
    limit = max(1, min(n, PIVOTS, PIVOT_BYTES // (8 * dim)))
    found = rows.select(F.xxhash64(vector).alias("h"), vector).orderBy("h").limit(limit).select(vector).collect()
    m = np.array([r[0] for r in found], np.float64).reshape(len(found), dim)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _in_cells(df: DataFrame, key: str, vector: str, pivots: np.ndarray) -> DataFrame:
    """(key, v, cell): the number of the nearest pivot."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            cell = np.argmax(_unit_rows(batch.column(1)) @ pivots.T, axis=1) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=["key", "v", "cell"])

    return df.select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("v")).mapInArrow(run, f"key {kind}, v array<float>, cell int")


def _blocks(cells: DataFrame, rows: int) -> DataFrame:
    """Blocks (cell, part, rows, centre, radius) of about so many rows at most."""
    kind = cells.schema["key"].dataType.simpleString()
    n_parts = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / rows).alias("n"))  # a row a pivot
    dealt = cells.join(F.broadcast(n_parts), "cell").withColumn("part", F.pmod(F.xxhash64("key"), F.col("n")))
    packed = dealt.groupBy("cell", "part").agg(F.collect_list(F.struct("key", "v")).alias("rows"))

    def run(batches):
        for batch in batches:
            balls = []
            for r in batch.column(2):
                unit = _unit_rows(r.values.field("v"))
                centre = unit.mean(axis=0)
                balls.append((centre.tolist(), float(np.sqrt(((unit - centre) ** 2).sum(axis=1).max()))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c for c, _ in balls], pa.list_(pa.float64())), pa.array([r for _, r in balls])], names=["cell", "part", "rows", "centre", "radius"])

    return packed.mapInArrow(run, f"cell int, part long, rows array<struct<key:{kind},v:array<float>>>, centre array<double>, radius double")


def cosine_bound(centre: np.ndarray, radius: float, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Greatest cosine between unit vectors of two balls: they are no nearer than the centres less both radii."""
    apart = np.maximum(np.linalg.norm(centres - centre, axis=1) - radius - radii - 1e-9, 0)
    return 1 - apart**2 / 2


def _open_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (q_cell, q_part, cell, part) of blocks of different cells whose bound reaches the queries' least k-th score."""
    n = max(1, -(-right.count() // SUMMARIES))
    balls = right.select(F.pmod(F.xxhash64("cell", "part"), F.lit(n)).alias("chunk"), F.struct("cell", "part", "centre", "radius").alias("ball"))
    chunks = balls.groupBy("chunk").agg(F.collect_list("ball").alias("balls"))  # about SUMMARIES a row
    asking = left.select("cell", "part", "centre", "radius", "least", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("chunk"))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                others = [x for x in r["balls"] if x["cell"] != r["cell"]]
                if others:
                    bound = cosine_bound(np.array(r["centre"]), r["radius"], np.array([x["centre"] for x in others]), np.array([x["radius"] for x in others]))
                    met = [x for x, ok in zip(others, bound >= r["least"]) if ok]
                    yield pa.RecordBatch.from_arrays([pa.array([v] * len(met) if not isinstance(v, list) else v, t) for v, t in ((r["cell"], pa.int32()), (r["part"], pa.int64()), ([x["cell"] for x in met], pa.int32()), ([x["part"] for x in met], pa.int64()))], names=["q_cell", "q_part", "cell", "part"])

    return asking.join(chunks, "chunk").drop("chunk").mapInArrow(run, "q_cell int, q_part long, cell int, part long")


def neighbours(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int, block_bytes: int = BLOCK_BYTES, tile: int = 1024, exclude_self: bool = True, skipped: list | None = None) -> DataFrame:
    """(query, neighbour, score, rank), exact; scores in double precision, ties by neighbour.

    Blocks hold block_bytes of vectors at most (a vector at least), so a row of
    two blocks is bounded whatever the dimension; of smaller tables there are
    blocks enough for the session's parallelism. If skipped is a list, the number
    of pairs of blocks that met and of all pairs are added to it.
    """
    kind = queries.schema[key].dataType.simpleString()
    n_corpus, dim = corpus.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(vector)), F.lit(1))).first()
    fitting = max(1, block_bytes // (4 * max(1, dim)))
    # A corpus of one block has no pairs to skip; its queries still make a block for each task.
    single = n_corpus <= fitting
    per_block = max(1, min(fitting, -(-max(1, n_corpus) // queries.sparkSession.sparkContext.defaultParallelism)))
    pivots = _pivots(corpus, vector, 1 if single else -(-n_corpus // fitting), dim)
    if not len(pivots):
        return queries.sparkSession.createDataFrame([], f"query {kind}, neighbour {kind}, score double, rank int")
    keep = (lambda df: df) if single else scratch.stored
    right = keep(_blocks(_in_cells(corpus, key, vector, pivots), fitting))
    asked = keep(_in_cells(queries, key, vector, pivots))

    def score(batches):
        for batch in batches:
            for q, c in zip(batch.column("q"), batch.column("c")):
                queried, keys = q.values.field("key"), c.values.field("key")
                qs, cs = _unit_rows(q.values.field("v")), _unit_rows(c.values.field("v"))
                places: dict = {}
                for j, x in enumerate(keys.to_pylist() if exclude_self else ()):
                    places.setdefault(x, []).append(j)
                step = tile_rows(len(cs), tile)
                for at in range(0, len(qs), step):
                    s = qs[at : at + step] @ cs.T
                    own = [(i, j) for i, x in enumerate(queried.slice(at, step).to_pylist()) for j in places.get(x, ())]
                    if own:
                        s[tuple(zip(*own))] = -np.inf
                    n = min(k, s.shape[1])
                    # All that tie with the k-th best go on, so ties are settled by neighbour later.
                    least = np.partition(s, -n, axis=1)[:, -n]
                    i, j = np.nonzero((s >= least[:, None]) & (s > -np.inf))
                    yield pa.RecordBatch.from_arrays([queried.take(pa.array(at + i)), keys.take(pa.array(j)), pa.array(s[i, j])], names=["query", "neighbour", "score"])

    def scored(pairs: DataFrame) -> DataFrame:
        return pairs.select("q", "c").mapInArrow(score, f"query {kind}, neighbour {kind}, score double")

    blocks = _blocks(asked, per_block)
    near = keep(_best(scored(blocks.select("cell", F.col("rows").alias("q")).join(right.select("cell", F.col("rows").alias("c")), "cell")), k))
    if single:
        return near
    # The k-th best of each query so far; none where fewer were found.
    kth = near.where(F.col("rank") == k).select(F.col("query").alias("key"), "score").groupBy("key").agg(F.min("score").alias("score"))
    parts = blocks.select("cell", "part", "centre", "radius", F.explode("rows.key").alias("key")).join(kth, "key", "left")
    left = parts.groupBy("cell", "part").agg(F.first("centre").alias("centre"), F.first("radius").alias("radius"), F.min(F.coalesce("score", F.lit(-2.0))).alias("least"))
    # A hair below, for rounding of equal scores.
    pairs = scratch.stored(_open_pairs(left.withColumn("least", F.col("least") - 1e-9), right.select("cell", "part", "centre", "radius")))
    if skipped is not None:
        per_cell = right.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        n_left, n_right = left.count(), right.count()
        own = left.join(per_cell, "cell").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        skipped += [pairs.count() + own, n_left * n_right]
    met = pairs.join(blocks.select(F.col("cell").alias("q_cell"), F.col("part").alias("q_part"), F.col("rows").alias("q")), ["q_cell", "q_part"])
    far = scored(met.join(right.select("cell", "part", F.col("rows").alias("c")), ["cell", "part"]))
    return _best(near.drop("rank").union(far), k)


def positive(neighbour_rows: DataFrame) -> DataFrame:
    """Neighbours with a score above zero."""
    return neighbour_rows.where("score > 0")


def contexts(neighbour_rows: DataFrame, corpus: DataFrame, key: str, author: str, quote: str, labelled: bool = True) -> DataFrame:
    """One context a query; a query's neighbours are at most k."""
    found = positive(neighbour_rows).join(corpus.select(F.col(key).alias("neighbour"), F.col(author).cast("string").alias("author"), F.col(quote).alias("quote")), "neighbour")
    items = F.sort_array(F.collect_list(F.struct("rank", "author", "score", "quote")))
    return found.groupBy("query").agg(items.alias("items")).select("query", text.render_context(F.col("items"), labelled).alias("context"))
