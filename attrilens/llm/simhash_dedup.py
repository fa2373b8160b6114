"""SimHash near-duplicate groups by pigeonhole blocks (operator 9).

A 64-bit fingerprint is cut into four blocks of 16 bits. Fingerprints at most
two bits apart agree on two blocks at least, so every close pair shares one of
the six keys made of two blocks. Fingerprints are joined on those keys and
verified by Hamming distance.

Copies collapse first: the join works on distinct fingerprints. A bucket of
more than ``pair_limit`` fingerprints is not paired: its members differ only in
the 32 bits outside the key, so each emits itself and its 32 one-bit
neighbours; two members share one of these exactly if they are at most two bits
apart, and a link to the least member of each such group joins the same
components with a linear number of rows.

``similar_groups`` goes the same way for texts that are less alike (five words,
a Jaccard similarity of 0.8): 64 bits part those badly, so fingerprints are
longer, with more blocks, and close cases are settled by the shingles.

Defined results: null and empty texts have fingerprint zero and link like any
other; equal texts are one component; rows with a null id keep their row and
take the least id of their component (null if none has one); repeated rows stay
repeated; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words of a shingle, least similarity, and the fingerprint (64-bit numbers, bits of a piece) of ``similar_groups``.
WIDTH, SIMILARITY, LONGS, PIECE_BITS = 5, 0.8, 22, 13
#: Shingles with the least hashes that tell whether a text can have a near copy, deviations of the Hamming distance that need a closer look, and most keys that go along with tasks.
LEAST, DEVIATIONS, MOST_KEYS = 20, 4.0, 500_000
#: The bits of a byte as the low bits of eight bytes.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()
PAIRS = [(i, j) for i in range(4) for j in range(i + 1, 4)]


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of the width-word shingles of an UTF-8 text, repeats included; of the whole sequence if it has fewer words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    if n == 1:
        return np.array([digest(joined, 42)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words])[:n].tolist()
    ends = (ends[width - 1 :] - 1).tolist()
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends)), np.uint64, n)


def simhash(text: bytes, width: int = 3) -> int:
    """SimHash of the width-word shingles of an UTF-8 text, as unsigned 64 bits."""
    hashes = shingle_hashes(text, width)
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 4096):
        ones += np.unpackbits(hashes[k : k + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        fps = np.array([simhash(t) for t in common.utf8(batch.column(1))], dtype=np.uint64)
        return {"doc_id": batch.column(0), "fp": pa.array(fps.view(np.int64))}

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return common.arrow_map(rows, run, f"doc_id {kind}, fp long")


def _part(fp, i: int):
    return F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))


def links(distinct: DataFrame, bits: int = 2, pair_limit: int = 16) -> DataFrame:
    """Edges (a, b) between distinct fingerprints with the components of "at most two bits apart"."""
    if bits != 2:
        raise ValueError("four blocks taken two at a time serve a bound of two bits")
    fp = F.col("fp")
    keys = F.array(*[F.struct(F.lit(k).alias("p"), (F.shiftleft(_part(fp, i), 16).bitwiseOR(_part(fp, j))).alias("bits")) for k, (i, j) in enumerate(PAIRS)])
    keyed = distinct.select("fp", F.explode(keys).alias("key")).select("fp", "key.p", "key.bits")
    shared = keyed.groupBy("p", "bits").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = common.cut(keyed.join(shared, ["p", "bits"]).select("p", "bits", "fp", "size"))
    few = met.where(F.col("size") <= pair_limit)
    left, right = few.select("p", "bits", F.col("fp").alias("a")), few.select("p", "bits", F.col("fp").alias("b"))
    near = left.join(right, ["p", "bits"]).where("a < b and bit_count(a ^ b) <= 2").select("a", "b")
    rest = F.create_map(*[x for k, (i, j) in enumerate(PAIRS) for x in (F.lit(k), F.array(*[F.lit(b - (1 << 64) if b >> 63 else b).cast("long") for b in [0] + [1 << (16 * m + n) for m in range(4) if m not in (i, j) for n in range(16)]]))])
    many = met.where(F.col("size") > pair_limit)
    flipped = many.select("p", "bits", "fp", F.explode(F.element_at(rest, F.col("p"))).alias("flip")).select("p", "bits", "fp", fp.bitwiseXOR(F.col("flip")).alias("mid"))
    least = flipped.groupBy("p", "bits", "mid").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    star = flipped.join(least, ["p", "bits", "mid"]).where("fp <> b and bit_count(fp ^ b) <= 2").select(F.col("fp").alias("a"), "b")
    return near.union(star).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pair_limit: int = 16) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id reachable by links."""
    marked = common.cut(fingerprints(docs, id_col, text_col))
    first = common.cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = common.components(links(first.select("fp"), pair_limit=pair_limit)).withColumnRenamed("node", "fp")
    rooted = first.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp", "left").select("doc_id", "fp", "component_id")


def differing_bits(similarity: float, bits: int, deviations: float = 0.0) -> int:
    """Bits in which fingerprints of two shingle sets of this Jaccard similarity differ, by the angle between sets of one size, and so many standard deviations more."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(p * bits + deviations * math.sqrt(p * (1 - p) * bits))


def wide_simhash(hashes: np.ndarray, longs: int = LONGS) -> np.ndarray:
    """A SimHash of 64 * longs bits from shingle hashes: each is drawn out to as many."""
    counts = np.zeros(64 * longs, np.int64)
    steps = (np.arange(1, longs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    for k in range(0, len(hashes), 255):
        x = hashes[k : k + 255, None] + steps
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        # Each byte becomes eight counters of a byte, which 255 rows cannot overflow.
        counts += _SPREAD[x.view(np.uint8)].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")


def pieces_of(fingerprint: np.ndarray, piece_bits: int = PIECE_BITS) -> np.ndarray:
    """A wide fingerprint as numbers of piece_bits bits."""
    bits = np.unpackbits(fingerprint.view(np.uint8), bitorder="little")
    n = len(bits) // piece_bits
    return bits[: n * piece_bits].reshape(n, piece_bits) @ (1 << np.arange(piece_bits, dtype=np.int64))


def _normal(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def _shingle_sets(docs: DataFrame, text_col: str, keys: DataFrame, width: int) -> DataFrame:
    """(key, shingles): the sorted set of shingle hashes of each text whose key is among keys."""
    n = keys.count()
    # Up to MOST_KEYS keys go along as 64-bit prefixes, so other texts are not shuffled.
    wanted = {r["k"] for r in keys.select(F.substring("key", 1, 8).alias("k")).collect()} if n <= MOST_KEYS else None

    def run(batches):
        for batch in batches:
            out = []
            for t in map(_normal, common.utf8(batch.column(0))):
                key = xxhash.xxh128_digest(t, 42)
                if wanted is None or key[:8] in wanted:
                    out.append((key, np.unique(shingle_hashes(t, width)).view(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([x for _, x in out], pa.list_(pa.int64()))], names=["key", "shingles"])

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "key binary, shingles array<long>")
    return common.stored(found.join(keys, "key", "left_semi").groupBy("key").agg(F.first("shingles").alias("shingles")))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, longs: int = LONGS, piece_bits: int = PIECE_BITS, pair_limit: int = 16) -> DataFrame:
    """(doc_id, text_hash, key, component_id): groups of texts whose sets of shingles have the given Jaccard similarity or more.

    Equal word sequences collapse first. A text goes on if half of its LEAST
    shingles with the least hashes are among those of another text (a pair at
    0.8 fails that with a chance of some 0.2 %). Fingerprints of 64 * longs bits
    are cut into pieces, and texts join on blocks of two pieces, each with the
    next three; a pair at 0.8 shares a block with a chance of 0.99. Pairs are
    verified by the Hamming distance of the whole: four deviations below the
    distance of the similarity they are linked, above four they are not, and
    between them the exact similarity of the shingle sets decides.

    In a block that over ``pair_limit`` texts share, each is compared with the
    least of them first. If the links leave the block in several components, the
    texts outside of the largest are compared with all; if these are over
    ``pair_limit`` too, the block is cut by each of its texts' other pieces and
    treated alike, and the last cut compares all pairs that are still apart.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    n_pieces = 64 * longs // piece_bits

    def run(batch: pa.RecordBatch) -> dict:
        out: dict = {"doc_id": batch.column(0), "text_hash": batch.column(2), "key": [], "fp": [], "pieces": [], "low": []}
        for t in map(_normal, common.utf8(batch.column(1))):
            hashes = shingle_hashes(t, width)
            fp = wide_simhash(hashes, longs)
            low = np.unique(hashes)[:LEAST]
            for name, x in (("key", xxhash.xxh128_digest(t, 42)), ("fp", fp), ("pieces", pieces_of(fp, piece_bits).astype(np.int32)), ("low", low.view(np.int64))):
                out[name].append(x)
        return out

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    marked = common.stored(common.arrow_map(rows, run, f"doc_id {kind}, text_hash long, key binary, fp array<long>, pieces array<int>, low array<long>"))
    first = common.stored(marked.groupBy("key").agg(F.min("doc_id").alias("first_id"), *[F.first(c).alias(c) for c in ("fp", "pieces", "low")]))
    low = first.select("key", F.size("low").alias("n_low"), F.explode("low").alias("h"))
    shared = low.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    likely = low.join(shared, "h", "left_semi").groupBy("key").agg((2 * F.count(F.lit(1)) >= F.first("n_low")).alias("ok")).where("ok").select("key")
    nodes = common.stored(first.join(likely, "key", "left_semi").select("key", "fp", "pieces"))
    fps = nodes.select("key", "fp")
    apart = F.aggregate(F.zip_with("fa", "fc", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    sure, most = (differing_bits(similarity, 64 * longs, d) for d in (-DEVIATIONS, DEVIATIONS))

    def verified(pairs: DataFrame) -> DataFrame:
        """(a, c, d) of distinct pairs that are near enough to be linked or compared."""
        both = pairs.distinct().join(fps.select(F.col("key").alias("a"), F.col("fp").alias("fa")), "a").join(fps.select(F.col("key").alias("c"), F.col("fp").alias("fc")), "c")
        return common.stored(both.select("a", "c", apart.alias("d")).where(F.col("d") <= most))

    def linked(near: DataFrame) -> DataFrame:
        """(key, root) of what sure links join."""
        return common.components(near.where(F.col("d") <= sure).select("a", F.col("c").alias("b"))).select(F.col("node").alias("key"), "root")

    def crossing(left: DataFrame, right: DataFrame) -> DataFrame:
        """Pairs of one block in different components."""
        one, other = left.select("b", F.col("key").alias("x"), F.col("root").alias("rx")), right.select("b", F.col("key").alias("y"), F.col("root").alias("ry"))
        return one.join(other, "b").where("rx <> ry").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("c"))

    piece = lambda d: F.get("pieces", (F.col("i") + d) % n_pieces)
    keyed = nodes.select("key", "pieces", F.explode(F.sequence(F.lit(0), F.lit(n_pieces - 1))).alias("i")).select("key", "i", F.explode(F.array(*[F.xxhash64("i", F.lit(d), piece(0), piece(d)) for d in (1, 2, 3)])).alias("b")).select("key", "b")
    near = roots = None
    for level in range(3):
        sizes = keyed.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least")).where("n > 1")
        found = common.stored(keyed.join(sizes, "b"))
        few, many = found.where(F.col("n") <= pair_limit), found.where(F.col("n") > pair_limit)
        pairs = few.select("b", F.col("key").alias("a")).join(few.select("b", F.col("key").alias("c")), "b").where("a < c").select("a", "c")
        met = verified(pairs.union(many.where("key <> least").select(F.col("least").alias("a"), F.col("key").alias("c"))))
        near = met if near is None else near.union(met)
        if not many.limit(1).count():
            break
        roots = common.stored(linked(near))
        rooted = common.stored(many.select("b", "key").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")))
        parts = rooted.groupBy("b", "root").agg(F.count(F.lit(1)).alias("n"))
        blocks = parts.groupBy("b").agg(F.max_by("root", F.struct("n", "root")).alias("main"), (F.sum("n") - F.max("n")).alias("outside")).where("outside > 0")
        mixed = rooted.join(blocks, "b")
        outside = mixed.where("root <> main")
        last = level == 2
        near = near.union(verified(crossing(outside if last else outside.where(F.col("outside") <= pair_limit), mixed)))
        crowded = mixed.where(F.col("outside") > pair_limit)
        if last or not crowded.limit(1).count():
            break
        keyed = crowded.select("b", "key").join(nodes.select("key", "pieces"), "key").select("key", "b", F.posexplode("pieces").alias("i", "p")).select("key", F.xxhash64("b", "i", "p").alias("b"))
    open_ = near.where(F.col("d") > sure).select("a", "c").distinct()
    if roots is not None:
        # What sure links join already needs no closer look.
        root = lambda x: roots.select(F.col("key").alias(x), F.col("root").alias(f"r{x}"))
        open_ = open_.join(root("a"), "a", "left").join(root("c"), "c", "left").where(F.coalesce("ra", "a") != F.coalesce("rc", "c")).select("a", "c")
    asked = common.stored(open_)
    sets = _shingle_sets(docs, text_col, asked.select(F.col("a").alias("key")).union(asked.select(F.col("c").alias("key"))).distinct(), width)
    side = lambda x: sets.select(F.col("key").alias(x), F.col("shingles").alias(f"s{x}"))
    both = asked.join(side("a"), "a").join(side("c"), "c")
    common_ = F.size(F.array_intersect("sa", "sc"))
    exact = both.where(common_ >= similarity * (F.size("sa") + F.size("sc") - common_)).select("a", F.col("c").alias("b"))
    ends = common.components(near.where(F.col("d") <= sure).select("a", F.col("c").alias("b")).union(exact)).withColumnRenamed("node", "key")
    rooted = first.select("key", "first_id").join(ends, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return marked.select("doc_id", "text_hash", "key").join(rooted.join(least, "root").select("key", "component_id"), "key").select("doc_id", "text_hash", "key", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """Documents that are the least id of their group of similar texts; columns as in docs.

    Repeated rows of the kept document (its id and its text) all stay; a row of
    the same id and another text goes with its own group. Rows with a null id
    stay only if no row of their group has an id.
    """
    groups = similar_groups(docs, id_col, text_col, **parameters)
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept_id"), F.col("text_hash").alias("_kept_text")).distinct()
    same_text = F.xxhash64(docs[text_col].cast("string")) == kept["_kept_text"]
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_kept_id"]) & same_text, "left_semi")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(common.table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
