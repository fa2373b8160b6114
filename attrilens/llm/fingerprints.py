"""Document fingerprints: quartile bucket digests of hashed byte triplets (operator 2).

Six triplets of each thirteen-byte window are hashed into buckets and counted:
one of neighbouring bytes, so short texts have some, and five wider ones, which
follow a text's own wording more than its language. A digest holds, in hex, a length code and for each bucket the quartile its count
falls in (two bits), which keeps the shape of the histogram and drops its scale.

Two digests are compared by the mean step between their bucket quartiles, set
against the mean step that independent digests with the same quartile shares
would show, so short texts (mostly empty buckets) are judged on the same scale
as long ones. Length codes add a bounded penalty. The likeness runs from 0 (no
nearer than independent digests) to 1 (equal digests).

Neighbour pairing (``with_next``) deals rows into ranges of ids, sends the first
rows of each range to the range before it too, sorts within partitions and
streams, so text is shuffled once and no range is held in memory.

Defined results: null and empty texts have the digest of no triplets, equal to
each other and at likeness 0 from any other; equal texts have equal digests;
texts under three bytes have no triplets and differ by the length code alone;
null ids come first; rows with one id are ordered by text; after the last row
comes the first; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS = 512
#: Offsets of the second and third byte of each triplet in its window.
TRIPLETS = ((1, 2), (3, 7), (4, 9), (5, 11), (6, 12), (4, 11))
REACH = max(j for _, j in TRIPLETS)
LENGTH_BASE, LENGTH_CAP, LENGTH_WEIGHT = 1.25, 16, 0.2
#: Documents for each range of ids; bins in which ids are counted at a time, which bound the ranges too.
RANGE_DOCS, COUNT_BINS = 2048, 1 << 17


def counts(data: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of hashed triplets by bucket."""
    out = np.zeros(buckets, np.int64)
    for at in range(0, max(1, len(data) - 2), 1 << 20):
        part = np.frombuffer(data, np.uint8, count=min(len(data) - at, (1 << 20) + REACH), offset=at).astype(np.uint32)
        own = min(1 << 20, len(data) - at)
        for k, (i, j) in enumerate(TRIPLETS):
            n = min(own, len(part) - j)
            if n <= 0:
                continue
            h = part[:n] * np.uint32(2654435761) + part[i : i + n] * np.uint32(2246822507) + part[j : j + n] * np.uint32(3266489909) + np.uint32(k * 668265263)
            h ^= h >> np.uint32(15)
            h *= np.uint32(739982445)
            h ^= h >> np.uint32(12)
            out += np.bincount(h % np.uint32(buckets), minlength=buckets)
    return out


def length_code(n: int) -> int:
    return min(255, int(np.log1p(n) / np.log(LENGTH_BASE)))


def digest(data: bytes, buckets: int = BUCKETS) -> str:
    """Hex digest: a byte of length, then two bits for each bucket."""
    c = counts(data, buckets)
    quartiles = np.sort(c)[[buckets // 4 - 1, buckets // 2 - 1, 3 * buckets // 4 - 1]]
    code = (c[:, None] > quartiles).sum(axis=1).astype(np.uint8).reshape(-1, 4)
    body = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    return bytes([length_code(len(data))]).hex() + body.astype(np.uint8).tobytes().hex()


def _codes(fingerprint: str) -> tuple[int, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8)
    body = raw[1:]
    return int(raw[0]), ((body[:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).astype(np.int8).ravel()


def likeness(a: str, b: str) -> float:
    """From 0 to 1; 1 for equal digests."""
    if a == b:
        return 1.0
    (la, ca), (lb, cb) = _codes(a), _codes(b)
    step = np.abs(ca - cb).mean()
    pa_, pb = np.bincount(ca, minlength=4) / len(ca), np.bincount(cb, minlength=4) / len(cb)
    chance = float(pa_ @ np.abs(np.subtract.outer(np.arange(4), np.arange(4))) @ pb)
    same = max(0.0, 1 - step / chance) if chance > 0 else 1.0
    return float(same * (1 - LENGTH_WEIGHT * min(abs(la - lb), LENGTH_CAP) / LENGTH_CAP))


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every document."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return common.arrow_map(rows, lambda b: {"doc_id": b.column(0), "fingerprint": [digest(t) for t in common.utf8(b.column(1))]}, f"doc_id {kind}, fingerprint string")


def range_starts(ids: DataFrame, range_docs: int = RANGE_DOCS, bins: int = COUNT_BINS) -> tuple[int, int | None, list[int]]:
    """(number of nulls, least id, further ids at which a range begins) for an id column, with about range_docs rows a range.

    Ids are counted in equal bins between the least and the greatest; bins that
    hold too many are cut into equal bins again. The driver sees at most
    ``bins`` sums a round.
    """
    nulls, least, most, n = ids.agg(F.count_if(F.col("id").isNull()), F.min("id"), F.max("id"), F.count("id")).first()
    if least is None:
        return nulls, None, []
    wanted = max(range_docs, n // bins)
    bins = min(bins, max(16, 16 * n // range_docs))
    done: list[tuple[int, int]] = []
    spans = [(least, most, max(1, -(-(most - least + 1) // bins)))]
    target = common.arrow_schema("k long, bin long, a long, b long, n long")
    while spans:
        # Spans of ids that are cut into bins: first id, last id, width of a bin.
        first, last = (np.array(c, np.int64) for c in list(zip(*spans))[:2])
        width = np.array([w for *_, w in spans], np.uint64)

        def counted(batches: Iterator[pa.RecordBatch], first=first, last=last, width=width) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = np.sort(batch.column(0).drop_null().to_numpy())
                k = np.searchsorted(first, v, side="right") - 1
                inside = (k >= 0) & (v <= last[k])
                v, k = v[inside], k[inside]
                at = ((v.astype(np.uint64) - first[k].astype(np.uint64)) // width[k]).astype(np.int64)
                new = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (at[1:] != at[:-1]))) if len(v) else np.zeros(0, np.int64)
                ends = np.append(new[1:], len(v)) if len(v) else new
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (k[new], at[new], v[new], v[ends - 1], ends - new)], schema=target)

        sums = ids.mapInArrow(counted, "k long, bin long, a long, b long, n long").groupBy("k", "bin").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n")).collect()
        heavy = sorted((r["a"], r["b"]) for r in sums if r["n"] > 4 * wanted and r["a"] < r["b"])
        done += [(r["a"], r["n"]) for r in sums if r["n"] <= 4 * wanted or r["a"] == r["b"]]
        each = max(2, bins // max(1, len(heavy)))
        spans = [(x, y, max(1, -(-(y - x + 1) // each))) for x, y in heavy]
    starts, held = [], 0
    for a, k in sorted(done):
        if held >= wanted:
            starts.append(a)
            held = 0
        held += k
    return nulls, least, [x for x in starts if x != least]


def with_next(docs: DataFrame, visit, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows visit((id, text), (next id, next text)) in ascending id order, the first following the last.

    visit is a factory: called once per task, it gives a function of two rows.
    Ids are integers.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    nulls, least, starts = range_starts(rows.select("id"), RANGE_DOCS)
    # Each is an id of the table, so it is the first of its range.
    bounds = np.array(starts, np.int64)
    first_is_null = bool(nulls)
    target = common.arrow_schema(schema)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            ids = batch.column(0)
            null = np.array(ids.is_null())
            v = ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            own = np.where(null, 0, np.searchsorted(bounds, v, side="right"))
            starts = ~null & (own > 0) & (v == bounds[np.maximum(own - 1, 0)]) if len(bounds) else np.zeros(len(v), bool)
            first = null if first_is_null else ~null & (v == least) if least is not None else null
            again = np.flatnonzero(starts | first)
            at = np.concatenate([np.arange(len(v)), again])
            to = np.concatenate([own, np.where(first[again], len(bounds), own[again] - 1)])
            part = batch.take(pa.array(at))
            seam = np.concatenate([np.zeros(len(v), bool), np.ones(len(again), bool)])
            yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array(seam), part.column(0), part.column(1)], names=["rng", "seam", "id", "text"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call, held = visit(), None
        for batch in common.slices(batches, "text"):
            out = []
            for rng, seam, i, text in zip(*[c.to_pylist() for c in batch.columns]):
                if held is not None and held[0] == rng and not held[1]:
                    out.append(call(held[2:], (i, text)))
                held = (rng, seam, i, text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target)

    dealt = rows.mapInArrow(deal, "rng int, seam boolean, id long, text string")
    return dealt.repartition("rng").sortWithinPartitions("rng", "seam", "id", "text").mapInArrow(stream, schema)


def _edited():
    memo: list = [None, None]

    def of(row) -> str:
        if memo[0] != row:
            memo[:] = [row, digest(row[1].encode())]
        return memo[1]

    def call(row, after):
        (i, text), (_, then) = row, after
        n = len(text)
        k = n // 4
        edited = (text[: n - k] + then[:k]).encode()
        own, changed = of(row), digest(edited)
        following = of(after)
        return i, n, hashlib.sha256(edited).hexdigest(), own, changed, likeness(own, changed), likeness(own, following)

    return call


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(common.table(spark, sf_dir, "documents"), _edited, schema)
