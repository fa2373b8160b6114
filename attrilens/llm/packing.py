"""Best-fit packing of token pieces by swap-based local search (operator 3).

Documents are tokenised in Arrow batches and cut into pieces of at most
``capacity`` ids. Only pieces (a few numbers each) are shuffled: they are dealt
by hash into groups of a bounded expected size (full pieces are sequences of
their own and go through no group). Each group is packed best-fit
decreasing, then a local search over its underfull bins exchanges one document
for one, two for one, or moves a document, taking steps that raise the sum of
squared fills, until bins empty or no step is left. A second round gathers every bin with free
space of each few groups and searches those again, from a new packing of their
pieces if that has fewer bins, so the loss at group borders shrinks by that factor.

Defined results: null and empty texts are one piece, the closing id alone;
repeated rows are packed each on their own; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
#: Expected pieces in a group of the first round, and groups gathered in the second.
GROUP_PIECES, GATHER = 4096, 16

_ENCODERS: dict = {}


class ByteEncoder:
    """The byte-level vocabulary: its ranks, and its tokenizers file for texts that the ranks' splitter gives up on.

    The splitter has a bounded stack, which about a million white-space
    characters in a row exhaust. Ids are equal either way.
    """

    def __init__(self, path: str | None = None, whole: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("bytes50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})
        self.whole = whole or public_tokenizers.path("byte_bpe_50k.json")

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.ranks.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            from tokenizers import Tokenizer

            return np.array(Tokenizer.from_file(self.whole).encode(text, add_special_tokens=False).ids, np.uint32)


def byte_encoder(path: str | None = None) -> ByteEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteEncoder(path)
    return _ENCODERS[path]


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the first takes the remainder."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, line) of every document; line tells pieces of a task apart."""
    kind = docs.schema[id_col].dataType.simpleString()
    target = common.arrow_schema(f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, line long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, line = byte_encoder(vocabulary).encode, 0
        for batch in common.slices(batches, "text"):
            source, rows = [], []
            for row, text in enumerate(common.strings(batch.column(1))):
                ids = np.append(encode(text), 0).astype("<u4")
                for k, (s, n) in enumerate(cut_points(len(ids), capacity)):
                    source.append(row)
                    rows.append((k, s, n, zlib.crc32(ids[s : s + n].tobytes()), line))
                    line += 1
            columns = [batch.column(0).take(pa.array(source, pa.int64())), *[pa.array(v, f.type) for v, f in zip(zip(*rows), list(target)[1:])]]
            yield pa.RecordBatch.from_arrays(columns, schema=target)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, line long")


class Bins:
    """Bins of item lengths with a best-fit index over the free space."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.free, self.order = capacity, [], [], []

    def add(self, item: int, n: int) -> None:
        """Best fit: the fullest bin with room, else a new one."""
        k = bisect_left(self.order, (n, -1))
        if k < len(self.order):
            _, b = self.order.pop(k)
            self.items[b].append(item)
            self.free[b] -= n
        else:
            b = len(self.items)
            self.items.append([item])
            self.free.append(self.capacity - n)
        if self.free[b]:
            insort(self.order, (self.free[b], b))


def _next_sums(sizes: list[int], capacity: int) -> np.ndarray:
    """For each length up to capacity the least one not below it that none, one or two of the sizes add up to."""
    kinds, copies = np.unique(np.asarray(sizes, np.int64), return_counts=True)
    both = np.add.outer(kinds, kinds)
    both = np.concatenate([both[np.triu_indices(len(kinds), 1)], 2 * kinds[copies > 1]])
    out = np.full(capacity + 1, 2 * capacity + 1, np.int32)
    for sums in ([0], kinds, both):
        out[sums] = sums
    return np.minimum.accumulate(out[::-1])[::-1]


def _that_add_up(items: list[int], lengths: list[int], total: int) -> list[int]:
    """None, one or two of the items whose lengths add up to total."""
    if not total:
        return []
    seen: dict[int, int] = {}
    for j in items:
        if lengths[j] == total:
            return [j]
    for j in items:
        if total - lengths[j] in seen:
            return [seen[total - lengths[j]], j]
        seen[lengths[j]] = j
    raise ValueError(total)


def local_search(lengths: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Raise the sum of squared fills over underfull bins until bins empty or no step helps.

    The emptiest bin gives: one of its documents moves to a bin with room, goes
    in for a shorter one that comes back, or goes in for two that together are
    shorter. A step is taken only if it raises the sum of squared fills, which
    holds exactly if the bin that gains ends fuller than the giving bin was.
    The search ends when the bins reach the bound that the total length sets, or
    every underfull bin has been tried in vain since the last step. A bin tried
    in vain is tried again only if a step changed it or a bin that it can give to.
    """
    # Full bins neither give nor gain.
    loads = [sum(lengths[i] for i in b) for b in bins]
    done = [list(b) for b, n in zip(bins, loads) if n >= capacity]
    held = [list(b) for b, n in zip(bins, loads) if n < capacity]
    fill = np.array([n for n in loads if n < capacity], np.int64)
    alive, least = len(held), -(-int(fill.sum()) // capacity)
    if alive <= least:
        return [b for b in done + held if b]
    items = np.array(sorted(i for b in held for i in b), np.int64)
    size, home = np.asarray(lengths, np.int64)[items], np.zeros(len(items), np.int64)
    at = {i: k for k, i in enumerate(items.tolist())}
    for b, members in enumerate(held):
        home[[at[i] for i in members]] = b
    sums = np.array([_next_sums([lengths[i] for i in b], capacity) for b in held])
    hope = fill > 0
    everyone = np.arange(len(held))
    while alive > least and hope.any():
        b = int(np.argmin(np.where(hope, fill, capacity + 1)))
        room = np.where(fill > 0, capacity - fill, 0)
        room[b] = 0
        # A bin gains from a step only if it ends fuller than the giving bin was.
        floor = np.maximum(fill[b] - fill + 1, 1)
        moved, failed = False, set()
        for i in sorted(held[b], key=lambda x: (-lengths[x], x)):
            n = lengths[i]
            if n in failed:
                continue
            gain = n - sums[everyone, np.maximum(n - room, 0)]
            gain[(gain < floor) | (room == 0)] = 0
            most = int(gain.max())
            if most <= 0:
                failed.add(n)
                continue
            # The largest gain, and of those the bin with the least room.
            t = int(np.argmin(np.where(gain == most, room, capacity + 1)))
            back = _that_add_up(held[t], lengths, n - most)
            held[b].remove(i)
            for j in back:
                held[t].remove(j)
            held[t].append(i)
            held[b] += back
            home[at[i]] = t
            home[[at[j] for j in back]] = b
            fill[t] += most
            fill[b] -= most
            moved = True
            break
        if not moved:
            hope[b] = False
            continue
        alive -= not fill[b]
        for x in (b, t):
            sums[x] = _next_sums([lengths[i] for i in held[x]], capacity)
            hope[x] = 0 < fill[x] < capacity
        for x in (b, t):
            if 0 < fill[x] < capacity:
                gain = size - sums[x][np.maximum(size - (capacity - fill[x]), 0)]
                again = home[(gain >= np.maximum(fill[home] - fill[x] + 1, 1)) & (home != x)]
                hope[again[fill[again] < capacity]] = True
    return [b for b in done + held if b]


def pack(lengths: list[int], capacity: int = CAPACITY, before: list[list[int]] | None = None) -> list[list[int]]:
    """Bins (lists of indices) of lengths that are each at most capacity; not more than the bins before, if given."""
    first = Bins(capacity)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        first.add(i, lengths[i])
    start = first.items if before is None or len(first.items) < len(before) else before
    return local_search(lengths, start, capacity)


_PACKED = "sequence_id long, offset long, underfull boolean"


def _packer(columns: list[str], capacity: int):
    def run(key: tuple, part: pa.Table) -> pa.Table:
        part = part.select(columns).sort_by([("doc_id", "ascending"), ("ids_crc32", "ascending"), ("piece", "ascending")])
        lengths = part.column("length").to_pylist()
        before: dict[int, list[int]] = {}
        if "sequence_id" in columns:
            for i, k in enumerate(part.column("sequence_id").to_pylist()):
                before.setdefault(k, []).append(i)
            part = part.drop_columns(["sequence_id"])
        bins = pack(lengths, capacity, list(before.values()) or None)
        sequence, offset, under = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), bool)
        base = key[0].as_py() << 32
        for b, items in enumerate(bins):
            at = 0
            for i in items:
                sequence[i], offset[i] = base + b, at
                at += lengths[i]
            if at < capacity:
                under[items] = True
        return part.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).append_column("underfull", pa.array(under))

    return run


def pack_pieces(parts: DataFrame, n_pieces: int, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, gather: int = GATHER) -> DataFrame:
    """Add sequence_id and offset to pieces; n_pieces sizes the groups."""
    groups = max(1, -(-n_pieces // group_pieces))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kind = parts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, {_PACKED}"
    # The line in its task keeps copies of one row apart.
    key = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", *(["line"] if "line" in parts.columns else [])), F.lit(groups))
    one = parts.withColumn("grp", key).groupBy("grp").applyInArrow(_packer(columns, capacity), schema)
    if groups == 1:
        return one.drop("underfull")
    # The first round's result is read twice: full bins as they are, underfull ones packed anew.
    one = common.cut(one)
    gathered = F.floor(F.shiftright("sequence_id", 32) / gather).cast("long") + F.lit(groups)
    two = one.where("underfull").select(*columns, "sequence_id", gathered.alias("grp")).groupBy("grp").applyInArrow(_packer([*columns, "sequence_id"], capacity), schema)
    return one.where("not underfull").union(two).drop("underfull")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Sequences of at most capacity tokens: one row per piece with its place."""
    parts = common.stored(pieces(docs, id_col, text_col, capacity, vocabulary))
    # A full piece is a sequence of its own (a negative number) and goes through no group.
    full = parts.where(F.col("length") == capacity).drop("line").withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    rest = parts.where(F.col("length") < capacity)
    return full.union(pack_pieces(rest, rest.count(), capacity))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"))
