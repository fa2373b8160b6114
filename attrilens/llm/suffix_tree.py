"""Language-model scores from a probabilistic suffix tree (operator 8).

Tokens are lower-cased words and one end for each text. The tree's symbols are
a start, the end and every training word; unknown words are one symbol more.
The root gives a symbol its count plus one over all counts, as the base score
does.

Contexts of one to ``depth`` symbols are counted level by level over the
training texts and extended while they are seen ``least_count`` times, so what
is gathered grows with the corpus. A context is kept as a state by a divergence
test: the distribution after it, each occurrence judged by the others
(leave-one-out), must tell its next symbols better than the longest kept suffix
does, by ``least_gain`` nats over all its occurrences. A state's distribution is
smoothed towards its suffix's by absolute discounting, and each symbol is scored
in the longest kept suffix of what precedes it.

Documents are turned into slices with a vocabulary of their own. For words, and
then for the windows (a context and the next symbol) of each level, a slice
sends its distinct keys with their counts as packed arrays, one for each range
of hashes; a range sums what the slices sent and returns the sums to them. So
there is one row for each slice and range, never more than keys, and no part of
the tree is sent to the driver or to every task but this: a context seen over
``hot_count`` times (at most 2**20 are) is spread over as many ranges as its
count holds ``hot_count``, so that these parts grow with the corpus and not with
contexts times ranges. Each range returns one row for its part: its share of the
size and the number of next symbols, and packed how many of its windows have
which count and chance. Spark adds the shares up, each part's gain is taken with
the sums, and the gains are added up for the same divergence test; which of these
contexts are states is sent to every task. So ``hot_count`` moves work but no score.
Windows whose last symbol or suffix only one slice asks for are counted there.

Defined results: null and empty texts are the end alone; a row with a null id
is a training row (it has no remainder 2); rows are scored each, repeated ones
too; without training rows all counts are 0 and every word is unknown; an empty
table gives an empty result; other columns are ignored. Words are told apart by
48 bits of a hash, windows and contexts by their range and 40 bits more, so about
one in two million is taken for another at any size.
"""

from __future__ import annotations

import gc
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DEPTH, LEAST_COUNT, LEAST_GAIN, DISCOUNT = 3, 2, 2.0, 0.75
SLICE_DOCS, SLICE_BYTES = 4096, 8 << 20
#: Keys that a range of hashes sums up at a time, on average.
RANGE_KEYS = 1 << 20
#: A context seen more often is spread, one range for each such count; more often if there could be over 2**20 of them.
HOT_COUNT, MOST_HOT = 1 << 17, 1 << 20
#: Chances are sent in steps of this share of a bit, windows and contexts by so many bytes beside their range, words by so many.
STEPS, KEY_BYTES, WORD_BYTES = 6, 5, 6


def held_out(id_col: str, folds: int = 7, out: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == out, F.lit(False))


class _Vocabulary(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        return k


def _short(numbers: np.ndarray) -> bytes:
    """Counts as bytes: how many, the counts, and those of 255 and more behind."""
    numbers = np.asarray(numbers, np.int64)
    big = numbers >= 255
    return np.int64(len(numbers)).tobytes() + np.where(big, 255, numbers).astype(np.uint8).tobytes() + numbers[big].tobytes()


def _counts(parts: list[bytes]) -> np.ndarray:
    """Counts of many byte strings as one array."""
    arrays = [np.zeros(0, np.int64)]
    for data in parts:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        out = np.frombuffer(data, np.uint8, n, 8).astype(np.int64)
        big = out == 255
        if big.any():
            out[big] = np.frombuffer(data[8 + n :], np.int64)
        arrays.append(out)
    return np.concatenate(arrays)


def _packed(places: np.ndarray) -> bytes:
    """Small numbers, the bytes of each weight together."""
    coder = zlib.compressobj(1, strategy=zlib.Z_HUFFMAN_ONLY)
    planes = np.ascontiguousarray(places.astype("<i4").view(np.uint8).reshape(-1, 4).T)
    return coder.compress(planes.tobytes()) + coder.flush()


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def _totals(counts: np.ndarray, back: np.ndarray) -> np.ndarray:
    """For each key that was sent its count, doubled, and one more if no other slice sent it."""
    return (counts.astype(np.int64) << 1 | (np.bincount(back, minlength=len(counts)) == 1))[back]


def _read(totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return totals >> 1, (totals & 1).astype(bool)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs of hashes."""
    x = (a ^ a >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(29)


def _range(keys: np.ndarray, ranges: int | np.ndarray) -> np.ndarray:
    """The range of each 64-bit key, rising with the key."""
    return ((keys >> np.uint64(32)) * np.asarray(ranges, np.uint64) >> np.uint64(32)).astype(np.int64)


def _sorted_set(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def _low_bytes(keys: np.ndarray, n: int) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :n].tobytes()


def _from_low(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(data) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(data, np.uint8).reshape(-1, n)
    return out.view("<i8").ravel()


def _ordered(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys below most in order, and their places before."""
    bits = max(1, len(keys) - 1).bit_length()
    if most.bit_length() + bits > 63:
        at = np.argsort(keys, kind="stable")
        return keys[at], at
    # One sort of keys that carry their places.
    both = keys << bits
    both |= np.arange(len(keys))
    both.sort()
    return both >> bits, both & (1 << bits) - 1


def _distinct(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys below most in order, where each is found first, and the place of each key among them."""
    keys, at = _ordered(keys, most)
    new = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
    back = np.empty(len(keys), np.int32)
    back[at] = np.cumsum(new, dtype=np.int32) - 1
    return keys[new], at[new], back


BASE = "slice long, vocab long, tokens long, texts long, ids array<{kind}>, held binary, sizes binary, places binary, hashes binary, trained binary"


def _word_keys(data: bytes) -> np.ndarray:
    """The kept bits of word hashes, as the high ones of 64."""
    return _from_low(data, WORD_BYTES).view(np.uint64) << np.uint64(64 - 8 * WORD_BYTES)


def _sliced(docs: DataFrame, kind: str) -> DataFrame:
    """One row for each slice: its documents as places in its vocabulary, frequent words first."""
    schema = BASE.format(kind=kind)
    target = common.arrow_schema(schema)

    def one(number: int, ids: list, held: list, known: _Vocabulary, places: array, sizes: list) -> pa.RecordBatch:
        flags, lengths = np.array(held, bool), np.array(sizes, np.int32)
        flat = np.frombuffer(places, np.int32) if places else np.zeros(0, np.int32)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in known), np.uint64, len(known))
        # The most frequent words get the least numbers, which pack best.
        order = np.argsort(-np.bincount(flat, minlength=len(hashes)), kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        flat = rank[flat]
        trained = np.bincount(flat[np.repeat(~flags, lengths)], minlength=len(hashes))
        row = [number, len(hashes), len(flat), int((~flags).sum()), ids, flags.tobytes(), lengths.tobytes(), _packed(flat), _low_bytes(hashes[order], WORD_BYTES), _short(trained)]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, target)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, held, known, places, sizes, size = [], [], _Vocabulary(), array("i"), [], 0
        for batch in common.slices(batches, "text", SLICE_BYTES):
            for i, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.utf8(batch.column(2))):
                before = len(places)
                places.extend(map(known.__getitem__, text.lower().split()))
                ids.append(i)
                held.append(out)
                sizes.append(len(places) - before)
                size += len(text)
                if len(ids) >= SLICE_DOCS or size >= SLICE_BYTES:
                    yield one(number, ids, held, known, places, sizes)
                    number += 1
                    ids, held, known, places, sizes, size = [], [], _Vocabulary(), array("i"), [], 0
        if ids:
            yield one(number, ids, held, known, places, sizes)

    return docs.mapInArrow(run, schema)


class Model:
    """What is the same for all slices."""

    def __init__(self, n_all: int, kinds: int, ends: int, least_count: int, least_gain: float, discount: float, hot_count: int, ranges: int):
        self.n_all, self.kinds, self.ends = n_all, kinds, ends
        self.least_count, self.least_gain, self.discount = least_count, least_gain, discount
        self.hot_count, self.ranges = hot_count, ranges


class Slice:
    """The symbols of a slice's documents, and their chances by contexts of growing length."""

    def __init__(self, row: dict, totals: np.ndarray, model: Model):
        self.model = model
        self.held, self.sizes = np.frombuffer(row["held"], bool), np.frombuffer(row["sizes"], np.int32)
        places, hashes = _unpacked(row["places"]), _word_keys(row["hashes"])
        # Totals come in the order of the words' hashes.
        n, by_word = row["vocab"], np.empty(row["vocab"], np.int64)
        by_word[np.argsort(hashes)] = totals
        counts, alone = _read(by_word)
        start = n + 1
        self.hashes = np.concatenate([hashes, np.array([0, 1], np.uint64)])
        self.sizes_of = np.concatenate([counts, [model.ends, model.ends]])
        flat = np.full(len(places) + 2 * len(self.sizes), start, np.int32)
        ends_at = np.cumsum(self.sizes + 2) - 1
        inside = np.ones(len(flat), bool)
        inside[ends_at] = inside[ends_at - self.sizes - 1] = False
        flat[inside], flat[ends_at] = places, n
        self.symbols, self.predicted = flat, flat != start
        self.trained = np.repeat(~self.held, self.sizes + 2)
        self.chance = ((self.sizes_of + 1) / (model.n_all + model.kinds + 1))[flat]
        self.local = np.append(alone, [False, False])[flat]
        context = np.full(len(flat), -1, np.int32)
        context[1:] = flat[:-1]
        self._next(context, self.hashes, self.sizes_of)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """By document, over all tokens but the start."""
        owner = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes + 2)
        return np.bincount(owner[self.predicted], weights=values[self.predicted], minlength=len(self.sizes))

    def _next(self, context: np.ndarray, hashes: np.ndarray, sizes: np.ndarray) -> None:
        context[~self.predicted] = -1
        there = np.flatnonzero(context >= 0)
        context[there[sizes[context[there]] < self.model.least_count]] = -1
        self.context, self.context_hashes, self.context_sizes = context, hashes, sizes

    def ask(self) -> None:
        """Distinct windows of the tokens whose context is seen often enough, and where each goes."""
        self.at = at = np.flatnonzero(self.context >= 0)
        bits = len(self.hashes).bit_length()
        keys = self.context[at].astype(np.int64)
        keys <<= bits
        keys |= self.symbols[at]
        kinds, first, self.back = _distinct(keys, len(self.context_hashes) << bits)
        of = self.of = kinds >> bits
        self.last = kinds & (1 << bits) - 1
        # Equal windows have equal chances.
        first = at[first]
        self.before, local = self.chance[first], self.local[first]
        self.seen = np.bincount(self.back[self.trained[at]], minlength=len(kinds))
        new = np.append(True, of[1:] != of[:-1]) if len(of) else np.zeros(0, bool)
        self.run, self.contexts = np.cumsum(new) - 1, of[new]
        # How many ranges, from its own on, a context is spread over.
        spans = np.minimum(-(-self.context_sizes[self.contexts] // self.model.hot_count), self.model.ranges)
        self.hot = spans > 1
        # Local windows that are seen once count for their context only.
        self.sent = np.flatnonzero(~local | (self.seen > 1))
        self.singles = np.bincount(self.run[local & (self.seen == 1)], minlength=len(self.contexts))
        home = _range(self.context_hashes[self.contexts], self.model.ranges)
        to = home[self.run[self.sent]]
        spread = self.hot[self.run[self.sent]]
        to[spread] = (to[spread] + _range(self.window_hashes(self.sent[spread]), spans[self.run[self.sent[spread]]])) % self.model.ranges
        size = max(1, len(self.contexts))
        pairs = to * size + self.run[self.sent]
        pairs, order = _ordered(pairs, self.model.ranges * size)
        self.sent = self.sent[order]
        new = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else order
        own = home * size + np.arange(len(self.contexts))
        self.entries = _sorted_set(np.concatenate([pairs[new], own]))
        self.entry, self.to = self.entries % size, self.entries // size
        self.own = self.entries == own[self.entry]
        self.lengths = np.zeros(len(self.entries), np.int64)
        self.lengths[np.searchsorted(self.entries, pairs[new])] = np.diff(np.append(new, len(pairs)))

    def window_hashes(self, at: np.ndarray) -> np.ndarray:
        return _mixed(self.context_hashes[self.of[at]], self.hashes[self.last[at]])

    def asked(self) -> Iterator[dict]:
        """One row for each range that gets something."""
        cuts = np.flatnonzero(np.append(True, self.to[1:] != self.to[:-1])) if len(self.to) else np.zeros(0, np.int64)
        at = np.append(0, np.cumsum(self.lengths))
        hashes = self.context_hashes[self.contexts[self.entry]]
        keys = np.frombuffer(_low_bytes(hashes, KEY_BYTES), np.uint8).reshape(-1, KEY_BYTES)
        singles = np.where(self.own, self.singles[self.entry], 0)
        wins = np.frombuffer(_low_bytes(self.window_hashes(self.sent), KEY_BYTES), np.uint8).reshape(-1, KEY_BYTES)
        counts = self.seen[self.sent]
        steps = np.clip(np.rint(-STEPS * np.log2(self.before[self.sent])), 0, 255).astype(np.uint8)
        hot = self.hot[self.entry]
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(self.to)]):
            u, v = int(at[a]), int(at[b])
            spread = np.flatnonzero(hot[a:b])
            yield {
                "part": int(self.to[a]), "contexts": keys[a:b].tobytes(), "runs": _short(self.lengths[a:b]), "singles": _short(singles[a:b]),
                "hot": spread.astype(np.int32).tobytes(), "hot_hashes": hashes[a:b][spread].tobytes(), "wins": wins[u:v].tobytes(), "counts": _short(counts[u:v]), "chances": steps[u:v].tobytes(),
            }

    def answer(self, totals: np.ndarray, kinds: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> None:
        """Counts of the sent windows, and for each entry the number of next symbols if its context is a state, else 0."""
        n, local = self.seen.copy(), np.ones(len(self.seen), bool)
        n[self.sent], local[self.sent] = _read(totals)
        after = np.zeros(len(self.contexts), np.int64)
        after[self.entry[self.own]] = kinds[self.own]
        if self.hot.any():
            after[self.hot] = hot[1][np.searchsorted(hot[0], self.context_hashes[self.contexts[self.hot]])]
        d, after, size = self.model.discount, after[self.run], self.context_sizes[self.contexts[self.run]]
        p = np.where(after > 0, (np.maximum(n - d, 0) + d * after * self.before) / size, self.before)
        self.chance[self.at] = p[self.back]
        self.local[self.at] = local[self.back]
        context = np.full(len(self.symbols), -1, np.int32)
        context[self.at] = self.back
        context[1:] = context[:-1]
        context[0] = -1
        # Only windows that are contexts of the next level need their hashes.
        often, hashes = np.flatnonzero(n >= self.model.least_count), np.zeros(len(n), np.uint64)
        hashes[often] = self.window_hashes(often)
        self._next(context, hashes, n)


def _joined(parts: list[bytes], kind) -> tuple[np.ndarray, np.ndarray]:
    """Arrays of many rows as one, and the place at which each begins (and the end)."""
    arrays = [np.frombuffer(x, kind) for x in parts]
    return np.concatenate(arrays) if arrays else np.zeros(0, kind), np.append(0, np.cumsum([len(a) for a in arrays]))


ASKED = "slice long, part long, contexts binary, runs binary, singles binary, hot binary, hot_hashes binary, wins binary, counts binary, chances binary"
ANSWERED = "slice long, part long, level int, totals binary, kinds binary, hot long, after long, once long, size long, times binary, steps binary, windows binary"


def _merged(rows: pa.Table, level: int, least_gain: float, discount: float) -> list[dict]:
    """A range of hashes: counts of windows over all slices, and the divergence test of contexts."""
    data = {c: rows.column(c).to_pylist() for c in rows.column_names}
    contexts, wins = (_from_low(b"".join(data[c]), KEY_BYTES) for c in ("contexts", "wins"))
    c_at, w_at = (np.append(0, np.cumsum([len(x) // KEY_BYTES for x in data[c]])) for c in ("contexts", "wins"))
    runs, singles, seen = (_counts(data[c]) for c in ("runs", "singles", "counts"))
    steps, (hot, h_at) = np.frombuffer(b"".join(data["chances"]), np.uint8), _joined(data["hot"], np.int32)
    hot = hot + np.repeat(c_at[:-1], np.diff(h_at))
    _, _, context = _distinct(contexts, 1 << 8 * KEY_BYTES)
    n_contexts = int(context.max(initial=-1)) + 1
    _, first, back = _distinct(wins, 1 << 8 * KEY_BYTES)
    total = np.bincount(back, weights=seen, minlength=len(first)).astype(np.int64)
    of = context[np.repeat(np.arange(len(contexts)), runs)[first]]
    p = 2.0 ** (-steps[first].astype(np.float64) / STEPS)
    add = lambda where, values=None: np.bincount(of[where], weights=values, minlength=n_contexts).astype(np.float64)
    alone = np.bincount(context, weights=singles, minlength=n_contexts)
    after = add(total > 0) + alone
    size = add(slice(None), total) + alone
    once, many = add(total == 1) + alone, total > 1
    m, t, q = of[many], total[many], p[many]
    others = np.maximum(size - 1, 1)
    gain = add(many, t * np.log((np.maximum(t - 1 - discount, 0) + discount * after[m] * q) / others[m] / q))
    gain += once * np.log(np.maximum(discount * (after - 1), 1e-9) / others)
    spread = np.zeros(n_contexts, bool)
    spread[context[hot]] = True
    kinds = np.where((gain >= least_gain) & (size > 1) & ~spread, after, 0).astype(np.int64)
    totals, states = _totals(total, back), kinds[context]
    part = data["part"][0]
    out = [
        {"slice": s, "part": part, "level": level, "totals": _short(totals[w_at[k] : w_at[k + 1]]), "kinds": _short(states[c_at[k] : c_at[k + 1]])}
        for k, s in enumerate(data["slice"])
    ]
    if len(hot):
        names, at = np.unique(_joined(data["hot_hashes"], np.uint64)[0], return_index=True)
        own = context[hot][at]
        # Windows of spread contexts by context, count and step of chance.
        named = np.full(n_contexts, -1, np.int64)
        named[own] = np.arange(len(own))
        often = many & (named[of] >= 0)
        windows, n = np.unique(np.stack([named[of[often]], total[often], steps[first][often].astype(np.int64)]), axis=1, return_counts=True)
        cuts = np.searchsorted(windows[0], np.arange(len(own) + 1)).tolist()
        for h, c, a, b in zip(names.view(np.int64).tolist(), own.tolist(), cuts, cuts[1:]):
            packed = {"times": _short(windows[1, a:b]), "steps": windows[2, a:b].astype(np.uint8).tobytes(), "windows": _short(n[a:b])}
            out.append({"slice": None, "part": part, "level": level, "hot": h, "after": int(after[c]), "once": int(once[c]), "size": int(size[c]), **packed})
    return out


def _part_gains(discount: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function: what the windows of each part of a spread context gain, given the context's size and number of next symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gains = []
            for times, steps, windows, after, size in zip(*[batch.column(c).to_pylist() for c in ("times", "steps", "windows", "after", "size")]):
                t, n, others = _counts([times]), _counts([windows]), max(size - 1, 1)
                q = 2.0 ** (-np.frombuffer(steps, np.uint8).astype(np.float64) / STEPS)
                gains.append(float((n * t * np.log((np.maximum(t - 1 - discount, 0) + discount * after * q) / others / q)).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("hot"), pa.array(gains, pa.float64())], names=["hot", "gain"])

    return run


def _hot_states(found: DataFrame, least_gain: float, discount: float) -> DataFrame:
    """(h, kinds) of the spread contexts by the test that ``_merged`` takes for the others."""
    rows = found.where("hot is not null")
    sums = rows.groupBy("hot").agg(*[F.sum(c).alias(c) for c in ("after", "once", "size")])
    parts = rows.select("hot", "times", "steps", "windows").join(sums.select("hot", "after", "size"), "hot")
    gains = parts.mapInArrow(_part_gains(discount), "hot long, gain double").groupBy("hot").agg(F.sum("gain").alias("gain"))
    others = F.greatest(F.col("size") - 1, F.lit(1))
    gain = F.col("gain") + F.col("once") * F.log(F.greatest(discount * (F.col("after") - 1), F.lit(1e-9)) / others)
    return sums.join(gains, "hot").select(F.col("hot").alias("h"), F.when((gain >= least_gain) & (F.col("size") > 1), F.col("after")).otherwise(0).alias("kinds"))


def _table(rows: list[dict], target: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=target)


def scored_ddl(kind: str) -> str:
    return f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


WORDS = "slice long, part long, keys binary, counts binary"
TOTALS = "slice long, part long, level int, totals binary, known long, counted long"


def _word_totals(base: DataFrame, ranges: int) -> DataFrame:
    """Training counts of the words of each slice over all slices, by ranges of hashes."""
    asked, answered = common.arrow_schema(WORDS), common.arrow_schema(TOTALS)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = _word_keys(row["hashes"])
                order = np.argsort(keys)
                keys, counts = keys[order], _counts([row["trained"]])[order]
                at = np.searchsorted(_range(keys, ranges), np.arange(ranges + 1))
                out = [{"slice": row["slice"], "part": p, "keys": keys[a:b].tobytes(), "counts": _short(counts[a:b])} for p, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist())) if a < b]
                yield from _table(out, asked).to_batches()

    def merge(rows: pa.Table) -> pa.Table:
        keys, at = _joined(rows.column("keys").to_pylist(), np.uint64)
        counts = _counts(rows.column("counts").to_pylist())
        kinds, back = np.unique(keys, return_inverse=True)
        total = np.bincount(back, weights=counts, minlength=len(kinds)).astype(np.int64)
        totals, part = _totals(total, back), rows.column("part")[0].as_py()
        out = [{"slice": s, "part": part, "level": 0, "totals": _short(totals[at[k] : at[k + 1]])} for k, s in enumerate(rows.column("slice").to_pylist())]
        return _table([*out, {"slice": None, "part": part, "level": 0, "known": int((total > 0).sum()), "counted": int(total.sum())}], answered)

    return base.select("slice", "vocab", "hashes", "trained").mapInArrow(ask, WORDS).groupBy("part").applyInArrow(merge, TOTALS)


def score_documents(docs: DataFrame, held: Column | None = None, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, least_count: int = LEAST_COUNT, least_gain: float = LEAST_GAIN, discount: float = DISCOUNT, hot_count: int = HOT_COUNT, range_keys: int = RANGE_KEYS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    if least_count < 2:
        raise ValueError("a context seen once tells nothing of other occurrences")
    kind = docs.schema[id_col].dataType.simpleString()
    held = held_out(id_col) if held is None else held
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held"), F.col(text_col).cast("string").alias("text"))
    base = common.stored(_sliced(rows, kind))
    ends, n_words, n_tokens = base.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("texts", "vocab", "tokens")]).first()
    words = common.stored(_word_totals(base, max(1, -(-n_words // range_keys))))
    known, counted = words.where("slice is null").agg(F.coalesce(F.sum("known"), F.lit(0)), F.coalesce(F.sum("counted"), F.lit(0))).first()
    n_all = counted + ends
    model = Model(n_all, known + (ends > 0), ends, least_count, least_gain, discount, max(hot_count, n_all // MOST_HOT), max(1, -(-n_tokens // range_keys)))
    asked, answered, target = common.arrow_schema(ASKED), common.arrow_schema(ANSWERED), common.arrow_schema(scored_ddl(kind))
    hots: list[tuple[np.ndarray, np.ndarray]] = []

    def walked(left: pa.Table, right: pa.Table, hots: list) -> tuple[dict, Slice]:
        """A slice after the levels that are answered."""
        row = left.to_pylist()[0]
        right = right.sort_by([("level", "ascending"), ("part", "ascending")])
        levels: dict[int, list] = {}
        for level, totals, kinds in zip(*[right.column(c).to_pylist() for c in ("level", "totals", "kinds")]):
            levels.setdefault(level, []).append((totals, kinds))
        s = Slice(row, _counts([x for x, _ in levels.get(0, [])]), model)
        for level, hot in enumerate(hots, 1):
            s.ask()
            found = levels.get(level, [])
            s.answer(_counts([x for x, _ in found]), _counts([x for _, x in found]), hot)
        return row, s

    def asking(hots: list) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            row, s = walked(left, right, hots)
            s.ask()
            return _table([{"slice": row["slice"], **x} for x in s.asked()], asked)

        return run

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        row, s = walked(left, right, hots)
        root = (s.sizes_of + 1) / (model.n_all + model.kinds + 1)
        base_score, score = s.sums(np.log10(root)[s.symbols]), s.sums(np.log10(s.chance))
        n_known = s.sums((s.sizes_of > 0)[s.symbols])
        columns = [row["ids"], s.held, s.sizes.astype(np.int64) + 1, n_known.astype(np.int64), np.full(len(s.sizes), n_all), base_score, score]
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(columns, target)], schema=target)

    def merging(level: int) -> Callable[[pa.Table], pa.Table]:
        return lambda rows: _table(_merged(rows, level, least_gain, discount), answered)

    empty = F.lit(None).cast("binary")
    answers = words.where("slice is not null").select("slice", "part", "level", "totals", empty.alias("kinds"))
    for level in range(1, depth + 1):
        wanted = base.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(asking(list(hots)), ASKED)
        found = common.stored(wanted.groupBy("part").applyInArrow(merging(level), ANSWERED))
        # At most 2**20 contexts are that frequent; a row for each.
        hot = _hot_states(found, least_gain, discount).collect()
        names = np.array([r["h"] for r in hot], np.int64).view(np.uint64)
        order = np.argsort(names)
        hots.append((names[order], np.array([r["kinds"] for r in hot], np.int64)[order]))
        answers = answers.union(found.where("slice is not null").select("slice", "part", "level", "totals", "kinds"))
        # Collections here and in the driver free the shuffles of levels that are done.
        del wanted
        gc.collect()
        docs.sparkSession.sparkContext._jvm.System.gc()
    return base.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(scored, scored_ddl(kind))


def op8_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(common.table(spark, sf_dir, "documents"))
