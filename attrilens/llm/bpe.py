"""BPE encoding and decoding in batched numpy merge rounds (operator 5).

Texts are normalised and cut into words as the vocabulary file says. The words
that a task has not met before are encoded together: their symbols stand in one
flat array, every adjacent pair is looked up by binary search over the sorted
pair keys of the merge table, and in each round every word merges its
lowest-ranked pair, left to right. Words without a pair to merge leave the
array. Results are kept in a table per task that is emptied when it is full.

Defined results: null and empty texts have no ids and decode to the empty text;
a special token's string in a text is that token, as in the tokenizers library;
repeated rows are encoded each; an empty table gives an empty result; other
columns are ignored. A word of over ``LONG`` bytes is merged alone, rank by rank:
a round looks up only the pairs beside the merges of the one before, so work is
in proportion to the word and to the distinct ranks that it meets.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

NO_RANK = np.int64(1) << 40
#: Bytes from which a word is merged alone.
LONG = 1024
_LOADED: dict = {}


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A lower-casing BPE with word ends, from a tokenizers file."""

    def __init__(self, path: str, keep: int = 400_000):
        with open(path) as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*self.vocab.values(), *special.values()])
        self.names = [""] * self.size
        for token, i in [*self.vocab.items(), *special.items()]:
            self.names[i] = token
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.words = regex.compile(steps[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.special_ids = special
        self.space = regex.compile(r"\p{White_Space}+")
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in merges], np.int64)
        right = np.array([self.vocab[b] for _, b in merges], np.int64)
        keys, made = left * self.size + right, np.array([self.vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        letters = byte_letters()
        self.inner = np.array([self.vocab[c] for c in letters], np.int64)
        self.final = np.array([self.vocab[c + self.end] for c in letters], np.int64)
        self.keep, self.known = keep, {}

    def normalise(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        # Letter by letter: a final sigma is lower-cased without its context.
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def split(self, text: str) -> list[str]:
        """Words of a text; special tokens stand for themselves."""
        if not any(t in text for t in self.special_ids):
            return self.words.findall(self.normalise(text))
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*self.words.findall(self.normalise(text[at : m.start()])), (m.group(),)]
            at = m.end()
        return out + self.words.findall(self.normalise(text[at:]))

    def ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair of symbols, and its place in the merge table."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK), at

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one word: all pairs of the lowest rank in a round, then the ranks beside them anew."""
        flat = np.frombuffer(word, np.uint8)
        n = len(flat)
        symbols = self.inner[flat]
        symbols[-1] = self.final[flat[-1]]
        after, before, there = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        rank, made = np.full(n, NO_RANK), np.zeros(n, np.int64)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def look(places: np.ndarray) -> None:
            places = places[after[places] < n]
            r, at = self.ranked(symbols[places], symbols[after[places]])
            rank[places], made[places] = r, self.made[at]
            order = np.argsort(r, kind="stable")
            places, r = places[order], r[order]
            cuts = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else []
            for a, b in zip(cuts, [*cuts[1:], len(r)]):
                if r[a] < NO_RANK:
                    if r[a] not in waiting:
                        waiting[r[a]] = []
                        heapq.heappush(heap, r[a])
                    waiting[r[a]].append(places[a:b])

        look(np.arange(n))
        while heap:
            least = heapq.heappop(heap)
            found = waiting.pop(least)
            hit = np.unique(np.concatenate(found)) if len(found) > 1 else found[0]
            hit = hit[there[hit] & (rank[hit] == least)]
            if not len(hit):
                continue
            if len(hit) > 1:
                # In a run of overlapping equal pairs every second one merges, from the left.
                head = np.append(True, after[hit[:-1]] != hit[1:])
                place = np.arange(len(hit)) - np.maximum.accumulate(np.where(head, np.arange(len(hit)), 0))
                hit = hit[place % 2 == 0]
            gone = after[hit]
            symbols[hit] = made[hit]
            there[gone], rank[gone], rank[hit] = False, NO_RANK, NO_RANK
            after[hit] = after[gone]
            inner = after[hit] < n
            before[after[hit][inner]] = hit[inner]
            beside = before[hit]
            beside = beside[beside >= 0]
            rank[beside] = NO_RANK
            look(np.unique(np.concatenate([hit, beside])))
        return symbols[there]

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of many words: one flat array, one merge per word and round; long words alone."""
        if any(len(w) > LONG for w in words):
            short = iter(self.merge([w for w in words if len(w) <= LONG]))
            return [self.merge_long(w) if len(w) > LONG else next(short) for w in words]
        if not words:
            return []
        lengths = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[flat]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.final[flat[ends]]
        word = np.repeat(np.arange(len(words)), lengths)
        done: list = [None] * len(words)
        while len(symbols):
            rank, at = self.ranked(symbols[:-1], symbols[1:])
            rank = np.append(np.where(word[:-1] == word[1:], rank, NO_RANK), NO_RANK)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.append(starts, len(word)))
            over = np.flatnonzero(least == NO_RANK)
            for k in over:
                done[word[starts[k]]] = symbols[starts[k] : starts[k] + counts[k]].copy()
            chosen = (rank != NO_RANK) & (rank == np.repeat(least, counts))
            hit = np.flatnonzero(chosen)
            if len(hit) > 1:
                # In a run of overlapping equal pairs every second one merges, from the left.
                head = np.append(True, np.diff(hit) != 1)
                place = np.arange(len(hit)) - np.maximum.accumulate(np.where(head, np.arange(len(hit)), 0))
                hit = hit[place % 2 == 0]
            symbols[hit] = self.made[at[hit]]
            stay = np.repeat(least != NO_RANK, counts)
            stay[hit + 1] = False
            symbols, word = symbols[stay], word[stay]
        return done

    def encoded(self, texts: list[str]) -> list[list[tuple[int, str, str]]]:
        """For each text its words as (number of ids, ids in decimal, decoded words)."""
        split = [self.split(t) for t in texts]
        known = self.known
        fresh = list({w for words in split for w in words if w not in known})
        if len(known) + len(fresh) > self.keep:
            known.clear()
            fresh = list({w for words in split for w in words})
        plain = [w for w in fresh if isinstance(w, str)]
        if plain:
            for w, ids in zip(plain, self.merge([w.encode() for w in plain])):
                ids = ids.tolist()
                known[w] = (len(ids), " ".join(map(str, ids)), " ".join([self.names[i] for i in ids]))
        for w in fresh:
            if not isinstance(w, str):
                known[w] = (1, str(self.special_ids[w[0]]), w[0])
        return [[known[w] for w in words] for words in split]

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.encoded([text])[0] for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces: the vocabulary names no decoder."""
        return " ".join(self.names[i] for i in ids)


def vocabulary(path: str | None = None) -> WordBpe:
    import public_tokenizers

    path = path or public_tokenizers.path("word_bpe_49k.json")
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, decoded): ids and the text they decode to."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        bpe = vocabulary(path)
        found = bpe.encoded(common.strings(batch.column(1)))
        return {"doc_id": batch.column(0), "ids": [[int(i) for _, x, _ in ws for i in x.split(" ")] for ws in found], "decoded": [" ".join([d for _, _, d in ws]) for ws in found]}

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return common.arrow_map(rows, run, f"doc_id {kind}, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        bpe, out = vocabulary(path), {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for words in bpe.encoded(common.strings(batch.column(1))):
            out["n_tokens"].append(sum([n for n, _, _ in words]))
            out["ids_sha256"].append(hashlib.sha256(" ".join([i for _, i, _ in words]).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(" ".join([d for _, _, d in words]).encode()).hexdigest())
        return {"doc_id": batch.column(0), **out}

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return common.arrow_map(rows, run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(common.table(spark, sf_dir, "documents"))
