"""Quality rules with tokeniser fertility (operator 7).

Base measures are counted on the whole text. The method then encodes each text
with two public vocabularies and measures characters per token, the share of
byte-fallback tokens and token entropy. For each language (the script of most
letters where the language is null) and each half octave of token counts, the
median and the distance from there to the upper quartile of each measure, over
all documents that pass the base rules, set the bands; a document is rejected
if it stands outside them. One formula serves groups of all sizes: the other
lengths of a language weigh in like at most ``PRIOR_SIZE`` documents each, less
by ``DECAY`` for each half octave between, and a band is the wider the fewer
documents stand behind it. Measures are counted by bins of ``STEPS`` (sums that
combine before the shuffle), so no group of any size meets in one task.

Defined results: null and empty texts have no words, fail the base rules and
have null measures; repeated rows are measured each; an empty table gives an
empty result; other columns are ignored (``filter_documents`` keeps them).
"""

from __future__ import annotations

import unicodedata
from array import array
from collections import Counter, defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .packing import byte_encoder

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
#: Rejection bands in robust deviations: fertility and entropy together, fertility alone; byte share above the median.
JOINT_LOW, FERTILITY_LOW, FERTILITY_HIGH, BYTE_EXCESS = -6.0, -8.0, 14.0, 0.10
PRIOR_SIZE, DECAY, WIDER = 30, 0.125, 1.5
#: Bins: parts of an octave of fertility, of a bit of entropy, of the whole share.
STEPS, SHARE_STEPS = 512, 4096
#: Bins that quartiles are looked up in at a time.
COARSE = 64
MEASURES = ("fertility", "byte_fertility", "entropy", "byte_entropy", "byte_share")

_PIECES: dict = {}


class Pieces:
    """A piece vocabulary; ids of words that a task has met are kept.

    A text with single spaces alone is cut there: no piece reaches over a space,
    and each word is encoded with one before it, as the first of a text is.
    """

    def __init__(self, path: str | None = None, keep: int = 200_000):
        import public_tokenizers
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.is_byte = np.array([self.model.is_byte(i) for i in range(len(names))])
        self.cuts = not any("\u2581" in x.lstrip("\u2581") for x in names)
        self.keep, self.known, self.before = keep, {}, {}

    def encode(self, text: str) -> np.ndarray:
        if not self.cuts or "  " in text or "\u2581" in text or text[:1] in ("", " ") or text[-1] == " ":
            return np.array(self.model.encode(text), np.int32)
        words = text.split(" ")
        found = list(map(self.known.get, words))
        if None in found:
            if 2 * len(self.known) > self.keep:
                # Words met since the last turn stay; words of the turn before that are taken over when they are met again.
                self.known, self.before = {}, self.known
            missed = {w for w, ids in zip(words, found) if ids is None}
            again = {w: self.before[w] for w in missed if w in self.before}
            fresh = list(missed - again.keys())
            again |= zip(fresh, [array("i", ids).tobytes() for ids in self.model.encode(fresh, num_threads=1)] if fresh else ())
            self.known |= again
            found = [again[w] if ids is None else ids for w, ids in zip(words, found)]
        return np.frombuffer(b"".join(found), np.int32)


def piece_model(path: str | None = None) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def repeat_words(words: list, window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more in the text."""
    n = len(words)
    if n < window:
        return 0
    seen: dict = defaultdict(count().__next__)
    ids = np.fromiter(map(seen.__getitem__, words), np.int64, n)
    if window >= 4 and len(seen) < 1 << 16:
        # Four words that fit one number: without two equal ones no window repeats.
        four = ids[:-3] << 48 | ids[1:-2] << 32 | ids[2:-1] << 16 | ids[3:]
        four = np.sort(four)
        if (four[1:] != four[:-1]).all():
            return 0
    # Windows of doubling width get exact ids from the ids of their halves.
    width = 1
    while width < window:
        step = min(width, window - width)
        ids = np.unique(ids[:-step] * (n + 1) + ids[step:], return_inverse=True)[1].astype(np.int64)
        width += step
        twice = np.bincount(ids)[ids] > 1
        if not twice.any():  # longer windows do not repeat either
            return 0
    marks = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + window, -1)
    return int((np.cumsum(marks[:-1]) > 0).sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def base_measures(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)"""
    words = text.encode().split()
    chars = len(text) - sum(text.count(c) for c in SPACES)
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), duplicate_lines(text), repeat_words(words)


def entropy(ids: np.ndarray) -> float:
    counts = np.unique(ids, return_counts=True)[1]
    return float(np.log2(len(ids)) - (counts * np.log2(counts)).sum() / len(ids))


def script(text: str) -> str:
    """First word of the Unicode name of most letters in the text."""
    found: Counter = Counter()
    for c, n in Counter(text).items():
        if c.isalpha():
            found[unicodedata.name(c, "NONE").split(" ", 1)[0]] += n
    return min(found, key=lambda k: (-found[k], k)) if found else "NONE"


def token_measures(text: str, pieces: np.ndarray, byte_ids: np.ndarray, is_byte: np.ndarray) -> tuple[float, ...]:
    return len(text) / len(pieces), len(text) / len(byte_ids), entropy(pieces), entropy(byte_ids), float(is_byte[pieces].mean())


_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, grp string, half int, fertility double, byte_fertility double, entropy double, byte_entropy double, byte_share double, text_key long"


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: str | None = None, bytes_vocabulary: str | None = None) -> DataFrame:
    """Base and token measures of every document, with its group for the bands."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        model, encoder = piece_model(vocabulary), byte_encoder(bytes_vocabulary)
        texts = common.strings(batch.column(1))
        rows = []
        for text, lang in zip(texts, batch.column(2).to_pylist()):
            base = base_measures(text)
            pieces = model.encode(text)
            group = lang if lang is not None else script(text)
            if base[0] and len(pieces):
                rows.append((*base, group, int(2 * np.log2(len(pieces))), *token_measures(text, pieces, encoder.encode(text), model.is_byte)))
            else:
                rows.append((*base, group, 0, *[None] * 5))
        names = [x.split(" ")[0] for x in _SCHEMA.split(", ")][:-1]
        return {"doc_id": batch.column(0), "text_key": batch.column(3), **{k: list(v) for k, v in zip(names, zip(*rows))}}

    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), lang.alias("lang"), F.xxhash64(text).alias("text_key"))
    return common.arrow_map(rows, run, f"doc_id {kind}, {_SCHEMA}")


def base_failed() -> Column:
    return F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")


def _bins() -> list[Column]:
    return [(F.floor(F.col(m) * SHARE_STEPS) if m == "byte_share" else F.floor(F.col(m) * STEPS) if "entropy" in m else F.floor(F.log2(m) * STEPS)).cast("long") for m in MEASURES]


def _middle(measure: int, at: Column) -> Column:
    """The middle of a bin."""
    name, at = MEASURES[measure], at + 0.5
    return at / SHARE_STEPS if name == "byte_share" else at / STEPS if "entropy" in name else F.pow(F.lit(2.0), at / STEPS)


def bands(passing: DataFrame) -> DataFrame:
    """(grp, half, n, mid_*, dev_*): medians and spreads above them of each group and half octave; a few rows."""
    bins = F.posexplode(F.array(*_bins())).alias("m", "at")
    group = ["grp", "half", "m"]
    # A row a bin; everything below works on at most 2 * COARSE rows of a group and measure at a time, or its number of coarse bins.
    counts = passing.select("grp", "half", bins).groupBy(*group, "at").agg(F.count(F.lit(1)).alias("n")).withColumn("c", F.floor(F.col("at") / COARSE))
    whole, order = Window.partitionBy(*group), Window.partitionBy(*group).orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
    coarse = counts.groupBy(*group, "c").agg(F.sum("n").alias("s")).withColumns({"upto": F.sum("s").over(order), "all": F.sum("s").over(whole)})
    # The coarse bins that hold a quartile, and what is below them.
    holds = F.filter(F.array(F.lit(0.5), F.lit(0.75)), lambda q: (F.col("upto") >= q * F.col("all")) & (F.col("upto") - F.col("s") < q * F.col("all")))
    held = coarse.select(*group, "c", "all", (F.col("upto") - F.col("s")).alias("before"), F.explode(holds).alias("q"))
    fine = Window.partitionBy(*group, "q").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    near = counts.join(held, [*group, "c"]).withColumn("upto", F.sum("n").over(fine) + F.col("before"))
    found = near.where(F.col("upto") >= F.col("q") * F.col("all")).groupBy(*group, "q").agg(F.min("at").alias("at"), F.max("all").alias("all"))
    of = lambda k, share: F.min(F.when((F.col("m") == k) & (F.col("q") == share), F.col("at")))
    quartiles = found.groupBy("grp", "half").agg(F.max("all").alias("n"), *[of(k, q).alias(f"q{int(4 * q)}_{m}") for k, m in enumerate(MEASURES) for q in (0.5, 0.75)])
    mids = {f"mid_{m}": _middle(k, F.col(f"q2_{m}")) for k, m in enumerate(MEASURES)}
    devs = {f"dev_{m}": _middle(k, F.col(f"q3_{m}")) - _middle(k, F.col(f"q2_{m}")) for k, m in enumerate(MEASURES)}
    return quartiles.select("grp", "half", "n", *[v.alias(k) for k, v in (mids | devs).items()])


def smoothed(own: DataFrame, wanted: DataFrame) -> DataFrame:
    """Bands of the wanted (grp, half), drawn towards those of other lengths; spreads towards that of all groups too."""
    names = [f"{k}_{m}" for k in ("mid", "dev") for m in MEASURES]
    every = own.agg(*[F.try_divide(F.sum(F.col("n") * F.col(f"dev_{m}")), F.sum("n")).alias(m) for m in MEASURES]).first()
    near = wanted.join(own.withColumnRenamed("half", "other"), "grp", "left")
    apart = F.abs(F.col("half") - F.col("other"))
    weight = F.when(apart == 0, F.col("n")).otherwise(F.least("n", F.lit(PRIOR_SIZE)) * F.pow(F.lit(DECAY), apart))
    near = near.withColumn("w", F.coalesce(weight, F.lit(0.0)))
    sums = near.groupBy("grp", "half").agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col(c)).alias(c) for c in names])
    mids = [(F.try_divide(F.col(f"mid_{m}"), F.col("w"))).alias(f"mid_{m}") for m in MEASURES]
    devs = [((F.coalesce(f"dev_{m}", F.lit(0.0)) + PRIOR_SIZE * F.lit(every[m]).cast("double")) / (F.col("w") + PRIOR_SIZE)).alias(f"dev_{m}") for m in MEASURES]
    wide = (1 + WIDER * PRIOR_SIZE / (F.col("w") + PRIOR_SIZE)).alias("wide")
    return sums.select("grp", "half", wide, *mids, *devs)


def verdicts(marked: DataFrame) -> DataFrame:
    """Add base_failed, the deviations and kept to measured documents."""
    marked = marked.withColumn("base_failed", base_failed())
    judged = marked.where("not base_failed and fertility is not null")
    # As many rows as there are languages and half octaves.
    table = common.cut(smoothed(common.cut(bands(judged)), judged.select("grp", "half").distinct()))
    out = marked.join(table, ["grp", "half"], "left")
    for m in MEASURES:
        over = F.col(m) - F.col(f"mid_{m}")
        out = out.withColumn(f"z_{m}", over if m == "byte_share" else F.coalesce(F.try_divide(over, 1.4826 * F.col(f"dev_{m}")), F.lit(0.0)))
    fertility, information, wide = F.least("z_fertility", "z_byte_fertility"), F.least("z_entropy", "z_byte_entropy"), F.col("wide")
    odd = (fertility + information < JOINT_LOW * wide) | (fertility < FERTILITY_LOW * wide) | (F.greatest("z_fertility", "z_byte_fertility") > FERTILITY_HIGH * wide) | (F.col("z_byte_share") > BYTE_EXCESS)
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(odd, F.lit(True)))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Measures and verdict of every document."""
    return verdicts(common.cut(measured(docs, id_col, text_col, lang_col)))


def filter_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Documents that the rules keep; columns as in docs."""
    kept = judged(docs, id_col, text_col, lang_col).where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_key").alias("_kept_key")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_kept_id"]) & (F.xxhash64(docs[text_col].cast("string")) == kept["_kept_key"]), "left_semi")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *MEASURES)
