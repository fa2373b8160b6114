"""Positive-unlabelled quality classifier (operator 10).

Trusted positives are documents that the training labels mark as good;
everything else is unlabelled. A first network separates positives from
unlabelled text; the least ratio of unlabelled to positive mass above a score
(best-bin estimate, with a margin for its sampling error) is the class prior.
The classifier then minimises the non-negative unbiased risk: the positive part
weighted by the prior, plus the unlabelled negative risk less the share of it
that positives explain, held at zero where the estimate turns negative.

Inputs are measures of the text alone. The fit takes at most ``max_positive``
labelled and ``max_unlabelled`` unlabelled documents (the least hashes), on the
driver; every document is scored in Arrow batches.

Defined results: null and empty texts are scored by the measures of the empty
text; an id that has labels of both kinds is not a trusted positive; repeated
rows get equal scores and stand once in the sample; without any trusted positive every score is the default
prior; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .quality_rules import SPACES, duplicate_lines, repeat_words

#: Bounds of the sample that the classifier is fitted on, and the score that predicts 1.
MAX_POSITIVE, MAX_UNLABELLED, THRESHOLD = 12_000, 24_000, 0.3
HIDDEN, EPOCHS, BATCH, RATE, DECAY, DEFAULT_PRIOR = 24, 40, 512, 5e-3, 1e-4, 0.5
_CLASSES = np.zeros(256, np.int64)
for _k, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"#$%&*", b"|<>", b"\"'()[]{}", b"_=+-/\\@~^`", b" ", b"\n", b"\t\r\x0b\x0c"), 1):
    _CLASSES[list(_set)] = _k
_CLASSES[128:] = 13
N_CLASSES = 14


def measures(text: str) -> np.ndarray:
    """Measures of one text, each near unit scale."""
    data = text.encode()
    classes = np.bincount(_CLASSES[np.frombuffer(data, np.uint8)], minlength=N_CLASSES)
    words = data.split()
    n, size = len(words), max(1, len(data))
    tokens = max(1, n)
    lengths = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1)
    seen = Counter(words)
    top = seen.most_common(1)[0][1] if seen else 0
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    share = np.sqrt(classes[1:] / size)
    last = Counter(w[-1:] for w in words)
    odd = sum(v for k, v in last.items() if not (k.isalnum() or k >= b"\x80" or k in b".,"))
    upper = sum(w.isupper() for w in words)
    return np.array([
        *share, np.log1p(n) / 5, lengths.mean() / 10, lengths.std() / 10, np.log1p(lengths.max()) / 5,
        np.log1p(len(seen)) / np.log1p(tokens) if n else 1.0, len(seen) / tokens, top / tokens, odd / tokens, upper / tokens,
        duplicate_lines(text) / max(1, len(lines)), repeat_words(words) / tokens, len(lines) / tokens,
        len(zlib.compress(data, 1)) / size, float(n == 0),
    ])


N_MEASURES = len(measures(""))


class Network:
    """One hidden layer on standardised measures."""

    def __init__(self, x: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        d = x.shape[1]
        self.p = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.m, self.v, self.t = [np.zeros_like(w) for w in self.p], [np.zeros_like(w) for w in self.p], 0

    def ready(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def logits(self, z: np.ndarray) -> np.ndarray:
        return np.tanh(z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def step(self, z: np.ndarray, slope: np.ndarray) -> None:
        """Adam step down the risk whose slope by each logit is given."""
        h = np.tanh(z @ self.p[0] + self.p[1])
        back = np.outer(slope, self.p[2]) * (1 - h * h)
        grads = [z.T @ back + DECAY * self.p[0], back.sum(0), h.T @ slope + DECAY * self.p[2], slope.sum(keepdims=True)]
        self.t += 1
        for w, g, m, v in zip(self.p, grads, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= RATE * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(self.ready(x)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _epochs(positive: np.ndarray, unlabelled: np.ndarray, seed: int):
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        u = rng.permutation(len(unlabelled))
        for k in range(0, len(u), BATCH):
            yield positive[rng.integers(0, len(positive), BATCH)], unlabelled[u[k : k + BATCH]]


def fit_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 7) -> float:
    """Share of positives among the unlabelled, from one half after fitting on the other."""
    net = Network(np.concatenate([positive, unlabelled]), seed)
    zp, zu = net.ready(positive), net.ready(unlabelled)
    for p, u in _epochs(zp[::2], zu[::2], seed):
        z = np.concatenate([p, u])
        y = np.repeat([1.0, 0.0], [len(p), len(u)])
        net.step(z, (_sigmoid(net.logits(z)) - y) * np.repeat([0.5 / len(p), 0.5 / len(u)], [len(p), len(u)]))
    sp, su = np.sort(net.logits(zp[1::2])), np.sort(net.logits(zu[1::2]))
    if not len(sp) or not len(su):
        return DEFAULT_PRIOR
    at = np.quantile(sp, np.linspace(0, 0.9, 91))
    above_p, above_u = 1 - np.searchsorted(sp, at) / len(sp), 1 - np.searchsorted(su, at) / len(su)
    margin = np.sqrt(np.log(20) / 2) * (len(sp) ** -0.5 + len(su) ** -0.5)
    k = np.argmin((above_u + margin) / above_p)
    return float(np.clip(above_u[k] / above_p[k], 0.02, 0.98))


def risk(gp: np.ndarray, gu: np.ndarray, prior: float) -> tuple[float, float]:
    """Positive and negative part of the unbiased risk of logits of positives and of unlabelled rows, with the logistic loss."""
    return prior * np.logaddexp(0, -gp).mean(), np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()


def slopes(gp: np.ndarray, gu: np.ndarray, prior: float) -> np.ndarray:
    """Slope of the non-negative risk by each logit; where the negative part is below zero, the way back up from it."""
    as_positive, as_negative_p, as_negative_u = -prior * _sigmoid(-gp) / len(gp), -prior * _sigmoid(gp) / len(gp), _sigmoid(gu) / len(gu)
    if risk(gp, gu, prior)[1] >= 0:
        return np.concatenate([as_positive + as_negative_p, as_negative_u])
    return -np.concatenate([as_negative_p, as_negative_u])


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 7) -> Network:
    """Minimise the non-negative unbiased risk with the logistic loss."""
    net = Network(np.concatenate([positive, unlabelled]), seed)
    for p, u in _epochs(net.ready(positive), net.ready(unlabelled), seed):
        net.step(np.concatenate([p, u]), slopes(net.logits(p), net.logits(u), prior))
    return net


def held_out(id_col: str | Column, folds: int = 5, out: int = 0) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string")) % folds == out, F.lit(False))


def _sample(docs: DataFrame, limit: int) -> np.ndarray:
    """Measures of at most limit distinct rows: those with the least hash."""
    got = common.least_hashed(docs, limit, lambda t: measures(t).tolist(), "x array<double>", "x")
    return np.array(got, np.float64).reshape(-1, N_MEASURES)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> tuple[Network | None, float]:
    """Classifier and class prior from labels whose id is not held out."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    good = labels.where(F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).alias("lo")).where("lo = 1")
    # At most max_positive ids, so the broadcast is bounded.
    trusted = common.hashed_below(good.select("doc_id"), max_positive, "doc_id").orderBy("h", "doc_id").limit(max_positive).select("doc_id")
    positive = _sample(rows.join(F.broadcast(trusted), "doc_id", "left_semi"), max_positive)
    if not len(positive):
        return None, DEFAULT_PRIOR
    unlabelled = _sample(rows, max_unlabelled)
    prior = fit_prior(positive, unlabelled)
    return fit(positive, unlabelled, prior), prior


def score(docs: DataFrame, model: Network | None, prior: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): probability of the positive class."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        texts = common.strings(batch.column(1))
        if model is None:
            return {"doc_id": batch.column(0), "score": [prior] * len(texts)}
        return {"doc_id": batch.column(0), "score": model.scores(np.array([measures(t) for t in texts])).tolist()}

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return common.arrow_map(rows, run, f"doc_id {kind}, score double")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model, prior = train(docs, common.table(spark, sf_dir, "labels"))
    found = score(docs, model, prior)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
