"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes.

Texts are lower-cased (A-Z) and every n-gram of NGRAMS code points is hashed into
2**BITS features, present or absent. Each feature is scaled by its naive Bayes
log-count ratio between toxic and other labelled texts; logistic regression over
the scaled features gives the score. The KEPT_FEATURES whose counts differ most
from independence have weights (the README has the held-out loss of other numbers).
Fitting sees a bounded sample of labelled texts and runs in one task; only the
weights come to the driver. Scoring is one pass over whole texts without a shuffle.

Null and empty texts have no features and score the intercept. Very long texts are
scored whole, in a batch of their own. Repeated rows score alike, ties can't occur.
An empty table gives no rows. Without labelled rows of both classes every score is
the share of toxic labels (0 without labels). Other columns are never looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import counted, discard
from tideline.llm.sampling import FIT_ROWS, fitted, labelled, with_scores
from tideline.llm.textbatch import chunks

NGRAMS = (3, 4, 5)
BITS = 20
KEPT_FEATURES = 4000
RIDGE = 1e-4
STEPS = 300


class CodePoints:
    """Texts as one array of code points, A-Z lower-cased, a newline after each."""

    def __init__(self, texts: list[str | None]):
        raw = "\n".join([t or "" for t in texts]) + "\n"
        self.n = len(texts)
        self.points = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
        self.points += np.uint32(32) * ((self.points >= 65) & (self.points <= 90))
        self.stop = np.cumsum([len(t or "") + 1 for t in texts]) - 1


def ngram_hashes(c: CodePoints):
    """For each n: hashed features at every place, and which places are in one text."""
    x = c.points
    edge = np.zeros(len(x) + 1, np.int32)
    np.cumsum(np.bincount(c.stop, minlength=len(x)), out=edge[1:])
    h = x * np.uint32(0x9E3779B1)
    for n in range(2, max(NGRAMS) + 1):
        h = h[:-1] * np.uint32(0x01000193) + x[n - 1 :] * np.uint32(0x9E3779B1)
        if n in NGRAMS:
            mixed = (h ^ h >> np.uint32(15)) * np.uint32(0x85EBCA6B + 2 * n)
            yield mixed >> np.uint32(32 - BITS), edge[n:] == edge[: len(h)]


def features(texts: list[str | None]) -> list[np.ndarray]:
    """Each text's distinct features."""
    if not texts:
        return []
    c = CodePoints(texts)
    keys = []
    for h, inside in ngram_hashes(c):
        at = np.flatnonzero(inside)
        keys.append(np.searchsorted(c.stop, at).astype(np.uint64) << np.uint64(32) | h[at])
    keys = np.unique(np.concatenate(keys))
    return np.split((keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.searchsorted(keys >> np.uint64(32), np.arange(1, c.n)))


@dataclass
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        c = CodePoints(texts)
        slot = np.full(1 << BITS, -1, np.int32)
        slot[self.buckets] = np.arange(len(self.buckets))
        found = []
        for h, inside in ngram_hashes(c):
            at = np.flatnonzero((s := slot[h]) >= 0)
            at = at[inside[at]]
            found.append(np.searchsorted(c.stop, at) * len(self.buckets) + s[at])
        found = np.unique(np.concatenate(found))
        doc, feature = np.divmod(found, max(1, len(self.buckets)))
        z = np.bincount(doc, weights=self.weights[feature], minlength=c.n) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def constant(share: float) -> Model:
    """The model of a sample with labels of one class only, or of none."""
    share = float(np.clip(share, 1e-9, 1 - 1e-9))
    return Model(np.empty(0, np.int64), np.empty(0), float(np.log(share / (1 - share))))


def log_count_ratios(positive: np.ndarray, total: np.ndarray, n_positive: int, n: int) -> np.ndarray:
    """Of features: the log ratio of their smoothed shares among toxic and other texts."""
    return np.log((positive + 1) / (n_positive + 2)) - np.log((total - positive + 1) / (n - n_positive + 2))


def weighted(buckets: np.ndarray, ratio: np.ndarray, rows: list[tuple[int, np.ndarray]], ridge: float = RIDGE) -> Model:
    """Logistic regression over features scaled by ratio; rows: (label, which of the
    buckets the text has)."""
    kept, y = len(buckets), np.array([r[0] > 0 for r in rows], float)
    doc, feature = np.repeat(np.arange(len(rows)), [len(f) for _, f in rows]), np.concatenate([f for _, f in rows])
    value = ratio[feature]
    w, bias, seen_w, seen_b = np.zeros(kept), 0.0, np.full(kept, 1e-8), 1e-8
    for _ in range(STEPS):  # diagonal adaptive gradient steps
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, weights=value * w[feature], minlength=len(y)) + bias, -30, 30)))
        error = (p - y) / len(y)
        g, gb = np.bincount(feature, weights=value * error[doc], minlength=kept) + ridge * w, error.sum()
        seen_w += g * g
        seen_b += gb * gb
        w -= 0.2 * g / np.sqrt(seen_w)
        bias -= 0.2 * gb / np.sqrt(seen_b)
    return Model(buckets, w * ratio, float(bias))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", training=None, rows: int = FIT_ROWS, kept: int = KEPT_FEATURES) -> Model:
    """Counts of features by class, the choice of features, and then, in one task, the
    weights from short lists of the chosen features that each sampled text has."""
    sample, seen = counted(labelled(docs, labels, label, training, rows), "toxicity-sample", n=F.count("*"), positive=F.count_if(F.col("label") > 0))
    n, n_positive = seen["n"], seen["positive"]
    if not 0 < n_positive < n:
        return constant(n_positive / n if n else 0.0)

    def count(batches):
        total, positive = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
        for batch in chunks(batches):
            for y, f in zip(batch.column("label").to_pylist(), features(batch.column("text").to_pylist())):
                total[f] += 1
                if y > 0:
                    positive[f] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at]), pa.array(positive[at])], ["feature", "total", "positive"])

    counts = sample.select("label", "text").mapInArrow(count, "feature int, total int, positive int").groupBy("feature").agg(F.sum("total").alias("total"), F.sum("positive").alias("positive"))
    share = n_positive / n
    strength = F.abs(F.col("positive") - F.col("total") * share) / F.sqrt(F.col("total") * (share * (1 - share)) + 1)
    top = sorted(tuple(r) for r in counts.orderBy(strength.desc(), "feature").limit(kept).collect())
    buckets, total, positive = (np.array(c, np.int64) for c in zip(*top))
    ratio = log_count_ratios(positive, total, n_positive, n)

    def shortened(batches):
        slot = np.full(1 << BITS, -1, np.int32)
        slot[buckets] = np.arange(len(buckets))
        for batch in chunks(batches):
            found = [(s := slot[f])[s >= 0] for f in features(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([f.tobytes() for f in found], pa.binary())], ["doc_id", "label", "features"])

    short = sample.mapInArrow(shortened, "doc_id long, label int, features binary")
    model = fitted(short, lambda found: weighted(buckets, ratio, [(y, np.frombuffer(f, np.int32)) for _, y, f in found]))
    discard(sample)
    return model


def score(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """The columns carry of docs (all, if None) and score; a column of that name
    is replaced. The model that is sent out is a few thousand numbers."""
    return with_scores(docs, model, carry)
