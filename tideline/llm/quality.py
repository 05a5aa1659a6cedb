"""Document quality from a linear-chain conditional random field over lines.

Every line gets a label, good or bad. A line's features are its own measures
(letters, symbols, word shapes, repetition) and those of the lines before and
after it, each cut into bins, mostly at quantiles of the fit sample. In the fit sample
lines carry the label of their document. Forward-backward gives each line's
marginal of being good; their mean, weighted by line length, is calibrated into
the document's score.

Lines without any byte are passed over; a null or empty text counts as one empty
line. Repeated rows score alike, ties can't occur, other columns (also clashing
ones) aren't read, and an empty table gives no rows. Without labelled rows of both
classes the score is the share of good labels (0 without labels). One chain of two
states needs constant memory per line, so very long texts only need memory for
themselves. Fitting sees a bounded sample and runs in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tideline.llm.sampling import FIT_ROWS, fitted, labelled, with_scores
from tideline.llm.textbatch import TextBatch, chunks

BINS = 12
LINEAR = 4  # bin edges evenly between the extremes, for measures that are rarely above zero
STEPS = 150
RIDGE = 1e-3
_CLASSES = np.full(256, 5, np.int8)  # 5: other symbols
for _c, _bytes in enumerate(([*range(97, 123), *range(128, 256)], range(65, 91), range(48, 58), [0x20, *range(9, 14)], b".,;:'\"()-?")):
    _CLASSES[list(_bytes)] = _c
MEASURES = 11


def line_measures(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measures of all lines (rows of float32), their lengths in bytes, and the
    offsets of each text's first line (n + 1)."""
    b = TextBatch(texts)
    b.split_words()
    stop = np.flatnonzero(b.buffer == 10)
    start = np.concatenate(([0], stop[:-1] + 1))
    doc = np.searchsorted(b.stop, stop)
    some = np.zeros(b.n, bool)
    some[doc[stop > start]] = True
    keep = (stop > start) | (~some[doc] & (stop == b.stop[doc]))
    start, stop, doc = start[keep], stop[keep], doc[keep]
    size = np.maximum(stop - start, 1).astype(np.float64)
    kind = _CLASSES[b.buffer]
    out = np.empty((len(stop), MEASURES), np.float32)
    for c in range(6):
        total = np.concatenate(([0], np.cumsum(kind == c)))
        out[:, c] = (total[stop] - total[start]) / size
    first, last = np.searchsorted(b.word_start, start), np.searchsorted(b.word_start, stop)
    words = last - first
    hashes = b.word_hashes()
    again = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes) > 1:
        again[2:] = np.cumsum((hashes[1:] == hashes[:-1]) & (b.word_doc[1:] == b.word_doc[:-1]))
    odd = np.concatenate(([0], np.cumsum(kind[b.word_stop - 1] == 5)))
    out[:, 6] = np.log2(size)
    out[:, 7] = size / np.maximum(words, 1)
    out[:, 8] = (again[last] - again[np.minimum(first + 1, last)]) / np.maximum(words, 1)
    out[:, 9] = (odd[last] - odd[first]) / np.maximum(words, 1)
    out[:, 10] = np.log2(words + 1)
    return out, stop - start, np.searchsorted(doc, np.arange(b.n + 1))


def chain_order(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts by falling number of lines, and how many have a t-th line."""
    lines = np.diff(offsets)
    order = np.argsort(-lines, kind="stable")
    return order, np.searchsorted(-lines[order], -np.arange(1, lines.max(initial=0) + 1), side="right")


@dataclass
class Model:
    edges: np.ndarray  # measures x (bins - 1)
    weights: np.ndarray  # (3, measures, bins): of the line before, the line, the line after
    bias: float
    chain: np.ndarray  # 2 x 2 log scores of (label, next label); 1: good
    slope: float
    shift: float

    def bins(self, measures: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, m, side="left") for e, m in zip(self.edges, measures.T)], 1)

    def emissions(self, bins: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log odds of good from the features alone."""
        per = np.take_along_axis(self.weights[:, None], bins[None, :, :, None], 3)[..., 0].sum(2)
        e = per[1] + self.bias
        inner = np.ones(len(bins), bool)
        inner[offsets[:-1][np.diff(offsets) > 0]] = False
        at = np.flatnonzero(inner)
        e[at] += per[0][at - 1]
        e[at - 1] += per[2][at]
        return e

    def messages(self, e: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log ratios good : bad of the forward and the backward messages."""
        a = np.exp(self.chain)
        order, active = chain_order(offsets)
        first, end = offsets[:-1][order], offsets[1:][order]
        fwd, bwd = np.zeros(len(e)), np.zeros(len(e))
        for t, n in enumerate(active.tolist()):
            at = first[:n] + t
            if t:
                r = np.exp(fwd[at - 1])
                fwd[at] = np.clip(e[at] + np.log((r * a[1, 1] + a[0, 1]) / (r * a[1, 0] + a[0, 0])), -30, 30)
                at = end[:n] - 1 - t
                s = np.exp(np.clip(e[at + 1] + bwd[at + 1], -30, 30))
                bwd[at] = np.log((s * a[1, 1] + a[1, 0]) / (s * a[0, 1] + a[0, 0]))
            else:
                fwd[at] = np.clip(e[at], -30, 30)
        return fwd, bwd

    def document_means(self, texts: list[str | None]) -> np.ndarray:
        measures, size, offsets = line_measures(texts)
        fwd, bwd = self.messages(self.emissions(self.bins(measures), offsets), offsets)
        good = 1 / (1 + np.exp(-(fwd + bwd)))
        weight = np.maximum(size, 1)
        return np.add.reduceat(good * weight, offsets[:-1]) / np.add.reduceat(weight, offsets[:-1])

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.edges):
            return np.full(len(texts), 1 / (1 + np.exp(-self.shift)))
        return 1 / (1 + np.exp(-np.clip(self.slope * _log_odds(self.document_means(texts)) + self.shift, -30, 30)))


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 0.01, 0.99)
    return np.log(p / (1 - p))


def fit_texts(texts: list[str | None], labels: list[int]) -> Model:
    y = np.array([int(v > 0) for v in labels], float)
    if not 0 < y.sum() < len(y):
        share = np.clip(y.mean(), 1e-9, 1 - 1e-9) if len(y) else 1e-9
        return Model(np.empty((0, 0)), np.zeros((3, 0, 0)), 0.0, np.zeros((2, 2)), 0.0, float(np.log(share / (1 - share))))
    return fit_measures([line_measures([t])[:2] for t in texts], y)


def fit_measures(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Model:
    """Maximises the chains' conditional likelihood by adaptive gradient steps."""
    measures, size = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    offsets = np.concatenate(([0], np.cumsum([len(r[0]) for r in rows])))
    line_doc = np.repeat(np.arange(len(rows)), np.diff(offsets))
    gold = y[line_doc]
    quantiles = [np.quantile(m, np.linspace(0, 1, BINS - LINEAR + 1)[1:-1]) for m in measures.T]
    between = [m.min() + (m.max() - m.min()) * np.array([0.1, 0.3, 0.5, 0.7][:LINEAR]) for m in measures.T]
    edges = np.stack([np.concatenate(x) for x in zip(quantiles, between)])
    model = Model(np.sort(edges, 1), np.zeros((3, MEASURES, BINS)), 0.0, np.zeros((2, 2)), 1.0, 0.0)
    bins = model.bins(measures)
    flat = bins + np.arange(MEASURES) * BINS
    joined = np.flatnonzero(line_doc[1:] == line_doc[:-1])  # lines that have a next one
    seen = [np.full((3, MEASURES, BINS), 1e-8), 1e-8, np.full((2, 2), 1e-8)]
    n = len(rows)
    scale = 1 / np.sqrt(np.diff(offsets))[line_doc]  # long texts count by the root of their lines

    def binned(error):
        return np.bincount(flat.ravel(), weights=np.repeat(error, MEASURES), minlength=MEASURES * BINS).reshape(MEASURES, BINS)

    for _ in range(STEPS):
        e = model.emissions(bins, offsets)
        fwd, bwd = model.messages(e, offsets)
        error = (1 / (1 + np.exp(-(fwd + bwd))) - gold) * scale / n
        before, after = np.zeros(len(error)), np.zeros(len(error))
        before[joined], after[joined + 1] = error[joined + 1], error[joined]
        g = np.stack([binned(before), binned(error), binned(after)]) + RIDGE / 10 * model.weights
        pair = np.exp(model.chain)[None] * np.exp(np.clip(fwd[joined], -30, 30))[:, None, None] ** np.array([0, 1])[:, None]
        pair = pair * np.exp(np.clip(e[joined + 1] + bwd[joined + 1], -30, 30))[:, None, None] ** np.array([0, 1])
        pair /= pair.sum((1, 2), keepdims=True)
        truth = np.zeros_like(pair)
        truth[np.arange(len(joined)), gold[joined].astype(int), gold[joined + 1].astype(int)] = 1
        gc = ((pair - truth) * scale[joined][:, None, None]).sum(0) / n + RIDGE * model.chain
        gb = error.sum()
        for k, v in enumerate((g, gb, gc)):
            seen[k] = seen[k] + v * v
        model.weights = model.weights - 0.1 * g / np.sqrt(seen[0])
        model.bias -= 0.1 * gb / np.sqrt(seen[1])
        model.chain = model.chain - 0.1 * gc / np.sqrt(seen[2])
    fwd, bwd = model.messages(model.emissions(bins, offsets), offsets)
    good, weight = 1 / (1 + np.exp(-(fwd + bwd))), np.maximum(size, 1)
    x = _log_odds(np.add.reduceat(good * weight, offsets[:-1]) / np.add.reduceat(weight, offsets[:-1]))
    w = np.array([1.0, 0.0])
    for _ in range(50):  # Newton steps of the calibration
        p = 1 / (1 + np.exp(-np.clip(w[0] * x + w[1], -30, 30)))
        design, h = np.stack([x, np.ones(n)]), p * (1 - p) + 1e-9
        w -= np.linalg.solve(design * h @ design.T + np.eye(2) * 1e-3, design @ (p - y) + 1e-3 * w)
    model.slope, model.shift = float(w[0]), float(w[1])
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", training=None, rows: int = FIT_ROWS) -> Model:
    """Line measures are taken where the sampled texts lie and fitted in one task."""

    def measured(batches):
        for batch in chunks(batches):
            m, size, offsets = line_measures(batch.column("text").to_pylist())
            parts = list(zip(offsets, offsets[1:]))
            arrays = [pa.array([m[a:b].tobytes() for a, b in parts], pa.binary()), pa.array([size[a:b].tobytes() for a, b in parts], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *arrays], ["doc_id", "label", "measures", "sizes"])

    def learn(sample):
        y = np.array([float(r[1] > 0) for r in sample])
        if not 0 < y.sum() < len(y):
            return fit_texts([""] * len(y), y.astype(int).tolist())
        return fit_measures([(np.frombuffer(m, np.float32).reshape(-1, MEASURES), np.frombuffer(s, np.int64)) for _, _, m, s in sample], y)

    return fitted(labelled(docs, labels, label, training, rows).mapInArrow(measured, "doc_id long, label int, measures binary, sizes binary"), learn)


def score(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """The columns carry of docs (all, if None) and score; a column of that name
    is replaced. The model that is sent out is a few hundred numbers."""
    return with_scores(docs, model, carry)
