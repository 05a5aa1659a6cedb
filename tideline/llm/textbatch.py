"""Vectorised byte, word and shingle hashing over a batch of whole texts.

A batch joins the UTF-8 texts with one separator byte, so every numpy pass runs
over all texts at once. Words are maximal runs of bytes other than the ASCII
white space 0x20 and 0x09-0x0D, which never occur inside a UTF-8 sequence.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U64 = np.uint64
#: Bases of two independent word hashes.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_STEP = (U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text that are hashed together; one longer text makes a batch alone.
CHUNK_BYTES = 1 << 19


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser, so that low and high bits are usable."""
    x = values + U64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def release() -> None:
    """Gives the memory that numpy and Arrow have freed, but still hold, back to the
    system: workers outlive their tasks, and an executor has several."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


class _Powers:
    """Powers of a word hash's base and of its inverse, grown when needed."""

    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def of(cls, n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        if which not in cls.held or len(cls.held[which][0]) < n:
            tables = []
            for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
                p = np.full(max(n, CHUNK_BYTES + 65536), base, U64)
                p[0] = 1
                tables.append(np.multiply.accumulate(p))
            cls.held[which] = tuple(tables)
        up, down = cls.held[which]
        return up[:n], down[:n]


class TextBatch:
    """Texts joined by a newline; null texts count as empty."""

    def __init__(self, texts: Sequence[str | None], lower: bool = False):
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        if lower:
            raw = [r.lower() for r in raw]
        self.raw = raw
        self.n = len(raw)
        sizes = np.fromiter(map(len, raw), np.int64, self.n)
        self.buffer = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        self.stop = np.cumsum(sizes + 1) - 1
        self.start = self.stop - sizes

    def split_words(self) -> None:
        """Sets word_start, word_stop, word_doc and words_before (n + 1 offsets)."""
        solid = ~_SPACE[self.buffer]
        edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
        if solid[0]:
            edge = np.concatenate(([0], edge))
        self.word_start, self.word_stop = edge[0::2], edge[1::2]
        self.words_before = np.concatenate(([0], np.searchsorted(self.word_start, self.stop)))
        self.word_doc = np.repeat(np.arange(self.n), np.diff(self.words_before))

    def word_hashes(self, which: int = 0) -> np.ndarray:
        up, down = _Powers.of(len(self.buffer) + 1, which)
        prefix = np.zeros(len(self.buffer) + 1, U64)
        np.cumsum((self.buffer.astype(U64) + U64(1)) * up[:-1], out=prefix[1:])
        return mix((prefix[self.word_stop] - prefix[self.word_start]) * down[self.word_start], which)

    def windows(self, hashes: np.ndarray, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word windows of one text each, and their first words."""
        if len(hashes) < k:
            return np.empty(0, U64), np.empty(0, np.int64)
        at = np.flatnonzero(self.word_doc[k - 1 :] == self.word_doc[: len(hashes) - k + 1])
        return mix(combine(hashes, k, which), which)[at], at


def combine(hashes: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Polynomial of k consecutive hashes at every place, by doubling the width."""
    step, out, have = _STEP[which], hashes, 1
    width = {1: hashes}
    while have * 2 <= k:
        out = out[:-have] * _power(step, have) + out[have:]
        have *= 2
        width[have] = out
    left, n = k - have, len(hashes) - k + 1
    out = out[:n] if left else out
    at = have
    for w in sorted(width, reverse=True):
        if left >= w:
            out = out * _power(step, w) + width[w][at : at + n]
            at, left = at + w, left - w
    return out


def _power(base: np.uint64, n: int) -> np.uint64:
    return U64(pow(int(base), n, 1 << 64))


def shingle_sets(batch: TextBatch, k: int) -> list[np.ndarray]:
    """Each text's distinct k-word shingles, sorted; a shorter text is one shingle."""
    hashes = batch.word_hashes()
    values, at = batch.windows(hashes, k)
    counts = np.diff(batch.words_before)
    doc = batch.word_doc[at]
    if len(short := np.flatnonzero((counts > 0) & (counts < k))):
        whole = []
        for d in short:
            a, b = batch.words_before[d : d + 2]
            whole.append(mix(combine(hashes[a:b], b - a), 17 + int(b - a))[0])
        values, doc = np.concatenate((values, np.array(whole, U64))), np.concatenate((doc, short))
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    values, doc = values[fresh], doc[fresh]
    return np.split(values, np.searchsorted(doc, np.arange(1, batch.n)))


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about limit bytes of text each, one row at least."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    release()
