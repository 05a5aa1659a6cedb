"""Packing token sequences by Karmarkar-Karp multiway differencing.

A task tokenizes its documents one after another and cuts each into pieces of
the window length and one shorter rest. Full pieces are windows of their own.
Rests gather in a buffer of bounded size; each full buffer is dealt over
near-equal windows by multiway differencing. Nothing is shuffled, a task holds
one buffer at a time, and a task that is run again gives the same windows, as
windows are numbered by input partition and order.

Nulls and empty texts give one piece that holds only the end id; a null id is
carried through. Very long texts are cut into as many windows as they fill. Repeated
rows are packed like any others, and equally long rests in the order they are read.
An empty table gives no rows. Extra columns, of whatever names, are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tideline.llm.bpe import ByteBpe, tokenizer_path
from tideline.llm.textbatch import chunks, release

WINDOW = 2048
#: Rests are packed together once they hold so many windows of tokens.
BUFFER_WINDOWS = 160
#: A longer rest is halved, as pieces well below the window length pack tightly.
LONGEST_REST = 1024
END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: np.ndarray, m: int) -> list[list[int]]:
    """Deals items over m windows: the two partial partitions with the widest
    spread are merged largest sum to smallest sum, until one is left."""
    n = len(sizes)
    left, right = [], []
    heap = []
    for i, s in enumerate(sizes.tolist()):
        sums, nodes = np.zeros(m, np.int64), np.full(m, -1, np.int64)
        sums[-1], nodes[-1] = s, i
        heap.append((-s, i, sums, nodes))
    heapq.heapify(heap)
    order = n
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        sums, x = a[::-1] + b, x[::-1]
        nodes = np.where(x < 0, y, x)
        for j in np.flatnonzero((x >= 0) & (y >= 0)).tolist():
            nodes[j] = n + len(left)
            left.append(int(x[j]))
            right.append(int(y[j]))
        by = np.argsort(sums, kind="stable")
        sums, nodes = sums[by], nodes[by]
        sums = sums - sums[0]
        heapq.heappush(heap, (-int(sums[-1]), order, sums, nodes))
        order += 1
    out = []
    for node in heap[0][3].tolist():
        stack, items = [node] if node >= 0 else [], []
        while stack:
            k = stack.pop()
            if k < n:
                items.append(k)
            else:
                stack += (right[k - n], left[k - n])
        out.append(sorted(items))
    return out


def near_equal_windows(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Windows within capacity; their count rises until differencing fits."""
    m = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        windows = differencing(sizes, m)
        if max((int(sizes[w].sum()) for w in windows), default=0) <= capacity:
            return [w for w in windows if w]
        m += max(1, m // 100)


def cut_points(n: int, window: int, longest_rest: int) -> list[int]:
    """Where a document's n ids are cut: full windows, then one or two rests."""
    rest = n % window
    cuts = list(range(0, n - rest, window)) + [n - rest] * (rest > 0)
    if rest > longest_rest:
        cuts.append(n - rest // 2)
    return [*cuts, n]


def _lists(arrays: tuple[np.ndarray, ...]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).view(np.int32)))


def packer(path: str, window: int, end_id: int, longest_rest: int, buffer_windows: int, with_ids: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from (doc_id, text) to pieces placed in windows."""

    def run(batches):
        encode = ByteBpe(path)
        base = TaskContext.get().partitionId() << 32
        used, rests, rest_tokens = 0, [], 0

        def flush():
            nonlocal used, rests, rest_tokens
            if not rests:
                return []
            out = []
            for w in near_equal_windows(np.array([r[2] for r in rests], np.int64), window):
                at = 0
                for i in w:
                    out.append((*rests[i], base + used, at))
                    at += rests[i][2]
                used += 1
            rests, rest_tokens = [], 0
            return out

        def emit(rows):
            columns = list(zip(*rows))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids, "sequence_id", "offset"]
            arrays = [_lists(c) if k == "ids" else pa.array(c, pa.int64()) for k, c in zip(names, columns)]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in chunks(batches):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode.batch(batch.column("text").to_pylist())):
                ids = np.append(ids, end_id).astype("<u4")
                cuts = cut_points(len(ids), window, longest_rest)
                for a, b in zip(cuts, cuts[1:]):
                    piece = (doc_id, a, b - a, zlib.crc32(ids[a:b].tobytes()), len(ids), *([ids[a:b]] if with_ids else ()))
                    if b - a == window:
                        rows.append((*piece, base + used, 0))
                        used += 1
                    else:
                        rests.append(piece)
                        rest_tokens += b - a
                if rest_tokens >= buffer_windows * window:
                    rows += flush()
            if rows:
                yield emit(rows)
        if rows := flush():
            yield emit(rows)
        encode = None
        release()

    return run


def pack(
    docs: DataFrame,
    path: str | None = None,
    window: int = WINDOW,
    end_id: int = END_ID,
    longest_rest: int = LONGEST_REST,
    buffer_windows: int = BUFFER_WINDOWS,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece; with_ids adds the ids themselves.

    path is the vocabulary file, which every executor has under the same path; where
    it is missing the job fails.
    """
    schema = SCHEMA.replace("sequence_id", "ids array<int>, sequence_id") if with_ids else SCHEMA
    fn = packer(path or tokenizer_path(), window, end_id, longest_rest, buffer_windows, with_ids)
    return docs.select("doc_id", "text").mapInArrow(fn, schema)
