"""MinHash fingerprints of whole texts.

A text's shingles are the runs of five words that end at each of its words, with
four marks before its first word, so that short texts have shingles too. Each of
PERMUTATIONS universal hash functions a * x + b keeps its least value over the
shingles; 16 bits of each make the fingerprint. The likeness of two fingerprints
is the share of equal places, an estimate of the Jaccard index.

Null texts count as empty. Texts without words share one fingerprint. Repeated
rows have equal fingerprints. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.llm.common import durable, groups_for
from tideline.llm.components import components
from tideline.llm.textbatch import TextBatch, chunks, combine, mix

PERMUTATIONS = 64
SHINGLE_WORDS = 5
BANDS = 16
THRESHOLD = 0.8
_MARK = np.uint64(0x5851F42D4C957F2D)
#: Shingles hashed by all permutations while they are in the processor's cache.
_BLOCK = 1 << 14


def permutations(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, np.uint64)


def minima(shingles: np.ndarray, starts: np.ndarray, n: int, count: int, seed: int = 7) -> np.ndarray:
    """Least value of each permutation over runs of shingles (n x count);
    the greatest number for an empty run. starts: n + 1 offsets."""
    out = np.full((n, count), np.iinfo(np.uint64).max, np.uint64)
    a, b = permutations(count, seed)
    for lo in range(0, len(shingles), _BLOCK):
        x = shingles[lo : lo + _BLOCK]
        d0, d1 = np.searchsorted(starts, lo, side="right") - 1, np.searchsorted(starts, lo + len(x), side="left")
        runs = np.arange(d0, d1)
        runs = runs[starts[runs + 1] > np.maximum(starts[runs], lo)]
        cuts = np.maximum(starts[runs] - lo, 0)
        for k in range(count):
            low = np.minimum.reduceat(x * a[k] + b[k], cuts)
            out[runs, k] = np.minimum(out[runs, k], low)
    return out


def shingles(batch: TextBatch, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes, one for each word, and each text's offsets (n + 1)."""
    batch.split_words()
    h = batch.word_hashes()
    marked = np.insert(h, np.repeat(batch.words_before[:-1], words - 1), _MARK)
    if len(marked) < words:
        return np.empty(0, np.uint64), np.zeros(batch.n + 1, np.int64)
    at = np.arange(len(h)) + (words - 1) * batch.word_doc
    return mix(combine(marked, words)[at]), batch.words_before


def fingerprints(texts: list[str | None], count: int = PERMUTATIONS) -> np.ndarray:
    """n x count numbers of 16 bits."""
    x, starts = shingles(TextBatch(texts) if not isinstance(texts, TextBatch) else texts)
    return (minima(x, starts, len(starts) - 1, count) >> np.uint64(20)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(1)


def _hex(prints: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes().hex() for r in prints.astype(">u2")], pa.string())


def fingerprint(docs: DataFrame, count: int = PERMUTATIONS) -> DataFrame:
    """(doc_id, fingerprint, n_shingles) in one pass."""

    def run(batches):
        for batch in chunks(batches):
            x, starts = shingles(TextBatch(batch.column("text").to_pylist()))
            prints = (minima(x, starts, batch.num_rows, count) >> np.uint64(20)).astype(np.uint16)
            n = [len(np.unique(x[a:b])) for a, b in zip(starts, starts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _hex(prints), pa.array(n, pa.int64())], ["doc_id", "fingerprint", "n_shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string, n_shingles long")


def _sketch(docs: DataFrame, count: int) -> DataFrame:
    """(doc_id, fingerprint, shingles) of texts with words; shingles: the sorted set."""

    def run(batches):
        for batch in chunks(batches):
            x, starts = shingles(TextBatch(batch.column("text").to_pylist()))
            prints = (minima(x, starts, batch.num_rows, count) >> np.uint64(20)).astype(np.uint16)
            sets = [np.unique(x[a:b]).tobytes() for a, b in zip(starts, starts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _hex(prints), pa.array(sets, pa.binary())], ["doc_id", "fingerprint", "shingles"])

    named = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text")
    return named.mapInArrow(run, "doc_id long, fingerprint string, shingles binary").filter(F.octet_length("shingles") > 0)


def _links(batches, threshold: float):
    """(a, b, jaccard) of rows (a, b, set_a, set_b) that reach the threshold."""
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "set_a", "set_b")))
        found = []
        for a, b, x, y in rows:
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, True))
            found.append((a, b, both / (len(x) + len(y) - both)))
        yield _linked([f for f in found if f[2] >= threshold])


def _linked(found: list[tuple[int, int, float]]) -> pa.RecordBatch:
    columns = list(zip(*found)) or [()] * 3
    kinds = (pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["a", "b", "jaccard"])


def _across(band: int, same_block: bool, m1: list[dict], m2: list[dict], threshold: float, bands: int) -> list[tuple[int, int, float]]:
    """Links between two blocks that join all components which the pairs of their
    members join. A pair counts in the first band that it shares."""

    def values(members):
        prints = np.array([list(m["fingerprint"]) for m in members])
        return prints[:, : prints.shape[1] // bands * bands].reshape(len(members), bands, -1)

    n1, n2 = ([m["node"] for m in ms] for ms in (m1, m2))
    c1, c2 = (np.array([m["component"] for m in ms], np.int64) for ms in (m1, m2))
    v1, v2 = values(m1), values(m2)
    s1, s2 = ([np.frombuffer(m["shingles"], np.uint64) for m in ms] for ms in (m1, m2))
    size2 = np.array([len(x) for x in s2], np.int64)
    starts = np.concatenate(([0], np.cumsum(size2)[:-1]))
    known, codes = np.unique(np.concatenate(s2), return_inverse=True)
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while c in root:
            c = root[c]
        return c

    out = []
    for i, (x, c) in enumerate(zip(s1, c1)):
        asked = (c2 != c) & ((v2 == v1[i]).all(2).argmax(1) == band)
        if same_block:
            asked[: i + 1] = False
        if not asked.any():
            continue
        mark = np.zeros(len(known), np.int64)
        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
        mark[at[known[at] == x]] = 1
        both = np.add.reduceat(mark[codes], starts)
        jaccard = both / (len(x) + size2 - both)
        for j in np.flatnonzero(asked & (jaccard >= threshold)).tolist():
            p, q = find(int(c)), find(int(c2[j]))
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((min(n1[i], n2[j]), max(n1[i], n2[j]), float(jaccard[j])))
    return out


def near_pairs(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, count: int = PERMUTATIONS) -> DataFrame:
    """(doc_a, doc_b, jaccard) of documents whose Jaccard index over their shingles
    is threshold or more. The links join the same components as all such pairs
    that share a band bucket, but a component doesn't have all its pairs.

    Each member of a bucket is compared with the bucket's smallest document first.
    Members that are still of different components are compared exactly, block by
    block, and a pair of blocks gives no more links than it has members. Documents
    of equal shingles join by their class's smallest id. Null ids take no part.
    """
    from tideline.llm.neardup import block_pairs  # which imports this module

    width = count // bands * 4
    key = ["fingerprint", "size", "set"]
    prints = durable(_sketch(docs, count).withColumns({"size": F.octet_length("shingles"), "set": F.xxhash64("shingles")}), "sketches")
    classes = durable(prints.groupBy(*key).agg(F.min("doc_id").alias("node"), F.first("shingles").alias("shingles")), "classes")
    posted = classes.select("node", F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.substring("fingerprint", i * width + 1, width).alias("value")) for i in range(bands)])).alias("b"), *key).select("node", "b.*", *key)
    heads = posted.groupBy("band", "value").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    stars = posted.join(heads, ["band", "value"]).filter("node > a").select("a", F.col("node").alias("b")).distinct()
    own = prints.select("doc_id", *key).join(classes.select("node", *key), key).filter("doc_id > node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("jaccard"))
    sets = classes.select("node", "shingles")
    asked = stars.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b").select("a", "b", "set_a", "set_b")
    linked = "a long, b long, jaccard double"
    links = durable(asked.mapInArrow(lambda batches: _links(batches, threshold), linked), "star-links")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                band, s1, s2, m1, m2 = (batch.column(c)[k].as_py() for c in ("band", "s1", "s2", "m1", "m2"))
                yield _linked(_across(band, s1 == s2, m1, m2, threshold, bands))

    members = posted.join(heads.drop("a"), ["band", "value"], "left_semi").join(classes.select("node", "shingles", *key), ["node", *key])
    printed = members.select("band", "value", "node", F.unhex("fingerprint").alias("fingerprint"), "shingles")
    blocks, _ = block_pairs(printed, components(links.select("a", "b")), ["band", "value"], ["fingerprint", "shingles"])
    rest = blocks.select("band", "s1", "s2", "m1", "m2").mapInArrow(run, linked)
    return links.union(own).union(rest).groupBy(F.col("a").alias("doc_a"), F.col("b").alias("doc_b")).agg(F.max("jaccard").alias("jaccard"))


def edited(text: str, following: str) -> str:
    """The last third of text replaced by as much of the start of the following."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit_report(docs: DataFrame, count: int = PERMUTATIONS) -> DataFrame:
    """Fingerprints of each text and of its edited text, by falling doc_id.

    Texts are dealt out once by ranges of doc_id. A task compares neighbours and
    hands on its first text and its last, unfinished one; these few edges are
    matched by range number afterwards. Equal ids are ordered by text; rows with
    a null id come last.
    """

    def run(batches):
        part, held, first = TaskContext.get().partitionId(), None, True
        for batch in chunks(batches):
            ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            if first:
                yield _edge(part, "first", ids[0], texts[0])
                first = False
            if held:
                ids, texts = [held[0], *ids], [held[1], *texts]
            held = (ids[-1], texts[-1])
            if len(ids) > 1:
                yield _report(part, ids[:-1], texts, count)
        if held:
            yield _edge(part, "last", *held)

    n = groups_for(docs)
    order = [F.desc_nulls_last("doc_id"), F.asc_nulls_first("text")]
    dealt = docs.select("doc_id", "text").repartitionByRange(n, F.desc_nulls_last("doc_id")).sortWithinPartitions(*order)
    found = durable(dealt.mapInArrow(run, f"part int, kind string, text string, {FIELDS}"), "edits")
    edges = found.filter("kind <> 'row'")
    firsts = edges.filter("kind = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    # Two rows for each range: the window and the edges' texts stay small.
    numbers = edges.filter("kind = 'first'").select("part")
    around = Window.orderBy("part")
    next_of = numbers.select("part", F.coalesce(F.lead("part").over(around), F.min("part").over(around)).alias("next_part"))
    pairs = edges.filter("kind = 'last'").select("part", "doc_id", "text").join(next_of, "part").join(firsts, "next_part")

    def close(batches):
        for batch in batches:
            for i, a, b in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "next_text"))):
                whole = _report(0, [i], [a, b], count)
                yield whole.select(whole.schema.names[3:])

    rows = found.filter("kind = 'row'").drop("part", "kind", "text")
    return rows.unionByName(pairs.select("doc_id", "text", "next_text").mapInArrow(close, FIELDS))


_NAMES = ["part", "kind", "text", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _edge(part: int, kind: str, doc_id: int | None, text: str) -> pa.RecordBatch:
    empty = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([kind]), pa.array([text]), pa.array([doc_id], pa.int64()), *empty], _NAMES)


def _report(part: int, ids: list, texts: list[str], count: int) -> pa.RecordBatch:
    """Rows for all texts but the last, which only follows."""
    n = len(ids)
    after = [edited(a, b) for a, b in zip(texts, texts[1:])]
    own, new = fingerprints(texts, count), fingerprints(after, count)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part] * n, pa.int32()),
            pa.array(["row"] * n),
            pa.nulls(n, pa.string()),
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in after]),
            _hex(own[:-1]),
            _hex(new),
            pa.array(likeness(own[:-1], new)),
            pa.array(likeness(own[:-1], own[1:])),
        ],
        _NAMES,
    )
