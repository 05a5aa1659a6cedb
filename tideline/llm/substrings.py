"""Removal of word sequences that repeat anywhere in the corpus.

Windows of `window` words are found level by level. The lengths of the levels
double up to the window (9, 18, 35 for 35 words). A level looks only at windows
whose shorter parts were repeated at the levels before. Of the parts of a
window at one length, that with the least hash stands for the window: equal
windows pick equal parts, so a window whose part occurs once in the corpus can't
be repeated and is dropped for good. What survives all levels is compared whole.
First, runs of surviving windows between places that the content itself fixes
are compared as one; then the windows of runs that occur once are compared with
each other and with one copy of every repeated run.

Documents are dealt once to groups of a few megabytes. Each level sends every
group's distinct hashes, with counts, to one count per hash, and what repeats
goes back to the groups where it occurs. A hash that a third of all documents
share thus travels once per group, not once per place, and no task gathers more
than one entry per group for a hash.

The levels' hashes have 64 bits, which can only let too many windows through; what
decides in the end, equal runs and equal windows, has two independent 64-bit hashes
of words and windows. Null and empty texts have no words. Very long texts are hashed
whole. Windows count wherever they start, twice in one document or in repeated rows
too; there are no ties. Rows are kept apart even if ids repeat; an empty table gives
no rows; other columns, of whatever name, are carried through untouched if asked for.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import dealt, groups_for
from tideline.llm.textbatch import CHUNK_BYTES, TextBatch, combine, mix, release

WINDOW = 35
SHORTEST = 9
GROUP_BYTES = 4 << 20
_FOUND = "h long, g long, p int, n int, want boolean"
_SPAN, _WHOLE = -1, -2


def level_lengths(window: int, shortest: int = SHORTEST) -> list[int]:
    """Rising lengths, each at least half of the next one; the window isn't in."""
    out, at = [], window
    while at > 1 and (not out or -(-at // 2) >= shortest):
        at = -(-at // 2)
        out.insert(0, at)
    return out


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def contains(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == x


def unique_pairs(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (h, g) in order, how often each occurs, and one place of it."""
    order = np.lexsort((g, h))
    h, g = h[order], g[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    at = np.flatnonzero(fresh)
    return h[at], g[at], np.diff(np.append(at, len(h))), order[at]


def contains_pairs(known: tuple[np.ndarray, np.ndarray], h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Which pairs (h, g) are among the known ones, which are distinct and in order."""
    out, n = np.zeros(len(h), bool), len(known[0])
    left = np.arange(len(h))
    at = np.searchsorted(known[0], h)
    while len(left):
        left, at = left[at < n], at[at < n]
        same = known[0][at] == h[left]
        left, at = left[same], at[same]
        hit = known[1][at] == g[left]
        out[left[hit]] = True
        left, at = left[~hit], at[~hit] + 1
    return out


class Group:
    """Word hashes of one group's texts, and what is known of their windows."""

    def __init__(self, texts: list[str | None], window: int, twice: bool = False):
        self.window, parts, others, counts, lo = window, [], [], [], 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size < CHUNK_BYTES):
                size += len(texts[hi] or "")
                hi += 1
            b = TextBatch(texts[lo:hi])
            b.split_words()
            parts.append(b.word_hashes())
            if twice:
                others.append(b.word_hashes(1))
            counts.append(np.diff(b.words_before))
            lo = hi
        self.words = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        self.others = np.concatenate(others) if others else np.empty(0, np.uint64)
        self.counts = np.concatenate(counts) if counts else np.empty(0, np.int64)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.size = max(0, len(self.words) - window + 1)
        self.open = self.inside(window)
        self.least: dict[int, np.ndarray] = {}

    def inside(self, k: int) -> np.ndarray:
        n = max(0, len(self.words) - k + 1)
        return self.doc[len(self.doc) - n :] == self.doc[:n]

    def hashes(self, k: int) -> np.ndarray:
        return mix(combine(self.words, k)) if len(self.words) >= k else np.empty(0, np.uint64)

    def least_part(self, k: int) -> np.ndarray:
        if self.size == 0:
            return np.empty(0, np.uint64)
        self.part = self.hashes(k)
        return sliding_minimum(self.part, self.window - k + 1)

    def apply(self, k: int, repeated: np.ndarray) -> None:
        self.last = self.least_part(k)
        self.open &= contains(repeated, self.last)

    def part_counts(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes that stand for open windows, and how often they occur here."""
        chosen = np.unique(self.least_part(k)[self.open])
        if not len(chosen):
            return chosen, np.empty(0, np.int64)
        x = self.part[self.inside(k)]
        at = np.searchsorted(chosen, x)
        at[at == len(chosen)] = 0
        return chosen, np.bincount(at[chosen[at] == x], minlength=len(chosen))

    def spans(self) -> None:
        """Runs of open windows with the same least part, cut every `window`."""
        at = np.flatnonzero(self.open)
        self.whole = self.hashes(self.window)[at]
        self.other = mix(combine(self.others, self.window, 1), 1)[at] if len(at) else self.whole
        fresh = np.ones(len(at), bool)
        if len(at) > 1:
            fresh[1:] = (at[1:] != at[:-1] + 1) | (self.last[at[1:]] != self.last[at[:-1]])
        head = np.flatnonzero(fresh)
        run = np.repeat(np.arange(len(head)), np.diff([*head, len(at)]))
        fresh |= (np.arange(len(at)) - head[run]) % self.window == 0 if len(at) else fresh
        head = np.flatnonzero(fresh)
        tail = np.append(head[1:], len(at)) - 1 if len(head) else head
        self.at, self.span_of = at, np.repeat(np.arange(len(head)), tail - head + 1)

        def runs(x, seed):
            return mix(x[head] * np.uint64(0x9FB21C651E98DF25) + x[tail] + (tail - head).astype(np.uint64), seed)

        self.span, self.span_other = runs(self.whole, 5), runs(self.other, 6)

    def whole_counts(self, repeated: tuple, here_first: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows of spans that occur once, and of one copy of the repeated
        spans that this group speaks for; counts; whether this group asks."""
        ask = ~contains_pairs(repeated, self.span, self.span_other)[self.span_of]
        h, g, _, one = unique_pairs(self.span, self.span_other)
        speak = np.zeros(len(self.span), bool)
        speak[one] = contains_pairs(here_first, h, g)
        speak = speak[self.span_of]
        known = unique_pairs(self.whole[speak], self.other[speak])[:2]
        ah, ag, n, _ = unique_pairs(self.whole[ask], self.other[ask])
        rest = ~contains_pairs((ah, ag), *known)
        n = n + 2 * contains_pairs(known, ah, ag)
        more = int(rest.sum())
        return np.append(ah, known[0][rest]), np.append(ag, known[1][rest]), np.append(n, np.full(more, 2)), np.arange(len(ah) + more) < len(ah)

    def covered(self, spans: tuple, windows: tuple) -> np.ndarray:
        """Which words lie in a repeated window."""
        bad = self.at[contains_pairs(spans, self.span, self.span_other)[self.span_of] | contains_pairs(windows, self.whole, self.other)] if len(self.at) else self.at
        edge = np.zeros(len(self.words) + 1, np.int64)
        edge[bad] += 1
        np.subtract.at(edge, bad + self.window, 1)
        return np.cumsum(edge)[:-1] > 0


def known_group(texts: list[str | None], window: int, lengths: list[int], hits: pa.Table | None, twice: bool) -> tuple[Group, dict]:
    """The group and what hits tell: of each level the repeated hashes in order, of
    runs and windows as pairs, and the runs that this group speaks for."""
    level, h, other, first = (np.empty(0, np.int64),) * 4
    if hits is not None and hits.num_rows:
        level, h, other, first = (hits.column(c).to_numpy() for c in ("level", "h", "g", "first"))
    h, other, first = h.view(np.uint64), other.view(np.uint64), first.astype(bool)
    found: dict = {k: np.sort(h[level == k]) for k in lengths}
    for name, mine in ((_SPAN, level == _SPAN), (_WHOLE, level == _WHOLE), ("first", (level == _SPAN) & first)):
        found[name] = unique_pairs(h[mine], other[mine])[:2]
    return Group(texts, window, twice), found


def mark_repeats(docs: DataFrame, window: int, schema: T.StructType, finish, text: str = "text", shortest: int = SHORTEST, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Applies finish(table, group, covered) to each group's rows; covered tells of
    each word of the group whether a repeated window covers it."""
    if window < 2:
        raise ValueError("window must be 2 words or more")
    lengths = level_lengths(window, shortest)
    n = groups_for(docs, text, group_bytes)
    keys = [F.col(c) for c in docs.columns if not isinstance(docs.schema[c].dataType, (T.MapType, T.VariantType))]
    group = "__p"
    while group in docs.columns:
        group += "_"
    placed = dealt(docs.withColumn(group, F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")), group, n)

    def counted(step: int):
        """Hashes of one level, given the hits of all levels before."""

        def emit(key, left, right):
            texts = left.column(text).to_pylist()
            g, found = known_group(texts, window, lengths, right, step >= len(lengths))
            for k in lengths[: min(step, len(lengths))]:
                g.apply(k, found[k])
            if step < len(lengths):
                h, count = g.part_counts(lengths[step])
                other, want = np.zeros(len(h), np.uint64), np.ones(len(h), bool)
            else:
                g.spans()
                if step == len(lengths):
                    h, other, count, _ = unique_pairs(g.span, g.span_other)
                    want = np.ones(len(h), bool)
                else:
                    h, other, count, want = g.whole_counts(found[_SPAN], found["first"])
            del g, found
            release()
            return pa.table({"h": h.view(np.int64), "g": other.view(np.int64), "p": np.full(len(h), key[0].as_py(), np.int32), "n": np.minimum(count, 2).astype(np.int32), "want": want})

        return emit

    def alone(emit):
        return lambda key, left: emit(key, left, None)

    def finished(key, left, right):
        g, found = known_group(left.column(text).to_pylist(), window, lengths, right, True)
        for k in lengths:
            g.apply(k, found[k])
        g.spans()
        out = finish(left.drop_columns([group]), g, g.covered(found[_SPAN], found[_WHOLE]))
        del g, found
        release()
        return out

    def repeated(rows: DataFrame, level: int) -> DataFrame:
        asked = F.collect_list(F.when(F.col("want"), F.col("p")))
        counts = rows.groupBy("h", "g").agg(F.sum("n").alias("n"), F.min("p").alias("least"), asked.alias("ps")).filter("n > 1")
        back = counts.select(F.explode("ps").alias("__p"), "h", "g", "least")
        return back.select("__p", F.lit(level).alias("level"), "h", "g", (F.col("__p") == F.col("least")).alias("first"))

    hits: list[DataFrame] = []
    for step, level in enumerate((*lengths, _SPAN, _WHOLE)):
        if hits:
            before = dealt(reduce(DataFrame.unionByName, hits), "__p", n)
            rows = placed.groupBy(group).cogroup(before.groupBy("__p")).applyInArrow(counted(step), _FOUND)
        else:
            rows = placed.groupBy(group).applyInArrow(alone(counted(step)), _FOUND)
        hits.append(repeated(rows, level))
    everything = dealt(reduce(DataFrame.unionByName, hits), "__p", n)
    return placed.groupBy(group).cogroup(everything.groupBy("__p")).applyInArrow(finished, schema)


def removal_report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def finish(left, g, covered):
        ends = np.cumsum(g.counts)
        removed = [int(covered[e - c : e].sum()) for c, e in zip(g.counts, ends)]
        shas = []
        for t, c, e, r in zip(left.column("text").to_pylist(), g.counts, ends, removed):
            words = (t or "").encode("utf-8", "surrogatepass").split() if r < c else []
            if r and words:
                words = [w for w, bad in zip(words, covered[e - c : e].tolist()) if not bad]
            shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
        return pa.table({"doc_id": left.column("doc_id"), "n_words": g.counts, "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(shas, pa.string())})

    return mark_repeats(docs.select("doc_id", "text"), window, schema, finish)


def remove_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text", length: str | None = None) -> DataFrame:
    """docs without the words of repeated windows. A text that loses nothing stays
    as it is; else its kept words are joined by one space, keeping line breaks.
    length: a column that gets the new number of code points."""

    def finish(left, g, covered):
        ends, out = np.cumsum(g.counts), []
        for t, c, e in zip(left.column(text).to_pylist(), g.counts, ends):
            bad = covered[e - c : e]
            if not bad.any():
                out.append(t)
                continue
            lines, at = [], 0
            for line in t.encode("utf-8", "surrogatepass").split(b"\n"):
                words = line.split()
                kept = [w for w, b in zip(words, bad[at : at + len(words)].tolist()) if not b]
                at += len(words)
                if kept or not words:
                    lines.append(b" ".join(kept))
            out.append(b"\n".join(lines).decode("utf-8", "surrogatepass"))
        left = left.set_column(left.schema.get_field_index(text), text, pa.array(out, pa.string()))
        if length:
            left = left.set_column(left.schema.get_field_index(length), length, pa.array([len(t) if t is not None else None for t in out], pa.int64()))
        return left

    return mark_repeats(docs, window, docs.schema, finish, text)


def removal_sql(window: int = WINDOW) -> str:
    """The same as DuckDB SQL over the table documents: all windows as texts."""
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
v AS (SELECT r, i, array_to_string(w[i : i + {window - 1}], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - {window - 2})) AS i FROM d WHERE len(w) >= {window})),
bad AS (SELECT r, i FROM v WHERE k IN (SELECT k FROM v GROUP BY k HAVING count(*) > 1)),
covered AS (SELECT DISTINCT r, i + j AS p FROM bad, range(0, {window}) x(j)),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t FROM (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d) ANTI JOIN covered USING (r, p) GROUP BY r),
gone AS (SELECT r, count(*) AS n FROM covered GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)"""
