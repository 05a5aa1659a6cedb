"""Near-duplicates, substrings and fingerprints against brute force."""

import collections
import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tideline.llm import fingerprints, neardup, substrings
from tideline.llm.components import components
from tideline.llm.textbatch import TextBatch, combine

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def sets(rows, k):
    out = []
    for i, t in rows:
        w = WORD.findall(lower(t))
        out.append((i, frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    return out


def brute_components(rows, k, percent=80):
    s = [(i, x) for i, x in sets(rows, k) if x and i is not None]
    root = {i: i for i, _ in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(s)):
        for b in range(a):
            (i, x), (j, y) = s[a], s[b]
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                i, j = find(i), find(j)
                root[max(i, j)] = min(i, j)
    return {i: find(i) for i, _ in s}


def mutated(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = "z%d" % rng.randrange(10**6)
    return " ".join(w)


@pytest.fixture(scope="module")
def crowd(spark):
    """A large group of near copies of different distance, and a passage that many
    documents share."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base, passage = " ".join(word() for _ in range(120)), " ".join(word() for _ in range(60))
    rows = [(i, mutated(rng, base, rng.randint(0, 9))) for i in range(260)]
    rows += [(1000 + i, passage + " " + " ".join(word() for _ in range(40))) for i in range(150)]
    rows += [(2000 + i, " ".join(word() for _ in range(50))) for i in range(40)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("block", [512, 16])
def test_components_match_brute_force(crowd, monkeypatch, block):
    rows, df = crowd
    monkeypatch.setattr(neardup, "BLOCK", block)
    got = {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in neardup.cluster(df, neardup.Rule(4, 80)).collect()}
    size, want = dict(sets(rows, 4)), brute_components(rows, 4)
    assert got == {i: (c, len(size[i]), c == i) for i, c in want.items()}


def test_links_are_read_without_another_python_operator(crowd, monkeypatch):
    """A task that runs two of them holds two workers, which stay with the executor."""
    plans = []

    def seen(links):
        plans.append(links._jdf.queryExecution().executedPlan().toString())
        return components(links)

    monkeypatch.setattr(neardup, "components", seen)
    neardup.cluster(crowd[1], neardup.Rule(4, 80))
    assert len(plans) == 2 and not any("InArrow" in p for p in plans)


def test_hub_links_hold_a_slice_of_the_shared_shingles():
    rng = np.random.default_rng(5)
    n, hub = 100, np.arange(40_000) < 8_000
    own = [np.stack([np.where(hub, rng.random(40_000) < 0.95, rng.random(40_000) < rng.uniform(0, 0.06)) for _ in range(n)]) for _ in range(2)]
    blocks = [
        pa.array([{"node": lo + i, "component": (lo + i) // 3, "hub_size": 8_000, "missing": int((hub & ~x).sum()), "difference": np.flatnonzero(hub != x).astype(np.uint64).tobytes()} for i, x in enumerate(o)])
        for lo, o in ((0, own[0]), (3 * n, own[1]))
    ]
    tracemalloc.start()
    a, b = neardup.hub_links(*blocks, neardup.Rule(4, 80))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    both, size = own[0].astype(np.float32) @ own[1].T.astype(np.float32), [o.sum(1) for o in own]
    i, j = np.nonzero(100 * both >= 80 * (size[0][:, None] + size[1] - both))
    linked = set(zip(i.tolist(), (j + 3 * n).tolist()))
    assert 0 < len(linked) < n * n and set(zip(a.tolist(), b.tolist())) <= linked
    assert sorted(zip((a // 3).tolist(), (b // 3).tolist())) == sorted({(x // 3, y // 3) for x, y in linked})
    assert peak < 20 << 20, peak >> 20


def test_odd_rows_are_clustered(odd, odd_rows):
    out = neardup.cluster(odd, neardup.Rule(4, 80)).collect()
    want = brute_components([r[:2] for r in odd_rows], 4)
    assert len(out) == len(odd_rows)
    for r in out:
        assert r.component_id == want.get(r.doc_id, r.doc_id) and r.kept == (r.doc_id == r.component_id)
    kept = neardup.deduplicate(odd, neardup.Rule(4, 80))
    assert kept.columns == odd.columns and {20, 21} & {r.doc_id for r in kept.collect()} == set()


def test_nothing_to_cluster(nothing):
    assert neardup.cluster(nothing).count() == 0 and neardup.deduplicate(nothing).count() == 0


def test_components_of_a_chain(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101)]
    got = {r.node: r.component for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def brute_removal(texts, window):
    docs = [WORD.findall(t or "") for t in texts]
    seen = collections.Counter(tuple(w[i : i + window]) for w in docs for i in range(len(w) - window + 1))
    out = []
    for w in docs:
        bad = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                bad[i : i + window] = [True] * window
        kept = [x for x, b in zip(w, bad) if not b]
        out.append((len(w), sum(bad), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("window", [2, 7, 35, 50])
def test_removal_matches_brute_force(spark, odd_rows, window):
    rng = random.Random(window)
    long = odd_rows[-5][1] or odd_rows[0][1]
    texts = [r[1] for r in odd_rows]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 90))) for _ in range(60)]
    texts += ["w " * 36, "w " * 35, " ".join(map(str, range(60))), " ".join(map(str, range(3, 70))), long]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.removal_report(df, window).collect()}
    assert got == dict(enumerate(brute_removal(texts, window)))


def test_small_groups_give_the_same(spark, odd_rows):
    df = spark.createDataFrame([(i, r[1]) for i, r in enumerate(odd_rows)], "doc_id long, text string")
    schema = substrings.T.StructType([substrings.T.StructField("doc_id", substrings.T.LongType()), substrings.T.StructField("bad", substrings.T.LongType())])

    def finish(left, g, covered):
        ends = np.cumsum(g.counts)
        return substrings.pa.table({"doc_id": left.column("doc_id"), "bad": substrings.pa.array([int(covered[e - c : e].sum()) for c, e in zip(g.counts, ends)], substrings.pa.int64())})

    got = {r.doc_id: r.bad for r in substrings.mark_repeats(df, 20, schema, finish, group_bytes=2000).collect()}
    assert got == {i: b for i, (_, b, _) in enumerate(brute_removal([r[1] for r in odd_rows], 20))}


def test_removal_keeps_columns_and_clean_texts(odd, odd_rows, nothing):
    out = substrings.remove_repeats(odd, 40, length="n_chars")
    assert out.columns == odd.columns and out.count() == len(odd_rows)
    clean = {r.doc_id: r.text for r in out.collect()}
    assert clean[3] == odd_rows[3][1] and clean[0] == "" and clean[22] is None
    assert substrings.remove_repeats(nothing, 40).count() == 0 and substrings.removal_report(nothing).count() == 0


def test_edit_report_matches_brute_force(spark, odd_rows, monkeypatch):
    monkeypatch.setattr(fingerprints, "groups_for", lambda docs: 4)
    rows = [(i, r[1]) for i, r in enumerate(odd_rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in fingerprints.edit_report(df).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        e = t[: len(t) - cut] + following[:cut]
        a, b, c = fingerprints.fingerprints([t, e, following])
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert got[i].near_edited == (a == b).mean() and got[i].near_next == (a == c).mean()


def test_edit_report_of_odd_rows(odd, odd_rows, nothing):
    assert fingerprints.edit_report(odd).count() == len(odd_rows) and fingerprints.edit_report(nothing).count() == 0
    by_text = collections.defaultdict(set)
    for r in fingerprints.fingerprint(odd).join(odd.select("doc_id", "text"), "doc_id").distinct().collect():
        by_text[r.doc_id].add(r.fingerprint)
    assert by_text[0] == by_text[20]


def test_likeness_estimates_jaccard():
    rng = random.Random(2)
    w = [str(rng.random()) for _ in range(400)]
    a, b = " ".join(w), " ".join(w[:300] + [str(rng.random()) for _ in range(100)])
    x, y = fingerprints.fingerprints([a, b], 1024)
    assert abs((x == y).mean() - 300 / 500) < 0.06


def test_banded_pairs(spark):
    rng = random.Random(1)
    base = " ".join(str(rng.random()) for _ in range(200))
    rows = [(1, base), (2, base), (3, mutated(rng, base, 2)), (4, " ".join(str(rng.random()) for _ in range(200))), (5, None)]
    got = {(r.doc_a, r.doc_b) for r in fingerprints.near_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 2), (1, 3)}


def joined(links):
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_banded_pairs_join_all_that_share_a_bucket(spark, monkeypatch):
    """Copies of one text whose smallest id is not similar to all others."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(3)
    base = " ".join(str(rng.random()) for _ in range(200))
    rows = [(i, mutated(rng, base, rng.randint(2, 9))) for i in range(300)]
    x, starts = fingerprints.shingles(TextBatch([t for _, t in rows]))
    own = [set(x[a:b].tolist()) for a, b in zip(starts, starts[1:])]
    prints = fingerprints.fingerprints([t for _, t in rows]).reshape(len(rows), fingerprints.BANDS, -1)
    true = {}
    for b in range(len(rows)):
        for a in np.flatnonzero((prints[:b] == prints[b]).all(2).any(1)).tolist():
            j = len(own[a] & own[b]) / len(own[a] | own[b])
            if j >= 0.8:
                true[a, b] = j
    got = {(r.doc_a, r.doc_b): r.jaccard for r in fingerprints.near_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert len(true) > 20 and got.items() <= true.items()
    assert joined(got) == joined(true)


@pytest.mark.parametrize("k", [1, 2, 5, 35])
def test_combined_hashes_depend_on_the_words_alone(k):
    b = TextBatch(["a b c " * 40, "x a b c " + "a b c " * 39])
    b.split_words()
    h = combine(b.word_hashes(), k)
    assert h[0] == h[3] == h[121]
