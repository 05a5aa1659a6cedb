"""The methods themselves, against plain versions of each."""

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import common, graphsearch, packing, pieces, sampling, substrings, toxicity, urltree
from tideline.llm.bpe import _SUSPECT, UNSURE, ByteBpe, tokenizer_path

# ---- toxicity --------------------------------------------------------------------


def ngrams(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return {t[i : i + n] for n in toxicity.NGRAMS for i in range(len(t) - n + 1)}


def test_features_are_the_ngrams_of_code_points():
    texts = ["Grün 日本語 grün", None, "", "ab", "ÄÄÄÄ\U0001f600x\U0001f600x", "the the the"]
    found = toxicity.features(texts)
    assert [len(f) for f in found] == [len(ngrams(t)) for t in texts]  # no collision among so few
    alone = [toxicity.features([t])[0].tolist() for t in texts]
    assert alone == [f.tolist() for f in found]
    assert set(toxicity.features(["GRüN"])[0]) & set(found[0]) and toxicity.features(["ABC"])[0].tolist() == toxicity.features(["abc"])[0].tolist()


def test_counts_choice_and_scale_follow_naive_bayes(spark):
    """The chosen features and their scales, counted over texts as sets of n-grams."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(3, 30))) + ("zq" if i % 3 == 0 else "") for i in range(90)]
    labels = [int(i % 3 == 0) for i in range(90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    y = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    model = toxicity.fit(docs, y, "toxic", kept=12)
    total, positive, share = {}, {}, sum(labels) / 90
    for t, v in zip(texts, labels):
        for g in ngrams(t):
            total[g], positive[g] = total.get(g, 0) + 1, positive.get(g, 0) + v
    strength = {g: abs(positive[g] - total[g] * share) / np.sqrt(total[g] * share * (1 - share) + 1) for g in total}
    number = {g: next(int(f) for f in toxicity.features([g])[0] if len(toxicity.features([g])[0]) == 1 or f not in np.concatenate(toxicity.features([g[1:], g[:-1]]))) for g in total}
    best = sorted(total, key=lambda g: (-round(strength[g], 12), number[g]))[:12]
    assert sorted(number[g] for g in best) == model.buckets.tolist()
    by = {number[g]: g for g in best}
    want = [np.log((positive[by[b]] + 1) / (30 + 2)) - np.log((total[by[b]] - positive[by[b]] + 1) / (60 + 2)) for b in model.buckets]
    got = toxicity.log_count_ratios(np.array([positive[by[b]] for b in model.buckets]), np.array([total[by[b]] for b in model.buckets]), 30, 90)
    assert np.allclose(want, got)
    scores = model.score(texts)
    z = [sum(w for b, w in zip(model.buckets, model.weights) if by[b] in ngrams(t)) + model.bias for t in texts]
    assert np.allclose(scores, 1 / (1 + np.exp(-np.array(z))))


def test_the_sample_is_bounded(spark):
    rows = [(i, "x" * (10 if i else 50_000), "a", "b") for i in range(40)] + [(1, "y", "a", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, features string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(2, 0)] * 5, "doc_id long, toxic int")
    got = sampling.labelled(docs, labels, "toxic", rows=30).collect()
    assert len(got) == len({r.doc_id for r in got}) <= 30 and 0 not in {r.doc_id for r in got}
    assert [r.text for r in sampling.labelled(docs, labels, "toxic").collect() if r.doc_id == 1] == ["xxxxxxxxxx"]


# ---- packing ----------------------------------------------------------------------


def test_fast_ids_of_every_code_point():
    """Each code point that the fast path may see, in four surroundings."""
    e = ByteBpe(tokenizer_path())
    points = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000]
    fast = [c for c in points if not (any(_SUSPECT[b] for b in c.encode()) and UNSURE.search(c))]
    assert len(fast) > 100_000
    for around in ("{}", "a{}b", " {} ", "1{}'s"):
        texts = [around.format(c) for c in fast]
        slow = e.slow.encode_batch(texts, add_special_tokens=False)
        assert all(a.tolist() == b.ids for a, b in zip(e.batch(texts), slow))


def test_two_way_differencing_is_that_of_numbers():
    """Of two windows, differencing leaves what subtracting the two largest again and again leaves."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 30, 101):
        sizes = rng.integers(1, 2000, n)
        heap = [-int(s) for s in sizes]
        heapq.heapify(heap)
        while len(heap) > 1:
            heapq.heappush(heap, heapq.heappop(heap) - heapq.heappop(heap))
        a, b = packing.differencing(sizes, 2)
        assert abs(int(sizes[a].sum()) - int(sizes[b].sum())) == -heap[0]


def test_a_missing_vocabulary_fails(spark, odd):
    with pytest.raises(Exception, match="nowhere"):
        packing.pack(odd, path="/nowhere/byte_bpe_50k.json").collect()
    with pytest.raises(Exception, match="nowhere"):
        pieces.encode(odd, path="/nowhere/piece.model").collect()


def test_null_ids_and_repeated_rows_are_packed(odd, odd_rows):
    rows = packing.pack(odd, with_ids=True).collect()
    whole = sum(len(ids) for ids in ByteBpe(tokenizer_path()).batch([r[1] for r in odd_rows])) + len(odd_rows)
    assert sum(r.length for r in rows) == whole
    assert sum(r.start == 0 for r in rows if r.doc_id is None) == 2 and sum(r.start == 0 for r in rows if r.doc_id == 28) == 3


# ---- pieces -----------------------------------------------------------------------


def test_shares_do_not_depend_on_the_batch():
    """A unit's shares, bit by bit, alone and behind a thousand others."""
    v = pieces.Vocabulary.load(pieces.model_path())
    rng = random.Random(4)
    word = lambda: " " + "".join(rng.choice("etaoinshrdluüß日") for _ in range(rng.randint(1, 14)))
    units = list({word() for _ in range(60)})

    def shares(raws, wanted):
        lattice = pieces.Lattice(v)
        lattice.add(list(range(len(raws))), [r.encode() for r in raws])
        out = {}
        for k, raw in enumerate(raws):
            if raw in wanted:
                n = len(raw.encode())
                states = range(lattice.slots[k] - n + 1, lattice.slots[k] + 1)
                out[raw] = [lattice.within[lattice.edge[s] : lattice.edge[s + 1] if s + 1 < len(lattice.edge) else None].tobytes() for s in states]
        return out

    alone = {}
    for u in units:
        alone |= shares([u], {u})
    others = list({word() for _ in range(1000)} - set(units))
    assert shares([*others, *units], set(units)) == alone


def test_samples_are_the_same_in_any_company(spark, odd_rows):
    rows = [(i, r[1]) for i, r in enumerate(odd_rows)] + [(1000 + i, f"text {i * 7919} über {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = {r.doc_id: r.ids for r in pieces.encode(df.coalesce(1)).collect()}
    assert one == {r.doc_id: r.ids for r in pieces.encode(df.repartition(50)).collect()}
    few = {r.doc_id: r.ids for r in pieces.encode(df.filter("doc_id % 37 = 0")).collect()}
    assert few == {k: one[k] for k in few}


# ---- substrings ---------------------------------------------------------------------


def test_pairs_of_hashes():
    rng = np.random.default_rng(1)
    h, g = rng.integers(0, 6, 500).astype(np.uint64), rng.integers(0, 9, 500).astype(np.uint64)
    a, b, n, one = substrings.unique_pairs(h, g)
    want = sorted(set(zip(h.tolist(), g.tolist())))
    assert list(zip(a.tolist(), b.tolist())) == want and n.sum() == 500 and (h[one] == a).all() and (g[one] == b).all()
    some = (a[::3], b[::3])
    known = set(zip(*(x.tolist() for x in some)))
    assert substrings.contains_pairs(some, h, g).tolist() == [p in known for p in zip(h.tolist(), g.tolist())]
    none = np.empty(0, np.uint64)
    assert not substrings.contains_pairs((none, none), h, g).any()


def test_words_whose_first_hashes_are_equal_stay(spark, monkeypatch):
    """With a first hash that tells nothing, the second one decides."""
    from tests.llm.test_dedup import brute_removal

    plain = substrings.TextBatch.word_hashes
    monkeypatch.setattr(substrings.TextBatch, "word_hashes", lambda self, which=0: plain(self, which) if which else np.ones_like(plain(self)))
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcd") for _ in range(30)) for _ in range(20)]
    texts += [texts[0], " ".join(texts[3].split()[4:20])]
    g = substrings.Group(texts, 7, True)
    g.last = g.least_part(7)
    g.spans()
    h, other, count, _ = substrings.unique_pairs(g.whole, g.other)
    again = substrings.contains_pairs((h[count > 1], other[count > 1]), g.whole, g.other)
    bad = np.zeros(len(g.words) + 1, np.int64)
    for at in g.at[again]:
        bad[at : at + 7] = 1
    ends = np.cumsum(g.counts)
    assert [int(bad[e - c : e].sum()) for c, e in zip(g.counts, ends)] == [b for _, b, _ in brute_removal(texts, 7)]


# ---- urls --------------------------------------------------------------------------


def judged(spark, urls, rules):
    rows = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, rule string, verdict string")
    out = {r.page_id: r for r in urltree.judge(rows.repartition(3), rules).collect()}
    return [out[i] for i in range(len(urls))]


def test_a_template_blocks_urls_that_no_rule_covers(spark):
    """Of 40 kinds of pages rules block 30; the others fall under the same wildcard."""
    words = [a + b for a in "abcdefgh" for b in "ijklm"]
    urls = [f"http://shop.example/{w}/item" for w in words] + ["http://quiet.example/ai/item", "http://shop.example/"]
    rules = [("block", f"shop.example/{w}/") for w in words[:30]] + [("allow", "quiet.example/")]
    out = judged(spark, urls, rules)
    assert all(r.rule is None and r.verdict == "block" and r.template == "/*/item" for r in out[30:40])
    assert out[40].verdict == "allow"


def test_templates_without_labels_follow_the_nearest_node_above(spark):
    bad = [f"http://h.example/bad/x{c}" for c in "abcdefgh"]
    good = [f"http://h.example/good/x{c}" for c in "abcdefghijkl"]
    rules = [("block", "h.example/bad/xa"), ("block", "h.example/bad/xb"), ("block", "h.example/bad/xc"), ("block", "h.example/bad/xd"), ("block", "h.example/bad/xe"), ("block", "h.example/bad/xf"), ("allow", "h.example/good/xa"), ("allow", "h.example/good/xb")]
    rules += [("allow", f"h.example/good/x{c}") for c in "cdefghij"]
    out = judged(spark, bad + good + ["http://h.example/other/x", "http://elsewhere.example/x"], rules)
    assert {r.verdict for r in out[:8]} == {"block"} and out[7].rule is None
    assert {r.verdict for r in out[8:20]} == {"allow"}
    assert out[20].verdict == out[21].verdict == "allow"  # host and table are mixed


def test_deep_paths_generalise_too(spark):
    """Segments vary at the fifteenth place, and a path has three thousand."""
    stem = "/".join("abcdefghijklmn")
    urls = [f"http://deep.example/{stem}/v{c}{d}/end/of/it" for c in "abcdef" for d in "pqrstu"] + ["http://deep.example/" + "s/" * 3000]
    out = judged(spark, urls, [("block", f"deep.example/{stem}/v{c}") for c in "abcde"])
    assert {r.verdict for r in out[:36]} == {"block"} and out[30].rule is None and "*" in out[30].template
    assert urltree.levels(20) == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 8), (8, 12), (12, 20)] and len(urltree.levels(3000)) < 20


def test_odd_urls(spark):
    urls = ["http://a.example/x"] * 3 + [None, "", "://", "http://a.example/" + "q" * 100_000, "http://ties.example/x"]
    out = judged(spark, urls, [("block", "ties.example/"), ("allow", "example/x")])
    assert len({(r.host, r.path, r.rule, r.verdict, r.template) for r in out[:3]}) == 1
    assert [(r.host, r.path) for r in out[3:6]] == [("", "")] * 3 and out[7].rule == "ties.example/"


# ---- neighbours ---------------------------------------------------------------------


def test_the_entry_reaches_all_nodes():
    x = np.random.default_rng(3).normal(size=(50, 4)).astype(np.float32)
    graph = np.full((50, 3), -1, np.int64)
    graph[:10, 0] = np.arange(1, 11)
    graph[20:30, 0] = np.arange(21, 31)
    whole = graphsearch.connected(x, graph, 0)
    seen, fresh = set(), {0}
    while fresh:
        seen |= fresh
        fresh = {int(j) for i in fresh for j in whole[i] if j >= 0} - seen
    assert seen == set(range(50)) and (whole[:, :3] == graph).all()


def test_small_shards_find_everything(spark):
    """Shards smaller than a beam are searched like any other, and columns may clash."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(120, 6)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist(), 1, 2, "c") for i, x in enumerate(v)], "vec_id long, embedding array<float>, shard int, rank int, cid string").repartition(3)
    got = {(r.query_id, r.rank): r.vec_id for r in graphsearch.search(df, F.col("vec_id") % 20 == 0, shard_rows=10).collect()}
    score = v.astype(np.float64) @ v.astype(np.float64).T
    for q in range(0, 120, 20):
        want = sorted((-score[q, i], i) for i in range(120) if i != q)[:20]
        assert [got[q, k + 1] for k in range(20)] == [i for _, i in want]


# ---- shared parts --------------------------------------------------------------------


def test_wanted_rows_are_a_superset_and_few(spark):
    rows = spark.range(50_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    ids = spark.range(0, 50_000, 1000)
    got = [r.doc_id for r in common.wanted_only(rows, "doc_id", ids).collect()]
    assert set(range(0, 50_000, 1000)) <= set(got) and len(got) < 60
    assert common.wanted_only(rows, "doc_id", ids.limit(0)).count() == 0


def test_groups_are_dealt_evenly(spark):
    rows = spark.range(8000).select("id", (F.col("id") % 32).cast("int").alias("p"))
    sizes = common.dealt(rows, "p", 32).groupBy(F.spark_partition_id().alias("t")).agg(F.count("*").alias("n"), F.countDistinct("p").alias("k")).collect()
    assert {r.n // r.k for r in sizes} == {250} and max(r.n for r in sizes) <= 2 * min(r.n for r in sizes)


def test_a_cluster_must_name_the_shared_folder():
    class Context:
        master = "spark://somewhere"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError):
        common.shared_folder(Session)
