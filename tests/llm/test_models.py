"""Classifiers, packing, chat, pieces, urls and neighbour search."""

import random
import re
import zlib

import numpy as np
import pytest

from tideline.llm import chat, graphsearch, packing, pieces, quality, toxicity, urltree
from tideline.llm.bpe import ByteBpe, tokenizer_path


@pytest.fixture(scope="module")
def labelled_rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghinorstu") for _ in range(rng.randint(2, 8)))
    docs, labels = [], []
    for i in range(500):
        w = [word() for _ in range(rng.randint(5, 80))]
        toxic, good = int(rng.random() < 0.3), int(rng.random() < 0.7)
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), "grumblefutz")
        if not good:
            w = [x + "%%%" for x in w]
        docs.append((i, "\n".join(" ".join(w[k : k + 12]) for k in range(0, len(w), 12))))
        labels.append((i, good, toxic))
    return docs, labels


@pytest.mark.parametrize("module,column,index", [(toxicity, "toxic", 2), (quality, "quality", 1)])
def test_held_out_accuracy(spark, labelled_rows, module, column, index):
    docs, labels = labelled_rows
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = module.fit(d, y, column, y.doc_id % 4 != 0)
    got = {r.doc_id: r.score for r in module.score(d, model).collect()}
    right = [(got[row[0]] >= 0.5) == bool(row[index]) for row in labels if row[0] % 4 == 0]
    assert sum(right) / len(right) > 0.95


@pytest.mark.parametrize("module,column", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_on_odd_rows(spark, odd, odd_rows, nothing, module, column):
    y = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (2, 1, None), (None, 1, 1), (23, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    model = module.fit(odd, y, column)
    out = module.score(odd, model)
    assert out.count() == len(odd_rows) and out.columns.count("score") == 1
    assert all(0 <= r.score <= 1 for r in out.collect())
    assert module.score(nothing, model).count() == 0
    blank = module.fit(nothing, y, column)
    assert {round(r.score, 3) for r in module.score(odd, blank).collect()} == {0.0}


def test_line_marginals_match_enumeration():
    m = quality.fit_texts(["good line here\nmore words", "BAD!!! %%%\n%%% ###", "fine text now", "%%% &&&"], [1, 0, 1, 0])
    text = "good words\n%%% ###\nmore text here"
    measures, size, offsets = quality.line_measures([text])
    e = m.emissions(m.bins(measures), offsets)
    weight, good = 0.0, np.zeros(3)
    for y in np.ndindex(2, 2, 2):
        w = np.exp(sum(e[t] * y[t] for t in range(3)) + m.chain[y[0], y[1]] + m.chain[y[1], y[2]])
        weight += w
        good += w * np.array(y)
    fwd, bwd = m.messages(e, offsets)
    assert np.allclose(1 / (1 + np.exp(-(fwd + bwd))), good / weight)


# ---- packing -------------------------------------------------------------------


def test_fast_ids_equal_the_tokenizers_library():
    e = ByteBpe(tokenizer_path())
    rng = random.Random(3)
    alphabet = " \n\tab'st1,.é 　x<|日\x1c\x85"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["", None, "<|endoftext|> x", "don't  we'll\r\n\r\n 12 "]
    for t, ids in zip(texts, e.batch(texts)):
        assert ids.tolist() == e.slow.encode(t or "", add_special_tokens=False).ids


def test_packed_pieces_are_whole_and_gapless(odd, odd_rows, nothing):
    rows = packing.pack(odd, with_ids=True).collect()
    slow = ByteBpe(tokenizer_path()).slow
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
        by_doc.setdefault(r.doc_id, {})[r.start] = r
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in {r[0]: r[1] for r in odd_rows if r[0] is not None and r[0] != 28}.items():
        ids = [x for _, p in sorted(by_doc[i].items()) for x in p.ids]
        assert ids == [*slow.encode(t or "", add_special_tokens=False).ids, 1]
        assert all(p.doc_tokens == len(ids) for p in by_doc[i].values())
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    assert packing.pack(nothing).count() == 0


def test_differencing_balances():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 900, 400)
    windows = packing.near_equal_windows(sizes, 2048)
    assert sorted(i for w in windows for i in w) == list(range(400))
    sums = [sizes[w].sum() for w in windows]
    assert max(sums) <= 2048 and len(windows) <= -(-sizes.sum() // 2048) + 2
    assert packing.near_equal_windows(np.array([2000, 2000, 100]), 2048) and packing.differencing(np.array([4, 5, 6, 7, 8]), 2)


# ---- chat ------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["", "plain", "\\", "\\.", "<|end|>", "a<|turn|>b\\<|text|>", "</s>[INST] ok [/INST]", "<", "<|end|", "\\\\<s>\\.", "é<|end|>\n"])
def test_escaping_is_reversible(text):
    e = chat.escaper()(text)
    assert chat.unescape(e) == text and not any(c in e for c in chat.CONTROLS)
    turns = [("user", text), ("assistant", text), (text, "x")]
    formatted, spans = chat.Template().render([{"role": r, "text": t} for r, t in turns])
    assert chat.read_back(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [text]


def test_templates():
    t = chat.Template("{% for m in messages %}{{ loop.index }}{% if m.role == 'a' and not loop.last %}A{% elif m.n >= 2 %}B{% else %}C{% endif %}{% endfor %}")
    assert t.render([{"role": "a"}, {"role": "b", "n": 2}, {"role": "a", "n": 0}])[0] == "1A2B3C"
    folded = chat.Template("a{{ 'b' + 'c' }}{% if 1 == 2 %}no{% else %}d{% endif %}")
    assert folded.tree == (chat.Emit(chat.Const("abcd")),)


@pytest.mark.parametrize("bad", ["{% for x %}", "{{ f(1) }}", "{{ x.__class__.mro() }}", "{% if x %}", "{{ 'a' | nope }}", "{{ (1 }}", "{% what %}"])
def test_bad_templates(bad):
    with pytest.raises(chat.TemplateError):
        chat.Template(bad).render([], x={})


def test_sandbox_has_no_attributes():
    with pytest.raises(chat.TemplateError):
        chat.Template("{{ x.__class__ }}").render([], x=3)


def test_odd_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, None, None, None), (None, 0, "user", "x"), (3, 0, "assistant", "</s>" * 5000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    assert out[1].n_turns == 3 and out[1].loss_chars == 2 and out[2].n_turns == 1 and out[3].loss_chars == 20_000 and None in out
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


# ---- pieces -----------------------------------------------------------------------


def test_segmentation_is_lossless_and_seeded(odd, odd_rows, nothing):
    one = {(r.doc_id, r.decoded_sha256): r for r in pieces.digests(odd).collect()}
    two = {(r.doc_id, r.decoded_sha256): r for r in pieces.digests(odd.repartition(7)).collect()}
    assert all(r.lossless for r in one.values()) and one == two
    other = {(r.doc_id, r.decoded_sha256): r for r in pieces.digests(odd, seed=2).collect()}
    assert any(other[k].ids_crc32 != one[k].ids_crc32 for k in one)
    assert pieces.digests(nothing).count() == 0
    v = pieces.Vocabulary.load(pieces.model_path())
    texts = {r[0]: r[1] or "" for r in odd_rows}
    for r in pieces.encode(odd.filter("doc_id < 28")).collect():
        assert pieces.decode(np.array(r.ids), v) == texts[r.doc_id]


def test_digests_hold_the_ids(odd):
    rows = pieces.digests(odd).collect()
    key = lambda r: (str(r.doc_id), r.ids)
    assert sorted(map(key, rows)) == sorted(map(key, pieces.encode(odd).collect()))
    assert all(len(r.ids) == r.n_pieces and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)


def test_samples_follow_the_lattice():
    v = pieces.Vocabulary.load(pieces.model_path())
    ids = {}
    for _, _, p in v.by_length:
        for i in p:
            ids.setdefault(v.data[i], int(i))

    def splits(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            if s[:k] in ids:
                for rest in splits(s[k:]):
                    yield (ids[s[:k]], *rest)

    every = list(splits(b" them"))
    weight = np.array([np.exp(sum(v.log_p[i] for i in s)) for s in every])
    n = 20_000
    got = pieces.Lattice(v).segment(["them"] * n, np.arange(n))
    count = {s: 0 for s in every}
    for s in got:
        count[tuple(s.tolist())] += 1
    assert max(abs(count[s] / n - w) for s, w in zip(every, weight / weight.sum())) < 0.015


# ---- urls --------------------------------------------------------------------------


@pytest.mark.parametrize(
    "url,host,path,rule,verdict",
    [
        ("http://A.Example.COM/en/825?x", "a.example.com", "/en/825", "com/en/", "block"),
        ("https://x.example.com/en/71#t", "x.example.com", "/en/71", "example.com/en/7", "allow"),
        ("ftp://example.net/de/8", "example.net", "/de/8", "example.net/de/8", "block"),
        ("http://example.net/de/9", "example.net", "/de/9", "net/de/", "allow"),
        ("http://notcom/en/1", "notcom", "/en/1", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://h?q=://x/en/", "h", "", None, "allow"),
    ],
)
def test_url_parts_and_rules(spark, url, host, path, rule, verdict):
    r = urltree.judge(spark.createDataFrame([(1, url, "x")], "page_id long, url string, host string")).first()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_templates_are_grown_and_rejected(spark):
    rows = [(i, f"http://bad.example.com/en/x{i}/{i}") for i in range(60)] + [(100 + i, f"http://good.example.org/de/w{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'abc'[i // 26]}") for i in range(60)]
    out = urltree.judge(spark.createDataFrame(rows, "page_id long, url string"), [("block", "example.com/en/x1"), ("allow", "example.org/de/wa")]).collect()
    assert {r.verdict for r in out if r.page_id < 100} == {"block"} and {r.verdict for r in out if r.page_id >= 100} == {"allow"}
    assert any(r.template.endswith("/*") for r in out if r.page_id >= 100)
    assert urltree.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


# ---- neighbours ---------------------------------------------------------------------


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(1500, 16)).astype(np.float32)
    v[1200:] = v[5]  # a fifth of all rows are one vector
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(5000, None), (5020, [0.0] * 16), (5040, [None] + [1.0] * 15), (5060, [float("nan")] * 16), (5080, []), (None, v[0].tolist()), (6000, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").repartition(5)
    out = graphsearch.search(df, df.vec_id % 20 == 0, shard_rows=400, beam=64).collect()
    x = v.astype(np.float64)
    found = {}
    for r in out:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == set(range(0, 1500, 20))
    hits = 0
    for q, got in found.items():
        got.sort()
        score = x @ x[q]
        want = sorted((-s, i) for i, s in enumerate(score) if i != q)[:20]
        assert [g[0] for g in got] == list(range(1, 21)) and all(abs(score[i] - s) < 1e-9 for _, i, s in got)
        assert [(-s, i) for _, i, s in got] == sorted((-s, i) for _, i, s in got)
        hits += len({i for _, i, _ in got} & {i for _, i in want})
    assert hits / (20 * len(found)) > 0.95


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.1]), (2, [0.5, 0.1]), (2, [0.5, 0.1])], "vec_id long, embedding array<float>")
    out = graphsearch.search(df, df.vec_id % 20 == 0).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in out] == [(0, 1), (0, 2)]
    assert graphsearch.search(df.limit(0), df.vec_id % 20 == 0).count() == 0
