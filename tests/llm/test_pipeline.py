"""The pipeline's stages against brute-force versions of each, on a small corpus."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_dedup import WORD, brute_components, brute_removal, mutated
from tideline.llm.bpe import ByteBpe, tokenizer_path


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghinorstu") for _ in range(rng.randint(2, 8)))
    docs, labels = [], []
    passage = " ".join(word() for _ in range(55))
    for i in range(300):
        w = [word() for _ in range(rng.randint(20, 120))]
        if i % 9 == 1:
            w[3] = w[-2] = "grumblefutz"
        if i % 7 == 2:
            w = [x + "%%%" for x in w]
        text = " ".join(w)
        if i % 50 == 4:
            text = text + " " + passage
        if i > 250 and i % 9 != 1 and i % 7 != 2:
            text = mutated(rng, docs[i - 250][1], 1)
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int("%%%" not in text), int("grumblefutz" in text)))
    docs += [(900, None, None, None, None), (901, "", "en", "s", 0)]
    folder = tmp_path_factory.mktemp("corpus").as_uri()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, docs


def test_stages(spark, corpus):
    folder, docs = corpus
    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns = now.columns
    stages = dict(corpus_pipeline.STAGES)
    before = {d[0]: d[1] for d in docs}

    def step(name, frame):
        out = corpus_pipeline.durable(stages[name](spark, frame, folder), name)
        assert out.columns == columns
        return out, {r.doc_id: r.text for r in out.collect()}

    now, left = step("toxicity", now)
    assert set(before) - set(left) == {i for i in before if "grumblefutz" in (before[i] or "")}
    seen = left
    now, left = step("quality", now)
    assert set(seen) - set(left) == {i for i in seen if "%%%" in (seen[i] or "")}
    seen = left
    now, left = step("minhash_near_dedup", now)
    want = brute_components(list(seen.items()), 5)
    assert set(left) == {i for i in seen if want.get(i, i) == i}
    seen = left
    now, left = step("substring_dedup", now)
    removed = dict(zip(seen, brute_removal(list(seen.values()), corpus_pipeline.PASSAGE_WORDS)))
    for i, t in left.items():
        n, cut, _ = removed[i]
        assert len(WORD.findall(t or "")) == n - cut and (cut or t == seen[i])
    slow = ByteBpe(tokenizer_path()).slow
    by_doc = {}
    for r in stages["packing"](spark, now, folder).collect():
        by_doc.setdefault(r.doc_id, []).append((r.start, r.ids))
    assert {i: [x for _, p in sorted(v) for x in p] for i, v in by_doc.items()} == {i: [*slow.encode(t or "", add_special_tokens=False).ids, 1] for i, t in left.items()}


def test_run_and_an_empty_table(spark, corpus, tmp_path):
    folder, docs = corpus
    rows = corpus_pipeline.run(spark, folder)
    assert 0 < rows.select("doc_id").distinct().count() < len(docs) and np.all(rows.toPandas()["length"] <= 2048)
    none = tmp_path.as_uri()
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{none}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{none}/labels.parquet")
    assert corpus_pipeline.run(spark, none).count() == 0
