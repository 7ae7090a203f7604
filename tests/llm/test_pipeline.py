import random

import pytest

import corpus_pipeline
from tamarack.llm.secrets import base_spans


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with planted toxic texts, near copies, benchmark passages and secrets among clean ones."""
    r = random.Random(6)
    word = lambda: "".join(r.choice(["the", "an", "er", "on", "re", "ti", "es", "or", "ly", "ing", "wh", "ou"]) for _ in range(r.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(40)
    docs, labels = [], []
    for k in range(400):
        t = text(60)
        if k % 10 == 1:
            t += " you idiot and pathetic moron"
        elif k % 10 == 2:
            t += " " + passage
        elif k % 10 == 3:
            t += ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end'
        elif k % 10 == 4 and k > 10:
            t = docs[k - 10][1].replace(" ", " ", 1) + " more"
        docs.append((k, t, "en", "s", len(t), "extra"))
        labels.append((k, 1, int(k % 10 == 1)))
    docs += [(900, None, None, None, None, None), (901, "", "en", "s", 0, "x")]
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, extra string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_each_stage_acts_on_what_the_last_one_kept(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
        if name != "sentencepiece":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    ids = {n: {r.doc_id for r in df.select("doc_id").collect()} for n, df in seen.items()}
    every = set(range(400)) | {900, 901}
    assert ids["toxicity"] == {k for k in every if k % 10 != 1 or k >= 900}
    copies = {k for k in range(14, 400) if k % 10 == 4}
    assert ids["near_duplicates"] == ids["toxicity"] - copies
    assert ids["decontamination"] == {k for k in ids["near_duplicates"] if k % 10 != 2}
    assert ids["secrets"] == ids["decontamination"] == ids["sentencepiece"]
    texts = {r.doc_id: r for r in seen["secrets"].collect()}
    assert not any(base_spans(r.text or "") for r in texts.values()) and "[SECRET]" in texts[3].text and texts[3].n_chars == len(texts[3].text) and texts[900].text is None
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in seen["sentencepiece"].collect())


def test_run_gives_the_last_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_pieces", "ids", "round_trip"] and out.count() == 283
