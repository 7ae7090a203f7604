import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tamarack.llm import quality

TEXTS = ["One two two THREE!! | 4\n", "", None, "éé éé ß. $x$", "word " * 30, " \n\t "]


def brute(t):
    t = t or ""
    b, words = t.encode(), re.findall("[^\x20\x09-\x0d]+", t)
    n, w = max(1, len(b)), max(1, len(words))
    share = lambda chars: sum(c in chars for c in b) / n
    counts = [words.count(x) for x in set(words)]
    return [
        np.log1p(len(b)), np.log1p(len(words)), sum(len(x.encode()) for x in words) / w, share(range(65, 91)), share(b"0123456789"), share(b"!#$%&*+<=>@^_`{|}~\\/[]()\"-"), share(b".,;:?'"), share(b"\n"),
        share(range(128, 256)), share(b"|"), len(counts) / w, sum(a == b for a, b in zip(words, words[1:])) / w, max(counts, default=0) / w, sum(x.encode()[-1] in b"!#$%&*+<=>@^_`{|}~\\/[]()\"-" for x in words) / w,
    ]


def test_statistics():
    got = quality.measure(pa.array(TEXTS, pa.string()))
    assert np.allclose(got, [brute(t) for t in TEXTS])
    assert not got[1].any() and not got[2].any()


def test_rules_of_a_printed_forest():
    text = "Model\n  Tree 0 (weight 1.0):\n    If (feature 2 <= 0.5)\n     If (feature 1 <= 3.0)\n      Predict: 0.0\n     Else (feature 1 > 3.0)\n      Predict: 1.0\n    Else (feature 2 > 0.5)\n     Predict: 1.0\n"
    got = {r.terms for r in quality.rules(text)}
    assert got == {((2, False, 0.5),), ((1, False, 3.0), (2, False, 0.5)), ((1, True, 3.0), (2, False, 0.5)), ((2, True, 0.5),)}


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(3)
    docs, labels = [], []
    for k in range(500):
        words = ["".join(r.choice(["the", "an", "er", "on", "re"]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(5, 60))]
        bad = k % 6 == 0
        docs.append((k, " ".join(w.upper() + "!!" for w in words) if bad and k % 4 else " ".join(words[:1] * 40) if bad else " ".join(words), 1))
        labels.append((k, int(not bad)))
    return spark.createDataFrame(docs, "doc_id long, text string, predicted int"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_model(spark, corpus):
    docs, labels = corpus
    model = quality.learn(docs, labels)
    assert 0 < len(model.rules) < 60
    rows = quality.scored(spark, docs, model).collect()
    assert sum(r.predicted == int(r.doc_id % 6 != 0) for r in rows) >= 495 and all(0 <= r.score <= 1 for r in rows)
    plan = quality.scored(spark, docs, model)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # the score itself is a column expression
    extra = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 500_000)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.scored(spark, extra, model).collect()}
    assert got[1] == got[2] and all(0 <= s <= 1 for s in got.values())


def test_one_class_or_none(spark, corpus):
    docs, labels = corpus
    assert quality.scored(spark, docs, quality.learn(docs, labels.where("false"))).select("score").distinct().collect()[0][0] == 0.5
    row = quality.scored(spark, docs, quality.learn(docs, labels.where("quality = 1"))).select("score").distinct().collect()
    assert len(row) == 1 and row[0][0] > 0.9
    assert quality.scored(spark, docs.where("false"), quality.Model((), 0.0)).count() == 0
