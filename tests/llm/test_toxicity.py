import math
import random

import pytest

from tamarack.llm import toxicity
from tamarack.llm.labelled import held_out
from tamarack.llm.toxicity import Automaton, Lexicon, Reader

LEXICON = Lexicon({"moron": 3.0, "stupid": 3.0, "worthless": 4.0, "veju*": 4.0, "scum": 3.0}, frozenset({"moron", "stupid", "worthless"}))


def distance(a, b):
    """Edits between two words, two swapped neighbours being one."""
    rows = [list(range(len(b) + 1))]
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(rows[-1][j] + 1, new[-1] + 1, rows[-1][j - 1] + (c != d)))
            if i > 1 and j > 1 and (a[i - 2], c) == (d, b[j - 2]):
                new[-1] = min(new[-1], rows[-2][j - 2] + 1)
        rows.append(new)
    return rows[-1][-1]


def test_automaton_equals_edit_distance():
    a, r = Automaton(LEXICON), random.Random(4)
    for _ in range(4000):
        w = list(r.choice(["moron", "stupid", "worthless", "scum", "veju", "random"]))
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(w) + 1)
            if r.random() < 0.3:
                w[at : at + 2] = w[at : at + 2][::-1]
            else:
                w[at : at + r.randint(0, 1)] = r.choice(["", "x", "m", "s"])
        w = "".join(w)
        near = min((distance(w, t), t) for t in LEXICON.fuzzy)
        if w in LEXICON.weights:
            expected = (w, 0)
        elif w.startswith("veju"):
            expected = ("veju*", 0)
        else:
            expected = near[::-1] if near[0] <= 1 else None
        assert a.match(w) == expected, w


def test_windows():
    reader = Reader(LEXICON)
    assert reader.hits("He said \"you are a moron\" to them")[1] == [("moron", 0, True, True)]
    assert reader.hits("You stuupid thing")[1] == [("stupid", 1, False, True)]
    assert reader.hits("the Vejuaire of it, WORTHLESS")[1] == [("veju*", 0, False, False), ("worthless", 0, False, False)]
    assert reader.hits("") == (0, [])
    plain, quoted = reader.features("a moron"), reader.features("the word \"moron\" was quoted")
    assert plain[4] > quoted[4] and quoted[2] > plain[2] == 0


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(8)
    words = ["".join(r.choice(["the", "an", "er", "on", "re", "ti"]) for _ in range(r.randint(1, 4))) for _ in range(200)]
    bad = ["moron", "blarg", "vejuine", "vejulo", "vejuat"]
    docs, labels = [], []
    for k in range(600):
        t = [r.choice(words) for _ in range(40)]
        y = int(k % 5 == 0)
        for _ in range(3 * y):
            t.insert(r.randrange(40), r.choice(bad))
        docs.append((k, " ".join(t), 7.0))
        labels.append((k, y, None if k % 50 else y))
    return spark.createDataFrame(docs, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_learned_model_separates(spark, corpus):
    docs, labels = corpus
    model = toxicity.learn(spark, docs, labels)
    assert {"blarg", "moron"} <= set(model.lexicon.weights) and "veju*" in model.lexicon.weights
    got = {r.doc_id: r for r in toxicity.scored(spark, docs, model).collect()}
    right = sum(got[k].predicted == int(k % 5 == 0) for k in range(600))
    assert right >= 590 and all(0 <= r.score <= 1 for r in got.values())
    extra = spark.createDataFrame([(1, None), (2, ""), (3, "you bllarg"), (4, "an er " * 40_000 + "blarg")], "doc_id long, text string")
    rows = {r.doc_id: r for r in toxicity.scored(spark, extra, model).collect()}
    assert rows[1].score == rows[2].score < rows[3].score
    assert rows[4].score > rows[2].score  # whole texts are read


def test_labels_of_one_class_or_none(spark, corpus):
    docs, labels = corpus
    for known, part in ((docs, labels.where("toxic = 0")), (docs, labels.where("toxic = 1")), (docs, labels.where("false")), (docs.where("false"), labels)):
        model = toxicity.learn(spark, known, part)
        rows = toxicity.scored(spark, spark.createDataFrame([(1, "you idiot"), (2, "the an er")], "doc_id long, text string"), model).orderBy("doc_id").collect()
        assert [r.predicted for r in rows] == [0, 0] and all(r.score < 1e-6 for r in rows)
    assert toxicity.scored(spark, docs.where("false"), model).count() == 0


def test_score_equals_brute_force(spark, corpus):
    """Every fuzzy term is compared with every word, and the sums are made anew."""
    docs, labels = corpus
    model = toxicity.learn(spark, docs, labels)
    lexicon = model.lexicon
    texts = ["you blarg", "said \"a moron\" once", "mron and blargs", "the an er", "", "vejuxx vejulo your", "x" * 50 + " blarg"]

    def score(text):
        words, hits = toxicity.WORD.findall(text.lower()), []
        for m in toxicity.WORD.finditer(text.lower()):
            w = m[0]
            stems = [t for t in lexicon.weights if t.endswith("*") and w.startswith(t[:-1])]
            near = min(((distance(w, t), t) for t in lexicon.fuzzy), default=(9, ""))
            found = (w, 0) if w in lexicon.weights else (max(stems, key=len), 0) if stems else near[::-1] if near[0] <= 1 else None
            if found:
                hits.append((*found, *Reader._context(text.lower(), m.start(), m.end())))
        x = toxicity.features(lexicon, len(words), hits)
        return 1 / (1 + math.exp(-sum(a * b for a, b in zip([*x, 1.0], model.coefficients))))

    rows = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string")
    got = toxicity.scored(spark, rows, model).collect()
    assert len(got) == len(texts) + 1
    for r in got:  # repeated rows and ties score alike
        assert r.score == pytest.approx(score(r.text), abs=1e-12)


def test_lexicon_has_no_bound(spark):
    """Thousands of terms, each in a few toxic texts of varied surroundings, are all learned."""
    r = random.Random(2)
    terms = ["".join(r.choice("bcdfghjklm") for _ in range(9)) for _ in range(4500)]
    docs = [(2 * k, " ".join(x for t in terms[k % 25 :: 25] for x in (f"w{r.randrange(99)}", t))) for k in range(600)]
    docs += [(2 * k + 1, " ".join(f"w{r.randrange(99)}" for _ in range(60))) for k in range(600)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in docs], "doc_id long, toxic int")
    model = toxicity.learn(spark, spark.createDataFrame(docs, "doc_id long, text string"), labels)
    assert set(terms) <= set(model.lexicon.weights)


def test_held_out_rows_of_the_given_tables(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = labels.where("toxic is not null").where(held_out()).join(docs, "doc_id")
    got = toxicity.scored(spark, rows.select("doc_id", "text", "toxic"), toxicity.learn(spark, docs, labels)).select("toxic", "predicted").collect()
    hit = sum(r.toxic == r.predicted == 1 for r in got)
    assert hit >= 0.88 * sum(r.toxic for r in got) and hit >= 0.95 * sum(r.predicted for r in got)


def test_broken_and_swapped_words():
    reader = Reader(LEXICON)
    for text in ("st*pid", "stpuid", "s t u p i d", "so s t u p i d !", "w.o.r.t.h.l.e.s.s", "m*r*o*n", "stu-pid", "ve-juaire"):
        terms = [h[:2] for h in reader.hits(text)[1]]
        assert len(terms) == 1 and terms[0][1] == 1, text
    assert [h[:2] for h in reader.hits("stupid-scum")[1]] == [("stupid", 0), ("scum", 0)]
    assert reader.hits("a b c d e, well-known, e.g. x.y")[1] == [] and reader.hits("s t u p idea")[1] == []


def test_quotation_and_abuse_differ(spark):
    """The same words score under 0.5 where they are quoted and above where they are meant; no row with quotations alone is labelled."""
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.learn(spark, docs, labels)
    meant = ["you are an idiot", "you are an idoit", "you st*pid loser", "you are so s t u p i d", "you pathetic worthless clown", "\"hello\" you idiot"]
    quoted = ['he said "you are an idiot"', "the word 'idiot' comes from greek", "they wrote “you are a moron” on it", "the report says that the term moron was common", "she quoted «stupid» from the letter"]
    rows = spark.createDataFrame(list(enumerate(meant + quoted)), "doc_id long, text string")
    got = {r.text: r.score for r in toxicity.scored(spark, rows, model).collect()}
    assert all(got[t] > 0.5 for t in meant) and all(got[t] < 0.5 for t in quoted), got
