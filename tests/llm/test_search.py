import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tamarack.llm import search

SCHEMA = "doc_id long, text string, item string, terms string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, top):
    """(item, rank, doc_id, score) of every item, by scoring all documents."""
    docs = [(d, Counter(terms(t)), len(terms(t))) for d, t in rows]
    n_docs, total = sum(n > 0 for _, _, n in docs), sum(n for _, _, n in docs)
    df = Counter(w for _, c, _ in docs for w in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in docs:
            score = 0
            for w in set(terms(text)) & set(c):
                m = 100 - 50 + (50 * n * n_docs) // total
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 20 * m))
            if score > 0:
                scored.append((-score, d is not None, d))
        out += [(item, k, d, -s) for k, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return out


def texts(seed, n, words=400):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)] + ["Äpfel", "naïve", "中文", "Zed9"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    return [" ".join(r.choices(vocabulary, weights, k=r.choice([0, 1, 3, 20, 60, 60, 900]))) for _ in range(n)]


def ranked(spark, rows, items, tmp_path, top=5, parts=3):
    docs = spark.createDataFrame([(d, t, "theirs", "theirs") for d, t in rows], SCHEMA).repartition(parts)
    asked = spark.createDataFrame(items, "item_id long, text string")
    search.index(spark, docs, f"{tmp_path}/index")
    found = search.search(spark, docs, asked, f"{tmp_path}/index", top).collect()
    return sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in found)


@pytest.mark.parametrize("text", ["", " .,;", "One two-TWO three_3", "É é ÀB c d", "\x00a\x7fb[c]{d}~e^f`g", "x" * 5000])
def test_terms(text):
    words, rows, codes = search.occurrences(pa.array(["first", text, None, text]))
    spelled = words.to_pylist()
    for k, want in ((0, ["first"]), (1, terms(text)), (2, []), (3, terms(text))):
        assert [spelled[c] for c in codes[rows == k]] == want


def test_bounds_are_never_below_scores():
    rows = [(k, t) for k, t in enumerate(texts(5, 300))]
    batch = pa.RecordBatch.from_pydict({"id": pa.array([k for k, _ in rows]), "text": [t for _, t in rows]})
    queried = [t for t in texts(6, 12) if t]
    words = sorted({w for t in queried for w in terms(t)})
    matrix = np.array([[w in terms(t) for w in words] for t in queried], dtype=np.float64)
    queries = search.Queries(pa.array(words), np.arange(1.0, len(words) + 1), matrix, 300, sum(len(terms(t)) for _, t in rows))
    exact, seen, close = queries.scores(batch.column("text")), set(), []
    for r in (x for b in search._index(iter([batch])) for x in b.to_pylist() if x["slices"]):
        bound = queries.bounds(r["class"], np.array(r["sizes"]), r["slices"])
        assert (bound >= exact[:, r["ids"]]).all()
        close.append(bound.sum() / max(exact[:, r["ids"]].sum(), 1))
        seen |= set(r["ids"])
    assert seen == {k for k, t in rows if terms(t)} and max(close) < 1.3


def test_whole_numbers_beyond_doubles():
    batch, words = pa.array(["a b", "a a a"]), pa.array(["a", "b"])
    one = search.Queries(words, np.array([2.0, 3.0]), np.ones((1, 2)), 2, 5)
    other = search.Queries(words, np.array([2, 3]), np.ones((1, 2), dtype=np.int64), 2, 5)
    assert one.scores(batch).tolist() == other.scores(batch).tolist()


@pytest.mark.parametrize("seed", range(3))
def test_results_equal_brute_force(spark, tmp_path, seed):
    rows = list(enumerate(texts(seed, 400)))
    items = list(enumerate(t for t in texts(seed + 100, 15) if len(t) < 2000))
    assert ranked(spark, rows, items, tmp_path) == sorted(brute(rows, items, 5))


def test_copies_ties_and_blocks_of_items(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "ITEMS", 2)
    rows = [(k, "same words here again and again") for k in range(300)] + [(k, f"other text number {k}") for k in range(300, 340)] + [(340 + k, "same words") for k in range(20)]
    items = [(k, t) for k, t in enumerate(["same words", "number 305", "again", "text other", "nothing of it", "", "?!"])]
    assert ranked(spark, rows, items, tmp_path, 7) == sorted(brute(rows, items, 7))


def test_odd_rows(spark, tmp_path):
    rows = [(None, "lost id"), (1, None), (2, ""), (3, "twice"), (3, "twice"), (4, "lost " * 30_000), (5, "id"), (6, "?")]
    items = [(1, "lost twice"), (2, "id")]
    want = brute(rows, items, 50)
    assert sorted(map(str, ranked(spark, rows, items, tmp_path, 50))) == sorted(map(str, want))


def test_empty_tables(spark, tmp_path):
    assert ranked(spark, [], [(1, "a")], tmp_path / "a") == []
    assert ranked(spark, [(1, "a")], [], tmp_path / "b") == []
    assert ranked(spark, [(1, "?")], [(1, "a")], tmp_path / "c") == []
