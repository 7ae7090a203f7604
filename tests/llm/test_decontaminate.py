import random

import numpy as np
import pytest

from tamarack.llm import decontaminate as d

R = random.Random(5)
SYLLABLES = ["the", "an", "er", "on", "re", "ti", "es", "or", "ly", "ing", "wh", "ou"]


def words(n):
    return " ".join("".join(R.choice(SYLLABLES) for _ in range(R.randint(1, 4))) for _ in range(n))


def norm(text):
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return d.normalise(raw, np.array([0, len(raw)]))[0].tobytes()


def distance(item, text):
    """Fewest edits of ``item`` against any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(text, k):
    t = list(text)
    for _ in range(k):
        at = R.randrange(len(t))
        what = R.randrange(3)
        if what == 0:
            t[at] = "z"
        elif what == 1:
            t.insert(at, "q")
        else:
            del t[at]
    return "".join(t)


def run(spark, docs, items):
    a = spark.createDataFrame([(*r, 9, "x") for r in docs], "doc_id long, text string, item_id long, start string")
    b = spark.createDataFrame([(*r, 9) for r in items], "item_id long, text string, doc_id long")
    return {(r.doc_id, r.item_id): r for r in d.contaminated(spark, a, b).collect()}


def test_equals_brute_force(spark):
    items = [(k, words(n)) for k, n in enumerate([3, 8, 20, 30, 40])]
    docs = []
    for k in range(60):
        i, t = R.choice(items)
        docs.append((k, f"{words(15)}.\n{edited(t, R.choice([0, 1, 2, 5, 9, 20]))}, {words(10)}"))
    docs += [(100, words(200)), (101, ""), (102, None), (103, items[4][1].upper().replace(" ", " -- "))]
    got = run(spark, docs, items)
    for i, t in items:
        m = norm(t).strip()
        budget = int(len(m) * d.EDIT_RATE)
        for k, text in docs:
            best = distance(m, norm(text or ""))
            assert ((k, i) in got) == (best <= budget), (k, i, best, budget)
            if best <= budget:
                assert got[k, i].edits == best
                part = text[got[k, i].start : got[k, i].end]
                assert distance(m, norm(part)) == best
    assert got[103, 4].edits == 0


def test_places_are_code_points(spark):
    item = "naïve über straße and some more words to be long enough"
    text = "é😀 ü — " + item + " öö"
    r = run(spark, [(1, text)], [(2, item)])[1, 2]
    assert text[r.start : r.end] == item


def test_edges(spark):
    long = words(40)
    assert run(spark, [], [(1, long)]) == run(spark, [(1, long)], []) == {}
    assert run(spark, [(1, long)], [(1, None), (2, ""), (3, " ?! ")]) == {}
    got = run(spark, [(1, words(30_000) + " " + long), (1, long)], [(5, long), (None, long)])
    assert set(got) == {(1, 5), (1, None)}
    docs = spark.createDataFrame([(1, long), (1, long), (None, long)], "doc_id long, text string")
    assert d.contaminated(spark, docs, spark.createDataFrame([(1, long)], "item_id long, text string")).count() == 3


def test_blocks_find_the_same(spark, monkeypatch):
    items = [(k, words(30)) for k in range(12)]
    docs = [(k, words(5) + " " + items[k % 12][1] + " " + words(5)) for k in range(24)]
    whole = run(spark, docs, items)
    monkeypatch.setattr(d, "BLOCK_CHARS", 500)
    assert run(spark, docs, items) == whole and len(whole) >= 24


def test_common_qgrams_are_counted_in_parts(spark, monkeypatch):
    shared = words(12)
    items = [(k, f"{shared} {words(10)}") for k in range(15)]
    docs = [(k, f"{shared} {shared} {items[k % 15][1]} {shared}") for k in range(15)] + [(99, f"{shared} " * 30)]
    whole = {k: tuple(r) for k, r in run(spark, docs, items).items()}
    monkeypatch.setattr(d, "POSTINGS", 100)
    raw = [np.frombuffer(t.encode(), dtype=np.uint8) for _, t in docs]
    off = np.cumsum([0, *map(len, raw)])
    index = d.Index.build(items)
    parts = {(docs[r][0], index.ids[i]): (docs[r][0], index.ids[i], e, s, t) for r, i, e, s, t in d._matches(np.concatenate(raw), off, index)}
    assert parts == whole and set(whole) >= {(k, k) for k in range(15)}


@pytest.mark.parametrize("k", range(30))
def test_alignment_in_a_band(k):
    item, text = words(4).encode(), words(8).encode()
    a, b = np.frombuffer(item, np.uint8), np.frombuffer(text, np.uint8)
    edits, end = d.align(a, b, -len(a), len(b))
    assert edits == distance(item, text) and distance(item, text[:end]) == edits


def test_short_passages_equal_brute_force(spark):
    letters = "abc d"
    items = [(m * 10 + k, "".join(R.choice(letters) for _ in range(m))) for m in range(1, 31) for k in range(3)]
    docs = []
    for k in range(80):
        t = R.choice(items)[1]
        docs.append((k, "".join(R.choice("abcd ") for _ in range(R.randint(0, 30))) + edited(t, R.choice([0, 0, 1, 2])) + R.choice(["", " bd", "!"])) if len(t) > 2 else (k, t))
    got = run(spark, docs, items)
    found = 0
    for i, t in items:
        m = norm(t).strip()
        for k, text in docs:
            best = distance(m, norm(text)) if m else 99
            assert ((k, i) in got) == (best <= int(len(m) * d.EDIT_RATE)), (k, i, t, text, best)
            if (k, i) in got:
                found += 1
                assert got[k, i].edits == best and distance(m, norm(text[got[k, i].start : got[k, i].end])) == best
    assert found > 200


def test_letters_of_two_bytes_match_in_either_case(spark):
    item = "ÉTUDE ÜBER ÑANDÚ ΑΘΗΝΑ МОСКВА İSTANBUL ŒUVRE"
    got = run(spark, [(1, "— étude über ñandú αθηνα москва İstanbul œuvre ")], [(1, item)])
    assert got[1, 1].edits == 0


def test_many_repeats_of_one_passage(spark, monkeypatch):
    text = words(30)
    items = spark.range(10_000).selectExpr("id AS item_id", f"'{text}' AS text")
    monkeypatch.setattr(d, "BLOCK_CHARS", 5000)
    built = []
    real = d.Index.build.__func__
    monkeypatch.setattr(d.Index, "build", classmethod(lambda cls, rows, *a: built.append(len(rows)) or real(cls, rows, *a)))
    docs = spark.createDataFrame([(1, "x " + text), (2, "nothing of it")], "doc_id long, text string")
    assert d.contaminated(spark, docs, items).count() == 10_000 and built == [1]
