import random

import numpy as np
import pytest

from tamarack.llm import ngram_join
from test_textbuf import expected


def brute(rows, width=5, percent=75):
    sets = [(i, expected(t, width)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= percent * len(x | y) and a is not None and b is not None:
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return sorted((i, len(s), find(i)) for i, s in sets)


def run(spark, rows, **extra):
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, component_id string, n int")
    return sorted(tuple(r) for r in ngram_join.link(spark, docs, **extra).collect())


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_brute_force(spark, seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    base = [[r.choice(words) for _ in range(r.choice([3, 5, 8, 30, 60]))] for _ in range(12)]
    passage = [r.choice(words) for _ in range(25)]
    texts = []
    for k in range(120):
        t = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            t[r.randrange(len(t))] = r.choice(words)
        texts.append(" ".join(passage + t[:6] if k % 9 == 0 else t))
    rows = list(enumerate(texts)) + [(500, ""), (501, None), (502, " \n "), (503, "one two"), (504, "One  TWO")]
    assert run(spark, rows) == brute(rows)


def test_a_large_group_of_near_copies(spark):
    r = random.Random(3)
    base = [f"v{k}" for k in range(80)]
    rows = []
    for k in range(150):
        t = list(base)
        for _ in range(3):
            t[r.randrange(80)] = f"x{r.randrange(1000)}"
        rows.append((k, " ".join(t)))
    assert run(spark, rows) == brute(rows)


def test_blocks_of_a_common_shingle(spark, monkeypatch):
    """Near copies and other texts under one passage, dealt out in blocks of a few sets."""
    monkeypatch.setattr(ngram_join, "HOT_SETS", 6)
    monkeypatch.setattr(ngram_join, "HOT_SHARE", 0)
    r = random.Random(7)
    base, passage = [f"v{k}" for k in range(60)], [f"p{k}" for k in range(9)]
    rows = []
    for k in range(90):
        t = list(base) if k % 3 else [f"y{r.randrange(40)}" for _ in range(7)]
        for _ in range(3):
            t[r.randrange(len(t))] = f"x{r.randrange(1000)}"
        rows.append((k, " ".join(passage + t)))
    rows += [(100 + k, rows[1][1]) for k in range(20)]
    assert run(spark, rows) == brute(rows)


def test_filters_never_drop_a_linked_pair():
    r = np.random.default_rng(5)
    dropped = 0
    for _ in range(4000):
        x = np.unique(r.integers(0, 400, r.integers(1, 120)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        y = np.unique(np.concatenate([x[r.random(len(x)) < r.choice([0.5, 0.8, 0.95])], r.integers(0, 1 << 60, r.integers(0, 30)).astype(np.uint64)]))
        differ, need = len(np.setxor1d(x, y)), -(-75 * (len(x) + len(y)) // 175)
        most = len(x) + len(y) - 2 * need
        for depth in range(5):
            assert ngram_join.suffix_bound(x, y, 1 << 30, depth) <= differ
            if ngram_join.suffix_bound(x, y, most, depth) > most:
                assert differ > most
                dropped += depth == 3
        a, b = ngram_join._signature(x), ngram_join._signature(y)
        assert np.unpackbits((a ^ b).view(np.uint8)).sum() <= differ
    assert dropped > 500


def test_threshold_is_inclusive(spark):
    a = " ".join(f"a{k}" for k in range(11))  # 7 shingles
    rows = [(1, a), (2, a + " b c"), (3, a + " b c d")]  # 7 of 9, 7 of 10
    assert [c for _, _, c in run(spark, rows)] == [1, 1, 1]  # 2 and 3 share 9 of 10
    assert [c for _, _, c in run(spark, [rows[0], rows[2]])] == [1, 3]


def test_repeated_rows_ids_and_empty_tables(spark):
    assert run(spark, [(7, "a b c d e f")] * 2) == [(7, 2, 7)] * 2
    t = " ".join(f"t{k}" for k in range(20))
    rows = [(1, t), (2, "p q r s t u v"), (2, t + " z")]  # id 2 has two texts, one near 1
    assert {c for _, _, c in run(spark, rows)} == {1}
    u = "l m n o p q r s"
    rows = [(9, u), (1, "a b c d e f"), (9, "a b c d e f"), (3, "g h i j k l"), (9, "g h i j k l")]  # id 9 ties three texts
    assert {c for _, _, c in run(spark, rows)} == {1}
    assert run(spark, []) == []
    got = ngram_join.link(spark, spark.createDataFrame([(None, t), (5, t), (None, "x")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id) == [(5, 16, 5)]
    assert {(r.n_shingles, r.component_id) for r in got if r.doc_id is None} == {(16, 5), (1, None)}


def test_long_text(spark):
    t = " ".join(f"k{i}" for i in range(200_000))
    assert run(spark, [(1, t), (2, t + " more"), (3, "x" * 3_000_000)]) == [(1, 199_996, 1), (2, 199_997, 1), (3, 1, 3)]


def brute_links(rows, percent=75):
    sets = [(i, expected(t, 5)) for i, t in rows]
    near = lambda x, y: x and y and 100 * len(x & y) >= percent * len(x | y)
    return sorted((i, sum(a != k and bool(near(x, y)) for a, (_, y) in enumerate(sets))) for k, (i, x) in enumerate(sets))


@pytest.mark.parametrize("block", [1000, 7])
def test_every_link_of_a_large_group_is_counted(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    r = random.Random(11)
    rows = [(900, ""), (901, None), (902, "alone in the world of words")]
    for g in range(3):
        base = [f"g{g}w{k}" for k in range(80)]
        for k in range(40):
            t = list(base)
            for _ in range(r.choice([0, 1, 2, 3])):
                t[r.randrange(80)] = f"x{r.randrange(1000)}"
            rows.append((100 * g + k, " ".join(t)))
    got = ngram_join.link_counts(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.n_links) for x in got) == brute_links(rows)
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == brute(rows)


def test_links_of_rows_without_id(spark):
    t = " ".join(f"t{k}" for k in range(40))
    got = ngram_join.link_counts(spark, spark.createDataFrame([(None, t), (5, t), (6, t + " z"), (None, "x")], "doc_id long, text string")).collect()
    assert sorted((x.doc_id or 0, x.n_links) for x in got) == [(0, 0), (0, 2), (5, 1), (6, 1)]
    assert ngram_join.link_counts(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_link_counts_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from tamarack.llm import queries

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = db.execute(queries.ORACLE_SQL["op6_ngram_link_counts"]).fetchall()
    rows = queries.op6_ngram_link_counts(spark, sf).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted(map(tuple, rows)) == sorted(want) and any(x.n_links for x in rows)


def test_cells_follow_each_shingles_own_number_of_sets(spark, monkeypatch):
    """A passage that very many different documents share, in blocks of few sets: the same links as by brute force."""
    monkeypatch.setattr(ngram_join, "CELL_SETS", 4)
    monkeypatch.setattr(ngram_join, "MOST_SETS", 8)
    r = random.Random(3)
    common = " ".join(f"c{k}" for k in range(12))
    texts = [f"{common} " + " ".join(f"g{g}w{k}" for k in range(8 if m else 7)) for g in range(30) for m in range(2)]
    texts += [f"{common} " + " ".join(f"x{r.randrange(10**6)}" for _ in range(9)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in ngram_join.link(spark, docs).collect()}

    def shingles(t):
        w = t.split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    assert got == {k: top(k) for k in range(len(texts))}
