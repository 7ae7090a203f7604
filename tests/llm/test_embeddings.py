import math
import random

import numpy as np
import pytest

from tamarack.llm import embeddings


def brute(rows, threshold=0.9):
    def ok(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cos(a, b):
        a, b = np.array(a, float), np.array(b, float)
        a, b = a / np.abs(a).max(), b / np.abs(b).max()
        return a @ b / math.sqrt((a @ a) * (b @ b))

    root, links = {i: i for i, _ in rows}, [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, v) in enumerate(rows):
        for m in range(k):
            j, w = rows[m]
            if ok(v) and ok(w) and len(v) == len(w) and cos(v, w) >= threshold:
                links[k] += 1
                links[m] += 1
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    return sorted((i, links[k], find(i), i == find(i)) for k, (i, _) in enumerate(rows))


def run(spark, rows, kind="float", **extra):
    df = spark.createDataFrame([(i, v, 5) for i, v in rows], f"vec_id long, embedding array<{kind}>, n_links int")
    return sorted(tuple(r) for r in embeddings.near_duplicates(spark, df, **extra).collect())


def made(seed, n, dim, groups):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dim))
    x = (centres[r.integers(0, groups, n)] + r.normal(size=(n, dim)) * 0.35).astype(np.float32)
    return [(int(i) * 3, [float(c) for c in v]) for i, v in enumerate(x)]


@pytest.mark.parametrize("tile", [7, 40, 8192])
def test_equals_brute_force(spark, tile):
    rows = made(1, 150, 16, 20)
    assert run(spark, rows, tile=tile) == brute(rows)


def test_edges(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (2, v), (3, [2.0, 4.0, 6.0]), (4, None), (5, [0.0] * 3), (6, [float("nan"), 1.0, 1.0]), (7, [float("inf"), 1.0, 1.0]), (8, [None, 1.0, 1.0]), (9, []), (10, [1.0, 2.0]), (11, [2.0, 4.1]), (12, [-1.0, -2.0, -3.0])]
    assert run(spark, rows, "double") == brute(rows)
    assert run(spark, [], "float") == []
    assert run(spark, [(4, None)], "float") == [(4, 0, 4, True)]


def test_extreme_sizes_and_exact_threshold(spark):
    a = [1e-200, 2e-200]
    rows = [(1, a), (2, [1e200, 2e200]), (3, [4.0, 3.0]), (4, [1.0, 0.0])]
    assert run(spark, rows, "double") == brute(rows)
    assert run(spark, [(3, [4.0, 3.0]), (4, [1.0, 0.0])], "double", threshold=0.8) == [(3, 1, 3, True), (4, 1, 3, False)]


def test_large_groups_of_copies_and_near_copies(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=12)
    rows = [(k, [float(x) for x in np.float32(base + r.normal(size=12) * 0.02)]) for k in range(120)] + [(k, [float(x) for x in np.float32(base)]) for k in range(200, 260)]
    random.Random(1).shuffle(rows)
    assert run(spark, rows, tile=50) == brute(rows)


def test_repeated_rows_and_null_ids(spark):
    rows = [(5, [1.0, 0.0]), (5, [1.0, 0.0]), (6, [1.0, 0.1])]
    assert run(spark, rows, "double") == [(5, 2, 5, True), (5, 2, 5, True), (6, 2, 5, False)]
    df = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert {tuple(r) for r in embeddings.near_duplicates(spark, df).collect()} == {(None, 0, None, True), (1, 0, 1, True)}


def test_pruning_loses_nothing():
    r = np.random.default_rng(5)
    x = r.normal(size=(700, 32))
    x[300:] = x[:400] + r.normal(size=(400, 32)) * 0.45
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    axes = np.linalg.eigh(u.T @ u)[1][:, ::-1]
    got = {(int(i), int(j)) for a, b in embeddings.compare(x, x, axes, 0.9, True) for i, j in zip(a, b)}
    i, j = np.nonzero(np.triu(u @ u.T >= 0.9, 1))
    assert got == set(zip(i.tolist(), j.tolist())) and len(got) > 50
