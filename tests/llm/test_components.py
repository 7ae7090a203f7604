import random

from tamarack.llm import components
from tamarack.llm.components import connected_components
from tamarack.llm.workspace import Workspace


def test_paths_stars_and_loops(spark):
    r = random.Random(1)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 200), (300, 301), (301, 300), (None, 5)]
    r.shuffle(edges)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test"))
    rows = {x.node: x.component for x in got.collect()}
    assert all(rows[k] == 0 for k in range(41)) and all(rows[k] == 100 for k in range(100, 140)) and rows[300] == rows[301] == 300
    assert got.count() == len(rows)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "test")).count() == 0


def test_centres_equal_other_nodes(spark, monkeypatch):
    monkeypatch.setattr(components, "NEIGHBOURS", 3)
    r = random.Random(2)
    edges = [(500, k) for k in range(501, 560)] + [(k, 900) for k in range(600, 640)] + [(501, 639), (7, 900)] + [(r.randrange(2000, 2300), r.randrange(2000, 2300)) for _ in range(250)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test")).collect()
    assert {x.node: x.component for x in got} == {x: find(x) for e in edges for x in e if e[0] != e[1]}
