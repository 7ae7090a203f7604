"""Connected components by alternating large and small stars, on Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tamarack.llm.workspace import Workspace

#: A node with more neighbours than this, and than a ``CENTRES``-th of all edges, is a centre; there are 2 * ``CENTRES`` of them at most.
NEIGHBOURS, CENTRES = 1000, 100_000
#: Edges of a task at least, where there are few: most rounds are short.
TASK_EDGES, TASKS = 100_000, 8


def spread_join(left: DataFrame, right: DataFrame, key: str, heavy: Column) -> DataFrame:
    """``left`` joined with the one row of ``right`` for each key.

    Rows of ``right`` that are ``heavy`` are broadcast, so that the many rows of
    ``left`` with those keys stay where they are; the caller bounds their number.
    """
    hot = F.broadcast(right.where(heavy))
    return left.join(hot, key).unionByName(left.join(hot.select(key), key, "left_anti").join(right.where(~heavy), key))


def _least(edges: DataFrame, count: int, work: Workspace) -> DataFrame:
    """``edges(a, b)`` with the smallest ``b`` of each ``a`` as ``m``; the edges of centres are not shuffled by them."""
    tasks = max(TASKS, count // TASK_EDGES)
    near = edges.withColumn("m", F.min("b").over(Window.partitionBy("a"))).coalesce(tasks)
    limit = max(NEIGHBOURS, count // CENTRES)
    if count <= limit:
        return near
    found = Observation()
    centres = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).where(F.col("n") > limit).select("a", "m").coalesce(tasks)
    centres = work.save(centres.observe(found, F.count(F.lit(1)).alias("rows")), "centres")
    if not found.get["rows"]:
        return near
    rest = edges.join(F.broadcast(centres.select("a")), "a", "left_anti")
    return edges.join(F.broadcast(centres), "a").unionByName(rest.withColumn("m", F.min("b").over(Window.partitionBy("a"))).coalesce(tasks))


def connected_components(edges: DataFrame, work: Workspace, max_rounds: int = 60) -> DataFrame:
    """``node, component`` of every node of ``edges(a, b)``; a component is named by its smallest node.

    Each round links every node's larger neighbours to its smallest one and then
    its smaller ones; the edges become stars after a number of rounds that grows
    with the logarithm of the longest path. The edges of nodes with very many
    neighbours are not shuffled by those nodes. Edges with a null end are left out,
    self links and repeats do no harm, no edges give no rows.
    """

    def save(df: DataFrame, name: str, count: int | None = None) -> tuple[DataFrame, tuple]:
        seen = Observation()
        df = df.distinct() if count is None else df.distinct().coalesce(max(TASKS, count // TASK_EDGES))
        df = work.save(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), name)
        return df, (seen.get["n"], seen.get["h"])

    now, state = save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _least(both, 2 * state[0], work).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        large, (count, _) = save(large, "large", 2 * state[0])
        pairs = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b"))))
        small = _least(large, count, work).select(pairs.alias("e")).select("e.*").where("a <> b")
        before, (now, state) = state, save(small, "small", 2 * count)
        work.drop(large)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
