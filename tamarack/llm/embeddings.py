"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are ordered by their first principal component and packed into tiles;
tiles whose ranges lie further apart than the threshold allows never meet. In
a pair of tiles the leading components' products come first; the norms of the
rest bound what they can still add, and pairs that cannot reach the threshold
are given up after each part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.components import connected_components, spread_join
from tamarack.llm.workspace import Workspace

#: Bytes of a tile at most and vectors of one at least, rows compared with as many columns at once, and components per part.
TILE_BYTES, TILE, ROWS, COLUMNS, PARTS = 8 << 20, 1024, 512, 8192, 4
#: Copies of a vector, and fractions of all rows, above which its row is broadcast: these are as many at most.
COPIES = 10_000
#: A cosine this near the threshold is computed again from the vectors as given.
NEAR = 1e-9


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _rows(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)


def principal_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Axes by falling variance of the unit vectors about 0; dim x dim sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                x = _unit(_rows(batch, dim))
                total += x.T @ x
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(dim), pa.int32()), "row": pa.array([r.tobytes() for r in total], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column("i").to_pylist(), batch.column("row")):
                total[i] = total.get(i, 0.0) + np.frombuffer(row.as_buffer())
        yield pa.RecordBatch.from_pydict({"i": pa.array(list(total), pa.int32()), "row": pa.array([x.tobytes() for x in total.values()], pa.binary())})

    out = np.zeros((dim, dim))
    for r in vectors.select("v").mapInArrow(run, "i int, row binary").repartition(F.col("i")).mapInArrow(add, "i int, row binary").collect():
        out[r.i] = np.frombuffer(r.row)
    return np.ascontiguousarray(np.linalg.eigh((out + out.T) / 2)[1][:, ::-1])


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each of ``n`` nodes' component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def compare(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of x, rows of y) of the pairs at the threshold or above, a block of x at a time. ``same``: x is y, pairs i < j."""
    ux, uy = _unit(x), _unit(y)
    px, py = ux @ axes, uy @ axes
    dim = px.shape[1]
    cuts = sorted({-(-dim * k // PARTS) for k in range(1, PARTS + 1)})
    rest = lambda p, c: np.sqrt(np.maximum(0.0, (p[:, c:] ** 2).sum(axis=1)))
    ends = [(rest(px, c), rest(py, c)) for c in cuts]
    least = threshold - NEAR
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    for at, to in ((at, to) for at in range(0, len(px), ROWS) for to in range(0, len(py), COLUMNS)):
        block, other = slice(at, at + ROWS), slice(to, to + COLUMNS)
        if same and to + COLUMNS <= at or px[block, 0].min() > py[other, 0].max() + reach or py[other, 0].min() > px[block, 0].max() + reach:
            continue
        done = px[block, : cuts[0]] @ py[other, : cuts[0]].T
        alive = done + ends[0][0][block, None] * ends[0][1][None, other] >= least
        if same:
            alive &= np.arange(at, at + done.shape[0])[:, None] < np.arange(to, to + done.shape[1])[None, :]
        i, j = np.nonzero(alive)
        if len(i) > 0.05 * alive.size:  # many survive: the block's whole products cost less
            i, j = np.nonzero(alive & (px[block] @ py[other].T >= least))
            i, j = at + i, to + j
        else:
            total = done[i, j]
            i, j, c0 = at + i, to + j, cuts[0]
            for c, (ex, ey) in zip(cuts[1:], ends[1:]):
                total = total + np.einsum("kd,kd->k", px[i, c0:c], py[j, c0:c])
                keep = total + ex[i] * ey[j] >= least
                i, j, total, c0 = i[keep], j[keep], total[keep], c
        for k in range(0, len(i), 1 << 16):
            ik, jk = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            cos = np.einsum("kd,kd->k", ux[ik], uy[jk])
            near = np.flatnonzero(np.abs(cos - threshold) < NEAR)
            for q in near:
                a, b = x[ik[q]].astype(np.float64), y[jk[q]].astype(np.float64)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                cos[q] = math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))
            good = cos >= threshold
            if good.any():
                yield ik[good], jk[good]


_FOUND = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _meet(axes, dim: int, kind: str, threshold: float):
    """Per vector of a pair of tiles: links to vectors of the other, and the smallest id that they join it to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                same = row["a"] == row["b"]
                x, y = (np.frombuffer(row[c].as_buffer(), dtype=kind).reshape(-1, dim) for c in ("va", "vb"))
                ids = np.concatenate([np.array(row["ia"].values), np.array(row["ib"].values)][: 1 if same else 2])
                times = np.concatenate([np.array(row["na"].values), np.array(row["nb"].values)][: 1 if same else 2])
                order = np.argsort(ids, kind="stable")
                place = np.empty(len(ids), dtype=np.int64)
                place[order] = np.arange(len(ids))
                links, shift, root = np.zeros(len(ids), dtype=np.int64), 0 if same else len(x), np.arange(len(ids))
                for i, j in compare(x, y, axes.value, threshold, same):
                    j = j + shift
                    links += np.bincount(i, weights=times[j], minlength=len(ids)).astype(np.int64) + np.bincount(j, weights=times[i], minlength=len(ids)).astype(np.int64)
                    # the roots so far are edges as well; pairs of a block are given up once they are joined
                    root = roots(np.concatenate([place[i], np.arange(len(ids))]), np.concatenate([place[j], root]), len(ids))
                hit = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit]), pa.array(ids[order][root[place[hit]]])], schema=_FOUND)

    return run


def _tiles(spark: SparkSession, vectors: DataFrame, dim: int, axes: np.ndarray, kind: str, tile: int | None, work: Workspace) -> DataFrame:
    """``tile, lo, hi, ids, times, v``: vectors packed in order of their first component.

    Every meeting pair of tiles is shuffled, so tiles are as large as ``TILE_BYTES``
    allows, but small enough for a few pairs a core.
    """
    lead = spark.sparkContext.broadcast(np.ascontiguousarray(axes[:, 0]))

    @F.arrow_udf("double")
    def first(v: pa.Array) -> pa.Array:
        return pa.array(_unit(v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), dim)) @ lead.value)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seq, size = [], 0, 0

        def out(table: pa.Table) -> pa.RecordBatch:
            x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            p = table.column("p").to_numpy()
            return pa.RecordBatch.from_pydict(
                {
                    "tile": pa.array([(table.column("part")[0].as_py() << 32) + seq], pa.int64()),
                    "lo": pa.array([p.min()]),
                    "hi": pa.array([p.max()]),
                    "ids": pa.array([table.column("rep").to_pylist()], pa.list_(pa.int64())),
                    "times": pa.array([table.column("n").to_pylist()], pa.list_(pa.int64())),
                    "v": pa.array([x.astype(kind).tobytes()], pa.binary()),
                }
            )

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            while size >= tile:
                table = pa.Table.from_batches(held)
                yield out(table.slice(0, tile))
                seq, size = seq + 1, size - tile
                held = table.slice(tile).to_batches()
        if size:
            yield out(pa.Table.from_batches(held))

    count = vectors.count()
    if tile is None:
        fit, cores = TILE_BYTES // (dim * np.dtype(kind).itemsize), spark.sparkContext.defaultParallelism
        tile = max(1, min(fit, max(TILE, -(-count // math.isqrt(8 * cores)))))
    parts = max(1, -(-count // tile))
    ordered = vectors.withColumn("p", first("v")).repartitionByRange(parts, "p", "rep").sortWithinPartitions("p", "rep").withColumn("part", F.spark_partition_id())
    return work.save(ordered.mapInArrow(pack, "tile long, lo double, hi double, ids array<long>, times array<long>, v binary"), "tiles")


def near_duplicates(spark: SparkSession, vectors: DataFrame, threshold: float = 0.9, tile: int | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors(vec_id, embedding, ...)``.

    Rows link when their cosine in double precision is ``threshold`` or more;
    equal vectors are compared once and counted each. ``n_links`` counts the
    other rows linked directly, ``component_id`` is the smallest vec_id reachable,
    ``kept`` says that this is the row's own. Null, zero and empty vectors, vectors
    with null or non-finite components and rows without an id link with nothing
    and are kept; vectors of other lengths aren't compared. Other vectors under
    the same id are one node: links add up. Other columns are ignored.
    """
    work = Workspace(spark, "embeddings")
    kind = "<f4" if "float" in dict(vectors.dtypes)["embedding"] else "<f8"
    cast = "array<float>" if kind == "<f4" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(cast).alias("v"))
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = work.save(rows.withColumn("ok", F.coalesce(sound & F.col("vec_id").isNotNull(), F.lit(False))), "rows")
    distinct = work.save(rows.where("ok").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "distinct")
    found = []
    for (dim,) in distinct.select(F.size("v")).distinct().collect():
        part = distinct.where(F.size("v") == dim)
        axes = principal_axes(part, dim)
        tiles = _tiles(spark, part, dim, axes, kind, tile, work)
        # tiles meet if their ranges of the first component come within the largest distance of a linked pair
        reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
        cells = tiles.select("tile", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / reach), F.floor(F.col("hi") / reach) + 1)).alias("cell"))
        a, b = cells.select(F.col("tile").alias("a"), F.col("lo").alias("la"), F.col("hi").alias("ha"), "cell"), cells.select(F.col("tile").alias("b"), F.col("lo").alias("lb"), F.col("hi").alias("hb"), "cell")
        pairs = a.join(b, "cell").where((F.col("a") <= F.col("b")) & (F.col("lb") <= F.col("ha") + reach) & (F.col("la") <= F.col("hb") + reach)).select("a", "b").distinct()
        left = tiles.select(F.col("tile").alias("a"), F.col("ids").alias("ia"), F.col("times").alias("na"), F.col("v").alias("va"))
        right = tiles.select(F.col("tile").alias("b"), F.col("ids").alias("ib"), F.col("times").alias("nb"), F.col("v").alias("vb"))
        met = pairs.join(left, "a").join(right, "b").repartition(F.col("a"), F.col("b"))
        found.append(met.mapInArrow(_meet(spark.sparkContext.broadcast(axes), dim, kind, threshold), "rep long, links long, root long"))
    if not found:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = work.save(reduce(DataFrame.unionByName, found), "links")
    parts = connected_components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")), work)
    of = distinct.groupBy("rep").agg(F.sum("n").alias("n")).join(links.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left")
    of = of.join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    of = distinct.select("v", "rep", F.col("n").alias("copies")).join(of, "rep").select("v", "copies", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    limit = max(COPIES, rows.count() // COPIES)
    of = work.save(of.withColumn("heavy", F.col("copies") > limit), "of")
    out = spread_join(rows.where("ok"), of, "v", F.col("heavy")).select("vec_id", "n_links", F.col("component").alias("component_id"))
    rest = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
