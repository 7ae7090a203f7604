"""Merkle manifest of a dataset: aligned subtrees in van Emde Boas order, in layers, with proofs and their check.

Rows are leaves, ordered by key within their group; two consecutive nodes become
their parent (a last single one alone) until one is left, the group's root. The
roots, in group order, likewise give the root of the manifest.

A tree is cut into aligned subtrees of ``height`` levels: block ``b`` of a layer
holds its nodes ``b << height`` and following and all that is above them up to the
block's root, and the blocks' roots are the lowest nodes of the next layer. A block
is one row; its nodes are one binary value in van Emde Boas order: a tree is split
at half its height and stored as its upper part, followed by the lower subtrees,
each in the same order. ``addresses`` computes a node's place from its depth and
position, for building as for the siblings that a proof lists.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.llm.workspace import Workspace, arrow_batches

HEIGHT, DIGEST = 12, 32


def addresses(levels: int, depth: int, at: np.ndarray) -> np.ndarray:
    """Places, in van Emde Boas order, of the nodes ``at`` of a depth of a complete tree with so many levels (the root has depth 0)."""
    place = np.zeros(len(at), dtype=np.int64)
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        lower = levels - upper
        place += (1 << upper) - 1 + (at >> (depth - upper)) * ((1 << lower) - 1)
        depth, at, levels = depth - upper, at & ((1 << (depth - upper)) - 1), lower
    return place


@lru_cache(maxsize=64)
def _row(height: int, depth: int) -> np.ndarray:
    return addresses(height + 1, depth, np.arange(1 << depth))


def height_of(members: int, total: int, height: int) -> int:
    """Levels above the lowest nodes of a block: all where other blocks follow, else as many as lead to one node."""
    return height if total > 1 << height else max(members - 1, 0).bit_length()


def parent(*children: bytes) -> bytes:
    return hashlib.sha256(b"".join(c.hex().encode() for c in children)).digest()


def built(leaves: list[bytes], height: int) -> tuple[bytes, bytes]:
    """A block's nodes in van Emde Boas order, zeros where there is none, and its root."""
    nodes = np.zeros(((1 << (height + 1)) - 1, DIGEST), dtype=np.uint8)
    level, sha = [x.hex().encode() for x in leaves], hashlib.sha256
    for up in range(height + 1):
        nodes[_row(height, height - up)[: len(level)]] = np.frombuffer(bytes.fromhex(b"".join(level).decode()), dtype=np.uint8).reshape(-1, DIGEST)
        if up < height:
            level = [sha(b"".join(level[k : k + 2])).hexdigest().encode() for k in range(0, len(level), 2)]
    return nodes.tobytes(), bytes.fromhex(level[0].decode())


def siblings(nodes: bytes, height: int, members: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level from below: each lowest node's sibling, whether there is one, and whether it stands left."""
    table, out = np.frombuffer(nodes, dtype=np.uint8).reshape(-1, DIGEST), []
    at, count = np.arange(members), members
    for up in range(height):
        beside = at ^ 1
        there = beside < count
        out.append((table[_row(height, height - up)[np.where(there, beside, 0)]], there, beside < at))
        at, count = at >> 1, (count + 1) >> 1
    return out


def steps(nodes: bytes, height: int, members: int) -> list[bytes]:
    """For each lowest node, its path to the block's root: a byte (0 no sibling, 1 right, 2 left) and the sibling, level by level."""
    parts = np.zeros((members, height, 1 + DIGEST), dtype=np.uint8)
    for up, (digest, there, left) in enumerate(siblings(nodes, height, members)):
        parts[:, up, 0] = np.where(there, 1 + left, 0)
        parts[:, up, 1:] = digest * there[:, None]
    raw, width = parts.tobytes(), height * (1 + DIGEST)
    return [raw[k * width : (k + 1) * width] for k in range(members)]


def folded(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its path give."""
    here, sha = leaf.hex().encode(), hashlib.sha256
    for k in range(0, len(path), 1 + DIGEST):
        kind, other = path[k], path[k + 1 : k + 1 + DIGEST].hex().encode()
        here = sha(here if kind == 0 else here + other if kind == 1 else other + here).hexdigest().encode()
    return bytes.fromhex(here.decode())


def listed(path: bytes) -> list[bytes]:
    """The siblings of a path, from the leaf up."""
    return [path[k + 1 : k + 1 + DIGEST] for k in range(0, len(path), 1 + DIGEST) if path[k]]


def leaf_of(*columns: Column) -> Column:
    """The digest of a row, as binary: every value as its length in bytes, a colon and itself, or ``-`` where it is null."""
    texts = [c.cast("string") for c in columns]
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256))


def _build(work: Workspace, rows: DataFrame, name: str, path: str, height: int) -> DataFrame:
    """Writes the layers of the trees of ``rows(_group, _key, _leaf, _claim)`` and returns ``_group, root``.

    Rows are dealt out by range and numbered within their part; the parts' counts (a row
    for each part and group) put the numbers behind each other. Rows of one key are dealt
    by digest and place as well.
    """
    spark = rows.sparkSession
    order = ["_group", F.col("_key").asc_nulls_first(), "_leaf", "_at"]
    dealt = rows.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    key_type = rows.schema["_key"].dataType.simpleString()
    group_type = rows.schema["_group"].dataType.simpleString()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = batch.column("_group").dictionary_encode()  # sorted, so that equal groups are neighbours
            codes = runs.indices.to_numpy()
            starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            lengths = np.diff(np.append(starts, len(codes)))
            place = np.arange(len(codes)) - np.repeat(starts, lengths)
            first = runs.dictionary[int(codes[0])].as_py()
            if first == last:
                place[: lengths[0]] += n
            n = int(place[-1]) + 1
            last = runs.dictionary[int(codes[-1])].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, "_place"])

    numbered = work.save(dealt.drop("_at").withColumn("_part", F.spark_partition_id()).select("_group", "_part", "_key", "_leaf", "_claim").mapInArrow(number, f"_group {group_type}, _part int, _key {key_type}, _leaf binary, _claim binary, _place long"), name)
    counts = numbered.groupBy("_group", "_part").agg((F.max("_place") + 1).alias("n"))
    ahead = counts.select(
        F.col("_group").alias("_g"), F.col("_part").alias("_p"), F.sum("n").over(Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("ahead"), F.sum("n").over(Window.partitionBy("_group")).alias("total")
    )
    placed = numbered.join(ahead, (F.col("_group") == F.col("_g")) & (F.col("_part") == F.col("_p"))).select("_group", "_key", "_leaf", "_claim", (F.col("_place") + F.coalesce("ahead", F.lit(0))).alias("at"), "total")
    schema = f"_group {group_type}, height int, block long, total long, members int, nodes binary, root binary"
    layers = [_layer(placed, f"{path}/0", f"{schema}, keys array<{key_type}>, claims array<binary>", height)]
    most = layers[0].agg(F.max("total")).first()[0] or 0
    while most > 1 << height:
        most = -(-most // (1 << height))
        above = layers[-1].where(f"not {_TOP}").select("_group", F.lit(None).cast(key_type).alias("_key"), F.col("root").alias("_leaf"), F.lit(None).cast("binary").alias("_claim"), F.col("block").alias("at"), F.expr(f"shiftright(total + {(1 << height) - 1}, {height})").alias("total"))
        layers.append(_layer(above, f"{path}/{len(layers)}", schema, height))
    work.drop(numbered)
    return _roots(layers)


#: The one block of a group that ends in its root.
_TOP = "total <= shiftleft(1L, height)"


def _roots(layers: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [x.where(_TOP).select("_group", "root") for x in layers])


def _layer(placed: DataFrame, path: str, schema: str, height: int) -> DataFrame:
    """Blocks of the nodes ``at`` of a layer; a group of rows is one block, so it has a bounded number of members."""
    names = [c.split()[0] for c in schema.split(", ")]
    spark, key_type, group_type = placed.sparkSession, *(_arrow(placed.schema[c].dataType) for c in ("_key", "_group"))
    types = {"_group": group_type, "height": pa.int32(), "block": pa.int64(), "total": pa.int64(), "members": pa.int32(), "nodes": pa.binary(), "root": pa.binary(), "keys": pa.list_(key_type), "claims": pa.list_(pa.binary())}

    def block(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        total, leaves = table.column("total")[0].as_py(), table.column("_leaf").to_pylist()
        nodes, root = built(leaves, height_of(len(leaves), total, height))
        row = {"_group": table.column("_group")[0].as_py(), "height": height, "block": table.column("at")[0].as_py() >> height, "total": total, "members": len(leaves), "nodes": nodes, "root": root}
        if "keys" in names:
            row |= {"keys": table.column("_key").to_pylist(), "claims": table.column("_claim").to_pylist()}
        return pa.table([pa.array([row[c]], types[c]) for c in names], names=names)

    blocks = placed.withColumn("_block", F.shiftright("at", height)).groupBy("_group", "_block").applyInArrow(block, schema)
    blocks.write.option("compression", "none").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _paths(layers: list[DataFrame], seeds: DataFrame) -> DataFrame:
    """The lowest blocks with ``path``, the way from a block's root to the manifest's root, and the columns of ``seeds(_group, path, ...)``.

    From the top, every block hands its members the way from them up: the bounded
    number of a block's members is a row each, joined with the blocks below.
    """
    extra = [c for c in seeds.columns if c not in ("_group", "path")]
    group_type = seeds.schema["_group"].dataType.simpleString()
    kinds = "".join(f", {c} {seeds.schema[c].dataType.simpleString()}" for c in extra)

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, r in enumerate(batch.select([c for c in batch.schema.names if c not in ("_group", *extra)]).to_pylist()):
                n = r["members"]
                ways = [x + r["path"] for x in steps(r["nodes"], height_of(n, r["total"], r["height"]), n)]
                same = pa.array([k] * n, pa.int64())
                first = r["block"] << r["height"]
                yield pa.RecordBatch.from_arrays([batch.column("_group").take(same), pa.array(range(first, first + n), pa.int64()), pa.array(ways, pa.binary()), *(batch.column(c).take(same) for c in extra)], names=["_group", "block", "path", *extra])

    handed = None
    for k in range(len(layers) - 1, -1, -1):
        layer = layers[k]
        tops = layer.where(_TOP).join(seeds, "_group")
        joined = tops if handed is None else tops.unionByName(layer.where(f"not {_TOP}").join(handed, ["_group", "block"]))
        if k:
            handed = joined.select("_group", "height", "block", "total", "members", "nodes", "path", *extra).mapInArrow(below, f"_group {group_type}, block long, path binary{kinds}")
    return joined


def _members(batches: Iterator[pa.RecordBatch], out: list[tuple[str, pa.DataType]], make) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            n, height = r["members"], height_of(r["members"], r["total"], r["height"])
            ways = steps(r["nodes"], height, n)
            leaves = np.frombuffer(r["nodes"], dtype=np.uint8).reshape(-1, DIGEST)[_row(height, height)[:n]]
            rows = [make(r, key, leaf.tobytes(), claim, way + r["path"]) for key, leaf, claim, way in zip(r["keys"], leaves, r["claims"], ways)]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], t) for c, (_, t) in enumerate(out)], names=[name for name, _ in out])


def write(spark: SparkSession, docs: DataFrame, path: str, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id", group: str = "lang", claim: Column | None = None, height: int = HEIGHT) -> None:
    """Writes the manifest of ``docs`` below ``path``: the leaves' layers of each group and those of the groups' roots.

    A leaf is the digest of ``columns``. Keys ascend with null first; rows of one key
    go by digest, so that rows in any order give the same root. Null is a group of its
    own, before all others. Repeated rows are leaves of their own; other columns are
    ignored, whatever their names. An empty table gives a manifest without a root. ``claim`` is a digest
    kept with each leaf, to be checked against the manifest; the leaf itself by default.
    """
    work = Workspace(spark, "manifest")
    label = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("-"))  # null is first
    leaf = leaf_of(*(F.col(f"`{c}`") for c in columns))
    with arrow_batches(spark, 5000):
        rows = work.save(docs.select(label.alias("_group"), F.col(f"`{key}`").alias("_key"), leaf.alias("_leaf"), (leaf if claim is None else claim).alias("_claim")), "leaves")
        roots = _build(work, rows, "numbered", f"{path}/groups", height)
        work.drop(rows)
        top = roots.select(F.lit("").alias("_group"), F.col("_group").alias("_key"), F.col("root").alias("_leaf"), F.lit(None).cast("binary").alias("_claim"))
        _build(work, top, "roots", f"{path}/top", height)


def _layers(spark: SparkSession, path: str) -> list[DataFrame]:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    n = len(where.getFileSystem(conf).listStatus(where))
    return [spark.read.parquet(f"{path}/{k}") for k in range(n)]


def _proved(spark: SparkSession, path: str) -> DataFrame:
    """The groups' lowest blocks with their ways to the root, ``subroot`` and ``root``."""
    groups, top = _layers(spark, f"{path}/groups"), _layers(spark, f"{path}/top")
    seeds = _roots(top).select("_group", F.lit(b"").alias("path"), F.col("root").alias("whole"))
    names = [("_group", pa.string()), ("subroot", pa.binary()), ("path", pa.binary()), ("whole", pa.binary())]
    make = lambda r, key, leaf, claim, way: (key, leaf, way, r["whole"])
    of_groups = _paths(top, seeds).mapInArrow(lambda b: _members(b, names, make), "_group string, subroot binary, path binary, whole binary")
    return _paths(groups, of_groups)


def root(spark: SparkSession, path: str) -> str | None:
    """The root of a manifest, in hexadecimal; None if it has no leaves."""
    found = _roots(_layers(spark, f"{path}/top")).select(F.lower(F.hex("root")).alias("root")).first()
    return found.root if found else None


def proofs(spark: SparkSession, path: str) -> DataFrame:
    """``key, leaf, siblings, lefts``: each leaf's siblings up to the root, and whether each stands left. Levels without a sibling are null."""
    blocks = _proved(spark, path)
    key = blocks.schema["keys"].dataType.elementType
    out = [("key", _arrow(key)), ("leaf", pa.binary()), ("siblings", pa.list_(pa.binary())), ("lefts", pa.list_(pa.bool_()))]

    def make(r: dict, name, leaf: bytes, claim: bytes, way: bytes) -> tuple:
        kinds = way[:: 1 + DIGEST]
        return name, leaf, [way[k + 1 : k + 1 + DIGEST] if way[k] else None for k in range(0, len(way), 1 + DIGEST)], [None if k == 0 else k == 2 for k in kinds]

    return blocks.mapInArrow(lambda b: _members(b, out, make), f"key {key.simpleString()}, leaf binary, siblings array<binary>, lefts array<boolean>")


def verified(spark: SparkSession, path: str) -> DataFrame:
    """``key, leaf, subroot, root, proof_sha256, folded_root, verified``: every leaf's claim carried up by its siblings and compared with the root. Digests are in hexadecimal."""
    blocks = _proved(spark, path)
    key = blocks.schema["keys"].dataType.elementType
    columns = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    out = [("key", _arrow(key)), *((c, pa.string()) for c in columns), ("verified", pa.bool_())]

    def make(r: dict, name, leaf: bytes, claim: bytes, way: bytes) -> tuple:
        got = folded(claim, way)
        return name, leaf.hex(), r["subroot"].hex(), r["whole"].hex(), parent(*listed(way)).hex(), got.hex(), got == r["whole"]

    schema = f"key {key.simpleString()}, " + ", ".join(f"{c} string" for c in columns) + ", verified boolean"
    return blocks.mapInArrow(lambda b: _members(b, out, make), schema)
