"""N-gram Jaccard join: near-duplicate documents by prefix filtering on word shingles.

Rows of the tables here, by step:

1. one pass gives every document its set size and set hash (equal sets are one
   node) and a frequency table of shingle hashes, of bounded size;
2. a second pass emits each set's prefix, rarest shingles first, and one shuffle
   by shingle brings the sets that share one together. Shingles of very common
   hash classes are dealt out in blocks of their sets;
3. neighbours in a block's size order, and its first set, are candidates, and so
   are the first sets of a shingle's blocks, if length and position let them reach
   the threshold and so do their signatures (hash classes in which the sets hold an odd number of shingles). A pair is
   verified once: the suffix filter bounds the difference of the ordered sets
   from below by halving them, and what passes is counted;
4. shingles whose sets are still in several components have all pairs between
   components verified, cell by cell of two blocks, so no component falls apart
   however large a group is.

Links inside a component are counted by ``link_counts``: every two sets of a
component meet once, in cells of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.llm.components import connected_components, spread_join
from tamarack.llm.textbuf import mix, shingles
from tamarack.llm.workspace import Workspace, small_batches

#: Hash classes of the frequency table, a byte each: broadcasting it is bounded (1 MB), and so are a worker's counts (4 MB).
SKETCH_BITS = 20
_CHUNK = 1 << 14
#: Levels of a table's entry for each doubling of the count.
LEVELS = 8
#: A class of more occurrences than this, and than so many times the mean, is dealt out in blocks; and so is any of more than ``MOST_SETS``, which bounds what one task sorts.
HOT_SETS, HOT_SHARE, MOST_SETS = 512, 8, 1 << 18
#: Sets of one shingle in each of the two blocks of a cell, where all pairs between components meet.
CELL_SETS = 512
#: Neighbours in a shingle's order that a set is compared with before components are known.
NEIGHBOURS = 3
#: Longs that hold the parities of a set's 64 * SIGNATURE hash classes.
SIGNATURE = 16
#: Sets and shingles of a block, two of which meet in one cell when links are counted.
BLOCK_SETS, BLOCK_SHINGLES = 1000, 1 << 20
#: Bits of the filter that spares shuffling documents without candidates: 2 ** 26 at most (8 MB).
BLOOM_BITS = 26
#: Shingles that are broadcast at most (8 MB of longs).
BROADCAST_TOKENS = 1_000_000
#: Rows of a set, and fractions of all rows, above which its row is broadcast: these are as many at most.
COPIES = 10_000
#: Sets that a task remembers, lest it gives one twice.
DONE = 50_000


def _set_hash(u: np.ndarray) -> int:
    return int(mix(np.array([mix(u ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(u))])).view(np.int64)[0])


def _signature(u: np.ndarray) -> np.ndarray:
    odd = np.bincount((u >> np.uint64(7)) % np.uint64(64 * SIGNATURE), minlength=64 * SIGNATURE) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _differ(x: str, y: str) -> str:
    """A lower bound of the symmetric difference of two sets, from their signatures."""
    return " + ".join(f"bit_count({x}[{k}] ^ {y}[{k}])" for k in range(SIGNATURE))


def _bucket(u: np.ndarray) -> np.ndarray:
    return (u >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


#: A part of the frequency table: a chunk's classes that occur, and how often.
_PARTS = [pa.field("chunk", pa.int32()), pa.field("at", pa.binary()), pa.field("counts", pa.binary())]
_PARTS_DDL = "chunk int, at binary, counts binary"


def _sparse(chunks: Iterator[tuple[int, np.ndarray]], kind: str) -> Iterator[list[pa.Array]]:
    rows = ((k, at.astype("<u2").tobytes(), c[at].astype(kind).tobytes()) for k, c in chunks if len(at := np.flatnonzero(c)))
    while some := list(islice(rows, 16)):
        yield [pa.array(x, f.type) for x, f in zip(zip(*some), _PARTS)]


def _measure(width: int):
    """(doc_id, n, set_id, signature) of every document, and at the task's end its part of the frequency table."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("set_id", pa.int64()), ("signature", pa.list_(pa.int64())), *_PARTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, waiting = np.zeros(1 << SKETCH_BITS, dtype=np.int32), [], 0
        for batch in batches:
            sizes, sets, marks = [], [], []
            for u in shingles(batch.column("text"), width):
                sizes.append(len(u))
                marks.append(_signature(u) if len(u) else None)
                sets.append(_set_hash(u) if len(u) else None)
                held.append(_bucket(u).astype(np.int32))
                waiting += len(u)
                if waiting > 1 << 19 or len(held) > 5_000:
                    counts += np.bincount(np.concatenate(held), minlength=len(counts)).astype(np.int32)
                    held, waiting = [], 0
            m = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int32()), pa.array(sets, pa.int64()), pa.array(marks, pa.list_(pa.int64())), *(pa.nulls(m, f.type) for f in _PARTS)], schema=schema
            )
        if held:
            counts += np.bincount(np.concatenate(held), minlength=len(counts)).astype(np.int32)
        for part in _sparse(((k, counts[k * _CHUNK : (k + 1) * _CHUNK]) for k in range(len(counts) // _CHUNK)), "<i4"):
            m = len(part[0])
            yield pa.RecordBatch.from_arrays([*(pa.nulls(m, f.type) for f in [*schema][:4]), *part], schema=schema)

    return run


@dataclass(frozen=True)
class Rarity:
    """How common each hash class of shingles is, in levels, and above which level one is dealt out in blocks."""

    levels: np.ndarray
    limit: float

    def order(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the shingles, rarest class first, and the blocks of each of them in that order."""
        level = self.levels[_bucket(u)]
        at = np.lexsort((u, level))
        return at, np.maximum(1, np.ceil(2.0 ** (level[at] / LEVELS) / self.limit)).astype(np.int64)


def _frequencies(parts: DataFrame) -> Rarity:
    """The table summed over tasks: what a scan task reads first, then by chunk. 2 ** SKETCH_BITS entries reach the driver."""

    def add(before: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, at, c in zip(batch.column("chunk").to_pylist(), batch.column("at"), batch.column("counts")):
                    if k not in total:
                        total[k] = np.zeros(_CHUNK, dtype=np.int64)
                    total[k][np.frombuffer(at.as_buffer(), dtype="<u2")] += np.frombuffer(c.as_buffer(), dtype=before)
            for part in _sparse(iter(total.items()), "<i8"):
                yield pa.RecordBatch.from_arrays(part, schema=pa.schema(_PARTS))

        return run

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in add("<i8")(batches):
            counts = [np.frombuffer(c.as_buffer(), dtype="<i8") for c in batch.column("counts")]
            levels = [np.minimum(255, np.round(LEVELS * np.log2(1.0 + c))).astype(np.uint8).tobytes() for c in counts]
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("at"), pa.array(levels, pa.binary()), pa.array([int(c.sum()) for c in counts])], schema=pa.schema([*_PARTS, ("n", pa.int64())]))

    levels, n = np.zeros(1 << SKETCH_BITS, dtype=np.uint8), 0
    some = parts.where("chunk is not null").select("chunk", "at", "counts").mapInArrow(add("<i4"), _PARTS_DDL)
    for row in some.repartition(F.col("chunk")).mapInArrow(level, f"{_PARTS_DDL}, n long").collect():
        levels[row.chunk * _CHUNK + np.frombuffer(row["at"], dtype="<u2").astype(np.int64)] = np.frombuffer(row["counts"], dtype=np.uint8)
        n += row.n
    return Rarity(levels, min(max(HOT_SETS, HOT_SHARE * n / len(levels)), MOST_SETS))


def _prefixes(width: int, percent: int, rarity: Broadcast):
    schema = pa.schema([("token", pa.int64()), ("set_id", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("block", pa.int32()), ("blocks", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, done = rarity.value.order, set()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            rows, held = [], 0
            for u in shingles(batch.column("text"), width):
                n = len(u)
                if n == 0 or (s := _set_hash(u)) in done:
                    continue
                if len(done) >= DONE:
                    done.clear()
                done.add(s)
                p = n - -(-percent * n // 100) + 1
                at, blocks = order(u)
                rows.append((u[at[:p]].view(np.int64), np.full(p, s), np.full(p, n), np.arange(p), (s & 0xFFFFFFFF) % blocks[:p], blocks[:p]))
                held += p
                if held > 1 << 17:
                    yield out()
                    rows, held = [], 0
            if held:
                yield out()

    return run


def _need(percent: int) -> str:
    return f"ceil({percent} * (n + m) / {100 + percent}.0D)"


def _passes(percent: int) -> str:
    """Length filter and positional filter of sizes n, m at positions pos, qos."""
    return f"least(n, m) * 100 >= {percent} * greatest(n, m) and 1 + least(n - pos - 1, m - qos - 1) >= {_need(percent)}"


def _signatures(percent: int, x: str = "x", y: str = "y") -> str:
    """Whether sets of sizes n, m and signatures x, y can reach the threshold."""
    return f"n + m - 2 * {_need(percent)} >= {_differ(x, y)}"


def _arrays(width: int, bits):
    """(set_id, shingles) of the sets that the filter lets through, once a task."""
    schema = pa.schema([("set_id", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, done = np.frombuffer(bits.value, dtype=np.uint32), set()
        power = len(words).bit_length() + 4
        has = lambda k: words[k >> 5] >> np.uint32(k & 31) & np.uint32(1)
        for batch in batches:
            keys, blobs, held = [], [], 0
            for u in shingles(batch.column("text"), width):
                if len(u) == 0 or (s := _set_hash(u)) in done or not all(has(k) for k in _bloom_places(s, power)):
                    continue
                if len(done) >= DONE:
                    done.clear()
                done.add(s)
                keys.append(s)
                blobs.append(u.tobytes())
                held += len(u)
                if held > 1 << 17:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], schema=schema)
                    keys, blobs, held = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], schema=schema)

    return run


def _bloom_places(s: int, power: int) -> tuple[int, int]:
    x = s & 0xFFFFFFFFFFFFFFFF
    return x >> (64 - power), x & ((1 << power) - 1)


def _bloom(ids: DataFrame) -> bytes:
    """A Bloom filter over ``set_id``, of a size that follows their number up to a bound; the bits are joined by Spark, word by word."""
    power = min(BLOOM_BITS, max(16, ids.count().bit_length() + 3))
    low = (1 << power) - 1
    places = ids.select(F.explode(F.array(F.shiftrightunsigned("set_id", 64 - power), F.col("set_id").bitwiseAND(low))).alias("k"))
    words = places.selectExpr("cast(shiftright(k, 5) AS int) AS w", "shiftleft(1L, cast(k & 31 AS int)) AS v").groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    out = np.zeros(1 << (power - 5), dtype=np.uint32)
    out[words.column("w").to_numpy()] = words.column("v").to_numpy()  # at most 2 ** (BLOOM_BITS - 5) rows
    return out.tobytes()


def suffix_bound(x: np.ndarray, y: np.ndarray, most: int, depth: int = 3) -> int:
    """At least how many elements are in one of two ordered sets only; no further than it takes to exceed ``most``.

    The middle of one splits both; what is left and right of it differs by the
    halves' sizes at least, and more if the halves themselves are split.
    """
    low = abs(len(x) - len(y))
    if low > most or depth == 0 or not len(x) or not len(y):
        return low
    mid = len(y) // 2
    at = int(np.searchsorted(x, y[mid]))
    hit = at < len(x) and x[at] == y[mid]
    left, right = (x[:at], y[:mid]), (x[at + hit :], y[mid + 1 :])
    rest = abs(len(right[0]) - len(right[1])) + (not hit)
    first = suffix_bound(*left, most - rest, depth - 1)
    if first + rest > most:
        return first + rest
    return first + (not hit) + suffix_bound(*right, most - first - (not hit), depth - 1)


def _verify(percent: int):
    """Keeps the pairs whose sets reach the threshold; those that the suffix filter drops are not counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                a, b = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                need = -(-percent * (len(a) + len(b)) // (100 + percent))
                most = len(a) + len(b) - 2 * need
                if suffix_bound(a, b, most) > most:
                    keep.append(False)
                    continue
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                keep.append(int((b[at] == a).sum()) >= need)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _count(percent: int):
    """(set_id, links) of each cell: pairs of its two blocks that reach the threshold, weighed by the other set's copies."""
    schema = pa.schema([("set_id", pa.int64()), ("links", pa.int64())])

    def cell(key: tuple, parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        rows = pa.Table.from_batches(parts)
        ids, copies, block = (rows.column(c).to_numpy() for c in ("set_id", "copies", "block"))
        sets = [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in rows.column("shingles")]
        sizes, links = np.array([len(u) for u in sets]), np.zeros(len(ids), dtype=np.int64)
        left, right = np.flatnonzero(block == key[1]), np.flatnonzero(block == key[2])
        if len(left) and len(right):
            tokens, owner = np.concatenate([sets[i] for i in right]), np.repeat(np.arange(len(right)), sizes[right])
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            for x, i in enumerate(left):
                first = np.searchsorted(tokens, sets[i], "left")
                reps = np.searchsorted(tokens, sets[i], "right") - first
                at = np.repeat(first - np.cumsum(reps) + reps, reps) + np.arange(reps.sum())
                good = np.bincount(owner[at], minlength=len(right)) >= -(-percent * (sizes[i] + sizes[right]) // (100 + percent))
                if key[1] == key[2]:
                    good[: x + 1] = False
                links[i] += copies[right[good]].sum()
                links[right[good]] += copies[i]
        return ids[links > 0], links[links > 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cells() -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
            key, held = None, []
            for batch in batches:
                keys = np.stack([batch.column(c).to_numpy() for c in ("component_id", "lo", "hi")])
                cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
                for a, b in zip([0, *cuts], [*cuts, len(batch)] if len(batch) else []):
                    if held and tuple(keys[:, a]) != key:
                        yield key, held
                        held = []
                    key = tuple(keys[:, a])
                    held.append(batch.slice(a, b - a))
            if held:
                yield key, held

        ids, links, n = [], [], 0
        for key, parts in cells():
            found = cell(key, parts)
            ids.append(found[0])
            links.append(found[1])
            n += len(found[0])
            if n > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, links)], schema=schema)
                ids, links, n = [], [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, links)], schema=schema)

    return run


def link(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs(doc_id, text, ...)``.

    Words are maximal runs of other than space and \\t..\\r, A-Z lower-cased; a
    document's set is its distinct shingles of ``width`` words, the whole
    sequence if it has fewer words, and empty if it has none. Documents link
    when 100 * intersection >= percent * union; ``component_id`` is the smallest
    doc_id reachable by links. Null and empty texts link with nothing, and
    neither does a row whose doc_id is null unless its set has another row, whose
    component it then shares. Rows that repeat a doc_id are one node and each
    stays in the result. Other columns are ignored.
    """
    work = Workspace(spark, "ngram-join")
    rows, named = _named(spark, _texts(docs), width, percent, work)
    return _with_sets(rows, work.save(named.select("set_id", "component_id", "copies"), "named")).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def link_counts(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links``: the rows of ``link``, and how many other rows each links with directly.

    Rows of equal sets link. Rows without a doc_id are not counted by others;
    their own ``n_links`` is 0 unless their set has another row.
    """
    work = Workspace(spark, "ngram-links")
    texts = _texts(docs)
    rows, named = _named(spark, texts, width, percent, work)
    named = work.save(named, "named")
    several = named.where("component_id is not null").groupBy("component_id").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles")).where("sets > 1")
    several = several.select("component_id", F.expr(f"greatest(ceil(sets / {BLOCK_SETS}), ceil(shingles / {BLOCK_SHINGLES}))").alias("blocks"))
    members = work.save(named.join(several, "component_id").select("set_id", "component_id", "copies", "blocks", F.expr("pmod(xxhash64(set_id), blocks)").alias("block")), "members")
    bits = spark.sparkContext.broadcast(_bloom(members))
    arrays = texts.select("text").mapInArrow(_arrays(width, bits), "set_id long, shingles binary").repartition(F.col("set_id")).dropDuplicates(["set_id"])
    cells = F.explode(F.expr("transform(sequence(0L, blocks - 1), k -> struct(least(k, block) AS lo, greatest(k, block) AS hi))"))
    spread = arrays.join(members, "set_id").select("component_id", "set_id", "copies", "block", "shingles", cells.alias("cell")).select("component_id", "cell.lo", "cell.hi", "set_id", "copies", "block", "shingles")
    met = spread.repartition(F.col("component_id"), F.col("lo"), F.col("hi")).sortWithinPartitions("component_id", "lo", "hi")
    links = met.mapInArrow(_count(percent), "set_id long, links long").groupBy("set_id").agg(F.sum("links").alias("links"))
    counted = work.save(named.select("set_id", "component_id", "copies").join(work.save(links, "counts"), "set_id", "left"), "counted")
    found = _with_sets(rows, counted)
    n_links = F.col("copies") - F.col("doc_id").isNotNull().cast("long") + F.coalesce("links", F.lit(0))
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(n_links, F.lit(0)).cast("long").alias("n_links"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _with_sets(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``rows`` with the columns of their sets. Sets of very many copies are broadcast, rows without one (null) are not shuffled."""
    limit = max(COPIES, rows.count() // COPIES)
    none = rows.where("set_id is null").select("*", *(F.lit(None).cast(t).alias(c) for c, t in sets.dtypes if c != "set_id"))
    return spread_join(rows.where("set_id is not null"), sets, "set_id", F.col("copies") > limit).unionByName(none)


def _named(spark: SparkSession, texts: DataFrame, width: int, percent: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """``doc_id, n, set_id`` of every row, and ``set_id, component_id, copies, n`` of every set; copies are its rows with an id."""
    small_batches(spark)
    measured = work.save(texts.mapInArrow(_measure(width), f"doc_id long, n int, set_id long, signature array<long>, {_PARTS_DDL}"), "measured")
    rows = measured.where("chunk is null").select("doc_id", "n", "set_id")
    sets = measured.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.max("signature").alias("signature"), F.count("doc_id").alias("copies"), F.max("n").alias("n"))
    sets = work.save(sets, "sets")
    sign = sets.select("set_id", "signature")
    rarity = spark.sparkContext.broadcast(_frequencies(measured))

    by_block = Window.partitionBy("token", "block")
    shared = (
        texts.select("text")
        .mapInArrow(_prefixes(width, percent, rarity), "token long, set_id long, n int, pos int, block int, blocks int")
        .repartition(F.col("token"), F.col("block"))
        .dropDuplicates(["token", "block", "set_id"])
        .withColumn("size", F.count("*").over(by_block))
        .where("size > 1 or blocks > 1")
        .withColumn("place", F.row_number().over(by_block.orderBy("n", "set_id")))
    )
    shared = work.save(shared, "shared")

    def neighbours(rows: DataFrame, *key: str) -> DataFrame:
        """Pairs ``a, b`` of sets that stand near each other in the order of sizes, or first, and pass the filters."""
        me, window = F.struct("set_id", "n", "pos"), Window.partitionBy(*key).orderBy("n", "set_id")
        near = rows.select(*key, "set_id", "n", "pos", *(F.lag(me, k).over(window).alias(f"p{k}") for k in range(1, NEIGHBOURS + 1)), F.first(me).over(window).alias("p0"))
        near = near.select("set_id", "n", "pos", F.explode(F.array(*(f"p{k}" for k in range(NEIGHBOURS + 1)))).alias("p")).where("p is not null and p.set_id <> set_id")
        near = near.select(F.col("set_id").alias("s"), F.col("p.set_id").alias("t"), "n", "pos", F.col("p.n").alias("m"), F.col("p.pos").alias("qos"))
        near = near.where(_passes(percent)).select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"), F.least("n", "m").alias("n"), F.greatest("n", "m").alias("m")).distinct()
        near = near.join(sign.toDF("a", "x"), "a").join(sign.toDF("b", "y"), "b").where(_signatures(percent))
        return near.select("a", "b")

    def verified(candidates: DataFrame) -> DataFrame:
        ids = candidates.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
        bits = spark.sparkContext.broadcast(_bloom(ids))
        # both joins use the one exchange by set_id that drops repeats
        arrays = texts.select("text").mapInArrow(_arrays(width, bits), "set_id long, shingles binary").repartition(F.col("set_id")).dropDuplicates(["set_id"])
        both = candidates.join(arrays.select(F.col("set_id").alias("a"), F.col("shingles").alias("x")), "a").join(arrays.select(F.col("set_id").alias("b"), F.col("shingles").alias("y")), "b")
        return work.save(both.mapInArrow(_verify(percent), "b long, a long").select("a", "b"), "links")

    # the first sets of a shingle's blocks are neighbours too, which ties the blocks of a group of near copies
    firsts = neighbours(shared.where(f"blocks > 1 and place <= {NEIGHBOURS}"), "token")
    pairs = work.save(neighbours(shared, "token", "block").unionByName(firsts).distinct(), "pairs")
    links = verified(pairs)
    if not shared.where(f"size > {NEIGHBOURS + 1} or blocks > 1").isEmpty():
        parts = connected_components(links, work).withColumnRenamed("node", "set_id")
        large = shared.where(f"size > {NEIGHBOURS + 1} or blocks > 1").join(parts, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
        # each shingle's own number of sets says how many blocks its cells are made of
        mixed = large.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.ceil(F.count("*") / CELL_SETS).cast("int").alias("parts")).where("lo < hi").select("token", "parts")
        mixed = work.save(mixed, "tokens")
        few = mixed.count() <= BROADCAST_TOKENS  # else by a shuffle
        large = large.drop("block", "blocks").join(F.broadcast(mixed) if few else mixed, "token").withColumnRenamed("parts", "blocks").withColumn("block", F.expr("cast(pmod(xxhash64(set_id), blocks) as int)"))
        large = large.join(sign.withColumnRenamed("signature", "x"), "set_id")
        cells = F.explode(F.expr("transform(sequence(0, blocks - 1), k -> struct(least(k, block) AS lo, greatest(k, block) AS hi))"))
        large = work.save(large, "mixed").withColumn("cell", cells).select("token", "cell.*", "block", "set_id", "n", "pos", "component", "x")
        other = large.select("token", "lo", "hi", F.col("block").alias("other"), F.col("set_id").alias("t"), F.col("n").alias("m"), F.col("pos").alias("qos"), F.col("component").alias("c"), F.col("x").alias("y"))
        rest = large.join(other, ["token", "lo", "hi"]).where("component < c and block + other = lo + hi").where(_passes(percent)).where(_signatures(percent))
        rest = rest.select(F.least("set_id", "t").alias("a"), F.greatest("set_id", "t").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
        rest = work.save(rest, "rest")
        if not rest.isEmpty():
            links = links.unionByName(verified(rest))

    name = sets.where("rep is not null")
    edges = links.join(name.select(F.col("set_id").alias("a"), F.col("rep").alias("ra")), "a").join(name.select(F.col("set_id").alias("b"), F.col("rep").alias("rb")), "b")
    edges = edges.select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    # a doc_id that repeats with other texts ties those texts' sets together
    again = rows.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).where("lo < hi").select("doc_id")
    again = work.save(again, "again")
    if not again.isEmpty():
        ties = rows.where("n > 0").join(again, "doc_id").select("doc_id", "set_id").distinct().join(name.select("set_id", "rep"), "set_id")
        edges = edges.unionByName(ties.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    whole = connected_components(edges, work)
    named = sets.join(whole.withColumnRenamed("node", "rep"), "rep", "left").select("set_id", F.coalesce("component", "rep").alias("component_id"), "copies", "n")
    return rows, named
