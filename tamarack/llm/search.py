"""Ranked lexical search: bit-sliced Bloom signatures give upper bounds, documents that these can't exclude are scored exactly.

``index`` writes two tables below a folder. ``blocks`` holds documents of like
numbers of terms side by side: bit ``b`` of all their signatures is one slice, a
bitmap over the block's rows. A signature holds each term once for every level of
``LEVELS`` that its count in the document reaches, so the slices of a term and a
level, taken together, mark at least the rows where the term stands so often.
``terms`` holds the number of documents of every term.

``search`` adds up weighted slices: a term counts with the highest count that its
levels allow, so no document scores above its sum. The documents with the highest
sums are scored exactly; their ``top``-th score is a floor for each item, and all
documents whose sums reach it are scored exactly too. Nothing else can be listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.llm.workspace import Workspace, arrow_batches

TOP = 50
#: Counts of a term in a document that its signature tells apart.
LEVELS = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 128, 256, 512, 1024], dtype=np.int64)
#: Bits of a signature for each entry (at least; sizes are powers of two), and slices that an entry sets.
BITS, HASHES = 16, 4
#: Entries of all rows of a block, and rows.
BLOCK_ENTRIES, BLOCK_ROWS, LEAST_CLASS = 1 << 19, 4096, 4
#: Terms that a task counts before it hands on what it has.
HELD_TERMS = 300_000
#: An items' block: items, and characters of their texts; a longer item comes alone.
ITEMS, ITEM_CHARS = 256, 1 << 16
TEXT_BYTES, CELLS = 4 << 20, 1 << 20
#: The score of one term is at most its weight times this.
UNIT = 1_000_000
BLOCKS = "class int, ids array<long>, sizes array<long>, slices binary, terms array<string>, counts array<long>"
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)], dtype=np.uint8)
_NO_ID = -(2**63)


def occurrences(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The terms, and for each of their occurrences the row and the term's place. Terms are runs of letters, digits and all that is not ASCII."""
    texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.string()), ""), pa.array([], pa.string())])  # offsets start at 0
    _, offsets, data = texts.buffers()
    folded = _FOLD[np.frombuffer(data or b"", dtype=np.uint8)]
    lists = pc.split_pattern(pa.StringArray.from_buffers(len(texts), offsets, pa.py_buffer(folded)), " ")
    bounds = np.array(lists.offsets, dtype=np.int64)
    words = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    rows, codes = np.repeat(np.arange(len(texts)), np.diff(bounds)), words.indices.to_numpy()
    filled = np.array(pc.not_equal(words.dictionary, ""), dtype=bool)
    keep = filled[codes] if len(codes) else np.zeros(0, dtype=bool)
    return words.dictionary, rows[keep], codes[keep].astype(np.int64)


def counted(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The terms; row, term and count of each pair that occurs, by row; the number of terms of each row."""
    words, rows, codes = occurrences(texts)
    pairs, counts = np.unique(rows * max(len(words), 1) + codes, return_counts=True)
    return words, pairs // max(len(words), 1), pairs % max(len(words), 1), counts, np.bincount(rows, minlength=len(texts))


def hashes(words: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words.cast(pa.binary()).to_pylist()], dtype=np.uint64)


def entries(hashed: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    """The hash of a term at a level (the finaliser of splitmix64)."""
    z = hashed + (np.atleast_1d(level).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def places(entry: np.ndarray, size: int) -> np.ndarray:
    """The slices of each entry, a row each, in signatures of ``size`` bits."""
    step = (entry >> np.uint64(32)) | np.uint64(1)
    return ((entry[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) & np.uint64(size - 1)).astype(np.int64)


def sliced(rows: list[np.ndarray], size: int) -> bytes:
    """The signatures of some rows' entries, slice by slice."""
    width = -(-len(rows) // 8)
    bits = np.zeros((size, 8 * width), dtype=bool)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = places(np.concatenate(rows), size)
    for k in range(HASHES):
        bits[at[:, k], of] = True
    return np.packbits(bits, axis=1).tobytes()


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``TEXT_BYTES`` of texts at most; a longer text comes alone."""
    for batch in batches:
        ends = np.cumsum(np.array(pc.fill_null(pc.binary_length(batch.column("text")), 0), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            stop = max(int(np.searchsorted(ends, (ends[start - 1] if start else 0) + TEXT_BYTES, side="right")), start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = {"class": pa.int32(), "ids": pa.list_(pa.int64()), "sizes": pa.list_(pa.int64()), "slices": pa.binary(), "terms": pa.list_(pa.string()), "counts": pa.list_(pa.int64())}
    held: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    seen: dict[str, int] = {}

    def row(**values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([values.get(c)], t) for c, t in types.items()], names=list(types))

    def block(c: int) -> pa.RecordBatch:
        ids, sizes, rows = zip(*held.pop(c))
        return row(**{"class": c, "ids": ids, "sizes": sizes, "slices": sliced(list(rows), BITS << c)})

    for batch in _parts(batches):
        words, rows, codes, counts, sizes = counted(batch.column("text"))
        levels = np.searchsorted(LEVELS, counts, side="right")
        ends = np.cumsum(levels)
        entry = entries(np.repeat(hashes(words)[codes], levels), np.arange(int(levels.sum())) - np.repeat(ends - levels, levels))
        bounds = np.append(0, ends)[np.searchsorted(rows, np.arange(len(sizes) + 1))]
        ids = pc.fill_null(batch.column("id"), _NO_ID).to_numpy()
        for k in np.flatnonzero(sizes).tolist():
            mine = entry[bounds[k] : bounds[k + 1]]
            c = max((len(mine) - 1).bit_length(), LEAST_CLASS)
            held.setdefault(c, []).append((int(ids[k]), int(sizes[k]), mine.copy()))
            if len(held[c]) >= min(BLOCK_ROWS, max(BLOCK_ENTRIES >> c, 1)):
                yield block(c)
        documents = np.bincount(codes, minlength=len(words))
        used = np.flatnonzero(documents)
        for w, n in zip(words.take(pa.array(used)).to_pylist(), documents[used].tolist()):
            seen[w] = seen.get(w, 0) + n
        if len(seen) > HELD_TERMS:
            yield row(terms=list(seen), counts=list(seen.values()))
            seen = {}
    for c in sorted(held):
        yield block(c)
    if seen:
        yield row(terms=list(seen), counts=list(seen.values()))


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))


def index(spark: SparkSession, docs: DataFrame, path: str) -> None:
    """Writes the index of ``docs(doc_id, text)``: one pass over the texts, and a shuffle of each task's distinct terms.

    Each row is a document of its own, also where rows repeat or lack a doc_id. Null
    texts and those without terms are in no block; other columns are ignored.
    """
    work = Workspace(spark, "search-index")
    with arrow_batches(spark):
        raw = work.save(_documents(docs).mapInArrow(_index, BLOCKS), "raw")
        raw.where("slices is not null").drop("terms", "counts").write.option("compression", "zstd").parquet(f"{path}/blocks")
        each = raw.where("terms is not null").select(F.explode(F.arrays_zip("terms", "counts")).alias("x"))
        each.groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("df")).write.option("compression", "zstd").parquet(f"{path}/terms")
    work.drop(raw)


@dataclass
class Queries:
    """A block of items: which terms each has (``matrix``), the terms' weights, and the corpus' totals."""

    words: pa.Array
    weights: np.ndarray
    matrix: np.ndarray
    documents: int
    terms: int

    def lengths(self, sizes: np.ndarray) -> np.ndarray:
        """m of documents of so many terms."""
        return 100 - 50 + (50 * sizes.astype(np.int64) * self.documents) // self.terms

    def bounds(self, c: int, sizes: np.ndarray, slices: bytes) -> np.ndarray:
        """Upper bounds of the scores, items by rows of a block; whole numbers."""
        size, rows, m = BITS << c, len(sizes), self.lengths(sizes)
        bitmap = np.frombuffer(slices, dtype=np.uint8).reshape(size, -1)
        most = np.vstack([_part(LEVELS[1:, None] - 1, m), np.full((1, rows), UNIT)])
        gains = np.diff(np.vstack([np.zeros((1, rows), dtype=np.int64), most]), axis=0).astype(self.matrix.dtype)
        out, hashed = np.zeros((len(self.matrix), rows), dtype=self.matrix.dtype), hashes(self.words)
        step = max(CELLS // rows, 16)
        for start in range(0, len(hashed), step):
            part = hashed[start : start + step]
            each = np.zeros((len(part), rows), dtype=self.matrix.dtype)
            alive, marked = np.arange(len(part)), np.full((len(part), bitmap.shape[1]), 255, dtype=np.uint8)
            for level in range(len(LEVELS)):  # a count that reaches a level reaches those below
                marked &= np.bitwise_and.reduce(bitmap[places(entries(part[alive], level), size)], axis=1)
                some = marked.any(axis=1)
                alive, marked = alive[some], marked[some]
                if not len(alive):
                    break
                each[alive] += np.unpackbits(marked, axis=1, count=rows) * gains[level]
            each *= self.weights[start : start + step, None]
            out += self.matrix[:, start : start + step] @ each
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Exact scores, items by texts."""
        words, rows, codes, counts, sizes = counted(texts)
        known = np.array(pc.fill_null(pc.index_in(words, value_set=self.words), -1), dtype=np.int64)
        term = known[codes] if len(codes) else codes
        rows, counts, term = rows[term >= 0], counts[term >= 0], term[term >= 0]
        value = self.weights[term] * _part(counts, self.lengths(sizes)[rows]).astype(self.matrix.dtype)
        out, step = np.zeros((len(self.matrix), len(texts)), dtype=np.int64), max(CELLS // max(len(self.words), 1), 1)
        for start in range(0, len(texts), step):
            mine, width = slice(*np.searchsorted(rows, [start, start + step])), min(step, len(texts) - start)
            each = np.zeros((len(self.words), width), dtype=self.matrix.dtype)
            each[term[mine], rows[mine] - start] = value[mine]
            out[:, start : start + step] = self.matrix @ each
        return out


def _part(count: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * count) // (1000 * count + 20 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _queries(spark: SparkSession, texts: list[str], terms: DataFrame, documents: int, total: int) -> Queries | None:
    words, rows, codes, _, _ = counted(pa.array(texts, pa.string()))
    # the block's terms only, whose number is bounded
    asked = spark.createDataFrame([(w,) for w in words.to_pylist() if w], "term string")
    known = {r.term: r.df for r in terms.join(F.broadcast(asked), "term", "left_semi").collect()}
    order = {w: k for k, w in enumerate(sorted(known))}
    if not order:
        return None
    weights = np.array([weight(documents, known[w]) for w in order], dtype=np.int64)
    spelled, lists = words.to_pylist(), np.zeros((len(texts), len(order)), dtype=bool)
    for r, c in zip(rows.tolist(), codes.tolist()):
        if spelled[c] in order:
            lists[r, order[spelled[c]]] = True
    # doubles are exact for whole numbers below 2 ** 53 and faster to multiply
    exact = int((lists @ weights).max()) * UNIT < 2**53
    kind = np.float64 if exact else np.int64
    return Queries(pa.array(list(order), pa.string()), weights.astype(kind), lists.astype(kind), documents, total)


def _highest(shared: Broadcast, top: int):
    """(item, id, score): each item's ``top`` highest bounds of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        best, names = np.zeros((len(queries.matrix), 0)), np.zeros((len(queries.matrix), 0), dtype=np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                bound = queries.bounds(r["class"], np.array(r["sizes"]), r["slices"])
                best = np.concatenate([best, bound], axis=1)
                names = np.concatenate([names, np.broadcast_to(np.array(r["ids"]), bound.shape)], axis=1)
                if best.shape[1] > top:
                    order = np.argpartition(-best, top - 1, axis=1)[:, :top]
                    best, names = np.take_along_axis(best, order, 1), np.take_along_axis(names, order, 1)
        item, column = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(names[item, column]), pa.array(best[item, column].astype(np.int64))], names=["item", "id", "score"])

    return run


def _reaching(shared: Broadcast):
    """(id, items): the items for which a document can't be excluded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, floor, last = shared.value
        for batch in batches:
            for r in batch.to_pylist():
                bound, names = queries.bounds(r["class"], np.array(r["sizes"]), r["slices"]), np.array(r["ids"])
                keep = (bound > floor[:, None]) | ((bound == floor[:, None]) & (names <= last[:, None]))
                which, item = np.nonzero(keep.T)
                found, starts = np.unique(which, return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(which)), pa.int32()), pa.array(item, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(names[found]), lists], names=["id", "items"])

    return run


def _exact(shared: Broadcast):
    """(item, doc_id, score) of documents and the items listed with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        for batch in _parts(batches):
            scores = queries.scores(batch.column("text"))
            lists = batch.column("items")
            row = np.repeat(np.arange(batch.num_rows), np.array(pc.list_value_length(lists), dtype=np.int64))
            item = lists.flatten().to_numpy()
            keep = scores[item, row] > 0
            row, item = row[keep], item[keep]
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), batch.column("id").take(pa.array(row)), pa.array(scores[item, row])], names=["item", "doc_id", "score"])

    return run


def _first(scored: DataFrame, top: int, name: str) -> DataFrame:
    """Each item's ``top`` first rows with their rank; Spark limits every task's rows before the shuffle."""
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col(name).asc_nulls_first())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _key(column: str) -> Column:
    return F.coalesce(column, F.lit(_NO_ID))


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, path: str, top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents of each item of ``items(item_id, text)``.

    ``path`` is the index of ``docs``. Equal scores go by ascending doc_id (null
    first); of rows that repeat both, each is listed. Every row of ``items`` is asked,
    also where item_ids repeat or are null; items without terms, or whose terms no
    document holds, have no rows, nor have documents with a score of 0. Items are asked
    in blocks of bounded size, each against the whole index.
    """
    work = Workspace(spark, "search")
    blocks, terms = spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/terms")
    totals = blocks.agg(F.sum(F.size("ids")).alias("n"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("l")).first()
    source = _documents(docs)

    def rescored(pairs: DataFrame, queries: Broadcast, name: str) -> DataFrame:
        joined = source.join(pairs.withColumnRenamed("id", "_id"), _key("id") == F.col("_id"))
        return work.save(joined.select("id", "text", "items").mapInArrow(_exact(queries), "item int, doc_id long, score long"), name)

    out = []
    with arrow_batches(spark):
        for names, texts in _item_blocks(items) if totals.l else []:
            queries = _queries(spark, texts, terms, totals.n, totals.l)
            if queries is None:
                continue
            shared = spark.sparkContext.broadcast(queries)
            likely = _first(blocks.mapInArrow(_highest(shared, top), "item int, id long, score long"), top, "id")
            likely = work.save(likely.groupBy("id").agg(F.collect_set("item").alias("items")), "likely")
            first = rescored(F.broadcast(likely), shared, "first")  # at most ``top`` documents for each of at most ``ITEMS`` items
            floor, last = np.zeros(len(texts)), np.full(len(texts), _NO_ID)
            for r in _first(first, top, "doc_id").where(F.col("rank") == top).collect():
                floor[r["item"]], last[r["item"]] = r.score, _NO_ID if r.doc_id is None else r.doc_id
            bounded = spark.sparkContext.broadcast((queries, floor, last))
            reaching = blocks.mapInArrow(_reaching(bounded), "id long, items array<int>").select("id", F.explode("items").alias("item"))
            pairs = work.save(reaching.groupBy("id").agg(F.collect_set("item").alias("items")), "reaching")
            exact = rescored(pairs, shared, "exact")  # they grow with the documents: Spark broadcasts them only if they are few
            listed = spark.createDataFrame(list(enumerate(names)), f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
            out.append(work.save(_first(exact, top, "doc_id").join(F.broadcast(listed), "item").select("item_id", "rank", "doc_id", "score"), "ranked"))
    if not out:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    found = out[0]
    for other in out[1:]:
        found = found.unionByName(other)
    return found


def _item_blocks(items: DataFrame) -> Iterator[tuple[list, list[str]]]:
    """Items in blocks of at most ``ITEMS`` and ``ITEM_CHARS``, a partition at a time."""
    names, texts, size = [], [], 0
    for r in items.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).toLocalIterator():
        if texts and (len(texts) >= ITEMS or size + len(r.text) > ITEM_CHARS):
            yield names, texts
            names, texts, size = [], [], 0
        names.append(r.item_id)
        texts.append(r.text)
        size += len(r.text)
    if texts:
        yield names, texts
