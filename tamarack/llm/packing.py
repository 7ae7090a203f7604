"""Packing of documents into sequences: first-fit decreasing with a tournament tree, in randomised groups.

Documents are tokenized once and written with a random number each. Groups of about
``GROUP_TOKENS`` tokens are made by that number, so that no key, source or length
gathers in one, and are packed apart from each other. What full sequences take of a
long document needs no search; its rest and the short documents are placed in
decreasing order, each into the first sequence with room, which a tournament tree
over the sequences' room finds in a logarithm of their number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.token_files import TEXT_BYTES, _encoder, _spec
from tamarack.llm.workspace import Workspace, arrow_batches

CAPACITY, END_ID = 2048, 1
#: Tokens of a group on average. Only a longer document can make one much larger, as it stays whole in a row anyway.
GROUP_TOKENS = 1 << 22
#: Room of fewer tokens stays empty: it is not worth a cut.
LEAST_CUT = 16
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Room:
    """A tournament tree over the room of sequences: each inner node holds the larger room of its two children."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(n - 1, 0).bit_length()
        self.best = [capacity] * (2 * self.leaves)

    def first(self, need: int) -> int:
        """The first sequence with room for ``need``."""
        at = 1
        while at < self.leaves:
            at *= 2
            if self.best[at] < need:
                at += 1
        return at - self.leaves

    def take(self, sequence: int, amount: int) -> None:
        best, at = self.best, sequence + self.leaves
        best[at] -= amount
        while at > 1:
            at //= 2
            most = max(best[2 * at], best[2 * at + 1])
            if best[at] == most:
                return
            best[at] = most


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The sequence of each size and the number of sequences; equal sizes go in their order. Sizes are at most ``capacity``."""
    out, used, room = np.zeros(len(sizes), dtype=np.int64), 0, Room(len(sizes), capacity)
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        out[k] = found = room.first(size)
        room.take(found, size)
        used = max(used, found + 1)
    return out, used


def packed(tokens: np.ndarray, capacity: int = CAPACITY, least_cut: int = LEAST_CUT) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces ``(document, start, length)`` for documents of so many tokens.

    After the first fit, the emptiest sequences are taken apart to fill the room that
    others have left, where that is at least ``least_cut``. The one sequence that may
    then still have room is parted at powers of two, as such lengths need no padding.
    """
    full, rest = tokens // capacity, tokens % capacity
    out = [[(d, capacity * k, capacity)] for d in np.flatnonzero(full).tolist() for k in range(int(full[d]))]
    docs = np.flatnonzero(rest)
    where, used = first_fit_decreasing(rest[docs], capacity)
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(used)]
    for d, s in zip(docs.tolist(), where.tolist()):
        found[s].append((d, int(full[d]) * capacity, int(rest[d])))
    room = [capacity - sum(p[2] for p in pieces) for pieces in found]
    found = [found[s] for s in np.argsort(room, kind="stable")]  # the fullest first
    room.sort()
    i, j = 0, len(found) - 1
    while i < j:
        if room[i] < least_cut:
            i += 1
            continue
        d, start, length = found[j].pop()
        moved = min(length, room[i])
        found[i].append((d, start, moved))
        room[i] -= moved
        room[j] += moved
        if moved < length:
            found[j].append((d, start + moved, length - moved))
        if not found[j]:
            j -= 1
    out += found[:j]
    if found:
        out += at_powers(found[j]) if room[j] >= least_cut else [found[j]]
    return out


def at_powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces as sequences whose lengths are the powers of two of their sum, the largest first."""
    total, out, queue = sum(p[2] for p in pieces), [], list(reversed(pieces))
    for bit in range(total.bit_length() - 1, -1, -1):
        need, part = total & (1 << bit), []
        while need:
            d, start, length = queue.pop()
            if length > need:
                queue.append((d, start + need, length - need))
                length = need
            part.append((d, start, length))
            need -= length
        if part:
            out.append(part)
    return out


def _tokenize(shared: Broadcast, kind: str, end: int):
    """(doc_id, ids) of each row, its last id ``end``; ``TEXT_BYTES`` of texts at once."""
    schema = pa.schema([("doc_id", pa.int64()), ("u", pa.float64()), ("ids", pa.binary()), ("n", pa.int64())])

    def encoded(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).combine_chunks()
        ids = _encoder(shared.value, kind).encode(table.column("text").chunk(0))
        bounds = np.frombuffer(ids.buffers()[1], dtype=np.int64)[ids.offset : ids.offset + len(ids) + 1]
        data, width = np.frombuffer(ids.buffers()[2], dtype=kind).copy(), np.dtype(kind).itemsize
        data[bounds[1:] // width - 1] = end
        mine = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(bounds.copy()), pa.py_buffer(data)])
        for k in range(0, len(ids), 1000):
            part = [table.column(c).chunk(0).slice(k, 1000) for c in ("doc_id", "u")]
            yield pa.RecordBatch.from_arrays([*part, mine.slice(k, 1000).cast(pa.binary()), pa.array(np.diff(bounds)[k : k + 1000] // width)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.column("text").nbytes
            if size > TEXT_BYTES:
                yield from encoded(held)
                held, size = [], 0
        if held:
            yield from encoded(held)

    return run


def pack(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, end: int = END_ID, tokenizer: str | None = None, seed: int = 13, group_tokens: int = GROUP_TOKENS, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, and the piece's ``ids`` if asked for.

    Each row is a document of its own and ends with ``end``, so null and empty texts
    are one token and rows that repeat or lack a doc_id are all packed; other columns
    are ignored and an empty table gives no pieces. ``start`` counts the document's
    tokens before the piece, ``offset`` those of the sequence, without gaps. Sequences
    hold at most ``capacity`` tokens. ``sequence_id`` is unique; ids of a group follow
    each other. Groups depend on ``seed`` alone, not on texts or ids. The result is written below the shared folder.
    """
    work = Workspace(spark, "packing")
    spec, kind = _spec(tokenizer)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.rand(seed).alias("u"))
    with arrow_batches(spark):
        tokens = work.save(texts.mapInArrow(_tokenize(spark.sparkContext.broadcast(spec), kind, end), "doc_id long, u double, ids binary, n long"), "tokens")
        groups = -(-(tokens.agg(F.sum("n")).first()[0] or 0) // group_tokens)
        schema = PIECES + ", ids array<int>" if with_ids else PIECES

        def place(table: pa.Table) -> pa.Table:
            group = table.column("g")[0].as_py()
            table = table.sort_by("u")  # rows come in any order; the same order in every attempt
            names, rows, sizes = table.column("doc_id").to_pylist(), table.column("ids").combine_chunks(), table.column("n").to_numpy()
            out: dict[str, list] = {c.split()[0]: [] for c in schema.split(", ")}
            for s, pieces in enumerate(packed(sizes, capacity)):
                offset = 0
                for d, start, length in pieces:
                    ids = np.frombuffer(rows[d].as_buffer(), dtype=kind)[start : start + length].astype("<u4")
                    values = (names[d], start, length, zlib.crc32(ids), int(sizes[d]), (group << 32) + s, offset, ids.astype(np.int32))
                    for column, value in zip(out.values(), values):
                        column.append(value)
                    offset += length
            types = [pa.list_(pa.int32()) if c == "ids" else pa.int64() for c in out]
            return pa.table([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

        placed = tokens.withColumn("g", F.floor(F.col("u") * max(groups, 1)).cast("long")).groupBy("g").applyInArrow(place, schema)
        out = work.save(placed, "pieces")
    work.drop(tokens)
    return out
