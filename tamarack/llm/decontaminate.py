"""Benchmark passages in documents, by the q-gram lemma on diagonal bands and banded alignment.

A passage of m bytes that occurs with at most k edits shares at least
m + 1 - q * (k + 1) q-grams with the text, all on k + 1 neighbouring diagonals.
Shared q-grams are counted in bands of diagonals that overlap by half, so one
band holds them all; bands with fewer are dropped without loss, the rest are
aligned within the band. Short passages get the longest q for which the bound
is one q-gram at least, down to the whole passage where no edit is allowed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.textbuf import LOWER, ODD, ODD_INVERSE, power, slices, utf8
from tamarack.llm.workspace import Workspace, small_batches

Q = 12
#: Edits allowed as a share of the passage's normalised length.
EDIT_RATE = 0.05
#: Characters of passages that are indexed and broadcast at once; a larger benchmark goes in blocks.
BLOCK_CHARS = 4_000_000
#: Shared q-grams that are counted at once.
POSTINGS = 1_000_000
_FILTER_BITS = 22
#: Two-byte letters (by code point) in lower case, where that is one such letter too.
_FOLD = np.array([ord(c.lower()) if len(c.lower()) == 1 and 0x80 <= ord(c.lower()) < 0x800 else ord(c) for c in map(chr, range(0x800))])

_KEEP = np.zeros(256, dtype=bool)
_KEEP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def normalise(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with letters of one or two bytes lower-cased and every run of ASCII other than letters and digits as one space.

    Returns the bytes, the rows' offsets in them, and each byte's place in ``buf``.
    """
    keep = _KEEP[buf]
    use = keep.copy()
    use[1:] |= keep[:-1]
    use[off[:-1][off[:-1] < len(buf)]] = keep[off[:-1][off[:-1] < len(buf)]]
    at = np.flatnonzero(use)
    out = LOWER[buf[at]]
    out[~keep[at]] = 32
    lead = np.flatnonzero(buf[at] >> 5 == 6)
    if len(lead):
        low = _FOLD[(out[lead].astype(np.int64) & 31) << 6 | out[lead + 1] & 63]
        out[lead], out[lead + 1] = 0xC0 | low >> 6, 0x80 | low & 63
    return out, np.searchsorted(at, off), at


def qgram_hashes(buf: np.ndarray, q: int) -> np.ndarray:
    n = len(buf)
    if n < q:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power(ODD, n), out=total[1:])
    return (total[q:] - total[:-q]) * power(ODD_INVERSE, n + 1)[: n - q + 1]


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)


@dataclass
class Grams:
    """Places of the q-grams of passages that share one q, by hash."""

    q: int
    hashes: np.ndarray
    bounds: np.ndarray
    item: np.ndarray
    pos: np.ndarray

    @classmethod
    def build(cls, q: int, numbers: np.ndarray, texts: list[np.ndarray]) -> Grams:
        grams = [qgram_hashes(texts[i], q) for i in numbers]
        h = np.concatenate(grams)
        order = np.argsort(h, kind="stable")
        item = np.repeat(numbers, [len(g) for g in grams])[order]
        pos = np.concatenate([np.arange(len(g)) for g in grams])[order]
        hashes, first = np.unique(h[order], return_index=True)
        return cls(q, hashes, np.append(first, len(h)), item, pos)

    @cached_property
    def bits(self) -> int:
        return min(_FILTER_BITS, max(12, len(self.hashes).bit_length() + 5))

    @cached_property
    def filter(self) -> np.ndarray:
        """A table of hash bits that most places of a text fail."""
        out = np.zeros(1 << self.bits, dtype=bool)
        out[_slot(self.hashes, self.bits)] = True
        return out


@dataclass
class Index:
    """A block of passages and their q-grams; its size follows from ``BLOCK_CHARS``."""

    ids: list[int]
    texts: list[np.ndarray]
    budgets: np.ndarray
    needs: np.ndarray
    parts: list[Grams]

    @classmethod
    def build(cls, rows: list[tuple[int, str]], q: int = Q, rate: float = EDIT_RATE) -> Index:
        """Passages without a letter or digit are left out: nothing is left of them."""
        ids, texts = [], []
        for i, t in rows:
            raw = np.frombuffer((t or "").encode(), dtype=np.uint8)
            out, _, _ = normalise(raw, np.array([0, len(raw)]))
            out = out[:-1] if len(out) and out[-1] == 32 else out
            if len(out):
                ids.append(i)
                texts.append(out)
        m = np.array([len(t) for t in texts], dtype=np.int64)
        budgets = np.minimum((m * rate).astype(np.int64), m - 1)
        qs = np.minimum(q, m // (budgets + 1))
        return cls(ids, texts, budgets, m + 1 - qs * (budgets + 1), [Grams.build(int(x), np.flatnonzero(qs == x), texts) for x in np.unique(qs)])


def align(item: np.ndarray, text: np.ndarray, lo: int, hi: int, fixed: bool = False) -> tuple[int, int]:
    """Fewest edits of ``item`` against a part of ``text`` on diagonals lo..hi, and that part's end.

    Diagonals are text minus item position. The part may start anywhere on them,
    or with ``fixed`` at 0 only.
    """
    width = hi - lo + 1
    ramp = np.arange(width)
    big = len(item) + len(text) + width
    row = np.where(ramp + lo < 0, big, 0)
    row = np.where(ramp + lo < 0, big, np.abs(ramp + lo)) if fixed else np.where(ramp + lo > len(text), big, row)
    padded = np.concatenate([np.zeros(max(0, -lo), np.uint8), text, np.zeros(max(0, len(item) + hi - len(text)) + 1, np.uint8)])
    shift = max(0, -lo)
    for i, c in enumerate(item):
        at = i + lo + shift
        same = padded[at : at + width] != c
        end = i + lo + 1 + ramp
        new = np.minimum(row + same, np.append(row[1:], big) + 1)
        new[(end < 1) | (end > len(text))] = big
        if i + 1 + lo <= 0 <= i + 1 + hi:
            new[-(i + 1 + lo)] = min(big, i + 1)
        row = np.minimum.accumulate(new - ramp) + ramp
        row[(end < 0) | (end > len(text))] = big
    best = int(row.argmin())
    return int(row[best]), len(item) + lo + best


def _add(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts summed by key."""
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, weights=counts, minlength=len(found)).astype(np.int64)


def _shared(text: np.ndarray, rows: np.ndarray, index: Index, grams: Grams, lift: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of (row, item, band) and their numbers of shared q-grams."""
    h, q = qgram_hashes(text, grams.q), grams.q
    pos = np.flatnonzero(grams.filter[_slot(h, grams.bits)])
    k = np.minimum(np.searchsorted(grams.hashes, h[pos]), len(grams.hashes) - 1)
    good = grams.hashes[k] == h[pos]
    pos, k = pos[good], k[good]
    row = np.searchsorted(rows, pos, "right") - 1
    good = pos + q <= rows[row + 1]
    pos, k, row = pos[good], k[good], row[good]
    reps = grams.bounds[k + 1] - grams.bounds[k]
    cuts = np.searchsorted(np.cumsum(reps), np.arange(POSTINGS, reps.sum(), POSTINGS))
    held, size, limit = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))], 0, POSTINGS
    for pos_, k_, row_, reps_ in zip(*(np.split(x, cuts) for x in (pos, k, row, reps))):  # a bounded number at once
        post = np.repeat(grams.bounds[k_], reps_) + np.arange(reps_.sum()) - np.repeat(np.cumsum(reps_) - reps_, reps_)
        item, row_ = grams.item[post], np.repeat(row_, reps_)
        diag = np.repeat(pos_, reps_) - rows[row_] - grams.pos[post] + lift  # never negative
        band = diag // (index.budgets[item] + 1) + 1
        pair = (row_ * np.int64(len(index.ids)) + item) * top
        held.append(_add(np.concatenate([pair + band, pair + band - 1]), np.ones(2 * len(band), dtype=np.int64)))
        size += len(held[-1][0])
        if size > limit:
            held = [_add(*map(np.concatenate, zip(*held)))]
            size, limit = 0, POSTINGS + len(held[0][0])
    return _add(*map(np.concatenate, zip(*held)))


def _matches(buf: np.ndarray, off: np.ndarray, index: Index) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, edits, start, end) in the given bytes: of each row and item the place with fewest edits."""
    text, rows, at = normalise(buf, off)
    lift = max(map(len, index.texts))
    n, top = len(index.ids), int(np.diff(rows).max()) + 2 * lift + 4
    keys, counts = map(np.concatenate, zip(*(_shared(text, rows, index, grams, lift, top) for grams in index.parts)))
    enough = counts >= index.needs[(keys // top) % n]
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for key in keys[enough]:
        p, b = divmod(int(key), top)
        r, i = divmod(p, n)
        if best.get((r, i), (1,))[0] == 0:
            continue
        budget, found = int(index.budgets[i]), index.texts[i]
        w = budget + 1
        line = text[rows[r] : rows[r + 1]]
        lo = (b - 1) * w - lift
        first = max(0, lo)
        at0 = line[first : max(first, lo + 2 * w - 1 + len(found))].tobytes().find(found.tobytes())
        if at0 >= 0:  # no edits
            best[r, i] = (0, first + at0, first + at0 + len(found))
            continue
        edits, end = align(found, line, lo - budget, lo + 2 * w - 1 + budget)
        if edits <= budget and edits < best.get((r, i), (edits + 1,))[0]:
            back = line[max(0, end - len(found) - budget) : end][::-1]
            _, size = align(found[::-1], back, -budget, budget, fixed=True)
            best[r, i] = (edits, end - size, end)
    for (r, i), (edits, start, end) in best.items():
        first, last = at[rows[r] + start], at[rows[r] + max(start, end - 1)]
        points = (buf[off[r] : last + 1] & 0xC0) != 0x80
        yield r, i, edits, int(points[: first - off[r]].sum()), int(points.sum())


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE) -> DataFrame:
    """``doc_id, item_id, edits, start, end`` of each document and benchmark passage that occurs in it.

    A passage of m normalised bytes occurs where at most ``rate * m`` edits (fewer
    than m) turn it into a part of the document's normalised text; of several places
    the one with fewest edits is given, in code points. A passage counts as a whole:
    a part of it is found only as far as the edits allow. Null and empty texts, and
    texts without a letter or digit, match nothing, on either side. Rows that repeat
    give rows each; null ids stay null. Other columns are ignored. Empty tables give
    an empty result.

    Equal passages are searched once. The benchmark goes in blocks of about
    ``BLOCK_CHARS`` characters: each is broadcast, its finds are written, and it is
    let go before the next.
    """
    small_batches(spark)
    schema = "doc_id long, key long, edits int, start long, end long"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    work = Workspace(spark, "benchmark")
    passages = work.save(items.select("text").distinct().withColumn("key", F.monotonically_increasing_id()), "passages")
    blocks = -(-(passages.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS)

    def search(shared: Broadcast):
        arrow = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("edits", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                buf, off = utf8(batch.column("text"))
                ids, out = batch.column("doc_id").to_pylist(), []
                for a, b in slices(off) if index.ids else ():
                    found = _matches(buf[off[a] : off[b]], off[a : b + 1] - off[a], index)
                    out += [(ids[a + r], index.ids[i], e, s, t) for r, i, e, s, t in found]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

        return run

    result = spark.createDataFrame([], schema)
    for k in range(blocks):
        part = passages.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast(Index.build(sorted((r.key, r.text) for r in part.collect()), q, rate))
        found = texts.mapInArrow(search(shared), schema)
        if blocks > 1:
            found = work.save(found, "found")
            shared.destroy()
        result = result.unionByName(found) if k else found
    names = items.join(passages, "text").select("key", "item_id")
    return result.join(names, "key").select("doc_id", "item_id", "edits", "start", "end")
