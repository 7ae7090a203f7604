"""Vectorised views of Arrow string columns: words, hashes and shingles.

Everything works on the UTF-8 buffer of a batch, so the cost per byte is that
of a few numpy passes and no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of one slice of a batch: bounds the arrays below whatever the batch holds.
SLICE_BYTES = 1 << 18

ODD = 0x9E3779B97F4A7C15
ODD_INVERSE = pow(ODD, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the column and ``len + 1`` offsets into them; a null is an empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, off


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes; a longer row comes alone."""
    n, first = len(off) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def power(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        _powers[base] = have = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of rows laid end to end, and the words' rows. ``off[0]`` is 0."""
    word = ~SEPARATOR[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[off] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(off, starts, "right") - 1


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, the same wherever the span stands."""
    n = len(buf)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power(ODD, n), out=total[1:])
    return mix((total[ends] - total[starts]) * power(ODD_INVERSE, n + 1)[starts])


def shingles(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Per row the sorted distinct hashes of its shingles of ``width`` lower-cased words.

    A row of fewer words has its whole sequence as one shingle, a row without words none.
    """
    buf, off = utf8(column)
    weights = power(0xD1342543DE82EF95, width + 1)[1:]
    for first, last in slices(off):
        part = LOWER[buf[off[first] : off[last]]]
        rows = off[first : last + 1] - off[first]
        starts, ends, row = word_spans(part, rows)
        hashes = span_hashes(part, starts, ends)
        bounds = np.searchsorted(row, np.arange(last - first + 1))
        windows = np.zeros(max(0, len(hashes) - width + 1), dtype=np.uint64)
        for j in range(width):
            windows += hashes[j : j + len(windows)] * weights[j]
        windows = mix(windows + np.uint64(width))
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= width:
                yield np.unique(windows[a : b - width + 1])
            elif b > a:
                short = (hashes[a:b] * weights[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield mix(np.array([short]))
            else:
                yield windows[:0]
