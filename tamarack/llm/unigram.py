"""Unigram tokenization: encoding, decoding and counting by Viterbi over an Aho-Corasick automaton.

The automaton enumerates every vocabulary piece that ends at a position, longest
first through its output links; each match relaxes the best score there, so one
pass over the text settles it. Tie rule: of equal scores the path whose last
piece starts first (is longest) stays. A character that no single-character
piece covers costs the lowest score less 10 and becomes its UTF-8 bytes, or the
unknown piece where the vocabulary has no byte pieces.

No piece of the vocabulary runs from another character into a space mark or
over a line feed, so a text's best path passes through those boundaries and
words are solved apart. The distinct words of half a million characters go
through the automaton together, one character of each a step, so a step is a few
array operations. Words with characters that no piece is, and very long ones,
are solved one by one; a vocabulary whose pieces run over those boundaries is
solved text by text.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.textbuf import span_hashes
from tamarack.llm.workspace import small_batches

SPACE = "▁"
#: Characters of texts whose words are solved together, ids that are decoded at once, and the longest word that goes with others.
TOGETHER, AT_ONCE, LONG = 1 << 19, 1 << 16, 64
UNKNOWN_PENALTY = 10.0
_BETWEEN = re.compile(f"[^ {SPACE}\n](?=[ {SPACE}\n])")


@dataclass(frozen=True)
class Vocabulary:
    """What tasks need of a vocabulary file: as large as its pieces, whatever the data."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: str  # n normal, b byte, x neither
    unknown: int

    @classmethod
    def load(cls, path: str | None = None) -> Vocabulary:
        """Reads a model file with the public library; only identity normalisation is supported."""
        sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        probe = " aÉ  ﬁ\ńB "
        if sp.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("the vocabulary's normalisation is not the identity with a leading space mark")
        ids = range(sp.get_piece_size())
        kinds = "".join("b" if sp.is_byte(i) else "x" if sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i) else "n" for i in ids)
        return cls(tuple(map(sp.id_to_piece, ids)), tuple(map(sp.get_score, ids)), kinds, sp.unk_id())


class Steps:
    """The automaton as arrays. Nodes are numbered level by level: an edge's place among all, plus 1, is its child."""

    def __init__(self, pieces: list[tuple[int, str]]):
        lengths = np.array([len(p) for _, p in pieces])
        text = np.array([p for _, p in pieces]).view(np.uint32).reshape(len(pieces), -1).astype(np.int64)
        at, levels, nodes = np.zeros(len(pieces), dtype=np.int64), [], 1
        for k in range(text.shape[1]):
            live = np.flatnonzero(lengths > k)
            edges, child = np.unique(at[live] << 21 | text[live, k], return_inverse=True)
            at[live] = nodes + child
            levels.append(edges)
            nodes += len(edges)
        self.edges, self.back = np.concatenate(levels), np.zeros(nodes, dtype=np.int64)
        own, self.n_found, first = np.full(nodes, -1), np.zeros(nodes, dtype=np.int64), 1
        own[at] = [i for i, _ in pieces]
        for k, edges in enumerate(levels):  # a node's longest suffix that is a node lies on a level above
            level = np.arange(first, first + len(edges))
            if k:
                self.back[level] = self.next(self.back[edges >> 21], edges & (1 << 21) - 1)
            self.n_found[level] = (own[level] >= 0) + self.n_found[self.back[level]]
            first += len(edges)
        self.found_at = np.cumsum(self.n_found) - self.n_found
        self.found, at, place = np.empty(self.n_found.sum(), dtype=np.int64), np.arange(nodes), self.found_at.copy()
        while at.any():  # the pieces that end at a node, longest first
            has = own[at] >= 0
            self.found[place[has]] = own[at][has]
            place += has
            at = self.back[at]

    def next(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The nodes that each one's character leads to."""
        out, left = np.zeros(len(nodes), dtype=np.int64), np.arange(len(nodes))
        while len(left):
            key = nodes << 21 | codes
            edge = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            hit = self.edges[edge] == key
            out[left[hit]] = edge[hit] + 1
            more = ~hit & (nodes > 0)
            left, nodes, codes = left[more], self.back[nodes[more]], codes[more]
        return out


class Lattice:
    """The automaton and the solver of one vocabulary."""

    def __init__(self, v: Vocabulary):
        self.automaton = ahocorasick.Automaton()
        normal = [i for i, k in enumerate(v.kinds) if k == "n" and v.pieces[i]]
        for i in normal:
            self.automaton.add_word(v.pieces[i], (i, len(v.pieces[i]), v.scores[i]))
        self.automaton.make_automaton()
        self.singles = {v.pieces[i] for i in normal if len(v.pieces[i]) == 1}
        self.unknown_score = min(v.scores[i] for i in normal) - UNKNOWN_PENALTY
        self.bytes = {int(v.pieces[i][1:-1], 16): i for i, k in enumerate(v.kinds) if k == "b"}
        self.unknown = v.unknown
        self.apart = not any(SPACE in v.pieces[i].lstrip(SPACE) or "\n" in v.pieces[i] for i in normal)
        self.split = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if self.apart else "(?s:.+)").findall
        self.steps = Steps([(i, v.pieces[i]) for i in normal])
        self.lengths, self.scores = np.array([len(p) for p in v.pieces]), np.array(v.scores)
        self.known = np.zeros(0x110000, dtype=bool)
        self.known[[ord(c) for c in self.singles]] = True

    def parts(self, text: str) -> list[str]:
        """The text's words, which are solved apart."""
        return self.split(SPACE + text.replace(" ", SPACE)) if text else []

    def _unknowns(self, part: str) -> list[int]:
        return [] if self.singles.issuperset(part) else [i for i, c in enumerate(part) if c not in self.singles]

    def encode(self, part: str) -> bytes:
        """Ids of the best path as 32-bit integers. Matches come longest first, so a later one must score more."""
        n, miss, k = len(part), self._unknowns(part), 0
        best, size, piece = [0.0] + [-np.inf] * n, [0] * (n + 1), [self.unknown] * (n + 1)
        for last, (i, length, score) in self.automaton.iter(part):
            end = last + 1
            while k < len(miss) and miss[k] < end:
                best[miss[k] + 1], size[miss[k] + 1] = best[miss[k]] + self.unknown_score, 1
                k += 1
            s = best[end - length] + score
            if s > best[end]:
                best[end], size[end], piece[end] = s, length, i
        for u in miss[k:]:
            best[u + 1], size[u + 1] = best[u] + self.unknown_score, 1
        out, at = [], n
        while at:
            if piece[at] == self.unknown and self.bytes:
                out += [self.bytes[b] for b in reversed(part[at - 1].encode("utf-8", "replace"))]
            else:
                out.append(piece[at])
            at -= size[at]
        out.reverse()
        return array("i", out).tobytes()

    def _together(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and each word's number of them: words of known characters, by place and size in ``codes``."""
        base = np.cumsum(sizes + 1) - sizes - 1
        best, piece, depth = np.zeros(int(sizes.sum()) + len(sizes)), np.zeros(int(sizes.sum()) + len(sizes), dtype=np.int64), 0
        live, node = np.arange(len(sizes)), np.zeros(len(sizes), dtype=np.int64)
        while len(live):
            node[live] = now = self.steps.next(node[live], codes[starts[live] + depth])
            depth += 1
            end, n = base[live] + depth, self.steps.n_found[now]
            first = np.cumsum(n) - n
            found = self.steps.found[np.repeat(self.steps.found_at[now] - first, n) + np.arange(n.sum())]
            score = best[np.repeat(end, n) - self.lengths[found]] + self.scores[found]
            best[end] = top = np.maximum.reduceat(score, first)
            which = np.repeat(np.arange(len(n)), n)
            hit = np.flatnonzero(score == top[which])
            piece[end] = found[hit[np.diff(which[hit], prepend=-1) > 0]]  # the first, so longest, of equal scores
            live = live[sizes[live] > depth]
        path, at = np.zeros(len(best), dtype=bool), base + sizes
        while len(at):
            path[at] = True
            left = at - self.lengths[piece[at]]
            on = left > base
            at, base = left[on], base[on]
        return piece[path], np.add.reduceat(path, np.cumsum(sizes + 1) - sizes - 1, dtype=np.int64)

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the texts' distinct words, where each word of the texts has its own there, how many, and the texts' first words."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        codes[codes == 0x20] = ord(SPACE)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        mark, line = codes == ord(SPACE), codes == 0x0A
        begins = mark | line
        begins[1:] &= ~(mark[1:] & mark[:-1])
        begins[1:] |= line[:-1]
        begins[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        starts = np.flatnonzero(begins)
        sizes, of = np.diff(starts, append=len(codes)), np.searchsorted(starts, np.cumsum(sizes) - sizes)
        _, one, same = np.unique(span_hashes(codes, starts, starts + sizes), return_index=True, return_inverse=True)
        there = starts[one][same]
        if (sizes[one][same] != sizes).any() or (codes[np.repeat(there - starts, sizes) + np.arange(len(codes))] != codes).any():
            one = same = np.arange(len(starts))  # equal hashes of different words
        known = np.logical_and.reduceat(self.known[codes], starts)[one] & (sizes[one] <= LONG) if len(one) else np.zeros(0, dtype=bool)
        n, ids = np.zeros(len(one), dtype=np.int64), []
        if known.any():
            found, n[known] = self._together(codes, starts[one][known], sizes[one][known])
            ids.append(found.astype("<i4"))
        for k in np.flatnonzero(~known):
            word = codes[starts[one[k]] :][: sizes[one[k]]].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
            ids.append(np.frombuffer(self.encode(word), dtype="<i4"))
            n[k] = len(ids[-1])
        place = np.empty_like(n)
        order = np.argsort(~known, kind="stable")
        place[order] = np.cumsum(n[order]) - n[order]
        return np.concatenate(ids) if ids else np.zeros(0, dtype="<i4"), place[same], n[same], of

    def _groups(self, texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
        """The texts with their leading mark, long ones in parts, and their numbers."""
        rows, held, size = [], [], 0
        for row, text in enumerate(texts):
            text, at = SPACE + text if text else "", 0
            while at < len(text):
                cut = _BETWEEN.search(text, at + TOGETHER)
                end = cut.end() if cut else len(text)
                if held and size + end - at > TOGETHER:
                    yield rows, held
                    rows, held, size = [], [], 0
                rows.append(row)
                held.append(text[at:end])
                at, size = end, size + end - at
        if held:
            yield rows, held

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, as 32-bit integers, and each text's number of them."""
        if not self.apart:
            rows = [b"".join(map(self.encode, self.parts(t))) for t in texts]
            return np.frombuffer(b"".join(rows), dtype="<i4"), np.array([len(r) // 4 for r in rows], dtype=np.int64)
        counts, out = np.zeros(len(texts), dtype=np.int64), [np.zeros(0, dtype="<i4")]
        for rows, held in self._groups(texts):
            ids, place, n, of = self._words(held)
            np.add.at(counts, rows, np.add.reduceat(n, of))
            out.append(ids[np.repeat(place - np.cumsum(n) + n, n) + np.arange(n.sum())])
        return np.concatenate(out), counts

    def count_all(self, texts: list[str]) -> np.ndarray:
        """How many ids ``encode_all`` gives for each text."""
        if not self.apart:
            return np.array([sum(map(self.count, self.parts(t))) for t in texts], dtype=np.int64)
        counts = np.zeros(len(texts), dtype=np.int64)
        for rows, held in self._groups(texts):
            _, _, n, of = self._words(held)
            np.add.at(counts, rows, np.add.reduceat(n, of))
        return counts

    def count(self, part: str) -> int:
        """Length of ``encode``'s ids: the best score and its piece count are carried, no path is kept."""
        n, miss, k = len(part), self._unknowns(part), 0
        best, count = [0.0] + [-np.inf] * n, [0] * (n + 1)

        def unknown(u: int) -> None:
            best[u + 1] = best[u] + self.unknown_score
            count[u + 1] = count[u] + (len(part[u].encode("utf-8", "replace")) if self.bytes else 1)

        for last, (i, length, score) in self.automaton.iter(part):
            end = last + 1
            while k < len(miss) and miss[k] < end:
                unknown(miss[k])
                k += 1
            s = best[end - length] + score
            if s > best[end]:
                best[end], count[end] = s, count[end - length] + 1
        for u in miss[k:]:
            unknown(u)
        return count[n]


@lru_cache(maxsize=1)
def _lattice(v: Vocabulary) -> Lattice:
    return Lattice(v)


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids))


def _texts(batch: pa.Array) -> list[str]:
    return [t or "" for t in batch.to_pylist()]


def encode(spark: SparkSession, text: Column, vocabulary: Vocabulary) -> Column:
    """``array<int>``: ids of the text. Null and empty texts have no ids."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lattice = _lattice(shared.value)
        for batch in batches:
            yield _lists(*lattice.encode_all(_texts(batch)))

    return ids(text)


class _Table:
    """The pieces' texts laid end to end."""

    def __init__(self, v: Vocabulary):
        table = [p.replace(SPACE, " ").encode() if k == "n" else bytes([int(p[1:-1], 16)]) if k == "b" else b"" for p, k in zip(v.pieces, v.kinds)]
        table[v.unknown] = " ⁇ ".encode()
        self.sizes = np.array([len(t) for t in table])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(table), dtype=np.uint8)

    def text(self, ids: np.ndarray) -> str:
        """The ids' text without the leading space; those outside the vocabulary give nothing."""
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.sizes):
            ids = ids[(ids >= 0) & (ids < len(self.sizes))]
        raw = []
        for at in range(0, len(ids), AT_ONCE):
            part = ids[at : at + AT_ONCE]
            sizes = self.sizes[part]
            stops = np.cumsum(sizes)
            raw.append(self.data[np.repeat(self.starts[part] - stops + sizes, sizes) + np.arange(stops[-1])].tobytes())
        return b"".join(raw).removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(maxsize=1)
def _table(v: Vocabulary) -> _Table:
    return _Table(v)


def decode(spark: SparkSession, ids: Column, vocabulary: Vocabulary) -> Column:
    """The text of ids. Null is null; ids outside the vocabulary and control pieces give nothing.

    ``decode(encode(t))`` is ``t``, but a null becomes empty and the space mark U+2581 a space.
    """
    small_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = _table(shared.value)
        for batch in batches:
            yield pa.array([table.text(row.values.drop_null().to_numpy()) if row.is_valid else None for row in batch], pa.string())

    return texts(ids)


def count(spark: SparkSession, text: Column, vocabulary: Vocabulary) -> Column:
    """``long``: how many ids ``encode`` gives, without making them. Null and empty texts: 0."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("long")
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lattice = _lattice(shared.value)
        for batch in batches:
            yield pa.array(lattice.count_all(_texts(batch)))

    return counts(text)


def encoded(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` and ``n_pieces``; columns of those names are replaced, the rest kept."""
    kept = docs.drop("ids", "n_pieces")
    return kept.withColumn("ids", encode(spark, F.col("text").cast("string"), Vocabulary.load(path))).withColumn("n_pieces", F.size("ids").cast("long"))


def decoded(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs(ids, ...)`` with ``decoded``, replacing a column of that name."""
    return docs.drop("decoded").withColumn("decoded", decode(spark, F.col("ids").cast("array<int>"), Vocabulary.load(path)))


def round_trip(spark: SparkSession, text: Column, vocabulary: Vocabulary) -> Column:
    """``struct<ids, same>``: the text's ids, and whether decoding these gives it again (an empty text for null).

    Both in one pass: neither ids nor texts go to a second Python worker.
    """
    small_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("struct<ids:array<int>,same:boolean>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lattice, table = _lattice(shared.value), _table(shared.value)
        for batch in batches:
            texts = _texts(batch)
            ids, counts = lattice.encode_all(texts)
            same = [table.text(part) == t for part, t in zip(np.split(ids, np.cumsum(counts)[:-1]), texts)]
            yield pa.StructArray.from_arrays([_lists(ids, counts), pa.array(same, pa.bool_())], ["ids", "same"])

    return run(text)


def round_tripped(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with ``n_pieces``, ``ids`` and ``round_trip``; columns of those names are replaced, the rest kept."""
    found = docs.drop("n_pieces", "ids", "round_trip").withColumn("_found", round_trip(spark, F.col("text").cast("string"), Vocabulary.load(path)))
    return found.withColumns({"n_pieces": F.size("_found.ids").cast("long"), "ids": F.col("_found.ids"), "round_trip": F.col("_found.same")}).drop("_found")


def counted(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with ``n_tokens``, replacing a column of that name."""
    return docs.drop("n_tokens").withColumn("n_tokens", count(spark, F.col("text").cast("string"), Vocabulary.load(path)))
