"""Toxicity by a fuzzy lexicon: Levenshtein automata intersected with a trie, and context windows.

The lexicon is learned from labelled rows: words, and word beginnings, that
toxic texts hold far more often than others, in different surroundings. A
word is looked up by running the automaton that accepts everything within one
edit of a term, two swapped neighbours being one; its states are sets of (trie
node, edits) and are made when a word first reaches them. Words with symbols
or spaces between their letters are looked up without them. Each hit is weighed
by its window: inside quotation marks, or beside a reporting verb without a
second person, it counts as quoted, beside a second person as addressed. Quoted
hits have a sum of their own, whose weight is 0 unless labelled rows give it one,
and count in no other. A logistic model on the sums gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.labelled import MAX_TRAIN, fit_logistic, training_rows
from tamarack.llm.workspace import small_batches

WORD = re.compile(r"\w+")
#: A word with symbols in it, or at least four letters with spaces between them.
BROKEN = re.compile(r"(?<!\w)(?:\w(?: \w){3,}(?!\w)|\w++(?:[*@$!#+~.·-]\w++)+)")
#: Terms that a small sample need not prove: each stays unless labelled rows speak against it.
SEED_TERMS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "imbecile", "dumbass", "bastard", "asshole", "bitch")
REPORTING = frozenset("said says called calls wrote writes quoted quote quotes reported reports term word phrase dit disait écrit dijo dice llamó escribió sagte sagt schrieb nannte".split())
ADDRESS = frozenset("you your youre yours u ur tu te toi ton ta vous votre usted tú du dich dein ihr euch".split())
QUOTES, SINGLE = "\"“”„«»", "'‘’‚‹›`"
#: Characters on either side of a hit that are read as its window.
WINDOW = 60
STEMS = (4, 5, 6)
#: What a hit with an edit counts beside one without.
EDITED = 0.8
#: Least length of fuzzy terms, and words that a worker remembers as clean at most.
FUZZY_LENGTH, SEEN_WORDS = 5, 150_000
MIN_G2, MIN_SHARE, MIN_LEFTS = 20.0, 0.6, 3


@dataclass(frozen=True)
class Lexicon:
    """Terms with weights; a term that ends in * stands for all words that begin so."""

    weights: dict[str, float]
    fuzzy: frozenset[str]


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    coefficients: tuple[float, ...]


class Automaton:
    """All words within one edit of a fuzzy term, equal to another term, or beginning with a stem.

    A state's pairs are (trie node, edits so far), or (trie node, -code of c) where c was
    read too early: it and the character before it may have changed places.
    """

    def __init__(self, lexicon: Lexicon):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.bends = [False]  # a fuzzy term passes through
        self.fuzzy = lexicon.fuzzy
        for t in sorted(lexicon.weights):
            node, bends = 0, t in lexicon.fuzzy
            self.bends[0] |= bends
            for c in t.rstrip("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.stem.append(None)
                    self.bends.append(False)
                node = self.children[node][c]
                self.bends[node] |= bends
            (self.stem if t.endswith("*") else self.term)[node] = t
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.stems: list[str | None] = []
        self.dead = self._state(set())
        self.start = self._state({(0, 0)})

    def _state(self, found: set) -> int:
        for node, e in list(found):
            if e == 0:
                found |= {(k, 1) for k in self.children[node].values() if self.bends[k]}
        key = frozenset(x for x in found if x[1] <= 0 or (x[0], 0) not in found)
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            ends = sorted((e, self.term[n]) for n, e in key if self.term[n] and (e == 0 or e == 1 and self.term[n] in self.fuzzy))
            self.accepts.append((ends[0][1], ends[0][0]) if ends else None)
            self.stems.append(next((self.stem[n] for n, e in key if e == 0 and self.stem[n]), None))
        return self.states[key]

    def _move(self, s: int, c: str) -> int:
        found = set()
        for node, e in self.sets[s]:
            if e < 0:
                swapped = self.children[self.children[node][c]].get(chr(-e)) if c in self.children[node] else None
                if swapped is not None:
                    found.add((swapped, 1))
                continue
            if c in self.children[node]:
                found.add((self.children[node][c], e))
            if e == 0 and self.bends[node]:
                found.add((node, 1))  # an extra character
                found |= {(k, 1) for k in self.children[node].values() if self.bends[k]}  # another one
                if any(c in self.children[k] for x, k in self.children[node].items() if x != c and self.bends[k]):
                    found.add((node, -ord(c)))  # two that are swapped
        self.moves[s][c] = to = self._state({(n, e) for n, e in found if e == 0 or self.bends[n]})
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        """The term and the edits, or None; equal terms go before stems, stems before edits."""
        s, stem, moves, dead = self.start, None, self.moves, self.dead
        for c in word:
            t = moves[s].get(c)
            s = self._move(s, c) if t is None else t
            if s == dead:
                break
            stem = self.stems[s] or stem
        found = self.accepts[s]
        return found if found and not (found[1] and stem) else (stem, 0) if stem else None


class Reader:
    """Finds the hits of texts; words seen before cost a set lookup."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.automaton = lexicon, Automaton(lexicon)
        self.seen: set[str] = set()
        self.found: dict[str, tuple[str, int]] = {}

    def hits(self, text: str) -> tuple[int, list[tuple[str, int, bool, bool]]]:
        """Words of the text, and of each hit: term, edits, quoted, addressed."""
        text = text.lower()
        words = WORD.findall(text)
        broken = [(m.start(), m.end(), "".join(WORD.findall(m[0]))) for m in BROKEN.finditer(text)]
        joined = [w for _, _, w in broken]
        new = {*words, *joined} - self.seen
        if len(self.seen) > SEEN_WORDS:
            self.seen.clear()
            self.found.clear()
            new = {*words, *joined}
        for w in new:
            if m := self.automaton.match(w):
                self.found[w] = m
        self.seen |= new
        if self.found.keys().isdisjoint(words) and self.found.keys().isdisjoint(joined):
            return len(words), []
        hits = [(m.start(), m.end(), *self.found[m[0]]) for m in WORD.finditer(text) if m[0] in self.found]
        # a broken word is a hit if none of its parts is one by itself
        whole = [(at, end, self.found[w][0], 1) for at, end, w in broken if w in self.found and self.found.keys().isdisjoint(WORD.findall(text[at:end]))]
        return len(words), [(term, edits, *self._context(text, at, end)) for at, end, term, edits in sorted(hits + whole)]

    @staticmethod
    def _context(text: str, start: int, end: int) -> tuple[bool, bool]:
        left, right = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
        near = WORD.findall(left)[-5:] + WORD.findall(right)[:5]
        marks = [c for c in left if c in QUOTES]
        inside = bool(marks) and (marks[-1] in "“„«" or marks[-1] == '"' and len(marks) % 2 == 1) and any(c in QUOTES for c in right)
        inside |= left[-1:] in SINGLE and right[:1] in SINGLE and bool(left and right)
        addressed = not ADDRESS.isdisjoint(near)
        return inside or not REPORTING.isdisjoint(near) and not addressed, addressed

    def features(self, text: str) -> list[float]:
        words, hits = self.hits(text)
        return features(self.lexicon, words, hits)


def features(lexicon: Lexicon, words: int, hits: list) -> list[float]:
    """Abuse by kind of hit and window: meant hits, of these the edited and the addressed, quoted hits, the strongest meant one, and the density of meant ones."""
    meant = fuzzy = quoted = addressed = top = 0.0
    n = 0
    for term, edits, q, a in hits:
        w = lexicon.weights[term]
        if q:
            quoted += w
            continue
        fuzzy += w * (edits > 0)
        w *= EDITED if edits else 1.0
        meant += w
        addressed += w * a
        top = max(top, w)
        n += 1
    return [math.log1p(meant), math.log1p(fuzzy), math.log1p(quoted), math.log1p(addressed), top, 10 * n / max(10, words)]


def _term_counts(rows: DataFrame) -> DataFrame:
    """Per word and stem: toxic texts, other texts, and distinct left neighbours in toxic texts (up to 8 a task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad, lefts = Counter(), Counter(), {}
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                words = WORD.findall(text.lower())
                keys = dict(zip(words, ["", *words]))
                stems = {w[:k] + "*": left for w, left in keys.items() for k in STEMS if len(w) > k}
                (bad if y else good).update(list(keys | stems))
                if y:
                    for key, left in (keys | stems).items():
                        known = lefts.setdefault(key, set())
                        if len(known) < 8:
                            known.add(left)
        keys = list(lefts)  # a term that no toxic text holds can't be one
        for at in range(0, len(keys), 20_000):
            part = keys[at : at + 20_000]
            yield pa.RecordBatch.from_pydict({"term": pa.array(part, pa.string()), "p": pa.array([bad[k] for k in part], pa.int64()), "lefts": pa.array([list(lefts[k]) for k in part], pa.list_(pa.string())), "n": pa.array([0] * len(part), pa.int64())})
        keys = list(good)
        for at in range(0, len(keys), 20_000):
            part = keys[at : at + 20_000]
            yield pa.RecordBatch.from_pydict({"term": pa.array(part, pa.string()), "p": pa.array([0] * len(part), pa.int64()), "lefts": pa.array([[]] * len(part), pa.list_(pa.string())), "n": pa.array([good[k] for k in part], pa.int64())})

    parts = rows.mapInArrow(run, "term string, p long, lefts array<string>, n long")
    return parts.groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.size("lefts") > 0, F.col("lefts")))))).alias("lefts"))


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """The lexicon and the weights, from at most ``max_train`` labelled rows (``labelled.training_rows``).

    If they lack a class, nothing can be learned: the lexicon is empty and every
    text scores about 0, so that none is rejected. Rows that repeat an id's text count
    each; equal strengths are ordered by term. Every term that passes the tests is
    in the lexicon: their number follows from the sample's texts.
    """
    small_batches(spark)
    rows = training_rows(docs, labels, "toxic", max_train).cache()
    try:
        total = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
        pos, neg = total.get(1, 0), total.get(0, 0)
        if not pos or not neg:
            return Model(Lexicon({}, frozenset()), (*[0.0] * 6, -30.0))
        share = pos / (pos + neg)
        counts = _term_counts(rows)
        part, q = F.col("p") / (F.col("p") + F.col("n")), F.lit(share)
        g2 = 2 * (F.col("p") * F.log(part / q) + F.when(F.col("n") > 0, F.col("n") * F.log((1 - part) / (1 - q))).otherwise(0.0))
        strong = counts.where(F.col("p") > 0).withColumn("g2", g2).where((F.col("g2") >= MIN_G2) & (part >= MIN_SHARE) & (F.col("lefts") >= MIN_LEFTS))
        found = strong.orderBy("term").select("term", "p", "n").collect()
        weights = {r.term: min(6.0, math.log((r.p + 0.5) / (r.n + 0.5) * neg / pos)) for r in found}
        against = {r.term for r in counts.where(F.col("term").isin(list(SEED_TERMS)) & (part < MIN_SHARE)).collect()}
        weights = {t: 3.0 for t in SEED_TERMS if t not in against} | weights
        lexicon = Lexicon(weights, frozenset(t for t in weights if len(t) >= FUZZY_LENGTH and not t.endswith("*")))

        def each(lexicon: Lexicon, schema: str, found: Callable[[Reader, str, int], list]) -> DataFrame:
            """The pairs that ``found`` lists for each row."""
            shared = spark.sparkContext.broadcast(lexicon)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                reader = Reader(shared.value)
                for batch in batches:
                    got = [x for t, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()) for x in found(reader, t, y)]
                    yield pa.RecordBatch.from_pylist([dict(zip("yx", x)) for x in got], schema=pa.schema([("y", pa.int32()), ("x", pa.string() if "string" in schema else pa.list_(pa.float64()))]))

            return rows.mapInArrow(run, schema)

        near = each(lexicon, "y int, x string", lambda reader, t, y: [(y, x) for x in {h[0] for h in reader.hits(t)[1] if h[1]}])
        edits = near.groupBy("x").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
        vague = {r.x for r in edits.where("n > p + 1").collect()}  # terms whose neighbours are clean words
        lexicon = replace(lexicon, fuzzy=lexicon.fuzzy - vague)
        seen = each(lexicon, "y int, x array<double>", lambda reader, t, y: [(y, reader.features(t))]).collect()
        return Model(lexicon, tuple(fit_logistic(np.array([r.x for r in seen]), np.array([r.y for r in seen], dtype=float), l2=0.1)))
    finally:
        rows.unpersist()


def score(spark: SparkSession, text: Column, model: Model) -> Column:
    """``double`` from 0 to 1 for each whole text; null and empty texts score as texts without a hit."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader, w = Reader(shared.value.lexicon), np.array(shared.value.coefficients)
        for batch in batches:
            x = np.array([reader.features(t or "") for t in batch.to_pylist()]).reshape(len(batch), len(w) - 1)
            yield pa.array(1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))))

    return run(text)


def scored(spark: SparkSession, docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 at the threshold or above), replacing such columns.

    Every row is scored by its own text, repeats alike; null and empty texts score
    as texts without a hit. Other columns stay, an empty table stays empty.
    """
    kept = docs.drop("score", "predicted")
    return kept.withColumn("score", score(spark, F.col("text").cast("string"), model)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
