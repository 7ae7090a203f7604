"""Secrets in texts: fixed patterns, and strings that a Markov model finds random.

Two first-order character models, of random strings and of ordinary
identifiers, are trained from labelled samples; a run of 12 or more token
characters, or what fixed patterns leave of one, is a span of kind ``markov`` if
its log-likelihood ratio is high for its length.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.workspace import small_batches

#: Kinds in the order in which spans of equal start are listed.
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # as [0-9a-f]+ with shorter matches dropped: both start where a run starts
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{20,}")
SHORT = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
WORDS = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20
#: A random run: nats in all (so many for runs of ``FULL`` characters, fewer in proportion for shorter ones), nats a character, and distinct characters.
MIN_LLR, MIN_MEAN, MIN_DISTINCT, FULL, LEAST = 12.0, 0.3, 8, 20, 12
#: Characters of samples that are counted at once.
COUNTED = 1 << 20
SPAN = "array<struct<kind:string,start:int,end:int,value:int>>"
_PLACE = np.full(128, -1, dtype=np.int64)
_PLACE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratio by (character before, character); the last row is the start."""

    ratio: np.ndarray

    def llr(self, run: str) -> tuple[float, int]:
        at = _PLACE[np.frombuffer(run.encode("ascii"), dtype=np.uint8)]
        return float(self.ratio[np.concatenate([[len(ALPHABET)], at[:-1]]), at].sum()), len(np.unique(at))

    def random(self, run: str) -> bool:
        nats, distinct = self.llr(run)
        if run == run.upper():  # capitals alone are no sign: words are shouted too
            nats = min(nats, self.llr(run.lower())[0])
        return nats >= MIN_LLR * min(len(run), FULL) / FULL and nats >= MIN_MEAN * len(run) and distinct >= MIN_DISTINCT


def transitions(samples: list[str]) -> np.ndarray:
    """Counts of (character before, character) with the start as the last row."""
    n, joined = len(ALPHABET), "".join(samples)
    at = _PLACE[np.frombuffer(joined.encode("ascii"), dtype=np.uint8)]
    before = np.empty_like(at)
    before[1:] = at[:-1]
    starts = np.cumsum([0, *map(len, samples)])
    before[starts[starts < len(at)]] = n
    return np.bincount(before * n + at, minlength=(n + 1) * n).reshape(n + 1, n).astype(float)


def fit(random: np.ndarray, ordinary: np.ndarray, smoothing: float = 0.5) -> Model:
    """From transition counts of both classes."""
    a, b = random + smoothing, ordinary + smoothing
    return Model(np.log(a / a.sum(axis=1, keepdims=True)) - np.log(b / b.sum(axis=1, keepdims=True)))


def identifiers(words: list[str]) -> list[str]:
    """Names as programs and paths have them, from every three words: snake case, camel case and a path."""
    three = zip(words[::3], words[1::3], words[2::3])
    return [x for a, b, c in three for x in (f"{a}_{b}_{c}".lower(), a.lower() + b.title() + c.title(), f"/{a}/{b}.{c}")]


def learn(spark: SparkSession, docs: DataFrame) -> Model:
    """Both models from all documents.

    Random strings: the values that the fixed patterns find there, and digests of
    the documents' ids in hexadecimal, base 64 and its letters and digits.
    Ordinary ones: all other runs of six token characters or more, and identifiers
    made of neighbouring words (``identifiers``). Only summed
    transition counts (two small matrices) reach the driver.
    """
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    digest = F.sha2(F.col("doc_id").cast("string"), 512)
    short, long = F.base64(F.unhex(F.sha2(F.col("doc_id").cast("string"), 256))), F.base64(F.unhex(digest))
    made = F.array(F.substring(digest, 1, 40), F.substring(long, 1, 40), F.substring(F.regexp_replace(short, "[+/=]", ""), 1, 24), F.upper(F.substring(F.regexp_replace(long, "[+/=]", ""), 1, 20)))
    made = F.when(F.col("doc_id").isNotNull(), made).otherwise(F.array().cast("array<string>"))  # nothing to digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(ALPHABET) + 1, len(ALPHABET)))
        for batch in batches:
            samples, held = ([], []), 0
            for text, made in zip(batch.column("text"), batch.column("made")):
                text = text.as_py()
                base = base_spans(text)
                samples[1].extend(made.as_py() + [text[v:e] for _, _, e, v in base])
                samples[0].extend(identifiers(re.findall("[A-Za-z]+", text)))
                samples[0].extend(m[0] for m in apart(WORDS.finditer(text), base))
                held += len(text)
                if held >= COUNTED:
                    total += [transitions(x) for x in samples]
                    samples, held = ([], []), 0
            total += [transitions(x) for x in samples]
        y, i, j = total.nonzero()
        yield pa.RecordBatch.from_pydict({"y": pa.array(y, pa.int32()), "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "c": pa.array(total[y, i, j], pa.float64())})

    counts = np.zeros((2, len(ALPHABET) + 1, len(ALPHABET)))
    for r in rows.select("text", made.alias("made")).mapInArrow(run, "y int, i int, j int, c double").groupBy("y", "i", "j").agg(F.sum("c").alias("c")).collect():
        counts[r.y, r.i, r.j] = r.c
    return fit(counts[1], counts[0])


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the value) of the fixed patterns, in code points."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    for run in RUN.finditer(text):
        at = run.start()
        if "AKIA" in run[0]:
            found += [("access", at + m.start(), at + m.end(), at + m.start()) for m in ACCESS.finditer(run[0]) if m.end() - m.start() >= MIN_ACCESS]
        found += [("hex", at + m.start(), at + m.end(), at + m.start()) for m in HEX.finditer(run[0])]
    return found


def apart(runs: Iterator[re.Match], found: list[tuple[str, int, int, int]]) -> Iterator[re.Match]:
    """The runs that no span overlaps: each looks up the furthest end of the spans that start before its own end."""
    if not found:
        yield from runs
        return
    starts, ends = zip(*sorted((s, e) for _, s, e, _ in found))
    furthest = list(accumulate(ends, max))
    for m in runs:
        k = bisect_left(starts, m.end())
        if not k or furthest[k - 1] <= m.start():
            yield m


def left_over(runs: Iterator[re.Match], found: list[tuple[str, int, int, int]]) -> Iterator[tuple[int, int]]:
    """Start and end of the runs, and of what spans leave of them, without separators at the cuts; of ``LEAST`` characters or more."""
    spans, k = sorted((s, e) for _, s, e, _ in found), 0
    for m in runs:
        at, end, cut = m.start(), m.end(), False
        while k and spans[k - 1][1] > at:
            k -= 1
        parts = []
        while k < len(spans) and spans[k][0] < end:
            start, stop = spans[k]
            if stop > at:
                parts.append((at, max(start, at)))
                at, cut = max(stop, at), True
            k += 1
        parts.append((at, end))
        for a, b in parts:
            if cut:  # a cut part sheds its separators
                while a < b and m.string[a] in "+/_.=-":
                    a += 1
                while a < b and m.string[b - 1] in "+/_.=-":
                    b -= 1
            if b - a >= LEAST:
                yield a, b


def find(text: str, model: Model) -> list[tuple[str, int, int, int]]:
    """All spans by start, then kind; random runs are added, and random parts of runs that fixed patterns' spans leave."""
    found = base_spans(text)
    added = [("markov", a, b, a) for a, b in left_over(SHORT.finditer(text), found) if model.random(text[a:b])]
    return sorted(found + added, key=lambda x: (x[1], KINDS.index(x[0])))


def spans(spark: SparkSession, text: Column, model: Model) -> Column:
    """Spans of each whole text as ``array<struct<kind, start, end, value>>``; none in null and empty texts."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.int32())]))

    @F.arrow_udf(SPAN)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([[dict(zip(("kind", "start", "end", "value"), x)) for x in find(t.as_py() or "", shared.value)] for t in batch], kind)

    return run(text)


def redact(text: str, found: list, mark: str = "[SECRET]") -> str:
    """The text with the values of its spans replaced; what overlaps is replaced once."""
    out, at = [], 0
    for value, end in sorted((x["value"], x["end"]) for x in found):
        if end > at:
            out += [text[at:value], mark] if value >= at else []
            at = end
    return "".join([*out, text[at:]])


def redacted(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with secrets' values replaced in ``text``; a null text stays null."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([redact(x, [{"value": v, "end": e} for _, _, e, v in find(x, shared.value)]) if (x := t.as_py()) else x for t in batch], pa.string())

    return docs.withColumn("text", run(F.col("text").cast("string")))


def scanned(spark: SparkSession, docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with ``secret_spans``, replacing a column of that name; the model is learned from ``docs`` unless given."""
    return docs.drop("secret_spans").withColumn("secret_spans", spans(spark, F.col("text").cast("string"), model or learn(spark, docs)))
