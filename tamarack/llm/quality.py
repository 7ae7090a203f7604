"""Quality by a sparse rule ensemble: tree paths as rules, lasso weights, Spark column expressions.

Statistics of each whole text are a struct column; shallow trees on labelled
rows give conjunctive rules over them; a lasso logistic model keeps few of the
rules; and the score is one column expression of comparisons and weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.labelled import MAX_TRAIN, training_rows
from tamarack.llm.textbuf import slices, span_hashes, utf8, word_spans
from tamarack.llm.workspace import small_batches

STATISTICS = ("log_bytes", "log_words", "word_bytes", "upper", "digit", "symbol", "stop", "newline", "other_bytes", "bar", "distinct", "repeat", "common", "symbol_end")
TREES, DEPTH, REGULARISATION = 12, 3, 0.002


def _is(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.uint8)
    out[list(chars)] = 1
    return out


_UPPER, _DIGIT, _STOP, _LINE, _BAR = _is(bytes(range(65, 91))), _is(b"0123456789"), _is(b".,;:?'"), _is(b"\n"), _is(b"|")
_SYMBOL, _OTHER = _is(b"!#$%&*+<=>@^_`{|}~\\/[]()\"-"), _is(bytes(range(128, 256)))


def measure(column: pa.Array) -> np.ndarray:
    """Statistics of the rows, one line each; shares are of bytes or words, all 0 for an empty text."""
    buf, off = utf8(column)
    out = np.zeros((len(column), len(STATISTICS)))
    for first, last in slices(off):
        part, rows = buf[off[first] : off[last]], off[first : last + 1] - off[first]
        if not len(part):
            continue
        n = np.maximum(np.diff(rows), 1)
        full = np.diff(rows) > 0

        def share(table: np.ndarray) -> np.ndarray:
            got = np.zeros(len(n))
            got[full] = np.add.reduceat(table[part], rows[:-1][full], dtype=np.int64)
            return got / n

        starts, ends, row = word_spans(part, rows)
        hashes = span_hashes(part, starts, ends)
        bounds = np.searchsorted(row, np.arange(last - first + 1))
        words = np.diff(bounds)
        w = np.maximum(words, 1)
        distinct, common = np.zeros(len(n)), np.zeros(len(n))
        for k in np.flatnonzero(words):
            times = np.unique(hashes[bounds[k] : bounds[k + 1]], return_counts=True)[1]
            distinct[k], common[k] = len(times), times.max()
        same = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
        lead = lambda flags, at: np.bincount(at, weights=flags, minlength=len(n)) / w
        out[first:last] = np.column_stack(
            [np.log1p(np.diff(rows)), np.log1p(words), np.bincount(row, weights=ends - starts, minlength=len(n)) / w]
            + [share(t) for t in (_UPPER, _DIGIT, _SYMBOL, _STOP, _LINE, _OTHER, _BAR)]
            + [distinct / w, lead(same, row[1:]), common / w, lead(_SYMBOL[part[ends - 1]], row)]
        )
    return out


def statistics(text: Column) -> Column:
    """The statistics of whole texts as a struct of doubles."""

    @F.arrow_udf("struct<" + ",".join(f"{s}:double" for s in STATISTICS) + ">")
    def run(texts: pa.Array) -> pa.Array:
        got = measure(texts)
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(got[:, k])) for k in range(len(STATISTICS))], names=list(STATISTICS))

    return run(text)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above, bound)."""

    terms: tuple[tuple[int, bool, float], ...]

    def column(self, stats: Column) -> Column:
        return reduce(lambda a, b: a & b, [stats[STATISTICS[k]] > bound if above else stats[STATISTICS[k]] <= bound for k, above, bound in self.terms])


@dataclass(frozen=True)
class Model:
    rules: tuple[tuple[Rule, float], ...]
    constant: float

    def column(self, stats: Column) -> Column:
        """The score as a Spark expression over the statistics."""
        z = reduce(lambda a, b: a + b, [F.when(r.column(stats), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.rules], F.lit(self.constant))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


_BRANCH = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)")


def rules(debug: str) -> list[Rule]:
    """All paths from a root to a node of the trees in a forest's printed form."""
    found, path = [], []
    for line in debug.splitlines():
        if line.strip().startswith("Tree "):
            path = []
        elif m := _BRANCH.match(line):
            depth = len(m[1])
            path = [p for p in path if p[0] < depth] + [(depth, (int(m[2]), m[3] == ">", float(m[4])))]
            bounds: dict = {}
            for _, (k, above, bound) in path:
                held = bounds.get((k, above))
                bounds[k, above] = bound if held is None else max(held, bound) if above else min(held, bound)
            found.append(Rule(tuple(sorted((k, above, bound) for (k, above), bound in bounds.items()))))
    return list(dict.fromkeys(found))


def learn(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Rules and weights from at most ``max_train`` labelled rows (``labelled.training_rows``).

    If they hold one class only, the score is constant: that class' smoothed
    share, or a half without rows.
    """
    rows = training_rows(docs, labels, "quality", max_train).select(F.col("y").cast("double").alias("label"), statistics(F.col("text")).alias("s")).cache()
    try:
        total = {int(r.label): r["count"] for r in rows.groupBy("label").count().collect()}
        good, bad = total.get(1, 0), total.get(0, 0)
        constant = float(np.log((good + 1) / (bad + 1)))
        if not good or not bad:
            return Model((), constant)
        vector = array_to_vector(F.array(*(F.col("s")[k] for k in STATISTICS)))
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, maxBins=64, minInstancesPerNode=2)
        found = rules(forest.fit(rows.select("label", vector.alias("features"))).toDebugString)
        if not found:
            return Model((), constant)
        fired = array_to_vector(F.array(*(r.column(F.col("s")).cast("double") for r in found)))
        lasso = LogisticRegression(elasticNetParam=1.0, regParam=REGULARISATION, standardization=False, maxIter=60)
        fit = lasso.fit(rows.select("label", fired.alias("features")))
        weights = fit.coefficients.toArray()
        return Model(tuple((r, float(w)) for r, w in zip(found, weights) if abs(w) > 1e-6), float(fit.intercept))
    finally:
        rows.unpersist()


def scored(spark: SparkSession, docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 at the threshold or above), replacing such columns.

    Null texts score as empty ones, whose statistics are all 0.
    """
    small_batches(spark)
    kept = docs.drop("score", "predicted", "_stats").withColumn("_stats", statistics(F.col("text").cast("string")))
    return kept.withColumn("score", model.column(F.col("_stats"))).withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop("_stats")
