"""The first rows in an order, for any number of them: rank selection over range partitions.

Few rows are taken by Spark's own top-n, whose last task holds them all. More are
found in four steps, none of which gathers them in one task:

1. a bounded sample of the first order column gives a value below which about that
   many rows lie, so that the rest of the table is left out by a filter;
2. what is left is dealt out by range over as many parts as it needs, and written;
3. the rows of each part are counted, and the counts summed up in order: parts before
   the cut are taken whole, and the cut falls into one part;
4. that part's first rows complete the result.

The result is exact: where the sample's value leaves too few rows, step 2 takes all.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarack.sources.scratch import Scratch

#: Rows that one task sorts at most: up to so many are taken directly, and parts hold about as many.
TASK_ROWS = 10_000
#: Rows of the sample, on average, and by how many standard deviations its rank lies above the wanted one.
SAMPLE, MARGIN = 20_000, 6.0


def _free(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def _below(df: DataFrame, first: str, n: int, total: int, seed: int) -> DataFrame:
    """The rows up to a value of the first order column that at least ``n`` rows most likely reach."""
    fraction = min(SAMPLE / total, 1.0)
    wanted = n * fraction  # of the sample, so many lie below the cut, give or take the root of it
    rank = math.ceil(wanted + MARGIN * math.sqrt(wanted) + MARGIN)
    if rank >= total * fraction:
        return df
    drawn = df.select(F.col(f"`{first}`").alias("v")).sample(fraction=fraction, seed=seed)
    found = drawn.withColumn("k", F.row_number().over(Window.orderBy(F.col("v").asc_nulls_first()))).where(F.col("k") == rank).first()  # a bounded sample
    if found is None or found.v is None:
        return df
    return df.where(F.col(f"`{first}`").isNull() | (F.col(f"`{first}`") <= F.lit(found.v)))


def first_rows(df: DataFrame, keys: list[str], n: int, task_rows: int = TASK_ROWS, seed: int = 0) -> DataFrame:
    """The first ``n`` rows in the order of ``keys``, ascending with null first; all rows if there are fewer.

    Of rows that are equal in all keys any may be taken where the cut falls between
    them; as copies of one row they are dealt over several parts. More than
    ``task_rows`` rows are written below the shared folder and read from there, and
    only counts of parts and one value of the sample reach the driver.
    """
    order = [F.col(f"`{k}`").asc_nulls_first() for k in keys]
    if n <= task_rows:
        return df.orderBy(*order).limit(n)
    total = df.count()
    if n >= total:
        return df
    near, part, spread = _below(df, keys[0], n, total, seed), _free(df, "_part"), _free(df, "_spread")
    scratch = Scratch(df.sparkSession, "ranks")

    def dealt(rows: DataFrame, name: str) -> tuple[DataFrame, list]:
        parts = max(-(-n // task_rows) * 2, 2)
        ranged = rows.withColumn(spread, F.monotonically_increasing_id()).repartitionByRange(parts, *order, F.col(spread)).drop(spread)
        saved = scratch.save(ranged.withColumn(part, F.spark_partition_id()), name)
        return saved, sorted((r[part], r["n"]) for r in saved.groupBy(part).agg(F.count("*").alias("n")).collect())

    saved, counts = dealt(near, "near")
    if sum(c for _, c in counts) < n:
        saved, counts = dealt(df, "all")
    before = 0
    for cut, c in counts:
        if before + c >= n:
            break
        before += c
    whole = saved.where(F.col(part) < cut)
    rest = saved.where(F.col(part) == cut).orderBy(*order).limit(n - before)
    return whole.unionByName(rest).drop(part)
