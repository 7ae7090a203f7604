"""Referential subsets: anchor rows, the rows of other tables that follow them, and key integrity."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions.config import Rules
from tamarack.operators.ranks import first_rows
from tamarack.sources.tables import month_column

#: Rows of a key set that is broadcast at most; larger ones join by a shuffle.
BROADCAST_KEYS = 1_000_000


def identifier(name: str) -> str:
    """The name, if it consists of word characters only."""
    if not re.fullmatch(r"\w+", name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def resolve(df: DataFrame, name: str) -> str:
    """The column's name as the table spells it."""
    found = [c for c in df.columns if c.lower() == identifier(name).lower()]
    if not found:
        raise ValueError(f"no column {name!r}")
    return found[0]


def date_column(df: DataFrame, rules: Rules = Rules()) -> str | None:
    """The first of the rules' date columns that the table has, whatever its case."""
    have = {c.lower(): c for c in df.columns}
    return next((have[c.lower()] for c in rules.date_columns if c.lower() in have), None)


def date_range(df: DataFrame, column: str | None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows with start <= column <= end; a bound that is not given does not filter, nor does a missing column.

    A table parted by month (``tables.lay_out``) is filtered by its months as well, so
    that only their parts are read.
    """
    if column is None:
        return df
    value = F.col(resolve(df, column))
    month = next((c for c in df.columns if c.lower() == month_column(column).lower()), None)
    if month is not None:
        for bound, within in ((start, F.col(month).__ge__), (end, F.col(month).__le__)):
            if bound and re.match(r"\d{4}-\d{2}", bound):
                df = df.where(within(int(bound[:4]) * 100 + int(bound[5:7])))
    if start:
        df = df.where(value >= F.lit(start).cast(df.schema[resolve(df, column)].dataType))
    if end:
        df = df.where(value <= F.lit(end).cast(df.schema[resolve(df, column)].dataType))
    return df


def fill_blanks(df: DataFrame) -> DataFrame:
    """Null strings as empty ones; other types stay null."""
    return df.fillna("")


def anchor_subset(df: DataFrame, keys: list[str], n: int | None, start: str | None = None, end: str | None = None, column: str | None = None, rules: Rules = Rules()) -> DataFrame:
    """The first ``n`` rows in key order within the date range (all without ``n``), whatever their number."""
    found = date_range(df, column or date_column(df, rules), start, end)
    return first_rows(found, [resolve(df, k) for k in keys], n) if n is not None else found


def independent_sample(df: DataFrame, keys: list[str], n: int, seed: int | None = None) -> DataFrame:
    """The first ``n`` rows in key order, or in an order drawn from ``seed``: by the MD5 of seed and keys as text, null as nothing."""
    names = [resolve(df, k) for k in keys]
    if seed is None:
        return first_rows(df, names, n)
    drawn = "_drawn"
    while drawn in {c.lower() for c in df.columns}:
        drawn += "_"
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in names))
    return first_rows(df.withColumn(drawn, F.md5(text)), [drawn, *names], n).drop(drawn)


def referential_subset(child: DataFrame, to_col: str, parent: DataFrame, from_col: str, key_count: int | None = None, buckets: int | None = None) -> DataFrame:
    """All child rows whose ``to_col`` is among the parent's ``from_col``; null keys match nothing.

    The distinct keys are broadcast if ``key_count`` says that they are at most
    ``BROADCAST_KEYS``; otherwise Spark chooses. Where the child lies in so many
    ``buckets`` by ``to_col``, more keys are dealt out like it, and its rows stay where they are.
    """
    child_key = resolve(child, to_col)
    keys = parent.select(F.col(resolve(parent, from_col)).alias("_key")).where("_key is not null")
    if key_count is not None and key_count <= BROADCAST_KEYS:
        keys = F.broadcast(keys.distinct())
    elif buckets and keys.schema[0].dataType == child.schema[child_key].dataType:  # else their hashes differ
        keys = keys.repartition(buckets, "_key").distinct()
    else:
        keys = keys.distinct()
    return child.join(keys, child[child_key] == keys["_key"], "left_semi")


@dataclass(frozen=True)
class Link:
    """``to_table.to_col`` refers to ``table.col``, or the other way round."""

    table: str
    col: str
    to_table: str
    to_col: str

    def between(self, a: str, b: str) -> tuple[str, str] | None:
        """The columns of a and b, if the link joins them."""
        if (self.table.lower(), self.to_table.lower()) == (a.lower(), b.lower()):
            return self.col, self.to_col
        if (self.to_table.lower(), self.table.lower()) == (a.lower(), b.lower()):
            return self.to_col, self.col
        return None


@dataclass(frozen=True)
class Plan:
    """Which table leads, the keys that order each table, and the links in order of preference."""

    anchor: str | None
    keys: dict[str, list[str]]
    links: tuple[Link, ...] = ()
    date_column: str | None = None
    #: Column and number of buckets of tables that are laid out so (``tables.bucketing``).
    buckets: dict[str, tuple[str, int]] | None = None


def join_path(links: tuple[Link, ...], a: str, b: str) -> tuple[str, str] | None:
    """The columns of the first link between two tables, in either direction."""
    return next((cols for link in links if (cols := link.between(a, b))), None)


def subset(dfs: dict[str, DataFrame], plan: Plan, n: int | None, start: str | None = None, end: str | None = None, max_hops: int = 1, fill_blank_strings: bool = False, references: tuple = ()) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The subset of each table and how it was chosen.

    The anchor is taken first and kept (``cache``), so that every child follows
    the same rows. Tables within ``max_hops`` links follow by semi-joins, others
    are the first ``n`` rows in key order. Child rows are not limited.
    ``references`` (``closure.Reference``) close the result: rows that chosen rows
    refer to are added, over self links and cycles too.
    """
    out: dict[str, DataFrame] = {}
    how: dict[str, str] = {}
    names = list(dfs)
    if plan.anchor is not None:
        lead = next(t for t in names if t.lower() == plan.anchor.lower())
        out[lead] = anchor_subset(dfs[lead], plan.keys[lead], n, start, end, plan.date_column).cache()
        how[lead] = "anchor_subset"
        edge, counts = [lead], {lead: n}
        for _ in range(max_hops):
            grown = []
            for parent in edge:
                for t in names:
                    if t not in out and (cols := join_path(plan.links, parent, t)):
                        column, n_buckets = (plan.buckets or {}).get(t, ("", None))
                        dealt = n_buckets if column.lower() == cols[1].lower() else None
                        out[t], how[t] = referential_subset(dfs[t], cols[1], out[parent], cols[0], counts.get(parent), dealt), "referential_subset"
                        grown.append(t)
            edge = grown
    for t in names:
        if t not in out:
            out[t] = independent_sample(dfs[t], plan.keys[t], n) if n is not None else dfs[t]
            how[t] = "independent_sample"
    if references:
        from tamarack.operators.closure import close

        out = close(out, dfs, references, plan.keys)
    if fill_blank_strings:
        out = {t: fill_blanks(df) for t, df in out.items()}
    return {t: out[t] for t in names}, how


def extraction_summary(subsets: dict[str, DataFrame], how: dict[str, str]) -> DataFrame:
    """``table_name, query_type, row_count, column_count, warning`` of each table."""
    rows = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(t).alias("table_name"), F.lit(how[t]).alias("query_type"), "row_count", F.lit(len(df.columns)).alias("column_count"))
        for t, df in subsets.items()
    ]
    return _warned(reduce(DataFrame.unionByName, rows))


def _warned(rows: DataFrame) -> DataFrame:
    return rows.withColumn("warning", F.when(F.col("row_count") == 0, F.concat(F.lit("no rows extracted from "), "table_name")))


def extraction_rows(spark: SparkSession, counted: list[tuple[str, str, int, int]]) -> DataFrame:
    """``extraction_summary`` of tables whose rows are counted already."""
    return _warned(spark.createDataFrame(counted, "table_name string, query_type string, row_count long, column_count int"))


def _is_empty(value: Column, zero: bool) -> Column:
    blank = value.isNull() | (value.cast("string") == "")
    return blank | (value.cast("string").rlike(r"^[+-]?0+(\.0*)?$")) if zero else blank


def integrity_report(dfs: dict[str, DataFrame], links: list[Link], zero_is_empty: bool = False) -> DataFrame:
    """Distinct keys, their overlap and the orphans of each link.

    Keys are compared as text; null and blank ones are left out, and with
    ``zero_is_empty`` numeric zeros too. ``passed``: no orphans on the second side
    or any overlap; ``strict_passed``: no orphans there. Each table is read once
    for all its keys and one shuffle brings equal keys together.
    """
    names = {t.lower(): t for t in dfs}
    uses: dict[str, list[tuple[int, int, str]]] = {}
    for i, link in enumerate(links):
        uses.setdefault(names[link.table.lower()], []).append((i, 0, link.col))
        uses.setdefault(names[link.to_table.lower()], []).append((i, 1, link.to_col))
    sides = []
    for t, cols in uses.items():
        df = dfs[t]
        entries = []
        for i, side, col in cols:
            c = resolve(df, col)
            numeric = df.schema[c].dataType.typeName() not in ("string", "char", "varchar")
            key = F.when(~_is_empty(F.col(c), zero_is_empty and numeric), F.col(c).cast("string"))
            entries.append(F.struct(F.lit(i).alias("rel"), F.lit(side).alias("side"), key.alias("key")))
        sides.append(df.select(F.explode(F.array(*entries)).alias("x")).select("x.rel", "x.side", "x.key").where("key is not null"))
    by_key = reduce(DataFrame.unionByName, sides).groupBy("rel", "key").agg(F.max(F.when(F.col("side") == 0, 1).otherwise(0)).alias("a"), F.max("side").alias("b"))
    counts = by_key.groupBy("rel").agg(F.sum("a").alias("keys_in_t1"), F.sum("b").alias("keys_in_t2"), F.sum(F.col("a") * F.col("b")).alias("overlap"))
    spark = next(iter(dfs.values())).sparkSession
    listed = spark.createDataFrame([(i, x.table, x.col, x.to_table, x.to_col) for i, x in enumerate(links)], "rel int, table_1 string, column_1 string, table_2 string, column_2 string")
    out = listed.join(counts, "rel", "left").fillna(0, ["keys_in_t1", "keys_in_t2", "overlap"])
    return out.withColumns(
        {"orphans_in_t1": F.col("keys_in_t1") - F.col("overlap"), "orphans_in_t2": F.col("keys_in_t2") - F.col("overlap")}
    ).withColumns({"passed": (F.col("orphans_in_t2") == 0) | (F.col("overlap") > 0), "strict_passed": F.col("orphans_in_t2") == 0}).drop("rel")


def integrity_summary(report: DataFrame) -> DataFrame:
    """One row: ``status`` passed or warnings, checks, and checks passed."""
    return report.agg(F.count("*").alias("checks"), F.coalesce(F.sum(F.col("passed").cast("int")), F.lit(0)).alias("checks_passed")).withColumn("status", F.when(F.col("checks") == F.col("checks_passed"), "passed").otherwise("warnings"))
