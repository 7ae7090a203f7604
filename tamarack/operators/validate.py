"""Checks of loaded tables, each a row ``table_name, check_name, expected, actual, passed``, and their roll-up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.functions.config import Rules


def key_columns(df: DataFrame, rules: Rules = Rules()) -> list[str]:
    """Columns whose names end with a checked key's name."""
    return [c for c in df.columns if c.lower().endswith(rules.checked_keys)]


def _check(df: DataFrame, table: str, name: str, expected, actual, passed) -> DataFrame:
    return df.select(F.lit(table).alias("table_name"), F.lit(name).alias("check_name"), F.lit(expected).cast("string").alias("expected"), actual.cast("string").alias("actual"), passed.alias("passed"))


def check_row_count(df: DataFrame, table: str, expected: int) -> DataFrame:
    n = df.agg(F.count("*").alias("n"))
    return _check(n, table, "row_count", expected, F.col("n"), F.col("n") == expected)


def check_columns(df: DataFrame, table: str, expected: list[str]) -> DataFrame:
    """No expected column is missing; case does not matter."""
    have = {c.lower() for c in df.columns}
    missing = sorted(c for c in expected if c.lower() not in have)
    one = df.sparkSession.range(1)
    return _check(one, table, "column_existence", "", F.lit(",".join(missing)), F.lit(not missing))


def check_not_empty(df: DataFrame, table: str) -> DataFrame:
    """Some row holds a value that is not null."""
    some = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNotNull() for c in df.columns], F.lit(False))
    n = df.where(some).limit(1).agg(F.count("*").alias("n"))
    return _check(n, table, "data_not_empty", "true", (F.col("n") > 0), F.col("n") > 0)


def check_not_null(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """No null or blank in each of the columns: one pass for all of them."""
    if not columns:
        return df.sparkSession.createDataFrame([], "table_name string, check_name string, expected string, actual string, passed boolean")
    blank = [F.coalesce(F.sum(F.when(F.col(f"`{c}`").isNull() | (F.col(f"`{c}`").cast("string") == ""), 1)), F.lit(0)).alias(f"_{i}") for i, c in enumerate(columns)]
    cells = F.array(*(F.struct(F.lit(f"not_null_{c}").alias("check_name"), F.col(f"_{i}").alias("n")) for i, c in enumerate(columns)))
    rows = df.agg(*blank).select(F.explode(cells).alias("x"))
    return rows.select(F.lit(table).alias("table_name"), "x.check_name", F.lit("0").alias("expected"), F.col("x.n").cast("string").alias("actual"), (F.col("x.n") == 0).alias("passed"))


def validate_table(df: DataFrame, table: str, expected_rows: int, expected_columns: list[str], rules: Rules = Rules()) -> DataFrame:
    """All checks of one table, from one aggregate over it."""
    keys = key_columns(df, rules)
    cells = {c: F.col(f"`{c}`") for c in df.columns}
    some = reduce(lambda a, b: a | b, [c.isNotNull() for c in cells.values()], F.lit(False))
    blanks = [F.count_if(cells[k].isNull() | (cells[k].cast("string") == "")).alias(f"_{i}") for i, k in enumerate(keys)]
    one = df.agg(F.count("*").alias("_n"), F.count_if(some).alias("_some"), *blanks)
    have = {c.lower() for c in df.columns}
    missing = ",".join(sorted(c for c in expected_columns if c.lower() not in have))

    def check(name: str, expected, actual, passed):
        return F.struct(F.lit(name).alias("check_name"), F.lit(expected).cast("string").alias("expected"), actual.cast("string").alias("actual"), passed.alias("passed"))

    checks = [
        check("row_count", expected_rows, F.col("_n"), F.col("_n") == expected_rows),
        check("column_existence", "", F.lit(missing), F.lit(not missing)),
        check("data_not_empty", "true", F.col("_some") > 0, F.col("_some") > 0),
        *(check(f"not_null_{k}", "0", F.col(f"_{i}"), F.col(f"_{i}") == 0) for i, k in enumerate(keys)),
    ]
    return one.select(F.explode(F.array(*checks)).alias("x")).select(F.lit(table).alias("table_name"), "x.*")


def validation_rollup(checks: DataFrame, failed_loads: int = 0) -> DataFrame:
    """One row: checks, passed, failed, tables that pass all, and the status.

    PASSED without failed checks, PARTIAL with some passed, else FAILED; no checks
    at all or a failed load are FAILED.
    """
    tables = checks.groupBy("table_name").agg(F.bool_and("passed").alias("ok"), F.count("*").alias("n"), F.sum(F.col("passed").cast("int")).alias("p"))
    out = tables.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_checks"), F.coalesce(F.sum("p"), F.lit(0)).alias("passed_checks"), F.coalesce(F.sum(F.col("ok").cast("int")), F.lit(0)).alias("tables_passed"))
    failed = F.col("total_checks") - F.col("passed_checks")
    status = F.when((F.col("total_checks") == 0) | F.lit(failed_loads > 0), "FAILED").when(failed == 0, "PASSED").when(F.col("passed_checks") > 0, "PARTIAL").otherwise("FAILED")
    return out.withColumn("failed_checks", failed).withColumn("status", status)
