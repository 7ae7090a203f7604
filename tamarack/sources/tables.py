"""Reading and writing of source tables, subsets, reports and target tables."""

from __future__ import annotations

import decimal
import json
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.sources import versions


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _literal(value) -> str:
    if isinstance(value, bool) or not isinstance(value, (int, float, decimal.Decimal, str)):
        raise ValueError(f"bounds are numbers or texts, not {type(value).__name__}")
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def jdbc_predicates(spark: SparkSession, name: str, jdbc: dict, column: str, parts: int) -> list[str]:
    """Conditions that deal a table over JDBC into ``parts`` of about as many rows, by bounds that the database measures.

    The database numbers the rows in the order of ``column`` (a number or a text, skewed
    or not) and hands over the first value of each part. Rows of one value stay together, so a
    value with more rows than a part makes a larger one. Null goes with the first part.
    """
    key = f'"{column}"'
    read = spark.read.format("jdbc").options(**jdbc)
    total = int(read.option("query", f"SELECT COUNT(*) AS n FROM {name}").load().first()[0])
    step = max(-(-total // parts), 1)
    ranked = f"SELECT k FROM (SELECT k, ROW_NUMBER() OVER () AS r FROM (SELECT {key} AS k FROM {name} WHERE {key} IS NOT NULL ORDER BY {key}) a) b WHERE r > 1 AND MOD(r - 1, {step}) = 0"
    bounds = [_literal(v) for v in dict.fromkeys(r[0] for r in read.option("query", ranked + " ORDER BY r").load().collect())]
    if not bounds:
        return ["1 = 1"]
    inner = [f"{key} >= {a} AND {key} < {b}" for a, b in zip(bounds, bounds[1:])]
    return [f"{key} IS NULL OR {key} < {bounds[0]}", *inner, f"{key} >= {bounds[-1]}"]


def read_source(spark: SparkSession, name: str, folder: str | None = None, jdbc: dict | None = None, split: tuple[str, int] | None = None) -> DataFrame:
    """A table: Parquet below ``folder``, or over JDBC with Spark's options (``partitionColumn`` splits the read), or of the catalog.

    ``split=(column, parts)`` splits a read over JDBC by measured bounds (``jdbc_predicates``).
    """
    if jdbc and split:
        options = {k: v for k, v in jdbc.items() if k != "url"}
        return spark.read.jdbc(jdbc["url"], name, predicates=jdbc_predicates(spark, name, jdbc, *split), properties=options)
    if jdbc:
        return spark.read.format("jdbc").options(dbtable=name, **jdbc).load()
    return spark.read.parquet(f"{folder}/{name}.parquet") if folder else spark.table(name)


def lay_out(df: DataFrame, name: str, key: str, buckets: int, date: str | None = None) -> DataFrame:
    """Saves a source as a table of the catalog, dealt into buckets by the key that children are followed on.

    With ``date`` it is parted by month, in a column ``<date>_month`` of integers like
    202401, by which ``subset.date_range`` leaves whole parts out. The rows go to their
    bucket's task first, so that each part has a file a bucket.
    """
    if date is not None:
        df = df.withColumn(month_column(date), F.year(date) * 100 + F.month(date))
    writer = df.repartition(buckets, F.col(f"`{key}`")).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    (writer.partitionBy(month_column(date)) if date is not None else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def month_column(date: str) -> str:
    return f"{date}_month"


def bucketing(spark: SparkSession, name: str) -> tuple[str, int] | None:
    """The one column that a table of the catalog is bucketed by, and the number of buckets."""
    found = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name in ('Num Buckets', 'Bucket Columns')").collect()}
    columns = [c.strip("`") for c in found.get("Bucket Columns", "[]").strip("[]").split(",") if c]
    return (columns[0], int(found["Num Buckets"])) if len(columns) == 1 else None


def list_tables(spark: SparkSession, folder: str | None = None, hidden: tuple[str, ...] = ("sqlite_", "_", ".")) -> DataFrame:
    """``table_name`` of the Parquet tables in a folder or of the catalog, without internal ones."""
    if folder:
        fs, where = _fs(spark, folder)
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        names = [n.removesuffix(".parquet") for n in names if n.endswith(".parquet")]
    else:
        names = [t.name for t in spark.catalog.listTables()]
    return spark.createDataFrame([(n,) for n in sorted(names) if not n.startswith(hidden)], "table_name string")


def write_csv(df: DataFrame, out: str, request: str, table: str) -> str:
    """The subset as CSV with a header below ``out/request``; nested columns go as JSON."""
    path = f"{out}/{request}/{table.upper()}_subset"
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f"`{f.name}`") for f in df.schema.fields]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)
    return path


def write_report(report: DataFrame, out: str, request: str, name: str) -> str:
    """A report of few rows as one JSON file; its schema stands beside it."""
    path = f"{out}/{request}/{name}"
    report.coalesce(1).write.mode("overwrite").json(path)
    spark = report.sparkSession
    spark.createDataFrame([(report.schema.json(),)], "schema string").coalesce(1).write.mode("overwrite").json(f"{path}_schema")
    return path


def read_report(spark: SparkSession, out: str, request: str, name: str) -> DataFrame | None:
    """A stored report, or None if there is none."""
    path = f"{out}/{request}/{name}"
    try:
        schema = spark.read.schema("schema string").json(f"{path}_schema").first().schema
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return spark.read.schema(T.StructType.fromJson(json.loads(schema))).json(path)


@dataclass(frozen=True)
class Target:
    """Where tables are loaded: Parquet below ``folder``, a ``database`` of the catalog, over JDBC with Spark's options, or a folder of ``versions``, which change together."""

    folder: str | None = None
    database: str | None = None
    jdbc: dict | None = None
    versions: str | None = None

    def __post_init__(self):
        if sum(x is not None for x in (self.folder, self.database, self.jdbc, self.versions)) != 1:
            raise ValueError("a target is a folder, a database, a JDBC connection or a folder of versions")

    def name(self, table: str) -> str:
        return f"{self.folder}/{table.lower()}" if self.folder is not None else f"{self.database}.{table.lower()}" if self.database is not None else table


def _target(target: str | Target) -> Target:
    return target if isinstance(target, Target) else Target(folder=target)


def create_empty(spark: SparkSession, schemas: dict[str, T.StructType], target: str | Target) -> None:
    """Empty target tables, replacing what is there."""
    for table, schema in schemas.items():
        load_table(spark.createDataFrame([], schema), target, table)


def _switch(spark: SparkSession, path: str) -> None:
    """Puts ``path__new`` in the place of ``path``; what stood there is kept aside until then, and comes back if that fails."""
    fs, now = _fs(spark, path)
    new, old = (_fs(spark, f"{path}__{x}")[1] for x in ("new", "old"))
    if fs.exists(now):
        fs.delete(old, True)
        if not fs.rename(now, old):
            raise OSError(f"can't move {path} to {path}__old")
    try:
        moved = fs.rename(new, now)
    except Exception:
        fs.rename(old, now)
        raise
    if not moved:
        if fs.exists(old):
            fs.rename(old, now)
        raise OSError(f"can't move {path}__new to {path}")
    fs.delete(old, True)


def load_table(df: DataFrame, target: str | Target, table: str) -> None:
    """Replaces a target table's rows.

    In a folder they are written aside and then take its place by two renames;
    the old rows are there until the new ones are, and a folder
    ``<table>__old`` without ``<table>`` is what a driver lost between them
    leaves. A catalog table is overwritten, one over JDBC truncated and filled,
    so its columns and grants stay.
    """
    spark, to = df.sparkSession, _target(target)
    if to.versions is not None:
        version = versions.new_version()
        df.write.parquet(versions.path_of(to.versions, version, table))
        versions.commit(spark, to.versions, version, [table])
        return
    name = to.name(table)
    if to.jdbc is not None:
        df.write.format("jdbc").options(dbtable=name, truncate="true", **to.jdbc).mode("overwrite").save()
    elif to.database is not None:
        df.write.mode("overwrite").saveAsTable(name)
    else:
        df.write.mode("overwrite").parquet(f"{name}__new")
        _switch(spark, name)


def read_target(spark: SparkSession, target: str | Target, table: str) -> DataFrame:
    """A loaded table, with its own schema."""
    to = _target(target)
    if to.versions is not None:
        return versions.read(spark, to.versions, table)
    name = to.name(table)
    if to.folder is not None:
        return spark.read.parquet(name)
    return read_source(spark, name, jdbc=to.jdbc)


SUMMARY = "table_name string, rows_loaded long, columns int, status string, error string"


def load_all(dfs: dict[str, DataFrame], target: str | Target) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Loads every table and returns the summary and the loaded tables.

    A table without rows or columns is skipped with a warning; one table's failure
    does not stop the others. Loaded tables are read with the schema of their own
    files, so a column that is missing there is missing here. Rows written as Parquet
    are counted while they are written. In a folder of versions all tables change in
    one commit: where one fails, the others are ``rolled back`` and readers keep what
    they had. Summary: ``table_name, rows_loaded, columns, status, error``.
    """
    spark, to = next(iter(dfs.values())).sparkSession, _target(target)
    if to.versions is not None:
        return _load_together(spark, dfs, to.versions)
    rows, loaded = [], {}
    for table, df in dfs.items():
        try:
            if not df.columns or df.isEmpty():
                rows.append((table, 0, len(df.columns), "skipped", "no rows or no columns"))
                continue
            seen = Observation() if to.folder is not None else None
            load_table(df if seen is None else df.observe(seen, F.count(F.lit(1)).alias("n")), target, table)
            loaded[table] = read_target(spark, target, table)
            rows.append((table, loaded[table].count() if seen is None else seen.get["n"], len(df.columns), "loaded", None))
        except Exception as e:  # noqa: BLE001  reported as the table's status
            rows.append((table, 0, len(df.columns), "failed", str(e)[:500]))
    return spark.createDataFrame(rows, SUMMARY), loaded


def _load_together(spark: SparkSession, dfs: dict[str, DataFrame], folder: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    version, rows, loaded = versions.new_version(), [], {}
    for table, df in dfs.items():
        path = versions.path_of(folder, version, table)
        try:
            n = 0
            if df.columns:
                seen = Observation()
                df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
                n = seen.get["n"]
            if n:
                loaded[table] = spark.read.parquet(path)
            rows.append((table, n, len(df.columns), "loaded", None) if n else (table, 0, len(df.columns), "skipped", "no rows or no columns"))
        except Exception as e:  # noqa: BLE001  reported as the table's status
            rows.append((table, 0, len(df.columns), "failed", str(e)[:500]))
    if any(status == "failed" for *_, status, _ in rows):
        rows = [(t, 0, c, "rolled back", "another table failed") if status == "loaded" else (t, n, c, status, error) for t, n, c, status, error in rows]
        loaded = {}
    elif loaded:
        versions.commit(spark, folder, version, list(loaded))
    return spark.createDataFrame(rows, SUMMARY), loaded


def load_summary(dfs: dict[str, DataFrame]) -> DataFrame:
    """``table_name, rows_loaded, columns`` of loaded tables."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("rows_loaded")).select(F.lit(t).alias("table_name"), "rows_loaded", F.lit(len(df.columns)).alias("columns")) for t, df in dfs.items()])
