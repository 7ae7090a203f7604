"""Queries that write the given tables as a job does and read them again, or join them with generated ones."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions.config import Rules
from tamarack.operators import subset, validate
from tamarack.plans.tpch import PLAN, START, tables
from tamarack.sources import generate, versions
from tamarack.sources.scratch import Scratch, shared_dir
from tamarack.sources.tables import Target, load_all, write_csv


def versioned_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads into a folder of versions, the second of orders alone: rows and keys of each table as of each commit."""
    dfs = tables(spark, sf_dir, "orders", "lineitem")
    folder = f"{shared_dir(spark)}/versions-{uuid.uuid4().hex}"
    load_all(dfs, Target(versions=folder))
    load_all({"orders": dfs["orders"].where(F.col("o_orderdate") >= START)}, Target(versions=folder))
    out = []
    for number in (1, 2):
        for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
            rows = versions.read(spark, folder, name, number)
            out.append(rows.agg(F.lit(number).alias("commit_number"), F.lit(name).alias("table_name"), F.count("*").alias("n"), F.sum(key).alias("key_sum")))
    return reduce(DataFrame.unionByName, out)


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts, written as a request's CSV and read by their schema."""
    df = tables(spark, sf_dir, "part")["part"]
    path = write_csv(df, Scratch(spark, "csv").root, "request", "part")
    return spark.read.schema(df.schema).option("header", True).csv(path)


def checked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks of the largest table in one scan, some of its keys taken away and a column expected that it lacks."""
    df = tables(spark, sf_dir, "lineitem")["lineitem"]
    spoilt = df.withColumn("l_suppkey", F.when(F.col("l_linenumber") != 2, F.col("l_suppkey")))
    return validate.validate_table(spoilt, "lineitem", df.count(), [*df.columns, "L_COMMENT"], Rules(checked_keys=("key",)))


def hop_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders from a day on as anchor, and how many rows of each table follow within three links."""
    out, how = subset.subset(tables(spark, sf_dir, "orders", "lineitem", "customer", "nation", "region", "part", "supplier"), PLAN, None, START, max_hops=3)
    return subset.extraction_summary(out, how).select("table_name", "query_type", "row_count")


def generated_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generated address for each customer, joined by the business id of its key: customers by segment and quality of the match."""
    df = tables(spark, sf_dir, "customer")["customer"]
    made = generate.address_matches(spark, df.agg(F.max("c_custkey") + 1).first()[0] or 0)
    people = df.select(generate.business_id(F.col("c_custkey")).alias("mtch_bus_nbr"), "c_mktsegment")
    by = people.join(made, "mtch_bus_nbr").groupBy("c_mktsegment", F.col("mtch_confid_cd").alias("confidence"), (F.col("sec_addr") != "").alias("has_second_line"))
    return by.agg(F.count("*").alias("n"), F.sum(F.col("accrcy_pct_amt").cast("bigint")).alias("accuracy"))


def generated_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated load cycles and their sources, one day for each day since the first order: orders by process and the state of both."""
    df = tables(spark, sf_dir, "orders")["orders"].select(F.to_date("o_orderdate").alias("day"))
    first, last = df.agg(F.min("day"), F.max("day")).first()
    days = (last - first).days + 1 if first else 0
    day = F.date_add(F.lit(generate.FIRST_CYCLE).cast("date"), F.datediff("day", F.lit(first)))
    orders = df.groupBy(day.alias("etl_cyc_dt")).agg(F.count("*").alias("n"))
    sources = generate.etl_sources(spark, days).select("etl_cyc_id", "etl_proc_cd", "etl_src_sts_cd", "etl_rec_cnt")
    cycles = generate.etl_cycles(spark, days).join(sources, ["etl_cyc_id", "etl_proc_cd"])
    by = orders.join(cycles, "etl_cyc_dt").groupBy(F.col("etl_proc_cd").alias("process"), F.col("etl_cyc_sts_cd").alias("cycle_status"), F.col("etl_src_sts_cd").alias("source_status"))
    return by.agg(F.sum("n").alias("n_orders"), F.sum(F.col("n") * F.col("etl_rec_cnt")).alias("n_records"))


QUERIES = {f.__name__: f for f in (versioned_targets, csv_round_trip, checked_lines, hop_sizes, generated_addresses, generated_cycles)}


def _draw(name: str, low: int, high: int) -> str:
    """``generate.Draw.number`` with seed 0 and row number ``i``."""
    return f"(('0x' || substr(md5('0|{name}|' || i::VARCHAR), 1, 8))::BIGINT % {high - low + 1} + {low})"


_SINCE = f"(SELECT * FROM orders WHERE o_orderdate >= DATE '{START}')"
_LINES = f"(SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM {_SINCE}))"
_CUSTOMERS = f"(SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM {_SINCE}))"
_SUPPLIERS = f"(SELECT * FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM {_LINES}))"
#: Nations follow from customers, as these stand before suppliers among the tables.
_NATIONS = f"(SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM {_CUSTOMERS}))"
_NULLS = {"l_orderkey": "l_orderkey IS NULL", "l_partkey": "l_partkey IS NULL", "l_suppkey": "l_linenumber = 2 OR l_linenumber IS NULL OR l_suppkey IS NULL"}

ORACLE_SQL = {
    "versioned_targets": f"""SELECT c::INT AS commit_number, t AS table_name, n, key_sum::BIGINT AS key_sum FROM (
        SELECT 1 AS c, 'orders' AS t, count(*) AS n, sum(o_orderkey) AS key_sum FROM orders UNION ALL SELECT 2, 'orders', count(*), sum(o_orderkey) FROM {_SINCE}
        UNION ALL SELECT unnest([1, 2]), 'lineitem', n, k FROM (SELECT count(*) AS n, sum(l_orderkey) AS k FROM lineitem))""",
    "csv_round_trip": "SELECT * FROM part",
    "checked_lines": """SELECT 'lineitem' AS table_name, c AS check_name, e AS expected, a AS actual, p AS passed FROM (
        SELECT 'row_count' AS c, count(*)::VARCHAR AS e, count(*)::VARCHAR AS a, TRUE AS p FROM lineitem UNION ALL SELECT 'column_existence', '', 'L_COMMENT', FALSE
        UNION ALL SELECT 'data_not_empty', 'true', (count(*) > 0)::VARCHAR, count(*) > 0 FROM lineitem"""
    + "".join(f" UNION ALL SELECT 'not_null_{k}', '0', count(*)::VARCHAR, count(*) = 0 FROM lineitem WHERE {w}" for k, w in _NULLS.items())
    + ")",
    "hop_sizes": f"""SELECT 'orders' AS table_name, 'anchor_subset' AS query_type, count(*) AS row_count FROM {_SINCE} UNION ALL SELECT 'lineitem', 'referential_subset', count(*) FROM {_LINES}
        UNION ALL SELECT 'customer', 'referential_subset', count(*) FROM {_CUSTOMERS} UNION ALL SELECT 'supplier', 'referential_subset', count(*) FROM {_SUPPLIERS}
        UNION ALL SELECT 'part', 'referential_subset', count(*) FROM part WHERE p_partkey IN (SELECT l_partkey FROM {_LINES}) UNION ALL SELECT 'nation', 'referential_subset', count(*) FROM {_NATIONS}
        UNION ALL SELECT 'region', 'referential_subset', count(*) FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM {_NATIONS})""",
    "generated_addresses": f"""SELECT c_mktsegment, ['A', 'B', 'C'][{_draw("confidence", 1, 3)}] AS confidence, {_draw("has_sec", 0, 1)} = 1 AS has_second_line, count(*) AS n,
        sum({_draw("accuracy", 80, 99)})::BIGINT AS accuracy FROM (SELECT c_mktsegment, c_custkey AS i FROM customer) GROUP BY ALL""",
    "generated_cycles": f"""SELECT {[p for p, _ in generate.PROCESSES]}[k + 1] AS process, CASE WHEN {_draw("status", 1, 100)} <= 25 THEN 'FAILED' ELSE 'DONE' END AS cycle_status,
        CASE WHEN {_draw("src_status", 1, 100)} <= 25 THEN 'BAD' ELSE 'GOOD' END AS source_status, count(*) AS n_orders, sum({_draw("etl_cnt", 100, 50_000)})::BIGINT AS n_records
        FROM (SELECT k, date_diff('day', first, o_orderdate::DATE) * {len(generate.PROCESSES)} + k AS i FROM orders, (SELECT min(o_orderdate::DATE) AS first FROM orders), (SELECT unnest(range({len(generate.PROCESSES)})) AS k)) GROUP BY ALL""",
}
