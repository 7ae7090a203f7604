"""Queries over the given tables: subsets, integrity, masks, checks and summaries."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions.config import Rules
from tamarack.functions.digits import digits_sql, mask_digits
from tamarack.functions.masks import mask_value
from tamarack.operators import mask as masking
from tamarack.operators import subset, validate
from tamarack.operators.closure import Reference
from tamarack.plans import provision
from tamarack.plans.mask_sql import mask_sql
from tamarack.plans.tpch import END, KEYS, LINKS, PLAN, RECORDS, RULES, SALT, START, tables
from tamarack.sources import generate, records
from tamarack.sources.scratch import Scratch, shared_dir
from tamarack.sources.tables import Target
from tamarack.sources.tables import load_summary as summary_of_loads


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of the anchor's orders, masked, with the number of their orders and lines."""
    dfs = tables(spark, sf_dir, "orders", "lineitem", "customer")
    request = provision.Request(tuple(dfs), record_count=RECORDS, start=START, end=END, salt=SALT, skip_provisioning=True)
    run = provision.run(spark, request, dfs, KEYS, plan=PLAN, rules=RULES)
    if run.error:
        raise run.cause
    lines = run.masked["lineitem"].groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"))
    per = run.masked["orders"].join(lines, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.coalesce(F.sum("n_lines"), F.lit(0)).alias("n_lines"))
    return run.masked["customer"].join(per, "c_custkey").select("c_custkey", "c_name", "n_orders", "n_lines")


def _subsets(spark: SparkSession, sf_dir: str, *names: str) -> tuple[dict[str, DataFrame], dict[str, str]]:
    return subset.subset(tables(spark, sf_dir, *names), PLAN, RECORDS, START, END)


def _day(name: str):
    return F.date_format(name, "yyyy-MM-dd").alias(name)


def anchor_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _subsets(spark, sf_dir, "orders")[0]["orders"]
    return out.withColumn("o_orderdate", _day("o_orderdate"))


def referential_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _subsets(spark, sf_dir, "orders", "lineitem")[0]["lineitem"]
    return out.withColumn("l_shipdate", _day("l_shipdate"))


def referential_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subsets(spark, sf_dir, "orders", "customer")[0]["customer"]


def two_hop_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of the anchor's customers: two links away."""
    dfs = tables(spark, sf_dir, "orders", "customer", "nation")
    return subset.subset(dfs, PLAN, RECORDS, START, END, max_hops=2)[0]["nation"]


def independent_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subsets(spark, sf_dir, "orders", "part")[0]["part"]


def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random sample that a seed fixes."""
    return subset.independent_sample(tables(spark, sf_dir, "part")["part"], ["p_partkey"], RECORDS, seed=7)


#: More rows than one task is given.
MANY = 40_000


def anchor_subset_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first lines in key order, so many that they are selected by rank."""
    out = subset.anchor_subset(tables(spark, sf_dir, "lineitem")["lineitem"], KEYS["lineitem"], MANY)
    return out.withColumn("l_shipdate", _day("l_shipdate"))


def seeded_sample_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = subset.independent_sample(tables(spark, sf_dir, "orders")["orders"], ["o_orderkey"], MANY // 3, seed=7)
    return out.withColumn("o_orderdate", _day("o_orderdate"))


_PARENT = "CASE WHEN c_custkey < 3 THEN (c_custkey + 1) % 3 ELSE floor(c_custkey / 7)::BIGINT END"
_REFERENCES = (Reference("orders", "o_custkey", "customer", "c_custkey"), Reference("customer", "c_parent", "customer", "c_custkey"), Reference("customer", "c_nationkey", "nation", "n_nationkey"))


def hierarchy_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of the anchor's orders with all whom they refer to as parents, up to a cycle of three: customers and their nations by key."""
    dfs = tables(spark, sf_dir, "orders", "customer", "nation")
    dfs["customer"] = dfs["customer"].withColumn("c_parent", F.when(F.col("c_custkey") < 3, (F.col("c_custkey") + 1) % 3).otherwise(F.floor(F.col("c_custkey") / 7)))
    out, _ = subset.subset({"orders": dfs["orders"], "customer": dfs["customer"], "nation": dfs["nation"].where("n_nationkey < 0")}, PLAN, RECORDS, START, END)
    from tamarack.operators.closure import close

    closed = close(out, dfs, _REFERENCES, KEYS)
    people = closed["customer"].select(F.lit("customer").alias("table_name"), F.col("c_custkey").alias("key"), "c_parent")
    return people.unionByName(closed["nation"].select(F.lit("nation").alias("table_name"), F.col("n_nationkey").cast("bigint").alias("key"), F.lit(None).cast("bigint").alias("c_parent")))


def extraction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subset.extraction_summary(*_subsets(spark, sf_dir, "orders", "lineitem", "customer", "part"))


_CHECKED = LINKS[:2]


def integrity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subset.integrity_report(_subsets(spark, sf_dir, "orders", "lineitem", "customer")[0], list(_CHECKED))


def integrity_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integrity of all links over the whole tables, one shuffle for all."""
    return subset.integrity_report(tables(spark, sf_dir, "orders", "lineitem", "customer", "nation", "region", "supplier", "part"), list(LINKS))


def integrity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subset.integrity_summary(integrity_report(spark, sf_dir))


def _masked(name: str, table: str, key: str, value: str, kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = tables(spark, sf_dir, table)[table]
        return df.select(key, mask_value(F.expr(value), kind, SALT).alias("masked"))

    query.__name__ = name
    return query, f"SELECT {key}, {mask_sql(value, kind, SALT)} AS masked FROM {table}"


_MASKS = [
    _masked("mask_name", "customer", "c_custkey", "c_name", "PERSON_NAME"),
    _masked("mask_street", "supplier", "s_suppkey", "s_name", "STREET_ADDRESS"),
    _masked("mask_city", "customer", "c_custkey", "c_name", "CITY"),
    _masked("mask_state", "supplier", "s_suppkey", "s_name", "STATE"),
    _masked("mask_zip", "part", "p_partkey", "p_name", "ZIP"),
    _masked("mask_phone", "orders", "o_orderkey", "o_custkey", "PHONE"),
    _masked("mask_email", "events", "event_id", "user_id", "EMAIL"),
    _masked("mask_ssn", "events", "event_id", "user_id", "SSN"),
    _masked("mask_generic", "part", "p_partkey", "p_brand", "GENERIC_PII"),
]


def mask_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest table with its keys masked, aggregated by flag: lines and distinct masks."""
    df = tables(spark, sf_dir, "lineitem")["lineitem"]
    out = masking.mask(df, {"l_orderkey": "GENERIC_PII", "l_partkey": "ZIP"}, SALT)
    return out.groupBy("l_returnflag").agg(F.count("*").alias("n_lines"), F.countDistinct("l_orderkey").alias("n_order_masks"), F.countDistinct("l_partkey").alias("n_part_masks"))


def mask_digits_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys as integers and as texts like a social security number, each with as many digits and all different."""
    df = tables(spark, sf_dir, "orders")["orders"].select("o_orderkey", F.regexp_replace(F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), r"^(\d{3})(\d{2})(\d{4})$", "$1-$2-$3").alias("ssn"))
    return df.select("o_orderkey", mask_digits(F.col("o_orderkey"), df.schema["o_orderkey"].dataType, SALT).alias("masked_key"), mask_digits(F.col("ssn"), df.schema["ssn"].dataType, SALT).alias("masked_ssn"))


def joined_digit_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys masked digit by digit in two tables join as the keys do: lines and orders by priority."""
    dfs = tables(spark, sf_dir, "orders", "lineitem")
    orders = masking.mask(dfs["orders"].select("o_orderkey", "o_orderpriority"), {"o_orderkey": "DIGITS"}, SALT)
    lines = masking.mask(dfs["lineitem"].select("l_orderkey"), {"l_orderkey": "DIGITS"}, SALT)
    per = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return orders.join(per, orders["o_orderkey"] == per["l_orderkey"]).groupBy("o_orderpriority").agg(F.sum("n").alias("n_lines"), F.count("*").alias("n_orders"))


def record_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as delimited records, some of them broken, read by their layout: records by problem."""
    from pyspark.sql import types as T

    df = tables(spark, sf_dir, "orders")["orders"]
    key = F.col("o_orderkey")
    customer = F.when(key % 10 == 3, "zz").when(key % 10 == 4, "").otherwise(F.col("o_custkey").cast("string"))
    line = F.concat_ws("\x01", key.cast("string"), customer, F.when(key % 10 == 5, "1996-13-01").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")), F.when(key % 10 != 6, F.col("o_orderpriority")))
    path = Scratch(spark, "records").root
    df.select(line.alias("value")).write.text(path)
    schema = T.StructType([T.StructField("key", T.LongType(), False), T.StructField("cust", T.IntegerType(), False), T.StructField("day", T.DateType()), T.StructField("priority", T.StringType(), True, {"max_length": 8})])
    good, bad = records.split_records(records.read_records(spark, path, schema))
    listed = bad.select(F.explode(records.PROBLEMS).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))
    return listed.unionByName(good.agg(F.lit("none").alias("problem"), F.count("*").alias("n")))


def _customer(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, str]]:
    df = tables(spark, sf_dir, "customer")["customer"]
    return df, masking.mask_columns(df, rules=RULES)


def mask_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, columns = _customer(spark, sf_dir)
    return masking.mask_stats(df, columns, "customer").withColumn("pii_columns", F.array_join("pii_columns", ","))


def before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, columns = _customer(spark, sf_dir)
    return masking.before_after(df, masking.mask(df, columns, SALT), "c_custkey", columns, "customer")


def masked_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys masked in two tables still join: lines and value by order priority."""
    dfs = tables(spark, sf_dir, "orders", "lineitem")
    orders = dfs["orders"].select(mask_value(F.col("o_orderkey"), "SSN", SALT).alias("k"), F.col("o_orderkey"), "o_orderpriority")
    lines = dfs["lineitem"].select(mask_value(F.col("l_orderkey"), "SSN", SALT).alias("k"), F.col("l_orderkey"))
    return orders.join(lines, "k").where("o_orderkey = l_orderkey").groupBy("o_orderpriority").agg(F.count("*").alias("n_lines"), F.countDistinct("k").alias("n_masks"))


def check_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    dfs = tables(spark, sf_dir, "orders", "lineitem")
    return validate.check_row_count(dfs["orders"], "orders", 15_000).unionByName(validate.check_row_count(dfs["lineitem"], "lineitem", 60_000))


def check_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables(spark, sf_dir, "orders")["orders"]
    return validate.check_columns(df, "orders", ["O_ORDERKEY", "o_custkey", "o_comment"])


def check_not_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables(spark, sf_dir, "orders")["orders"]
    return validate.check_not_empty(df, "orders").unionByName(validate.check_not_empty(df.where("o_orderkey < 0"), "none"))


def check_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables(spark, sf_dir, "lineitem")["lineitem"]
    df = df.withColumn("l_returnflag", F.when(F.col("l_linenumber") > 1, F.col("l_returnflag")))
    return validate.check_not_null(df, "lineitem", ["l_orderkey", "l_partkey", "l_returnflag"])


def validation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validation_rollup(check_not_null(spark, sf_dir).unionByName(check_not_empty(spark, sf_dir)))


def load_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary_of_loads(_subsets(spark, sf_dir, "orders", "lineitem", "customer")[0])


def _provisioned(spark: SparkSession, sf_dir: str) -> provision.Run:
    dfs = tables(spark, sf_dir, "orders", "lineitem", "customer")
    request = provision.Request(tuple(dfs), record_count=RECORDS, start=START, end=END, salt=SALT)
    return provision.run(spark, request, dfs, KEYS, Target(versions=f"{shared_dir(spark)}/target-{uuid.uuid4().hex}"), plan=PLAN, rules=RULES)


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job over three tables: profiled, subset, masked, loaded and validated."""
    return provision.run_summary(spark, _provisioned(spark, sf_dir))


def loaded_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _provisioned(spark, sf_dir).checks


def generate_for_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generated business for each customer, with its hierarchy: businesses by ultimate id."""
    n = tables(spark, sf_dir, "customer")["customer"].count()
    made = generate.business_entities(spark, n)
    return made.groupBy("ultimate_bus_id").agg(F.count("*").alias("n"), F.countDistinct("business_id").alias("n_ids"), F.min("rec_seq_nbr").alias("first"))


def target_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integrity of the links between the tables as they were loaded."""
    return _provisioned(spark, sf_dir).target_integrity


def dated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date column that rules choose for each table, and its rows within a range."""
    rules = Rules(date_columns=("o_missing", "L_SHIPDATE", "O_ORDERDATE", "ts", "l_commitdate"))
    out = []
    for name, df in tables(spark, sf_dir, "orders", "lineitem", "events", "part").items():
        column = subset.date_column(df, rules)
        rows = subset.date_range(df, column, START, "2024-01-15")
        out.append(rows.agg(F.lit(name).alias("table_name"), F.lit(column).cast("string").alias("date_column"), F.count("*").alias("n")))
    return reduce(DataFrame.unionByName, out)


def checked_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null checks of all columns whose names end as keys do, some values taken away."""
    df = tables(spark, sf_dir, "lineitem")["lineitem"].withColumn("l_suppkey", F.when(F.col("l_linenumber") != 2, F.col("l_suppkey")))
    return validate.check_not_null(df, "lineitem", validate.key_columns(df, Rules(checked_keys=("key", "_id"))))


def generated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generated score for each customer, joined by the business id of its key: customers by segment and risk."""
    df = tables(spark, sf_dir, "customer")["customer"]
    scores = generate.credit_scores(spark, df.agg(F.max("c_custkey") + 1).first()[0] or 0)
    people = df.select(generate.business_id(F.col("c_custkey")).alias("bus_nbr"), "c_mktsegment")
    return people.join(scores, "bus_nbr").groupBy("c_mktsegment", F.col("cr_scor_risk_clss_cd").alias("risk")).agg(F.count("*").alias("n"), F.sum(F.col("cr_risk_pct").cast("bigint")).alias("pct"))


QUERIES = {
    "flagship": flagship,
    **{f.__name__: f for f in (anchor_subset, referential_children, referential_parents, two_hop_subset, independent_sample, seeded_sample, anchor_subset_large, seeded_sample_large, hierarchy_closure, extraction_summary, integrity_report, integrity_full, integrity_summary)},
    **{q.__name__: q for q, _ in _MASKS},
    **{f.__name__: f for f in (mask_lineitem, mask_digits_of_orders, joined_digit_masks, record_problems, mask_stats, before_after, masked_join, check_row_count, check_columns, check_not_empty, check_not_null, validation_rollup, load_summary, run_summary, loaded_checks, target_integrity, dated_rows, checked_keys, generate_for_customers, generated_scores)},
}

_ANCHOR = f"(SELECT * FROM orders WHERE o_orderdate >= DATE '{START}' AND o_orderdate <= DATE '{END}' ORDER BY o_orderkey LIMIT {RECORDS})"
_LINES = f"(SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM {_ANCHOR}))"
_CUSTOMERS = f"(SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM {_ANCHOR}))"


def _integrity_sql(links, source) -> str:
    def one(x) -> str:
        a, b = (f"(SELECT DISTINCT {c}::VARCHAR AS k FROM {source(t)} WHERE {c} IS NOT NULL)" for t, c in ((x.table, x.col), (x.to_table, x.to_col)))
        return f"""SELECT '{x.table}' AS table_1, '{x.col}' AS column_1, '{x.to_table}' AS table_2, '{x.to_col}' AS column_2,
            (SELECT count(*) FROM {a}) AS keys_in_t1, (SELECT count(*) FROM {b}) AS keys_in_t2, (SELECT count(*) FROM {a} x JOIN {b} y USING (k)) AS overlap"""

    return f"""SELECT *, keys_in_t1 - overlap AS orphans_in_t1, keys_in_t2 - overlap AS orphans_in_t2,
        keys_in_t2 = overlap OR overlap > 0 AS passed, keys_in_t2 = overlap AS strict_passed FROM ({" UNION ALL ".join(map(one, links))})"""


_SUBSET = {"orders": _ANCHOR, "lineitem": _LINES, "customer": _CUSTOMERS}.__getitem__
_INTEGRITY = _integrity_sql(_CHECKED, _SUBSET)
_NOT_NULL = """SELECT 'lineitem' AS table_name, 'not_null_' || c AS check_name, '0' AS expected, n::VARCHAR AS actual, n = 0 AS passed FROM (
    SELECT 'l_orderkey' AS c, count(*) FILTER (l_orderkey IS NULL) AS n FROM lineitem
    UNION ALL SELECT 'l_partkey', count(*) FILTER (l_partkey IS NULL) FROM lineitem
    UNION ALL SELECT 'l_returnflag', count(*) FILTER (l_linenumber <= 1 OR l_linenumber IS NULL OR l_returnflag IS NULL OR l_returnflag = '') FROM lineitem)"""
_NOT_EMPTY = """SELECT t AS table_name, 'data_not_empty' AS check_name, 'true' AS expected, CASE WHEN n > 0 THEN 'true' ELSE 'false' END AS actual, n > 0 AS passed
    FROM (SELECT 'orders' AS t, count(*) AS n FROM orders UNION ALL SELECT 'none', count(*) FROM orders WHERE o_orderkey < 0)"""
_CHECKS = f"{_NOT_NULL} UNION ALL {_NOT_EMPTY}"
_LOADED = f"""SELECT 'orders' AS table_name, count(*) AS n, 6 AS columns, count(*) FILTER (o_orderkey IS NULL) AS b FROM {_ANCHOR}
    UNION ALL SELECT 'lineitem', count(*), 11, 0 FROM {_LINES} UNION ALL SELECT 'customer', count(*), 5, 0 FROM {_CUSTOMERS}"""
_ID = "lpad((100000000 + (({0}) * 7) % 900000000)::VARCHAR, 9, '0')"

_DRAW = "('0x' || substr(md5('0|{0}|' || i::VARCHAR), 1, 8))::BIGINT"

ORACLE_SQL = {
    "flagship": f"""
        SELECT c_custkey, {mask_sql("c_name", "PERSON_NAME", SALT)} AS c_name, n_orders, n_lines FROM customer JOIN (
            SELECT o_custkey, count(*) AS n_orders, coalesce(sum(n), 0)::BIGINT AS n_lines FROM {_ANCHOR} o
            LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey GROUP BY 1) ON o_custkey = c_custkey""",
    "anchor_subset": f"SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate) FROM {_ANCHOR}",
    "referential_children": f"SELECT * REPLACE (strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate) FROM {_LINES}",
    "referential_parents": f"SELECT * FROM {_CUSTOMERS}",
    "two_hop_subset": f"SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM {_CUSTOMERS})",
    "independent_sample": f"SELECT * FROM part ORDER BY p_partkey LIMIT {RECORDS}",
    "seeded_sample": f"SELECT * FROM part ORDER BY md5('7|' || p_partkey::VARCHAR), p_partkey LIMIT {RECORDS}",
    "seeded_sample_large": f"SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate) FROM orders ORDER BY md5('7|' || o_orderkey::VARCHAR), o_orderkey LIMIT {MANY // 3}",
    "anchor_subset_large": f"SELECT * REPLACE (strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate) FROM lineitem ORDER BY {', '.join(KEYS['lineitem'])} LIMIT {MANY}",
    "hierarchy_closure": f"""WITH RECURSIVE c AS (SELECT *, {_PARENT} AS c_parent FROM customer),
        r AS (SELECT c_custkey FROM {_CUSTOMERS} UNION SELECT c.c_parent FROM r JOIN c USING (c_custkey) WHERE c_parent IN (SELECT c_custkey FROM customer))
        SELECT 'customer' AS table_name, c_custkey AS key, c_parent FROM c JOIN r USING (c_custkey)
        UNION ALL SELECT 'nation', n_nationkey::BIGINT, NULL FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c JOIN r USING (c_custkey))""",
    "mask_digits_of_orders": f"""SELECT k.o_orderkey, k.masked AS masked_key, s.masked AS masked_ssn FROM ({digits_sql("(SELECT o_orderkey FROM orders)", "o_orderkey", SALT, 64)}) k
        JOIN ({digits_sql("(SELECT o_orderkey, regexp_replace(lpad(o_orderkey::VARCHAR, 9, '0'), '^(...)(..)(....)$', '\\1-\\2-\\3') AS ssn FROM orders)", "ssn", SALT)}) s USING (o_orderkey)""",
    "joined_digit_masks": "SELECT o_orderpriority, count(*) AS n_lines, count(DISTINCT o_orderkey) AS n_orders FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
    "record_problems": """SELECT problem, count(*) AS n FROM (
        SELECT unnest(CASE WHEN m = 3 THEN ['cust: not of type int'] WHEN m = 4 THEN ['cust: no value'] WHEN m = 5 THEN ['day: not of type date'] WHEN m = 6 THEN ['fields: 3 of 4'] ELSE [] END
            || CASE WHEN m <> 6 AND len(o_orderpriority) > 8 THEN ['priority: longer than 8'] ELSE [] END) AS problem FROM (SELECT *, o_orderkey % 10 AS m FROM orders)) GROUP BY 1
        UNION ALL SELECT 'none', count(*) FROM orders WHERE o_orderkey % 10 NOT IN (3, 4, 5, 6) AND len(o_orderpriority) <= 8""",
    "extraction_summary": f"""SELECT t AS table_name, q AS query_type, n AS row_count, c AS column_count, CASE WHEN n = 0 THEN 'no rows extracted from ' || t END AS warning FROM (
        SELECT 'orders' AS t, 'anchor_subset' AS q, count(*) AS n, 6 AS c FROM {_ANCHOR} UNION ALL SELECT 'lineitem', 'referential_subset', count(*), 11 FROM {_LINES}
        UNION ALL SELECT 'customer', 'referential_subset', count(*), 5 FROM {_CUSTOMERS} UNION ALL SELECT 'part', 'independent_sample', least(count(*), {RECORDS}), 6 FROM part)""",
    "integrity_report": _INTEGRITY,
    "integrity_full": _integrity_sql(LINKS, str),
    "integrity_summary": f"SELECT count(*) AS checks, sum(passed::INT)::BIGINT AS checks_passed, CASE WHEN bool_and(passed) THEN 'passed' ELSE 'warnings' END AS status FROM ({_INTEGRITY})",
    **{q.__name__: sql for q, sql in _MASKS},
    "mask_lineitem": f"""SELECT l_returnflag, count(*) AS n_lines, count(DISTINCT {mask_sql("l_orderkey", "GENERIC_PII", SALT)}) AS n_order_masks, count(DISTINCT {mask_sql("l_partkey", "ZIP", SALT)}) AS n_part_masks FROM lineitem GROUP BY 1""",
    "mask_stats": "SELECT 'customer' AS table_name, 1 AS pii_fields, 'c_name' AS pii_columns, count(*) AS rows_masked, count(*) FILTER (c_name <> '') AS total_values_masked FROM customer",
    "before_after": f"SELECT 'customer' AS table_name, 'c_name' AS column_name, 'PERSON_NAME' AS mask_type, c_name AS before, {mask_sql('c_name', 'PERSON_NAME', SALT)} AS after FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 1)",
    "masked_join": f"SELECT o_orderpriority, count(*) AS n_lines, count(DISTINCT {mask_sql('o_orderkey', 'SSN', SALT)}) AS n_masks FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
    "check_row_count": """SELECT t AS table_name, 'row_count' AS check_name, e::VARCHAR AS expected, n::VARCHAR AS actual, n = e AS passed FROM (
        SELECT 'orders' AS t, 15000 AS e, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', 60000, count(*) FROM lineitem)""",
    "check_columns": """SELECT 'orders' AS table_name, 'column_existence' AS check_name, '' AS expected, coalesce(string_agg(c, ',' ORDER BY c), '') AS actual, count(c) = 0 AS passed
        FROM (VALUES ('o_orderkey'), ('o_custkey'), ('o_comment')) v(c) WHERE c NOT IN (SELECT column_name FROM (DESCRIBE orders))""",
    "check_not_empty": _NOT_EMPTY,
    "check_not_null": _NOT_NULL,
    "validation_rollup": f"""SELECT count(*) AS total_checks, sum(passed::INT)::BIGINT AS passed_checks, count(*) - sum(passed::INT)::BIGINT AS failed_checks,
        (SELECT count(*) FROM (SELECT bool_and(passed) AS ok FROM ({_CHECKS}) GROUP BY table_name) WHERE ok) AS tables_passed,
        CASE WHEN bool_and(passed) THEN 'PASSED' WHEN bool_or(passed) THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM ({_CHECKS})""",
    "load_summary": f"SELECT table_name, n AS rows_loaded, columns FROM ({_LOADED})",
    "run_summary": f"""SELECT 'completed' AS status, 3 AS tables_profiled, 22 AS total_fields, 1 AS pii_fields_detected, 2 AS relationships_found, sum(n)::BIGINT AS rows_extracted,
        (SELECT count(*) FROM {_CUSTOMERS} WHERE c_name <> '') AS values_masked, sum(n)::BIGINT AS rows_loaded, 'PASSED' AS validation_status FROM ({_LOADED})""",
    "loaded_checks": f"""SELECT table_name, c.check_name, CASE c.check_name WHEN 'row_count' THEN n::VARCHAR WHEN 'column_existence' THEN '' ELSE 'true' END AS expected,
        CASE c.check_name WHEN 'row_count' THEN n::VARCHAR WHEN 'column_existence' THEN '' ELSE 'true' END AS actual, TRUE AS passed
        FROM ({_LOADED}), (VALUES ('row_count'), ('column_existence'), ('data_not_empty')) c(check_name)""",
    "target_integrity": _INTEGRITY,
    "dated_rows": f"""SELECT 'orders' AS table_name, 'o_orderdate' AS date_column, count(*) AS n FROM orders WHERE o_orderdate BETWEEN DATE '{START}' AND DATE '2024-01-15'
        UNION ALL SELECT 'lineitem', 'l_shipdate', count(*) FROM lineitem WHERE l_shipdate BETWEEN DATE '{START}' AND DATE '2024-01-15'
        UNION ALL SELECT 'events', 'ts', count(*) FROM events WHERE ts BETWEEN DATE '{START}' AND DATE '2024-01-15' UNION ALL SELECT 'part', NULL, count(*) FROM part""",
    "checked_keys": """SELECT 'lineitem' AS table_name, 'not_null_' || c AS check_name, '0' AS expected, n::VARCHAR AS actual, n = 0 AS passed FROM (
        SELECT 'l_orderkey' AS c, count(*) FILTER (l_orderkey IS NULL) AS n FROM lineitem UNION ALL SELECT 'l_partkey', count(*) FILTER (l_partkey IS NULL) FROM lineitem
        UNION ALL SELECT 'l_suppkey', count(*) FILTER (l_linenumber = 2 OR l_linenumber IS NULL OR l_suppkey IS NULL) FROM lineitem)""",
    "generated_scores": f"""SELECT c_mktsegment, (({_DRAW.format("risk")} % 5) + 1)::VARCHAR AS risk, count(*) AS n, sum({_DRAW.format("risk_pct")} % 100 + 1)::BIGINT AS pct
        FROM (SELECT c_mktsegment, c_custkey AS i FROM customer) GROUP BY ALL""",
    "generate_for_customers": f"""SELECT ultimate_bus_id, count(*) AS n, count(DISTINCT business_id) AS n_ids, min(i + 1)::INT AS first FROM (
        SELECT i, {_ID.format("i")} AS business_id, {_ID.format("('0x' || substr(md5('0|ultimate|' || i::VARCHAR), 1, 8))::BIGINT % least(n, 20)")} AS ultimate_bus_id
        FROM (SELECT count(*) AS n, unnest(range(count(*))) AS i FROM customer)) GROUP BY 1""",
}
