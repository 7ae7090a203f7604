"""Queries over the given tables' catalog, measured from the tables themselves in one pass each."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.operators import profile
from tamarack.plans.tpch import RULES, tables
from tamarack.sources.catalog import fields_from_tables

#: Tables profiled, with their columns (text columns marked *), for the SQL.
SHAPE = {
    "region": "r_regionkey r_name*",
    "nation": "n_nationkey n_name* n_regionkey",
    "customer": "c_custkey c_name* c_nationkey c_acctbal c_mktsegment*",
    "supplier": "s_suppkey s_name* s_nationkey s_acctbal",
    "part": "p_partkey p_name* p_brand* p_type* p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus* o_totalprice o_orderdate o_orderpriority*",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag* l_linestatus* l_shipdate",
    "events": "event_id ts user_id event_type* value props*",
    "documents": "doc_id text* lang* source* n_chars",
    "labels": "doc_id quality toxic",
    "pages": "page_id url* html*",
}


def _classified(spark: SparkSession, sf_dir: str, measured: bool = True) -> DataFrame:
    """The catalog, read once: its row per column is taken to the driver, so that plans built on it scan no table again."""
    fields = fields_from_tables(spark, tables(spark, sf_dir, *SHAPE), measured)
    return profile.classify_fields(spark.createDataFrame(fields.collect(), fields.schema), RULES)


def classify_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("table_name", "ordinal", "name", F.col("class").alias("field_class"), "pii_type", "max_length", "row_count", "null_count")


def mask_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that are masked, with their masks and the longest value."""
    out = _classified(spark, sf_dir).where("mask_type is not null or pii_type is not null")
    return out.select("table_name", "name", F.coalesce("mask_type", "pii_type").alias("mask_type"), "max_length")


def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _classified(spark, sf_dir)
    names = {c: F.array_join(c, ",").alias(c) for c in ("control_fields", "scd2_fields", "key_fields")}
    counts = rows.groupBy("table_name").agg(F.max("row_count").alias("row_count"))
    pii = F.array_join(F.transform("pii_fields", lambda x: F.concat_ws(":", x["name"], x["pii_type"], x["max_length"].cast("string"))), ",").alias("pii_fields")
    return profile.table_profiles(rows).join(counts, "table_name").select("table_name", "field_count", pii, *names.values(), "is_scd2", "is_control_table", "row_count")


def pii_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.pii_summary(profile.table_profiles(_classified(spark, sf_dir, measured=False)))
    by = F.array_join(F.transform(F.array_sort(F.map_entries("pii_by_table")), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",")
    return out.select("tables_with_pii", "total_pii_fields", by.alias("pii_by_table"))


def profile_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _classified(spark, sf_dir)
    out = profile.profile_totals(profile.table_profiles(rows))
    filled = rows.agg(F.sum(F.col("row_count") - F.col("null_count")).alias("filled_cells"))
    return out.withColumn("k", F.lit(1)).join(filled.withColumn("k", F.lit(1)), "k").select("tables_profiled", "total_fields", F.size("scd2_tables").alias("n_scd2_tables"), "filled_cells")


def anchor_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.anchor_table(profile.table_profiles(_classified(spark, sf_dir, measured=False))).select("table_name", "field_count")


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.infer_relationships(_classified(spark, sf_dir, measured=False), RULES).select("table_1", "column_1", "table_2", "column_2", "confidence", "key_class")


#: Key names that mean one thing, for the given tables.
CONCEPTS = (("person", ("c_custkey", "o_custkey", "user_id")), ("text", ("doc_id", "page_id")))


def concept_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships with keys that mean the same under different names."""
    rules = replace(RULES, concepts=CONCEPTS)
    return profile.infer_relationships(_classified(spark, sf_dir, measured=False), rules).select("table_1", "column_1", "table_2", "column_2", "confidence")


def join_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.join_paths(profile.infer_relationships(_classified(spark, sf_dir, measured=False), RULES)).withColumnsRenamed({"from": "from_table", "to": "to_table"})


def subsetting_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _classified(spark, sf_dir, measured=False)
    profiles = profile.table_profiles(rows)
    return profile.subsetting_order(profiles, profile.infer_relationships(rows, RULES), profile.anchor_table(profiles))


def whole_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report as one row, its lists by their sizes and its longest table."""
    out = profile.profile_report(_classified(spark, sf_dir), RULES)
    keyed = F.size(F.filter("tables", lambda t: F.size(t["key_fields"]) > 0)).alias("tables_with_keys")
    high = F.size(F.filter("relationships", lambda r: r["confidence"] == "high")).alias("high_relationships")
    return out.select("tables_profiled", "total_fields", "tables_with_pii", "total_pii_fields", keyed, F.size("relationships").alias("n_relationships"), high, "anchor_table")


QUERIES = {f.__name__: f for f in (classify_fields, mask_types, table_profile, pii_summary, profile_totals, anchor_table, relationships, concept_relationships, join_paths, subsetting_order, whole_profile)}


def _like(patterns: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(n, '{p}')" for p in patterns) + ")"


def _ends(patterns: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"ends_with(n, '{p}')" for p in patterns) + ")"


def _fields_sql() -> str:
    rows = []
    for t, (table, columns) in enumerate(SHAPE.items(), 1):
        for k, c in enumerate(columns.split(), 1):
            name, text = c.rstrip("*"), c.endswith("*")
            size = f"max(length({name}))::INT" if text else "NULL::INT"
            rows.append(f"SELECT {t} AS t, '{table.upper()}' AS table_name, {k} AS ordinal, '{name}' AS n, {size} AS max_length, count(*) AS row_count, count(*) - count({name}) AS null_count FROM {table}")
    kind = f"""CASE WHEN {_like(RULES.scd2)} THEN 'scd2' WHEN {_like(RULES.control)} THEN 'control' WHEN {_like(RULES.pii)} THEN 'pii'
        WHEN {_ends(RULES.key_ends)} OR starts_with(n, 'business_id') THEN 'key' WHEN contains(n, 'filler') THEN 'filler' ELSE 'business' END"""
    pii = f"""CASE WHEN {_like(RULES.pii_name)} THEN 'PERSON_NAME' WHEN {_like(RULES.pii_address)} THEN 'ADDRESS' WHEN {_like(RULES.pii_phone)} THEN 'PHONE' WHEN {_like(RULES.pii_id)} THEN 'IDENTIFIER' END"""
    mask = "CASE " + " ".join(f"WHEN {_like(p)} THEN '{m}'" for m, p in RULES.mask_routes) + " END"
    return f"SELECT *, n AS name, {kind} AS c, CASE WHEN {kind} = 'pii' THEN {pii} END AS pii_type, {mask} AS mask_type FROM ({' UNION ALL '.join(rows)})"


_F = f"WITH f AS ({_fields_sql()})"
_KEYS = f"k AS (SELECT *, regexp_replace(replace(replace(n, 'mtch_', ''), 'bus_', 'business_'), '^[a-z]{{1,2}}_', '') AS token FROM f WHERE {_ends(RULES.related_ends)} OR starts_with(n, 'business_id'))"
_RELATED = f"""r AS (SELECT a.t AS t1, b.t AS t2, a.table_name AS table_1, a.n AS column_1, b.table_name AS table_2, b.n AS column_2, CASE WHEN a.n = b.n THEN 'high' ELSE 'medium' END AS confidence,
    CASE WHEN a.c = 'control' OR b.c = 'control' THEN 'control' ELSE 'key' END AS key_class FROM k a JOIN k b ON a.token = b.token AND a.t < b.t)"""


def _names(kind: str) -> str:
    return f"coalesce(string_agg(n, ',' ORDER BY ordinal) FILTER (c = '{kind}'), '')"


_PII = "count(*) FILTER (c = 'pii')"
ORACLE_SQL = {
    "classify_fields": f"{_F} SELECT table_name, ordinal, name, c AS field_class, pii_type, max_length, row_count, null_count FROM f",
    "mask_types": f"{_F} SELECT table_name, name, coalesce(mask_type, pii_type) AS mask_type, max_length FROM f WHERE mask_type IS NOT NULL OR pii_type IS NOT NULL",
    "table_profile": f"""{_F} SELECT table_name, count(*) AS field_count, coalesce(string_agg(n || ':' || pii_type || coalesce(':' || max_length::VARCHAR, ''), ',' ORDER BY ordinal) FILTER (c = 'pii'), '') AS pii_fields,
        {_names("control")} AS control_fields, {_names("scd2")} AS scd2_fields, {_names("key")} AS key_fields, count(*) FILTER (c = 'scd2') >= 2 AS is_scd2,
        count(*) FILTER (c = 'control') > 0.5 * count(*) AS is_control_table, max(row_count) AS row_count FROM f GROUP BY table_name""",
    "pii_summary": f"""{_F}, p AS (SELECT table_name, {_PII} AS k FROM f GROUP BY 1)
        SELECT count(*) FILTER (k > 0) AS tables_with_pii, sum(k)::BIGINT AS total_pii_fields, string_agg(table_name || '=' || k, ',' ORDER BY table_name) FILTER (k > 0) AS pii_by_table FROM p""",
    "profile_totals": f"{_F} SELECT count(DISTINCT table_name) AS tables_profiled, count(*) AS total_fields, 0 AS n_scd2_tables, sum(row_count - null_count)::BIGINT AS filled_cells FROM f",
    "anchor_table": f"{_F} SELECT table_name, count(*) AS field_count FROM f GROUP BY t, table_name HAVING count(*) FILTER (c = 'control') <= 0.5 * count(*) ORDER BY 2 DESC, t LIMIT 1",
    "relationships": f"{_F}, {_KEYS}, {_RELATED} SELECT table_1, column_1, table_2, column_2, confidence, key_class FROM r",
    "concept_relationships": f"""{_F}, {_KEYS} SELECT a.table_name AS table_1, a.n AS column_1, b.table_name AS table_2, b.n AS column_2, CASE WHEN a.n = b.n THEN 'high' ELSE 'medium' END AS confidence
        FROM k a JOIN k b ON a.t < b.t AND (a.token = b.token OR {" OR ".join(f"(a.n IN {names} AND b.n IN {names})" for _, names in CONCEPTS)})""",
    "join_paths": f"{_F}, {_KEYS}, {_RELATED} SELECT table_1 AS from_table, column_1 AS key, table_2 AS to_table, column_2 AS key_to FROM r WHERE key_class = 'key'",
    "whole_profile": f"""{_F}, {_KEYS}, {_RELATED}, p AS (SELECT t, table_name, count(*) AS n, {_PII} AS pii, count(*) FILTER (c = 'key') AS keys, count(*) FILTER (c = 'control') AS control FROM f GROUP BY ALL)
        SELECT count(*) AS tables_profiled, sum(n)::BIGINT AS total_fields, count(*) FILTER (pii > 0) AS tables_with_pii, sum(pii)::BIGINT AS total_pii_fields, (count(*) FILTER (keys > 0))::INT AS tables_with_keys,
        (SELECT count(*) FROM r)::INT AS n_relationships, (SELECT count(*) FROM r WHERE confidence = 'high')::INT AS high_relationships,
        (SELECT table_name FROM p WHERE control <= 0.5 * n ORDER BY n DESC, t LIMIT 1) AS anchor_table FROM p""",
    "subsetting_order": f"""{_F}, {_KEYS}, {_RELATED}, s AS (SELECT table_1 AS x, [t1, t2, 0] AS spot FROM r UNION ALL SELECT table_2, [t1, t2, 1] FROM r),
        a AS (SELECT table_name FROM f GROUP BY t, table_name HAVING count(*) FILTER (c = 'control') <= 0.5 * count(*) ORDER BY count(*) DESC, t LIMIT 1)
        SELECT table_name, row_number() OVER (ORDER BY table_name NOT IN (FROM a), m IS NULL, m, t)::INT AS position
        FROM (SELECT DISTINCT t, table_name FROM f) LEFT JOIN (SELECT x, min(spot) AS m FROM s GROUP BY x) ON x = table_name""",
}
