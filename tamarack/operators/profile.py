"""Profile of a catalog: classes, table profiles, relationships between keys, and the plan of a subset.

A ``fields`` table has one row per column: ``table_name, ordinal, name,
max_length, is_typed, ...``; ``table_order`` numbers the tables as requested.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions.classify import ends_with_any, field_class, mask_route, normalised_key, pii_type
from tamarack.functions.config import Rules


def filter_tables(fields: DataFrame, tables: list[str]) -> DataFrame:
    """Rows of the requested tables, by table name or, for layouts, by the file's stem; case does not matter."""
    wanted = [t.lower() for t in tables]
    match = F.lower("table_name").isin(wanted)
    if "file" in fields.columns:
        stem = F.regexp_extract(F.lower("file"), r"([^/\\]*?)(\.[^./\\]*)?$", 1)
        match |= (F.col("kind") == "dml") & stem.isin(wanted)
    return fields.where(match)


def classify_fields(fields: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``fields`` with ``class``, ``pii_type`` (of pii fields) and ``mask_type``."""
    kind = field_class(F.col("name"), rules)
    return fields.withColumns({"class": kind, "pii_type": F.when(kind == "pii", pii_type(F.col("name"), rules)), "mask_type": mask_route(F.col("name"), rules)})


def table_profiles(classified: DataFrame) -> DataFrame:
    """A row per table: number of fields, lists of them by class in their order, and what kind of table it is."""

    def listed(test: str) -> F.Column:
        return F.transform(F.array_sort(F.collect_list(F.when(F.expr(test), F.struct("ordinal", "name")))), lambda x: x["name"])

    pii = F.transform(
        F.array_sort(F.collect_list(F.when(F.col("class") == "pii", F.struct("ordinal", "name", "pii_type", "max_length")))),
        lambda x: F.struct(x["name"].alias("name"), x["pii_type"].alias("pii_type"), x["max_length"].alias("max_length")),
    )
    return (
        classified.groupBy("table_name")
        .agg(
            F.min("table_order").alias("table_order"),
            F.count("*").alias("field_count"),
            pii.alias("pii_fields"),
            listed("class = 'control'").alias("control_fields"),
            listed("class = 'scd2'").alias("scd2_fields"),
            listed("class = 'key'").alias("key_fields"),
            F.max("is_typed").alias("is_typed"),
        )
        .withColumn("is_scd2", F.size("scd2_fields") >= 2)
        .withColumn("is_control_table", F.col("is_typed") | (F.size("control_fields") > 0.5 * F.col("field_count")))
    )


def pii_summary(profiles: DataFrame) -> DataFrame:
    """One row: tables with personal data, its fields, and their number by table."""
    some = F.size("pii_fields") > 0
    pairs = F.array_sort(F.collect_list(F.when(some, F.struct("table_name", F.size("pii_fields").alias("n")))))
    return profiles.agg(F.count(F.when(some, 1)).alias("tables_with_pii"), F.coalesce(F.sum(F.size("pii_fields")), F.lit(0)).alias("total_pii_fields"), F.map_from_entries(pairs).alias("pii_by_table"))


def profile_totals(profiles: DataFrame) -> DataFrame:
    """One row: tables, fields, and the tables with slowly changing dimensions."""
    slow = F.array_sort(F.collect_list(F.when(F.col("is_scd2"), F.col("table_name"))))
    return profiles.agg(F.count("*").alias("tables_profiled"), F.coalesce(F.sum("field_count"), F.lit(0)).alias("total_fields"), slow.alias("scd2_tables"))


def anchor_table(profiles: DataFrame) -> DataFrame:
    """The table with most fields that is not a control table, the first of equals; no row if there is none."""
    return profiles.where(~F.col("is_control_table")).orderBy(F.desc("field_count"), "table_order").limit(1)


def infer_relationships(classified: DataFrame, rules: Rules = Rules(), skip_control: bool = False) -> DataFrame:
    """Pairs of key columns of two tables with equal normalised names or one concept.

    Columns ``table_1, column_1, table_2, column_2, relationship_type,
    confidence, key_class``; tables stand in their order and each pair once. An
    equi-join on name tokens, so tables are never compared pair by pair.
    """
    name = F.lower("name")
    keys = classified.where(ends_with_any(name, rules.related_ends) | (name.startswith("business_id")))
    if skip_control:
        keys = keys.where("class <> 'control'")
    concepts = [F.when(name.isin(*names), F.lit(f"concept:{c}")) for c, names in rules.concepts]
    tokens = F.array_compact(F.array(F.concat(F.lit("name:"), normalised_key(F.col("name"), rules)), *concepts))
    keys = keys.select("table_name", "table_order", "name", "class", F.explode(tokens).alias("token")).distinct()
    a, b = keys.alias("a"), keys.alias("b")
    pairs = a.join(b, F.col("a.token") == F.col("b.token")).where("a.table_order < b.table_order")
    same = F.lower("a.name") == F.lower("b.name")
    return pairs.select(
        F.col("a.table_name").alias("table_1"),
        F.col("a.name").alias("column_1"),
        F.col("b.table_name").alias("table_2"),
        F.col("b.name").alias("column_2"),
        F.lit("foreign_key").alias("relationship_type"),
        F.when(same, "high").otherwise("medium").alias("confidence"),
        F.when((F.col("a.class") == "control") | (F.col("b.class") == "control"), "control").otherwise("key").alias("key_class"),
        F.col("a.table_order").alias("order_1"),
        F.col("b.table_order").alias("order_2"),
    ).distinct()


def join_paths(relationships: DataFrame) -> DataFrame:
    """``from, key, to, key_to`` of each relationship over keys that are not control fields."""
    return relationships.where("key_class = 'key'").select(F.col("table_1").alias("from"), F.col("column_1").alias("key"), F.col("table_2").alias("to"), F.col("column_2").alias("key_to"))


def subsetting_order(profiles: DataFrame, relationships: DataFrame, anchor: DataFrame) -> DataFrame:
    """``table_name, position``: the anchor, then tables as they first appear in relationships, then the rest."""
    seen = relationships.select(F.explode(F.array(F.struct(F.col("table_1").alias("t"), F.col("order_1").alias("a"), F.col("order_2").alias("b"), F.lit(0).alias("s")), F.struct(F.col("table_2").alias("t"), F.col("order_1").alias("a"), F.col("order_2").alias("b"), F.lit(1).alias("s")))).alias("x"))
    first = seen.groupBy(F.col("x.t").alias("table_name")).agg(F.min(F.struct("x.a", "x.b", "x.s")).alias("at"))
    lead = anchor.select("table_name", F.lit(True).alias("is_anchor"))
    ranked = profiles.select("table_name", "table_order").join(first, "table_name", "left").join(lead, "table_name", "left")
    rank = Window.orderBy(F.col("is_anchor").desc_nulls_last(), F.col("at").asc_nulls_last(), "table_order")  # a row per table
    return ranked.select("table_name", F.row_number().over(rank).alias("position"))


def profile_report(classified: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The whole profile as one row of structs and arrays."""
    profiles = table_profiles(classified)
    related = infer_relationships(classified, rules)
    tables = profiles.agg(F.array_sort(F.collect_list(F.struct("table_order", *(c for c in profiles.columns if c != "table_order")))).alias("tables"))
    links = related.agg(F.array_sort(F.collect_list(F.struct("order_1", "order_2", "column_1", "column_2", "table_1", "table_2", "confidence", "key_class"))).alias("relationships"))
    anchor = anchor_table(profiles).agg(F.first("table_name", ignorenulls=True).alias("anchor_table"))
    out = profile_totals(profiles).withColumn("_one", F.lit(1))
    for part in (pii_summary(profiles), tables, links, anchor):  # one row each
        out = out.join(part.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def fingerprints(classified: DataFrame) -> DataFrame:
    """``table_name, fingerprint``: one digest for a table's columns, types and classes, whatever their order."""
    field = F.concat_ws("|", F.lower("name"), F.coalesce("declared_type", F.lit("")), F.coalesce("class", F.lit("")), F.coalesce("pii_type", F.lit("")))
    return classified.groupBy(F.upper("table_name").alias("table_name")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(field)), "\n"), 256).alias("fingerprint"))


def changes(stored: DataFrame, current: DataFrame) -> DataFrame:
    """What differs between two classified catalogs: ``table_name, column_name, change, before, after``.

    ``change`` is added, dropped, retyped or reclassified (a class or kind of personal
    data that differs); a column may have two rows. Names are compared without case.
    Only tables whose fingerprints differ are looked into.
    """
    a, b = fingerprints(stored).withColumnRenamed("fingerprint", "f1"), fingerprints(current).withColumnRenamed("fingerprint", "f2")
    differ = a.join(b, "table_name", "full").where(~F.col("f1").eqNullSafe(F.col("f2"))).select("table_name")

    def fields(rows: DataFrame, side: str) -> DataFrame:
        kind = F.concat_ws("/", "class", "pii_type")
        named = rows.select(F.upper("table_name").alias("table_name"), F.lower("name").alias("column_name"), F.struct(F.col("declared_type").alias("type"), kind.alias("kind")).alias(side))
        return named.join(F.broadcast(differ), "table_name", "left_semi")

    both = fields(stored, "x").join(fields(current, "y"), ["table_name", "column_name"], "full")

    def change(when: F.Column, name: str, before: F.Column, after: F.Column) -> F.Column:
        return F.when(when, F.struct(F.lit(name).alias("change"), before.alias("before"), after.alias("after")))

    old, new = F.col("x").isNotNull(), F.col("y").isNotNull()
    found = F.array(
        change(~old, "added", F.lit(None).cast("string"), F.col("y.type")),
        change(~new, "dropped", F.col("x.type"), F.lit(None).cast("string")),
        change(old & new & ~F.col("x.type").eqNullSafe(F.col("y.type")), "retyped", F.col("x.type"), F.col("y.type")),
        change(old & new & (F.col("x.kind") != F.col("y.kind")), "reclassified", F.col("x.kind"), F.col("y.kind")),
    )
    return both.select("table_name", "column_name", F.explode(F.array_compact(found)).alias("c")).select("table_name", "column_name", "c.*")
