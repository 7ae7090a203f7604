import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from schemas import ROWS, ddl, layout
from tamarack.sources import catalog


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("schemas")
    (d / "dml").mkdir()
    (d / "ddl").mkdir()
    for t in ROWS:
        (d / "dml" / f"{t}.dml").write_text(layout(t, typed=t == "etl_src_ctl"))
    (d / "ddl" / "both.sql").write_text(ddl("etl_cyc_ctl") + "\n" + ddl("etl_src_ctl", index="PRIMARY INDEX ( ETL_CYC_DT )"))
    (d / "ddl" / "extra.sql").write_text(ddl("business_credit_score").replace("business_credit_score", "other_table"))
    return d


def test_layouts_give_every_field(spark, files):
    rows = catalog.fields_from_layouts(spark, f"{files}/dml/*.dml").collect()
    by = {}
    for r in rows:
        by.setdefault(r.table_name.lower(), []).append(r)
    assert {t: len(r) for t, r in by.items()} == {t: len(r) for t, r in ROWS.items()}
    for t, expected in ROWS.items():
        got = sorted(by[t], key=lambda r: r.ordinal)
        assert [r.name for r in got] == [x[1] for x in expected]
        assert [r.declared_type for r in got] == [x[2] for x in expected]
        assert [r.not_null for r in got] == [x[4] == "yes" for x in expected]
        assert all(r.is_typed == (t == "etl_src_ctl") for r in got)


def test_layout_details(spark, files):
    rows = {(r.table_name, r.name): r for r in catalog.fields_from_layouts(spark, f"{files}/dml/*.dml").collect()}
    r = rows["ETL_CYC_CTL", "etl_cyc_strt_ts"]
    assert (r.base_type, r.format, r.delimiter, r.default_null, r.source_db) == ("datetime", "YYYY-MM-DD HH24:MI:SS.NNNNNN", "\\x01", "", "FIN")
    assert rows["STG_BUSINESS_ENTITY", "bus_short_name"].max_length == 30
    assert rows["ETL_SRC_CTL", "src_cd"].source_table is None  # no header: the name comes from the file


def test_single_lines(spark):
    text = 'record\n // note\n  decimal("\\x01",0, maximum_length=7, sign_reserved) amount = NULL("0") /*DECIMAL(5,2)*/;\n\n  string("\\x01") plain;\n  string(1) newline = "\\n";\nend\n  string("\\x01") outside;\n'
    rows = catalog.parse_layouts(spark.createDataFrame([(text, "/x/Some_Table.dml")], "text string, file string")).collect()
    assert [(r.table_name, r.name, r.declared_type, r.sign_reserved, r.default_null, r.max_length) for r in rows] == [("SOME_TABLE", "amount", "DECIMAL(5,2)", True, "0", 7), ("SOME_TABLE", "plain", "VARCHAR", False, None, None)]


def test_empty_text(spark):
    empty = spark.createDataFrame([("", "/a.dml"), ("nothing here", "/b.sql")], "text string, file string")
    assert catalog.parse_layouts(empty).count() == catalog.parse_ddl(empty).count() == catalog.parse_ddl_tables(empty).count() == 0


def test_ddl_fields_and_indexes(spark, files):
    rows = catalog.fields_from_ddl(spark, f"{files}/ddl").collect()
    got = sorted((r for r in rows if r.table_name == "ETL_SRC_CTL"), key=lambda r: r.ordinal)
    assert [(r.name, r.declared_type, r.not_null) for r in got] == [(x[1], x[2], x[4] == "yes") for x in ROWS["etl_src_ctl"]]
    tables = {r.table_name: r for r in catalog.tables_from_ddl(spark, f"{files}/ddl").collect()}
    assert tables["ETL_CYC_CTL"].index_columns == ["a", "b"] and tables["ETL_CYC_CTL"].index_unique and tables["ETL_CYC_CTL"].index_name == "PK"
    assert tables["ETL_SRC_CTL"].index_columns == ["etl_cyc_dt"] and not tables["ETL_SRC_CTL"].index_unique and tables["ETL_SRC_CTL"].index_name is None
    assert all(r.is_multiset and r.fallback for r in tables.values())


def test_merge_prefers_layouts(spark, files):
    both = catalog.merge_catalog(catalog.fields_from_layouts(spark, f"{files}/dml/*.dml"), catalog.fields_from_ddl(spark, f"{files}/ddl"))
    kinds = {(r.table_name, r.kind) for r in both.select("table_name", "kind").distinct().collect()}
    assert ("OTHER_TABLE", "ddl") in kinds and ("ETL_CYC_CTL", "dml") in kinds and ("ETL_CYC_CTL", "ddl") not in kinds
    order = {r.table_name: r.table_order for r in both.select("table_name", "table_order").distinct().collect()}
    assert sorted(order.values()) == list(range(1, 7)) and order["OTHER_TABLE"] == 6 and order["BUSINESS_ADDRESS_MATCH"] == 1


def test_struct_type_and_delimited_records(spark, files, tmp_path):
    fields = catalog.fields_from_layouts(spark, f"{files}/dml/*.dml")
    schema = catalog.to_struct_type(fields, "etl_cyc_ctl")
    assert schema["etl_cyc_dt"].dataType == T.DateType() and schema["etl_cyc_id"].dataType == T.LongType() and not schema["etl_cyc_dt"].nullable
    (tmp_path / "r.dat").write_text("2024-10-01\x01P1\x012024-10-01 06:00:00.000001\x01\x01DAILY\x01\x017\n")
    row = catalog.read_delimited(spark, str(tmp_path / "r.dat"), schema).first()
    assert row.etl_cyc_dt == datetime.date(2024, 10, 1) and row.etl_cyc_end_ts is None and row.etl_cyc_sts_cd is None and row.etl_cyc_id == 7
    assert row.etl_cyc_strt_ts.microsecond == 1


def test_fields_of_tables(spark):
    df = spark.createDataFrame([("ab", 1), (None, 2)], "name string, n int")
    rows = catalog.fields_from_tables(spark, {"t": df, "e": df.where("false")}).orderBy("table_order", "ordinal").collect()
    assert [(r.table_name, r.name, r.max_length, r.null_count, r.row_count, r.not_null) for r in rows[:2]] == [("T", "name", 2, 1, 2, False), ("T", "n", None, 0, 2, True)]
    assert rows[2].row_count == 0


def test_type_text(spark):
    row = spark.createDataFrame([("DECIMAL(15,0)",)], "d string").select(catalog.base_type(F.col("d")).alias("b"), catalog.type_length(F.col("d")).alias("n")).first()
    assert (row.b, row.n) == ("DECIMAL", 15)
    assert catalog.spark_type("decimal (3)") == T.DecimalType(3, 0) and catalog.spark_type("NUMBER") == T.DecimalType(38, 0) and catalog.spark_type("VARCHAR(9)") == T.StringType()


def test_ddl_types_without_a_size(spark):
    text = "CREATE TABLE db.t (a CHAR NOT NULL, b VARCHAR, c CHAR(3), d VARCHAR ( 7 ) CHARACTER SET LATIN, e DECIMAL, CHARACTERISTIC (a))"
    rows = catalog.parse_ddl(spark.createDataFrame([(text, "f.sql")], "text string, file string")).orderBy("ordinal").collect()
    assert [(r.name, r.declared_type, r.max_length, r.not_null) for r in rows] == [("a", "CHAR", None, True), ("b", "VARCHAR", None, False), ("c", "CHAR(3)", 3, False), ("d", "VARCHAR(7)", 7, False), ("e", "DECIMAL", None, False)]


def test_unmeasured_fields_count_rows_only(spark):
    df = spark.createDataFrame([("ab",), (None,)], "x string")
    r = catalog.fields_from_tables(spark, {"t": df}, measured=False).first()
    assert (r.name, r.row_count, r.max_length, r.null_count, r.not_null) == ("x", 2, None, None, None)
