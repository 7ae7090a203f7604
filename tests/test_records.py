from pyspark.sql import types as T

from tamarack.sources import catalog, ddl, records

SCHEMA = T.StructType(
    [
        T.StructField("n", T.IntegerType(), False),
        T.StructField("s", T.StringType(), True, {"max_length": 3}),
        T.StructField("d", T.DateType()),
        T.StructField("x", T.DecimalType(5, 2)),
        T.StructField("t", T.TimestampType()),
    ]
)


def test_every_line_is_kept_or_named(spark, tmp_path):
    lines = {
        "1\x01ab\x012024-01-31\x011.25\x012024-01-31 01:02:03.000004": [],
        "2\x01\x01\x01\x01": [],
        "3\x01ab\x012024-01-31\x01-7\x01\x01": [],
        "zz\x01ab\x01\x01\x01": ["n: not of type int"],
        "\x01ab\x01\x01\x01": ["n: no value"],
        "4\x01abcd\x01\x01\x01": ["s: longer than 3"],
        "5\x01\x012024-02-30\x01\x01": ["d: not of type date"],
        "6\x01\x01\x011.255\x01": ["x: more than 2 decimals"],
        "7\x01\x01\x0112345\x01": ["x: not of type decimal(5,2)"],
        "8\x01\x01\x01\x01noon": ["t: not of type timestamp"],
        "9\x01ab": ["fields: 2 of 5"],
        "10\x01\x01\x01\x01\x01x\x01": ["fields: 7 of 5"],
        "": ["fields: 1 of 5", "n: no value"],
        "99999999999\x01abcd\x01x\x01\x01": ["n: not of type int", "s: longer than 3", "d: not of type date"],
    }
    path = tmp_path / "records.dat"
    path.write_text("\n".join(lines) + "\n")
    found = records.read_records(spark, str(path), SCHEMA).collect()
    assert {r["_record"]: r["_problems"] for r in found} == lines
    good, bad = records.split_records(records.read_records(spark, str(path), SCHEMA))
    assert (good.count(), bad.count()) == (3, 11) and good.columns == SCHEMA.names
    kept = records.load_records(spark, str(path), SCHEMA, str(tmp_path / "bad"))
    assert kept.count() == 3 and spark.read.json(str(tmp_path / "bad")).count() == 11
    assert [r.x for r in kept.orderBy("n").collect()][0] is not None


def fields(spark, text):
    texts = spark.createDataFrame([(text, "f.sql")], "text string, file string")
    rows = catalog.parse_ddl(texts).orderBy("table_name", "ordinal").collect()
    return [(r.table_name, r.name, r.declared_type, r.not_null) for r in rows], catalog.parse_ddl_tables(texts).orderBy("table_name").collect()


def test_quotes_comments_and_depth(spark):
    text = """-- CREATE TABLE not_this (a INTEGER);
    CREATE MULTISET TABLE db.t ,FALLBACK ( -- note, one (two
      a INTEGER NOT NULL, /* b CHAR(1), ) */
      c CHAR(3) COMPRESS ('x','y;z'),
      d DECIMAL(10,2) DEFAULT 1 CHECK ((d > 0) AND (d IN (1, 2, 3))),
      e VARCHAR(9) DEFAULT 'NOT NULL; it''s -- no, comment',
      "Odd, Name" DATE FORMAT 'YYYY-MM-DD' NOT NULL,
      CONSTRAINT k CHECK (a > 0 AND (c <> ')' OR e = '(')),
      f SMALLINT
    ) UNIQUE PRIMARY INDEX px ( a ,"c" );
    CREATE SET TABLE "u" (z TIMESTAMP(6))
    CREATE TABLE v (y BIGINT;
    CREATE TABLE w AS x"""
    found, tables = fields(spark, text)
    assert found == [
        ("T", "a", "INTEGER", True), ("T", "c", "CHAR(3)", False), ("T", "d", "DECIMAL(10,2)", False), ("T", "e", "VARCHAR(9)", False), ("T", "odd, name", "DATE", True), ("T", "f", "SMALLINT", False),
        ("U", "z", "TIMESTAMP(6)", False), ("V", "y", "BIGINT", False),
    ]
    assert [(r.table_name, r.index_columns, r.index_unique, r.index_name, r.fallback, r.is_multiset) for r in tables][:2] == [("T", ["a", "c"], True, "px", True, True), ("U", [], False, None, False, False)]


def test_texts_without_statements_and_open_quotes():
    assert ddl.statements("") == [] and ddl.statements("SELECT 'CREATE TABLE t (a INTEGER)'") == []
    open_quote = ddl.statements("CREATE TABLE t (a CHAR(1) DEFAULT 'x, b INTEGER)")
    assert len(open_quote) == 1 and len(open_quote[0].items) == 1
    assert [len(s.items) for s in ddl.statements("CREATE TABLE t (a INTEGER, b INTEGER /* open")] == [2]
    code, shape = ddl.shaped("a /* ' */ 'b''c' -- \"")
    assert len(code) == len(shape) and code.split() == ["a", "'b''c'"] and shape.split() == ["a", "'____'"]
