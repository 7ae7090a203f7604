"""Catalogs of fields and tables, from record layouts, DDL files or tables themselves.

``fields`` rows: ``table_name, source_db, source_table, ordinal, name, base_type,
declared_type, max_length, not_null, default_null, format, delimiter,
sign_reserved, is_typed, file, kind``. Files are read whole, a row each. Layouts are
taken apart by regular expressions in Spark; DDL first goes through ``ddl.statements``,
which knows quoted text, comments and the depth of parentheses.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.sources import ddl

FIELDS = (
    "table_name string, source_db string, source_table string, ordinal int, name string, base_type string, declared_type string, max_length int, "
    "not_null boolean, default_null string, format string, delimiter string, sign_reserved boolean, is_typed boolean, file string, kind string"
)
TABLES = "table_name string, source_db string, is_multiset boolean, fallback boolean, index_columns array<string>, index_unique boolean, index_name string, file string"
COLUMNS = [x.split()[0] for x in FIELDS.split(", ")]

_DECLARED = r"(?i)\b((?:VAR)?CHAR\s*\(\s*\d+\s*\)|BIGINT|SMALLINT|INTEGER|FLOAT|(?:DECIMAL|NUMERIC|NUMBER)\s*(?:\(\s*\d+\s*(?:,\s*\d+\s*)?\))?|DATE|TIMESTAMP\s*(?:\(\s*\d+\s*\))?)"
#: In DDL the size of a character type may be left out.
_DDL_DECLARED = _DECLARED.replace(r"CHAR\s*\(\s*\d+\s*\)", r"CHAR\b\s*(?:\(\s*\d+\s*\))?", 1)
_FIELD = r"^\s*(string|decimal|datetime|date)\s*\(.*\)\s*\w+\s*(=\s*NULL\(\"[^\"]*\"\))?\s*(/\*.*\*/)?\s*;\s*(/\*.*\*/)?\s*$"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group, or null where the pattern does not match or the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _tight(declared: Column) -> Column:
    return F.upper(F.regexp_replace(declared, r"\s+", ""))


def base_type(declared: Column) -> Column:
    """Type name without parameters."""
    return F.regexp_extract(declared, r"^(\w+)", 1)


def type_length(declared: Column) -> Column:
    """First number in parentheses."""
    return _found(declared, r"\((\d+)").cast("int")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\r\n?", "\n").alias("text"), F.col("_metadata.file_path").alias("file"))


def parse_layouts(texts: DataFrame) -> DataFrame:
    """``fields`` of layouts ``texts(text, file)``; text without fields gives no rows."""
    text = F.col("text")
    body = F.regexp_extract(text, r"(?s)(?:^|\n)\s*record\b(.*?)\n\s*end\b", 1)
    head = r"(?is)DML Generated for SQL:.*?\bFROM\s+(?:(\w+)\.)?(\w+)"
    name = F.coalesce(_found(text, head, 2), F.regexp_extract("file", r"([^/\\]*?)(?:\.[^./\\]*)?$", 1))
    rows = texts.select(
        F.upper(name).alias("table_name"),
        _found(text, head, 1).alias("source_db"),
        _found(text, head, 2).alias("source_table"),
        text.rlike(r"(?m)^\s*(metadata\s+)?type\s+(\w+\s*)?=").alias("is_typed"),
        "file",
        F.posexplode(F.filter(F.split(body, "\n"), lambda x: x.rlike(_FIELD) & ~x.rlike(r"\bnewline\s*="))).alias("pos", "line"),
    )
    line = F.col("line")
    code = F.regexp_replace(line, r"/\*.*?\*/", "")
    comment = F.regexp_extract(line, r"/\*(.*?)\*/", 1)
    base = F.regexp_extract(line, r"^\s*(\w+)", 1)
    plain = F.create_map(*(F.lit(x) for x in ("string", "VARCHAR", "decimal", "DECIMAL(38,0)", "date", "DATE", "datetime", "TIMESTAMP")))
    return rows.select(
        "table_name",
        "source_db",
        "source_table",
        (F.col("pos") + 1).alias("ordinal"),
        F.regexp_extract(code, r"\)\s*(\w+)\s*(?:=\s*NULL\(\"[^\"]*\"\))?\s*;", 1).alias("name"),
        base.alias("base_type"),
        F.coalesce(_tight(_found(comment, _DECLARED)), plain[base]).alias("declared_type"),
        _found(code, r"maximum_length\s*=\s*(\d+)").cast("int").alias("max_length"),
        comment.rlike(r"(?i)\bNOT\s+NULL\b").alias("not_null"),
        F.when(code.rlike("NULL\\("), F.regexp_extract(code, r"NULL\(\"([^\"]*)\"\)", 1)).alias("default_null"),
        _found(code, r"\(\"(YYYY[^\"]*)\"\)").alias("format"),
        _found(code, r"\"(\\x[0-9a-fA-F]{2})\"").alias("delimiter"),
        code.contains("sign_reserved").alias("sign_reserved"),
        "is_typed",
        "file",
        F.lit("dml").alias("kind"),
    )


def fields_from_layouts(spark: SparkSession, path: str) -> DataFrame:
    """``fields`` of all layout files at ``path``."""
    return parse_layouts(_files(spark, path))


_STATEMENT = pa.schema([("file", pa.string()), ("head", pa.string()), ("items", pa.list_(pa.string())), ("shapes", pa.list_(pa.string())), ("tail", pa.string())])


def _statements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [{"file": r["file"], **found._asdict()} for r in batch.to_pylist() for found in ddl.statements(r["text"] or "")]
        yield pa.RecordBatch.from_pylist(rows, schema=_STATEMENT)


def _blocks(texts: DataFrame) -> DataFrame:
    found = texts.select("text", "file").mapInArrow(_statements, "file string, head string, items array<string>, shapes array<string>, tail string")
    name = r'(?is)^CREATE\s+((?:MULTI)?SET\s+)?TABLE\s+(?:"?(\w+)"?\s*\.\s*)?"?(\w+)"?'
    head = F.col("head")
    return found.select(
        F.upper(F.regexp_extract(head, name, 3)).alias("table_name"),
        _found(head, name, 2).alias("source_db"),
        F.regexp_extract(head, name, 3).alias("source_table"),
        F.regexp_extract(head, name, 1).rlike("(?i)multiset").alias("is_multiset"),
        head.rlike(r"(?i),\s*FALLBACK\b").alias("fallback"),
        "items",
        "shapes",
        "tail",
        "file",
    )


def parse_ddl(texts: DataFrame) -> DataFrame:
    """``fields`` of DDL ``texts(text, file)``; a file may create several tables. Names are in lower case.

    What stands in quotes or comments counts as no part of the DDL but for quoted names and formats.
    """

    def spaced(x: Column) -> Column:
        return F.trim(F.regexp_replace(x, r"\s+", " "))

    both = F.arrays_zip(F.transform("items", spaced).alias("line"), F.transform("shapes", spaced).alias("shape"))
    declares = r'^(?:"[^"]*"|\w+) ' + _DDL_DECLARED.replace(r"\b", "", 1)
    rows = _blocks(texts).select("table_name", "source_db", "source_table", "file", F.posexplode(F.filter(both, lambda x: x["shape"].rlike(declares))).alias("pos", "x"))
    line, shape, named = F.col("x.line"), F.col("x.shape"), r'^(?:"([^"]*)"|(\w+))'
    declared = _tight(F.regexp_extract(F.regexp_replace(shape, named + " ", ""), _DDL_DECLARED, 1))
    return rows.select(
        "table_name",
        "source_db",
        "source_table",
        (F.col("pos") + 1).alias("ordinal"),
        F.lower(F.coalesce(_found(line, named, 1), _found(line, named, 2))).alias("name"),
        base_type(declared).alias("base_type"),
        declared.alias("declared_type"),
        F.when(declared.rlike("CHAR"), type_length(declared)).alias("max_length"),
        shape.rlike(r"(?i)\bNOT NULL\b").alias("not_null"),
        F.lit(None).cast("string").alias("default_null"),
        F.when(shape.rlike(r"(?i)\bFORMAT '"), _found(line, r"(?i)FORMAT '([^']*)'")).alias("format"),
        F.lit(None).cast("string").alias("delimiter"),
        F.lit(False).alias("sign_reserved"),
        F.lit(False).alias("is_typed"),
        "file",
        F.lit("ddl").alias("kind"),
    )


def parse_ddl_tables(texts: DataFrame) -> DataFrame:
    """``tables`` of DDL texts: kind of table and primary index."""
    index = r"(?is)\b(UNIQUE\s+)?PRIMARY\s+INDEX\s*(\w*)\s*\(([^)]*)\)"
    tail = F.col("tail")
    listed = F.regexp_extract(tail, index, 3)
    return _blocks(texts).select(
        "table_name",
        "source_db",
        "is_multiset",
        "fallback",
        F.when(listed != "", F.transform(F.split(listed, ","), lambda x: F.lower(F.trim(F.regexp_replace(x, '"', ""))))).otherwise(F.array().cast("array<string>")).alias("index_columns"),
        (F.regexp_extract(tail, index, 1) != "").alias("index_unique"),
        _found(tail, index, 2).alias("index_name"),
        "file",
    )


def fields_from_ddl(spark: SparkSession, path: str) -> DataFrame:
    """``fields`` of all DDL files at ``path``."""
    return parse_ddl(_files(spark, path))


def tables_from_ddl(spark: SparkSession, path: str) -> DataFrame:
    """``tables`` of all DDL files at ``path``."""
    return parse_ddl_tables(_files(spark, path))


def merge_catalog(layout: DataFrame, ddl: DataFrame) -> DataFrame:
    """Layout fields, and DDL fields of tables that have no layout; ``table_order`` numbers tables, layouts first by file."""
    known = layout.select("table_name").distinct()
    both = layout.unionByName(ddl.join(known, "table_name", "left_anti"))
    return with_order(both)


def with_order(fields: DataFrame) -> DataFrame:
    """``fields`` with ``table_order``: by kind (layouts first), then file, then name."""
    from pyspark.sql import Window

    tables = fields.groupBy("table_name").agg(F.min(F.struct(F.when(F.col("kind") == "dml", 0).otherwise(1), "file", "table_name")).alias("at"))
    order = tables.select("table_name", F.row_number().over(Window.orderBy("at")).alias("table_order"))  # a row per table
    return fields.join(F.broadcast(order), "table_name")


def fields_from_tables(spark: SparkSession, dfs: dict[str, DataFrame], measured: bool = True) -> DataFrame:
    """``fields`` of given tables, with ``table_order``, and from one pass over each: longest text, rows, and nulls.

    ``max_length`` is the longest text of a string column; ``not_null`` says that no value is null.
    Where ``measured`` is false only rows are counted, so that no column is read; lengths and nulls are null.
    """
    parts = []
    for order, (table, df) in enumerate(dfs.items(), 1):
        entries = []
        for k, f in enumerate(df.schema.fields):
            c = F.col(f"`{f.name}`")
            size = F.max(F.length(c)) if measured and isinstance(f.dataType, T.StringType) else F.lit(None)
            nulls = F.count("*") - F.count(c) if measured else F.lit(None).cast("long")
            entries.append(
                F.struct(
                    F.lit(k + 1).alias("ordinal"), F.lit(f.name).alias("name"), F.lit(f.dataType.typeName()).alias("base_type"), F.lit(f.dataType.simpleString()).alias("declared_type"),
                    size.cast("int").alias("max_length"), nulls.alias("null_count"), F.count("*").alias("row_count"),
                )
            )
        rows = df.agg(F.array(*entries).alias("x")).select(F.explode("x").alias("x")).select("x.*")
        parts.append(
            rows.select(
                F.lit(table.upper()).alias("table_name"), F.lit(None).cast("string").alias("source_db"), F.lit(table).alias("source_table"), "ordinal", "name", "base_type", "declared_type", "max_length",
                (F.col("null_count") == 0).alias("not_null"), F.lit(None).cast("string").alias("default_null"), F.lit(None).cast("string").alias("format"), F.lit(None).cast("string").alias("delimiter"),
                F.lit(False).alias("sign_reserved"), F.lit(False).alias("is_typed"), F.lit(table).alias("file"), F.lit("table").alias("kind"), F.lit(order).alias("table_order"), "null_count", "row_count",
            )
        )
    return reduce(DataFrame.unionByName, parts)


_SIMPLE = {"INTEGER": T.IntegerType(), "SMALLINT": T.ShortType(), "BIGINT": T.LongType(), "FLOAT": T.DoubleType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampType()}


def spark_type(declared: str) -> T.DataType:
    """The Spark type of a declared one; character types are strings."""
    base, _, rest = declared.upper().replace(" ", "").partition("(")
    if base in ("DECIMAL", "NUMERIC", "NUMBER"):
        p, _, s = rest.rstrip(")").partition(",")
        return T.DecimalType(int(p or 38), int(s or 0))
    return _SIMPLE.get(base, T.StringType())


def to_struct_type(fields: DataFrame, table: str) -> T.StructType:
    """The schema of one table; only its field rows reach the driver. ``max_length`` is kept as metadata."""
    rows = fields.where(F.lower("table_name") == table.lower()).orderBy("ordinal").select("name", "declared_type", "not_null", "max_length").collect()
    return T.StructType([T.StructField(r.name, spark_type(r.declared_type), not r.not_null, {} if r.max_length is None else {"max_length": r.max_length}) for r in rows])


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = "\x01") -> DataFrame:
    """Records of delimited files by a declared schema; empty values are null, and so are values that do not fit.

    ``records.read_records`` keeps records that do not fit aside instead.
    """
    return spark.read.csv(path, schema=schema, sep=sep, nullValue="", dateFormat="yyyy-MM-dd", timestampFormat="yyyy-MM-dd HH:mm:ss.SSSSSS", quote="")
