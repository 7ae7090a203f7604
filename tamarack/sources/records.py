"""Delimited records against their layout: what does not fit is kept aside with the reasons, never turned into null unseen."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns that ``read_records`` adds.
PROBLEMS, RECORD, FILE = "_problems", "_record", "_file"
DATE, TIMESTAMP = "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _value(text: Column, kind: T.DataType) -> Column:
    """The text as a value of the type, or null."""
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.DateType):
        return F.try_to_date(text, DATE)
    if isinstance(kind, T.TimestampType):
        return F.coalesce(F.try_to_timestamp(text, F.lit(TIMESTAMP)), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))
    return text.try_cast(kind)


def _problem(text: Column, value: Column, field: T.StructField) -> Column:
    """Why a field does not fit, or null."""
    kind, name = field.dataType, field.name
    out = F.when(text.isNull(), F.lit(None).cast("string") if field.nullable else F.lit(f"{name}: no value"))
    out = out.when(value.isNull(), F.lit(f"{name}: not of type {kind.simpleString()}"))
    if isinstance(kind, T.DecimalType):
        exact = text.try_cast(T.DecimalType(38, min(38 - kind.precision + kind.scale, 37)))
        out = out.when(exact.isNull() | (exact != value), F.lit(f"{name}: more than {kind.scale} decimals"))
    if isinstance(kind, T.StringType) and "max_length" in field.metadata:
        out = out.when(F.length(text) > field.metadata["max_length"], F.lit(f"{name}: longer than {field.metadata['max_length']}"))
    return out


def read_records(spark: SparkSession, path: str, schema: T.StructType, sep: str = "\x01") -> DataFrame:
    """Every line of the files at ``path`` as a row of ``schema``, with ``_problems``, ``_record`` (the line) and ``_file``.

    Empty fields are null; a separator behind the last field is allowed. A problem is a
    number of fields other than the schema's, a field that is empty but not nullable, not
    of its type, a text longer than ``max_length`` in the field's metadata, or a decimal
    with more places than declared. Rows with problems hold the values that fit.
    """
    lines = spark.read.text(path).select(F.col("value").alias(RECORD), F.col("_metadata.file_path").alias(FILE))
    parts, n = F.split(RECORD, re.escape(sep), -1), len(schema.fields)
    lines = lines.withColumn("_parts", F.when((F.size(parts) == n + 1) & (F.element_at(parts, -1) == ""), F.slice(parts, 1, n)).otherwise(parts))
    texts = [F.nullif(F.get("_parts", F.lit(k)), F.lit("")) for k in range(n)]
    values = [_value(t, f.dataType) for t, f in zip(texts, schema.fields)]
    count = F.when(F.size("_parts") != n, F.concat(F.lit("fields: "), F.size("_parts").cast("string"), F.lit(f" of {n}")))
    found = F.array(count, *(_problem(t, v, f) for t, v, f in zip(texts, values, schema.fields)))
    return lines.select(*(v.alias(f.name) for v, f in zip(values, schema.fields)), F.filter(found, lambda x: x.isNotNull()).alias(PROBLEMS), RECORD, FILE)


def split_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records without problems, in the schema's columns, and ``_file, _record, _problems`` of the others."""
    good = records.where(F.size(PROBLEMS) == 0).drop(PROBLEMS, RECORD, FILE)
    return good, records.where(F.size(PROBLEMS) > 0).select(FILE, RECORD, PROBLEMS)


def load_records(spark: SparkSession, path: str, schema: T.StructType, bad_path: str, sep: str = "\x01") -> DataFrame:
    """Records that fit; the others are written to ``bad_path`` as JSON."""
    good, bad = split_records(read_records(spark, path, schema, sep))
    bad.write.mode("overwrite").json(bad_path)
    return good
