import re

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.functions.digits import digits_sql, mask_digits
from tamarack.operators import mask as masking

TYPES = {8: T.ByteType(), 16: T.ShortType(), 32: T.IntegerType(), 64: T.LongType()}


def masked(spark, values, kind, salt="s"):
    df = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("v", kind)]))
    return [r.m for r in df.select(mask_digits(F.col("v"), kind, salt).alias("m")).collect()]


@pytest.mark.parametrize("width", [1, 2, 3, 4, 5])
def test_all_texts_of_a_width(spark, width):
    values = [str(k).zfill(width) for k in range(10**width)]
    got = masked(spark, values, T.StringType())
    assert sorted(got) == values and not any(a == b for a, b in zip(values, got))


def test_nine_digits(spark):
    df = spark.range(200_000).select(F.lpad((F.col("id") * 4999).cast("string"), 9, "0").alias("v"))
    out = df.select("v", mask_digits(F.col("v"), T.StringType(), "s").alias("m"))
    assert out.select("m").distinct().count() == 200_000 and out.where("m = v or not m rlike '^[0-9]{9}$'").isEmpty()


def test_format_stays(spark):
    values = ["123-45-6789", "(555) 010-9999", "A1-b22", "12345678901234567890123456789012345x6", "٣", "no digits", "", " ", None, "　", "1" * 37]
    got = masked(spark, values, T.StringType())
    for v, m in zip(values[:4], got):
        assert m != v and re.sub("[0-9]", "0", m) == re.sub("[0-9]", "0", v)
    assert got[6:10] == ["", " ", None, "　"] and all(re.fullmatch("KEY_[0-9a-f]{32}", got[k]) for k in (4, 5, 10))
    same = masked(spark, ["123456789"], T.StringType())[0]
    assert got[0].replace("-", "") == same != masked(spark, ["123456789"], T.StringType(), "t")[0]


@pytest.mark.parametrize("bits", [8, 16])
def test_all_small_integers(spark, bits):
    values = list(range(-(2 ** (bits - 1)), 2 ** (bits - 1)))
    got = masked(spark, values, TYPES[bits])
    assert sorted(got) == values
    for v, m in zip(values, got):
        assert len(str(v)) == len(str(m)) and (v < 0) == (m < 0)
    assert sum(v == m for v, m in zip(values, got)) <= 1  # parts of one value have no other


@pytest.mark.parametrize("bits", [32, 64])
def test_integers_at_the_ends_of_their_type(spark, bits):
    end = 2 ** (bits - 1)
    values = [0, 5, 9, -1, -9, 10, 99, 100, 12345, end - 1, end - 2, -end, 1 - end, end // 2, *(end - 1000 - k * 7919 for k in range(200)), None]
    got = masked(spark, values, TYPES[bits])
    assert len(set(got)) == len(values) and got[-1] is None and all(-end <= m < end and m != v and len(str(m)) == len(str(v)) for v, m in zip(values[:-1], got))


def test_sql_is_equal(spark):
    db = duckdb.connect()
    for bits, kind in TYPES.items():
        values = [0, 7, -7, 10, 99, 100, 127, -128, 2 ** (bits - 1) - 1, -(2 ** (bits - 1)), 2 ** (bits - 2) + 3]
        db.execute("CREATE OR REPLACE TABLE t AS SELECT unnest(?::BIGINT[]) AS v", [values])
        assert dict(db.execute(f"SELECT v, masked FROM ({digits_sql('t', 'v', 's', bits)})").fetchall()) == dict(zip(values, masked(spark, values, kind)))
    texts = ["1", "42", "123-45-6789", "a12b345", "9" * 36]
    db.execute("CREATE OR REPLACE TABLE t AS SELECT unnest(?::VARCHAR[]) AS v", [texts])
    assert dict(db.execute(f"SELECT v, masked FROM ({digits_sql('t', 'v', 's')})").fetchall()) == dict(zip(texts, masked(spark, texts, T.StringType())))


def test_tables_keep_types_and_joins(spark):
    a = spark.range(500).select(F.col("id").cast("int").alias("acct_nbr"), F.lpad(F.col("id").cast("string"), 5, "0").alias("zip_cd"), F.lit("Acme").alias("bus_name"))
    columns = masking.mask_columns(a, {"acct_nbr": "IDENTIFIER"}, keep_format=True)
    assert columns == {"acct_nbr": "DIGITS", "zip_cd": "DIGITS", "bus_name": "PERSON_NAME"}
    out = masking.mask(a, columns, "s", {"zip_cd": 2})
    assert out.schema["acct_nbr"].dataType == T.IntegerType() and out.select("acct_nbr").distinct().count() == 500 == out.where("length(zip_cd) = 5").select("zip_cd").distinct().count()
    assert out.join(masking.mask(a.select("acct_nbr"), {"acct_nbr": "DIGITS"}, "s"), "acct_nbr").count() == 500
