import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tamarack.functions.masks import TYPES, mask_value
from tamarack.operators import mask as masking
from tamarack.plans.mask_sql import mask_sql

VALUES = ["\t", "\n \u00a0", "John Doe", "Acme", "123 Main", "", "  ", None, "Ashport", "NY", "12345", "Ünï", "x" * 5000]
SHAPES = {
    "ZIP": r"\d{5}", "SSN": r"\d{3}-\d{2}-\d{4}", "PHONE": r"\d{3}-\d{3}-\d{4}", "STATE": "[A-Z]{2}", "EMAIL": r"[a-z]+\.[a-z]+\d\d@example\.com",
    "KEY": "KEY_[0-9a-f]{32}", "GENERIC_PII": "MASKED_[a-z]{4}", "PERSON_NAME": r"\w+ \w+", "STREET_ADDRESS": r"\d+ [\w ]+", "CITY": r"[\w ]+",
}


@pytest.mark.parametrize("kind", TYPES)
def test_masks(spark, kind):
    df = spark.createDataFrame([(v,) for v in VALUES], "v string")
    got = [r.m for r in df.select(mask_value(F.col("v"), kind, "s").alias("m")).collect()]
    assert got[:2] == VALUES[:2] and got[5:8] == ["", "  ", None]
    for v, m in zip(VALUES, got):
        if v and v.strip():
            assert re.fullmatch(SHAPES[kind], m) and m != v
    db = duckdb.connect()
    sql = [db.execute(f"SELECT {mask_sql('$1', kind, 's')}", [v]).fetchone()[0] for v in VALUES]
    assert sql == got


def test_a_mask_depends_on_value_type_and_salt_alone(spark):
    a = spark.createDataFrame([("John Doe",)], "bus_nm string")
    b = spark.createDataFrame([("John Doe", 1)], "bus_nm string, k int")
    one = masking.mask(a, masking.mask_columns(a), "s").first().bus_nm
    assert one == masking.mask(b, {"bus_nm": "PERSON_NAME"}, "s").first().bus_nm != "John Doe"
    assert len({masking.mask(a, {"bus_nm": k}, s).first().bus_nm for k in ("PERSON_NAME", "CITY") for s in ("s", "t", "u")}) > 2


def test_routes(spark):
    df = spark.createDataFrame([("a", "b", "c", "d", 1)], "acct_cty_nm string, addr_match_nbr string, tax_id string, plain string, k int")
    assert masking.mask_columns(df) == {"acct_cty_nm": "CITY", "addr_match_nbr": "STREET_ADDRESS", "tax_id": "GENERIC_PII"}
    assert masking.mask_columns(df, {"tax_id": "IDENTIFIER", "plain": "PHONE"}, protect=("ADDR_MATCH_NBR",)) == {"acct_cty_nm": "CITY", "tax_id": "IDENTIFIER", "plain": "PHONE"}


def test_numbers_become_text_and_lengths_are_kept_on_request(spark):
    df = spark.createDataFrame([(7, "A")], "n int, exec_mid_init string")
    out = masking.mask(df, {"n": "ZIP", "exec_mid_init": "PERSON_NAME"}, "s", {"exec_mid_init": 1}).first()
    assert re.fullmatch(r"\d{5}", out.n) and len(out.exec_mid_init) == 1


def test_statistics_and_sample(spark):
    df = spark.createDataFrame([(1, "a", None), (2, " ", "x"), (3, "", "y")], "k int, b_name string, c_city string")
    columns = masking.mask_columns(df)
    row = masking.mask_stats(df, columns, "t").first()
    assert (row.pii_fields, row.rows_masked, row.total_values_masked) == (2, 3, 4)
    rows = {r.column_name: r for r in masking.before_after(df, masking.mask(df, columns, "s"), "k", columns, "t").collect()}
    assert rows["b_name"].before == "a" and rows["b_name"].after != "a" and rows["c_city"].after is None
    assert masking.mask_stats(df.where("false"), columns, "t").first().total_values_masked == 0


def test_masked_keys_still_join(spark):
    a = spark.range(200).select(F.col("id").alias("k"))
    masked = masking.mask(a, {"k": "SSN"}, "s")
    assert masked.distinct().count() == 200 == masked.join(masked, "k").count()


def test_white_space_stays_and_keys_stay_apart(spark):
    rows = [(k, v, f"key {k}") for k, v in enumerate(["\t", "\n", " \r\n ", "\u00a0", "", None, "x\t", "KEY_"])]
    df = spark.createDataFrame(rows, "id int, name string, __hash0 string")
    got = masking.mask(df, {"name": "PERSON_NAME", "__hash0": "KEY"}, "salt").orderBy("id").collect()
    assert [r.name for r in got[:6]] == [r[1] for r in rows[:6]] and all(r.name not in ("x\t", "KEY_") for r in got[6:])
    assert len({r["__hash0"] for r in got}) == len(rows) and all(r["__hash0"].startswith("KEY_") for r in got)
    many = masking.mask(spark.range(200_000).toDF("k"), {"k": "KEY"}, "salt")
    assert many.distinct().count() == 200_000
