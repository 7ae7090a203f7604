import pytest
from pyspark.sql import functions as F

from tamarack.operators import ranks


def rows(df):
    return sorted(map(str, df.collect()))


def frame(spark, n=5000):
    key = F.when(F.col("id") % 50 == 0, None).otherwise(F.md5(F.col("id").cast("string")))
    return spark.range(n).repartition(7).select(key.alias("k"), (F.col("id") % 10).alias("tie"), F.col("id").alias("_part"))


@pytest.mark.parametrize("n", [0, 1, 99, 100, 101, 1234, 4999, 5000, 9999])
def test_equals_a_sort(spark, n):
    df = frame(spark)
    assert rows(ranks.first_rows(df, ["k", "_part"], n, task_rows=100)) == rows(df.orderBy("k", "_part").limit(n))


def test_few_values(spark):
    df = frame(spark)
    got = ranks.first_rows(df, ["tie"], 1700, task_rows=100)
    assert sorted(r.tie for r in got.collect()) == sorted([t for t in range(10) for _ in range(500)])[:1700]


def test_copies_of_one_row_are_dealt_over_parts(spark):
    df = spark.range(4000).select(F.lit(1).alias("k"))
    got = ranks.first_rows(df, ["k"], 3000, task_rows=500)
    assert got.count() == 3000 and got.rdd.getNumPartitions() > 1


def test_a_wrong_sample_only_costs_time(spark, monkeypatch):
    df = frame(spark)
    monkeypatch.setattr(ranks, "_below", lambda df, *_: df.where("false"))
    assert rows(ranks.first_rows(df, ["k", "_part"], 1234, task_rows=100)) == rows(df.orderBy("k", "_part").limit(1234))


def test_the_sample_leaves_rows_out(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SAMPLE", 1000)
    df = frame(spark, 20_000)
    near = ranks._below(df, "k", 2000, 20_000, 0)
    assert 2000 <= near.count() < 6000
    plan = ranks.first_rows(df, ["k", "_part"], 2000, task_rows=100)
    assert rows(plan) == rows(df.orderBy("k", "_part").limit(2000))


def test_empty_table(spark):
    assert ranks.first_rows(frame(spark).where("false"), ["k"], 500, task_rows=100).collect() == []
