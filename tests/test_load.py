import pytest
from pyspark.sql import functions as F

from tamarack.operators import validate
from tamarack.sources import tables
from tamarack.sources.tables import Target


def test_checks(spark):
    df = spark.createDataFrame([(1, "a", ""), (2, None, None)], "bus_id int, x_nbr string, other string")
    assert validate.key_columns(df) == ["bus_id", "x_nbr"]
    rows = {r.check_name: r for r in validate.validate_table(df, "t", 2, ["BUS_ID", "gone"]).collect()}
    assert rows["row_count"].passed and rows["data_not_empty"].passed and not rows["column_existence"].passed and rows["column_existence"].actual == "gone"
    assert rows["not_null_bus_id"].passed and not rows["not_null_x_nbr"].passed and rows["not_null_x_nbr"].actual == "1"
    none = {r.check_name: r for r in validate.validate_table(df.where("false"), "t", 1, []).collect()}
    assert not none["row_count"].passed and not none["data_not_empty"].passed and none["not_null_bus_id"].passed
    nulls = spark.createDataFrame([(None,)], "x string")
    assert not validate.check_not_empty(nulls, "t").first().passed


def test_rollup(spark):
    schema = "table_name string, check_name string, expected string, actual string, passed boolean"

    def status(*passed, failed=0):
        return validate.validation_rollup(spark.createDataFrame([("t", "c", "", "", p) for p in passed], schema), failed).first().status

    assert [status(True, True), status(True, False), status(False), status(), status(True, failed=1)] == ["PASSED", "PARTIAL", "FAILED", "FAILED", "FAILED"]


def test_loads_replace_and_skip(spark, tmp_path):
    a = spark.range(3).withColumn("v", F.lit("x"))
    summary, loaded = tables.load_all({"A": a, "empty": a.where("false")}, str(tmp_path))
    rows = {r.table_name: r for r in summary.collect()}
    assert (rows["A"].rows_loaded, rows["A"].status) == (3, "loaded") and rows["empty"].status == "skipped" and set(loaded) == {"A"}
    tables.load_all({"A": a.limit(1)}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 1
    bad, _ = tables.load_all({"bad": a.select(F.raise_error(F.lit("no")).alias("x"), "id"), "A": a}, str(tmp_path))
    assert {r.table_name: r.status for r in bad.collect()} == {"bad": "failed", "A": "loaded"}


def test_sources_and_csv(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "b.parquet"))
    spark.range(2).write.parquet(str(tmp_path / "sqlite_x.parquet"))
    assert [r.table_name for r in tables.list_tables(spark, str(tmp_path)).collect()] == ["b"]
    assert tables.read_source(spark, "b", str(tmp_path)).count() == 2
    path = tables.write_csv(spark.range(2), str(tmp_path), "req", "b")
    assert path.endswith("req/B_subset") and spark.read.option("header", True).csv(path).columns == ["id"]
    tables.create_empty(spark, {"C": spark.range(1).schema}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 0
    assert tables.load_summary({"b": spark.range(4)}).first().rows_loaded == 4


def test_a_failing_switch_keeps_the_old_rows(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "a")
    tables.load_table(spark.range(3), str(tmp_path), "A")
    with pytest.raises(Exception):
        tables._switch(spark, path)  # nothing stands aside
    assert spark.read.parquet(path).count() == 3
    tables.load_table(spark.range(5), str(tmp_path), "A")
    assert spark.read.parquet(path).count() == 5 and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["a"]


def test_targets_in_the_catalog_and_over_jdbc(spark, tmp_path):
    spark.sql(f"CREATE DATABASE loads LOCATION '{tmp_path}/db'")
    targets = Target(database="loads"), Target(jdbc={"url": "jdbc:derby:memory:loads;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    try:
        for target in targets:
            for n in (3, 2):
                df = spark.range(n).select(F.col("id").alias("ID"), F.lit("x").alias("V"))
                summary, loaded = tables.load_all({"A": df, "none": df.where("false")}, target)
                assert {r.table_name: (r.rows_loaded, r.status) for r in summary.collect()} == {"A": (n, "loaded"), "none": (0, "skipped")}
                assert sorted(map(tuple, loaded["A"].collect())) == [(i, "x") for i in range(n)]
            tables.create_empty(spark, {"E": spark.range(1).schema}, target)
            assert tables.read_target(spark, target, "E").isEmpty()
    finally:
        spark.sql("DROP DATABASE loads CASCADE")
    for bad in ({}, {"folder": "a", "database": "b"}):
        with pytest.raises(ValueError):
            Target(**bad)


def test_reads_over_jdbc_are_split_by_measured_bounds(spark):
    jdbc = {"url": "jdbc:derby:memory:split;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    skewed = spark.range(3000).select(F.pow("id", F.lit(3)).cast("bigint").alias("K"), F.concat(F.lit("o'"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("T"), F.when(F.col("id") % 100 > 0, F.col("id") % 3).alias("FEW"))
    tables.load_table(skewed, Target(jdbc=jdbc | {"createTableColumnTypes": "T VARCHAR(20)"}), "S")
    for column, most in (("K", 800), ("T", 800)):
        df = tables.read_source(spark, "S", jdbc=jdbc, split=(column, 4))
        sizes = [r.n for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert df.count() == 3000 and len(sizes) == 4 and max(sizes) <= most
        assert df.exceptAll(skewed).isEmpty()
    few = tables.read_source(spark, "S", jdbc=jdbc, split=("FEW", 10))
    assert few.count() == 3000 and few.rdd.getNumPartitions() == 4  # one for each value, with null in the first
    tables.load_table(skewed.where("false"), Target(jdbc=jdbc), "E")
    assert tables.read_source(spark, "E", jdbc=jdbc, split=("K", 4)).count() == 0
