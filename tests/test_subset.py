import pytest

from tamarack.operators import subset
from tamarack.operators.subset import Link, Plan


@pytest.fixture(scope="module")
def dfs(spark):
    parent = spark.createDataFrame([(1, "2024-01-01", "a"), (2, "2024-06-30", "b"), (3, "2025-01-01", None), (4, None, "d")], "ID int, Eff_Sdt string, v string")
    child = spark.createDataFrame([(10, 1), (11, 1), (12, 2), (13, 9), (14, None), (15, 3)], "cid int, pid int")
    grand = spark.createDataFrame([(100, 10), (101, 13)], "gid int, cid int")
    other = spark.createDataFrame([(k,) for k in range(20)], "k int")
    return {"parent": parent, "child": child, "grand": grand, "other": other}


PLAN = Plan("PARENT", {"parent": ["id"], "child": ["cid"], "grand": ["gid"], "other": ["k"]}, (Link("parent", "ID", "child", "pid"), Link("grand", "cid", "child", "cid")))


def ids(df, c):
    return sorted(r[c] for r in df.select(c).collect())


def test_dates_are_inclusive_and_optional(dfs):
    p = dfs["parent"]
    assert subset.date_column(p) == "Eff_Sdt" and subset.date_column(dfs["child"]) is None
    assert ids(subset.date_range(p, "eff_sdt", "2024-01-01", "2024-06-30"), "ID") == [1, 2]
    assert ids(subset.date_range(p, "eff_sdt", start="2024-06-30"), "ID") == [2, 3]
    assert ids(subset.date_range(p, None, "2024-06-30"), "ID") == [1, 2, 3, 4]


def test_children_follow_the_anchor_and_are_not_limited(dfs):
    out, how = subset.subset(dfs, PLAN, 2, "2024-01-01", "2024-12-31")
    assert ids(out["parent"], "ID") == [1, 2] and ids(out["child"], "cid") == [10, 11, 12]
    assert ids(out["grand"], "gid") == [100, 101] and len(ids(out["other"], "k")) == 2
    assert how == {"parent": "anchor_subset", "child": "referential_subset", "grand": "independent_sample", "other": "independent_sample"}
    again, _ = subset.subset(dfs, PLAN, 2, "2024-01-01", "2024-12-31", max_hops=2)
    assert ids(again["grand"], "gid") == [100]


def test_no_anchor_samples_everything(dfs):
    out, how = subset.subset(dfs, Plan(None, PLAN.keys), 1)
    assert set(how.values()) == {"independent_sample"} and all(df.count() == 1 for df in out.values())


def test_blank_strings(dfs):
    out, _ = subset.subset(dfs, PLAN, 4, fill_blank_strings=True)
    assert "" in [r.v for r in out["parent"].collect()] and [r.pid for r in out["child"].collect()].count(None) == 0


def test_seeded_sample_is_stable(dfs):
    a, b = (ids(subset.independent_sample(dfs["other"], ["k"], 5, seed=3), "k") for _ in range(2))
    assert a == b and a != [0, 1, 2, 3, 4]


def test_summary_warns_of_empty_tables(dfs):
    out, how = subset.subset(dfs, PLAN, 2, "1990-01-01", "1990-12-31")
    rows = {r.table_name: r for r in subset.extraction_summary(out, how).collect()}
    assert rows["child"].row_count == 0 and "child" in rows["child"].warning and rows["other"].warning is None


def test_integrity(dfs):
    r = subset.integrity_report(dfs, list(PLAN.links)).collect()[0]
    assert (r.keys_in_t1, r.keys_in_t2, r.overlap, r.orphans_in_t1, r.orphans_in_t2, r.passed, r.strict_passed) == (4, 4, 3, 1, 1, True, False)


def test_integrity_of_empty_and_zero_keys(spark):
    a = spark.createDataFrame([(0, "0"), (1, ""), (2, None)], "n int, s string")
    b = spark.createDataFrame([(0, "0")], "n int, s string")
    links = [Link("a", "n", "b", "n"), Link("a", "s", "b", "s")]
    rows = {r.column_1: r for r in subset.integrity_report({"a": a, "b": b}, links).collect()}
    assert (rows["n"].keys_in_t1, rows["s"].keys_in_t1) == (3, 1)
    zero = {r.column_1: r for r in subset.integrity_report({"a": a, "b": b}, links, zero_is_empty=True).collect()}
    assert (zero["n"].keys_in_t1, zero["s"].keys_in_t1) == (2, 1)
    none = subset.integrity_report({"a": a.where("false"), "b": b.where("false")}, links)
    assert subset.integrity_summary(none).first().status == "passed"


def test_names_are_checked(dfs):
    with pytest.raises(ValueError):
        subset.resolve(dfs["child"], "cid; drop")
    with pytest.raises(ValueError):
        subset.resolve(dfs["child"], "missing")


def test_laid_out_tables_stay_in_place(spark, tmp_path):
    from pyspark.sql import functions as F

    from tamarack.sources import tables

    spark.sql(f"CREATE DATABASE laid LOCATION '{tmp_path}/laid'")
    try:
        child = spark.range(3000).select((F.col("id") % 700).alias("pid"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 365).cast("int")).alias("day"), "id")
        laid = tables.lay_out(child, "laid.child", "pid", 8, "day")
        assert tables.bucketing(spark, "laid.child") == ("pid", 8) and laid.count() == 3000
        parent = spark.range(0, 900, 3).withColumnRenamed("id", "key")
        got = subset.referential_subset(laid, "pid", parent, "key", None, 8)
        want = subset.referential_subset(child, "pid", parent, "key")
        assert got.select(child.columns).exceptAll(want).isEmpty() and got.count() == want.count()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = got._jdf.queryExecution().executedPlan().toString()
        scan = plan[: plan.index("FileScan parquet spark_catalog.laid.child")]
        assert "SortMergeJoin" in plan and scan.count("Exchange") == plan.count("Exchange") - plan[plan.index("FileScan parquet spark_catalog.laid.child") :].count("Exchange")
        assert plan.count("Exchange hashpartitioning") == 1  # of the keys
        some = subset.date_range(laid, "day", "2024-02-10", "2024-03-05")
        assert some.count() == child.where("day between '2024-02-10' and '2024-03-05'").count()
        assert "PartitionFilters: [isnotnull(day_month" in some._jdf.queryExecution().executedPlan().toString()
        plan = Plan("parent", {"parent": ["key"], "child": ["id"]}, (Link("parent", "key", "child", "pid"),), buckets={"child": ("pid", 8)})
        out, how = subset.subset({"parent": parent, "child": laid}, plan, None)
        assert how["child"] == "referential_subset" and out["child"].count() == want.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE laid CASCADE")
