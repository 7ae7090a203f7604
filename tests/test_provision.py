import pytest
from pyspark.sql import functions as F

from schemas import ROWS
from tamarack.operators import mask as masking
from tamarack.operators import profile, subset, validate
from tamarack.operators.subset import Link
from tamarack.plans import provision
from tamarack.plans.provision import Request
from tamarack.sources import catalog, generate, tables, versions

KEYS = {"stg_business_entity": ["business_id"], "business_credit_score": ["bus_nbr"], "business_address_match": ["addr_match_nbr"], "etl_cyc_ctl": ["etl_cyc_id"], "etl_src_ctl": ["etl_cyc_id"]}
THREE = ("stg_business_entity", "business_credit_score", "business_address_match")


@pytest.fixture(scope="module")
def made(spark):
    return {t: df.cache() for t, df in generate.generate(spark, 200).items()}


def test_generated_tables(made):
    assert {t: df.count() for t, df in made.items()} == {"stg_business_entity": 200, "business_credit_score": 200, "business_address_match": 200, "etl_cyc_ctl": 90, "etl_src_ctl": 90}
    expected = {t: [r[1] for r in rows if r[7] != "no" and not r[1].startswith("filler")] for t, rows in ROWS.items()}
    for t, df in made.items():
        assert sorted(df.columns) == sorted(expected[t])
    links = [Link("stg_business_entity", "business_id", t, c) for t, c in (("business_credit_score", "bus_nbr"), ("business_address_match", "mtch_bus_nbr"), ("stg_business_entity", "ultimate_bus_id"), ("stg_business_entity", "parent_bus_id"))]
    report = subset.integrity_report(made, links + [Link("etl_cyc_ctl", "etl_cyc_id", "etl_src_ctl", "etl_cyc_id")]).collect()
    assert all(r.strict_passed for r in report)
    entity = made["stg_business_entity"]
    assert entity.select("business_id").distinct().count() == 200 and entity.select("ultimate_bus_id").distinct().count() <= 20


def test_generation_is_stable_in_any_partitioning(spark):
    a, b = (generate.business_entities(spark, 50, 1, p) for p in (1, 7))
    assert a.exceptAll(b).isEmpty() and not a.exceptAll(generate.business_entities(spark, 50, 2)).isEmpty()


def test_whole_job(spark, made, tmp_path):
    request = Request(THREE, record_count=50, start="2024-01-01", end="2024-12-31")
    run = provision.run(spark, request, made, KEYS, str(tmp_path))
    assert run.error is None and run.status == "completed"
    row = provision.run_summary(spark, run).first()
    assert (row.tables_profiled, row.rows_extracted, row.rows_loaded, row.validation_status) == (3, 150, 150, "PASSED") and row.values_masked > 1000
    assert {r.table_name for r in run.checks.collect()} == set(THREE)
    links = ["table_1", "column_1", "table_2", "column_2"]
    assert sorted(run.target_integrity.select(links).collect()) == sorted(run.integrity.select(links).collect())
    assert [(r.keys_in_t1, r.keys_in_t2, r.strict_passed) for r in run.target_integrity.where("column_1 = 'business_id' and column_2 = 'bus_nbr'").collect()] == [(50, 50, True)]
    names = {r.business_id for r in run.masked["stg_business_entity"].collect()}
    assert {r.bus_nbr for r in run.masked["business_credit_score"].collect()} == names


@pytest.mark.parametrize("loses, check", [(lambda df: df.limit(7), "row_count"), (lambda df: df.drop("cr_risk_pct"), "column_existence")])
def test_a_load_that_loses_rows_or_columns_fails_its_check(spark, made, tmp_path, monkeypatch, loses, check):
    load = tables.load_table
    monkeypatch.setattr(tables, "load_table", lambda df, target, table: load(loses(df), target, table))
    run = provision.run(spark, Request(("business_credit_score",), record_count=20), made, KEYS, str(tmp_path))
    assert [r.check_name for r in run.checks.where("not passed").collect()] == [check]
    assert run.status == "partial" and provision.run_summary(spark, run).first().validation_status == "PARTIAL"


def test_protected_keys_and_lengths(spark, made):
    request = Request(("business_address_match",), record_count=5, protect_keys=True, truncate=True, skip_provisioning=True)
    run = provision.run(spark, request, made, KEYS)
    assert "addr_match_nbr" not in run.masks["business_address_match"]
    plain = provision.run(spark, Request(("business_address_match",), record_count=5, skip_provisioning=True), made, KEYS)
    assert plain.masks["business_address_match"]["addr_match_nbr"] == "STREET_ADDRESS"
    assert provision.run_summary(spark, plain).first().validation_status == "N/A"


def test_profile_only(spark, made):
    run = provision.run(spark, Request(THREE, skip_subsetting=True, skip_masking=True, skip_provisioning=True), made, KEYS)
    assert run.profiles.count() == 3 and not run.subsets and provision.run_summary(spark, run).first().rows_extracted == 0


def test_failures(spark, made):
    assert provision.run(spark, Request(("missing",)), made, KEYS).status == "failed"
    assert provision.run(spark, Request(THREE, skip_profiling=True), made, KEYS).status == "failed"
    control = provision.run(spark, Request(("etl_cyc_ctl",), record_count=3, skip_provisioning=True), made, KEYS)
    assert control.how == {"etl_cyc_ctl": "independent_sample"}


@pytest.mark.parametrize("bad", [{"tables": ()}, {"start": "2025-01-01", "end": "2024-01-01"}, {"skip_subsetting": True}, {"skip_masking": True}, {"record_count": 0}])
def test_bad_requests(bad):
    with pytest.raises(ValueError):
        Request(**({"tables": ("t",)} | bad))


def test_cap():
    assert Request(("t",), record_count=20_000, max_records=10_000).record_count == 10_000 and Request(("t",), record_count=20_000).record_count == 20_000


def test_one_commit_one_scan_and_release(spark, made, tmp_path):
    target = tables.Target(versions=str(tmp_path))
    run = provision.run(spark, Request(THREE, record_count=20), made, KEYS, target)
    assert run.status == "completed" and {r.status for r in run.loads.collect()} == {"loaded"} and versions.latest(spark, str(tmp_path)).number == 1
    assert {r.table_name: (r.rows_masked, r.total_values_masked) for r in run.stats.collect()} == {t: tuple(masking.mask_stats(run.subsets[t], run.masks[t], t).select("rows_masked", "total_values_masked").first()) for t in THREE}
    assert sorted(run.extracted.collect()) == sorted(subset.extraction_summary(run.subsets, run.how).collect())
    before = provision.run_summary(spark, run).first()
    run.release()
    run.release()
    assert provision.run_summary(spark, run).first() == before and run.checks.count() > 9
    assert tables.read_target(spark, target, THREE[0]).count() == 20
    plan = validate.validate_table(tables.read_target(spark, target, THREE[0]), "t", 20, [])._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("FileScan parquet") == 1


def test_a_failing_table_rolls_the_others_back(spark, made, tmp_path):
    target = tables.Target(versions=str(tmp_path))
    provision.run(spark, Request(THREE, record_count=20), made, KEYS, target)
    broken = made | {THREE[1]: made[THREE[1]].withColumn("viabl_rt", F.when(F.length("viabl_rt") > 0, F.raise_error(F.lit("no"))).otherwise(F.col("viabl_rt")))}
    run = provision.run(spark, Request(THREE, record_count=30), broken, KEYS, target)
    assert run.status == "failed" and tables.read_target(spark, target, THREE[0]).count() == 20


def test_keep_format(spark, made):
    request = Request(("business_credit_score", "stg_business_entity"), record_count=50, keep_format=True, skip_provisioning=True)
    run = provision.run(spark, request, made, KEYS)
    zips = run.masked["stg_business_entity"].select("phys_zip_cd").collect()
    assert run.masks["stg_business_entity"]["phys_zip_cd"] == "DIGITS" and all(len(r.phys_zip_cd) == 5 and r.phys_zip_cd.isdigit() for r in zips)


def test_a_stored_profile_is_compared(spark, made):
    t = "business_credit_score"
    stored = catalog.fields_from_tables(spark, {t: made[t]})
    same = provision.run(spark, Request((t,), record_count=5, skip_profiling=True, skip_provisioning=True), made, KEYS, fields=stored)
    assert same.status == "completed" and same.drift.isEmpty()
    changed = {t: made[t].drop("finc_pct").withColumn("bus_phone", F.lit("1")).withColumn("row_ver_nbr", F.lit(1))}
    warned = provision.run(spark, Request((t,), record_count=5, skip_profiling=True, skip_provisioning=True), changed, KEYS, fields=stored)
    assert warned.status == "completed" and {(r.column_name, r.change) for r in warned.drift.collect()} == {("finc_pct", "dropped"), ("bus_phone", "added"), ("row_ver_nbr", "retyped")}
    stopped = provision.run(spark, Request((t,), record_count=5, skip_profiling=True, skip_provisioning=True, on_drift="stop"), changed, KEYS, fields=stored)
    assert stopped.status == "failed" and "finc_pct dropped" in stopped.error
    layout = catalog.fields_from_tables(spark, {t: made[t]}).withColumn("kind", F.lit("ddl")).withColumn("declared_type", F.lit("CHAR(9)"))
    assert provision.drift(spark, profile.classify_fields(layout), {t: made[t]}).isEmpty()  # names of types are of another kind
