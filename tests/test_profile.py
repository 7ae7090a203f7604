import pytest

from schemas import ROWS, layout
from tamarack.operators import profile
from tamarack.sources import catalog

REQUESTED = ["stg_business_entity", "business_credit_score", "business_address_match"]


@pytest.fixture(scope="module")
def classified(spark):
    texts = spark.createDataFrame([(layout(t, typed=t == "etl_src_ctl"), f"/s/{t}.dml") for t in ROWS], "text string, file string")
    return profile.classify_fields(catalog.with_order(catalog.parse_layouts(texts))).cache()


def test_classes_and_types_of_every_field(classified):
    got = {(r.table_name.lower(), r.name): r for r in classified.collect()}
    for t, rows in ROWS.items():
        for _, name, _, _, _, kind, route, *_ in rows:
            cls, _, pii = kind.partition(" / ")
            r = got[t, name]
            assert r["class"] == cls, (t, name)
            assert (r.pii_type or "") == pii, (t, name)
            if route != "-":
                assert (r.mask_type or r.pii_type) == route.split(" ")[0], (t, name)


def test_totals_of_the_three_tables(classified):
    rows = profile.filter_tables(classified, [t.upper() for t in REQUESTED])
    profiles = profile.table_profiles(rows)
    totals, pii = profile.profile_totals(profiles).first(), profile.pii_summary(profiles).first()
    assert (totals.tables_profiled, totals.total_fields) == (3, 130)
    assert sorted(totals.scd2_tables) == ["BUSINESS_ADDRESS_MATCH", "BUSINESS_CREDIT_SCORE"]
    assert (pii.total_pii_fields, pii.tables_with_pii) == (36, 2)
    assert pii.pii_by_table == {"STG_BUSINESS_ENTITY": 26, "BUSINESS_ADDRESS_MATCH": 10}
    assert profile.anchor_table(profiles).first().table_name == "STG_BUSINESS_ENTITY"
    assert profile.infer_relationships(rows).count() == 20


def test_relationships(classified):
    rows = profile.infer_relationships(classified).collect()
    assert len(rows) == 21
    pairs = {(r.column_1, r.column_2): r for r in rows}
    assert pairs["mtch_bus_nbr", "business_id"].confidence == "medium" and pairs["mtch_bus_nbr", "business_id"].key_class == "key"
    three = profile.infer_relationships(profile.filter_tables(classified, REQUESTED)).collect()
    assert sum(r.confidence == "high" for r in three) == 6 and all(r.key_class == "control" for r in three if r.confidence == "high")
    assert all(r.key_class == "key" for r in profile.infer_relationships(classified, skip_control=True).collect())


def test_control_tables_and_plan(classified):
    profiles = profile.table_profiles(classified)
    control = {r.table_name for r in profiles.where("is_control_table").collect()}
    assert control == {"ETL_CYC_CTL", "ETL_SRC_CTL"}
    only = profile.table_profiles(profile.filter_tables(classified, ["etl_cyc_ctl"]))
    assert profile.anchor_table(only).isEmpty()
    order = profile.subsetting_order(profiles, profile.infer_relationships(classified), profile.anchor_table(profiles)).orderBy("position").collect()
    assert order[0].table_name == "STG_BUSINESS_ENTITY" and len(order) == 5
    paths = profile.join_paths(profile.infer_relationships(classified)).collect()
    assert paths and not any("publ_id" in r["key"] for r in paths)


def test_filter_by_stem_and_unknown(classified):
    assert profile.filter_tables(classified, ["Etl_Cyc_Ctl"]).count() == 7
    assert profile.filter_tables(classified, ["nothing"]).isEmpty()


def test_report(classified, tmp_path, spark):
    from tamarack.sources.tables import read_report, write_report

    report = profile.profile_report(classified)
    write_report(report, str(tmp_path), "r1", "profile")
    row = read_report(spark, str(tmp_path), "r1", "profile").first()
    assert row.tables_profiled == 5 and row.anchor_table == "STG_BUSINESS_ENTITY" and len(row.relationships) == 21 and len(row.tables) == 5
    assert read_report(spark, str(tmp_path), "r2", "profile") is None


def test_changes_since_a_stored_profile(spark):
    stored = spark.createDataFrame([("T", "bus_id", "int", "key", None), ("T", "bus_nm", "string", "pii", "PERSON_NAME"), ("T", "x", "int", "business", None), ("U", "a", "int", "business", None), ("GONE", "g", "int", "business", None)], "table_name string, name string, declared_type string, class string, pii_type string")
    now = spark.createDataFrame([("t", "BUS_ID", "bigint", "key", None), ("t", "bus_nm", "string", "business", None), ("t", "y", "date", "business", None), ("u", "A", "int", "business", None)], stored.schema)
    got = sorted(map(tuple, profile.changes(stored, now).collect()), key=str)
    assert got == sorted([("T", "bus_id", "retyped", "int", "bigint"), ("T", "bus_nm", "reclassified", "pii/PERSON_NAME", "business"), ("T", "x", "dropped", "int", None), ("T", "y", "added", None, "date"), ("GONE", "g", "dropped", "int", None)], key=str)
    assert profile.changes(stored, stored.orderBy("name")).isEmpty() and profile.fingerprints(stored).count() == 3
