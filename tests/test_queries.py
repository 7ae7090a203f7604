"""Every query of the library over the smallest tables, against its SQL."""

from pathlib import Path

import duckdb
import pytest

from tamarack.plans import catalog_queries, source_queries, table_queries

SF = "/root/testdata/sf0.001"
QUERIES = {**table_queries.QUERIES, **catalog_queries.QUERIES, **source_queries.QUERIES}
SQL = {**table_queries.ORACLE_SQL, **catalog_queries.ORACLE_SQL, **source_queries.ORACLE_SQL}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def _rows(rows, columns):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(str([round(r[k], 6) if isinstance(r[k], float) else r[k] for k in at]) for r in rows)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query_equals_its_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    want = db.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert _rows(got.collect(), got.columns) == _rows(want.fetchall(), columns)


def test_seeded_sample(spark):
    a, b = (QUERIES["seeded_sample"](spark, SF).collect() for _ in range(2))
    assert a == b and len(a) == min(1000, spark.read.parquet(f"{SF}/part.parquet").count())


def test_entry_points(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
