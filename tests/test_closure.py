import random

import pytest

from tamarack.operators import subset
from tamarack.operators.closure import Reference, close
from tamarack.operators.subset import Link, Plan
from tamarack.sources import generate


def closed_by_hand(tables, chosen, references):
    """Rows (by first column) reached over the references."""
    found = {t: set(chosen.get(t, ())) for t in tables}
    while True:
        before = {t: set(v) for t, v in found.items()}
        for r in references:
            asked = {row[r[1]] for row in tables[r[0]] if row["id"] in found[r[0]]} - {None}
            found[r[2]] |= {row["id"] for row in tables[r[2]] if row[r[3]] in asked}
        if found == before:
            return found


@pytest.mark.parametrize("seed", range(3))
def test_equals_a_search_by_hand(spark, seed):
    r = random.Random(seed)
    people = [{"id": k, "boss": r.choice([None, r.randrange(40), k, 99]), "town": r.choice([None, *range(6)])} for k in range(40)]
    towns = [{"id": k, "mayor": r.choice([None, r.randrange(40)])} for k in range(6)]
    references = [("people", "boss", "people", "id"), ("people", "town", "towns", "id"), ("towns", "mayor", "people", "id")]
    start = set(r.sample(range(40), 3))
    want = closed_by_hand({"people": people, "towns": towns}, {"people": start}, references)
    dfs = {"people": spark.createDataFrame([(p["id"], p["boss"], p["town"]) for p in people], "id int, boss int, town int"), "towns": spark.createDataFrame([(t["id"], t["mayor"]) for t in towns], "id int, mayor int")}
    subsets = {"people": dfs["people"].where(dfs["people"]["id"].isin(list(start))), "towns": dfs["towns"].where("false")}
    out = close(subsets, dfs, [Reference(*x) for x in references], {"people": ["id"], "towns": ["id"]})
    assert {t: sorted(x.id for x in df.collect()) for t, df in out.items()} == {t: sorted(v) for t, v in want.items()}


def test_chains_cycles_and_odd_keys(spark):
    rows = [(k, k + 1) for k in range(25)] + [(25, 20), (None, 3), (30, None), (7, 8)]
    df = spark.createDataFrame(rows, "ID int, up int")
    chosen = spark.createDataFrame([(0, 1), (None, 3), (30, None)], "ID int, up int")
    out = close({"t": chosen, "other": chosen}, {"t": df, "other": df}, [Reference("T", "UP", "t", "id"), Reference("t", "up", "missing", "id")], {"t": ["id"], "other": ["id"]})
    assert sorted((r.ID is None, r.ID or 0) for r in out["t"].collect()) == sorted([(False, k) for k in [*range(26), 7, 30]] + [(True, 0)])
    assert out["other"] is chosen


def test_references_to_other_columns_and_no_rows(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, code string")
    b = spark.createDataFrame([(10, "x"), (11, "x"), (12, "z")], "id int, code string")
    got = close({"a": a.where("id = 1"), "b": b.where("false")}, {"a": a, "b": b}, [Reference("a", "code", "b", "code")], {"a": ["id"], "b": ["id"]})
    assert sorted(r.id for r in got["b"].collect()) == [10, 11]
    none = close({"a": a.where("false"), "b": b.where("false")}, {"a": a, "b": b}, [Reference("a", "code", "b", "code")], {"a": ["id"], "b": ["id"]})
    assert none["b"].isEmpty()


def test_hierarchy_of_generated_businesses(spark):
    made = generate.generate(spark, 200)
    t = "stg_business_entity"
    plan = Plan(t, {t: ["rec_seq_nbr"]}, (Link(t, "business_id", t, "parent_bus_id"),))
    references = tuple(Reference(t, c, t, "business_id") for c in ("ultimate_bus_id", "hq_bus_id", "parent_bus_id"))
    out, _ = subset.subset({t: made[t]}, plan, 7, references=references)
    ids = {r.business_id for r in out[t].collect()}
    refs = {r[c] for r in out[t].collect() for c in ("ultimate_bus_id", "hq_bus_id", "parent_bus_id")}
    assert refs <= ids and len(ids) < 200 and made[t].orderBy("rec_seq_nbr").limit(7).select("business_id").subtract(out[t].select("business_id")).isEmpty()
