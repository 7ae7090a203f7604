"""The given tables as this library sees them: keys, links and naming rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamarack.functions.config import KEY_ENDS, RELATED_ENDS, Rules
from tamarack.operators.subset import Link, Plan

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
KEYS = {
    "orders": ["o_orderkey"],
    "customer": ["c_custkey"],
    "supplier": ["s_suppkey"],
    "part": ["p_partkey"],
    "nation": ["n_nationkey"],
    "region": ["r_regionkey"],
    "events": ["event_id"],
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate"],
}
LINKS = (
    Link("orders", "o_orderkey", "lineitem", "l_orderkey"),
    Link("orders", "o_custkey", "customer", "c_custkey"),
    Link("customer", "c_nationkey", "nation", "n_nationkey"),
    Link("supplier", "s_nationkey", "nation", "n_nationkey"),
    Link("nation", "n_regionkey", "region", "r_regionkey"),
    Link("lineitem", "l_partkey", "part", "p_partkey"),
    Link("lineitem", "l_suppkey", "supplier", "s_suppkey"),
)
START, END, RECORDS = "1996-01-01", "1996-12-31", 1000
PLAN = Plan("orders", KEYS, LINKS, "o_orderdate")
#: Keys here end with "key" and carry their table's letter in front.
RULES = Rules(key_ends=(*KEY_ENDS, "key"), related_ends=(*RELATED_ENDS, "key"), strip_prefix="^[a-z]{1,2}_")
SALT = "salt"


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names or NAMES}
