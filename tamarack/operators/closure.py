"""Closure of subsets over references: every row that a chosen row refers to, in any number of steps.

A reference from a table to itself (a parent's key) or round a cycle of tables needs
as many steps as the longest way. The steps are semi-naive: each looks only for the
keys that the rows found by the step before refer to, and that are not chosen yet.
They run over narrow tables of keys and references, a bounded number of which is kept;
the rows themselves are read once, at the end.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.operators.subset import BROADCAST_KEYS, resolve
from tamarack.sources.scratch import Scratch

#: Steps after which the rows chosen so far are written as one table, so that plans stay short.
COMPACT = 8


@dataclass(frozen=True)
class Reference:
    """``table.col`` refers to ``to_table.to_col``; both may be the same table."""

    table: str
    col: str
    to_table: str
    to_col: str


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def close(subsets: dict[str, DataFrame], dfs: dict[str, DataFrame], references: Iterable[Reference], keys: dict[str, list[str]], scratch: Scratch | None = None) -> dict[str, DataFrame]:
    """``subsets`` with all rows of ``dfs`` that their rows refer to, directly or through others.

    ``keys`` tell each table's rows apart; rows with a null key are left as they are
    and add nothing. Null references refer to nothing, and references to keys that no
    row has add nothing. A key that several rows have chooses all of them. Cycles end,
    as a row is chosen once. Tables that nothing refers to are returned unchanged; the
    others hold the rows of ``dfs`` with the chosen keys, each row of a table that
    repeats a key as well. The tables of keys stay below the shared folder.
    """
    names = {t.lower(): t for t in dfs}
    found = [Reference(names[r.table.lower()], r.col, names[r.to_table.lower()], r.to_col) for r in references if {r.table.lower(), r.to_table.lower()} <= names.keys()]
    aimed = sorted({r.to_table for r in found}, key=list(dfs).index)
    if not aimed:
        return subsets
    scratch = scratch or Scratch(next(iter(dfs.values())).sparkSession, "closure")

    def key_of(t: str) -> list[Column]:
        return [F.col(f"`{resolve(dfs[t], k)}`").alias(f"k{i}") for i, k in enumerate(keys[t])]

    def key_names(t: str) -> list[str]:
        return [f"k{i}" for i in range(len(keys[t]))]

    def referring(t: str) -> list[Column]:
        return [F.col(f"`{resolve(dfs[t], r.col)}`").alias(f"r{i}") for i, r in enumerate(found) if r.table == t]

    # the tables referred to, as keys, the columns referred to, and the references of their own
    narrow = {
        t: scratch.save(dfs[t].select(*key_of(t), *(F.col(f"`{resolve(dfs[t], r.to_col)}`").alias(f"c{i}") for i, r in enumerate(found) if r.to_table == t), *referring(t)), f"keys-{t}")
        for t in aimed
    }
    chosen = {t: [scratch.save(subsets[t].select(*key_of(t)).dropna().distinct(), f"chosen-{t}")] for t in aimed}
    latest = {t: subsets[t].select(*key_of(t), *referring(t)) for t in {r.table for r in found}}
    step = 0
    while latest:
        wanted: dict[str, list[DataFrame]] = {}
        for i, r in enumerate(found):
            if r.table in latest:
                asked = latest[r.table].select(F.col(f"r{i}").alias("_asked")).where("_asked is not null").distinct()
                rows = narrow[r.to_table].join(asked, narrow[r.to_table][f"c{i}"] == asked["_asked"], "left_semi")
                wanted.setdefault(r.to_table, []).append(rows)
        latest = {}
        for t, rows in wanted.items():
            fresh = _union(rows).dropna(subset=key_names(t)).join(_union(chosen[t]), key_names(t), "left_anti")
            added, seen = scratch.observed(fresh, f"step{step}-{t}", n=F.count(F.lit(1)))
            if seen["n"]:
                latest[t] = added
                chosen[t].append(added.select(*key_names(t)))
                if len(chosen[t]) > COMPACT:
                    chosen[t] = [scratch.save(_union(chosen[t]).distinct(), f"chosen-{t}")]
        step += 1

    def rows_of(t: str) -> DataFrame:
        ids = scratch.save(_union(chosen[t]).distinct(), f"all-{t}")
        ids = F.broadcast(ids) if ids.count() <= BROADCAST_KEYS else ids
        columns = [F.col(f"`{resolve(dfs[t], k)}`") for k in keys[t]]
        whole = dfs[t].join(ids, reduce(lambda a, b: a & b, [c == ids[k] for c, k in zip(columns, key_names(t))]), "left_semi")
        unkeyed = subsets[t].where(reduce(lambda a, b: a | b, [c.isNull() for c in columns]))
        return whole.unionByName(unkeyed)

    return {t: rows_of(t) if t in aimed else df for t, df in subsets.items()}
