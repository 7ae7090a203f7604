import hashlib
import zlib

import numpy as np
import pytest

from tamarack.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _leaf string, _group string, root string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def way(levels, at):
    out = []
    for level in levels[:-1]:
        out.append((level[at ^ 1], at & 1) if at ^ 1 < len(level) else None)
        at >>= 1
    return out


def brute(rows, claims):
    """Per row: leaf, subroot, root, proof, folded root, verified."""
    groups = sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    members = {g: sorted((k for k, r in enumerate(rows) if r[2] == g), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, leaf(*rows[k]))) for g in groups}
    trees = {g: tree([leaf(*rows[k]) for k in members[g]]) for g in groups}
    top = tree([trees[g][-1][0] for g in groups])
    out = []
    for n, g in enumerate(groups):
        for at, k in enumerate(members[g]):
            path, here = way(trees[g], at) + way(top, n), claims[k]
            for step in path:
                here = h(here) if step is None else h(step[0], here) if step[1] else h(here, step[0])
            out.append((rows[k][0], leaf(*rows[k]), trees[g][-1][0], top[-1][0], h(*(s[0] for s in path if s)), here, here == top[-1][0]))
    return out


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "theirs", "theirs", "theirs") for r in rows], SCHEMA).repartition(parts)


def made(n, langs=("en", "de", None)):
    return [(k * 3, f"text {k}", langs[k % len(langs)] if k % 5 else langs[0], None if k % 4 == 0 else f"s{k % 3}", k if k % 6 else None) for k in range(n)]


@pytest.mark.parametrize("levels", range(1, 9))
def test_addresses_name_each_place_once(levels):
    found = np.concatenate([manifest.addresses(levels, d, np.arange(1 << d)) for d in range(levels)])
    assert sorted(found.tolist()) == list(range((1 << levels) - 1))


def test_addresses_keep_lower_subtrees_together():
    # 4 levels: the upper 2 take places 0 to 2, then each of the 4 lower trees takes 3
    assert manifest.addresses(4, 0, np.array([0])).tolist() == [0] and manifest.addresses(4, 1, np.arange(2)).tolist() == [1, 2]
    assert manifest.addresses(4, 2, np.arange(4)).tolist() == [3, 6, 9, 12] and manifest.addresses(4, 3, np.arange(8)).tolist() == [4, 5, 7, 8, 10, 11, 13, 14]


@pytest.mark.parametrize(("n", "height"), [(1, 1), (2, 1), (23, 1), (3, 2), (9, 2), (16, 2), (70, 2), (1, 12), (70, 12)])
def test_proofs_equal_brute_force(spark, tmp_path, n, height):
    rows = made(n)
    manifest.write(spark, table(spark, rows), f"{tmp_path}/m", height=height)
    got = manifest.verified(spark, f"{tmp_path}/m").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, [leaf(*r) for r in rows]))
    assert all(r.verified for r in got) and manifest.root(spark, f"{tmp_path}/m") == got[0].root


def test_tampering_is_found(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = made(60)
    claims = [leaf(*r[:4], r[4] + 1 if r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else r[4]) for r in rows]
    changed = [F.col("doc_id"), F.col("source"), F.col("lang"), F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")), F.col("text")]
    manifest.write(spark, table(spark, rows), f"{tmp_path}/m", claim=manifest.leaf_of(*changed))
    got = manifest.verified(spark, f"{tmp_path}/m").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, claims)) and {r.verified for r in got} == {True, False}


def test_proof_lists_siblings(spark, tmp_path):
    rows = made(5, ("en",))
    manifest.write(spark, table(spark, rows), f"{tmp_path}/m")
    by_key = {r.key: r for r in manifest.proofs(spark, f"{tmp_path}/m").collect()}
    last = by_key[12]
    assert last.siblings[:2] == [None, None] and last.siblings[2] is not None and last.lefts == [None, None, True]


def test_odd_rows(spark, tmp_path):
    rows = [(None, "a", "en", None, 1), (None, None, None, None, None), (1, "é" * 5000, "", "x", 5000), (2, "same", "en", "s", 4), (2, "same", "en", "s", 4), (2, "b", "en", "s", 4), (3, "", "-", "", 0)]
    manifest.write(spark, table(spark, rows), f"{tmp_path}/m")
    assert sorted(map(str, map(tuple, manifest.verified(spark, f"{tmp_path}/m").collect()))) == sorted(map(str, brute(rows, [leaf(*r) for r in rows])))


def test_order_of_rows_does_not_matter(spark, tmp_path):
    rows = made(50)
    manifest.write(spark, table(spark, rows), f"{tmp_path}/a")
    manifest.write(spark, table(spark, rows[::-1], 7), f"{tmp_path}/b")
    assert manifest.root(spark, f"{tmp_path}/a") == manifest.root(spark, f"{tmp_path}/b")


def test_empty_table(spark, tmp_path):
    manifest.write(spark, table(spark, []), f"{tmp_path}/m")
    assert manifest.verified(spark, f"{tmp_path}/m").collect() == [] and manifest.root(spark, f"{tmp_path}/m") is None
