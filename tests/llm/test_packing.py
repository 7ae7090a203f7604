import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tamarack.llm import packing

SCHEMA = "doc_id long, text string, ids string, u double"


def padding(lengths, capacity):
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in lengths)


def check(tokens, sequences, capacity):
    """Each token lies in one piece, and no sequence holds too many."""
    pieces = defaultdict(list)
    for s in sequences:
        assert 0 < sum(p[2] for p in s) <= capacity and all(p[2] > 0 for p in s)
        for d, start, length in s:
            pieces[d].append((start, length))
    for d, n in enumerate(tokens):
        at = 0
        for start, length in sorted(pieces[d]):
            assert start == at
            at += length
        assert at == n


@pytest.mark.parametrize("seed", range(30))
def test_first_fit_equals_a_plain_search(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 64, 2048])
    sizes = np.array([r.randint(1, capacity) for _ in range(r.randint(0, 200))], dtype=np.int64)
    room, want = [], np.zeros(len(sizes), dtype=np.int64)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        at = next((i for i, x in enumerate(room) if x >= sizes[k]), None)
        if at is None:
            at = len(room)
            room.append(capacity)
        room[at] -= sizes[k]
        want[k] = at
    got, used = packing.first_fit_decreasing(sizes, capacity)
    assert got.tolist() == want.tolist() and used == len(room)


@pytest.mark.parametrize("longest", [1, 5, 63, 64, 65, 400])
@pytest.mark.parametrize("least", [1, 4])
def test_pieces_cover_documents(longest, least):
    r = np.random.default_rng(longest)
    for n in (0, 1, 2, 7, 300):
        tokens = r.integers(1, longest + 1, n)
        sequences = packing.packed(tokens, 64, least)
        check(tokens, sequences, 64)
        if least == 1:
            assert padding([sum(p[2] for p in s) for s in sequences], 64) == 0
        else:
            assert padding([sum(p[2] for p in s) for s in sequences], 64) <= (least - 1) * len(sequences)


def test_powers_of_two():
    assert [sum(p[2] for p in s) for s in packing.at_powers([(0, 0, 5), (1, 3, 9)])] == [8, 4, 2]
    assert packing.at_powers([]) == []


def test_documents(spark):
    texts = ["", None, "a", "Some words, and some more.", "word " * 9000, "same text", "same text", "x" * 50_000]
    rows = [(k if k < 6 else 5, t, "theirs", 0.5) for k, t in enumerate(texts)] + [(None, "no id", None, None)]
    found = packing.pack(spark, spark.createDataFrame(rows, SCHEMA), with_ids=True, group_tokens=4000).collect()
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append(r)
        documents[r.doc_id].append(r)
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for k, t in [(k, t) for k, t, *_ in rows if k != 5]:
        pieces = sorted(documents[k], key=lambda r: r.start)
        ids = [i for r in pieces for i in r.ids]
        assert ids == tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        assert all(r.doc_tokens == len(ids) for r in pieces)
    assert sum(r.length for r in documents[5]) == sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in texts[5:])


def test_one_id_for_all_rows(spark):
    rows = [(7, f"a few words {k}", None, None) for k in range(500)]
    found = packing.pack(spark, spark.createDataFrame(rows, SCHEMA), group_tokens=1000).collect()
    assert len({r.sequence_id >> 32 for r in found}) > 1  # dealt over groups whatever the id
    assert sum(r.length for r in found) == sum({(r.sequence_id, r.offset): r.length for r in found}.values())


def test_empty_table_and_settings(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    assert packing.pack(spark, spark.createDataFrame([], SCHEMA)).collect() == []
    assert spark.conf.get(key) == before
