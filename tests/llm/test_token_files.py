import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tamarack.llm import token_files as tf

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def huffman_cost(counts, limit):
    """Least total bits with codes of at most ``limit`` bits, by trying all length multisets (few symbols)."""
    counts = sorted((c for c in counts if c), reverse=True)
    best = None

    def go(k, room, low, cost):
        nonlocal best
        if k == len(counts):
            best = cost if best is None else min(best, cost)
            return
        for n in range(low, limit + 1):
            if 2.0**-n + (len(counts) - k - 1) * 2.0**-limit <= room:
                go(k + 1, room - 2.0**-n, n, cost + n * counts[k])

    go(0, 1.0, 1, 0)
    return best


@pytest.mark.parametrize("seed", range(20))
def test_lengths_are_optimal_and_decodable(seed):
    r = random.Random(seed)
    counts = np.array([r.choice([0, 1, 2, 5, 40, 1000]) for _ in range(8)])
    if (counts > 0).sum() < 2:
        counts[:2] = 1
    lengths = tf.code_lengths(counts, 4)
    assert (lengths[counts > 0] > 0).all() and not lengths[counts == 0].any() and lengths.max() <= 4
    assert sum(2.0 ** -int(n) for n in lengths if n) <= 1
    assert (lengths * counts).sum() == huffman_cost(counts.tolist(), 4)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_round_trip_of_blocks(n):
    r = np.random.default_rng(n)
    ids = np.minimum(r.zipf(1.3, n), 5000).astype(np.uint32)
    counts = np.bincount(ids, minlength=10)
    counts[3] += 1
    lengths = tf.code_lengths(counts)
    codes = tf.canonical(lengths)
    payload, marks = tf.pack(ids, lengths, codes)
    assert np.array_equal(tf.unpack(payload, np.asarray(marks), n, tf.tables(lengths, codes)), ids)
    for k, mark in enumerate(marks[:3]):  # each checkpoint starts a decodable part
        assert np.array_equal(tf.unpack(payload, np.array([mark]), min(256, n - 256 * k), tf.tables(lengths, codes)), ids[256 * k : 256 * k + 256])


def test_too_many_ids_for_the_limit():
    with pytest.raises(ValueError):
        tf.code_lengths(np.ones(9), 3)
    assert tf.code_lengths(np.array([0, 7])).tolist() == [0, 1]


TEXTS = ["Hello, WORLD. it's don't", "", None, "naïve ΑΣ. ǅ İstanbul, ﬁ", "a b c\td\r\ne", "<|endoftext|>, <|EndOfText|>. x", "é. ́x 1234 !!?", "one. two, three.four", " double  space\n\nline ", "漢字 😀,", "word " * 30_000, "Hello, WORLD. it's don't"]


def test_dataset_round_trip(spark, tmp_path):
    rows = [(k * 7 - 10, t, -1) for k, t in enumerate(TEXTS)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    tf.write(spark, docs, f"{tmp_path}/d")
    got = tf.read(spark, f"{tmp_path}/d").orderBy("doc_id").collect()
    start = 0
    for r, (i, t, _) in zip(got, sorted(rows)):
        ids = [*TOKENIZER.encode(t or "", add_special_tokens=False).ids, tf.END_ID]
        assert (r.doc_id, r.ids, r.n_tokens, r.start) == (i, ids, len(ids), start), t
        assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)


def test_many_blocks_repeats_and_nulls(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tf, "BLOCK_TOKENS", 50)
    rows = [(k // 2, f"text number {k // 2} of many") for k in range(400)] + [(None, "no id")]
    tf.write(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5), f"{tmp_path}/d")
    got = tf.read(spark, f"{tmp_path}/d", with_ids=False).orderBy("start").collect()
    assert len(got) == 401 and got[0].doc_id is None and [r.doc_id for r in got[1:]] == sorted(r[0] for r in rows[:-1])
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    assert spark.read.parquet(f"{tmp_path}/d/blocks").count() > 20


def test_empty_table(spark, tmp_path):
    tf.write(spark, spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/d")
    assert tf.read(spark, f"{tmp_path}/d").count() == 0


PARTS = [*"abcXYZ .,!?'\"-<|>&%#019_\n\t\r", "İ", "ı", "Σ", "ς", "ß", "é", "É", "é", "É", "́", "क़", "क़", "K", "ﬁ", "日", "한", "ᄀ", "ᅡ", " ", "　", "<|endoftext|>", "<|startoftext|>", "'s", "'LL", "ǰ", "J̌", "🙂", "٣", "Ⅷ"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_library(name):
    r = random.Random(5)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 14))) for _ in range(20_000)] + ["x" * 200 + "." + "é" * 90, "hello world", "İ.", "İ,", "naïve..."]
    spec, kind = tf._spec(public_tokenizers.path(name))
    encoder = tf.Encoder(spec, kind)
    assert encoder.apart == (name == "word_bpe_49k.json")
    want = [np.array([*e.ids, tf.END_ID], dtype=kind).tobytes() for e in Tokenizer.from_str(spec).encode_batch(texts, add_special_tokens=False)]
    for part in (slice(0, 9_000), slice(9_000, None)):  # the second meets words that the first left
        assert encoder.encode(pa.array(texts)[part]).to_pylist() == want[part]


def test_every_letter_before_a_stop():
    spec, kind = tf._spec(None)
    encoder = tf.Encoder(spec, kind)
    texts = [f"a{c}{s}" for c in map(chr, range(33, 0x3400)) if c.isalpha() for s in (".", ",", "'s", "...", "≠")]
    want = [np.array([*e.ids, tf.END_ID], dtype=kind).tobytes() for e in TOKENIZER.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(pa.array(texts)).to_pylist() == want


def test_a_full_table_of_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(tf, "KNOWN_WORDS", 5)
    spec, kind = tf._spec(None)
    encoder = tf.Encoder(spec, kind)
    for k in range(20):
        text = f"one two three word{k} word{k + 1}, four."
        assert encoder.encode(pa.array([text, None])).to_pylist() == [np.array([*TOKENIZER.encode(t, add_special_tokens=False).ids, tf.END_ID], dtype=kind).tobytes() for t in (text, "")]


def test_another_tokenizer_file(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tf.write(spark, spark.createDataFrame([(1, "hello world"), (2, None)], "doc_id long, text string"), f"{tmp_path}/d", path)
    got = {r.doc_id: r.ids for r in tf.read(spark, f"{tmp_path}/d").collect()}
    assert got == {1: [*Tokenizer.from_file(path).encode("hello world", add_special_tokens=False).ids, 2], 2: [2]}


def test_many_rows_without_an_id_spread_over_files(spark, tmp_path):
    docs = spark.range(4000).selectExpr("cast(null AS long) AS doc_id", "'same words' AS text").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tf.write(spark, docs, f"{tmp_path}/d")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = spark.read.parquet(f"{tmp_path}/d/blocks").groupBy("part").count().count()
    got = tf.read(spark, f"{tmp_path}/d", with_ids=False)
    assert files > 1 and got.count() == 4000 and got.select("start").distinct().count() == 4000
