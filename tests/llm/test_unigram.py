import re

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamarack.llm import unigram

VOCABULARY = unigram.Vocabulary.load()
LATTICE = unigram.Lattice(VOCABULARY)


@pytest.fixture(scope="module")
def library():
    """The public library's own unigram encoder over the same pieces and scores: the model's type is one field of its file."""
    raw = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    sp = None
    for m in re.finditer(rb"\x18\x02", raw):  # field 3 (model_type) of the trainer's settings, value 2: BPE
        changed = raw[: m.start()] + b"\x18\x01" + raw[m.end() :]
        try:
            sp = sentencepiece.SentencePieceProcessor(model_proto=changed)
        except RuntimeError:
            continue
        if sp.encode("the", out_type=int) and sp.get_piece_size() == 32_000 and sp.encode("abstraction") != sentencepiece.SentencePieceProcessor(model_proto=raw).encode("abstraction") or m.start() > 490_000:
            break
    return sp


def ids(text):
    return [int.from_bytes(b[i : i + 4], "little") for b in map(LATTICE.encode, LATTICE.parts(text)) for i in range(0, len(b), 4)]


def brute(part):
    """Fewest-cost segmentation by trying every piece at every position, right to left of ties as the operator says."""
    score = {p: (s, i) for i, (p, s, k) in enumerate(zip(VOCABULARY.pieces, VOCABULARY.scores, VOCABULARY.kinds)) if k == "n"}
    best = [(0.0, [])]
    for end in range(1, len(part) + 1):
        options = [(best[start][0] + score[part[start:end]][0], best[start][1] + [score[part[start:end]][1]]) for start in range(max(0, end - 48), end) if part[start:end] in score]
        if part[end - 1] not in score:
            options.append((best[end - 1][0] + LATTICE.unknown_score, best[end - 1][1] + [LATTICE.bytes[b] for b in part[end - 1].encode()]))
        top = max(o[0] for o in options)
        best.append(next(o for o in options if o[0] == top))
    return best[-1][1]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="the anioérsd \n.,▁漢ﬁ\U0001f600xyzQ", max_size=40))
def test_best_path_and_counts(text):
    got = ids(text)
    assert got == (brute("▁" + text.replace(" ", "▁")) if text else [])
    assert len(got) == sum(map(LATTICE.count, LATTICE.parts(text)))


def test_equals_the_library(library):
    for text in ("Hello world", "  two  spaces ", "naïve café ñandú", "line\nbreak\ttab", "thanedble attion to heswh", "Ærø 漢字 😀 end", "a", " "):
        assert ids(text) == library.encode(text), text


def test_columns(spark):
    texts = ["Hello world", "", None, "a\nb  c ", "x" * 30_000, "é" * 500 + " 😀", "mark ▁ here", "Hello world"]
    docs = spark.createDataFrame([(k, t, "clash", -1) for k, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")
    rows = unigram.counted(spark, unigram.decoded(spark, unigram.encoded(spark, docs))).orderBy("doc_id").collect()
    for r, t in zip(rows, texts):
        assert r.ids == ids(t or "") and r.n_pieces == r.n_tokens == len(r.ids)
        assert r.decoded == (t or "").replace("▁", " ")
    assert unigram.encoded(spark, docs.where("false")).count() == 0


def test_foreign_ids_decode_to_nothing(spark):
    df = spark.createDataFrame([([-1, 1, 99_999_999, None],), (None,)], "ids array<int>")
    assert [r.decoded for r in unigram.decoded(spark, df).collect()] == ["", None]


def test_other_normalisation_is_refused():
    class Probe:
        def normalize(self, text):
            return text.lower()

    original = sentencepiece.SentencePieceProcessor
    sentencepiece.SentencePieceProcessor = lambda **_: Probe()
    try:
        with pytest.raises(ValueError):
            unigram.Vocabulary.load("any")
    finally:
        sentencepiece.SentencePieceProcessor = original


def test_null_column(spark):
    assert spark.range(1).select(unigram.count(spark, F.lit(None).cast("string"), VOCABULARY).alias("n")).first().n == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="the anioérsd \n.,▁漢ﬁ\U0001f600xyzQ", max_size=60), max_size=6), st.sampled_from([5, 40, 1 << 19]), st.booleans())
def test_words_solved_together_are_those_solved_alone(texts, together, collide):
    texts = [*texts, "e" * 70 + " the", "the the  " * 9]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(unigram, "TOGETHER", together)
        if collide:  # all words of one hash
            m.setattr(unigram, "span_hashes", lambda codes, starts, ends: (starts * 0).astype("u8"))
        found, counts = LATTICE.encode_all(texts)
        assert found.tolist() == [i for t in texts for i in ids(t)] and counts.tolist() == [len(ids(t)) for t in texts]
        assert LATTICE.count_all(texts).tolist() == counts.tolist()
    assert [len(x) for x in LATTICE.encode_all([])] == [0, 0]


def test_round_trip_is_one_pass_of_one_worker(spark):
    texts = ["Hello world", "", None, "a\nb  c ", "é" * 500 + " 😀", "mark ▁ here", " x"]
    docs = spark.createDataFrame([(k, t, "clash", -1) for k, t in enumerate(texts)], "doc_id long, text string, ids string, n_pieces int")
    found = unigram.round_tripped(spark, docs)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    for r in found.collect():
        assert r.ids == ids(texts[r.doc_id] or "") and r.n_pieces == len(r.ids) and r.round_trip == (r.doc_id != 5)
    assert unigram.round_tripped(spark, docs.where("false")).count() == 0
