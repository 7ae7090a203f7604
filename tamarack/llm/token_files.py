"""Token-id files: canonical length-limited Huffman codes, read back by tables from bit-offset checkpoints.

A dataset is a folder with ``code`` (one row per id: its code length; canonical
order gives the codes) and ``blocks`` (Parquet files in ascending doc_id order).
A block holds the ids of consecutive documents as one bit string, with the bit
offset of every ``INTERVAL``-th id, and is decoded without any other block.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.llm.workspace import Workspace, small_batches

END_ID = 2
MAX_LENGTH = 18
BLOCK_TOKENS, INTERVAL = 1 << 18, 256
#: Bounds of a Python worker's memory: bytes of texts tokenized together, words that it remembers and their length.
TEXT_BYTES, KNOWN_WORDS, WORD_BYTES = 12 << 20, 1_000_000, 64
#: Words of a line that is tokenized at once, and lines or characters given to the library in one call.
LINE, CALL_LINES, CALL_CHARS = 100, 200, 200_000
#: The parts of the tokenizer file for which ``Encoder`` cuts words.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
WORD_END = "</w>"
SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
#: By code point: letters that stay one letter when composed and lower-cased.
SAFE = np.array([c.isalpha() and len(c.lower()) == 1 and c.lower().isalpha() and all(unicodedata.normalize("NFC", x) == x for x in (c, c.lower())) for c in map(chr, range(0x530))] + [False])
BLOCK_SCHEMA = "part int, start long, doc_ids array<long>, sizes array<int>, checkpoints array<long>, payload binary"


class _Known:
    """Ids of words, side by side in Arrow arrays. A table that is full keeps the words of the batch at hand."""

    def __init__(self) -> None:
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())

    def get(self, words: pa.Array, make: Callable[[pa.Array], pa.Array]) -> pa.Array:
        at = pc.index_in(words, value_set=self.words)
        missing = pc.is_null(at)
        new = words.filter(missing)
        place = np.array(pc.fill_null(at, 0), dtype=np.int64)
        place[np.array(missing)] = len(self.words) + np.arange(len(new))
        ids = pa.concat_arrays([self.ids, make(new)])
        out = ids.take(pa.array(place))
        self.words, self.ids = (pa.concat_arrays([self.words, new]), ids) if len(ids) <= KNOWN_WORDS else (words, out)
        return out


class Encoder:
    """Ids of whole texts with the end id, as the tokenizers library gives them.

    A tokenizer whose parts are those of ``NORMALIZER`` and ``SPLIT`` (with added
    tokens that hold ``<`` and no white space) treats these pieces apart:

    * words between spaces, tabs and line breaks: no token holds white space, no
      character composes with it, and lower-casing looks at one character;
    * a word's ASCII signs at its end after a letter of ``SAFE``: the scan looks at
      nothing behind it, a token that holds a letter takes no sign after it, and
      such a letter stays one letter when it is composed and lower-cased.

    ASCII words without ``<`` are looked up in lower case. Each piece is then
    tokenized once a batch and the frequent ones are remembered. With any other
    tokenizer whole texts are tokenized.
    """

    def __init__(self, spec: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_str(spec), kind
        self.apart = cuts_words(spec)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)  # ids that end a letters' run
        if self.apart:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.known = _Known()

    def _each(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; so many characters at once that the library's results stay small."""
        out, part, size = [], [], 0
        for k, t in enumerate(texts, 1):
            part.append(t)
            size += len(t)
            if size > CALL_CHARS or k == len(texts):
                out += [np.array(e.ids, dtype=self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                part, size = [], 0
        return out

    def _pieces(self, pieces: pa.Array) -> pa.Array:
        """Ids of pieces. Runs of letters share calls, as the ids that end them tell them apart."""
        alpha = np.array(pc.utf8_is_alpha(pieces), dtype=bool)
        letters, alone = np.flatnonzero(alpha), [np.flatnonzero(~alpha)]
        found, order = [], []
        lines = pa.ListArray.from_arrays(pa.array(np.append(np.arange(0, len(letters), LINE), len(letters)), pa.int32()), pieces.take(pa.array(letters)))
        joined = pc.binary_join(lines, " ").to_pylist()
        for k in range(0, len(joined), CALL_LINES):
            for i, e in enumerate(self.tokenizer.encode_batch_fast(joined[k : k + CALL_LINES], add_special_tokens=False), k):
                words, ids = letters[i * LINE : (i + 1) * LINE], np.array(e.ids, dtype=self.kind)
                stops = np.flatnonzero(self.ends[ids]) + 1
                if len(stops) == len(words):
                    found.append(pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(np.append(0, stops * ids.itemsize)), pa.py_buffer(ids)]))
                    order.append(words)
                else:  # a few letters become more than letters
                    alone.append(words)
        alone = np.concatenate(alone)
        found.append(pa.array(self._each(pieces.take(pa.array(alone)).to_pylist()), pa.large_binary()))
        places = np.empty(len(pieces), dtype=np.int64)
        places[np.concatenate([*order, alone])] = np.arange(len(pieces))
        return pa.concat_arrays(found).take(pa.array(places))

    def _words(self, words: pa.Array) -> pa.Array:
        stems, tails = cut(words)
        n, both = len(words), pa.concat_arrays([stems, tails]).dictionary_encode()
        short = pc.less_equal(pc.binary_length(both.dictionary), WORD_BYTES)
        if pc.all(short).as_py():
            ids = self.known.get(both.dictionary, self._pieces)
        else:  # long ones are not remembered
            long = pc.invert(short)
            order = np.concatenate([np.flatnonzero(short), np.flatnonzero(long)])
            rare = pa.array(self._each(both.dictionary.filter(long).to_pylist()), pa.large_binary())
            ids = pa.concat_arrays([self.known.get(both.dictionary.filter(short), self._pieces), rare]).take(pa.array(np.argsort(order)))
        ids = ids.take(both.indices)
        return pc.binary_join_element_wise(ids.slice(0, n), ids.slice(n), pa.scalar(b"", pa.large_binary()))

    def encode(self, texts: pa.Array) -> pa.Array:
        texts, end = pc.fill_null(texts.cast(pa.string()), ""), np.array([END_ID], dtype=self.kind).tobytes()
        if not self.apart:
            return pa.array([x + end for x in self._each(texts.to_pylist())], pa.large_binary())
        for c in "\n\t\r":
            texts = pc.replace_substring(texts, c, " ")
        lists = pc.split_pattern(texts, " ")
        bounds = np.array(lists.offsets, dtype=np.int64)
        words = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds -= bounds[0]
        ids = pa.concat_arrays([self._words(words.dictionary), pa.array([end], pa.large_binary())])
        joined = ids.take(pa.array(np.insert(words.indices.to_numpy(), bounds[1:], len(ids) - 1)))
        _, offsets, data = joined.buffers()
        ends = np.frombuffer(offsets, dtype=np.int64)[joined.offset :][bounds + np.arange(len(bounds))]
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends), data])


def cuts_words(spec: str) -> bool:
    """Whether a tokenizer file's parts are such that ``Encoder`` may cut words."""
    d = json.loads(spec)
    model = d["model"]
    plain = model["type"] == "BPE" and model.get("end_of_word_suffix") == WORD_END and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    added = all("<" in t["content"] and not any(c.isspace() for c in t["content"]) and not any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in d["added_tokens"])
    return plain and added and d["normalizer"] == NORMALIZER and d["pre_tokenizer"] == SPLIT and not d["truncation"]


def cut(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Each word's stem and its tail of ASCII signs, empty where they can't be told apart."""
    words = pa.concat_arrays([words, pa.array([], pa.string())])  # offsets start at 0
    special = pc.match_substring(words, "<")
    trimmed = pc.ascii_rtrim(words, SIGNS)
    off = np.frombuffer(words.buffers()[1], dtype=np.int32)[: len(words) + 1].astype(np.int64)
    buf = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)
    size = np.array(pc.binary_length(trimmed), dtype=np.int64)
    before = np.maximum(off[:-1] + size - 1, 0)  # the last byte of a letter
    last = buf[before].astype(np.int64) if len(buf) else before
    lead = buf[np.maximum(before - 1, 0)].astype(np.int64) if len(buf) else before
    point = np.where(last < 128, last, np.where(lead & 0xE0 == 0xC0, (lead & 0x1F) << 6 | last & 0x3F, 0))
    good = (size > 0) & (size < np.diff(off)) & SAFE[np.minimum(point, len(SAFE) - 1)] & ~np.array(special, dtype=bool)
    lengths = np.where(good, np.diff(off) - size, 0)
    ends = np.cumsum(lengths)
    tail = buf[np.repeat(off[1:] - ends, lengths) + np.arange(lengths.sum())]
    tails = pa.Array.from_buffers(pa.string(), len(words), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(tail)])
    stems = pc.if_else(pa.array(good), trimmed, words)
    return pc.if_else(pc.and_not(pc.string_is_ascii(stems), special), pc.ascii_lower(stems), stems), tails


@lru_cache(maxsize=1)
def _encoder(spec: str, kind: str) -> Encoder:
    return Encoder(spec, kind)


def _spec(path: str | None) -> tuple[str, str]:
    """The tokenizer file's text, and the little-endian type that holds its ids."""
    from tokenizers import Tokenizer

    with open(path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        text = f.read()
    return text, "<u2" if max(Tokenizer.from_str(text).get_vocab().values(), default=0) < 1 << 16 else "<u4"


def _tokenize(shared: Broadcast, kind: str):
    """(doc_id, ids) of each row, ``TEXT_BYTES`` of texts at once, and at the task's end how often it has seen each id."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("seen", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, total, held, size = _encoder(shared.value, kind), np.zeros(0, dtype=np.int64), [], 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal total
            table = pa.Table.from_batches(held).combine_chunks()
            texts = table.column("text").chunk(0)
            ids = encoder.encode(texts)
            got = np.bincount(np.frombuffer(ids.buffers()[2] or b"", dtype=kind), minlength=len(total))
            got[: len(total)] += total
            total = got
            for k in range(0, len(texts), 1000):
                part = ids.slice(k, 1000)
                m = len(part)
                yield pa.RecordBatch.from_arrays([table.column("doc_id").chunk(0).slice(k, m), part.cast(pa.binary()), pa.nulls(m, schema.types[2]), pa.nulls(m, schema.types[3])], schema=schema)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.column("text").nbytes
            if size > TEXT_BYTES:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()
        seen = np.flatnonzero(total)
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([seen], schema.types[2]), pa.array([total[seen]], schema.types[3])], schema=schema)

    return run


def code_lengths(counts: np.ndarray, limit: int = MAX_LENGTH) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.int64)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} ids need codes of more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        both = np.concatenate([leaves, packages])
        sort = np.argsort(both, kind="stable")
        levels.append(sort < n)
        both = both[sort]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * n - 2
    for is_leaf in reversed(levels):
        taken = int(is_leaf[:take].sum())
        out[order[:taken]] += 1
        take = 2 * (take - taken)
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in canonical order: by length, then id."""
    codes, code, before = np.zeros(len(lengths), dtype=np.uint64), 0, 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)):
        if lengths[i]:
            code <<= int(lengths[i]) - before
            before = int(lengths[i])
            codes[i] = code
            code += 1
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The ids' bit string and the bit offset of every ``INTERVAL``-th of them."""
    size = lengths[ids]
    ends = np.cumsum(size)
    at = ends - size
    words = np.zeros((int(ends[-1]) >> 5) + 3 if len(ids) else 3, dtype=np.uint64)
    if len(ids):
        value = codes[ids] << (64 - size - (at & 31)).astype(np.uint64)
        first, where = np.unique(at >> 5, return_index=True)
        words[first] = np.bitwise_or.reduceat(value >> np.uint64(32), where)
        words[first + 1] |= np.bitwise_or.reduceat(value & np.uint64(0xFFFFFFFF), where)
    return words.astype(">u4").tobytes(), at[::INTERVAL]


def tables(lengths: np.ndarray, codes: np.ndarray, limit: int = MAX_LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length by the next ``limit`` bits."""
    symbol, size = np.zeros(1 << limit, dtype=np.uint32), np.zeros(1 << limit, dtype=np.int64)
    for i in np.flatnonzero(lengths):
        shift = limit - int(lengths[i])
        a = int(codes[i]) << shift
        symbol[a : a + (1 << shift)], size[a : a + (1 << shift)] = i, lengths[i]
    return symbol, size


def unpack(payload: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray], limit: int = MAX_LENGTH) -> np.ndarray:
    """The ``n`` ids of a bit string: all checkpoints go ahead together, one table look-up an id."""
    symbol, size = table
    words = np.frombuffer(payload, dtype=">u4").astype(np.uint64)
    pairs = (words[:-1] << np.uint64(32)) | words[1:]
    out = np.zeros((len(checkpoints), INTERVAL), dtype=np.uint32)
    at, lanes = checkpoints.astype(np.int64).copy(), len(checkpoints)
    down, mask = np.int64(64 - limit), np.uint64((1 << limit) - 1)
    for k in range(min(INTERVAL, n)):
        if k == n - (lanes - 1) * INTERVAL:
            lanes -= 1
        here = at[:lanes]
        look = ((pairs[here >> 5] >> (down - (here & 31)).astype(np.uint64)) & mask).astype(np.int64)
        out[:lanes, k] = symbol[look]
        here += size[look]
    return out.reshape(-1)[:n]


def write(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Tokenizes ``docs(doc_id, text)`` and writes the dataset, ordered by doc_id (null first, ties by their ids' hash).

    Null texts are empty: they have the end id only. Rows that repeat all stay.
    Other columns are ignored, an empty table gives empty files. Only the counts of the vocabulary's ids reach the driver.
    """
    small_batches(spark)
    work = Workspace(spark, "token-files")
    spec, kind = _spec(tokenizer)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = work.save(texts.mapInArrow(_tokenize(spark.sparkContext.broadcast(spec), kind), "doc_id long, ids binary, seen array<int>, times array<long>"), "ids")
    found = tokens.where("seen is not null").select(F.explode(F.arrays_zip("seen", "times")).alias("c")).groupBy(F.col("c.seen").alias("id")).agg(F.sum("c.times").alias("n")).collect()
    counts = np.zeros(max((r.id for r in found), default=0) + 1, dtype=np.int64)
    for r in found:
        counts[r.id] = r.n
    lengths = code_lengths(counts)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id int, length int").coalesce(1).write.parquet(f"{path}/code")
    shared = spark.sparkContext.broadcast((lengths, canonical(lengths)))
    arrow = pa.schema([("part", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("checkpoints", pa.list_(pa.int64())), ("payload", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        names: list = []
        start = part = size = 0

        def block() -> pa.RecordBatch:
            payload, marks = pack(np.concatenate(held), *shared.value)
            row = {"part": part, "start": start, "doc_ids": names, "sizes": [len(x) for x in held], "checkpoints": marks.tolist(), "payload": payload}
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            for name, row, part in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), batch.column("part").to_pylist()):
                names.append(name)
                held.append(np.frombuffer(row.as_buffer(), dtype=kind))
                size += len(held[-1])
                if size >= BLOCK_TOKENS:
                    yield block()
                    start += size
                    held, names, size = [], [], 0
        if held:
            yield block()

    # rows of one id, or of none, may be many: their ids' hash and then their place deal them out
    ids = tokens.where("ids is not null").select("doc_id", "ids", F.xxhash64("ids").alias("h"), F.monotonically_increasing_id().alias("at"))
    keys = [F.col("doc_id").asc_nulls_first(), "h", "at"]
    ordered = ids.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.select("doc_id", "ids", F.spark_partition_id().alias("part")).mapInArrow(encode, BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks")
    work.drop(tokens)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, and its ``ids`` unless that is turned off.

    ``start`` counts the ids of all documents before it.
    """
    found = spark.read.parquet(f"{path}/code").collect()  # at most the vocabulary
    lengths = np.zeros(max((r.id for r in found), default=0) + 1, dtype=np.int64)
    for r in found:
        lengths[r.id] = r.length
    shared = spark.sparkContext.broadcast(lengths)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    schema = "part int, doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>" if with_ids else "part int, doc_id long, start long, n_tokens long, ids_crc32 long"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tables(shared.value, canonical(shared.value))
        for batch in batches:
            for k in range(batch.num_rows):
                part, start, names, sizes, marks, payload = (batch.column(c)[k] for c in ("part", "start", "doc_ids", "sizes", "checkpoints", "payload"))
                sizes = np.array(sizes.values, dtype=np.int64)
                ends = np.cumsum(sizes)
                ids = unpack(payload.as_buffer(), np.array(marks.values), int(ends[-1]), table).astype("<u4")
                raw, m = memoryview(ids.view(np.uint8)), len(sizes)
                columns = {
                    "part": pa.array([part.as_py()] * m, pa.int32()),
                    "doc_id": names.values,
                    "start": pa.array(start.as_py() + ends - sizes, pa.int64()),
                    "n_tokens": pa.array(sizes, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist())], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(columns)

    totals = blocks.select("part", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    ahead = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))  # one row per file
    rows = blocks.mapInArrow(decode, schema).join(ahead, "part")
    return rows.withColumn("start", F.col("start") + F.col("ahead")).drop("part", "ahead")
