"""WARC archives: segmented records written and put together again.

Files are WARC 1.1, written in gzip (a member per file) and read with or without
it, also those of other writers. A record whose block is longer than a
segment is continued in ``continuation`` records, which may stand in any file;
the reader groups them by the origin's record id, orders them by segment
number, checks the total length, and decodes the chunked transfer framing.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.components import spread_join
from tamarack.llm.workspace import Workspace

CRLF = b"\r\n"
SEGMENT_BYTES, CHUNK_BYTES = 32_768, 8_192
#: Records of a file at most: with ``SEGMENT_BYTES`` this bounds a file, which one task reads whole.
RECORDS_PER_FILE = 1_000
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Pages of a payload, and fractions of all pages, above which its row is broadcast: these are as many at most.
COPIES = 10_000
#: Bytes of payloads in one Arrow batch.
BATCH_BYTES = 4 << 20
#: Bytes that are inflated at once, bytes of a record's head at most, and of its block (as many as a value of Arrow's has).
PIECE_BYTES, HEAD_BYTES, RECORD_BYTES = 1 << 20, 1 << 20, (1 << 31) - 1


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped. Raises ValueError where the framing breaks."""
    out, at = [], 0
    while True:
        end = body.index(CRLF, at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if size < 0 or body[at + size : at + size + 2] != CRLF:
            raise ValueError("a chunk doesn't end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def _record(kind: str, name: str, block: bytes, **fields) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}", f"Content-Length: {len(block)}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    return "\r\n".join(lines).encode() + CRLF + CRLF + block


def _name(page_id: int | None, copy: int) -> str:
    return f"urn:page:{'' if page_id is None else page_id}#{copy:x}"


def records(page_id: int | None, copy: int, url: str | None, payload: bytes, refers_to: dict | None, segment: int) -> Iterator[bytes]:
    """The page's records, without the blank lines that end them. A line break in a URL is escaped.

    ``refers_to`` has the page_id and the copy of the response that a revisit repeats.
    """
    name = _name(page_id, copy)
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A") or None
    fields = {"WARC_Target_URI": uri, "WARC_Payload_Digest": "sha1:" + digest(payload), "Content_Type": "application/http;msgtype=response"}
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        yield _record("revisit", name, block, **fields, WARC_Profile=REVISIT_PROFILE, WARC_Refers_To=f"<{_name(refers_to['page_id'], refers_to['copy'])}>")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    if len(parts) == 1:
        yield _record("response", name, block, **fields)
        return
    for k, part in enumerate(parts, 1):
        total = len(block) if k == len(parts) else None
        if k == 1:
            yield _record("response", name, part, **fields, WARC_Segment_Number=1)
        else:
            yield _record("continuation", f"{name}.{k}", part, WARC_Segment_Origin_ID=f"<{name}>", WARC_Segment_Number=k, WARC_Segment_Total_Length=total)


def write(spark: SparkSession, pages: DataFrame, path: str, segment: int = SEGMENT_BYTES, min_bytes: int = 0) -> None:
    """Writes a record for each row of ``pages(page_id, url, html)`` to WARC files below ``path``.

    Of rows with equal payloads of at least ``min_bytes`` bytes those with the
    smallest page_id are responses and the others revisits of it; smaller ones are
    responses, as are rows with a null id whose payload no row with an id has. A
    null html is an empty payload, a null url leaves the field out.

    A record's id holds its page_id and its row's number, which tells repeated rows
    apart. It is counted in two passes, so a revisit's reference is exact where the
    rows come in the same order each time, as those of files do.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("copy", F.monotonically_increasing_id())
    sha = F.sha1("payload")
    ids = rows.where(F.length("payload") >= min_bytes).select("page_id", "copy", sha.alias("sha"))
    own = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "copy"))
    first = ids.groupBy("sha").agg(F.min(own).alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    # html is shuffled by page, never by payload, and so are ids of a payload that very many pages have
    limit = max(COPIES, pages.count() // COPIES)
    again = spread_join(ids.select("page_id", "sha").distinct(), first, "sha", F.col("n") > limit).where("page_id is null or page_id <> first.page_id").select("page_id", "sha", "first")
    spread = F.when(F.col("page_id").isNull(), F.xxhash64("copy")).otherwise(F.col("page_id"))
    known = again.where("page_id is not null")
    joined = rows.withColumn("sha", sha).join(known, ["page_id", "sha"], "left")
    if not again.where("page_id is null").isEmpty():
        nameless = again.where("page_id is null").select("sha", F.col("first").alias("other"))
        joined = joined.withColumn("k", F.when(F.col("page_id").isNull(), F.col("sha")).otherwise(spread.cast("string")))
        joined = joined.join(nameless.withColumnRenamed("sha", "k"), "k", "left").withColumn("first", F.coalesce("first", "other"))
    tagged = joined.select("page_id", "url", "payload", F.col("first").alias("refers_to"), "copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for row in zip(*(batch.column(c) for c in ("page_id", "copy", "url", "payload", "refers_to"))):
                for r in records(*(x.as_py() for x in row), segment):
                    out.append(r)
                    held += len(r)
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    # a line of the text writer is a record with the two line breaks that end it
    text = tagged.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    text.write.options(lineSep="\r\n\r\n", compression="gzip", maxRecordsPerFile=RECORDS_PER_FILE, **{"zlib.compress.level": "BEST_SPEED"}).text(path)


class _Stretch:
    """The bytes of a file up to the next break, taken a piece at a time."""

    def __init__(self, pieces: Iterable[bytes | None]):
        self.pieces, self.data, self.broken, self.over = iter(pieces), bytearray(), False, False

    def grow(self) -> bool:
        if self.broken or self.over:
            return False
        piece = next(self.pieces, b"")
        self.broken, self.over = piece is None, piece == b""
        self.data += piece or b""
        return bool(piece)

    def holds(self, n: int) -> bool:
        while len(self.data) < n and self.grow():
            pass
        return len(self.data) >= n

    def record(self) -> tuple[dict[str, str], bytes] | None:
        """Takes the record that begins here; nothing is taken if none does."""
        if not self.holds(5) or self.data[:5] != b"WARC/":
            return None
        end = self.data.find(CRLF + CRLF)
        while end < 0 and len(self.data) < HEAD_BYTES and self.grow():
            end = self.data.find(CRLF + CRLF)
        if end < 0:
            return None
        lines = self.data[:end].decode("utf-8", "replace").split("\r\n")
        if any(x.startswith("WARC/") for x in lines[1:]):  # the head is cut, and the next one follows
            return None
        fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if ":" in x)}
        size = fields.get("content-length", "")
        if not re.fullmatch(r"[0-9]{1,10}", size) or int(size) > RECORD_BYTES:
            return None
        start, end = end + 4, end + 4 + int(size)
        if not self.holds(end):
            return None
        self.holds(end + 5)
        if self.data[end : end + 2] not in (CRLF, b"") and self.data[end : end + 5] != b"WARC/":
            return None
        block = bytes(self.data[start:end])
        del self.data[:end]
        return fields, block

    def skip(self) -> None:
        """Goes on to the next line that looks like a record's first, or to the end of the stretch."""
        del self.data[:1]
        while (at := self.data.find(b"\nWARC/")) < 0:
            del self.data[:-5]
            if not self.grow():
                self.data.clear()
                return
        del self.data[: at + 1]


def scan(pieces: Iterable[bytes | None]) -> Iterator[tuple[dict[str, str] | None, bytes]]:
    """Fields (names in lower case) and block of each record of a file that comes in pieces; None stands for lost bytes.

    A record is one whose head can be read, whose block is there as its length says,
    and which a blank line, another record or the end follows. What lies between
    records gives (None, b""), once for each such place. No more than a record and a
    piece are held, unless a length claims more than the file still has.
    """
    here, hurt = _Stretch(pieces), False
    while True:
        while here.holds(2) and here.data[:2] == CRLF:  # the blank lines that end a record
            del here.data[:2]
        if not here.data and not here.broken:
            return
        found = here.record() if here.data else None
        if found:
            hurt = False
            yield found
            continue
        if not hurt:
            hurt = True
            yield None, b""
        if here.data:
            here.skip()
        else:
            here.broken = False


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a whole file, as ``scan``. Raises ValueError where one is broken."""
    for fields, block in scan([raw]):
        if fields is None:
            raise ValueError("a broken record, or something between records")
        yield fields, block


def inflated(raw: bytes) -> Iterator[bytes | None]:
    """The content of gzip members one after another, in pieces; other content is given as it is.

    None stands for what a damaged or cut member still held; the next one is looked for.
    """
    at = 0
    while raw[at : at + 2] == b"\x1f\x8b":
        member, begin = zlib.decompressobj(31), at
        try:
            while not member.eof:
                fed = member.unconsumed_tail
                if not fed:
                    fed = raw[at : at + PIECE_BYTES]
                    at += len(fed)
                piece = member.decompress(fed, PIECE_BYTES)
                if piece:
                    yield piece
                elif not fed and not member.eof:
                    yield None
                    return
            at -= len(member.unused_data)
        except zlib.error:
            yield None
            at = raw.find(b"\x1f\x8b\x08", max(begin + 1, at - PIECE_BYTES))
            if at < 0:
                return
    for k in range(at, len(raw), PIECE_BYTES):
        yield raw[k : k + PIECE_BYTES]


def _inflate(raw: bytes) -> bytes:
    return b"".join(piece for piece in inflated(raw) if piece)


def _page(name: str) -> int | None:
    """The page_id in a record id of this writer; null for the ids of others."""
    found = re.fullmatch(r"<?urn:page:(-?\d+)#[0-9a-f]+>?", name)
    return int(found[1]) if found else None


def _http(block: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (names in lower case) and body of an HTTP message."""
    head, _, body = block.partition(CRLF + CRLF)
    return {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)}, body


RESULT = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, complete boolean, payload binary, record_id string"


def _row(fields: dict[str, str], block: bytes | None, keep: bool) -> dict:
    """A record of the result; ``complete`` is false if its segments or framing are broken or its digest differs."""
    said = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    name = fields.get("warc-record-id", "")
    row = {"page_id": _page(name), "url": fields.get("warc-target-uri"), "record_type": fields.get("warc-type"), "payload_digest": said or None, "complete": block is not None, "record_id": name.strip("<>")}
    if block is None:
        return row
    if row["record_type"] == "revisit":
        size = _http(block)[0].get("content-length", "")
        return row | {"refers_to": _page(fields.get("warc-refers-to", "")), "payload_bytes": int(size) if size.isdigit() else None}
    payload = block
    if fields.get("content-type", "").startswith("application/http") or row["record_type"] == "response" and block[:5] == b"HTTP/":
        http, payload = _http(block)
        if http.get("transfer-encoding", "").lower() == "chunked":
            try:
                payload = unchunked(payload)
            except ValueError:
                return row | {"complete": False}
    got = digest(payload)
    wrong = fields.get("warc-payload-digest", "").startswith("sha1:") and got != said
    return row | {"payload_bytes": len(payload), "payload_digest": got, "complete": not wrong, "payload": payload if keep else None}


_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("complete", pa.bool_()), ("payload", pa.binary()), ("record_id", pa.string())])
_SEGMENT = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.get("payload") or b"") + len(row.get("block") or b"") + 200
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of WARC files below ``path``, segments put together, with the columns of ``RESULT``.

    Records in one piece never leave their task; only segments are shuffled. A
    record with a missing segment or a wrong total length comes with ``complete``
    false and no payload. Every record of other writers gives a row too: its page_id
    is null where the record id is not one of this writer, its payload is the body
    of an HTTP message (chunked if that says so) or else the block. No files' order
    or repeats matter; an empty file has no records. Each file is read once, and
    inflated a piece at a time.
    """
    work = Workspace(spark, "warc")
    files = spark.read.format("binaryFile").load(path).select("content")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(f: dict | None, b: bytes) -> dict:
            if f is None:
                return {"complete": False}
            if "warc-segment-number" not in f:
                return _row(f, b, with_payload)
            number, total, first = f["warc-segment-number"], f.get("warc-segment-total-length", ""), f.get("warc-type") != "continuation"
            origin = f.get("warc-record-id" if first else "warc-segment-origin-id")
            if not origin or not re.fullmatch(r"[0-9]{1,9}", number):
                return _row(f, None, with_payload)
            return {"origin": origin, "number": int(number), "total": int(total) if re.fullmatch(r"[0-9]{1,18}", total) else None, "fields": list(f.items()) if first else None, "block": b}

        for batch in batches:
            for content in batch.column("content"):
                yield from _batches((row(f, b) for f, b in scan(inflated(content.as_py()))), pa.schema([*_ARROW, *_SEGMENT]))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(r: dict) -> dict:
            parts = r["parts"]
            block = b"".join(p["block"] for p in parts)
            fits = [p["number"] for p in parts] == list(range(1, len(parts) + 1)) and r["total"] == len(block)
            fields = dict(r["fields"] or {"warc-record-id": r["origin"]})
            return _row(fields, block if fits and r["fields"] else None, with_payload)

        for batch in batches:
            yield from _batches((row(batch.slice(k, 1).to_pylist()[0]) for k in range(batch.num_rows)), _ARROW)

    found = work.save(files.mapInArrow(each, f"{RESULT}, origin string, number int, total long, fields map<string,string>, block binary"), "records")
    # one record's segments make one record again, so a group is never larger than a record
    grouped = (
        found.where("origin is not null")
        .groupBy("origin")
        .agg(F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"), F.max("total").alias("total"), F.first("fields", ignorenulls=True).alias("fields"))
        .select("origin", "parts", "total", "fields")
    )
    return found.where("origin is null").select(_ARROW.names).unionByName(grouped.mapInArrow(finish, RESULT))
