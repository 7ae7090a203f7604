import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tamarack.llm import warc


def expected(rows):
    first = {}
    for i, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, html in rows:
        raw = (html or "").encode()
        to = first.get(html or "")
        again = to is not None and i != to
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    r = random.Random(1)
    texts = ["", None, "<p>é😀</p>", "a\r\n\r\nWARC/1.1\r\n", "x" * 100_000, "ü" * 40_001, "0\r\n\r\n", "same"] + ["".join(r.choice("abc \r\né") for _ in range(r.randint(0, 9000))) for _ in range(20)]
    rows = [(k, t) for k, t in enumerate(texts * 3)] + [(3, "x" * 100_000), (500, "x" * 100_000), (None, "same"), (None, "alone")]
    pages = spark.createDataFrame([(i, f"http://a.example/{i}\r\nX: 1" if i != 2 else None, t, "clash") for i, t in rows], "page_id long, url string, html string, record_type string")
    warc.write(spark, pages.repartition(4), f"{tmp_path}/w", segment=1000)
    got = warc.read(spark, f"{tmp_path}/w")
    records = got.collect()
    assert all(x.complete for x in records)
    assert sorted(((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in records), key=str) == expected(rows)
    by = {}
    for i, t in rows:
        by.setdefault(i, set()).add((t or "").encode())
    assert all(bytes(x.payload) in by[x.page_id] for x in records if x.record_type == "response")
    assert all(x.payload is None for x in records if x.record_type == "revisit")
    assert {x.url for x in records if x.page_id == 2} == {None} and any(x.url == "http://a.example/3%0D%0AX: 1" for x in records)


def test_small_payloads_are_never_revisits(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    warc.write(spark, pages, f"{tmp_path}/w", min_bytes=3)
    assert {r.page_id: r.refers_to for r in warc.read(spark, f"{tmp_path}/w").collect()} == {1: None, 2: None, 3: None, 4: 3}


def test_segments_in_other_files_out_of_order_and_missing(spark, tmp_path):
    whole = list(warc.records(7, 1, "u", b"payload " * 500, None, 600))
    broken = list(warc.records(8, 2, "u", b"other " * 500, None, 600))
    bad_framing = [warc._record("response", "urn:page:9#3", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nabc")]
    assert len(whole) > 3
    for k, r in enumerate(reversed(whole + broken[:2] + broken[3:] + bad_framing)):
        (tmp_path / f"{k}.warc.gz").write_bytes(gzip.compress(r + b"\r\n\r\n"))
    got = {r.page_id: r for r in warc.read(spark, str(tmp_path)).collect()}
    assert got[7].complete and bytes(got[7].payload) == b"payload " * 500
    assert not got[8].complete and got[8].payload is None and not got[9].complete


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_chunked_framing(size):
    for payload in (b"", b"a", b"\r\n" * 50, bytes(range(256)) * 40):
        assert warc.unchunked(warc.chunked(payload, size)) == payload
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"3\r\nabcd\r\n0\r\n\r\n")


def test_members_and_records_of_one_file():
    parts = [warc._record("response", f"urn:page:{k}#0", b"x" * k) + b"\r\n\r\n" for k in range(3)]
    raw = b"".join(map(gzip.compress, parts))
    assert [len(b) for _, b in warc.parse(warc._inflate(raw))] == [0, 1, 2]
    with pytest.raises(ValueError):
        list(warc.parse(parts[2][:-6]))


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(spark, pages, f"{tmp_path}/w")
    assert warc.read(spark, f"{tmp_path}/w").count() == 0


def test_file_sizes_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 10)
    pages = spark.range(95).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.col("id").cast("string").alias("html")).coalesce(1)
    warc.write(spark, pages, f"{tmp_path}/w")
    assert len(list((tmp_path / "w").glob("*.gz"))) >= 10 and warc.read(spark, f"{tmp_path}/w").count() == 95


def test_revisits_refer_to_records_that_exist(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", "same" if k % 2 else f"own {k}") for k in range(60)] + [(1, "u", "same")], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages")
    warc.write(spark, spark.read.parquet(f"{tmp_path}/pages"), f"{tmp_path}/w")
    found = [f for x in (tmp_path / "w").glob("*.gz") for f, _ in warc.parse(warc._inflate(x.read_bytes()))]
    responses = {f["warc-record-id"] for f in found if f["warc-type"] == "response"}
    refers = {f["warc-refers-to"] for f in found if f["warc-type"] == "revisit"}
    assert len(found) == 61 and len(refers) == 1 and refers <= responses


def test_archives_of_other_writers(spark, tmp_path):
    def record(kind, name, block, *more):
        head = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: <" + name + b">", b"Content-Length: %d" % len(block), *more]
        return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = b"Content-Type: application/http; msgtype=response"
    plain = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nhello"
    parts = [
        record(b"warcinfo", b"urn:uuid:0", b"software: other\r\n", b"Content-Type: application/warc-fields"),
        record(b"response", b"urn:uuid:1", plain, http, b"WARC-Target-URI: http://a.example/"),
        record(b"response", b"urn:uuid:2", b"HTTP/1.1 200 OK\r\ntransfer-encoding: Chunked\r\n\r\n5\r\nhello\r\n0\r\n\r\n", http, b"WARC-Payload-Digest: sha1:" + warc.digest(b"hello").encode()),
        record(b"response", b"urn:uuid:3", plain, http, b"WARC-Payload-Digest: sha1:WRONG"),
        record(b"resource", b"urn:uuid:4", b"raw \xff bytes", b"Content-Type: image/png"),
        record(b"revisit", b"urn:uuid:5", b"", b"WARC-Refers-To: <urn:uuid:1>"),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(parts[:3]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, parts[3:])))
    (tmp_path / "empty.warc").write_bytes(b"")
    got = {r.record_id: r for r in warc.read(spark, str(tmp_path)).collect()}
    assert len(got) == 6 and {r.page_id for r in got.values()} == {None}
    assert [bytes(got[f"urn:uuid:{k}"].payload) for k in (1, 2, 4)] == [b"hello", b"hello", b"raw \xff bytes"]
    assert [got[f"urn:uuid:{k}"].complete for k in range(6)] == [True, True, True, False, True, True]
    assert got["urn:uuid:1"].url == "http://a.example/" and got["urn:uuid:5"].payload_bytes is None


def whole(k, block=b"some text"):
    return warc._record("resource", f"urn:uuid:{k}", block) + b"\r\n\r\n"


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_reading_goes_on_after_damage(piece):
    """A record of each kind of damage between two good ones; pieces may end anywhere."""
    long = whole(1).replace(b"Content-Length: 9", b"Content-Length: 12")
    huge = whole(1).replace(b"Content-Length: 9", b"Content-Length: 99999")
    endless = whole(1).replace(b"Content-Length: 9", b"Content-Length: 999999999999")
    nothing = whole(1).replace(b"Content-Length: 9", b"Content-Length: x")
    for bad in (b"a junk line\r\n", long, huge, endless, nothing, whole(1)[:-9], whole(1)[:40], b"\r\nWARC/", b"\n", b"\0" * 3000):
        raw = whole(0) + bad + b"\r\n" + whole(2) + whole(3, b"")
        got = list(warc.scan(raw[k : k + piece] for k in range(0, len(raw), piece)))
        assert [f and f["warc-record-id"] for f, _ in got] == ["<urn:uuid:0>", None, "<urn:uuid:2>", "<urn:uuid:3>"], bad
    assert list(warc.scan([])) == [] and [f for f, _ in warc.scan([b"junk"])] == [None]
    assert [f is None for f, _ in warc.scan([whole(0), None, None, whole(1), None])] == [False, True, False, True]
    with pytest.raises(ValueError):
        list(warc.parse(whole(0) + b"junk"))


def test_damaged_files_lose_only_what_is_damaged(spark, tmp_path):
    r = random.Random(3)
    members = [gzip.compress(whole(k, r.randbytes(3000))) for k in range(6)]
    spoilt = bytearray(members[2])
    spoilt[len(spoilt) // 2 : len(spoilt) // 2 + 40] = bytes(40)
    (tmp_path / "a.warc.gz").write_bytes(b"".join([*members[:2], bytes(spoilt), members[3]]))
    (tmp_path / "b.warc.gz").write_bytes(members[4] + members[5][:-1500])
    lost = list(warc.records(7, 1, "u", b"payload " * 500, None, 600))
    (tmp_path / "c.warc").write_bytes(b"\r\n\r\n".join(lost[1:]) + b"\r\n\r\njunk")
    odd = warc._record("continuation", "urn:uuid:8", b"x", WARC_Segment_Number="two", WARC_Segment_Origin_ID="<urn:uuid:9>") + b"\r\n\r\n"
    (tmp_path / "d.warc").write_bytes(odd + whole(10))
    got = sorted((x.record_id or "", x.complete, x.page_id) for x in warc.read(spark, str(tmp_path)).collect())
    good = [(f"urn:uuid:{k}", True, None) for k in (0, 1, 3, 4, 10)]
    assert got == sorted([*good, ("", False, None), ("", False, None), ("", False, None), ("urn:page:7#1", False, 7), ("urn:uuid:8", False, None)])


def test_a_large_file_is_inflated_by_pieces(tmp_path):
    """200 MB of records in one gzip member, of which a piece and a record are held at a time."""
    import tracemalloc

    block = bytes(range(256)) * 4000
    raw = gzip.compress(whole(1, block) * 200, compresslevel=1)
    tracemalloc.start()
    n = sum(len(b) for _, b in warc.scan(warc.inflated(raw)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 200 * len(block) and peak < 12 << 20
