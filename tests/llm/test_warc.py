"""The WARC reader on archives put together by hand."""

import base64
import hashlib
import io
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from threadloom.llm import warc


def record(block=b"", version="WARC/1.1", end=b"\r\n\r\n", **headers):
    given = {"WARC-Type": "metadata", "WARC-Record-ID": "<urn:uuid:1>", "WARC-Date": "2024-01-01T00:00:00Z", "Content-Length": str(len(block))} | {k.replace("_", "-"): v for k, v in headers.items()}
    return "\r\n".join([version, *(f"{k}: {v}" for k, v in given.items() if v is not None)]).encode() + b"\r\n\r\n" + block + end


HTTP = b"HTTP/1.1 200 OK\r\ncontent-length: 3\r\n\r\nabc"


def test_records_of_all_types():
    for kind in ("warcinfo", "request", "metadata", "resource", "conversion", "continuation"):
        got = warc.parse_record(record(b"x: y\r\n", WARC_Type=kind))
        assert (got["record_type"], got["payload"], got["page_id"], got["record_id"]) == (kind, b"x: y\r\n", None, "<urn:uuid:1>")
    got = warc.parse_record(record(HTTP, version="WARC/1.0", WARC_Type="response", Content_Type="application/http; msgtype=response"))
    assert (got["payload"], got["payload_bytes"], got["payload_digest"]) == (b"abc", 3, hashlib.sha1(b"abc").hexdigest())
    got = warc.parse_record(record(HTTP[:-3], WARC_Type="revisit", Content_Type="application/http", WARC_Refers_To="<urn:uuid:0>"))
    assert (got["payload"], got["payload_bytes"], got["payload_digest"], got["refers_to_id"]) == (None, 3, None, "<urn:uuid:0>")


def test_header_forms():
    raw = b"WARC/1.0\r\nwarc-type:resource\r\nWARC-RECORD-ID:<x>\r\nWarc-Date: \t2024\r\ncontent-length:2\r\nWARC-Target-URI: http://a/%25\r\nNote: one\r\n two\r\nWARC-Concurrent-To: <a>\r\nWARC-Concurrent-To: <b>\r\n\r\nhi\r\n\r\n"
    got = warc.parse_record(raw)
    assert (got["record_type"], got["payload"], got["url"]) == ("resource", b"hi", "http://a/%25")
    for kind in ("sha1", "sha-256", "md5"):
        value = hashlib.new(kind.replace("-", ""), b"hi").digest()
        for text in (value.hex(), base64.b32encode(value).decode().rstrip("=")):
            assert warc.parse_record(record(b"hi", WARC_Payload_Digest=f"{kind}:{text}", WARC_Block_Digest=f"{kind}:{text}"))["payload"] == b"hi"
    assert warc.parse_record(record(b"hi", WARC_Payload_Digest="blake9:zz"))["payload"] == b"hi"


@pytest.mark.parametrize(
    "raw",
    [
        b"", b"WARC/1.1\r\n", record(b"x", version="HTTP/1.1"), record(b"x", WARC_Date=None), record(b"x", Content_Length="2"), record(b"x", Content_Length="one"),
        record(b"x", end=b"\r\n"), record(b"x", WARC_Payload_Digest="sha1:" + "a" * 40), record(b"x", WARC_Block_Digest="sha1:zz"),
        record(HTTP, WARC_Type="response", Content_Type="application/http", WARC_Block_Digest="md5:" + hashlib.md5(b"").hexdigest()),
        record(HTTP + b"d", WARC_Type="response", Content_Type="application/http"), record(b"none", WARC_Type="response", Content_Type="application/http"),
        record(b"x").replace(b"WARC-Date:", b"WARC-Date"), record(b"x").replace(b"WARC-Date", b"WARC-Type"),
    ],
)
def test_bad_records(raw):
    with pytest.raises(ValueError):
        warc.parse_record(raw)


def test_cut_off_and_encoded_payloads_may_differ_in_length():
    chunked = HTTP.replace(b"content-length: 3", b"content-length: 9\r\nTransfer-Encoding: chunked")
    assert warc.parse_record(record(chunked, WARC_Type="response", Content_Type="application/http"))["payload_bytes"] == 3
    assert warc.parse_record(record(HTTP + b"d", WARC_Type="response", Content_Type="application/http", WARC_Truncated="length"))["payload_bytes"] == 4


def archive(records, dictionary=b"", compressed=False, between=b""):
    pack = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor()
    shown = zstandard.ZstdCompressor().compress(dictionary) if compressed else dictionary
    return (warc.leading_frame(shown) if dictionary else b"") + between.join(map(pack.compress, records))


def test_archives():
    records = [record(b"payload %d " % i * 20, WARC_Record_ID=f"<urn:uuid:{i}>") for i in range(40)]
    trained = zstandard.train_dictionary(2048, [r + bytes([i]) for i, r in enumerate(records)] * 8).as_bytes()
    skipped = struct.pack("<II", 0x184D2A50, 3) + b"abc"
    for dictionary in (b"", trained):
        for compressed in (False, True):
            for between in (b"", skipped):
                raw = archive(records, dictionary, compressed, between)
                for chunk in (7, 1 << 20):
                    got = list(warc.read_archive(io.BytesIO(raw), chunk))
                    assert [r for _, r in got] == records
                    assert all(warc.struct.unpack("<I", raw[at : at + 4])[0] == 0xFD2FB528 for at, _ in got)
    raw = archive(records, trained)
    for bad in (raw[:-3], raw[:20], raw + b"junk that is no frame"):
        with pytest.raises(ValueError, match="^at "):
            list(warc.read_archive(io.BytesIO(bad)))
    assert list(warc.read_archive(io.BytesIO(b""))) == []


def test_errors_name_archive_and_place(spark, tmp_path):
    good = record(b"x")
    (tmp_path / "a.warc.zst").write_bytes(archive([good, good.replace(b"2024", b"20246").replace(b"Content-Length: 1", b"Content-Length: 7")]))
    names = spark.createDataFrame([(f"file://{tmp_path}/a.warc.zst",)], "archive string")
    with pytest.raises(Exception, match=r"a\.warc\.zst: at \d+: block of 1 bytes, Content-Length 7"):
        warc.read_archives(spark, names).collect()


def test_records_of_other_archives(spark, tmp_path):
    (tmp_path / "b.warc.zst").write_bytes(archive([record(b"info", WARC_Type="warcinfo"), record(HTTP, WARC_Type="response", Content_Type="application/http", WARC_Target_URI="http://a/%0A")]))
    got = warc.read_archives(spark, spark.createDataFrame([(f"file://{tmp_path}/b.warc.zst",)], "archive string")).orderBy("place").collect()
    assert [(r["record_type"], r["page_id"], r["url"], bytes(r["payload"])) for r in got] == [("warcinfo", None, None, b"info"), ("response", None, "http://a/%0A", b"abc")]


def test_round_trip_after_a_shuffle(spark):
    rows = [(i, f"http://x/{i}", "é" * (400 + i % 5 * 60)) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    last = {h: i for i, _, h in rows}
    for df in (pages, pages.repartition(8), pages.groupBy("page_id").agg(F.max("url").alias("url"), F.max("html").alias("html"))):
        got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect()}
        for i, _, h in rows:
            n = len(h.encode())
            assert got[i] == (n, "revisit" if n >= 1000 and last[h] != i else "response", last[h] if n >= 1000 and last[h] != i else None)
