"""Zstandard-compressed WARC archives: one zstd frame per record, the dictionary in the leading skippable frame.

Archives lie in the shared folder (any file system that pyarrow.fs opens by URI). They are written and read as streams, record by
record, so neither an archive's size nor its number of records needs memory. A task that runs again rewrites its archive
under the same name: parts are written beside it and moved into place.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, shuffle_partitions, stage

SKIPPABLE = 0x184D2A5D
DICTIONARY_BYTES = 32 * 1024
LEAST_REVISIT = 1000
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
# Headers that every record has, versions, and digests that can be checked.
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
VERSIONS = (b"WARC/1.1", b"WARC/1.0", b"WARC/0.18")
DIGESTS = ("sha1", "sha256", "sha512", "md5")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
OWN_ID = re.compile(r"<urn:page:(\d+|-\d+)>")
RECORDS = "record_id string, record_type string, page_id long, url string, payload_digest string, payload_bytes long, refers_to_id string, payload binary, archive string, place long"


def record_id(page_id) -> str:
    return "<urn:page:null>" if page_id is None else f"<urn:page:{page_id}>"


def build_record(page_id, url, payload: bytes, digest: bytes, refers_to) -> bytes:
    """A WARC/1.1 response record, or a revisit record without payload if refers_to is given. digest: SHA-1 of the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_headers(lines: list[str]) -> dict[str, str]:
    """Header lines as names in lower case -> values. White space around values does not count; a line that begins with white space
    goes on with the one before. ValueError for lines without a name, and for repeated names other than WARC-Concurrent-To."""
    headers: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (" ", "\t") and last:
            headers[last] += " " + line.strip()
            continue
        name, sep, value = line.partition(":")
        last = name.strip().lower()
        if not sep or not last or " " in last:
            raise ValueError(f"bad header line {line[:80]!r}")
        if last in headers and last != "warc-concurrent-to":
            raise ValueError(f"header {name} given twice")
        headers[last] = value.strip()
    return headers


def digest_of(stated: str | None) -> tuple[str, bytes] | None:
    """Algorithm and bytes of a digest header in base 32 or hex; None if there is none, or of an algorithm that is not known."""
    kind, sep, value = (stated or "").partition(":")
    kind = kind.strip().lower().replace("-", "")
    if not sep or kind not in DIGESTS:
        return None
    size, value = hashlib.new(kind).digest_size, value.strip()
    try:
        raw = bytes.fromhex(value) if len(value) == 2 * size else base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    except ValueError as e:
        raise ValueError(f"digest {stated!r} cannot be read") from e
    if len(raw) != size:
        raise ValueError(f"digest {stated!r} has the wrong length")
    return kind, raw


def parse_record(raw: bytes) -> dict:
    """One record of any type, WARC/1.0 or 1.1 -> record_id, record_type, page_id (of ids that this module gives, else null), url,
    payload_digest (hex SHA-1), payload_bytes, refers_to_id, payload.

    The payload is what follows the HTTP header in records of that content type, else the whole block. A revisit has none: digest
    and length are the stated ones, null where they are not. ValueError if a required header is missing or a line malformed, the
    block is not as long as Content-Length says, the payload not as long as HTTP says (unless it was encoded for transfer or cut
    off), or a digest of a known algorithm is not that of the bytes."""
    cut = raw.find(b"\r\n\r\n")
    head = raw[: max(cut, 0)].decode("utf-8").split("\r\n")
    if cut < 0 or head[0].encode() not in VERSIONS:
        raise ValueError("no WARC header")
    headers = parse_headers(head[1:])
    if missing := [x for x in REQUIRED if not headers.get(x)]:
        raise ValueError(f"headers missing: {', '.join(missing)}")
    if not headers["content-length"].isdigit():
        raise ValueError("Content-Length is no number")
    block = raw[cut + 4 : -4]
    if raw[-4:] != b"\r\n\r\n" or len(block) != int(headers["content-length"]):
        raise ValueError(f"block of {len(block)} bytes, Content-Length {headers['content-length']}")
    kind, payload, stated = headers["warc-type"].lower(), block, None
    if headers.get("content-type", "").lower().startswith("application/http"):
        http, sep, payload = block.partition(b"\r\n\r\n")
        if not sep:
            raise ValueError("no HTTP header in the block")
        fields = {n.strip().lower(): v.strip() for n, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
        stated = int(fields["content-length"]) if fields.get("content-length", "").isdigit() else None
        loose = "transfer-encoding" in fields or "warc-truncated" in headers
        if kind != "revisit" and stated not in (None, len(payload)) and not loose:
            raise ValueError(f"payload of {len(payload)} bytes, HTTP says {stated}")
    digest = digest_of(headers.get("warc-payload-digest"))
    block_digest = digest_of(headers.get("warc-block-digest"))
    for known, of in ((block_digest, block), (digest if kind != "revisit" else None, payload)):
        if known and hashlib.new(known[0], of).digest() != known[1]:
            raise ValueError("bytes differ from their digest")
    if kind == "revisit" and payload and stated is not None:
        raise ValueError("revisit record with a payload")
    if kind == "revisit":
        shown, size = (digest[1].hex() if digest and digest[0] == "sha1" else None), stated
    else:
        shown, size = hashlib.sha1(payload).hexdigest(), len(payload)
    url, number = headers.get("warc-target-uri"), OWN_ID.fullmatch(headers["warc-record-id"])
    own = headers["warc-record-id"].startswith("<urn:page:")
    return {
        "record_id": headers["warc-record-id"], "record_type": kind, "page_id": int(number[1]) if number else None,
        "url": url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%") if url is not None and own else url,
        "payload_digest": shown, "payload_bytes": size, "refers_to_id": headers.get("warc-refers-to"), "payload": None if kind == "revisit" else payload,
    }


def leading_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


def load_dictionary(raw: bytes) -> bytes:
    """The dictionary in a leading frame: as it is, or itself compressed."""
    import zstandard

    if not raw.startswith(ZSTD_MAGIC):
        return raw
    try:
        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    except zstandard.ZstdError as e:
        raise ValueError(f"bad dictionary: {e}") from e


def read_archive(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Place (offset of the frame) and raw bytes of an archive's records: the dictionary from the leading skippable frame, if the
    archive begins with one, then one record per zstd frame; other skippable frames are passed over.
    ValueError with the place if a frame is bad, or the archive ends within one."""
    import zstandard

    head, place, dictionary = stream.read(8), 0, b""
    if len(head) == 8 and struct.unpack("<II", head)[0] == SKIPPABLE:
        wanted = struct.unpack("<II", head)[1]
        frame = stream.read(wanted)
        if len(frame) != wanted:
            raise ValueError("at 0: dictionary cut off")
        dictionary, place, head = load_dictionary(frame), 8 + wanted, b""
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
    rest, frame, parts, length = head, reader.decompressobj(), [], 0
    while True:
        data = rest or stream.read(chunk)
        rest = b""
        if not data:
            if length:
                raise ValueError(f"at {place}: archive ends within a record")
            return
        try:
            parts.append(frame.decompress(data))
        except zstandard.ZstdError as e:
            raise ValueError(f"at {place}: bad frame: {e}") from e
        length += len(data)
        if frame.eof:
            rest = frame.unused_data
            if raw := b"".join(parts):
                yield place, raw
            place += length - len(rest)
            frame, parts, length = reader.decompressobj(), [], 0


def train_dictionary(pages: DataFrame, samples: int = 256) -> bytes:
    """A zstd dictionary from a bounded sample: the pages of least md5(page_id). Empty where the sample is too small to train on."""
    import zstandard

    ids = pages.select("page_id").where("page_id IS NOT NULL").orderBy(F.md5(F.col("page_id").cast("string")), "page_id").limit(samples)
    rows = pages.join(F.broadcast(ids.distinct()), "page_id").select(F.substring(F.coalesce("html", F.lit("")), 1, 20_000).alias("h")).limit(samples).collect()
    texts = [r["h"].encode() for r in rows if r["h"]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes() if len(texts) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def plan_records(pages: DataFrame) -> DataFrame:
    """pages(page_id long, url, html) -> page_id, url, payload binary, digest binary, refers_to.

    Of records with equal payloads of LEAST_REVISIT bytes or more that of the largest page_id stays a response, the others
    revisit it. Where the largest page_id has several such rows, one of them is the response (the first by its number in a staged
    table of just these rows) and the rest revisit it. Pages without a page_id are responses. A null html is an empty payload."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    pages = pages.select("page_id", "url", payload.alias("payload")).withColumn("hex", F.sha1("payload"))
    keys = pages.where(F.length("payload") >= LEAST_REVISIT).select("page_id", "hex").where("page_id IS NOT NULL").groupBy("hex", "page_id").count()
    groups = keys.groupBy("hex").agg(F.max(F.struct("page_id", "count")).alias("last"), F.sum("count").alias("c")).where("c > 1")
    groups = stage(keys.join(groups, "hex").select("page_id", "hex", F.col("last.page_id").alias("refers_to"), F.col("last.count").alias("n_last")), "groups")
    several = groups.where("page_id = refers_to AND n_last > 1").select("page_id", "hex")
    rows = pages.join(groups.select("page_id", "hex", "refers_to", (F.col("page_id") == F.col("refers_to")).alias("last"), (F.col("n_last") > 1).alias("several")), ["page_id", "hex"], "left")
    tied = F.coalesce(F.col("last") & F.col("several"), F.lit(False))
    one = rows.where(~tied).select("page_id", "url", "payload", F.unhex("hex").alias("digest"), F.when(~F.col("last"), F.col("refers_to")).alias("refers_to"))
    if several.isEmpty():
        return one
    numbered = stage(pages.join(several, ["page_id", "hex"]).withColumn("number", F.monotonically_increasing_id()), "tied")
    first = numbered.groupBy("hex").agg(F.min("number").alias("first"))
    rest = numbered.join(first, "hex").select("page_id", "url", "payload", F.unhex("hex").alias("digest"), F.when(F.col("number") != F.col("first"), F.col("page_id")).alias("refers_to"))
    return one.unionByName(rest)


def write_archives(pages: DataFrame, path: str) -> DataFrame:
    """Write the pages as archives below path, one for each partition -> archive, n_records: one row per archive."""
    spark = pages.sparkSession
    dictionary = spark.sparkContext.broadcast(train_dictionary(pages))

    def write(batches):
        import pyarrow.fs as fs
        import zstandard
        from pyspark import TaskContext

        shared = dictionary.value
        level = {"level": 3, "write_content_size": True}
        packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(shared), **level) if shared else zstandard.ZstdCompressor(**level)
        name = f"{path}/part-{TaskContext.get().partitionId():06d}.warc.zst"
        store, at = fs.FileSystem.from_uri(name)
        store.create_dir(at.rpartition("/")[0], recursive=True)
        n, beside = 0, f"{at}.{uuid.uuid4().hex}"
        with store.open_output_stream(beside, compression=None) as out:
            out.write(leading_frame(shared))
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    pick = lambda x: None if pd.isna(x) else x
                    page, refers = pick(r.page_id), pick(r.refers_to)
                    out.write(packer.compress(build_record(None if page is None else int(page), pick(r.url), r.payload, r.digest, None if refers is None else int(refers))))
                    n += 1
        store.move(beside, at)
        yield pd.DataFrame({"archive": [name], "n_records": [n]})

    plan = plan_records(pages)
    as_text = plan.withColumn("page_id", F.col("page_id").cast("string")).withColumn("refers_to", F.col("refers_to").cast("string"))
    return stage(as_text.mapInPandas(write, "archive string, n_records long"), "archives")


def read_archives(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """archives(archive) -> the records of all archives, checked, of any type. A wrong record fails the query with the archive's name
    and the record's place in it."""

    def read(batches):
        import pyarrow.fs as fs

        for pdf in batches:
            for name in pdf["archive"]:
                store, at = fs.FileSystem.from_uri(name)
                rows, size = [], 0
                with store.open_input_stream(at, compression=None) as stream:
                    try:
                        for place, raw in read_archive(stream):
                            try:
                                rows.append(parse_record(raw) | {"archive": name, "place": place})
                            except ValueError as e:
                                raise ValueError(f"at {place}: {e}") from e
                            size += len(raw)
                            if size > 4 << 20:
                                yield _frame(rows)
                                rows, size = [], 0
                    except ValueError as e:
                        raise ValueError(f"{name}: {e}") from e
                if rows:
                    yield _frame(rows)

    return archives.select("archive").repartition(shuffle_partitions(spark)).mapInPandas(read, RECORDS)


def _frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in RECORDS.split(", ")])
    return out.astype({"page_id": "Int64", "payload_bytes": "Int64", "place": "Int64"})


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as archives, read these back -> page_id, payload_bytes, payload_digest, record_type, refers_to (page_id).

    A revisit's length and digest are those of the response that it refers to, found among the records read; its own headers
    must agree with them, else refers_to is null. One row per row of pages, repeated rows included, of which one is a response and the
    others revisit it if their payload is that long, and rows without a page_id, which are responses of their own; other columns
    are left out."""
    spark = pages.sparkSession
    archives = write_archives(pages, shared_path(spark, "warc"))
    records = stage(read_archives(spark, archives).drop("payload", "url"), "records")
    responses = records.where("record_type = 'response' AND page_id IS NOT NULL").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("full_digest"), F.col("payload_bytes").alias("full_bytes")).distinct()
    both = records.join(responses, "refers_to_id", "left")
    agrees = (F.col("full_digest") == F.col("payload_digest")) & (F.col("full_bytes") == F.col("payload_bytes"))
    return both.select(
        "page_id", F.coalesce("full_bytes", "payload_bytes").alias("payload_bytes"), F.coalesce("full_digest", "payload_digest").alias("payload_digest"),
        "record_type", F.when(agrees, F.col("refers_to")).alias("refers_to"),
    )


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to FROM r
"""
