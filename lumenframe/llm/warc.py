"""WARC archives compressed by record with a Zstandard dictionary.

An archive is one file: a skippable frame that holds the dictionary, then one
Zstandard frame for each record.  Its dictionary is built from records of that
archive; a task's records make as many archives as their bytes need.  Spark's
text writer lays archives down, one a file (an empty skippable frame serves as
its line separator), so its commit protocol keeps them whole when an executor is
lost, and any store that Spark can write to will do.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.shared import prepare, shared_folder

#: Fixed values of the format: magic numbers of the dictionary frame, of a compressed frame, of an empty skippable frame.
DICTIONARY_FRAME = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
EMPTY_FRAME = "P*M\x18\0\0\0\0"
#: Bytes of records that are held back to train a dictionary from, and the dictionary's size.
TRAIN_BYTES = 16 << 20
DICTIONARY_BYTES = 112 << 10
#: Bytes of records in an archive: the record that reaches them is its last.
ARCHIVE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(page_id: int | None, nth: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}:{nth}')}>"


def _header(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n"


def make_record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None, length: int, nth: int = 0, refers_nth: int = 0) -> bytes:
    """A response record, or a revisit record if ``refers_to`` names the page whose response has this payload.

    ``nth`` tells records of one page_id apart, ``refers_nth`` says to which of them a revisit refers.
    """
    digest = "sha1:" + base64.b32encode(sha1).decode()
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "") or f"urn:page:{page_id}"
    own = "" if page_id is None else str(page_id)
    if refers_to is None:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
        kind = [("WARC-Type", "response")]
    else:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
        kind = [("WARC-Type", "revisit"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, refers_nth)), ("X-Refers-To-Page", str(refers_to))]
    fields = [*kind, ("WARC-Record-ID", record_id(page_id, nth)), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest), ("X-Page", own), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _header(fields) + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, HTTP header, payload."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = data[end + 4 : end + 4 + int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or data[end + 4 + len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    cut = block.index(b"\r\n\r\n") + 4
    return fields, block[:cut], block[cut:]


def train(records: list[bytes]) -> bytes:
    """A dictionary from records: trained on all of them, or where they are too few or too alike for that, their first bytes as raw content."""
    size = max(64, min(DICTIONARY_BYTES, sum(map(len, records)) // 10))
    if len(records) >= 8 and size >= 1024:
        try:
            return zstandard.train_dictionary(size, records, k=256, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(r[: max(8, size // len(records))] for r in records)[: max(size, 8)]


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed


def frames(records: Iterator[bytes], level: int = 3) -> Iterator[bytes]:
    """The frames of an archive: its dictionary, then each record by itself."""
    held, size = [], 0
    for record in records:
        held.append(record)
        size += len(record)
        if size >= TRAIN_BYTES:
            break
    if not held:
        return
    dictionary = train(held)
    yield dictionary_frame(dictionary)
    compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
    for record in held:
        yield compressor.compress(record)
    held.clear()
    for record in records:
        yield compressor.compress(record)


def archives(records: Iterator[bytes]) -> Iterator[bytes]:
    """Whole archives, each of about ARCHIVE_BYTES of records and led by a dictionary of its own."""
    records = iter(records)

    def one(record: bytes) -> Iterator[bytes]:
        size = 0
        while record is not None:
            yield record
            size += len(record)
            record = next(records, None) if size < ARCHIVE_BYTES else None

    for first in records:
        yield b"".join(frames(one(first)))


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive; other skippable frames are skipped."""
    at, decompressor = 0, zstandard.ZstdDecompressor()
    view = memoryview(data)
    while at < len(data):
        magic = int.from_bytes(view[at : at + 4], "little")
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            size = int.from_bytes(view[at + 4 : at + 8], "little")
            if magic == DICTIONARY_FRAME and at == 0:
                dictionary = bytes(view[8 : 8 + size])
                if dictionary.startswith(FRAME_MAGIC):
                    dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
                decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
            at += 8 + size
        else:
            one = decompressor.decompressobj()
            out, n = [], at
            while not one.eof:
                if n >= len(data):
                    raise ValueError("an archive ends within a record")
                out.append(one.decompress(view[n : n + (1 << 16)]))
                n += 1 << 16
            at = min(n, len(data)) - len(one.unused_data)
            yield b"".join(out)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records() -> Iterator[bytes]:
        for batch in batches:
            ids, urls, digests, sizes, refers, nth, refers_nth = (batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6, 7))
            html = batch.column(2).cast(pa.binary())
            for i in range(batch.num_rows):
                yield make_record(ids[i], urls[i], html[i].as_py() or b"", digests[i], refers[i], sizes[i], nth[i], refers_nth[i] or 0)

    for archive in archives(records()):
        yield pa.RecordBatch.from_arrays([pa.array([archive], pa.large_binary()).cast(pa.binary())], names=["archive"])


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) to archives under ``path``.

    Of the rows with equal payloads of at least ``least_bytes``, those with the
    largest page_id are responses and the others revisits of it; rows with
    smaller payloads are all responses, and so are rows without a page_id that
    share their payload with no page_id.  Null html is an empty payload; a null
    url becomes a URN.  Equal payloads are told by SHA-1, whose largest page_id
    is aggregated before the shuffle; the join back is split by Spark if one
    payload is very frequent.  Every record has an id of its own, also where
    rows or page_ids repeat or are null.  An empty table gives no archive.
    """
    prepare(pages.sparkSession)
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.unhex(F.sha1(html.cast("binary"))).alias("sha1"), F.octet_length(html).cast("long").alias("bytes"))
    # The place in the scan tells rows apart; ids are made of it, decisions are not.
    rows = rows.withColumn("nth", F.monotonically_increasing_id())
    last = rows.where((F.col("bytes") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("sha1").agg(F.max(F.struct("page_id", "nth")).alias("last"))
    rows = rows.join(last, "sha1", "left")
    to, small = F.col("last.page_id"), F.col("bytes") < least_bytes
    response = to.isNull() | F.col("page_id").eqNullSafe(to) | small
    rows = rows.select("page_id", "url", F.when(response, F.col("html")).alias("kept"), "sha1", "bytes", F.when(~response, to).alias("refers_to"), "nth", F.when(~response, F.col("last.nth")).alias("refers_nth"))
    packed = rows.mapInArrow(_write, "archive binary").select(F.col("archive").cast("string").alias("value"))
    packed.write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).text(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive in batch.column(0):
            rows: list[tuple] = []
            for record in read_archive(archive.as_py()):
                fields, http, payload = parse_record(record)
                kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                size = len(payload) if kind == "response" else int(http.split(b"Content-Length: ")[1].split(b"\r\n")[0])
                if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not match its digest")
                refers = fields.get("X-Refers-To-Page")
                rows.append((int(fields["X-Page"]) if fields["X-Page"] else None, size, digest, kind, int(refers) if refers else None, fields["WARC-Target-URI"], fields["WARC-Record-ID"], fields.get("WARC-Refers-To")))
                if len(rows) >= 5000:
                    yield _table(rows)
                    rows = []
            if rows:
                yield _table(rows)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "record_id", "refers_to_id"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives under ``path``; every response's payload is checked against its digest.

    A task reads one archive at a time, whole: ARCHIVE_BYTES of records, or one
    that is longer.
    """
    prepare(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, record_id string, refers_to_id string")


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and return what their records say."""
    path = shared_folder(pages.sparkSession)
    write_archives(pages, path, least_bytes)
    return read_archives(pages.sparkSession, path)
