"""WARC archives: a writer with revisit records, and a reader that splits archives by byte ranges.

Archives are files of one gzip member per record, in a folder of any store that
``pyarrow.fs`` opens by URI.  A reading task gets a byte range of one archive.
It looks for the gzip magic, takes a place for a record's start only if the
member there decodes to a WARC header, owns the records that start inside its
range and reads the last of them past the range's end.  After a record the next
one is expected right behind it; the scan for the magic starts again only where
that fails.  Tasks hold one record and one read block at a time.

Writing tasks name their archives by a fresh id, and the written table of
archive names is what counts: an attempt that was lost leaves a file that
nothing reads.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logprism.llm.common import arrow_rows
from logprism.session import run_dir, store

MAGIC = b"\x1f\x8b\x08"
READ_BLOCK = 1 << 20
#: Bytes of a range, and of an archive before the writer starts another.
RANGE_BYTES = 32 << 20
ARCHIVE_BYTES = 256 << 20
#: Bytes of a header at the most; a candidate member must show its end within them.
HEADER_BYTES = 64 << 10
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = pa.schema([
    ("archive", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()),
    ("refers_to", pa.string()), ("uri", pa.string()), ("payload_digest", pa.string()),
    ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("digest_ok", pa.bool_()),
])
RECORD_DDL = (
    "archive string, offset long, record_type string, record_id string, refers_to string, uri string, "
    "payload_digest string, payload_bytes long, payload binary, digest_ok boolean")
ARCHIVE = pa.schema([("archive", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])
ARCHIVE_DDL = "archive string, bytes long, records long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean(value: object) -> str:
    """A header value: no line ends."""
    return "" if value is None else str(value).replace("\r", "%0D").replace("\n", "%0A")


def member(record_id: str, uri: str, payload: bytes, refers_to: str | None) -> bytes:
    """One record as a gzip member; with ``refers_to`` a revisit, which leaves the payload out.

    A revisit keeps the HTTP header, so the payload's length is still known.
    """
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean(uri)}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write rows ``record_id, uri, payload (binary), refers_to`` and return the table of archives.

    Null payloads are written as empty ones.  Each task writes archives of
    about ``ARCHIVE_BYTES``.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        stream, path, size, count = None, "", 0, 0
        for batch in batches:
            for row_id, uri, payload, refers_to in zip(*(batch[c].to_pylist() for c in (
                    "record_id", "uri", "payload", "refers_to"))):
                if stream is None:
                    files.create_dir(base, recursive=True)
                    path, size, count = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    stream = files.open_output_stream(path, compression=None)
                data = member(row_id, uri, payload or b"", refers_to)
                stream.write(data)
                size, count = size + len(data), count + 1
                if size >= ARCHIVE_BYTES:
                    stream.close()
                    stream = None
                    yield arrow_rows(ARCHIVE, [[f"{folder}/{path.rsplit('/', 1)[1]}"], [size], [count]])
        if stream is not None:
            stream.close()
            yield arrow_rows(ARCHIVE, [[f"{folder}/{path.rsplit('/', 1)[1]}"], [size], [count]])

    narrow = records.select("record_id", "uri", "payload", "refers_to")
    return store(narrow.mapInArrow(write, ARCHIVE_DDL), "archives")


class Window:
    """A file's bytes from some place on, read block by block as they are asked for."""

    def __init__(self, file: pa.NativeFile, at: int):
        self.file, self.at, self.data, self.size = file, at, b"", file.size()

    def fill(self, end: int) -> bool:
        """Hold the bytes up to ``end`` if the file has so many."""
        have = self.at + len(self.data)
        if have < min(end, self.size):
            self.file.seek(have)
            self.data += self.file.read(max(READ_BLOCK, min(end, self.size) - have))
        return self.at + len(self.data) >= end

    def drop(self, before: int) -> None:
        if before - self.at > READ_BLOCK:
            self.data, self.at = self.data[before - self.at:], before


def is_record(window: Window, start: int) -> bool:
    """Does the member at ``start`` decode to a WARC header?"""
    window.fill(start + HEADER_BYTES)
    begin = start - window.at
    unpack = zlib.decompressobj(31)
    try:
        head = unpack.decompress(window.data[begin:begin + HEADER_BYTES], HEADER_BYTES)
    except zlib.error:
        return False
    return head.startswith(b"WARC/1.") and (b"\r\n\r\n" in head) and b"WARC-Type:" in head


def read_member(window: Window, start: int) -> tuple[bytes, int] | None:
    """The unpacked member at ``start`` and the place behind it; None if it is cut short or broken."""
    unpack, out, at = zlib.decompressobj(31), [], start
    try:
        while not unpack.eof:
            if not window.fill(at + 1):
                return None
            piece = window.data[at - window.at:]
            out.append(unpack.decompress(piece))
            at += len(piece)
    except zlib.error:
        return None
    return b"".join(out), at - len(unpack.unused_data)


def fields(lines: bytes) -> dict[str, str]:
    found = {}
    for line in lines.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            found[name.strip().lower()] = value.strip()
    return found


def parse(data: bytes) -> tuple | None:
    """record_type, record_id, refers_to, uri, payload_digest, payload_bytes, payload, digest_ok."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    if not blank or not head.startswith(b"WARC/1."):
        return None
    header = fields(head)
    length = header.get("content-length", "")
    if not length.isdigit():
        return None
    block = rest[:int(length)]
    http, blank, body = block.partition(b"\r\n\r\n")
    stated = fields(http).get("content-length", "")
    kind = header.get("warc-type")
    digest = header.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "revisit":
        size, body, right = int(stated) if stated.isdigit() else None, None, None
    else:
        size, right = len(body), digest is None or base32_sha1(body) == digest
        digest = base32_sha1(body)
    return (kind, header.get("warc-record-id"), header.get("warc-refers-to"), header.get("warc-target-uri"),
            digest, size, body, right)


def range_records(archive: str, start: int, end: int) -> Iterator[tuple]:
    """The records that start in the bytes ``start <= place < end`` of an archive, in order."""
    files, path = pafs.FileSystem.from_uri(archive)
    with files.open_input_file(path) as file:
        window, at, expected = Window(file, start), start, False
        while True:
            if not expected:  # look for the next magic that a WARC header follows
                while True:
                    more = window.fill(at + len(MAGIC) + READ_BLOCK)
                    found = window.data.find(MAGIC, at - window.at)
                    if found < 0:
                        if not more:
                            return
                        at = window.at + len(window.data) - len(MAGIC) + 1
                        window.drop(at)
                        if at >= end:
                            return
                        continue
                    at = window.at + found
                    if at >= end:
                        return
                    if is_record(window, at):
                        break
                    at += 1
            if at >= end:
                return
            got = read_member(window, at)
            record = parse(got[0]) if got else None
            if record is None:  # broken: go on behind its first byte
                at, expected = at + 1, False
                continue
            yield at, record
            at, expected = got[1], True
            window.drop(at)
            if at >= window.size:
                return


def read_archives(archives: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """Records of the archives in a table ``archive, bytes``, by byte ranges of ``range_bytes``.

    Broken members are passed over; an archive without any gives no rows.
    ``digest_ok`` compares the stated digest with the payload (null for revisits).
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, start in zip(batch["archive"].to_pylist(), batch["start"].to_pylist()):
                rows, held = [], 0
                for at, record in range_records(archive, start, start + range_bytes):
                    body = record[6]
                    rows.append((archive, at, *record[:6], body if payloads else None, record[7]))
                    held += len(body) if body and payloads else 100
                    if held > READ_BLOCK:
                        yield arrow_rows(RECORD, list(map(list, zip(*rows))))
                        rows, held = [], 0
                if rows:
                    yield arrow_rows(RECORD, list(map(list, zip(*rows))))

    ranges = archives.filter("bytes > 0").select("archive", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    # one task for each range: adaptive execution would merge rows as small as these
    tasks = archives.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0]
    return ranges.repartition(max(1, int(tasks or 0))).mapInArrow(read, RECORD_DDL)


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """``archive, bytes`` of the archives of a folder that something else wrote."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return files.select(F.col("path").alias("archive"), F.col("length").alias("bytes"))


def record_id(page_id) -> F.Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def archive_pages(pages: DataFrame, revisit_bytes: int = 0) -> DataFrame:
    """Write ``page_id, url, html`` as records in the shared folder; returns the table of archives.

    Of equal payloads of at least ``revisit_bytes`` bytes, the one with the
    largest page_id is a response and the others revisit it.  Rows that repeat
    that page_id with that payload are responses too, and so are all of a
    payload that only rows without page_id have.  A null html is an empty
    payload.
    """
    rows = pages.select(
        "page_id", F.col("url").alias("uri"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("_key", F.unhex(F.sha1("payload")))
    groups = (
        rows.filter(F.length("payload") >= revisit_bytes).groupBy("_key")
        .agg(F.max("page_id").alias("_keep"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    )
    marked = rows.join(groups, "_key", "left")
    other = F.col("_keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_keep"))
    records = marked.select(
        record_id(F.col("page_id")).alias("record_id"), "uri", "payload",
        F.when(other, record_id(F.col("_keep"))).alias("refers_to"))
    return write_archives(records, run_dir(pages.sparkSession, "warc"))


def pages_read_back(pages: DataFrame, revisit_bytes: int = 0, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` out of the archives of the pages."""
    records = read_archives(archive_pages(pages, revisit_bytes), range_bytes, payloads=False)

    def page(column: str) -> F.Column:
        return F.expr(f"try_cast(regexp_extract({column}, '^<urn:x-page:(-?[0-9]+)>$', 1) as bigint)")

    return records.select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page("refers_to").alias("refers_to"))
