"""WARC archives as seekable Zstandard bundles.

Each task of the scan writes its records to one archive: records are grouped into frames that are compressed apart, and a
seek table of the Zstandard seekable format (a skippable frame with the compressed and plain size of each frame) closes
the file. An index table maps each record's id to its archive, its frame, and its offset and length in the plain frame, so
one record is read with one seek and one frame.

Of records with equal payloads of at least LEAST bytes the one with the largest id is kept as a response; the others are
revisit records that refer to it. What must meet for that are digests and lengths, not payloads: they are aggregated with
a partial sum on each task, and the largest ids are joined back over salted keys, so one payload on a third of all pages
spreads over SALTS tasks.

The archives live in the shared folder. A task that runs again writes files of its own; those that the committed index
names count, others are never read.

Defined results: a null html is an empty payload; a null url is empty, and signs outside ASCII's visible ones are
percent-encoded in it; equal rows with the largest id are all responses; a row with a null id is a response and is not
referred to; other columns are ignored; an empty table gives an empty index.
"""

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Folder, unique
from .text import bound_batches, shared_folder, written

#: Bytes from which on equal payloads are stored once, and plain bytes after which a frame ends.
LEAST, FRAME = 1000, 1 << 20
#: Plain bytes of the frames that one task reads back, about.
READ = 16 << 20
#: Parts into which the pages of one payload are dealt when the kept id is joined to them.
SALTS = 32
# Magic numbers of the Zstandard seekable format, and the WARC profile of revisit records.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def warc_record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit record without payload if refers_to is given. digest: hexadecimal SHA-1."""
    body = HTTP % len(payload)
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page is None else page}>"),
        ("WARC-Target-URI", quote(url or "", safe="!#$%&'()*+,/:;=?@[]~")),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is None:
        body += payload
    else:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(body))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Fields of a record, the HTTP head and the payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a record doesn't end where its length says")
    http, _, payload = body.partition(b"\r\n\r\n")
    return fields, http, payload


def page_of(urn: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn)
    return int(found[1]) if found else None


class BundleWriter:
    """Frames of records in one file, and its seek table."""

    def __init__(self, out, frame: int = FRAME):
        self.out, self.limit, self.zstd = out, frame, zstandard.ZstdCompressor(level=3)
        self.held, self.size, self.at, self.table = [], 0, 0, []

    def add(self, record: bytes) -> tuple[int, int, int]:
        """(number of the frame, offset in the plain frame, length)."""
        if self.held and self.size + len(record) > self.limit:
            self.flush()
        place = len(self.table), self.size, len(record)
        self.held.append(record)
        self.size += len(record)
        return place

    def flush(self) -> None:
        if self.held:
            packed = self.zstd.compress(b"".join(self.held))
            self.out.write(packed)
            self.table.append((len(packed), self.size))
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries)) + entries)
        self.out.close()


class BundleReader:
    """Random access to the frames of a bundle."""

    def __init__(self, file):
        self.file = file
        file.seek(0, 2)
        end = file.tell()
        file.seek(end - 9)
        frames, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        width = 12 if flags & 0x80 else 8
        file.seek(end - 9 - frames * width)
        raw = file.read(frames * width)
        self.places, at = [], 0
        for k in range(frames):
            packed, plain = struct.unpack_from("<II", raw, k * width)
            self.places.append((at, packed, plain))
            at += packed

    def frame(self, n: int) -> bytes:
        at, packed, plain = self.places[n]
        self.file.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=plain)


INDEX = "page_id long, archive string, frame long, frame_offset long, length long"


def revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, digest and kept (the largest id with the payload) of the pages to be stored as revisits."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    each = pages.select("page_id", F.octet_length(payload).alias("bytes"), F.sha1(payload).alias("digest")).where(f"bytes >= {least} AND page_id IS NOT NULL")
    kept = each.groupBy("digest", "bytes").agg(F.max("page_id").alias("kept"), F.count("*").alias("pages")).where("pages > 1").drop("pages")
    salted = kept.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = each.withColumn("salt", F.pmod("page_id", F.lit(SALTS)).cast("int"))
    return dealt.join(salted, ["digest", "bytes", "salt"]).where("page_id <> kept").select("page_id", "digest", "kept").distinct()


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, frame: int = FRAME) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) to archives in folder, and returns the index: page_id,
    archive, frame, frame_offset and length of each."""
    bound_batches(pages.sparkSession)
    again = revisits(pages, least).withColumnRenamed("page_id", "_page")
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"), F.sha1(payload).alias("_digest"))
    rows = rows.join(again, (rows["page_id"] == again["_page"]) & (rows["_digest"] == again["digest"]), "left").select("page_id", "url", "payload", "_digest", "kept")
    names = [x.split()[0] for x in INDEX.split(", ")]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, name = Folder(folder), unique(f"part-{TaskContext.get().partitionId():06d}", ".warc.zst")
        bundle = None
        for b in batches:
            if bundle is None:
                bundle = BundleWriter(place.create(f"{name}.open"), frame)
            found = []
            for page, url, body, digest, kept in zip(*(c.to_pylist() for c in b.columns)):
                found.append((page, name, *bundle.add(warc_record(page, url, body, digest, kept))))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found), [pa.int64(), pa.string(), *[pa.int64()] * 3])], names=names)
        if bundle:
            bundle.close()
            place.move(f"{name}.open", name)

    return written(rows.mapInArrow(write, INDEX))


RECORD = "page_id long, archive_page_id long, record_type string, url string, payload_digest string, refers_to long, http_bytes long, payload binary"


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """The records that index names: page_id, archive_page_id (the id in the record itself), record_type, url,
    payload_digest (hexadecimal; that of the record), refers_to, http_bytes (the payload's length by the record's HTTP
    head) and payload (null in revisits). Rows are dealt by archive and frame to tasks of about READ plain bytes, and each
    frame is opened once."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, archive, reader, number, plain = Folder(folder), None, None, None, b""
        for b in batches:
            out, size = [], 0
            for page, name, frame, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                if name != archive:
                    if reader:
                        reader.file.close()
                    archive, reader, number = name, BundleReader(place.open(name)), None
                if frame != number:
                    number, plain = frame, reader.frame(frame)
                fields, http, body = parse_record(plain[offset : offset + length])
                revisit = fields["WARC-Type"] == "revisit"
                digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                if not revisit and hashlib.sha1(body).hexdigest() != digest:
                    raise ValueError(f"the payload of page {page} isn't what its digest says")
                stated = int(re.search(rb"Content-Length: (\d+)", http)[1])
                out.append((page, page_of(fields["WARC-Record-ID"]), fields["WARC-Type"], fields["WARC-Target-URI"], digest, page_of(fields.get("WARC-Refers-To", "")), stated, None if revisit else body))
                size += 0 if revisit else len(body)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)
        if reader:
            reader.file.close()

    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    dealt = index.repartition(max(1, -(-total // READ)), "archive", "frame").sortWithinPartitions("archive", "frame", "frame_offset")
    return dealt.select(*(x.split()[0] for x in INDEX.split(", "))).mapInArrow(read, RECORD)


def archive_digest(pages: DataFrame) -> DataFrame:
    """Writes pages to archives, reads them back and sums them up, a row for each page."""
    folder = shared_folder(pages.sparkSession)
    back = read_archives(write_archives(pages, folder), folder)
    size = F.when(F.col("record_type") == "revisit", F.col("http_bytes")).otherwise(F.octet_length("payload").cast("long"))
    return back.select(F.col("archive_page_id").alias("page_id"), size.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def duckdb_sql() -> str:
    return f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest,
  max(page_id) OVER (PARTITION BY b) AS kept FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST} AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST} AND page_id <> kept THEN kept END AS refers_to FROM d"""
