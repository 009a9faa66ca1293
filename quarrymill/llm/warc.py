"""Legacy archive conversion: ARC version 1 and 2 records to WARC/1.1.

An ARC file opens with a version block that names the header fields of its version; every record is one header
line, as many bytes as the line declares, and a line feed. The converter parses lines by their version, takes
content by declared length, and synthesises the WARC record id (name-based, so a retry writes the same record),
date, type and digests. Heads and payloads stay bytes from end to end, whatever their encoding.

Records are converted once and kept. Revisits are found from digests, ids and targets alone; these meet the records by
a broadcast of at most BROADCAST_DIGESTS rows, or else by a join that spreads frequent digests. Each row of an archive
table is one archive: a warcinfo record and records up to archive_bytes, a gzip member each. Spark's text writer
writes one archive a file, so its commit protocol covers lost executors. It must write a separator after each row: a
gzip member ends in the highest byte of its length, which is 0 below 16 MB, and this byte is the separator (longer
records span several members). Archives are read back as files whose records are cut by Content-Length.

Defined results: null html is an empty payload; a null or blank url becomes `urn:x-unknown`; null ids are written
as `page-null` and come back null; of equal payloads of at least `min_revisit_bytes` the smallest non-null page_id
is the response (rows sharing that id all are); content without an HTTP head becomes a resource record; header lines
that aren't UTF-8 are read as Latin-1; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import as_batch, in_arrow, materialise, scratch_path, slices, spread_join, utf8_rows

#: The header fields of the two ARC versions, in the order the version block lists them.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Digests (five short values each) that go to every task.
BROADCAST_DIGESTS = 200_000
#: Bytes of a gzip member at most: the highest byte of its length is 0.
MEMBER_BYTES = (1 << 24) - 1
#: Namespace of the record ids synthesised here.
RECORD_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:quarrymill:arc-record")
UNKNOWN_URL = "urn:x-unknown"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def decoded(line: bytes) -> str:
    try:
        return line.decode()
    except UnicodeDecodeError:
        return line.decode("latin-1")


# ---- ARC


def arc_version_block(name: str, version: int, date: str) -> bytes:
    lines = f"{version} 0 quarrymill\n{' '.join(ARC_FIELDS[version])}\n".encode()
    extra = " 200 - - 0 -" if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{extra} {len(lines)}\n".encode() + lines + b"\n"


def arc_record(version: int, url: str, ip: str, date: str, mime: str, content: bytes, status: int = 200, checksum: str = "-", filename: str = "-") -> bytes:
    fields = [url, ip, date, mime]
    if version == 2:
        fields += [str(status), checksum, "-", "0", filename]
    return " ".join([*fields, str(len(content))]).encode() + b"\n" + content + b"\n"


@dataclass
class ArcRecord:
    header: dict[str, str]
    content: bytes
    offset: int


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of one ARC file after its version block. A line that doesn't fit its version raises ValueError."""
    fields, at = None, 0
    while at < len(data):
        if data[at : at + 1] == b"\n":  # the line feed that ends a record
            at += 1
            continue
        end = data.index(b"\n", at)
        line = decoded(data[at:end]).rstrip("\r")
        if fields is None and not line.startswith("filedesc://"):
            raise ValueError(f"no version block before {line[:80]!r}")
        values = line.split(" ")
        size = int(values[-1])
        content = data[end + 1 : end + 1 + size]
        if len(content) != size:
            raise ValueError(f"{line[:80]!r} declares {size} bytes, {len(content)} are left")
        if fields is None:
            block = decoded(content).splitlines()
            version = int(block[0].split()[0])
            fields = block[1].split() if len(block) > 1 else ARC_FIELDS[version]
        else:
            if len(values) < len(fields):
                raise ValueError(f"{line[:80]!r} has {len(values)} of {len(fields)} fields")
            spare = len(values) - len(fields)  # blanks inside the URL
            values = [" ".join(values[: spare + 1]), *values[spare + 1 :]]
            yield ArcRecord(dict(zip(fields, values)), content, at)
        at = end + 1 + size


def arc_date(date: str) -> str:
    """14 (or fewer) digits to a WARC date."""
    digits = re.sub(r"\D", "", date)[:14]
    digits += "00000101000000"[len(digits) :]
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """HTTP head with its blank line, and body; no head where the content doesn't start as a response."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    m = re.search(rb"\r?\n\r?\n", content)
    return (content[: m.end()], content[m.end() :]) if m else (content, b"")


CONVERTED = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("warc_date", T.StringType()),
        T.StructField("ip_address", T.StringType()),
        T.StructField("mime", T.StringType()),
        T.StructField("http_head", T.BinaryType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("block_digest", T.StringType()),
        T.StructField("source_name", T.StringType()),
    ]
)
_CONVERTED = to_arrow_schema(CONVERTED)


def convert_record(archive: str, r: ArcRecord) -> tuple:
    """The WARC fields of one ARC record."""
    head, body = split_http(r.content)
    url = r.header["URL"]
    name = r.header.get("Filename", "-")
    digest = digest32(body)
    rid = uuid.uuid5(RECORD_SPACE, f"{archive} {name} {url} {r.header['Archive-date']} {r.offset} {digest}")
    return (
        f"<urn:uuid:{rid}>", url, arc_date(r.header["Archive-date"]), r.header["IP-address"], r.header["Content-type"],
        head, body, len(body), digest, digest32(r.content) if head else digest, name,
    )


def convert_arc(archives: DataFrame) -> DataFrame:
    """Rows (path, content) of whole ARC files, plain or gzip, to one row of CONVERTED per record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows, size = [], 0
                for r in read_arc(gunzip(content)):
                    rows.append(convert_record(path, r))
                    size += len(r.content)
                    if size > 8_000_000:
                        yield as_batch(_CONVERTED, list(zip(*rows)))
                        rows, size = [], 0
                if rows:
                    yield as_batch(_CONVERTED, list(zip(*rows)))

    return archives.select("path", "content").transform(in_arrow, run, CONVERTED)


def pages_to_arc(pages: DataFrame, version: int = 2, date: str = "20240101000000", archive_bytes: int = 8_000_000) -> DataFrame:
    """ARC files as rows (path, content) of about archive_bytes each, one record per page."""
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])
    spec = "path string, content binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def archive() -> pa.RecordBatch:
            name = hashlib.sha1(b"".join(parts)).hexdigest()[:16] + ".arc"
            return as_batch(schema, [[name], [arc_version_block(name, version, date) + b"".join(parts)]])

        for batch in slices(batches, 500):
            columns = [batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), utf8_rows(batch.column("html"))]
            for page_id, url, html in zip(*columns):
                url = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), (url or "").strip()) or UNKNOWN_URL
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
                name = f"page-{'null' if page_id is None else page_id}"
                parts.append(arc_record(version, url, "0.0.0.0", date, "text/html", head + html, checksum=digest32(html), filename=name))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield archive()
                    parts, size = [], 0
        if parts:
            yield archive()

    return pages.select("page_id", "url", "html").transform(in_arrow, run, spec)


# ---- WARC


def page_number(name: Column | str) -> Column:
    return F.regexp_extract(name, "^page-(-?[0-9]+)$", 1).try_cast("long")


def mark_revisits(records: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """records with `first`: name, record_id, target_uri and warc_date of the response that a revisit refers to, else null."""
    number = page_number("source_name")
    first = F.when(number.isNotNull(), F.struct(number.alias("page"), F.col("record_id"), F.col("target_uri"), F.col("warc_date")))
    repeated = records.where(F.col("payload_bytes") >= min_revisit_bytes).groupBy("payload_digest").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = materialise(repeated.where("n > 1 and first is not null"), "warc-repeated")
    if repeated.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS:
        marked = records.join(F.broadcast(repeated.drop("n")), "payload_digest", "left")
    else:
        marked = spread_join(records, repeated, ["payload_digest"], "n", F.col("record_id"), "left").drop("n")
    own = (F.col("payload_bytes") < min_revisit_bytes) | F.col("first").isNull() | (number == F.col("first.page"))
    return marked.withColumn("first", F.when(~F.coalesce(own, F.lit(False)), F.col("first")))


def warc_record(kind: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(record: bytes) -> bytes:
    """The record as one gzip member, or as several of less than 16 MB each."""
    return b"".join(gzip.compress(record[at : at + MEMBER_BYTES], 6, mtime=0) for at in range(0, len(record), MEMBER_BYTES))


def converted_record(r: dict) -> bytes:
    """The WARC record of a row of mark_revisits."""
    first, head = r["first"], r["http_head"]
    kind = "revisit" if first else "response" if head else "resource"
    digest, block = f"sha1:{r['payload_digest']}", head if first else head + r["payload"]
    return warc_record(kind, [
        ("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["warc_date"]), ("WARC-Target-URI", r["target_uri"]), ("WARC-IP-Address", r["ip_address"]), ("WARC-Payload-Digest", digest),
        ("WARC-Block-Digest", f"sha1:{digest32(block)}" if first else f"sha1:{r['block_digest']}"),
        ("WARC-Profile", REVISIT_PROFILE if first else None),
        ("WARC-Refers-To", first and first["record_id"]), ("WARC-Refers-To-Target-URI", first and first["target_uri"]), ("WARC-Refers-To-Date", first and first["warc_date"]),
        ("ARC-Source-Name", r["source_name"]), ("ARC-Refers-To-Name", first and f"page-{first['page']}"), ("ARC-Payload-Length", str(r["payload_bytes"])),
        ("Content-Type", "application/http; msgtype=response" if head else r["mime"]),
    ], block)


def warc_archives(records: DataFrame, archive_bytes: int = 16_000_000) -> DataFrame:
    """Rows (value): whole gzip archives of about archive_bytes (or one record), a warcinfo record first."""
    schema = pa.schema([("value", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, last = [], 0, ""

        def archive() -> pa.RecordBatch:
            info = b"software: quarrymill\r\nformat: WARC File Format 1.1\r\n"
            fields = [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(RECORD_SPACE, f'warcinfo {last} {size}')}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")]
            return as_batch(schema, [[members(warc_record("warcinfo", fields, info)) + b"".join(parts)]])

        date = ""
        for batch in slices(batches, 500):
            for r in batch.to_pylist():
                parts.append(members(converted_record(r)))
                size, last, date = size + len(parts[-1]), r["record_id"], r["warc_date"]
                if size >= archive_bytes:
                    yield archive()
                    parts, size = [], 0
        if parts:
            yield archive()

    return records.transform(in_arrow, run, "value binary")


def write_warc(records: DataFrame, path: str, archive_bytes: int = 16_000_000) -> None:
    rows = warc_archives(records, archive_bytes).select(F.expr("substring(value, 1, octet_length(value) - 1)").cast("string").alias("value"))
    rows.write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def inflated(data: bytes) -> Iterator[bytes]:
    """Pieces of a gzip file of one or many members; other data as it is."""
    if data[:2] != b"\x1f\x8b":
        yield bytes(data)
        return
    view, at, z = memoryview(data), 0, zlib.decompressobj(31)
    while at < len(view):
        part = view[at : at + 65_536]
        piece = z.decompress(part)
        if piece:
            yield piece
        at += len(part) - len(z.unused_data)
        if z.eof:
            z = zlib.decompressobj(31)


def gunzip(data: bytes) -> bytes:
    return b"".join(inflated(data))


def read_warc_bytes(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record, cut by Content-Length; holds one record at a time."""
    held = bytearray()
    pieces = iter(pieces)

    def until(enough) -> bool:
        while not enough():
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while until(lambda: len(held) > 0):
        if not until(lambda: held.find(b"\r\n\r\n") >= 0):
            raise ValueError(f"no record in {bytes(held[:60])!r}")
        end = held.find(b"\r\n\r\n")
        lines = decoded(bytes(held[:end])).split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record: {lines[0][:60]!r}")
        header = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(header["content-length"])
        until(lambda: len(held) >= end + 8 + size)
        block = bytes(held[end + 4 : end + 4 + size])
        if len(block) != size or held[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"{header.get('warc-record-id')}: the block is not {size} bytes")
        del held[: end + 8 + size]
        yield header, block


READ = "record_id string, record_type string, target_uri string, warc_date string, source_name string, refers_to string, refers_to_name string, payload_bytes long, payload_digest string"
_READ = pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.string()) for x in READ.split(", ")])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives under path but for warcinfo. The digest of each payload is computed anew and must equal its header's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = []
                for h, block in read_warc_bytes(inflated(batch.column("content")[k].as_py())):
                    kind = h["warc-type"]
                    if kind == "warcinfo":
                        continue
                    digest, size = h["warc-payload-digest"].removeprefix("sha1:"), int(h["arc-payload-length"])
                    if kind != "revisit":
                        body = split_http(block)[1] if kind == "response" else block
                        if digest32(body) != digest or len(body) != size:
                            raise ValueError(f"{h['warc-record-id']}: the payload doesn't match its digest")
                    rows.append((h["warc-record-id"], kind, h["warc-target-uri"], h["warc-date"], h.get("arc-source-name"), h.get("warc-refers-to"), h.get("arc-refers-to-name"), size, digest))
                if rows:
                    yield as_batch(_READ, list(zip(*rows)))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").transform(in_arrow, run, READ)


def archive_pages(pages: DataFrame, path: str | None = None, min_revisit_bytes: int = 0) -> DataFrame:
    """pages to ARC, ARC to WARC archives under path, and the archives' records read back, one row per page."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    records = materialise(convert_arc(pages_to_arc(pages)), "warc-records")
    write_warc(mark_revisits(records, min_revisit_bytes), path)
    return read_warc(spark, path).select(page_number("source_name").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_number("refers_to_name").alias("refers_to"))
