"""Legacy web archives: ARC files of versions 1 and 2 are parsed by their header lines and declared lengths and converted to WARC.

Archives are packed in the tasks, at most about ARCHIVE_BYTES of records each, every record a gzip member of its own, and written by Spark
as one file each, into any folder that Spark can write to; they are read with Spark's binaryFile source, so a task holds a few archives
and one record unpacked. Which of the records with one payload is the response is settled by an aggregation over digests.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SALTS, dealt, discard, folder, forget, materialize, place, quoted, text_bytes

#: Bytes of records, before compression, at which an archive is closed.
ARCHIVE_BYTES = 16 << 20
#: Bytes of records handed to Spark at a time.
_BATCH = 4 << 20
#: A gzip member without content. The text writer ends each file with a separator; it is the last byte of this member, a zero.
_EMPTY = gzip.compress(b"", 1, mtime=0)

#: Header lines of the two versions of ARC, and the WARC profile of revisits.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Values are parted by blanks, but a URL may hold some; so lines are read from their end.
_HEADER = {
    1: re.compile(rb"(?P<url>\S.*) (?P<ip>\S+) (?P<date>\d{4,14}) (?P<mime>\S+) (?P<length>\d{1,18})"),
    2: re.compile(rb"(?P<url>\S.*) (?P<ip>\S+) (?P<date>\d{4,14}) (?P<mime>\S+) (?P<status>\d{3}|-) (?P<checksum>\S+) (?P<location>\S+) (?P<offset>\d{1,18}) (?P<name>\S+) (?P<length>\d{1,18})"),
}


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes) -> bytes:
    """data as a gzip member, the same on every machine."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def opened(data: bytes) -> io.BufferedIOBase:
    """An archive's bytes, plain or in gzip members, as a stream."""
    return gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)


def arc_url(url: str | None) -> bytes:
    """A URL without blanks, control characters and characters beyond ASCII; about:blank for null and empty ones."""
    return quote(url, safe="%/:=&?~#+!$,;'@()*[]").encode() if url else b"about:blank"


def payload_of(content: bytes) -> tuple[bytes, bytes]:
    """(HTTP headers with their blank line, payload); without HTTP headers all is payload."""
    if content.startswith(b"HTTP/") and (end := content.find(b"\r\n\r\n")) >= 0:
        return content[: end + 4], content[end + 4 :]
    return b"", content


def whole(text: str | None) -> int | None:
    """A whole number of 64 bits, or None."""
    return n if text and re.fullmatch(r"-?\d{1,19}", text) and -(2**63) <= (n := int(text)) < 2**63 else None


def field(headers: bytes, name: str) -> str | None:
    """The first value of a header, its name compared without case."""
    for line in headers.split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if colon and key.strip().lower() == name.lower().encode():
            return value.strip().decode("utf-8", "replace")
    return None


# --- ARC ---
def arc_block(version: int, name: str, date: str) -> bytes:
    """The version block that starts an archive."""
    body = f"{version} 0 ledgerloom\n{ARC_FIELDS[version]}\n".encode()
    own = f"filedesc://{name} 0.0.0.0 {date} text/plain".encode()
    return own + (b" %d\n" % len(body) if version == 1 else b" 200 - - 0 %s %d\n" % (name.encode(), len(body))) + body


def arc_record(version: int, name: str, offset: int, url: bytes, ip: str, date: str, mime: str, status: str, content: bytes) -> bytes:
    """The blank line before a record, its header line, and its content."""
    own = b"\n%s %s %s %s" % (url, ip.encode(), date.encode(), mime.encode())
    return own + (b" %d\n" % len(content) if version == 1 else b" %s %s - %d %s %d\n" % (status.encode(), sha1(content).encode(), offset, name.encode(), len(content))) + content


def arc_records(f: io.BufferedIOBase) -> Iterator[dict]:
    """The records of an archive in order, each with version, offset, its header's values, content and problem.

    The version is that of the block at the start, 1 without one. A line that is no header of this version is passed over up to the next
    that is one: bad-header says so once. A content shorter than declared, or an archive that breaks off, ends the archive: truncated.
    """
    version, name, bad, at = 1, None, False, 0
    try:
        while True:
            at = f.tell()
            line = f.readline()
            if not line:
                return
            if not (line := line.rstrip(b"\r\n")).strip():
                continue
            first = line.startswith(b"filedesc://")
            found = (_HEADER[2].fullmatch(line) or _HEADER[1].fullmatch(line)) if first else _HEADER[version].fullmatch(line)
            if not found:
                if not bad:
                    yield {"offset": at, "version": version, "archive": name, "problem": "bad-header"}
                bad = True
                continue
            bad = False
            values = {k: v.decode("utf-8", "replace") for k, v in found.groupdict().items()}
            content = f.read(length := int(values["length"]))
            if first:
                version, name = (2 if content.startswith(b"2") else 1), values["url"].removeprefix("filedesc://")
            values |= {"offset": at, "version": version, "archive": name, "length": length}
            if len(content) < length:
                yield values | {"problem": "truncated"}
                return
            yield values | {"content": content, "problem": None}
    except (EOFError, OSError, zlib.error):
        yield {"offset": at, "version": version, "archive": name, "problem": "truncated"}


# --- WARC ---
def warc_date(date: str) -> str:
    """A date of ARC, of 4 to 14 digits, as one of WARC; missing parts are the first."""
    d = date + "00000101000000"[len(date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def warc_info(name: str) -> bytes:
    block = b"software: ledgerloom\r\nformat: WARC File Format 1.1\r\n"
    made = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
    return warc_record(made, block)


def warc_records(f: io.BufferedIOBase) -> Iterator[dict]:
    """The records of an archive, each with offset, fields (names in lower case), block and problem: as for arc_records()."""
    bad, at = False, 0
    try:
        while True:
            at = f.tell()
            line = f.readline()
            if not line:
                return
            if not line.strip():
                continue
            fields: dict[str, str] = {}
            if line.startswith(b"WARC/"):
                while (own := f.readline()).strip():
                    key, _, value = own.decode("utf-8", "replace").partition(":")
                    fields.setdefault(key.strip().lower(), value.strip())
            if not fields.get("content-length", "").isdigit():
                if not bad:
                    yield {"offset": at, "fields": fields, "problem": "bad-header"}
                bad = True
                continue
            bad = False
            block = f.read(length := int(fields["content-length"]))
            if len(block) < length:
                yield {"offset": at, "fields": fields, "problem": "truncated"}
                return
            yield {"offset": at, "fields": fields, "block": block, "problem": None}
    except (EOFError, OSError, zlib.error):
        yield {"offset": at, "fields": {}, "problem": "truncated"}


# --- archives on Spark ---
def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    names = batch.schema.names
    for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
        yield dict(zip(names, row, strict=True))


def _batched(rows: Iterator[dict], schema: pa.Schema, size: Callable[[dict], int]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for row in rows:
        held.append({k: row.get(k) for k in schema.names})
        n += 200 + size(row)
        if n >= _BATCH:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _packed(start: Callable[[int, str], bytes], record: Callable[[int, str, int, dict], bytes], label: str, most: int, rows: Callable[[pa.RecordBatch], Iterator[dict]] = _rows) -> Callable:
    """Rows to archives, one row each: for each value of the column version an archive is open until it has `most` bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, task = 0, TaskContext.get().partitionId()
        open_: dict[int, tuple[str, list[bytes], list[int]]] = {}
        closed = lambda parts: pa.RecordBatch.from_arrays([pa.array([b"".join(parts) + _EMPTY[:-1]], pa.binary())], ["archive"])
        for row in (r for b in batches for r in rows(b)):
            version = row["version"]
            if version not in open_:
                name = f"{label}-{task:06d}-{made:06d}"
                made += 1
                first = start(version, name)
                open_[version] = name, [member(first)], [len(first)]
            name, parts, at = open_[version]
            data = record(version, name, at[0], row)
            parts.append(member(data))
            at[0] += len(data)
            if at[0] >= most:
                yield closed(parts)
                del open_[version]
        for _, parts, _ in open_.values():
            yield closed(parts)

    return pack


def _write(rows: DataFrame, pack: Callable, path: str) -> None:
    archives = rows.mapInArrow(pack, "archive binary").select(F.col("archive").cast("string"))
    archives.write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


def _read(spark: SparkSession, path: str, parse: Callable[[io.BufferedIOBase], Iterator[dict]], schema: str, size: Callable[[dict], int]) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (row | {"file": file} for b in batches for file, data in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), strict=True) for row in parse(opened(data)))
        yield from _batched(each, arrow, size)

    return _files(spark, path).mapInArrow(parsed, schema)


def write_arc(captures: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write captures (url, ip, date, mime, status, content, version) as ARC files, of version 1 or 2 by the column.

    date is of 14 digits. Null ip, date, mime, status, content and version are 0.0.0.0, 19700101000000, no-type, -, empty and 1. URLs are
    escaped where a header line cannot hold them. An empty table writes no archive.
    """

    def record(version: int, name: str, offset: int, row: dict) -> bytes:
        word = lambda v, other: re.sub(r"\s+", "", v or "") or other
        return arc_record(version, name, offset, arc_url(row["url"]), word(row["ip"], "0.0.0.0"), word(row["date"], "19700101000000"), word(row["mime"], "no-type"), word(row["status"], "-"), row["content"] or b"")

    own = [quoted(captures.columns[place(captures.columns, c)]).alias(c) for c in ("url", "ip", "date", "mime", "status", "content", "version")]
    rows = captures.select(*own).withColumn("version", F.when(F.col("version") == 2, 2).otherwise(1))
    _write(rows, _packed(lambda v, name: arc_block(v, name, "19700101000000"), record, "arc", archive_bytes), path)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """(file, archive, offset, version, url, ip, date, mime, status, length, headers, payload, problem): a row for each record of the
    archives below path, the version blocks left out, and for each place where an archive cannot be read on (problem, other values null).

    Files are read whole, so one takes its size as memory; write_arc() and convert() bound them.
    """

    def parse(f: io.BufferedIOBase) -> Iterator[dict]:
        for r in arc_records(f):
            if not r.get("url", "").startswith("filedesc://") or r["problem"]:
                headers, payload = payload_of(r["content"]) if r["problem"] is None else (None, None)
                yield r | {"headers": headers, "payload": payload}

    schema = "file string, archive string, offset long, version int, url string, ip string, date string, mime string, status string, length long, headers binary, payload binary, problem string"
    return _read(spark, path, parse, schema, lambda r: len(r["payload"] or b""))


def _synthetic(f: io.BufferedIOBase, file: str, key_header: str) -> Iterator[dict]:
    """The records of an archive of ARC that are sound, with what WARC says of them besides. Record ids follow from archive, offset, URL,
    date and payload, so every reading gives the same."""
    for r in arc_records(f):
        if r["problem"] is None and not r["url"].startswith("filedesc://"):
            headers, payload = payload_of(r["content"])
            digest = sha1(payload)
            rid = uuid.uuid5(uuid.NAMESPACE_URL, "\n".join([r["archive"] or file, str(r["offset"]), r["url"], r["date"], digest]))
            yield r | {"headers": headers, "payload": payload, "http": bool(headers), "digest": digest, "payload_bytes": len(payload), "record_id": f"<urn:uuid:{rid}>", "warc_date": warc_date(r["date"]), "key": whole(field(headers, key_header))}


def index_arc(spark: SparkSession, path: str, key_header: str) -> DataFrame:
    """(file, offset, url, warc_date, record_id, digest, payload_bytes, http, key): the records of read_arc() without a problem and without their
    payloads. key is the whole number in the HTTP header `key_header`, null without one."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = "file string, offset long, url string, warc_date string, record_id string, digest string, payload_bytes long, http boolean, key long"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (row | {"file": file} for b in batches for file, data in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), strict=True) for row in _synthetic(opened(data), file, key_header))
        yield from _batched(each, arrow, lambda r: 200)

    return _files(spark, path).mapInArrow(parsed, schema)


def revisits(index: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(file, offset, refers_to, refers_to_url, refers_to_date) of the records of index_arc() that revisit another.

    Of records with equal payloads of at least min_bytes the one of the largest key (then of the last archive and offset) is the response, the
    others revisit it; a null key comes before all others. Payloads compare by SHA-1 and length. Records without HTTP headers revisit nothing.
    """
    same = ["digest", "payload_bytes"]
    order = F.struct(F.col("key").isNotNull().alias("has"), "key", "file", "offset", "record_id", "url", "warc_date")
    rows = index.where(F.col("http") & (F.col("payload_bytes") >= min_bytes)).withColumn("_salt", F.pmod(F.xxhash64("file", "offset"), F.lit(SALTS)))
    # A payload that occurs again is copied to those tasks only that have rows of it.
    first = rows.groupBy(*same).agg(F.max(order).alias("first"), F.count("*").alias("n"), F.collect_set("_salt").alias("_salt")).where("n > 1")
    first = first.select(*same, F.explode("_salt").alias("_salt"), "first")
    met = rows.select("file", "offset", "record_id", *same, "_salt").join(first, [*same, "_salt"]).where("record_id <> first.record_id")
    return met.select("file", "offset", F.col("first.record_id").alias("refers_to"), F.col("first.url").alias("refers_to_url"), F.col("first.warc_date").alias("refers_to_date"))


def convert(spark: SparkSession, arc: str, warc: str, key_header: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the records of the ARC files below `arc` as WARC files below `warc`.

    Types: revisit by revisits(), response for other records with HTTP headers, resource for those without. A revisit holds the HTTP headers
    only, so the length they declare is the payload's. Records with a problem (see read_arc()) are left out. Payloads stay in the archives
    until they are written: an index of digests settles the revisits, and each archive meets the list of its own.
    """
    index = materialize(index_arc(spark, arc, key_header), "index")
    own = revisits(index, min_bytes).groupBy("file").agg(F.collect_list(F.struct("offset", "refers_to", "refers_to_url", "refers_to_date")).alias("revisits"))
    own = materialize(own, "revisits")  # written, its size is known: the planner broadcasts it if it is small and deals archives by file if not

    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        for file, data, again in zip(batch.column("file").to_pylist(), text_bytes(batch.column("content")), batch.column("revisits").to_pylist(), strict=True):
            to = {r["offset"]: r for r in again or ()}
            for r in _synthetic(opened(data), file, key_header):
                yield r | {"version": 1, "again": to.get(r["offset"])}

    def record(version: int, name: str, offset: int, r: dict) -> bytes:
        again = r["again"]
        block = r["headers"] + (b"" if again else r["payload"])
        fields = [("WARC-Type", "revisit" if again else "response" if r["http"] else "resource"), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["warc_date"]), ("WARC-Target-URI", r["url"]), ("WARC-IP-Address", None if r["ip"] == "0.0.0.0" else r["ip"])]
        fields += [("WARC-Payload-Digest", f"sha1:{r['digest']}"), ("WARC-Block-Digest", f"sha1:{sha1(block)}")]
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", again["refers_to"]), ("WARC-Refers-To-Target-URI", again["refers_to_url"]), ("WARC-Refers-To-Date", again["refers_to_date"])] if again else []
        return warc_record([*fields, ("Content-Type", "application/http; msgtype=response" if r["http"] else r["mime"])], block)

    pack = _packed(lambda _, name: warc_info(name), record, "warc", archive_bytes, rows)
    _write(_files(spark, arc).join(own, "file", "left"), pack, warc)
    discard(index, own)


def read_warc(spark: SparkSession, path: str, key_header: str) -> DataFrame:
    """(file, offset, warc_type, record_id, date, url, key, payload_bytes, digest, sound, refers_to, problem): a row for each record of the archives
    below path but warcinfo, and for each place where one cannot be read on.

    digest is that of the payload as declared, bare. payload_bytes is of the full payload: for a revisit the Content-Length of its HTTP
    headers. sound: the block, and the payload if it is there, have the digests that are declared.
    """

    def parse(f: io.BufferedIOBase) -> Iterator[dict]:
        for r in warc_records(f):
            own, kind = r["fields"], r["fields"].get("warc-type")
            if r["problem"]:
                yield {"offset": r["offset"], "problem": r["problem"]}
            elif kind != "warcinfo":
                headers, payload = payload_of(r["block"])
                digest, declared = own.get("warc-payload-digest", "").removeprefix("sha1:") or None, field(headers, "Content-Length")
                size = int(declared) if kind == "revisit" and declared and declared.isdigit() else len(payload)
                sound = own.get("warc-block-digest") in (None, f"sha1:{sha1(r['block'])}") and (kind == "revisit" or digest in (None, sha1(payload)))
                yield {"offset": r["offset"], "warc_type": kind, "record_id": own.get("warc-record-id"), "date": own.get("warc-date"), "url": own.get("warc-target-uri"), "key": whole(field(headers, key_header)), "payload_bytes": size, "digest": digest, "sound": sound, "refers_to": own.get("warc-refers-to")}

    schema = "file string, offset long, warc_type string, record_id string, date string, url string, key long, payload_bytes long, digest string, sound boolean, refers_to string, problem string"
    return _read(spark, path, parse, schema, lambda r: 200)


KEY = "X-Page-Id"


def captures(pages: DataFrame, date: str = "20000101000000") -> DataFrame:
    """Pages (page_id, url, html) as captures for write_arc(): an HTTP response each, with the page_id in a header. Null html is an empty
    payload. Odd page_ids go to archives of version 2, others and null ones to those of version 1."""
    page_id, url, html = (quoted(pages.columns[place(pages.columns, c)]) for c in ("page_id", "url", "html"))
    payload = F.coalesce(html.cast("binary"), F.lit(b""))
    own = F.when(page_id.isNull(), "").otherwise(F.concat(F.lit(f"{KEY}: "), page_id.cast("string"), F.lit("\r\n")))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), own, F.lit("Content-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    odd: Column = F.coalesce(page_id % 2 != 0, F.lit(False))
    return pages.select(url.cast("string").alias("url"), F.lit(None).cast("string").alias("ip"), F.lit(date).alias("date"), F.lit("text/html").alias("mime"), F.lit("200").alias("status"), F.concat(head.cast("binary"), payload).alias("content"), F.when(odd, 2).otherwise(1).alias("version"))


def archived(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each row of pages, as read from the WARC files that its ARC files,
    of both versions, are converted to. refers_to is the page_id of the response that a revisit refers to. The WARC files stay if path says where.

    Null and empty html is an empty payload, long html one record. Repeated rows have a record each: one of them is the response. A null page_id
    comes before all others. An empty table gives no rows. Other columns are not read.
    """
    spark = pages.sparkSession
    legacy, made = folder(spark, "arc"), path or folder(spark, "warc")
    write_arc(captures(pages), legacy)
    convert(spark, legacy, made, KEY, min_bytes)
    forget(legacy)
    records = materialize(read_warc(spark, made, KEY), "records")
    if not path:
        forget(made)
    ends = records.where("warc_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("key").alias("page"))
    again = dealt(records.where("warc_type = 'revisit'"), ends, ["refers_to"], "left")
    columns = lambda df, to: df.select(F.col("key").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("warc_type").alias("record_type"), to.cast("long").alias("refers_to"))
    return columns(records.where("warc_type <> 'revisit'"), F.lit(None)).unionByName(columns(again, F.col("page")))
