"""Legacy archive converter: ARC files to equivalent WARC files, and readers of both.

An ARC file opens with a version block, whose first line says which header line the records
have: five fields in version 1, ten in version 2. Each record is a header line, the
declared number of bytes and a line end, here in a gzip member of its own (plain files
are read too). The converter synthesises what WARC asks for: record ids, ISO dates, record types,
block and payload digests. Records with equal payloads become revisits of the one with
the smallest page id; the grouping is an aggregation by digest and a join, and
a file's records, bounded by the roll-over size, are the only ones one task sees together.

Files go to the shared folder under names that a retried task writes anew, complete
before they are moved into place; later steps read the names that successful tasks reported.

Cases: null html is an empty payload, a null url becomes a urn, a null page id sorts last and
stays null. Rows that repeat a page id and a payload: one is the response, the others revisit it. An
empty table gives an empty result. A record that does not match its declared length raises
ValueError with its file and number.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, scratch_path

ROLL_BYTES = 32 << 20
#: Up to so many repeated payloads (about 150 bytes each) are told by a broadcast; beyond it by a shuffle that splits large groups.
BROADCAST_DIGESTS = 200_000
DATE = "20240101000000"
#: What an ARC header line says where the server's address is not known.
NO_ADDRESS = "0.0.0.0"
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Fields of our own on revisits: the payload's length, which a record without an HTTP header says nowhere else, and the page of the response.
PAYLOAD_LENGTH, REFERS_TO_PAGE = "X-Payload-Length", "Refers-To-Page-Id"
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "quernstone:arc")


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _put(uri: str, data: bytes) -> None:
    store, path = _store(uri)
    store.create_dir(posixpath.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, path)


def _get(uri: str) -> bytes:
    store, path = _store(uri)
    with store.open_input_stream(path, compression=None) as f:
        return f.read()


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(data: bytes) -> Iterator[bytes]:
    """Contents of a file's gzip members; of a plain file the whole."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while at < len(view):  # in small steps, as what follows a member is copied
        z, parts = zlib.decompressobj(31), []
        while not z.eof and at < len(view):
            step = view[at : at + 16_384]
            parts.append(z.decompress(step))
            at += len(step)
        at -= len(z.unused_data)
        yield b"".join(parts)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---- ARC


def arc_opening(name: str, version: int) -> bytes:
    body = f"{version} 0 quernstone\n{FIELDS[version]}\n".encode()
    head = f"filedesc://{name} 0.0.0.0 {DATE} text/plain " + ("200 - - 0 " + name + " " if version == 2 else "")
    return head.encode() + str(len(body)).encode() + b"\n" + body + b"\n"


def arc_record(url: str, date: str, kind: str, content: bytes, version: int, offset: int = 0, name: str = "-", address: str = NO_ADDRESS) -> bytes:
    url = re.sub(r"[\s\x00-\x1f]", lambda m: f"%{ord(m[0]):02X}", url)
    head = f"{url} {address} {date} {kind} " + (f"200 {sha1_base32(content)} - {offset} {name} " if version == 2 else "")
    return head.encode() + str(len(content)).encode() + b"\n" + content + b"\n"


@dataclass
class Entry:
    """A record of an ARC file."""

    url: str
    address: str
    date: str
    kind: str
    content: bytes


def arc_records(data: bytes, name: str = "") -> Iterator[tuple[str, str, str, bytes]]:
    """(url, date, content type, content) of an ARC file's records after its version block."""
    return ((e.url, e.date, e.kind, e.content) for e in arc_entries(data, name))


def arc_entries(data: bytes, name: str = "") -> Iterator[Entry]:
    """An ARC file's records after its version block."""
    version, number = None, 0
    for block in members(data):
        at = 0
        while at < len(block):
            if block[at : at + 1] == b"\n":
                at += 1
                continue
            end = block.find(b"\n", at)
            if end < 0:
                raise ValueError(f"{name}: record {number} has no end of its header line")
            line = block[at:end].decode("utf-8", "replace")
            count = 5 if version in (None, 1) else 10
            parts = line.rsplit(" ", count - 1)
            if version is None and line.startswith("filedesc://"):
                parts = line.split(" ")
            if not parts[-1].isdigit() or version is not None and len(parts) != count:
                raise ValueError(f"{name}: record {number} has a header line of another version: {line[:200]!r}")
            length = int(parts[-1])
            content = block[end + 1 : end + 1 + length]
            if len(content) != length:
                raise ValueError(f"{name}: record {number} declares {length} bytes and has {len(content)}")
            if version is None:
                version = int(content.split(b" ", 1)[0])
                if version not in FIELDS:
                    raise ValueError(f"{name}: ARC version {version} is not known")
            else:
                yield Entry(parts[0], parts[1], parts[2], parts[3], content)
            at, number = end + 1 + length, number + 1


def http_parts(content: bytes) -> tuple[bytes, bytes]:
    """Header block with its blank line, and payload, of a recorded HTTP response; without a header block all is payload."""
    if content.startswith(b"HTTP/"):
        for gap in (b"\r\n\r\n", b"\n\n"):
            at = content.find(gap)
            if at >= 0:
                return content[: at + len(gap)], content[at + len(gap) :]
    return b"", content


def http_field(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*(.*?)\r?$", head)
    return m[1].decode() if m else None


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", version: int = 2, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write every row as an ARC record, read as what a crawler has received; one row per file."""

    def run(batches):
        from pyspark import TaskContext

        part, k, now, size, rows = TaskContext.get().partitionId(), 0, [], 0, 0
        name = lambda: f"part-{part:06d}-{k:04d}.arc.gz"
        for batch in batches:
            for i, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = (html or "").encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n" + (f"X-Page-Id: {i}\r\n" if i is not None else "") + "\r\n"
                now.append(_member(arc_record(url or f"urn:page:{i}", DATE, "text/html", head.encode() + body, version, size, name())))
                size, rows = size + len(now[-1]), rows + 1
                if size >= roll_bytes:
                    _put(f"{path}/{name()}", _member(arc_opening(name(), version)) + b"".join(now))
                    yield pa.RecordBatch.from_pydict({"file": [f"{path}/{name()}"], "records": [rows]}, schema=out)
                    k, now, size, rows = k + 1, [], 0, 0
        if now:
            _put(f"{path}/{name()}", _member(arc_opening(name(), version)) + b"".join(now))
            yield pa.RecordBatch.from_pydict({"file": [f"{path}/{name()}"], "records": [rows]}, schema=out)

    out = pa.schema([("file", pa.string()), ("records", pa.int64())])
    rows = pages.select(F.col(id_col).cast("long").alias("i"), F.col(url_col).alias("u"), F.col(html_col).alias("h"))
    return materialise(rows.mapInArrow(run, "file string, records long"), "arc-files")


def _each(files: DataFrame) -> DataFrame:
    return files.select("file").repartition(max(1, files.count()))


def scan_arc(files: DataFrame) -> DataFrame:
    """(file, number, page_id, digest, date, url) of every record in the files."""
    out = pa.schema([("file", pa.string()), ("number", pa.int64()), ("page_id", pa.int64()), ("digest", pa.string()), ("date", pa.string()), ("url", pa.string())])

    def run(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows = []
                for k, e in enumerate(arc_entries(_get(file), file)):
                    head, payload = http_parts(e.content)
                    i = http_field(head, "X-Page-Id")
                    rows.append({"file": file, "number": k, "page_id": int(i) if i else None, "digest": sha1_base32(payload), "date": e.date, "url": e.url})
                yield pa.RecordBatch.from_pylist(rows, schema=out)

    return _each(files).mapInArrow(run, "file string, number long, page_id long, digest string, date string, url string")


def same_payload(records: DataFrame) -> DataFrame:
    """Adds first: the record (order, page_id, file, number, date, url) that a repeated payload is kept in; null for one that stands alone."""
    key = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "file", "number", "date", "url")
    firsts = materialise(records.groupBy("digest").agg(F.min(key).alias("first"), F.count("*").alias("m")).where("m > 1").drop("m"), "arc-firsts")
    if firsts.count() <= BROADCAST_DIGESTS:
        firsts = F.broadcast(firsts)
    return records.join(firsts, "digest", "left")


# ---- WARC


def record_id(file: str, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{file}:{number}')}>"


def target_of(source: str, path: str) -> str:
    """The WARC file of an ARC file: its name, and a digest of its folder, as files of two folders may share a name."""
    name = posixpath.basename(source).removesuffix(".gz").removesuffix(".arc")
    return f"{path}/{name}-{hashlib.sha1(posixpath.dirname(source).encode()).hexdigest()[:8]}.warc.gz"


def iso_date(date: str) -> str:
    date = (date + "00000101000000"[len(date) :])[:14] if len(date) < 14 else date[:14]
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def warc_record(fields: dict[str, str], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def warc_records(data: bytes, name: str = "") -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of a WARC file's records."""
    number = 0
    for block in members(data):
        at = 0
        while at < len(block):
            end = block.find(b"\r\n\r\n", at)
            lines = block[at:end].decode().split("\r\n")
            if end < 0 or not lines[0].startswith("WARC/"):
                raise ValueError(f"{name}: record {number} has no WARC header")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            length = int(fields["content-length"])
            content = block[end + 4 : end + 4 + length]
            if len(content) != length or block[end + 4 + length : end + 8 + length] != b"\r\n\r\n":
                raise ValueError(f"{name}: record {number} does not have its declared {length} bytes")
            yield fields, content
            at, number = end + 8 + length, number + 1


@dataclass
class First:
    """The record that a revisit refers to."""

    file: str
    number: int
    page: str | None
    date: str
    url: str


def convert_file(source: str, target: str, firsts: dict[int, First]) -> int:
    """Write the WARC form of one ARC file; ``firsts``: by number, for the records that revisit another."""
    name = posixpath.basename(target)
    out = [_member(warc_record({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(target, -1), "WARC-Date": iso_date(DATE), "WARC-Filename": name, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))]
    for k, e in enumerate(arc_entries(_get(source), source)):
        head, payload = http_parts(e.content)
        fields = {"WARC-Type": "response" if head else "resource", "WARC-Record-ID": record_id(source, k), "WARC-Date": iso_date(e.date), "WARC-Target-URI": e.url}
        if e.address not in (NO_ADDRESS, "-"):
            fields["WARC-IP-Address"] = e.address
        block = e.content
        if k in firsts:
            first = firsts[k]
            fields |= {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(first.file, first.number), "WARC-Refers-To-Date": iso_date(first.date), "WARC-Refers-To-Target-URI": first.url, PAYLOAD_LENGTH: str(len(payload))}
            if first.page is not None:
                fields[REFERS_TO_PAGE] = first.page
            block = head
        fields |= {"WARC-Payload-Digest": f"sha1:{sha1_base32(payload)}", "WARC-Block-Digest": f"sha1:{sha1_base32(block)}", "Content-Type": "application/http; msgtype=response" if head else e.kind}
        out.append(_member(warc_record(fields, block)))
    _put(target, b"".join(out))
    return len(out) - 1


def convert(records: DataFrame, path: str, n_files: int) -> DataFrame:
    """Write a WARC file for each of the ``n_files`` ARC files of ``records`` (a ``scan_arc`` with ``first``); one row per file.

    Rows are dealt by file, to as many tasks as there are files, as the work is the files' and not the rows'.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        source = rows["file"].iloc[0]
        target = target_of(source, path)
        firsts = {int(k): First(f, int(n), p, d, u) for k, f, n, p, d, u, again in zip(*(rows[c] for c in ("number", "first_file", "first_number", "first_page", "first_date", "first_url", "again")), strict=True) if again}
        return pd.DataFrame({"file": [target], "records": [convert_file(source, target, firsts)]})

    again = F.col("first").isNotNull() & ~((F.col("file") == F.col("first.file")) & (F.col("number") == F.col("first.number")))
    rows = records.select("file", "number", F.col("first.file").alias("first_file"), F.col("first.number").alias("first_number"), F.col("first.page_id").cast("string").alias("first_page"), F.col("first.date").alias("first_date"), F.col("first.url").alias("first_url"), F.coalesce(again, F.lit(False)).alias("again"))
    return materialise(rows.repartition(max(1, n_files), "file").groupBy("file").applyInPandas(run, "file string, records long"), "warc-files")


def read_warc(files: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, target_uri) of every content record."""
    out = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("target_uri", pa.string())])

    def run(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows = []
                for fields, block in warc_records(_get(file), file):
                    kind = fields["warc-type"]
                    if kind == "warcinfo":
                        continue
                    head, payload = http_parts(block)
                    i, length, refers = http_field(head, "X-Page-Id"), fields.get(PAYLOAD_LENGTH.lower()) or http_field(head, "Content-Length"), fields.get(REFERS_TO_PAGE.lower())
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if kind != "revisit" and digest != sha1_base32(payload):
                        raise ValueError(f"{file}: {fields['warc-record-id']} does not have its digest")
                    rows.append((int(i) if i else None, int(length or 0) if kind == "revisit" else len(payload), digest, kind, int(refers) if refers else None, fields["warc-record-id"], fields["warc-target-uri"]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return _each(files).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string")


def convert_archives(arc_files: DataFrame, path: str) -> DataFrame:
    """ARC files (column ``file``) to WARC files under ``path``; one row per file written."""
    records = materialise(scan_arc(arc_files), "arc-records")
    return convert(same_payload(records), path, arc_files.count())


def op3_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    arcs = write_arc(pages, scratch_path(spark, "arc"))
    return read_warc(convert_archives(arcs, scratch_path(spark, "warc")))


#: SQL has no base32: twenty bytes are four groups of five, each eight digits of five bits.
_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> {s}) & 31 AS INTEGER) + 1, 1)"
ORACLE = {
    "op3_arc_to_warc": f"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, url, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT r, page_id, url, octet_length(body) AS payload_bytes, sha1(body) AS hex FROM p),
g AS (SELECT r, k, CAST('0x' || substr(hex, 10 * k + 1, 10) AS BIGINT) AS v FROM d, range(4) AS t(k)),
b AS (SELECT r, string_agg({" || ".join(_DIGIT.format(s=s) for s in range(35, -1, -5))}, '' ORDER BY k) AS payload_digest FROM g GROUP BY r),
n AS (SELECT d.*, payload_digest, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, d.r) AS n, first_value(page_id) OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, d.r) AS first FROM d JOIN b USING (r))
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n > 1 THEN first END AS refers_to FROM n"""
}


def op3_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, without the record ids, which name a run's own files."""
    return op3_arc_to_warc(spark, sf_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op3_arc_to_warc": op3_digest}
