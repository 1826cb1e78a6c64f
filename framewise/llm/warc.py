"""Web archives: a converter of legacy ARC archives to WARC, and writing and reading WARC archives.

ARC files begin with a version block that declares the fields of the header lines to come; version 1 lines hold
URL, IP address, date, content type and length, version 2 lines add result code, checksum, location, offset and
file name.  The length that a line declares is what delimits its body.  Each ARC record becomes a WARC record
with an identifier made of what it stands for (the same whenever it is converted), a WARC date, a type, and
digests of block and payload.

Archives are gzip files of one member per record, written by tasks to the shared folder under names of their own;
a task tells its archives only when they are complete, so a repeated task leaves files that nobody reads.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, stored

V1_FIELDS = ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"]
V2_FIELDS = ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"]
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122: names that are URLs
ARC_BYTES, WARC_BYTES, READ_BYTES = 4 << 20, 32 << 20, 1 << 16
ARCHIVE_DATE = "20240101000000"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- ARC


def arc_block(records: list[tuple[str, str, bytes]], name: str, version: int = 1) -> bytes:
    """An ARC file of (url, content type, body) records."""
    fields = V1_FIELDS if version == 1 else V2_FIELDS
    about = f"{version} 0 framewise\n{' '.join(fields)}\n".encode()
    out = [_arc_line(fields, f"filedesc://{name}", "text/plain", about), about, b"\n"]
    for url, kind, body in records:
        out += [_arc_line(fields, url, kind, body), body, b"\n"]
    return b"".join(out)


def _arc_line(fields: list[str], url: str, kind: str, body: bytes) -> bytes:
    known = {"URL": quote(url, safe="!#$%&'()*+,/:;=?@[]~") or "-", "IP-address": "0.0.0.0", "Archive-date": ARCHIVE_DATE, "Content-type": kind, "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": "-", "Archive-length": str(len(body))}
    return (" ".join(known[f] for f in fields) + "\n").encode()


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, body) of each record after the version block, whose last line declares the fields."""
    at, fields = 0, V1_FIELDS
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        if line[0].startswith("filedesc://"):
            length = int(line[-1])
            about = data[end + 1 : end + 1 + length].decode("utf-8", "replace").splitlines()
            fields = about[1].split(" ") if len(about) > 1 else V2_FIELDS if about and about[0].startswith("2") else V1_FIELDS
            at = end + 1 + length
            continue
        if len(line) > len(fields):  # older crawlers left spaces in URLs and types
            extra = len(line) - len(fields)
            line = ["%20".join(line[: extra + 1]), *line[extra + 1 :]]
        if len(line) < len(fields):
            raise ValueError(f"ARC header line at {at} has {len(line)} of {len(fields)} fields")
        head = dict(zip(fields, line, strict=True))
        length = int(head["Archive-length"])
        if end + 1 + length > len(data):
            raise ValueError(f"ARC record at {at} declares {length} bytes; {len(data) - end - 1} are left")
        yield head, data[end + 1 : end + 1 + length]
        at = end + 1 + length


def http_message(payload: bytes, extra: dict[str, str]) -> bytes:
    lines = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", *(f"{k}: {v}" for k, v in extra.items())]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload


def http_parts(body: bytes) -> tuple[bytes, bytes]:
    """(head with its blank line, payload)."""
    cut = body.find(b"\r\n\r\n")
    return (body[: cut + 4], body[cut + 4 :]) if cut >= 0 else (b"", body)


def record_id(url: str, date: str, payload_digest: str, page: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{url} {date} {payload_digest} {page}')}>"


def warc_date(arc_date: str) -> str:
    """ARC's 14 digits (missing ones count as the earliest) as a WARC date."""
    full = (arc_date + "00000101000000"[len(arc_date) :])[:14]
    return datetime.strptime(full, "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def converted(head: dict[str, str], body: bytes) -> tuple[dict[str, str], bytes]:
    """The WARC header fields and block that say what an ARC record says."""
    date = warc_date(head["Archive-date"])
    if body.startswith(b"HTTP/"):
        top, payload = http_parts(body)
        page = next((x.split(b":", 1)[1].strip().decode() for x in top.split(b"\r\n") if x.lower().startswith(b"x-page-id:")), "")
        kind, content = "response", "application/http; msgtype=response"
    else:
        payload, page, kind, content = body, "", "resource", head["Content-type"]
    own = digest(payload)
    fields = {"WARC-Type": kind, "WARC-Record-ID": record_id(head["URL"], date, own, page), "WARC-Date": date, "WARC-Target-URI": head["URL"], "WARC-IP-Address": head["IP-address"]}
    fields |= {"WARC-Payload-Digest": f"sha1:{own}", "WARC-Block-Digest": f"sha1:{digest(body)}", "Content-Type": content, "Content-Length": str(len(body))}
    return fields, body


def as_revisit(fields: dict[str, str], block: bytes, refers_to: str) -> tuple[dict[str, str], bytes]:
    """The record without its payload, which the record ``refers_to`` holds."""
    head, _ = http_parts(block)
    fields = fields | {"WARC-Type": "revisit", "WARC-Refers-To": refers_to, "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    return fields | {"WARC-Block-Digest": f"sha1:{digest(head)}", "Content-Length": str(len(head))}, head


# --- WARC


def warc_member(fields: dict[str, str], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(head.encode()) + squeeze.compress(block) + squeeze.compress(b"\r\n\r\n") + squeeze.flush()


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of a gzip archive of one member per record, each byte unpacked once."""
    at, view = 0, memoryview(data)
    while at < len(view):
        member, out = zlib.decompressobj(31), []
        while not member.eof:
            if at >= len(view):
                raise ValueError("the archive ends inside a record")
            out.append(member.decompress(view[at : at + READ_BYTES]))
            at = min(at + READ_BYTES, len(view))
        at -= len(member.unused_data)
        raw = b"".join(out)
        cut = raw.index(b"\r\n\r\n")
        version, *lines = raw[:cut].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:20]!r}")
        fields = dict(x.split(": ", 1) for x in lines)
        yield fields, raw[cut + 4 : cut + 4 + int(fields["Content-Length"])]


def _arc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, list[str | None]]]:
    """ARC files of about ARC_BYTES and, for each record, the page that its payload is to be found with (or None)."""
    records, refers, size, n = [], [], 0, 0
    for b in batches:
        cols = [b.column(i) for i in range(4)]
        for i in range(b.num_rows):
            page, url, html, refer = (c[i] for c in cols)
            page, refer = page.as_py(), refer.as_py()
            payload = html.as_buffer().to_pybytes() if html.is_valid else b""
            body = http_message(payload, {} if page is None else {"X-Page-Id": str(page)})
            records.append((url.as_py() or "", "text/html", body))
            refers.append(refer)
            size += len(body)
            if size >= ARC_BYTES:
                yield arc_block(records, f"{n}.arc", 1 + n % 2), refers
                records, refers, size, n = [], [], 0, n + 1
    if records:
        yield arc_block(records, f"{n}.arc", 1 + n % 2), refers


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    attempt, buffer, n, done = uuid.uuid4().hex, io.BytesIO(), 0, []

    def close() -> None:
        nonlocal buffer, n
        if buffer.tell():
            path = f"{root}/{attempt}-{n:05d}.warc.gz"
            with store.open_output_stream(path, compression=None) as out:
                out.write(buffer.getbuffer())
            done.append(path)
            buffer, n = io.BytesIO(), n + 1

    for arc, refers in _arc_rows(batches):
        for (head, body), refer in zip(parse_arc(arc), refers, strict=True):
            fields, block = converted(head, body)
            if refer is not None:
                url, page = refer.split(" ", 1)
                own = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                fields, block = as_revisit(fields, block, record_id(url, fields["WARC-Date"], own, page))
            buffer.write(warc_member(fields, block))
            if buffer.tell() >= WARC_BYTES:
                close()
    close()
    yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["path"])


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, _ = fs.FileSystem.from_uri(folder)
    names = ["page_id", "record_id", "record_type", "refers", "payload_bytes", "payload_digest", "block_digest_holds", "url", "warc_date"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string()]
    for b in batches:
        for path in b.column(0).to_pylist():
            rows = []
            with store.open_input_stream(path, compression=None) as f:
                data = f.read()
            for fields, block in read_warc(data):
                head, payload = http_parts(block)
                page = next((int(x.split(b":", 1)[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"x-page-id:")), None)
                revisit = fields["WARC-Type"] == "revisit"
                own = fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else digest(payload)
                rows.append((page, fields["WARC-Record-ID"], fields["WARC-Type"], fields.get("WARC-Refers-To"), None if revisit else len(payload), own, fields["WARC-Block-Digest"] == f"sha1:{digest(block)}", fields["WARC-Target-URI"], fields["WARC-Date"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


READ = "page_id long, record_id string, record_type string, refers string, payload_bytes long, payload_digest string, block_digest_holds boolean, url string, warc_date string"


def written_archives(pages: DataFrame, revisit_min_bytes: int = 0) -> tuple[DataFrame, str]:
    """(paths of the archives as a table, their folder): every row of ``pages`` (page_id, url, html) as a WARC record.

    Of records with one payload of at least ``revisit_min_bytes`` bytes the one of the largest page_id holds it and the others
    refer to that; rows of null page_id hold their own.  A null html is an empty payload, a null url an empty address.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.when(F.col("page_id").isNotNull() & (F.octet_length("html") >= revisit_min_bytes), F.sha1(F.col("html").cast("binary"))))
    #: The record that holds a payload is named by its url, date, digest and page, so its url goes along.
    holders = rows.select("page_id", "url", "key").where("key is not null").groupBy("key").agg(F.max(F.struct("page_id", "url")).alias("h"), F.count(F.lit(1)).alias("n")).where("n > 1")
    holders = stored(holders.select(F.col("key").alias("k"), "h.page_id", "h.url").toDF("k", "holder", "holder_url"), "holders")
    refer = F.when(F.col("holder") != F.col("page_id"), F.concat_ws(" ", F.col("address"), F.col("holder").cast("string")))
    out = rows.join(holders.withColumn("address", _as_in_arc(F.col("holder_url"))), F.col("key") == F.col("k"), "left")
    folder = fresh_path(spark, "warc")
    paths = out.select("page_id", "url", "html", refer.alias("refer")).mapInArrow(lambda it: _write(it, folder), "path string")
    return stored(paths, "warc-paths"), folder


def _as_in_arc(url):
    """How a url stands in an ARC header line, where the record's own url is read from."""

    @F.pandas_udf("string")
    def safe(urls):
        return urls.map(lambda u: quote(u, safe="!#$%&'()*+,/:;=?@[]~") or "-")

    return safe(url)


def archived_pages(pages: DataFrame, revisit_min_bytes: int = 0) -> DataFrame:
    """Per row of ``pages``, written to archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to, url, warc_date.

    Of a revisit, length and digest are those of the payload that it refers to.  Repeated rows are as many records;
    those of the largest page_id are all responses.  An empty table gives an empty one.
    """
    paths, folder = written_archives(pages, revisit_min_bytes)
    got = stored(paths.repartition(max(1, min(paths.count(), 4096))).mapInArrow(lambda it: _read(it, folder), READ), "warc-records")
    kept = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "warc_date"]
    holds = got.where("record_type = 'response' and page_id is not null").select("record_id", "page_id", "payload_bytes")
    holds = holds.groupBy(F.col("record_id").alias("refers")).agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("held_bytes"))
    #: Only revisits look for what they refer to; stored, so that Spark splits the revisits of a common payload among tasks.
    revisits = got.where("record_type = 'revisit'")
    holds = stored(holds.join(revisits.select("refers").distinct(), "refers", "left_semi"), "held-payloads")
    revisits = revisits.join(holds, "refers", "left").withColumn("payload_bytes", F.col("held_bytes")).select(kept)
    return got.where("record_type != 'revisit'").withColumn("refers_to", F.lit(None).cast("long")).select(kept).unionAll(revisits)


SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT *, array_to_string(list_transform(range(32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(('0b' || substr(bits, CAST(i * 5 + 1 AS INTEGER), 5)) AS INTEGER) + 1, 1)), '') AS payload_digest
      FROM (SELECT *, array_to_string(list_transform(range(40), lambda i:
              CASE substr(hex, CAST(i + 1 AS INTEGER), 1) WHEN '0' THEN '0000' WHEN '1' THEN '0001' WHEN '2' THEN '0010' WHEN '3' THEN '0011'
              WHEN '4' THEN '0100' WHEN '5' THEN '0101' WHEN '6' THEN '0110' WHEN '7' THEN '0111' WHEN '8' THEN '1000' WHEN '9' THEN '1001'
              WHEN 'a' THEN '1010' WHEN 'b' THEN '1011' WHEN 'c' THEN '1100' WHEN 'd' THEN '1101' WHEN 'e' THEN '1110' ELSE '1111' END), '') AS bits FROM p)),
m AS (SELECT hex, max(page_id) AS holder FROM p GROUP BY hex)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> holder THEN holder END AS refers_to
FROM b JOIN m USING (hex)
"""
