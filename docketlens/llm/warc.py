"""Legacy archives (ARC, versions 1 and 2) and their conversion to WARC 1.1.

``arc_image`` writes an archive, ``parse_arc`` reads one by its version block:
the version says which fields a record's header line has, and the line's last
field is the declared length of what follows.  ``to_warc_fields`` synthesises
what WARC adds: record identifier, ISO time, record type, payload digest.

Archives are written by Spark's own text writer, one WARC file per task and
``RECORDS_A_FILE`` records, so they are committed or absent, wherever the
shared folder lies; every record ends in a newline, which is the writer's.

Payloads that are equal and at least ``REVISIT_BYTES`` long: the smallest
``page_id`` holds the payload (``response``), the others refer to it
(``revisit``).

Defined results: null html is an empty payload; null or unprintable parts of a
URL are escaped; rows that repeat a ``page_id`` with an equal payload are all
responses if that id is the smallest; a null ``page_id`` never is; an empty
table gives no archive records; a very long page is one record, and its archive
as much longer; of equal payloads the smallest ``page_id`` alone decides, so
there are no ties; further columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, scratch

REVISIT_BYTES, RECORDS_A_FILE, ARC_BYTES = 100, 1000, 4 << 20
#: Fixed values of the two formats: a record's header line, by version.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
ARCHIVED, ADDRESS = "20200101000000", "0.0.0.0"


def _line(version: int, url: str, mime: str, code: str, n: int, offset: int, name: str, date: str = ARCHIVED) -> bytes:
    fields = {"URL": url, "IP-address": ADDRESS, "Archive-date": date, "Content-type": mime, "Result-code": code, "Checksum": "-", "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(n)}
    return " ".join(fields[f] for f in ARC_FIELDS[version].split()).encode() + b"\n"


def arc_image(records: list[tuple[str, bytes]], version: int, name: str = "legacy.arc") -> bytes:
    """``(url, network document)`` records as one ARC file."""
    body = f"{version} 0 docketlens\n{ARC_FIELDS[version]}\n".encode()
    out = [_line(version, f"filedesc://{name}", "text/plain", "200", len(body), 0, name), body, b"\n"]
    at = sum(map(len, out))
    for url, document in records:
        head = _line(version, _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url), "text/html", "200", len(document), at, name)
        out += (head, document, b"\n")
        at += len(head) + len(document) + 1
    return b"".join(out)


def parse_arc(image: bytes):
    """Yield ``(fields, document)`` of each record after the version block."""
    end = image.index(b"\n")
    first = image[:end].decode().split(" ")
    if not first[0].startswith("filedesc://"):
        raise ValueError("no version block")
    n = int(first[-1])
    block = image[end + 1 : end + 1 + n].decode()
    version = int(block.split(" ", 1)[0])
    names = ARC_FIELDS[version].split()
    if block.split("\n")[1].split() != names:
        raise ValueError(f"unexpected header fields for version {version}")
    at = end + 1 + n + 1
    while at < len(image):
        end = image.index(b"\n", at)
        values = image[at:end].decode().split(" ")
        if len(values) != len(names):
            raise ValueError(f"a header line of {len(values)} fields at {at}")
        fields = dict(zip(names, values, strict=True))
        n = int(fields["Archive-length"])
        document = image[end + 1 : end + 1 + n]
        if len(document) != n or image[end + 1 + n : end + 2 + n] != b"\n":
            raise ValueError(f"the declared length of the record at {at} is wrong")
        yield fields, document
        at = end + 2 + n


def split_http(document: bytes) -> tuple[bytes, bytes]:
    """Header block (with its blank line) and payload of an archived response."""
    at = document.index(b"\r\n\r\n") + 4
    return document[:at], document[at:]


def http_field(head: bytes, name: bytes) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name) + rb":[ ]*([^\r\n]*)", head)
    return m[1].decode() if m else None


def iso_time(date14: str) -> str:
    d = date14
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_uuid(key: str) -> str:
    """A name-based identifier: reruns and references agree on it."""
    h = hashlib.sha256(b"docketlens-record:" + key.encode()).hexdigest()
    return f"urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-8{h[17:20]}-{h[20:32]}"


def to_warc_fields(fields: dict[str, str], document: bytes) -> dict:
    """What a WARC record needs, from an ARC record."""
    head, payload = split_http(document)
    key = http_field(head, b"X-Row")
    return {
        "key": None if key in (None, "null") else int(key),
        "uri": fields["URL"],
        "ip": fields["IP-address"],
        "date": iso_time(fields["Archive-date"]),
        "http": head.decode(),
        "payload": payload.decode("utf-8", "surrogateescape"),
        "digest": hashlib.sha256(payload).hexdigest(),
        "n": len(payload),
    }


CONVERTED = "key long, uri string, ip string, date string, http string, payload string, digest string, n long"
_CONVERTED = pa.schema([("key", pa.int64()), ("uri", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("http", pa.string()), ("payload", pa.string()), ("digest", pa.string()), ("n", pa.int64())])


def legacy_images(pages: DataFrame) -> DataFrame:
    """``page_id, url, html`` -> ARC files of bounded size, alternately of version 1 and 2: ``image binary``."""

    def write(batches):
        held, n, version = [], 0, 1
        for batch in batches:
            for key, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (html or "").encode("utf-8", "surrogatepass")
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Row: {'null' if key is None else key}\r\n\r\n"
                held.append((url or "urn:none:", head.encode() + payload))
                n += len(payload)
                if n >= ARC_BYTES:
                    yield pa.RecordBatch.from_pydict({"image": [arc_image(held, version)]})
                    held, n, version = [], 0, 3 - version
        if held:
            yield pa.RecordBatch.from_pydict({"image": [arc_image(held, version)]})

    bound_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(write, "image binary")


def convert(images: DataFrame) -> DataFrame:
    """ARC files -> one row of WARC fields per archived record."""

    def read(batches):
        for batch in batches:
            for image in batch.column(0).to_pylist():
                rows = {k: [] for k in _CONVERTED.names}
                for fields, document in parse_arc(image):
                    for k, v in to_warc_fields(fields, document).items():
                        rows[k].append(v)
                yield pa.RecordBatch.from_pydict(rows, schema=_CONVERTED)

    return images.select("image").mapInArrow(read, CONVERTED)


def _uuid(key):
    h = F.sha2(F.concat(F.lit("docketlens-record:"), key.cast("string")), 256)
    part = lambda i, n: F.substring(h, i + 1, n)
    return F.concat(F.lit("urn:uuid:"), part(0, 8), F.lit("-"), part(8, 4), F.lit("-5"), part(13, 3), F.lit("-8"), part(17, 3), F.lit("-"), part(20, 12))


def write_warcs(pages: DataFrame, path: str) -> None:
    """Convert the pages' legacy archives and write WARC files below ``path``."""
    payload = F.coalesce("html", F.lit(""))
    shared = (
        pages.where(F.octet_length(payload) >= REVISIT_BYTES)
        .groupBy(F.sha2(payload, 256).alias("_digest"))
        .agg(F.min(F.col("page_id").cast("long")).alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1")
    )
    rows = convert(legacy_images(pages)).join(shared, F.col("digest") == F.col("_digest"), "left")
    revisit = F.col("_first").isNotNull() & ~F.col("key").eqNullSafe(F.col("_first"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    block = F.when(revisit, F.col("http")).otherwise(F.concat("http", "payload"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<"), _uuid(F.coalesce(F.col("key").cast("string"), F.lit("null"))), F.lit(">"))),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("uri")),
        line("WARC-IP-Address", F.col("ip")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(
            revisit,
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("WARC-Refers-To", F.concat(F.lit("<"), _uuid(F.col("_first")), F.lit(">"))),
                line("X-Refers-To-Row", F.col("_first").cast("string")),
            ),
        ).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
        F.lit("\r\n\r"),  # the writer's newline ends the record
    )
    rows.select(record.alias("value")).write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


def parse_warc(data: bytes):
    """Yield ``(headers, block)`` of each record of an uncompressed WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"no record at {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        n = int(headers["Content-Length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) != n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"the declared length of the record at {at} is wrong")
        yield headers, block
        at = end + 8 + n


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string"


def read_warcs(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``; responses are checked against their digest."""

    def read(batches):
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string())])
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = {k: [] for k in schema.names}
                for headers, block in parse_warc(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content):
                    http, payload = split_http(block)
                    digest, n = headers["WARC-Payload-Digest"].removeprefix("sha256:"), int(http_field(http, b"Content-Length"))
                    if headers["WARC-Type"] == "response":
                        n, digest_read = len(payload), hashlib.sha256(payload).hexdigest()
                        if digest_read != digest:
                            raise ValueError(f"payload and digest differ in {headers['WARC-Record-ID']}")
                    key, to = http_field(http, b"X-Row"), headers.get("X-Refers-To-Row")
                    for k, v in zip(schema.names, (None if key == "null" else int(key), n, digest, headers["WARC-Type"], None if to is None else int(to), headers["WARC-Record-ID"]), strict=True):
                        rows[k].append(v)
                yield pa.RecordBatch.from_pydict(rows, schema=schema)

    bound_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(read, READ)


def archived(pages: DataFrame) -> DataFrame:
    """Write the pages to WARC files in the shared folder and read them back."""
    path = scratch(pages.sparkSession, "warc")
    write_warcs(pages, path)
    return read_warcs(pages.sparkSession, path)
