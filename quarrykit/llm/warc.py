"""Legacy web archives (ARC, versions 1 and 2) converted to WARC, and WARC written and read by Spark.

The converter reads the version block of an ARC file, takes the names of the header fields from it, then reads each record by its
declared length and makes the WARC record that stands for it: identifier, timestamp, type and digests. Archives are text files of Spark's
own writer whose line separator is the end of a WARC record, so a lost task is simply written again. A file holds some 32 MB of pages at most (or one
larger page), so it is read whole by one task; each file is one gzip member, as Spark's writer makes no others.

Cases: a null url is written as ``about:blank``; a null html is an empty payload; a null page_id has no identifier of its own, is always a
response and nothing refers to it; rows that repeat a page_id with an equal payload share one verdict; an empty table gives empty archives
and no rows; columns beyond page_id, url and html are ignored.
"""

import base64
import gzip
import hashlib
import io
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, materialize, shared_dir, table

CRLF = b"\r\n"
END = "\r\n\r\n"
#: Header fields of the two ARC versions, as the format description gives them (fixed values).
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT_BYTES = 1000
#: Bytes of pages gathered into one ARC, which gives one row of the writer, at most, but for the page that passes it; and ARCs in a WARC file at most.
ARC_BYTES, ARCS_PER_FILE = 4 << 20, 8


def write_arc(name: str, version: int, date: str, documents) -> bytes:
    """An uncompressed ARC file of (url, ip, content type, body) documents; body is the whole network response."""
    out = io.BytesIO()

    def line(url: str, ip: str, kind: str, size: int) -> None:
        clean = [re.sub(r"\s", lambda m: "%%%02X" % ord(m[0][0]), x) or "-" for x in (url, ip, kind.split(";")[0])]
        middle = [] if version == 1 else ["200", "-", "-", str(out.tell()), name]
        out.write(" ".join([clean[0], clean[1], date, clean[2], *middle, str(size)]).encode() + b"\n")

    about = f"{version} 0 quarrykit\n{' '.join(ARC_FIELDS[version])}\n".encode()
    line(f"filedesc://{name}", "0.0.0.0", "text/plain", len(about))
    out.write(about)
    for url, ip, kind, body in documents:
        out.write(b"\n")
        line(url, ip, kind, len(body))
        out.write(body)
    return out.getvalue()


def read_arc(data: bytes):
    """The records of an ARC file as (fields by name, body), the version block first. Raises ValueError where a declared length runs past the end."""
    at, names = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        stop = data.index(b"\n", at)
        head = data[at:stop].decode("utf-8", "replace").rstrip("\r")
        length = int(head.rpartition(" ")[2])
        body = data[stop + 1 : stop + 1 + length]
        if len(body) < length:
            raise ValueError(f"the record at {at} declares {length} bytes; {len(body)} are left")
        if names is None:
            about = body.decode("utf-8", "replace").split("\n")
            names = ARC_FIELDS[int(about[0].split(" ")[0])]
        yield dict(zip(names, head.rsplit(" ", len(names) - 1), strict=True)), body
        at = stop + 1 + length


def record_id(page_id: int) -> str:
    """The identifier of a page's record: a version 8 UUID that holds the 64-bit page_id."""
    n = page_id & (1 << 64) - 1
    return f"<urn:uuid:{n >> 32:08x}-{n >> 16 & 0xFFFF:04x}-8{n >> 4 & 0xFFF:03x}-8000-{n & 0xF:012x}>"


def page_of(identifier: str) -> int | None:
    """The page_id that an identifier of record_id() holds; None for any other."""
    if not (m := re.fullmatch(r"<urn:uuid:([0-9a-f]{8})-([0-9a-f]{4})-8([0-9a-f]{3})-8000-0{11}([0-9a-f])>", identifier)):
        return None
    n = int("".join(m.groups()), 16)
    return n - (1 << 64) if n >> 63 else n


def other_id(*parts: bytes) -> str:
    x = hashlib.sha256(b"\0".join(parts)).hexdigest()
    return f"<urn:uuid:{x[:8]}-{x[8:12]}-5{x[13:16]}-9{x[17:20]}-{x[20:32]}>"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _warc(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + CRLF + CRLF + block


def convert_arc(data: bytes, refers: dict[int, int] | None = None):
    """The WARC records, without the two line ends that close each, that stand for the records of an ARC file.

    refers maps page_ids to that of the response that they revisit.
    """
    for fields, body in read_arc(data):
        date = fields["Archive-date"]
        when = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
        if fields["URL"].startswith("filedesc://"):
            about = f"software: quarrykit\r\nformat: WARC File Format 1.1\r\ndescription: converted from {fields['URL'][11:]}\r\n".encode()
            yield _warc([("WARC-Type", "warcinfo"), ("WARC-Record-ID", other_id(b"info", data[:200], str(len(data)).encode())), ("WARC-Date", when), ("Content-Type", "application/warc-fields")], about)
            continue
        head, _, payload = body.partition(CRLF + CRLF)
        m = re.search(rb"\r\nX-Page-Id: (-?\d+)", head)
        page = int(m[1]) if m else None
        own = other_id(fields["URL"].encode(), date.encode(), body) if page is None else record_id(page)
        to = (refers or {}).get(page)
        block = head + CRLF + CRLF if to is not None else body
        headers = [("WARC-Type", "response" if to is None else "revisit"), ("WARC-Record-ID", own), ("WARC-Date", when), ("WARC-Target-URI", fields["URL"]), ("WARC-IP-Address", fields["IP-address"])]
        headers += [("WARC-Payload-Digest", _digest(payload)), ("WARC-Block-Digest", _digest(block)), ("X-Payload-Length", str(len(payload)))]
        if to is not None:
            headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(to))]
        yield _warc([*headers, ("Content-Type", "application/http;msgtype=response")], block)


def read_warc(stream):
    """The records of a stream of WARC as (headers with lower-case names, block)."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(CRLF)) != b"":
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("a record ends early")
        yield headers, block


def _archive(version: int, date: str):
    def run(batches):
        rows, held, part = [], 0, 0
        for batch in batches:
            for page, url, html, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append((page, url, html or b"", to))
                held += len(rows[-1][2])
                if held >= ARC_BYTES:
                    yield _converted(rows, version, date, part)
                    rows, held, part = [], 0, part + 1
        if rows:
            yield _converted(rows, version, date, part)

    return run


def _converted(rows: list, version: int, date: str, part: int) -> pa.RecordBatch:
    def response(page: int | None, html: bytes) -> bytes:
        own = b"" if page is None else b"X-Page-Id: %d\r\n" % page
        return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + own + b"Content-Length: %d\r\n\r\n" % len(html) + html

    arc = write_arc(f"pages-{part:05d}.arc", version, date, ((url or "about:blank", "0.0.0.0", "text/html", response(page, html)) for page, url, html, _ in rows))
    return pa.RecordBatch.from_pydict({"value": [END.encode().join(convert_arc(arc, {page: to for page, _, _, to in rows if page is not None and to is not None}))]}, pa.schema([("value", pa.binary())]))


def refers_to(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload a page of larger page_id has too. Works on digests alone; counts are summed before the shuffle."""
    light = pages.select("page_id", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("bytes"))
    light = light.filter((F.col("bytes") >= min_bytes) & F.col("page_id").isNotNull())
    light = materialize(light)
    groups = light.groupBy("digest", "bytes").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least"), F.count("*").alias("times")).filter("least < refers_to").drop("least")
    return joined(light, groups, ["digest", "bytes"], light.count(), "inner").filter("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, path: str, version: int = 2, date: str = "20240101000000", min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write each row of pages(page_id, url, html) as an ARC record, convert it, and write gzipped WARC files to path."""
    own = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"))
    joined = own.join(refers_to(pages, min_bytes), ["page_id", "digest"], "left").select("page_id", "url", F.col("html").cast("binary").alias("html"), "refers_to")
    records = joined.mapInArrow(_archive(version, date), "value binary").select(F.col("value").cast("string").alias("value"))
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", ARCS_PER_FILE).text(path)


def _parse(batches):
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("target_uri", pa.string())])
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for head, block in read_warc(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())))):
                if head["warc-type"] not in ("response", "revisit"):
                    continue
                http, _, payload = block.partition(CRLF + CRLF)
                if head["warc-type"] == "response" and _digest(payload) != head["warc-payload-digest"]:
                    raise ValueError(f"{head['warc-record-id']}: its payload has another digest")
                rows.append((page_of(head["warc-record-id"]), int(head["x-payload-length"]), base64.b32decode(head["warc-payload-digest"][5:]).hex(), head["warc-type"], page_of(head.get("warc-refers-to", "")), head["warc-record-id"], head["warc-target-uri"]))
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_archives(spark, path: str) -> DataFrame:
    """One row per response or revisit record of the WARC files at path; payload digests of responses are verified."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_parse, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string")


def op10_warc(spark, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).drop("record_id", "target_uri")
