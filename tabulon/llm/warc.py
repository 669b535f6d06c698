"""Legacy archives to WARC: ARC 1 and 2 files are parsed by their header lines and declared lengths, and equivalent WARC
records made of them, with identifiers, timestamps, types and digests; archives are written and read back through Spark.

Pages pass through files three times: ``write_legacy`` stores them as a legacy crawler did, ``convert`` reads such files and
writes WARC files, ``read_archives`` reads these. A file holds about ARCHIVE_BYTES of payload and is the work of one task.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import load, lookup, shared_dir, stored

#: Payloads of at least so many bytes become revisits when met again.
REVISIT_BYTES = 1000
#: Bytes of an archive file, about: one file is read by one task; a longer record has a file of its own.
ARCHIVE_BYTES = 8_000_000
#: Header fields of an archived page's HTTP message and of its WARC record that carry the page's key.
PAGE_KEY, RECORD_KEY, REFERS_KEY = "X-Page-Key", "X-Record-Key", "X-Refers-To-Key"
#: The fields of an ARC header line by version, and WARC's names.
ARC_FIELDS = {1: ("url", "ip", "date", "type", "length"), 2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length")}
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class DamagedArchive(ValueError):
    """A header line or a declared length that doesn't fit the bytes."""


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    type: str
    body: bytes
    status: str = "-"
    checksum: str = "-"
    version: int = 1


@dataclass
class WarcRecord:
    headers: dict[str, str]
    block: bytes = b""
    extra: dict[str, str] = field(default_factory=dict)

    @property
    def payload(self) -> bytes:
        """The block without its HTTP header, if it has one."""
        if "msgtype=response" in self.headers.get("Content-Type", ""):
            head, gap, body = self.block.partition(b"\r\n\r\n")
            return body if gap else b""
        return self.block

    def to_bytes(self) -> bytes:
        lines = [WARC_VERSION, *(f"{k}: {v}" for k, v in self.headers.items()), f"Content-Length: {len(self.block)}"]
        return "\r\n".join(lines).encode() + b"\r\n\r\n" + self.block + b"\r\n\r\n"


def arc_header(version: int = 1, name: str = "archive.arc", date: str = "19960101000000") -> bytes:
    """The version block that an ARC file begins with."""
    block = f"{version} 0 tabulon\n{' '.join({'url': 'URL', 'ip': 'IP-address', 'date': 'Archive-date', 'type': 'Content-type', 'status': 'Result-code', 'checksum': 'Checksum', 'location': 'Location', 'offset': 'Offset', 'filename': 'Filename', 'length': 'Archive-length'}[f] for f in ARC_FIELDS[version])}\n\n".encode()
    middle = "" if version == 1 else " 200 - - 0 " + name
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{middle} {len(block)}\n".encode() + block + b"\n"


def arc_bytes(record: ArcRecord) -> bytes:
    """A record as an ARC file has it; what would break the header line is escaped."""
    safe = lambda s: re.sub(r"[\s\x00-\x1f]", lambda m: "%" + m[0].encode().hex().upper(), s) or "-"
    values = {"url": safe(record.url), "ip": record.ip, "date": record.date, "type": safe(record.type), "status": record.status, "checksum": record.checksum, "location": "-", "offset": "0", "filename": "-", "length": str(len(record.body))}
    return " ".join(values[f] for f in ARC_FIELDS[record.version]).encode() + b"\n" + record.body + b"\n"


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, its version block first (a url of scheme filedesc); DamagedArchive where it is cut or lies."""
    at, version = 0, 1
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        parts = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ") if end >= 0 else []
        if parts and parts[0].startswith("filedesc:"):
            first = data[end + 1 : data.find(b"\n", end + 1)].split(b" ")[0]
            version = 2 if first == b"2" else 1
        if len(parts) < len(ARC_FIELDS[version]) or not parts[-1].isdigit():
            raise DamagedArchive(f"no header line at {at}")
        n = len(ARC_FIELDS[version])
        got = dict(zip(ARC_FIELDS[version][1:], parts[-n + 1 :], strict=True)) | {"url": " ".join(parts[: len(parts) - n + 1])}
        body = data[end + 1 : end + 1 + int(got["length"])]
        if len(body) != int(got["length"]):
            raise DamagedArchive(f"{got['length']} bytes declared at {at}, {len(body)} there")
        yield ArcRecord(got["url"], got["ip"], got["date"], got["type"], body, got.get("status", "-"), got.get("checksum", "-"), version)
        at = end + 1 + len(body)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    """The same identifier for the same record, whenever it is converted."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join(map(str, parts)))}>"


def timestamp(arc_date: str) -> str:
    """ARC's 14 digits (or their beginning) as WARC-Date; what isn't a date is the epoch."""
    d = re.fullmatch(r"(\d{4})(\d\d)?(\d\d)?(\d\d)?(\d\d)?(\d\d)?", arc_date)
    y, *rest = d.groups() if d else ("1970",)
    mo, day, h, mi, s = [*(r or o for r, o in zip(rest, ("01", "01", "00", "00", "00"), strict=False))] or ["01", "01", "00", "00", "00"]
    return f"{y}-{mo}-{day}T{h}:{mi}:{s}Z"


def to_warc(arc: ArcRecord) -> WarcRecord:
    """warcinfo for a version block, response for an HTTP message, resource for anything else."""
    http = arc.body.startswith(b"HTTP/")
    kind = "warcinfo" if arc.url.startswith("filedesc:") else "response" if http else "resource"
    out = WarcRecord({"WARC-Type": kind, "WARC-Record-ID": record_id(arc.url, arc.date, hashlib.sha1(arc.body).hexdigest()), "WARC-Date": timestamp(arc.date)})
    out.block = arc.body
    if kind == "warcinfo":
        out.headers |= {"WARC-Filename": arc.url.removeprefix("filedesc://"), "Content-Type": "text/plain"}
        return out
    out.headers |= {"WARC-Target-URI": arc.url, "WARC-IP-Address": arc.ip, "Content-Type": "application/http; msgtype=response" if http else arc.type}
    out.headers |= {"WARC-Block-Digest": digest(arc.body), "WARC-Payload-Digest": digest(out.payload)}
    return out


def as_revisit(record: WarcRecord, refers_to: str) -> WarcRecord:
    """The same capture without its payload, which the record ``refers_to`` has."""
    head = record.block.partition(b"\r\n\r\n")[0] + b"\r\n\r\n" if record.headers["WARC-Type"] == "response" else b""
    headers = record.headers | {"WARC-Type": "revisit", "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": refers_to, "WARC-Block-Digest": digest(head)}
    return WarcRecord(headers, head)


def parse_warc(data: bytes) -> Iterator[WarcRecord]:
    """The records of a WARC file, by declared lengths; a payload may hold anything, record separators included."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise DamagedArchive(f"no record at {at}")
        headers = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        n = int(headers.pop("Content-Length"))
        at = end + 4 + n
        if data[at : at + 4] != b"\r\n\r\n":
            raise DamagedArchive(f"{n} bytes declared at {end + 4} don't end a record")
        yield WarcRecord(headers, data[end + 4 : at])
        at += 4


def page_record_id(page_id: object, sha1: str) -> str:
    return record_id("page", page_id, sha1)


def legacy_page(url: str | None, html: bytes, version: int, key: object = None) -> ArcRecord:
    """A page as a legacy crawler stored it: an HTTP message under its address, here with the page's key among its headers.

    Pages tell neither when nor where they were fetched: both are made from the address, alike on every run.
    """
    h = hashlib.md5((url or "").encode()).digest()
    date = f"{1996 + h[0] % 10}{1 + h[1] % 12:02}{1 + h[2] % 28:02}{h[3] % 24:02}{h[4] % 60:02}{h[5] % 60:02}"
    mine = f"{PAGE_KEY}: {key}\r\n" if key is not None else ""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mine}Content-Length: {len(html)}\r\n\r\n".encode()
    return ArcRecord(url or "unknown:", f"192.0.2.{h[6]}", date, "text/html", head + html, "200" if version == 2 else "-", "-", version)


def _keyed(block: bytes) -> tuple[str | None, bytes]:
    """The page's key in an HTTP message, and the message's payload."""
    head, _, payload = block.partition(b"\r\n\r\n")
    key = re.search(rb"\r\n" + PAGE_KEY.encode() + rb": ([^\r]*)", head)
    return key and key[1].decode(), payload


_FILES = {"compression": "gzip", "lineSep": "\n", "maxRecordsPerFile": 1}


def _in_files(parts: Iterator[bytes], before: bytes = b"") -> Iterator[pa.RecordBatch]:
    """Records joined to the contents of files, a row each, less the line feed that Spark's text writer adds."""
    held, size = [before], 0
    for p in chain(parts, [None]):
        if size and (p is None or size + len(p) > ARCHIVE_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1].decode()], pa.string())], names=["value"])
            held, size = [before], 0
        if p is not None:
            held.append(p)
            size += len(p)


def _contents(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the gzipped files in a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")


def write_legacy(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", versions: tuple[int, ...] = (1, 2)) -> None:
    """Pages as gzipped ARC files in ``path``, the files of one task in one of ``versions``.

    A null payload is empty, a null address ``unknown:``, a page of null id has no key; every row is a record.
    """
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))

    def legacy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        version = versions[TaskContext.get().partitionId() % len(versions)]

        def records() -> Iterator[bytes]:
            for b in batches:
                for key, url, html in zip(*b.columns, strict=True):
                    yield arc_bytes(legacy_page(url.as_py(), html.as_py().encode(), version, key.as_py()))

        yield from _in_files(records(), arc_header(version))

    rows.mapInArrow(legacy, "value string").write.options(**_FILES).text(path)


def legacy_index(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, sha1, n) of each page in the ARC files of ``path``: where it is, its payload's digest and bytes."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for b in batches:
            for at, content in zip(*b.columns, strict=True):
                rows = [_keyed(r.body) for r in parse_arc(gzip.decompress(content.as_py())) if not r.url.startswith("filedesc:")]
                names = ["path", "key", "sha1", "n"]
                yield pa.RecordBatch.from_arrays([pa.array([at.as_py()] * len(rows), pa.string()), pa.array([k for k, _ in rows], pa.string()), pa.array([hashlib.sha1(p).hexdigest() for _, p in rows], pa.string()), pa.array([len(p) for _, p in rows], pa.int64())], names=names)

    return _contents(spark, path).mapInArrow(parse, "path string, key string, sha1 string, n long")


def convert(spark: SparkSession, legacy: str, path: str, id_type: str = "long", revisit_bytes: int = REVISIT_BYTES) -> None:
    """ARC files of pages as gzipped WARC files in ``path``.

    Of pages of equal payload of ``revisit_bytes`` or more, the greatest key is the response and the others revisit it (rows
    that repeat this key are responses; a page without key counts as lowest). Digests are compared without payloads, and what
    a file's pages revisit is joined to the file by its path.
    """
    index = stored(legacy_index(spark, legacy), "index")
    big = index.where(F.col("n") >= revisit_bytes)
    best = big.groupBy("sha1").agg(F.max(F.col("key").cast(id_type)).cast("string").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1 and first is not null")
    of = lookup(big, best, ["sha1"], index.count(), "times", F.concat_ws("|", "path", "key"))
    of = of.where(F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))).select("path", "sha1", "first").distinct()
    revisits = of.groupBy(F.col("path").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("sha1", "first"))).alias("first"))
    files = _contents(spark, legacy)
    files = files.join(stored(revisits, "revisits"), files["path"] == F.col("of"), "left").select("content", F.map_entries("first").alias("first"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        import gzip

        for b in batches:
            for content, revisits in zip(*b.columns, strict=True):
                first = {e["key"]: e["value"] for e in revisits.as_py() or []}
                for arc in parse_arc(gzip.decompress(content.as_py())):
                    warc = to_warc(arc)
                    if warc.headers["WARC-Type"] != "warcinfo":
                        key, payload = _keyed(arc.body)
                        sha1 = hashlib.sha1(payload).hexdigest()
                        warc.headers["WARC-Record-ID"] = page_record_id(key, sha1)
                        if key is not None:
                            warc.headers[RECORD_KEY] = key
                        if len(payload) >= revisit_bytes and first.get(sha1, key) != key:
                            warc = as_revisit(warc, page_record_id(first[sha1], sha1))
                            warc.headers[REFERS_KEY] = first[sha1]
                    yield warc.to_bytes()

    files.mapInArrow(lambda batches: _in_files(made(batches)), "value string").write.options(**_FILES).text(path)


def read_archives(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """(key, record_type, record_id, refers_to_id, refers_to, block_bytes, payload_bytes, payload_digest) of each page record of the archives in ``path``.

    Digests are checked against the payload that a record has; a revisit's size is that of the record it refers to.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for b in batches:
            for content in b.column(0):
                rows = []
                for r in parse_warc(gzip.decompress(content.as_py())):
                    h, payload = r.headers, r.payload
                    if h["WARC-Type"] == "warcinfo":
                        continue
                    own = h["WARC-Type"] != "revisit"
                    if own and digest(payload) != h["WARC-Payload-Digest"]:
                        raise DamagedArchive(f"{h['WARC-Record-ID']}: the payload's digest is another")
                    rows.append((h.get(RECORD_KEY), h["WARC-Type"], h["WARC-Record-ID"], h.get("WARC-Refers-To"), h.get(REFERS_KEY), len(r.block), len(payload) if own else None, base64.b32decode(h["WARC-Payload-Digest"][5:]).hex()))
                kinds = (*[pa.string()] * 5, pa.int64(), pa.int64(), pa.string())
                names = ["key", "record_type", "record_id", "refers_to_id", "refers_to", "block_bytes", "payload_bytes", "payload_digest"]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=names)

    files = _contents(spark, path).select("content")
    records = stored(files.mapInArrow(parse, "key string, record_type string, record_id string, refers_to_id string, refers_to string, block_bytes long, payload_bytes long, payload_digest string"), "records")
    referred = records.where("record_type = 'revisit'").groupBy("refers_to_id").agg(F.count(F.lit(1)).alias("times"))
    sizes = records.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.max("payload_bytes").alias("size")).join(referred, "refers_to_id")
    out = lookup(records, sizes, ["refers_to_id"], records.count(), "times", F.col("record_id"))
    return out.select(F.col("key").cast(id_type), "record_type", "record_id", "refers_to_id", F.col("refers_to").cast(id_type), "block_bytes", F.coalesce("payload_bytes", "size").alias("payload_bytes"), "payload_digest")


def archived(pages: DataFrame, path: str, id_col: str = "page_id", **columns: str) -> DataFrame:
    """Pages through legacy files in ``path``/arc to WARC files in ``path``/warc, and what ``read_archives`` finds there."""
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType.simpleString()
    write_legacy(pages, f"{path}/arc", id_col, **columns)
    convert(spark, f"{path}/arc", f"{path}/warc", kind)
    return read_archives(spark, f"{path}/warc", kind)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through legacy archives to WARC archives, and what these hold."""
    got = archived(load(spark, sf_dir, "pages"), f"{shared_dir(spark)}/tabulon-archives-{uuid.uuid4().hex}")
    return got.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> first THEN first END AS refers_to
FROM f
"""
