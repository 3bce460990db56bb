"""Legacy ARC archives and their conversion to WARC.

An ARC file starts with a version block whose second line names the version; its last line lists the header
fields. Version 1 records have five fields, version 2 records ten; the last field is the declared length
of the record, which alone decides where the record ends. The converter synthesises what ARC does
not have: record identifiers (derived from file name and offset, so a repeated task writes the same), ISO
timestamps, record types, block and payload digests, and revisit records for equal payloads.

Archives are assembled in tasks as rows of bounded size and written by Spark's text writer, one row per file,
so they go to any store that Spark can write and a lost task is simply repeated. Compression is by file
("none" gives files that any WARC tool can seek in). Archives are read as binary files and parsed record by
record. A revisit is decided by a join of digests; payloads themselves are never grouped.
"""

from __future__ import annotations

import base64
import datetime as dt
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.llm.common import staged
from noteloom.runtime import shared_dir

ARCHIVE_BYTES = 16 << 20  # archives are cut at the first record boundary after so many bytes
# Header lines of the two ARC versions and the profile of WARC revisits.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_EPOCH = dt.datetime(2001, 1, 1)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_version_block(name: str, version: int) -> bytes:
    fields = ARC_FIELDS[version]
    body = f"{version} 0 noteloom\n{fields}\n".encode()
    extra = "" if version == 1 else "200 - - 0 " + name + " "
    return f"filedesc://{name} 0.0.0.0 20010101000000 text/plain {extra}{len(body)}\n".encode() + body


def arc_record(version: int, name: str, offset: int, url: str, date: str, block: bytes) -> bytes:
    extra = "" if version == 1 else f"200 {hashlib.md5(block).hexdigest()} - {offset} {name} "
    return f"{url} 0.0.0.0 {date} text/html {extra}{len(block)}\n".encode() + block


def parse_arc(data: bytes) -> Iterator[tuple[str, int, dict[str, str], bytes]]:
    """(file name, offset, header fields, block) of every record after the version block.

    Empty lines between records are skipped. A header line with another number of fields than its version
    has, or a record that is shorter than its declared length, raises ValueError.
    """
    name, version, at = "", 0, 0
    while True:
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"{name}: no header line at {at}")
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        parts = line.split(" ")
        if not parts[-1].isdigit():
            raise ValueError(f"{name}: no length in header line at {at}")
        length = int(parts[-1])
        block = data[end + 1 : end + 1 + length]
        if len(block) < length:
            raise ValueError(f"{name}: record at {at} ends before its declared length")
        if line.startswith("filedesc://"):
            name, version = parts[0].removeprefix("filedesc://"), int(block.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"{name}: unknown ARC version {version}")
        else:
            fields = ARC_FIELDS.get(version, "").split(" ")
            # a content type may hold blanks itself: the fields before and after it are fixed in number
            tail = len(fields) - 4
            if len(parts) < len(fields):
                raise ValueError(f"{name}: {len(parts)} header fields at {at}")
            parts = parts[:3] + [" ".join(parts[3:-tail])] + parts[-tail:]
            yield name, at, dict(zip(fields, parts)), block
        at = end + 1 + length


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with its empty line) and payload; a block without a status line is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    cut = block.find(b"\r\n\r\n")
    return (block, b"") if cut < 0 else (block[: cut + 4], block[cut + 4 :])


def warc_date(arc_date: str) -> str:
    """ISO form of a 14, 12 or 8 digit ARC date; anything else gives the epoch."""
    for form, n in (("%Y%m%d%H%M%S", 14), ("%Y%m%d%H%M", 12), ("%Y%m%d", 8)):
        if len(arc_date) == n:
            try:
                return dt.datetime.strptime(arc_date, form).strftime("%Y-%m-%dT%H:%M:%SZ")
            except ValueError:
                break
    return "1970-01-01T00:00:00Z"


def record_id(name: str, offset: int) -> str:
    return f"urn:uuid:{uuid.uuid5(_NAMESPACE, f'{name}#{offset}')}"


def warc_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.0", f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in headers], f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record; raises ValueError on a broken one."""
    at = 0
    while at < len(data):
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC record at {at}")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        length = int(headers["content-length"])
        block = data[end + 4 : end + 4 + length]
        if len(block) < length:
            raise ValueError(f"record at {at} ends before its declared length")
        yield headers, block
        at = end + 4 + length


def _safe_url(url: str | None) -> str:
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~-._") if url else "unknown:"


def _arc_files(limit: int):
    """Rows (page_id, url, html) to rows that each hold one ARC file; versions alternate by file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, parts, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "html")]
            for page_id, url, html in zip(*columns):
                version = 1 + number % 2
                name = f"pages-{task:06d}-{number:06d}.arc"
                if not parts:
                    parts = [arc_version_block(name, version)]
                    size = len(parts[0])
                payload = html or b""
                head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                head += "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
                head += f"Content-Length: {len(payload)}\r\n\r\n"
                date = (_EPOCH + dt.timedelta(seconds=(page_id or 0) % 600_000_000)).strftime("%Y%m%d%H%M%S")
                record = arc_record(version, name, size + 1, _safe_url(url), date, head.encode() + payload)
                parts.append(record)
                size += 1 + len(record)
                if size >= limit:
                    yield pa.RecordBatch.from_arrays([pa.array([b"\n".join(parts)], pa.binary())], names=["value"])
                    number, parts, size = number + 1, [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"\n".join(parts)], pa.binary())], names=["value"])

    return run


def _save(files: DataFrame, path: str, separator: str, codec: str) -> None:
    """One file per row. A string column takes the bytes as they are."""
    rows = files.select(F.col("value").cast("string").alias("value"))
    rows.write.option("lineSep", separator).option("compression", codec).option("maxRecordsPerFile", 1).text(path)


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")


def _opened(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def write_arc(pages: DataFrame, path: str, codec: str = "gzip", limit: int = ARCHIVE_BYTES) -> None:
    """Write ``pages`` (page_id, url, html) as ARC files of versions 1 and 2. Null html is an empty payload."""
    slim = pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("binary").alias("html"))
    _save(slim.mapInArrow(_arc_files(limit), "value binary"), path, "\n", codec)


_ARC_ROW = (
    "record string, url string, date string, ip string, mime string, head binary, payload binary, "
    "page_id long, bytes long, digest string"
)


def _arc_rows(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 5 + [pa.binary()] * 2 + [pa.int64()] * 2 + [pa.string()]
        names = "record url date ip mime head payload page_id bytes digest".split()
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for name, at, fields, block in parse_arc(_opened(content.as_py())):
                    head, payload = split_http(block)
                    page = re.search(rb"(?im)^X-Page-Id: (-?\d+)\r?$", head)
                    rows.append(
                        (
                            record_id(name, at),
                            fields["URL"],
                            warc_date(fields["Archive-date"]),
                            fields["IP-address"],
                            fields["Content-type"],
                            head if with_payload else None,
                            payload if with_payload else None,
                            int(page[1]) if page else None,
                            len(payload),
                            sha1_base32(payload),
                        )
                    )
                    size += len(payload)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def read_arc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of the ARC files under ``path`` with synthesised WARC identifier, date and payload digest."""
    return _archives(spark, path).mapInArrow(_arc_rows(with_payload), _ARC_ROW)


def _warc_files(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, parts, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            # the writer adds the last separator
            return pa.RecordBatch.from_arrays([pa.array([b"\r\n\r\n".join(parts)], pa.binary())], names=["value"])

        for batch in batches:
            for r in batch.to_pylist():
                if not parts:
                    name = f"pages-{task:06d}-{number:06d}.warc"
                    info = b"software: noteloom\r\nformat: WARC File Format 1.0\r\n"
                    parts = [
                        warc_record(
                            "warcinfo",
                            [
                                ("WARC-Record-ID", f"<{record_id(name, 0)}>"),
                                ("WARC-Date", "2001-01-01T00:00:00Z"),
                                ("WARC-Filename", name),
                                ("Content-Type", "application/warc-fields"),
                            ],
                            info,
                        )
                    ]
                    size = len(parts[0])
                revisit, http = r["first_record"] is not None, bool(r["head"])
                block = r["head"] if revisit else r["head"] + r["payload"]
                kind = "revisit" if revisit else "response" if http else "resource"
                headers = [
                    ("WARC-Record-ID", f"<{r['record']}>"),
                    ("WARC-Date", r["date"]),
                    ("WARC-Target-URI", r["url"]),
                    ("WARC-IP-Address", r["ip"]),
                    ("Content-Type", "application/http; msgtype=response" if http else r["mime"]),
                    ("WARC-Payload-Digest", f"sha1:{r['digest']}"),
                    ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
                    ("X-Payload-Length", str(r["bytes"])),
                ]
                if r["page_id"] is not None:
                    headers.append(("X-Page-Id", str(r["page_id"])))
                if revisit:
                    headers += [
                        ("WARC-Profile", REVISIT),
                        ("WARC-Refers-To", f"<{r['first_record']}>"),
                        ("WARC-Refers-To-Target-URI", r["first_url"]),
                        ("WARC-Refers-To-Date", r["first_date"]),
                    ]
                    if r["first_page"] is not None:
                        headers.append(("X-Refers-To-Page-Id", str(r["first_page"])))
                parts.append(warc_record(kind, headers, block))
                size += len(parts[-1])
                if size >= limit:
                    yield flush()
                    number, parts, size = number + 1, [], 0
        if parts:
            yield flush()

    return run


def convert_arc(
    spark: SparkSession, arc_path: str, warc_path: str, codec: str = "gzip", min_bytes: int = 0, limit: int = ARCHIVE_BYTES
) -> None:
    """Convert the ARC files under ``arc_path`` to WARC files under ``warc_path``.

    Of the records with equal payloads of at least ``min_bytes`` bytes, the one with the smallest page id
    (then record identifier; no page id comes last) keeps its payload; the others become revisits of it.
    """
    plain = staged(read_arc(spark, arc_path, with_payload=False).where(F.col("bytes") >= min_bytes).drop("head", "payload"))
    order = F.struct(F.col("page_id").isNull(), "page_id", "record")
    first = plain.groupBy("digest").agg(
        F.min_by(F.struct(*[F.col(c).alias(f"first_{c.split('_')[0]}") for c in ("record", "url", "date", "page_id")]), order).alias("f"),
        F.count("*").alias("n"),
    )
    first = staged(first.where("n > 1").select("digest", "f.*"))
    again = plain.select("record", "digest").join(first, "digest").where(F.col("record") != F.col("first_record"))
    again = again.drop("digest")
    records = read_arc(spark, arc_path).join(again, "record", "left")
    _save(records.mapInArrow(_warc_files(limit), "value binary"), warc_path, "\r\n\r\n", codec)


_WARC_ROW = (
    "record string, record_type string, page_id long, url string, date string, payload_bytes long, payload_digest string, "
    "refers_to_record string, refers_to long, payload binary"
)


def _warc_rows(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda v: None if v is None else int(v)
        strip = lambda v: None if v is None else v.strip("<>")
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = [c.strip().split(" ")[0] for c in _WARC_ROW.split(",")]
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for h, block in parse_warc(_opened(content.as_py())):
                    if h["warc-type"] == "warcinfo":
                        continue
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    if h["warc-block-digest"] != f"sha1:{sha1_base32(block)}":
                        raise ValueError(f"{h['warc-record-id']}: block digest differs")
                    payload, length = None, int(h.get("x-payload-length", -1))
                    if h["warc-type"] != "revisit":
                        payload = split_http(block)[1]
                        length = len(payload)
                        if sha1_base32(payload) != digest:
                            raise ValueError(f"{h['warc-record-id']}: payload digest differs")
                    rows.append(
                        (
                            strip(h["warc-record-id"]),
                            h["warc-type"],
                            number(h.get("x-page-id")),
                            h.get("warc-target-uri"),
                            h["warc-date"],
                            length,
                            digest,
                            strip(h.get("warc-refers-to")),
                            number(h.get("x-refers-to-page-id")),
                            payload if with_payload else None,
                        )
                    )
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of the WARC files under ``path``; digests and declared lengths are checked on the way."""
    return _archives(spark, path).mapInArrow(_warc_rows(with_payload), _WARC_ROW)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as ARC, convert to WARC in the shared folder, and read the WARC files back.

    One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to, record, url, date. Null
    html is an empty payload and null ids are kept; rows with equal ids stay separate records. An empty
    table gives an empty result.
    """
    spark = pages.sparkSession
    root = f"{shared_dir(spark)}/archives/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    write_arc(pages, f"{root}/arc")
    convert_arc(spark, f"{root}/arc", f"{root}/warc")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/arc")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return read_warc(spark, f"{root}/warc", with_payload=False).drop("payload", "refers_to_record")
