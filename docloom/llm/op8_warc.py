"""Operator 8: convert ARC archives to WARC.

ARC files (versions 1 and 2, of gzip members) are read by their version's header fields and declared lengths. Every
record becomes a WARC record with a synthesised id, time, type and digests. Of records whose payloads are equal and
at least MIN_PAYLOAD bytes, the first by page id (then archive and place) is the response; the others revisit it,
without their payload. The first of each digest is found by a grouped minimum and joined back, so a group of copies
of any size is only a key; an archive's revisits, as many as its records at most, go to the task that converts it.
An archive ends after ARCHIVE_BYTES of whole records or ARCHIVE_RECORDS of them, and a task reads its archives one after
another, so its memory is bounded; tasks grow with the archives, but are TASK_ARCHIVES times fewer.

Defined results: null and empty html is an empty payload; null or odd urls are escaped in ARC headers; a null page_id
is written without one and comes last among equal payloads; rows are records, repeated page_ids too: of equal payloads
with one page_id the first by archive and place is the response; payloads of any length are written whole, a very long
one in an archive of its own; an empty table gives no archives; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import get_file, lean, put_file, scratch, table, written

MIN_PAYLOAD = 100
#: Bytes of whole records before packing, and records, of an archive after which the next one is begun; a larger record
#: has an archive of its own. So what a task holds of an archive is bounded, however small its records are.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 64 << 20, 100_000
#: Archives that a task reads, one after another, where there are more of them than cores.
TASK_ARCHIVES = 64
_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}  # fixed values: header lines of both versions
_DATE = "20240101000000"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def gunzip(data: bytes) -> bytes:
    """All members, or the bytes themselves if they aren't gzip."""
    out = []
    while data[:2] == b"\x1f\x8b":
        unpacker = zlib.decompressobj(31)
        out.append(unpacker.decompress(data))
        data = unpacker.unused_data
    return b"".join(out) + data


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    content: bytes


def arc_record(version: int, url: str, ip: str, date: str, mime: str, content: bytes, name: str = "-") -> bytes:
    middle = [] if version == 1 else ["200", "-", "-", "0", name]
    return " ".join([url, ip, date, mime, *middle, str(len(content))]).encode() + b"\n" + content + b"\n"


def arc_head(version: int, name: str) -> bytes:
    return arc_record(version, f"filedesc://{name}", "0.0.0.0", _DATE, "text/plain", f"{version} 0 docloom\n{_FIELDS[version]}\n\n".encode(), name)


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records after the version block, which says how many fields a header line has."""
    at, fields = 0, 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        stop = data.index(b"\n", at)
        line = data[at:stop].decode("utf-8", "replace").rstrip("\r")
        size = int(line.rsplit(" ", 1)[1])
        content = data[stop + 1 : stop + 1 + size]
        if len(content) != size:
            raise ValueError(f"the archive ends within the record {line[:200]}")
        at = stop + 1 + size
        if not fields:
            fields = len(_FIELDS[int(content.split(b" ", 1)[0])].split())
            continue
        url, *rest = line.rsplit(" ", fields - 1)
        yield ArcRecord(url, rest[0], rest[1], rest[2], content)


def http_parts(content: bytes) -> tuple[bytes, bytes]:
    """An HTTP message's head and payload; without a head all is payload."""
    if content.startswith(b"HTTP/"):
        head, found, payload = content.partition(b"\r\n\r\n")
        if found:
            return head + found, payload
    return b"", content


def _header(head: bytes, name: bytes) -> str | None:
    found = re.search(rb"(?im)^" + name + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace").strip() if found else None


def iso_time(date: str) -> str:
    """A time of 12 or 14 digits as in WARC."""
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(archive: str, place: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{place}')}>"


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def warc_record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{lines}WARC-Block-Digest: sha256:{sha256(block)}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of every record."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:stop].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record: {first[:100]}")
        fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = int(fields["content-length"])
        yield fields, data[stop + 4 : stop + 4 + size]
        at = stop + 4 + size + 4


def write_arcs(pages: DataFrame, folder: str) -> DataFrame:
    """Write (page_id, url, html) as ARC files, version 1 and 2 in turn; return their paths."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0
        version = 1 + part % 2

        def flush() -> pa.RecordBatch:
            name = f"part-{part:06d}-{seq:06d}.arc.gz"
            return pa.RecordBatch.from_pydict({"arc": [put_file(folder, name, b"".join([gzip_member(arc_head(version, name)), *held]))]})

        for batch in batches:
            for page, url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                payload = (source.as_py() or "").encode("utf-8", "replace")
                mark = "" if page is None else f"X-Page-Id: {page}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{mark}\r\n".encode()
                address = quote(url or "", safe="!#$%&'()*+,/:;=?@[]~") or "unknown:"
                record = arc_record(version, address, "0.0.0.0", _DATE, "text/html", head + payload)
                held.append(gzip_member(record))
                size += len(record)
                if size >= ARCHIVE_BYTES or len(held) >= ARCHIVE_RECORDS:
                    yield flush()
                    seq, held, size = seq + 1, [], 0
        if held:
            yield flush()

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return written(rows.mapInArrow(lean(write), "arc string"), "op8-arcs")


def arc_index(arcs: DataFrame) -> DataFrame:
    """Every record of the archives: arc (file name), place, page_id, payload_bytes, digest."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for place, r in enumerate(read_arc(gunzip(get_file(path)))):
                    head, payload = http_parts(r.content)
                    page = _header(head, b"X-Page-Id")
                    rows.append((path.rsplit("/", 1)[1], place, int(page) if page else None, len(payload), sha256(payload)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["arc", "place", "page_id", "payload_bytes", "digest"])

    return written(arcs.mapInArrow(lean(index), "arc string, place int, page_id long, payload_bytes long, digest string"), "op8-index")


def convert_arcs(arcs: DataFrame, folder: str) -> DataFrame:
    """Write a WARC for every ARC (column arc: path); return the WARCs' paths."""
    count = arcs.count()
    spread = max(1, min(count, arcs.sparkSession.sparkContext.defaultParallelism), -(-count // TASK_ARCHIVES))
    arcs = written(arcs.repartition(spread, "arc"), "op8-spread")
    index = arc_index(arcs)
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "arc", "place")
    first = index.where(F.col("payload_bytes") >= MIN_PAYLOAD).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    again = index.where(F.col("payload_bytes") >= MIN_PAYLOAD).join(first.hint("merge"), "digest").where("arc <> first.arc or place <> first.place")
    lists = again.groupBy("arc").agg(F.collect_list(F.struct("place", F.col("first.page_id").alias("to_page"), F.col("first.arc").alias("to_arc"), F.col("first.place").alias("to_place"))).alias("revisits"))
    todo = arcs.select(F.col("arc").alias("path"), F.element_at(F.split("arc", "/"), -1).alias("arc")).join(lists.hint("merge"), "arc", "left").select("path", "revisits")

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, revisits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                arc = path.rsplit("/", 1)[1]
                name = re.sub(r"\.arc(\.gz)?$", "", arc) + ".warc.gz"
                decided = {r["place"]: r for r in revisits or ()}
                info = warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(arc, -1)), ("WARC-Date", iso_time(_DATE)), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], f"software: docloom\r\nformat: WARC File Format 1.1\r\nconverted-from: {arc}\r\n".encode())
                out = [gzip_member(info)]
                for place, r in enumerate(read_arc(gunzip(get_file(path)))):
                    out.append(gzip_member(_converted(arc, place, r, decided.get(place))))
                yield pa.RecordBatch.from_pydict({"warc": [put_file(folder, name, b"".join(out))]})

    return written(todo.repartition(spread, "path").mapInArrow(lean(convert), "warc string"), "op8-warcs")


def _converted(arc: str, place: int, r: ArcRecord, revisit: dict | None) -> bytes:
    head, payload = http_parts(r.content)
    fields = [("WARC-Type", "revisit" if revisit else "response" if head else "resource"), ("WARC-Record-ID", record_id(arc, place)), ("WARC-Date", iso_time(r.date)), ("WARC-Target-URI", r.url), ("WARC-IP-Address", r.ip if r.ip != "0.0.0.0" else None), ("WARC-Payload-Digest", f"sha256:{sha256(payload)}")]
    if revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(revisit["to_arc"], revisit["to_place"])),
            ("WARC-Page-Refers-To", None if revisit["to_page"] is None else str(revisit["to_page"])), ("Content-Type", "application/http; msgtype=response"),
        ]
        return warc_record(fields, head)
    fields.append(("Content-Type", "application/http; msgtype=response" if head else r.mime))
    return warc_record(fields, r.content)


def read_warcs(spark: SparkSession, folder: str) -> DataFrame:
    """Response, resource and revisit records of all WARCs in the folder, their digests verified."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in read_warc(gunzip(content.as_py())):
                    kind = fields["warc-type"]
                    if kind == "warcinfo":
                        continue
                    if fields["warc-block-digest"] != f"sha256:{sha256(block)}":
                        raise ValueError(f"a block of {fields['warc-record-id']} was changed")
                    head, payload = http_parts(block)
                    digest, size = fields["warc-payload-digest"].removeprefix("sha256:"), len(payload)
                    if kind == "revisit":
                        size = int(_header(head, b"Content-Length") or 0)
                    elif sha256(payload) != digest:
                        raise ValueError(f"the payload of {fields['warc-record-id']} was changed")
                    page, to = _header(head, b"X-Page-Id"), fields.get("warc-page-refers-to")
                    rows.append((int(page) if page else None, size, digest, kind, int(to) if to else None, fields["warc-record-id"], fields.get("warc-refers-to"), fields["warc-target-uri"], fields["warc-date"]))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "refers_to_record", "url", "date"]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_record string, url string, date string"
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("content").mapInArrow(lean(read), schema)


def op8_warc_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = write_arcs(table(spark, sf_dir, "pages"), scratch(spark, "op8-arc-files"))
    folder = scratch(spark, "op8-warc-files")
    if not convert_arcs(arcs, folder).take(1):
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read_warcs(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_SQL = f"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, payload_bytes >= {MIN_PAYLOAD} AND row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) > 1 AS again, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM f
"""
QUERIES = {"op8_warc_conversion": op8_warc_conversion}
ORACLE = {"op8_warc_conversion": _SQL}
