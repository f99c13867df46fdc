"""Legacy ARC archives to WARC 1.1.

ARC files of version 1 (five header fields) and 2 (ten) are read by the version block's own declaration and by declared
lengths; URLs may hold spaces, so fields are taken from the right. Every record gets a WARC identifier made from file and
offset (the same in every run), an ISO time, a type, and SHA-1 payload digests. Records whose payload repeats become
revisits of one response. Archives are gzip files written by Spark's text writer, one record a row: the record separator
of the format is the writer's line separator. A file is parsed in one task, so its size is that of a written partition.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonemill.llm.store import stored

LEAST = 1000  # payload bytes from which a repeated payload is a revisit
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# header fields by ARC version: fixed values of the format
FIELDS = {
    b"1": ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    b"2": ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
RECORDS = "file string, record_id string, version int, uri string, ip string, date string, mime string, head binary, payload binary, payload_digest string"
LINE = "value string"


def _strings(values: list[bytes]) -> pa.Array:
    """Bytes as a string column, unchanged even where they are not UTF-8."""
    data = pa.array(values, pa.binary())
    return pa.Array.from_buffers(pa.string(), len(data), data.buffers())


def iso(date: str) -> str:
    """ARC digits (8, 12 or 14) → WARC time."""
    d = (date + "0" * 14)[:14] if date.isdigit() else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


# ---- ARC ----

def arc_record(version: int, uri: str, date: str, head: bytes, payload: bytes, ip: str = "0.0.0.0", mime: str = "text/html") -> bytes:
    body = head + payload
    middle = f"{uri} {ip} {date} {mime}" + (" 200 - - 0 -" if version == 2 else "")
    return f"{middle} {len(body)}\n".encode() + body


def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 zonemill\n{' '.join(FIELDS[str(version).encode()])}\n".encode()
    extra = " 200 - - 0 -" if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{extra} {len(body)}\n".encode() + body


def parse_arc(data: bytes) -> Iterator[tuple[int, int, str, str, str, str, bytes]]:
    """(offset, version, uri, ip, date, mime, content) of every record after the version block.

    A header line that doesn't fit its version or a length beyond the file raises: nothing is skipped.
    """
    at, fields = 0, None
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        stop = data.find(b"\n", at)
        if stop < 0:
            raise ValueError(f"ARC header without end at {at}")
        line = data[at:stop].rstrip(b"\r")
        parts = line.rsplit(b" ", (len(fields) if fields else 10) - 1)
        if fields is None:  # the version block says how the other header lines are cut
            if not line.startswith(b"filedesc:"):
                raise ValueError("ARC file without version block")
            parts = line.split(b" ")
        try:
            length = int(parts[-1])
        except ValueError:
            raise ValueError(f"ARC length is no number at {at}") from None
        content = data[stop + 1:stop + 1 + length]
        if len(content) < length or fields and len(parts) != len(fields):
            raise ValueError(f"ARC record does not fit its header at {at}")
        if fields is None:
            version = content[:1]
            if version not in FIELDS:
                raise ValueError(f"ARC version {version!r}")
            fields = FIELDS[version]
        else:
            uri, ip, date, mime = (p.decode("utf-8", "replace") for p in parts[:4])
            yield at, int(version), uri, ip, date, mime, content
        at = stop + 1 + length


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with its empty line) and payload; a record without HTTP head is all payload."""
    if content.startswith(b"HTTP/"):
        end = content.find(b"\r\n\r\n")
        if end >= 0:
            return content[:end + 4], content[end + 4:]
    return b"", content


def _plain(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def _from_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content")):
            name, rows, size = path.rsplit("/", 1)[-1], [], 0
            for offset, version, uri, ip, date, mime, content in parse_arc(_plain(data.as_py())):
                head, payload = split_http(content)
                rows.append((name, str(uuid.uuid5(uuid.NAMESPACE_URL, f"{name}#{offset}")), version, uri, ip, date, mime, head, payload, hashlib.sha1(payload).hexdigest()))
                size += len(content)
                if size > 1 << 22:
                    yield _table(rows)
                    rows, size = [], 0
            if rows:
                yield _table(rows)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), *[pa.string()] * 4, pa.binary(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in RECORDS.split(", ")])


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the ARC files under a path; a file without records after its version block gives no rows."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_from_arc, RECORDS)


# ---- WARC ----

def warc_record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{head}\r\n".encode() + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields (lower-case) and block of every record, by declared lengths."""
    at = 0
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(fields["content-length"])
        block = data[end + 4:end + 4 + length]
        if len(block) < length:
            raise ValueError(f"WARC block shorter than declared at {at}")
        yield fields, block
        at = end + 4 + length


def _to_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    info = warc_record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'zonemill-{part}')}>"), ("WARC-Date", iso("")), ("Content-Type", "application/warc-fields")], b"software: zonemill\r\nformat: WARC File Format 1.1\r\n")
    first = True
    for batch in batches:
        rows = [info] if first and batch.num_rows else []
        first = first and not batch.num_rows
        for r in batch.to_pylist():
            digest = "sha1:" + base64.b32encode(bytes.fromhex(r["payload_digest"])).decode()
            uri = r["uri"].replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20")
            fields = [("WARC-Record-ID", f"<urn:uuid:{r['record_id']}>"), ("WARC-Date", iso(r["date"])), ("WARC-Target-URI", uri), ("WARC-IP-Address", r["ip"]), ("WARC-Payload-Digest", digest)]
            if r["refers_id"]:
                fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{r['refers_id']}>")]
                kind, block = "revisit", r["head"]
            else:
                kind, block = ("response" if r["head"] else "resource"), r["head"] + r["payload"]
                fields.append(("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()))
            mime = "application/http; msgtype=response" if r["head"] else r["mime"]
            rows.append(warc_record(kind, [*fields, ("Content-Type", mime)], block))
        yield pa.RecordBatch.from_arrays([_strings(rows)], ["value"])


def revisits(records: DataFrame, order: Column, least: int = LEAST) -> DataFrame:
    """Adds ``refers_id``: of equal payloads of at least ``least`` bytes the one with the largest ``order`` is kept, the
    others refer to its record (ties: the larger record_id). A digest shared by many records is one row of the grouped side."""
    long = records.where(F.length("payload") >= least)
    kept = (long.groupBy("payload_digest").agg(F.max(F.struct(order.alias("o"), F.col("record_id"))).alias("k"), F.count("*").alias("n"))
            .where("n > 1").select("payload_digest", F.col("k.record_id").alias("kept_id")))
    refers = F.when((F.length("payload") >= least) & (F.col("kept_id") != F.col("record_id")), F.col("kept_id"))
    return records.join(kept, "payload_digest", "left").withColumn("refers_id", refers).drop("kept_id")


def write_warc(records: DataFrame, path: str) -> None:
    """Records with ``refers_id`` (null: a response of its own) → gzipped WARC files."""
    rows = records.select("record_id", "uri", "ip", "date", "mime", "head", "payload", "payload_digest", "refers_id").mapInArrow(_to_warc, LINE)
    _write(rows, path, "\r\n\r\n")


def _write(rows: DataFrame, path: str, separator: str) -> None:
    rows.write.mode("overwrite").option("lineSep", separator).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def convert(spark: SparkSession, arcs: str, warcs: str, order: Column) -> None:
    """ARC files → WARC files."""
    write_warc(revisits(read_arc(spark, arcs), order), warcs)


def _from_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("content"):
            rows, size = [], 0
            for fields, block in parse_warc(_plain(data.as_py())):
                kind = fields["warc-type"]
                if kind == "warcinfo":
                    continue
                head, payload = split_http(block)
                digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                if kind != "revisit" and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"payload of {fields['warc-record-id']} does not fit its digest")
                rows.append((fields["warc-record-id"][10:-1], kind, fields["warc-target-uri"], fields["warc-date"], head, None if kind == "revisit" else payload, digest, fields.get("warc-refers-to", "")[10:-1] or None))
                size += len(block)
                if size > 1 << 22:
                    yield _archived(rows)
                    rows, size = [], 0
            if rows:
                yield _archived(rows)


ARCHIVED = "record_id string, kind string, uri string, date string, head binary, payload binary, payload_digest string, refers_id string"


def _archived(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [*[pa.string()] * 4, pa.binary(), pa.binary(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in ARCHIVED.split(", ")])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files; a response's payload is checked against its digest, a revisit has no payload."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_from_warc, ARCHIVED)


# ---- pages as a legacy crawl ----

def _pages_as_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, first = TaskContext.get().partitionId(), True
    version = 1 + part % 2
    for batch in batches:
        rows = [arc_version_block(version, f"pages-{part}.arc", "19960801000000") + b"\n"] if first and batch.num_rows else []
        first = first and not batch.num_rows
        for page, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
            payload = (html or "").encode()
            head = f"HTTP/1.0 200 OK\r\nX-Page-Id: {'' if page is None else page}\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
            uri = (url or "urn:none").replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20") or "urn:none"
            rows.append(arc_record(version, uri, f"1996{(page or 0) % 12 + 1:02d}01000000", head, payload))
        yield pa.RecordBatch.from_arrays([_strings(rows)], ["value"])


def pages_to_arc(pages: DataFrame, path: str) -> None:
    """The ``pages`` table as a legacy crawl: ARC files of both versions, page_id as an HTTP field."""
    _write(pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(_pages_as_arc, LINE), path, "\n")


def _http(name: str) -> Column:
    return F.regexp_extract(F.col("head").cast("string"), rf"(?m)^{name}: ([0-9-]+)\r?$", 1)


def page_of() -> Column:
    text = _http("X-Page-Id")
    return F.when(text != "", text).cast("long")


def page_digests(archived: DataFrame) -> DataFrame:
    """Per page: payload bytes and digest, record type and the page a revisit refers to, all from the archives."""
    meta = stored(archived.select("record_id", page_of().alias("page_id"), F.coalesce(F.length("payload").cast("long"), _http("Content-Length").cast("long")).alias("payload_bytes"), "payload_digest", F.col("kind").alias("record_type"), "refers_id"), "archived")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    # only revisits refer to a record: the others, nearly all, take no part in the join
    target = meta.where("refers_id is null").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"))
    revisits = meta.where("refers_id is not null").join(target, "refers_id", "left").select(*columns, "refers_to")
    return meta.where("refers_id is null").select(*columns, F.lit(None).cast("long").alias("refers_to")).unionByName(revisits)
