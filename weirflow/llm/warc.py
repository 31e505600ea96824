"""Legacy ARC archives to WARC archives, and back to rows.

The converter reads ARC 1 and ARC 2 alike: the version block at the head names
the fields of the header lines that follow, each line declares how many bytes
its record has, and one newline closes a record.  For every record a WARC
equivalent is synthesised: identifier (a name-based UUID of address, date and
payload digest), 14-digit dates as ISO 8601, a type (the version block becomes
``warcinfo``, what starts with an HTTP status line ``response``, anything else
``resource``; known payloads ``revisit``) and SHA-256 digests of block and
payload.

Archives are written by Spark's text sink: a WARC record and the two newlines
that end it are a "line" with its separator, so the files are genuine
``.warc`` streams (gzip) on whatever store Spark writes to.

Defined results: null pages have empty payloads; null addresses become
``urn:none``; white space in an address is percent-encoded; a null page_id
comes back as null and is a revisit if an equal payload has an id; of repeated
rows that share the smallest page_id each stays a response; a page is written
whole, however long (a record and its page must fit a task); empty tables give
empty archives; further columns are not read.
"""

from __future__ import annotations

import calendar
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.workspace import delete, materialise, new_path

#: Field names of the header lines, by version.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_REVISIT = 100  #: payloads of fewer bytes are always written in full
RECORDS_A_FILE = 1000
SEGMENT = 4_000_000  #: bytes of ARC converted at a time
EPOCH = datetime(2000, 1, 1, tzinfo=UTC)


class ArchiveError(ValueError):
    """An archive that does not follow its own declarations."""


# -- ARC ---------------------------------------------------------------------


@dataclass(frozen=True)
class ArcRecord:
    """A header line's fields by name, and the declared bytes behind it."""

    version: int
    fields: dict[str, str]
    block: bytes
    head: bool = False  #: whether it is the version block


def arc_head(version: int, name: str, date: str) -> bytes:
    """The version block that opens an ARC file."""
    body = f"{version} 0 weirflow\n{' '.join(FIELDS[version])}\n".encode()
    return arc_record(version, f"filedesc://{name}", date, "text/plain", body)


def arc_record(version: int, url: str, date: str, kind: str, block: bytes, filename: str = "-", offset: int = 0) -> bytes:
    """One record with the header line of its version."""
    values = [url, "0.0.0.0", date, kind]
    if version == 2:
        values += ["200", "-", "-", str(offset), filename]
    return " ".join([*values, str(len(block))]).encode() + b"\n" + block + b"\n"


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, its version block first: only the first record can be one, whatever addresses others have."""
    at, names, version, first = 0, FIELDS[1], 1, True
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ArchiveError("the header line does not end")
        parts = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        is_head, first = first and parts[0].startswith("filedesc://"), False
        expected = (len(FIELDS[1]), len(FIELDS[2])) if is_head else (len(names),)
        if len(parts) not in expected or not parts[-1].isdigit():
            raise ArchiveError(f"not a header line of version {version}: {parts[:3]}")
        block = data[end + 1 : end + 1 + int(parts[-1])]
        if len(block) < int(parts[-1]):
            raise ArchiveError("fewer bytes than declared")
        if is_head:
            version = int(block.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ArchiveError(f"version {version}")
            lines = block.decode("utf-8", "replace").split("\n")
            names = tuple(lines[1].split()) if len(lines) > 1 and lines[1].strip() else FIELDS[version]
        yield ArcRecord(version, dict(zip(FIELDS[2] if len(parts) == len(FIELDS[2]) else FIELDS[1], parts, strict=True)) if is_head else dict(zip(names, parts, strict=True)), block, is_head)
        at = end + 1 + int(parts[-1])


# -- WARC --------------------------------------------------------------------


def iso_date(date: str) -> str:
    """A 14-digit (or shorter, or broken) ARC date as WARC writes it; parts that no calendar or clock has count as their least."""
    digits = re.sub(r"\D", "", date)[:14].ljust(14, "0")
    year, month, day, hour, minute, second = (int(digits[a:b]) for a, b in ((0, 4), (4, 6), (6, 8), (8, 10), (10, 12), (12, 14)))
    year, month = max(year, 1), month if 1 <= month <= 12 else 1
    day = day if 1 <= day <= calendar.monthrange(year, month)[1] else 1
    hour, minute, second = (x if x < most else 0 for x, most in ((hour, 24), (minute, 60), (second, 60)))
    return f"{year:04}-{month:02}-{day:02}T{hour:02}:{minute:02}:{second:02}Z"


def record_id(url: str, date: str, payload_digest: str) -> str:
    """The same for the same capture, wherever and whenever it is converted."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {payload_digest}')}>"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head (with its empty line) and payload of a block; no head if it isn't HTTP."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    cut = block.find(b"\r\n\r\n")
    return (block, b"") if cut < 0 else (block[: cut + 4], block[cut + 4 :])


@dataclass(frozen=True)
class Original:
    """The capture that a revisit points at."""

    url: str
    date: str
    label: str  #: what WARC-Refers-To-Label says of it


def to_warc(record: ArcRecord, revisit: Callable[[bytes, str], Original | None] = lambda head, digest: None) -> bytes:
    """The WARC equivalent of an ARC record, without the newlines that end it."""
    url, date = record.fields["URL"], iso_date(record.fields["Archive-date"])
    head, payload = split_http(record.block)
    digest = hashlib.sha256(payload).hexdigest()
    fields = {"WARC-Type": "resource", "WARC-Record-ID": record_id(url, date, digest), "WARC-Date": date}
    kind, block = record.fields["Content-type"], record.block
    if record.head:
        fields |= {"WARC-Type": "warcinfo", "WARC-Filename": url.removeprefix("filedesc://")}
        kind = "application/warc-fields"
        block = f"software: weirflow\r\nformat: WARC File Format 1.1\r\nconverted-from: ARC {record.version}\r\n".encode()
    else:
        fields |= {"WARC-Target-URI": url, "WARC-Payload-Digest": f"sha256:{digest}"}
        if record.fields.get("IP-address", "0.0.0.0") != "0.0.0.0":
            fields["WARC-IP-Address"] = record.fields["IP-address"]
        if head:
            fields["WARC-Type"], kind = "response", "application/http;msgtype=response"
            if original := revisit(head, digest):
                block = head
                fields |= {
                    "WARC-Type": "revisit", "WARC-Profile": REVISIT_PROFILE, "WARC-Truncated": "length",
                    "WARC-Refers-To": record_id(original.url, original.date, digest), "WARC-Refers-To-Target-URI": original.url,
                    "WARC-Refers-To-Date": original.date, "WARC-Refers-To-Label": original.label,
                }
    fields |= {"WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type": kind, "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block


#: The fields that are read, as they are written; their case does not matter.
_NAMES = {
    name.lower(): name
    for name in (
        "WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Block-Digest", "WARC-Filename", "WARC-IP-Address", "WARC-Profile",
        "WARC-Truncated", "WARC-Refers-To", "WARC-Refers-To-Target-URI", "WARC-Refers-To-Date", "WARC-Refers-To-Label", "Content-Type", "Content-Length",
    )
}


def read_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and block of each record of a WARC stream."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ArchiveError(f"not a record: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        fields = {_NAMES.get(name, name): value for name, value in fields.items()}
        size = int(fields["Content-Length"])
        block = stream.read(size)
        if len(block) < size:
            raise ArchiveError("fewer bytes than declared")
        yield fields, block


# -- frames ------------------------------------------------------------------


def convert(arcs: DataFrame, content_col: str = "content") -> DataFrame:
    """Column ``record`` (binary): the WARC equivalent of every record of ARC files (gzip or plain) given as binary rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0):
                data = cell.as_py() or b""
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                yield pa.RecordBatch.from_arrays([pa.array([to_warc(r) for r in read_arc(data)], pa.binary())], names=["record"])

    return arcs.select(F.col(content_col).alias("content")).mapInArrow(run, "record binary")


def write_archives(records: DataFrame, path: str) -> None:
    """Write column ``record`` as gzipped WARC files."""
    text = records.select(F.col("record").cast("string").alias("value"))
    text.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


READ = "record_type string, record_id string, refers_to_id string, url string, date string, payload_digest string, payload_bytes long, refers_label string, http_head binary, payload binary"


def read_archives(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """Rows of all records but ``warcinfo``; digests of full payloads are checked, those of revisits taken over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("refers_to_id", pa.string()), ("url", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_label", pa.string()), ("http_head", pa.binary()), ("payload", pa.binary())])
        for batch in batches:
            for cell in batch.column(0):
                out: list[tuple] = []
                size = 0
                with gzip.GzipFile(fileobj=io.BytesIO(cell.as_py())) as stream:
                    for fields, block in read_warc(stream):
                        kind = fields["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        head, payload = split_http(block)
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        if kind == "revisit":
                            declared = re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)
                            n, payload = int(declared[1]) if declared else -1, None
                        else:
                            n = len(payload)
                            if hashlib.sha256(payload).hexdigest() != digest:
                                raise ArchiveError(f"digest of {fields['WARC-Record-ID']}")
                        out.append((kind, fields["WARC-Record-ID"], fields.get("WARC-Refers-To"), fields["WARC-Target-URI"], fields["WARC-Date"], digest, n, fields.get("WARC-Refers-To-Label"), head, payload if keep_payload else None))
                        size += len(block)
                        if size > SEGMENT:
                            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, o, strict=True)) for o in out], schema=schema)
                            out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, o, strict=True)) for o in out], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("length") > 0).select("content").mapInArrow(run, READ)


def _page_date(page_id: int | None) -> str:
    """A capture date for a page that has none."""
    return (EPOCH + timedelta(seconds=(page_id or 0) % (10**9))).strftime("%Y%m%d%H%M%S")


def _page_url(url: str | None) -> str:
    """The address without characters that a header line can't hold."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:none"


def pages_to_records(pages: DataFrame) -> DataFrame:
    """Column ``record`` from (page_id, url, html): through ARC segments, versions 1 and 2 by turns, to WARC.

    Equal payloads are found by their digests; of each the smallest page_id is
    written in full.
    """
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    slim = slim.withColumn("digest", F.sha2("payload", 256))
    known = slim.where(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("page_id", "url")).alias("all_first"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"))
    known = known.where("n > 1").select("digest", F.coalesce("first", "all_first").alias("first"))
    keyed = slim.join(known, "digest", "left").select("page_id", "url", "payload", "digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"), F.col("first").isNotNull().alias("shared"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            names = batch.schema.names
            rows = zip(*(batch.column(names.index(n)) for n in ("page_id", "url", "payload", "digest", "first_id", "first_url", "shared")), strict=True)
            segment, known_by = [], {}
            size, version = 0, turn % 2 + 1
            for row in rows:
                page_id, url, payload, digest, first_id, first_url, shared = (x.as_py() for x in row)
                payload = bytes(payload or b"")
                label = "" if page_id is None else str(page_id)
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {label}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                if shared and first_id is not None and page_id != first_id:
                    known_by[label, digest] = Original(_page_url(first_url), iso_date(_page_date(first_id)), str(first_id))
                segment.append(arc_record(version, _page_url(url), _page_date(page_id), "text/html", head + payload, f"segment-{turn}", size))
                size += len(segment[-1])
                if size > SEGMENT:
                    yield _converted(version, turn, segment, known_by)
                    segment, known_by, size, turn = [], {}, 0, turn + 1
                    version = turn % 2 + 1
            if segment:
                yield _converted(version, turn, segment, known_by)
                turn += 1

    return keyed.mapInArrow(run, "record binary")


def _converted(version: int, turn: int, segment: list[bytes], known_by: dict[tuple[str, str], Original]) -> pa.RecordBatch:
    """One ARC segment as WARC records."""
    arc = arc_head(version, f"segment-{turn}.arc", _page_date(0)) + b"".join(segment)

    def revisit(head: bytes, digest: str) -> Original | None:
        return known_by.get((head.split(b"X-Page-Id: ", 1)[1].split(b"\r\n", 1)[0].decode(), digest))

    return pa.RecordBatch.from_arrays([pa.array([to_warc(r, revisit) for r in read_arc(arc)], pa.binary())], names=["record"])


def resolved(rows: DataFrame, label: Column) -> DataFrame:
    """Rows of :func:`read_archives` with ``label`` and, of revisits, ``refers_to``: the label of the record that WARC-Refers-To names.

    Of several records with one identifier the smallest label counts; where none has it, what the writer noted of it does.
    """
    told = rows.withColumn("label", label)
    targets = told.where("record_type <> 'revisit'").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.min("label").alias("target"))
    asked = told.where("record_type = 'revisit'").join(targets, "refers_to_id", "left").withColumn("refers_to", F.coalesce("target", F.col("refers_label").cast(rows.select(label.alias("x")).schema[0].dataType)))
    return told.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast(asked.schema["refers_to"].dataType)).unionByName(asked.drop("target"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query of this operator over the whole of ``pages``."""
    path = new_path(spark, "warc")
    write_archives(pages_to_records(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    label = F.regexp_extract(F.col("http_head").cast("string"), r"X-Page-Id: (-?\d*)", 1)
    # Read once: what the archives say of each record is small.
    rows = materialise(read_archives(spark, path, keep_payload=False).drop("payload"), "records")
    delete(spark, path)
    return resolved(rows, label.try_cast("long")).select(F.col("label").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN first_id IS NOT NULL AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
