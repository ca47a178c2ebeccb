"""WARC archives: writing records with revisits, and a reader that salvages damaged archives.

Writing: records of equal payloads (at least ``least`` bytes) are one group; the one with the
largest id is a response, the others are revisits that refer to it. Each record is a gzip
member of its own, with digests of its block and of its full payload; tasks cut their records
into archives of some ``ARCHIVE_BYTES``.

Reading: an archive is read record by record, and each must pass its checks: the member's
CRC, the version line, the header lines, the stated length, the end of the record, and the
digests. After one that fails the reader looks for the next place at which a valid record
begins (a gzip member, or a version line where the archive isn't compressed), goes on there,
and tells the bytes between as a gap, with the reason. Every byte of an archive is thus in
one record or in one gap. A candidate place is checked in full before it is trusted, so what
looks like a beginning within a payload doesn't cut a record that is sound.

Archives are rows (archive, content), as Spark's binaryFile source gives them; a record is in
memory as a whole, an archive as well, and no more than one archive of a task at a time.

Defined results: a null payload is an empty one; a null id is smaller than any other; all
records that share the largest id of their group are responses; repeated rows are records of
their own; a null address is written as one of the record's id; line ends in header values
become spaces; an empty table gives no archives, and an empty or null archive no records and
no gaps; further columns, whatever their names, are not read. Very long payloads make an
archive of their own.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm._text import release, slices
from textloom.session import materialise, table

#: Compressed bytes after which an archive is closed.
ARCHIVE_BYTES = 8 << 20
#: Payloads shorter than this are always responses.
LEAST_BYTES = 0
#: The date of records that have none.
DATE = "2024-01-01T00:00:00Z"
LEVEL = 6
#: Bytes that are uncompressed at a time, and of a record's header at most.
STEP, HEADER_BYTES = 1 << 15, 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed values of the formats.
MEMBER, END, VERSION = b"\x1f\x8b\x08", b"\r\n\r\n", re.compile(rb"WARC/(\d+\.\d+)\r\n")
LENGTH = re.compile(rb"\d{1,18}\Z")

RECORD = "archive string, offset long, length long, reason string, type string, record_id string, uri string, date string, page_id long, refers_to long, payload_bytes long, payload_digest string, payload binary"


class Damaged(ValueError):
    """Why a record at a place can't be taken."""


class Record(NamedTuple):
    fields: dict[str, str]
    block: bytes


def digest(data: bytes) -> str:
    """SHA-1 in base 32, as WARC headers have it."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{payload_digest}')}>"


def write_record(kind: str, page_id: int | None, uri: str | None, payload: bytes, refers_to: int | None = None, date: str = DATE) -> bytes:
    """An uncompressed record; a revisit has its payload's digest and length, but not the payload."""
    full = digest(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (payload if kind == "response" else b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, full)), ("WARC-Date", date), ("WARC-Target-URI", uri if uri is not None else f"urn:page:{page_id}")]
    if page_id is not None:
        fields.append(("WARC-Page-ID", str(page_id)))
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, full)), ("WARC-Refers-To-Page-ID", str(refers_to))]
    fields += [("WARC-Payload-Digest", f"sha1:{full}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {' '.join(v.splitlines())}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "replace") + block + END


def member(record: bytes, level: int = LEVEL) -> bytes:
    """A gzip member without a time, so that equal records are equal bytes."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(record) + squeeze.flush()


def read_record(data: bytes, at: int) -> tuple[Record, int]:
    """The record at ``at`` of uncompressed bytes, and where it ends. Raises ``Damaged``."""
    version = VERSION.match(data, at)
    if not version:
        raise Damaged("no version line")
    stop = data.find(END, at, at + HEADER_BYTES)
    if stop < 0:
        raise Damaged("header without an end")
    fields: dict[str, str] = {}
    name = None
    for line in data[version.end() : stop].split(b"\r\n") if stop > version.end() else []:
        if line[:1] in (b" ", b"\t") and name:  # a folded line
            fields[name] += " " + line.strip().decode("utf-8", "replace")
            continue
        key, colon, value = line.partition(b":")
        if not colon or not key.strip():
            raise Damaged("header line without a name")
        name = key.strip().decode("utf-8", "replace").lower()
        fields[name] = value.strip().decode("utf-8", "replace")
    if not LENGTH.match(fields.get("content-length", "").encode()):
        raise Damaged("no length")
    start, size = stop + 4, int(fields["content-length"])
    if start + size + 4 > len(data):
        raise Damaged("cut short")
    if data[start + size : start + size + 4] != END:
        raise Damaged("no end where the length says")
    block = data[start : start + size]
    if (said := sha1_of(fields.get("warc-block-digest"))) and said != digest(block):
        raise Damaged("block digest differs")
    found = Record(fields, block)
    if fields.get("warc-type") == "response" and (said := sha1_of(fields.get("warc-payload-digest"))) and said != digest(payload_of(found)):
        raise Damaged("payload digest differs")
    return found, start + size + 4


def sha1_of(value: str | None) -> str | None:
    """The digest of a header value, if it is one that can be checked."""
    kind, _, said = (value or "").partition(":")
    return said.strip().upper() if kind.strip().lower() == "sha1" and len(said.strip()) == 32 else None


def payload_of(record: Record) -> bytes:
    """What follows the HTTP header; the whole block where there is none."""
    if not record.fields.get("content-type", "").startswith("application/http"):
        return record.block
    head, found, body = record.block.partition(END)
    return body if found else b""


def stated_length(record: Record) -> int | None:
    """The length of the full payload that the HTTP header states."""
    head = record.block.partition(END)[0]
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == b"content-length" and LENGTH.match(value.strip()):
            return int(value)
    return None


def read_member(data: bytes, at: int) -> tuple[list[Record], int]:
    """All records of the gzip member at ``at``, and where it ends. Raises ``Damaged``."""
    inflate, pieces, end = zlib.decompressobj(31), [], at
    try:
        while not inflate.eof and end < len(data):  # in steps, so that what follows the member isn't copied again and again
            pieces.append(inflate.decompress(data[end : end + STEP]))
            end += STEP
    except zlib.error as e:
        raise Damaged(f"member: {str(e).rpartition(': ')[2]}") from None
    if not inflate.eof:
        raise Damaged("member is cut short")
    plain, found, place = b"".join(pieces), [], 0
    del pieces
    while place < len(plain):
        record, place = read_record(plain, place)
        found.append(record)
    if not found:
        raise Damaged("member without a record")
    return found, min(end, len(data)) - len(inflate.unused_data)


def read_one(data: bytes, at: int) -> tuple[list[Record], int]:
    """What begins at ``at``: a gzip member or an uncompressed record."""
    if data.startswith(MEMBER, at):
        return read_member(data, at)
    record, end = read_record(data, at)
    return [record], end


def next_member(data: bytes, start: int) -> int:
    at = data.find(MEMBER, start)
    return len(data) if at < 0 else at


def next_version(data: bytes, start: int) -> int:
    found = VERSION.search(data, start)
    return found.start() if found else len(data)


def salvage(data: bytes):
    """Yields ``(offset, length, records, None)`` of what is sound, and ``(offset, length, [], reason)`` of each gap, in order."""
    at = 0
    while at < len(data):
        try:
            records, end = read_one(data, at)
        except Damaged as e:
            reason, begin = str(e), at
            gz = plain = at
            while True:  # the next place that holds a whole valid record
                gz, plain = (next_member(data, at + 1) if gz <= at else gz), (next_version(data, at + 1) if plain <= at else plain)
                at = min(gz, plain)
                if at == len(data):
                    break
                try:
                    records, end = read_one(data, at)
                    break
                except Damaged:
                    continue
            yield begin, at - begin, [], reason
            if at == len(data):
                return
        yield at, end - at, records, None
        at = end


def linked(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """``pages`` (page_id, uri, payload) with ``leader``: whether there is one, and its id, for the pages that revisit it.

    Payloads are equal if their lengths and SHA-256 are. Leaders are found by a partial aggregate, so copies meet as one row per task.
    """
    keyed = pages.select("page_id", "uri", F.coalesce("payload", F.lit(b"")).alias("payload")).withColumns({"_n": F.length("payload"), "_sha": F.sha2("payload", 256)})
    leaders = keyed.groupBy("_sha", "_n").agg(F.max("page_id").alias("_leader"), F.count("*").alias("_rows")).filter((F.col("_rows") > 1) & (F.col("_n") >= least)).drop("_rows")
    met = keyed.join(leaders, ["_sha", "_n"], "left")
    return met.select("page_id", "uri", "payload", F.when(F.col("_leader").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_leader")), F.col("_leader")).alias("leader"))


def archives(pages: DataFrame, least: int = LEAST_BYTES, size: int = ARCHIVE_BYTES) -> DataFrame:
    """archive, content: gzipped WARC archives with one record for each page. ``pages``: page_id, uri, payload (binary)."""

    def pack(batches):
        done: list[bytes] = []
        used = 0

        def close():
            content = b"".join(done)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array([f"{hashlib.sha256(content).hexdigest()[:32]}.warc.gz"]), pa.array([content], pa.binary())], names=["archive", "content"])

        for piece, payloads in slices(batches, "payload"):
            for page_id, uri, leader, payload in zip(piece.column("page_id").to_pylist(), piece.column("uri").to_pylist(), piece.column("leader").to_pylist(), payloads.to_pylist(), strict=True):
                done.append(member(write_record("response" if leader is None else "revisit", page_id, uri, payload, leader)))
                used += len(done[-1])
                if used >= size:
                    yield close()
                    used = 0
        if done:
            yield close()
        release()

    return linked(pages, least).mapInArrow(pack, "archive string, content binary")


def save(content: DataFrame, folder: str) -> DataFrame:
    """Writes archives as files into a folder that all executors share; archive, path. Files appear whole, by renaming, so a task that runs twice writes the same file."""

    def put(batches):
        store, base = pa_fs.FileSystem.from_uri(folder)
        for batch in batches:
            names = []
            for name, data in zip(batch.column("archive").to_pylist(), batch.column("content").to_pylist(), strict=True):
                part = f"{base}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(data)
                store.move(part, f"{base}/{name}")
                names.append(f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column("archive"), pa.array(names, pa.string())], names=["archive", "path"])

    return content.select("archive", "content").mapInArrow(put, "archive string, path string")


def open_archives(spark: SparkSession, path: str) -> DataFrame:
    """archive, content of files, through Spark's own reader."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content")


def read(content: DataFrame, payloads: bool = True) -> DataFrame:
    """Records and gaps of archives: archive, offset, length (bytes in the archive; records of one member share them), reason, and of records their fields.

    A gap has a reason and no type. page_id and refers_to are those of this module's own records; payload_bytes and payload_digest are of the full payload, of revisits as their headers state it. ``payloads`` False leaves the payload null.
    """
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in RECORD.split(", ")])

    def number(value: str | None) -> int | None:
        return int(value) if value and re.fullmatch(r"-?\d{1,18}", value) else None

    def row(archive, offset, length, record: Record) -> tuple:
        f, body = record.fields, payload_of(record)
        known = f.get("warc-type") in ("response", "revisit")
        size = (stated_length(record) if f.get("warc-type") == "revisit" else len(body)) if known else None
        said = sha1_of(f.get("warc-payload-digest")) or (digest(body) if f.get("warc-type") == "response" else None)
        return (archive, offset, length, None, f.get("warc-type"), f.get("warc-record-id"), f.get("warc-target-uri"), f.get("warc-date"), number(f.get("warc-page-id")), number(f.get("warc-refers-to-page-id")), size, said, body if payloads and f.get("warc-type") != "revisit" else None)

    def parse(batches):
        for batch in batches:
            for archive, data in zip(batch.column("archive").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows, held = [], 0
                for offset, length, records, reason in salvage(data or b""):
                    rows += [row(archive, offset, length, r) for r in records] or [(archive, offset, length, reason, *[None] * 9)]
                    held += sum(len(r.block) for r in records) if payloads else 0
                    if held > ARCHIVE_BYTES or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
            release()

    return content.select("archive", "content").mapInArrow(parse, RECORD)


def gaps(found: DataFrame) -> DataFrame:
    """The log of quarantined bytes of ``read``: archive, offset, length, reason."""
    return found.filter("reason is not null").select("archive", "offset", "length", "reason")


def pages_of(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records of ``read``."""
    return found.filter("type in ('response', 'revisit')").select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("uri"), utf8(F.col("html")).alias("payload"))
    stored = materialise(archives(pages), "archives")
    return pages_of(read(stored, payloads=False))


def oracle_sql() -> str:
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS top, count(*) AS n FROM p GROUP BY html),
h AS (SELECT page_id, octet_length(encode(p.html)) AS n_bytes, sha1(encode(p.html)) AS hex, CASE WHEN n > 1 AND octet_length(encode(p.html)) >= {LEAST_BYTES} AND page_id IS DISTINCT FROM top THEN top END AS refers_to FROM p JOIN g USING (html))
SELECT page_id, CAST(n_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS INT)) % 32 + 1 AS INT), 1)), '') AS payload_digest,
  CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM h"""
