"""Media columns: Matroska files written, and read into packet tables.

The reader goes through the variable-length EBML elements (of unknown size too), tells
tracks, clusters, simple blocks and block groups, the three kinds of lacing, and cues, and
gives a row for every packet: track, timestamp, byte range in the file, key flag. The
writer stores bytes as 8-bit PCM samples of one audio track, in laced blocks, with cues.

Defined results: a null or empty text is stored as 64 zero bytes; equal texts give equal
files; repeated rows, and those of a null doc_id, stay; a very long text is one file, which
a task holds a few times over; an empty table gives an empty table; a file that is null or
no Matroska has no packets and no features but an ``error``; further columns, whatever their
names, are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from textloom.llm._text import slices
from textloom.session import table

#: Payloads are padded with bytes 0 to a positive multiple of this.
UNIT = 64
#: Samples per second, per packet, packets per block, blocks per cluster.
RATE, PACKET, LACED, BLOCKS = 8000, 512, 8, 8

#: Element ids of the format (fixed values).
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ, ID_LENGTH, SIZE_LENGTH, DOC_TYPE, DOC_VERSION, DOC_READ = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
ENTRY, NUMBER, UID, KIND, LACING, CODEC, AUDIO, FREQUENCY, CHANNELS, DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE, GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
PARENTS = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, ENTRY, AUDIO, GROUP, CUE_POINT, CUE_POSITIONS}
TOP = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES}


def vint(n: int, width: int = 0) -> bytes:
    """A number in EBML's variable length; the value of all ones is left for "unknown"."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def unsigned(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(sizes: list[int], kind: int) -> bytes:
    """The head of a laced block: packets less one, then all sizes but the last (kind 1: Xiph, 3: EBML; 2, fixed, has none)."""
    head = bytes([len(sizes) - 1])
    if kind == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == 3:
        head += vint(sizes[0])
        for before, n in zip(sizes, sizes[1:-1], strict=False):
            width = next(w for w in range(1, 9) if abs(n - before) < (1 << 7 * w - 1) - 1)
            head += vint(n - before + (1 << 7 * width - 1) - 1, width)
    return head


def write(payload: bytes, packet: int = PACKET, laced: int = LACED, blocks: int = BLOCKS) -> bytes:
    """``payload`` as the samples of one 8-bit PCM track."""
    head = element(EBML, unsigned(EBML_VERSION, 1) + unsigned(EBML_READ, 1) + unsigned(ID_LENGTH, 4) + unsigned(SIZE_LENGTH, 8) + element(DOC_TYPE, b"matroska") + unsigned(DOC_VERSION, 4) + unsigned(DOC_READ, 2))
    info = element(INFO, unsigned(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)) + element(MUXER, b"textloom") + element(WRITER, b"textloom"))
    audio = element(AUDIO, element(FREQUENCY, struct.pack(">d", RATE)) + unsigned(CHANNELS, 1) + unsigned(DEPTH, 8))
    tracks = element(TRACKS, element(ENTRY, unsigned(NUMBER, 1) + unsigned(UID, 1) + unsigned(KIND, 2) + unsigned(LACING, 1) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    parts, at, cues = [info, tracks], len(info) + len(tracks), []
    for start in range(0, len(payload), packet * laced * blocks):
        time = start * 1000 // RATE
        body = [unsigned(TIMESTAMP, time)]
        for b in range(start, min(len(payload), start + packet * laced * blocks), packet * laced):
            data = payload[b : b + packet * laced]
            sizes = [min(packet, len(data) - i) for i in range(0, len(data), packet)]
            kind = 0 if len(sizes) == 1 else 2 if len(set(sizes)) == 1 else 3
            body.append(element(SIMPLE, b"\x81" + struct.pack(">hB", b * 1000 // RATE - time, 0x80 | kind << 1) + (lace(sizes, kind) if kind else b"") + data))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, time) + element(CUE_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


def number(data: bytes, at: int, keep: bool = False) -> tuple[int, int]:
    """The variable-length number at ``at`` (with its marker bit if ``keep``; -1: unknown size) and where it ends."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no EBML number at {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"cut short at {at}")
    n = int.from_bytes(data[at : at + width], "big")
    if keep:
        return n, at + width
    n -= 1 << 7 * width
    return (-1 if n == (1 << 7 * width) - 1 else n), at + width


def elements(data: bytes, at: int, end: int, depth: int = 0):
    """(depth, id, body start, body end) of every element, parents before what they hold."""
    while at < end:
        ident, body = number(data, at, True)
        size, body = number(data, body)
        stop = end if size < 0 else body + size
        if stop > end:
            raise ValueError(f"element {ident:#x} at {at} passes the end")
        if size < 0 and ident == CLUSTER:  # of unknown size: it ends where another element of the segment begins
            stop = body
            while stop < end and number(data, stop, True)[0] not in TOP:
                n, after = number(data, number(data, stop, True)[1])
                stop = after + n
        yield depth, ident, body, stop
        if ident in PARENTS:
            yield from elements(data, body, stop, depth + 1)
        at = stop


def block(data: bytes, start: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative timestamp, flags and the byte ranges (offset, size) of a block's packets."""
    track, at = number(data, start)
    time, flags = struct.unpack_from(">hB", data, at)
    at += 3
    kind = flags >> 1 & 3
    if not kind:
        return track, time, flags, [(at, end - at)]
    count, at, sizes = data[at] + 1, at + 1, []
    if kind == 1:
        for _ in range(count - 1):
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            n, at = n + data[at], at + 1
            sizes.append(n)
    elif kind == 3 and count > 1:
        n, at = number(data, at)
        sizes.append(n)
        for _ in range(count - 2):
            before = at
            n, at = number(data, at)
            sizes.append(sizes[-1] + n - (1 << 7 * (at - before) - 1) + 1)
    elif kind == 2:
        if (end - at) % count:
            raise ValueError("fixed lacing of unequal packets")
        sizes = [(end - at) // count] * (count - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lacing passes the block's end")
    ranges = []
    for n in sizes:
        ranges.append((at, n))
        at += n
    return track, time, flags, ranges


def read(data: bytes) -> dict:
    """tracks, packets (track, timestamp_ns, offset, size, key, cluster offset) and cues (time_ns, track, cluster offset) of a file."""
    if number(data, 0, True)[0] != EBML:
        raise ValueError("no EBML head")
    whole = lambda a, b: int.from_bytes(data[a:b], "big")
    tracks, packets, cues, scale, base, time, cluster = [], [], [], 1_000_000, 0, 0, 0
    group: dict = {}
    waiting: list = []
    spaced: dict[int, float] = {}  # nanoseconds between the packets of a lace, for tracks of one sample per byte

    def emit(start, end, key=None):
        track, rel, flags, ranges = block(data, start, end)
        when, past = (time + rel) * scale, 0
        for offset, size in ranges:
            packets.append((track, when + round(past * spaced.get(track, 0)), offset, size, bool(flags & 0x80) if key is None else key, cluster))
            past += size

    for _, ident, a, b in elements(data, 0, len(data)):
        if waiting and ident not in (BLOCK_DURATION, REFERENCE):
            emit(*waiting, "reference" not in group)
            waiting = []
        if ident == SEGMENT:
            base = a
        elif ident == SCALE:
            scale = whole(a, b)
        elif ident == ENTRY:
            tracks.append({})
        elif ident in (NUMBER, KIND, CHANNELS, DEPTH) and tracks:
            tracks[-1][{NUMBER: "number", KIND: "kind", CHANNELS: "channels", DEPTH: "depth"}[ident]] = whole(a, b)
        elif ident == CODEC and tracks:
            tracks[-1]["codec"] = data[a:b].decode("latin-1")
        elif ident == FREQUENCY and tracks:
            tracks[-1]["rate"] = struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0]
        elif ident == CLUSTER:
            spaced = {t.get("number"): 8e9 / t["rate"] / t.get("depth", 8) / t.get("channels", 1) for t in tracks if t.get("rate") and "PCM" in t.get("codec", "")}
            cluster = a
        elif ident == TIMESTAMP:
            time = whole(a, b)
        elif ident == SIMPLE:
            emit(a, b)
        elif ident == GROUP:
            group = {}
        elif ident == BLOCK:
            waiting = [a, b]
        elif ident == REFERENCE:
            group["reference"] = True
        elif ident == CUE_POINT:
            cues.append([0, 0, 0])
        elif ident == CUE_TIME:
            cues[-1][0] = whole(a, b) * scale
        elif ident == CUE_TRACK:
            cues[-1][1] = whole(a, b)
        elif ident == CUE_CLUSTER:
            cues[-1][2] = base + whole(a, b)
    if waiting:
        emit(*waiting, "reference" not in group)
    return {"tracks": tracks, "packets": packets, "cues": [tuple(c) for c in cues]}


def with_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text) and media: the padded text as a Matroska file."""

    def store(batches):
        for piece, texts in slices(batches):
            sizes, files = [], []
            for text in texts.cast(pa.large_binary()).to_pylist():
                sizes.append(len(text))
                files.append(write(text + bytes(-len(text) % UNIT if text else UNIT)))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(store, "doc_id long, n_bytes long, media binary")


def packet_table(media: DataFrame) -> DataFrame:
    """One row per packet of each file: doc_id, packet, track, timestamp_ns, offset, size, key_frame, cluster_offset, in_cues, error.

    ``media``: doc_id, media. A file that can't be read gives one row with its ``error``.
    """
    names = ["doc_id", "packet", "track", "timestamp_ns", "offset", "size", "key_frame", "cluster_offset", "in_cues", "error"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.string()]

    def parse(batches):
        for piece, files in slices(batches, "media"):
            rows = []
            for doc_id, data in zip(piece.column("doc_id").to_pylist(), files.to_pylist(), strict=True):
                try:
                    found = read(data)
                    cued, seen = {c for _, _, c in found["cues"]}, None
                    starts = cluster_starts(data) if cued else {}
                    for i, (track, time, offset, size, key, cluster) in enumerate(found["packets"]):
                        rows.append((doc_id, i, track, time, offset, size, key, cluster, cluster != seen and starts.get(cluster) in cued, None))
                        seen = cluster
                except (ValueError, IndexError, struct.error) as e:
                    rows.append((doc_id, None, None, None, None, None, None, None, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names=names)

    return media.select("doc_id", "media").mapInArrow(parse, "doc_id long, packet long, track long, timestamp_ns long, offset long, size long, key_frame boolean, cluster_offset long, in_cues boolean, error string")


def cluster_starts(data: bytes) -> dict[int, int]:
    """Where the element begins, by where its body begins, for each cluster."""
    return {a: data.rfind(CLUSTER.to_bytes(4, "big"), 0, a) for _, ident, a, _ in elements(data, 0, len(data)) if ident == CLUSTER}


def samples(data: bytes, found: dict, track: int = 1) -> bytes:
    """The bytes of a track, from its packets' ranges."""
    return b"".join([data[o : o + n] for t, _, o, n, _, _ in found["packets"] if t == track])


def feature(payload: bytes, found: dict) -> str:
    """Level, spread and zero crossings of the samples, and counts of the file's parts."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    n = max(1, len(x))
    crossed = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    last = max((t for _, t, *_ in found["packets"]), default=0)
    return f"mean={x.sum() / n:.6f};rms={(np.dot(x, x) / n) ** 0.5:.6f};crossings={crossed};packets={len(found['packets'])};cues={len(found['cues'])};last_ns={last}"


def media_features(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, error, from the stored bytes alone. A file that can't be read has an ``error`` and nothing that comes from its samples."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]

    def compute(batches):
        for piece, files in slices(batches, "media"):
            out: list[list] = [[] for _ in range(7)]
            for data, there in zip(files.to_pylist(), piece.column("media").is_valid().to_pylist(), strict=True):
                stored = (len(data), hashlib.sha256(data).hexdigest()) if there else (None, None)
                try:
                    found = read(data)
                    payload = samples(data, found)
                    row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), *stored, feature(payload, found), None)
                except (ValueError, IndexError, struct.error) as e:
                    row = (None, None, None, *stored, None, str(e))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("n_bytes"), *[pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)]], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(compute, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


def op4_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(with_media(table(spark, sf_dir, "documents")))
