"""Removal of repeated passages with longest-previous-factor arrays, over all documents.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with
a smaller doc_id. Strings are judged on the input; matches never cross documents.

A suffix array of a whole corpus can't be built in one place, so it is built in pieces
that belong together. Each string of ``length`` bytes has an anchor: the least hash of its
``GRAM``-byte grams, which depends on the string alone, so equal strings meet under their
anchor. (1) Documents send the hashes of their anchors; those that stand in two documents
come back to their documents. (2) Only around these, documents send the stretches of text
whose strings have the anchor; copies of a stretch are merged before the shuffle, and long
stretches are cut, so that those of a text with a period are copies. (3) The suffixes of an
anchor's stretches that begin such a string are put in suffix order, with the longest common
prefix of neighbours (both as deep as a string is long, in whole machine words). From each
suffix, the previous and the next one in that order that stand in a smaller document are
found, and the least common prefix on the way: the larger of the two is the longest previous
factor. Where it reaches ``length``, the string has stood before. (4) Documents gather these
ranges. Exact copies of whole texts are set aside first; all but the first are removed whole.

Anchors of more than one in ``SHARE`` documents are common passages. Their stretches aren't brought
together with all places where they stand: copies are merged by an aggregate that starts
where they are, the distinct ones are judged as in (3), and the places learn the result from
a join that deals them over ``SALTS`` tasks. What meets in one task under such an anchor is
distinct stretches only (some 80 bytes each).

Defined results: a null or empty text has nothing to remove; a null doc_id is smaller and
larger than none, so its text stays whole; rows with one doc_id never remove each other's
text; strings repeated within a document stay; of equal texts the one of the smallest doc_id
stays, with all rows of that id; a very long text is a step of its own, of which a task holds
the hashes (some 40 bytes a byte); an empty table gives an empty table; further columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm._text import bounded_parts, cuts_of, mix, slices, strings
from textloom.session import discard, materialise, table

#: Bytes of a string that counts as repeated; bytes of the grams whose least hash is its anchor.
LENGTH, GRAM = 50, 20
#: Bytes of text whose anchors meet in one bucket of the first step.
BUCKET_BYTES = 40 << 20
#: Bytes of stretches that are sorted at a time (those of one anchor at least); strings of a stretch at most.
BLOCK_BYTES, CUT = 1 << 20, 4096
#: Bytes of text per task where stretches meet.
PART_BYTES = 16 << 20
#: An anchor is hot in more than one in so many documents, if these are more than the first number; and in more than the second in any case.
SHARE, HOT = 128, (1000, 1_000_000)
#: Parts that the places of a hot anchor's stretches are dealt over.
SALTS = 16
#: The ids of exact copies are broadcast up to this size, joined by shuffle beyond it.
BROADCAST_BYTES = 64 << 20

U = np.uint64
#: Where a stretch stands; of h (the text's hash, which tells texts of one doc_id apart) the low 32 bits are enough.
OCCURRENCE = np.dtype([("doc_id", "<i8"), ("h", "<i4"), ("start", "<u4")])


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """For each string of ``length`` bytes, the least hash of its grams."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers = {1: data.astype(np.uint64) + U(1)}
    size, base = 1, 0x9E3779B97F4A7C15
    while 2 * size <= gram:
        h = powers[size]
        powers[2 * size] = h[:-size] * U(pow(base, size, 1 << 64)) + h[size:]
        size *= 2
    h, at = powers[size], size
    while at < gram:
        step = max(s for s in powers if s <= gram - at)
        tail = powers[step][at:]
        m = min(len(h), len(tail))
        h = h[:m] * U(pow(base, step, 1 << 64)) + tail[:m]
        at += step
    h = mix(h[: len(data) - gram + 1])
    width, span = length - gram + 1, 1
    while 2 * span <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[:n], h[width - span : width - span + n])


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and each text's bounds."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def previous_smaller(values: np.ndarray, common: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest place before each that has a smaller value, and the least of ``common`` (each place's common prefix with the one before it) from there on. The search ends where that falls below ``length``; -1, 0: none."""
    p, least = np.arange(len(values)) - 1, common.copy()
    live = lambda at: at[(p[at] >= 0) & (least[at] >= length)]
    active = live(np.arange(len(values)))
    active = active[values[p[active]] >= values[active]]
    while len(active):  # what lies between a place and its candidate is no smaller, so the candidate's own candidate is next
        least[active] = np.minimum(least[active], least[p[active]])
        p[active] = p[p[active]]
        active = live(active)
        active = active[values[p[active]] >= values[active]]
    none = (p < 0) | (least < length)
    return np.where(none, -1, p), np.where(none, 0, least)


def ranks(values: np.ndarray) -> np.ndarray:
    """Each value's place among the distinct ones."""
    by = np.argsort(values)
    ordered = values[by]
    out = np.empty(len(by), np.int64)
    out[by] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]])[: len(by)])
    return out


def suffix_order(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at places ``at`` in order of their first bytes (``length``, up to whole words), and each one's common prefix with the one before it, as deep."""
    words = -(-length // 8)
    padded = np.concatenate([data, np.zeros(8 * words + 8, np.uint8)]).astype(np.uint64)
    for width in (1, 2, 4):  # eight bytes from each place on, the first in the highest bits
        padded = padded[:-width] << U(8 * width) | padded[width:]
    rank = ranks(padded[at])
    for w in range(1, words):  # a word more: by the rank so far, then by the word's own
        if len(at) and rank.max() == len(at) - 1:
            break
        rank = ranks(rank * np.int64(len(at) + 1) + ranks(padded[at + 8 * w]))
    order = np.argsort(rank)
    common, open_ = np.zeros(len(at), np.int64), np.arange(1, len(at))
    for w in range(words):
        apart = padded[at[order[open_]] + 8 * w] ^ padded[at[order[open_ - 1]] + 8 * w]
        differ = apart != 0
        common[open_] += np.where(differ, sum((apart < U(1 << 8 * k)).astype(np.int64) for k in range(1, 8)), 8)
        open_ = open_[~differ]
    return order, common


def previous_factors(texts: list[bytes], documents: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each string of ``length`` bytes in each text, in a row: its longest previous factor (0 below ``length``); and where each text's strings begin.

    A factor is previous if it starts in a text of a smaller document.
    """
    sizes = np.array([len(t) for t in texts])
    strings = sizes - length + 1
    marks = np.concatenate([[0], np.cumsum(strings)])
    at = np.arange(marks[-1]) + np.repeat(np.concatenate([[0], np.cumsum(sizes)])[:-1] - marks[:-1], strings)
    order, common = suffix_order(np.frombuffer(b"".join(texts), np.uint8), at, length)
    values = np.repeat(documents, strings)[order]
    _, before = previous_smaller(values, common, length)
    _, after = previous_smaller(values[::-1], np.concatenate([[0], common[:0:-1]]), length)
    factors = np.empty(len(at), np.int64)
    factors[order] = np.maximum(before, after[::-1])
    return factors, marks


def repeated(texts: list[bytes], documents: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end of each range that strings with a previous factor of ``length`` cover."""
    factors, marks = previous_factors(texts, documents, length)
    text = np.repeat(np.arange(len(texts)), np.diff(marks))
    gone = np.concatenate([[False], factors >= length, [False]])
    edge = np.concatenate([[True], text[1:] != text[:-1], [True]]) if len(text) else np.ones(1, bool)
    begin = np.flatnonzero(gone[1:-1] & (edge[:-1] | ~gone[:-2]))
    end = np.flatnonzero(gone[1:-1] & (edge[1:] | ~gone[2:]))
    return text[begin], begin - marks[text[begin]], end - marks[text[begin]] + length


def anchor_rows(docs: DataFrame, buckets: int, length: int) -> DataFrame:
    """Step 1, sending: per slice and bucket, which documents have which anchors."""

    def send(batches):
        for piece, texts in slices(batches):
            data, bounds = buffers(texts)
            found = [np.unique(anchors(data[a:b], length)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            sizes = np.array([len(x) for x in found])
            flat, owner = np.concatenate(found), np.repeat(np.arange(len(found)), sizes)
            bucket = (mix(flat) % U(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            flat, owner, bucket = flat[by], owner[by], bucket[by]
            ids = piece.column("doc_id").to_numpy(zero_copy_only=False)
            rows = ([], [], [], [])
            for k, a, b in cuts_of(bucket):
                own, count = np.unique(owner[a:b], return_counts=True)
                for column, value in zip(rows, (k, ids[own].astype(np.int64).tobytes(), count.astype(np.uint32).tobytes(), flat[a:b].tobytes()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "ids", "counts", "anchors"])

    return docs.select("doc_id", "text").mapInArrow(send, "bucket int, ids binary, counts binary, anchors binary")


def shared_anchors(sent: DataFrame, most: int) -> DataFrame:
    """Step 1, answering: doc_id and those of its anchors that another document has too, and how many of these, the last, are hot: in more than ``most`` documents. Rows of a bucket come together."""

    def answer(batches):
        held, key = [], None

        def done():
            flat = np.concatenate([np.frombuffer(x[2], np.uint64) for x in held])
            ids = np.concatenate([np.repeat(np.frombuffer(x[0], np.int64), np.frombuffer(x[1], np.uint32)) for x in held])
            by = np.argsort(flat, kind="stable")
            flat, ids = flat[by], ids[by]
            starts = np.nonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))[0]
            sizes = np.diff(np.concatenate([starts, [len(flat)]]))
            shared = np.repeat(np.minimum.reduceat(ids, starts) < np.maximum.reduceat(ids, starts), sizes)
            hot = np.repeat(sizes > most, sizes)[shared]
            flat, ids = flat[shared], ids[shared]
            by = np.lexsort((hot, ids))
            flat, ids, hot = flat[by], ids[by], hot[by]
            cuts = np.nonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))[0] if len(ids) else np.zeros(0, np.int64)
            ends = np.concatenate([cuts, [len(ids)]]) * 8
            blob = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
            many = np.add.reduceat(hot, cuts, dtype=np.int64) if len(cuts) else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ids[cuts]), blob, pa.array(many)], names=["doc_id", "shared", "hot"])

        for batch in batches:
            for k, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "ids", "counts", "anchors")), strict=True):
                if held and k != key:
                    yield done()
                    held = []
                key = k
                held.append(row)
        if held:
            yield done()

    return sent.mapInArrow(answer, "doc_id long, shared binary, hot long")


def stretches(docs: DataFrame, length: int) -> DataFrame:
    """Step 2: anchor, part (0; of a hot anchor, a number that spreads its rows), stretch, where it stands, and the least document there. ``docs``: doc_id, h, text, shared (list of (anchors, how many of them, at the end, are hot))."""

    def cut(batches):
        for piece, texts in slices(batches):
            data, bounds = buffers(texts)
            ids, hs, shared = piece.column("doc_id").to_pylist(), piece.column("h").to_pylist(), piece.column("shared").to_pylist()
            parts = []
            for i, blobs in enumerate(shared):
                blobs = [(np.frombuffer(x["shared"], np.uint64), x["hot"]) for x in blobs]
                found, known = anchors(data[bounds[i] : bounds[i + 1]], length), np.unique(np.concatenate([x for x, _ in blobs]))
                if not len(found) or not len(known):
                    continue
                common = np.isin(known, np.concatenate([x[len(x) - n :] for x, n in blobs]))
                change = np.nonzero(np.concatenate([[True], found[1:] != found[:-1]]))[0]
                value = found[change]
                at = np.searchsorted(known, value)
                at[at == len(known)] = 0
                hit = known[at] == value
                stop = np.concatenate([change[1:], [len(found)]])
                parts.append((value[hit], change[hit], stop[hit], np.full(int(hit.sum()), i), common[at][hit]))
            if not parts:
                continue
            value, start, stop, owner, common = (np.concatenate(x) for x in zip(*parts, strict=True))
            pieces = -(-(stop - start) // CUT)
            piece_of = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            value, start, stop, owner, common = (np.repeat(x, pieces) for x in (value, start, stop, owner, common))
            start = start + piece_of * CUT
            stop = np.minimum(stop, start + CUT)
            sizes = stop - start + length - 1
            ends = np.concatenate([[0], np.cumsum(sizes)])
            gather = np.arange(ends[-1]) + np.repeat(start + bounds[owner] - ends[:-1], sizes)
            text = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data[gather].tobytes())]).dictionary_encode()
            code = text.indices.to_numpy()
            by = np.argsort(code, kind="stable")
            where = np.zeros(len(by), OCCURRENCE)
            where["doc_id"], where["h"], where["start"] = np.array(ids, np.int64)[owner[by]], np.array(hs, np.int32)[owner[by]], start[by]
            cuts = np.searchsorted(code[by], np.arange(len(text.dictionary) + 1))
            spots = pa.Array.from_buffers(pa.binary(), len(text.dictionary), [None, pa.py_buffer((cuts * OCCURRENCE.itemsize).astype(np.int32).tobytes()), pa.py_buffer(where.tobytes())])
            first, least = cuts[:-1], np.minimum.reduceat(where["doc_id"], cuts[:-1])
            spread = np.where(common[by][first], 1 + (mix(where["h"][first].astype(np.uint64)) % U(SALTS)).astype(np.int32), 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(value[by][first].view(np.int64)), pa.array(spread), text.dictionary.cast(pa.binary()), spots, pa.array(least)], names=["anchor", "part", "stretch", "spots", "least"])

    return docs.select("doc_id", "h", "text", "shared").mapInArrow(cut, "anchor long, part int, stretch binary, spots binary, least long")


def placed(texts: list[bytes], spots: list[bytes], least: np.ndarray, text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """doc_id, h, a, b at all places of stretches: in documents after the first that has one, all of it; in the first, the ranges (``text``, ``begin``, ``end``) that stood before."""
    every = np.frombuffer(b"".join(spots), OCCURRENCE)
    of = np.repeat(np.arange(len(texts)), np.array([len(x) for x in spots]) // OCCURRENCE.itemsize)
    own = every["doc_id"] == least[of]
    rest, first, which = every[~own], every[own], of[own]
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    many = np.diff(bounds)[which]
    at = np.arange(many.sum()) + np.repeat(bounds[which] - np.cumsum(many) + many, many)
    again, start = np.repeat(first, many), rest["start"].astype(np.int64)
    base, sizes = again["start"].astype(np.int64), np.array([len(x) for x in texts], np.int64)
    return [np.concatenate(c) for c in ((rest["doc_id"], again["doc_id"]), (rest["h"], again["h"]), (start, base + begin[at]), (start + sizes[of[~own]], base + end[at]))]


def grouped(batches, key: str, names: list[str], block_bytes: int):
    """Rows (as lists by column) of whole groups, which come together, in blocks of about ``block_bytes`` of their second column."""
    held, size, now = [], 0, None
    for batch in batches:
        for k, *row in zip(*(strings(batch.column(c)) for c in (key, *names)), strict=True):
            if size >= block_bytes and k != now:
                yield [list(c) for c in zip(*held, strict=True)]
                held, size = [], 0
            now = k
            held.append((k, *row))
            size += len(row[0])
    if held:
        yield [list(c) for c in zip(*held, strict=True)]


def earlier_ranges(cut: DataFrame, length: int) -> DataFrame:
    """Step 3: doc_id, h and byte ranges that an earlier document has too. Rows of an anchor come together; those of hot anchors go through as they are."""
    names, kinds = ["doc_id", "h", "a", "b", "anchor", "stretch", "spots", "least"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]

    def judge(batches):
        def cold():
            for batch in batches:
                hot = np.flatnonzero(batch.column("part").to_numpy() > 0)
                if len(hot):
                    waiting.append(batch.take(pa.array(hot)))
                yield batch.filter(pa.array(batch.column("part").to_numpy() == 0))

        waiting: list = []
        for _, texts, spots, least in grouped(cold(), "anchor", ["stretch", "spots", "least"], BLOCK_BYTES):
            first = np.array(least, np.int64)
            columns = placed(texts, spots, first, *repeated(texts, first, length))
            yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(columns, kinds[:4], strict=True)), *(pa.nulls(len(columns[0]), t) for t in kinds[4:])], names=names)
            while waiting:
                yield passed(waiting.pop())
        for batch in waiting:
            yield passed(batch)

    def passed(batch):
        return pa.RecordBatch.from_arrays([*(pa.nulls(batch.num_rows, t) for t in kinds[:4]), *(batch.column(c) for c in names[4:])], names=names)

    return cut.mapInArrow(judge, "doc_id long, h int, a long, b long, anchor long, stretch binary, spots binary, least long")


def hot_ranges(waiting: DataFrame, length: int, parts: int) -> DataFrame:
    """Step 3 for hot anchors: doc_id, h, a, b. ``waiting``: anchor, stretch, spots, least."""

    def judge(batches):
        for anchors_, texts, least in grouped(batches, "anchor", ["stretch", "least"], BLOCK_BYTES):
            text, begin, end = repeated(texts, np.array(least, np.int64), length)
            bounds = np.searchsorted(text, np.arange(len(texts) + 1))
            lists = lambda x: pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(x.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(anchors_, pa.int64()), pa.array(texts, pa.binary()), pa.array(least, pa.int64()), lists(begin), lists(end)], names=["anchor", "stretch", "first", "begin", "end"])

    def tell(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ranges = batch.column("begin"), batch.column("end")
            text = np.repeat(np.arange(batch.num_rows), np.diff(ranges[0].offsets.to_numpy()))
            begin, end = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in ranges)
            columns = placed(strings(batch.column("stretch")), strings(batch.column("spots")), batch.column("first").to_numpy(), text, begin, end)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(t), k) for c, t, k in zip(columns, (np.int64, np.int32, np.int64, np.int64), (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "h", "a", "b"])

    distinct = waiting.groupBy("anchor", "stretch").agg(F.min("least").alias("least"))
    judged = distinct.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(judge, "anchor long, stretch binary, first long, begin array<long>, end array<long>")
    told = judged.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return waiting.withColumn("salt", F.pmod(F.xxhash64("spots"), F.lit(SALTS)).cast("int")).join(told, ["anchor", "stretch", "salt"]).select("stretch", "spots", "first", "begin", "end").mapInArrow(tell, "doc_id long, h int, a long, b long")


def without(docs: DataFrame) -> DataFrame:
    """Step 4: n_removed, spans (merged) and the kept bytes. ``docs``: doc_id, h, text, a, b (ranges)."""

    def remove(batches):
        for piece, texts in slices(batches):
            removed, spans, kept = [], [], []
            for text, a, b in zip(texts.cast(pa.large_binary()).to_pylist(), piece.column("a").to_pylist(), piece.column("b").to_pylist(), strict=True):
                at, gone, merged, parts = 0, 0, [], []
                for x, y in sorted(zip(a or [], b or [], strict=True)):
                    if x > at or not merged:
                        parts.append(text[at:x])
                        merged.append({"start": x, "end": y})
                        gone, at = gone + y - x, y
                    elif y > at:
                        merged[-1]["end"] = y
                        gone, at = gone + y - at, y
                parts.append(text[at:])
                removed.append(gone), spans.append(merged), kept.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("h"), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=["doc_id", "h", "n_removed", "spans", "kept"])

    return docs.select("doc_id", "h", "text", "a", "b").mapInArrow(remove, "doc_id long, h int, n_removed long, spans array<struct<start: long, end: long>>, kept binary")


def repeats(docs: DataFrame, length: int = LENGTH, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """own (doc_id, text, h), facts (doc_id, h, n_bytes, sha, copy: of an earlier whole text) and ranges (doc_id, h, a, b: arrays) of the documents."""
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.expr("cast(xxhash64(text) & 2147483647 as int)"))
    plain = materialise(own.select("doc_id", "h", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "facts")
    first = plain.filter("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("sha", "first")
    first = materialise(first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "firsts")  # copies of one text are dealt over as many tasks
    salted = plain.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    facts = materialise(salted.join(first, ["sha", "salt"], "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).drop("first", "salt"), "facts")
    discard(plain), discard(first)
    copies = facts.filter("copy").select("doc_id", "h").distinct()
    sums = facts.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count_if("copy"), F.count("*")).first()
    texts = own.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length)).join(F.broadcast(copies) if sums[1] * 32 <= broadcast_bytes else copies, ["doc_id", "h"], "left_anti")
    buckets, parts = (max(8, -(-sums[0] // size)) for size in (BUCKET_BYTES, PART_BYTES))
    sent = anchor_rows(texts, buckets, length).repartition(bounded_parts(buckets), "bucket").sortWithinPartitions("bucket")
    replies = shared_anchors(sent, min(HOT[1], max(HOT[0], sums[2] // SHARE))).groupBy("doc_id").agg(F.collect_list(F.struct("shared", "hot")).alias("shared"))
    cut = stretches(texts.join(replies, "doc_id"), length).repartition(bounded_parts(parts), "anchor", "part").sortWithinPartitions("anchor")
    found = materialise(earlier_ranges(cut, length), "found")
    every = found.filter("stretch is null").select("doc_id", "h", "a", "b")
    waiting = found.filter("stretch is not null").select("anchor", "stretch", "spots", "least")
    if waiting.head(1):
        every = every.unionByName(hot_ranges(waiting, length, bounded_parts(parts)))
    return texts, facts, materialise(every.groupBy("doc_id", "h").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b")), "ranges")


def remove_repeats(docs: DataFrame, length: int = LENGTH, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, spans (start and end of each maximal removed run, in bytes), kept (the remaining bytes)."""
    _, facts, ranges = repeats(docs, length, broadcast_bytes)
    whole = facts.filter(F.col("copy") & (F.col("n_bytes") >= length)).select("doc_id", "h", F.array(F.lit(0).cast("long")).alias("a"), F.array("n_bytes").alias("b")).dropDuplicates(["doc_id", "h"])
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.expr("cast(xxhash64(text) & 2147483647 as int)"))
    joined = own.join(ranges.join(whole.select("doc_id", "h"), ["doc_id", "h"], "left_anti").unionByName(whole), ["doc_id", "h"], "left")
    return without(joined).select("doc_id", (F.col("n_removed") + F.length("kept")).alias("n_bytes"), "n_removed", "spans", "kept")


def digests(docs: DataFrame, length: int = LENGTH, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``remove_repeats`` as doc_id, n_bytes, n_removed, n_spans, kept_sha256; texts that lose nothing, or all, aren't moved for it."""
    texts, facts, ranges = repeats(docs, length, broadcast_bytes)
    touched = without(texts.join(ranges, ["doc_id", "h"])).select("doc_id", "h", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    touched = materialise(touched, "touched").dropDuplicates(["doc_id", "h"])
    whole = F.col("copy") & (F.col("n_bytes") >= length)
    out = facts.join(touched, ["doc_id", "h"], "left")
    pick = lambda full, name, none: F.when(whole, full).otherwise(F.coalesce(name, none)).alias(name)
    return out.select(
        "doc_id", "n_bytes", pick(F.col("n_bytes"), "n_removed", F.lit(0).cast("long")), pick(F.lit(1).cast("long"), "n_spans", F.lit(0).cast("long")),
        pick(F.lit(hashlib.sha256(b"").hexdigest()), "kept_sha256", F.col("sha")),
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
