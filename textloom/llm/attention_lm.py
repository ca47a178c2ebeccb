"""LM scoring with a causal self-attention model over subword ids, in numpy.

Tokens are the words of a text and one end; a word is the byte-level BPE ids of a space and
its letters, so its first id tells that a word begins. The model predicts these ids one after
another, each from causal self-attention over the ids before it, and then the text's end: a
word's probability is the product over its ids, a text's over its words and its end.

The prediction is a softmax in two levels. An id's *unit* is itself for the ``UNITS`` most
frequent ids; the rarer ones share two units, those that begin a word and the others, in which
they have their shares of the corpus. Units are dealt into ``CLASSES`` classes by what they
follow. Then
p(id | before) = p(class | attention, previous unit) p(unit | class, previous unit) p(id | unit):
the attention layer gives logits of the classes that are added to those of the previous unit
alone, and the unit within its class comes from counts of pairs of units. After a word's first
id the rest of the word, its ending included, is a mixture of the model's product over ids and
of the corpus' count of the word among words that begin so (Witten-Bell: the more of these
words are different, the less their counts weigh).

Scoring cuts a text into windows of ``STRIDE`` ids that see ``STRIDE`` more before them:
windows overlap, each id is scored once, in the window where it has most context, and
windows are scored many at a time under one mask.

All that is learnt covers every training document whole. Counts of words go by hash to
buckets, which sum them and answer each slice, so no table of words is held in one place;
counts of ids and of pairs of units are tables of a fixed size, summed on the executors.
Attention trains in ``ROUNDS`` rounds: in each, every task trains a copy of the model on all
windows of its slices' documents of that round, and the copies are averaged, level by level,
by the ids they saw. Each training document is trained on in one round.

Defined results: a null or empty text is its end alone; a null doc_id is scored, not held
out, and teaches; documents held out are scored but teach nothing; with no training document
every count is 0 and the score is the base's; repeated rows count each; a very long text is a
slice of its own, of which one task holds the ids (some 20 bytes a word; windows are made a
few hundred at a time); an empty table gives an empty table; further columns, whatever their
names, are not read.
"""

from __future__ import annotations

import base64
import pickle
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm._text import bounded_parts, cuts_of, joined, mix, release, slices, strings, words
from textloom.session import materialise, table

#: Ids scored per window, and ids before them that the window sees.
STRIDE = 16
#: Width of embeddings; most frequent ids that are units of their own; classes of units (the last is the text's end).
WIDTH, UNITS, CLASSES = 16, 2048, 64
#: Rounds of local training, windows in a row that are trained together, such runs of a step, learning rate.
ROUNDS, RUN, BATCH, RATE = 2, 8, 48, 0.01
#: Runs of a step whose arrays are in the processor's cache at a time, of which the step's gradient is the sum.
TOGETHER = 16
#: Windows scored at a time.
SCORED = 512
#: Weight of the unigram in a pair's probability.
SMOOTH = 4.0
#: Blocks that the table of pairs is summed in; tables or copies of the model that one task sums.
BLOCKS, FAN = 64, 64
#: Bytes of text of a slice.
SLICE_BYTES = 2 << 20
#: Folds, and the one that is held out.
FOLDS, HELD = 7, 2
#: Bytes of text whose words meet in one bucket, and of text that one task scores.
BUCKET_BYTES, PART_BYTES = 20 << 20, 16 << 20
#: Bytes of a row that holds part of a slice: rows of megabytes cost the JVM far more memory than their size.
ROW_BYTES = 192 << 10

#: Bound of attention scores before the exponential.
LARGEST = np.float32(30)
#: Units of all rarer ids that begin a word, of the other rarer ones, and of a text's edge: its beginning as context, its end as what is predicted.
RARE, RARE_NEXT, EDGE, SIZE = UNITS, UNITS + 1, UNITS + 2, UNITS + 3
IDS = 1 << 16
U = np.uint64
#: Spaces that the tokenizer's pattern may join with a neighbour's; words with one are encoded alone.
SPACES = r"[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD


class Subwords:
    """Byte-level BPE ids of words, each with a space before it."""

    def __init__(self, path: str | None):
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.begins = np.zeros(IDS, bool)
        self.begins[[i for b, i in ranks.items() if b.startswith(b" ")]] = True

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), np.uint16)

    def ids(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has. Words are encoded in one text, as none reaches over a space."""
        if pc.any(pc.match_substring_regex(distinct, SPACES)).as_py():
            found = [self.encode(" " + w) for w in strings(distinct)]
            return np.concatenate(found), np.array([len(x) for x in found], np.int64)
        flat = self.encode(" " + joined(distinct, " "))
        return flat, np.diff(np.append(np.flatnonzero(self.begins[flat]), len(flat)))


_subwords: dict = {}


def subwords(path: str | None = None) -> Subwords:
    """One per Python worker."""
    if path not in _subwords:
        _subwords[path] = Subwords(path)
    return _subwords[path]


def unpack(payload: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(payload))


class Slice:
    """Documents of a slice: their ids, which are held out, the bounds of their words, these words' codes, and of each distinct word, in order of hash: ids (in a row), how many, and how often it stands in training documents."""

    def __init__(self, doc_ids: list, held: np.ndarray, texts: pa.Array, path: str | None = None):
        distinct, codes, bounds = words(texts)
        ids, sizes = subwords(path).ids(distinct) if len(distinct) else (np.zeros(0, np.uint16), np.zeros(0, np.int64))
        by = np.argsort(word_hashes(ids, sizes), kind="stable")
        rank = np.empty(len(by), np.uint32)
        rank[by] = np.arange(len(by), dtype=np.uint32)
        self.doc_ids, self.held, self.bounds, self.codes = doc_ids, held, bounds, rank[codes]
        self.ids, self.sizes = ids[runs(np.cumsum(sizes) - sizes, sizes, by)], sizes[by].astype(np.int32)
        self.times = np.bincount(self.codes[np.repeat(~held, np.diff(bounds))], minlength=len(by)).astype(np.uint32)

    @property
    def hashes(self) -> np.ndarray:
        return word_hashes(self.ids, self.sizes)

    @property
    def words(self) -> tuple:
        return self.bounds, self.codes, self.ids, self.sizes


def slice_rows(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Slices of documents (doc_id, text, held) as rows of bounded size: slice, part (-n .. -1), blob, and in the last part ends: the number of training documents."""

    def pack(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for piece, texts in slices(batches, limit=SLICE_BYTES):
            held = piece.column("held").to_numpy(zero_copy_only=False).astype(bool)
            blob = packed(Slice(piece.column("doc_id").to_pylist(), held, texts, path))
            parts = [blob[a : a + ROW_BYTES] for a in range(0, len(blob), ROW_BYTES)]
            n = len(parts)
            yield pa.RecordBatch.from_arrays([pa.array([number] * n, pa.int64()), pa.array(range(-n, 0), pa.int64()), pa.array(parts, pa.binary()), pa.array([0] * (n - 1) + [int((~held).sum())], pa.int64())], names=["slice", "part", "blob", "ends"])
            number += 1

    return docs.mapInArrow(pack, "slice long, part long, blob binary, ends long")


def whole(batches):
    """(number, slice, answers) of rows (slice, part, blob) in order: parts from 0 on are answers, which follow their slice."""
    number, made, parts, answers = None, None, [], []
    for batch in batches:
        for i in range(batch.num_rows):
            own, part = batch.column("slice")[i].as_py(), batch.column("part")[i].as_py()
            if made is not None and own != number:
                yield number, made, answers
                made, answers = None, []
            if part < 0:
                parts.append(batch.column("blob")[i].as_py())
                if part == -1:
                    number, made, parts = own, unpack(b"".join(parts)), []
            else:
                answers.append(batch.column("blob")[i].as_py())
    if made is not None:
        yield number, made, answers


def runs(starts: np.ndarray, sizes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The places of runs ``of`` (which start at ``starts`` and have ``sizes``), one run after another."""
    size = sizes[of]
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[of] - ends + size, size)


def word_hashes(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's ids, which are the word."""
    starts, h = np.cumsum(sizes) - sizes, np.zeros(len(sizes), np.uint64)
    active = np.arange(len(sizes))
    for place in range(int(sizes.max(initial=0))):
        active = active[sizes[active] > place]
        h[active] = mix(h[active] * U(0x9E3779B97F4A7C15) + ids[starts[active] + place] + U(1))
    return mix(h + sizes.astype(np.uint64))


def word_counts(sliced: DataFrame, buckets: int) -> DataFrame:
    """Per slice and bucket, the corpus counts of the slice's words in order of hash; per bucket (slice -1), its training tokens, the distinct words among them, and how many of these begin with each id."""

    def send(batches):
        for number, own, _ in whole(batches):
            h, first = own.hashes, first_ids(own.ids, own.sizes)
            bucket = ((h >> U(32)) * U(buckets) >> U(32)).astype(np.int64)  # rises with the hash, so a bucket is a range of sorted hashes
            part = [(k, number, h[a:b].tobytes(), own.times[a:b].tobytes(), first[a:b].tobytes()) for k, a, b in cuts_of(bucket)]
            if part:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*part, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "slice", "hashes", "times", "firsts"])

    def add(batches):
        held, key = [], None
        squeeze = zstandard.ZstdCompressor(level=1)

        def done():
            h = np.concatenate([np.frombuffer(x[1], np.uint64) for x in held])
            times = np.concatenate([np.frombuffer(x[2], np.uint32) for x in held])
            distinct, at, inverse = np.unique(h, return_index=True, return_inverse=True)
            total = np.bincount(inverse, times, len(distinct)).astype(np.uint64)
            ends = np.cumsum([len(x[1]) // 8 for x in held])[:-1]
            answers = [squeeze.compress(c.tobytes()) for c in np.split(total[inverse], ends)]
            n, first = len(held), np.concatenate([np.frombuffer(x[3], np.uint16) for x in held])[at]
            answers.append(packed(np.bincount(first[total > 0], minlength=IDS)))
            return pa.RecordBatch.from_arrays([pa.array([*(x[0] for x in held), -1], pa.int64()), pa.array([key] * (n + 1), pa.int64()), pa.array(answers, pa.binary()), *(pa.array([*([0] * n), int(x)], pa.int64()) for x in (np.count_nonzero(total), total.sum()))], names=["slice", "bucket", "counts", "types", "tokens"])

        for batch in batches:
            for k, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "slice", "hashes", "times", "firsts")), strict=True):
                if held and k != key:
                    yield done()
                    held = []
                key = k
                held.append(row)
        if held:
            yield done()

    sent = sliced.select("slice", "part", "blob").mapInArrow(send, "bucket long, slice long, hashes binary, times binary, firsts binary")
    return sent.repartition(bounded_parts(buckets), "bucket").sortWithinPartitions("bucket").mapInArrow(add, "slice long, bucket long, counts binary, types long, tokens long")


def first_ids(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first id of each word."""
    return ids[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[:-1]]


def packed(x) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(x, protocol=5))


def summed(rows: DataFrame, many: bool = False) -> np.ndarray | None:
    """The sum of arrays of one shape (``cells``: packed; a row per task, or ``many``), by levels of ``FAN`` until so many tasks are left; None without any."""

    def add(batches):
        total = None
        for batch in batches:
            for cells in batch.column("cells").to_pylist():
                total = unpack(cells) if total is None else total + unpack(cells)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([packed(total)], pa.binary())], names=["cells"])

    tasks, rows = rows.rdd.getNumPartitions(), rows.mapInArrow(add, "cells binary") if many else rows
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        rows = rows.repartition(tasks).mapInArrow(add, "cells binary")
    got = [unpack(r["cells"]) for r in rows.collect()]  # FAN rows at most
    return np.sum(got, axis=0) if got else None


def summed_in_blocks(rows: DataFrame) -> np.ndarray:
    """The sum of tables that tasks send in blocks (block, cells): block k has every ``BLOCKS``-th cell from k on, so that frequent pairs are dealt over all."""

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, cells in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                held[k] = held.get(k, 0) + unpack(cells)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([packed(x) for x in held.values()], pa.binary())], names=["block", "cells"])

    got = rows.repartition(BLOCKS, "block").mapInArrow(add, "block int, cells binary").collect()  # a table of fixed size
    found = {r["block"]: unpack(r["cells"]) for r in got}
    out = np.zeros(sum(map(len, found.values())), np.int64)
    for k, cells in found.items():
        out[k::BLOCKS] = cells
    return out


def id_counts(sliced: DataFrame) -> np.ndarray:
    """How often each id stands in training documents."""

    def count(batches):
        out = np.zeros(IDS, np.int64)
        for _, own, _ in whole(batches):
            out += np.bincount(own.ids, np.repeat(own.times, own.sizes), IDS).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([packed(out)], pa.binary())], names=["cells"])

    out = summed(sliced.select("slice", "part", "blob").mapInArrow(count, "cells binary"))
    return np.zeros(IDS, np.int64) if out is None else out


def pair_counts(sliced: DataFrame, unit: np.ndarray) -> np.ndarray:
    """How often one unit follows another in training documents, a text's edge included."""

    def count(batches):
        out = np.zeros(SIZE * SIZE, np.int64)
        for _, own, _ in whole(batches):
            x, weight, _ = stream(*own.words, unit, np.flatnonzero(~own.held))
            after = np.append(x[1:], np.int16(EDGE))
            np.add.at(out, (x.astype(np.int64) * SIZE + after)[weight], 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([packed(out[k::BLOCKS]) for k in range(BLOCKS)], pa.binary())], names=["block", "cells"])

    out = summed_in_blocks(sliced.select("slice", "part", "blob").mapInArrow(count, "block int, cells binary"))
    return (out if len(out) else np.zeros(SIZE * SIZE, np.int64)).reshape(SIZE, SIZE)


def stream(bounds: np.ndarray, codes: np.ndarray, ids: np.ndarray, sizes: np.ndarray, unit: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of the chosen texts, in windows: what stands where, which places predict the next one, and each text's first place.

    A text has one window of edges (context only), then its edge and its units, up to a whole
    number of windows. The place after its last unit holds an edge, which is its end.
    """
    n = np.diff(bounds)[chosen]
    mine = codes if len(chosen) == len(bounds) - 1 else codes[np.repeat(np.isin(np.arange(len(bounds) - 1), chosen), np.diff(bounds))]
    sizes = sizes.astype(np.int32)
    flat = unit[ids][runs(np.cumsum(sizes, dtype=np.int32) - sizes, sizes, mine)]
    many = np.diff(np.concatenate([[0], np.cumsum(sizes[mine], dtype=np.int64)])[np.concatenate([[0], np.cumsum(n)])])
    windows = 1 + -(-(many + 1) // STRIDE)
    first = (np.concatenate([[0], np.cumsum(windows)])[:-1] + 1) * STRIDE
    x = np.full(int(windows.sum()) * STRIDE, EDGE, np.int16)
    before = np.concatenate([[0], np.cumsum(many)])[:-1]
    x[np.arange(len(flat)) + np.repeat(first + 1 - before, many)] = flat
    weight = np.zeros(len(x), np.int8)
    np.add.at(weight, first, 1)
    closing = first + many + 1
    np.add.at(weight, closing[closing < len(x)], -1)
    return x, np.cumsum(weight, dtype=np.int8).astype(bool), first


class Vocabulary:
    """Units of ids, classes of units, and the probabilities that come from counts alone."""

    def __init__(self, ids: np.ndarray, types: np.ndarray | None = None, path: str | None = None):
        """``ids``: how often each id stands in training documents; ``types``: how many of their distinct words begin with it."""
        begins = subwords(path).begins
        top = np.argsort(-ids, kind="stable")[:UNITS]
        top = top[ids[top] > 0]
        self.unit = np.where(begins, RARE, RARE_NEXT).astype(np.int16)
        self.unit[top] = np.arange(len(top))
        self.within = np.zeros(IDS)
        for rare in (RARE, RARE_NEXT):
            own = self.unit == rare
            self.within[own] = np.log((ids[own] + 1) / (ids[own].sum() + own.sum()))
        self.begins = np.zeros(SIZE, bool)  # what begins a word, or ends a text: the word before it is at its end
        self.begins[[RARE, EDGE]] = True
        self.begins[: len(top)] = begins[top]
        self.times, self.types = ids, np.zeros(IDS, np.int64) if types is None else types

    def fit(self, pairs: np.ndarray) -> Vocabulary:
        pairs = pairs.astype(np.float64)
        unigram = (pairs.sum(axis=0) + 0.5) / (pairs.sum() + 0.5 * SIZE)
        p = (pairs + SMOOTH * unigram) / (pairs.sum(axis=1, keepdims=True) + SMOOTH)
        self.left, right = self.factors(pairs)
        self.kind, self.ended = self.classes(right, pairs.sum(axis=0))
        of_class = np.stack([np.bincount(self.kind, row, CLASSES) for row in p])
        self.class_log = np.log(of_class + 1e-30).astype(np.float32)
        self.unit_log = np.log(p / of_class[:, self.kind]).astype(np.float32)
        return self

    @staticmethod
    def factors(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Correspondence analysis of the pairs: coordinates of units by what follows them, and by what they follow."""
        row, column = np.sqrt(pairs.sum(axis=1) + 0.5), np.sqrt(pairs.sum(axis=0) + 0.5)
        m = pairs / row[:, None] / column[None, :]
        q = np.random.default_rng(7).normal(size=(SIZE, WIDTH + 5))
        for _ in range(8):
            q = np.linalg.qr(m.T @ (m @ q))[0]
        u, s, v = np.linalg.svd(m @ q, full_matrices=False)
        pick = slice(1, WIDTH + 1)  # the first only tells how frequent a unit is
        return (u * s)[:, pick] / row[:, None] * row.sum() / SIZE, (q @ v.T * s)[:, pick] / column[:, None] * column.sum() / SIZE

    def classes(self, points: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, int]:
        """Each unit's class, by halving the class that is most frequent, and the first of the classes whose units begin a word. The edge is the last class."""
        weight, kind = times + 0.01, np.where(self.begins, 1, 0)
        kind[EDGE] = -1

        def mass(k):
            at = np.flatnonzero(kind == k)
            return weight[at].sum() if len(at) > 1 else 0.0

        found = [mass(0), mass(1)]
        while len(found) < CLASSES - 1 and max(found) > 0:
            k = int(np.argmax(found))
            at = np.flatnonzero(kind == k)
            kind[at[self.halves(points[at], weight[at])]] = len(found)
            found[k] = mass(k)
            found.append(mass(len(found)))
        of_first = np.zeros(CLASSES, bool)
        of_first[kind[:EDGE][self.begins[:EDGE]]] = True
        order = np.argsort(of_first[: CLASSES - 1], kind="stable")
        place = np.empty(CLASSES - 1, np.int64)
        place[order] = np.arange(CLASSES - 1)
        return np.append(place[kind[:EDGE]], CLASSES - 1), int((~of_first[: CLASSES - 1]).sum())

    @staticmethod
    def halves(x: np.ndarray, weight: np.ndarray, rounds: int = 10) -> np.ndarray:
        """Which points are in the one of two means' halves; they begin on both sides of the first principal axis."""
        away = x - np.average(x, axis=0, weights=weight)
        one = away @ np.linalg.svd(away * np.sqrt(weight)[:, None], full_matrices=False)[2][0] > 0
        for _ in range(rounds):
            if one.all() or not one.any():
                return np.arange(len(x)) == int(weight.argmax())
            a, b = (np.average(x[side], axis=0, weights=weight[side]) for side in (one, ~one))
            one = ((x - a) ** 2).sum(axis=1) < ((x - b) ** 2).sum(axis=1)
        return np.arange(len(x)) == int(weight.argmax()) if one.all() or not one.any() else one


class Attention:
    """The model's parameters, its forward pass over windows, and its gradient."""

    NAMES = ("emb", "q", "k", "v", "near", "out")

    def __init__(self, vocabulary: Vocabulary, seed: int = 3):
        rng = np.random.default_rng(seed)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.p = {
            "emb": small(SIZE, WIDTH) + np.clip(vocabulary.left, -2, 2).astype(np.float32) / 2, "q": small(WIDTH, WIDTH), "k": small(WIDTH, WIDTH),
            "v": np.eye(WIDTH, dtype=np.float32), "near": np.zeros(2 * STRIDE, np.float32), "out": small(WIDTH, CLASSES),
        }
        a, b = np.arange(STRIDE)[:, None] + STRIDE, np.arange(2 * STRIDE)[None, :]
        self.back, self.causal = (a - b).clip(0), (b <= a).astype(np.float32)

    def tables(self, emb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of embeddings: queries, what windows take (embeddings next to a one, which sums the weights), and what a mean of embeddings adds to the logits.

        Queries and keys only meet in a product, and values only in their mean, so keys and
        values are the embeddings as they are, and their matrices stand in the others'.
        """
        form, into = self.forms()
        return emb @ form, np.concatenate([emb, np.ones((len(emb), 1), np.float32)], axis=1), into

    def forms(self) -> tuple[np.ndarray, np.ndarray]:
        return self.p["q"] @ self.p["k"].T * np.float32(WIDTH**-0.5), self.p["v"] @ self.p["out"]

    def bounds(self, queries: np.ndarray, keys: np.ndarray, into: np.ndarray) -> tuple[bool, bool]:
        """Whether scores, and logits, may be too large. A state is a mean, so no logit is larger than the largest that an embedding would give."""
        emb = keys[:, :WIDTH]
        return bool(np.sqrt((queries**2).sum(axis=1).max() * (emb**2).sum(axis=1).max()) > LARGEST), bool((emb @ into).max() > 2 * LARGEST)

    def weigh(self, q: np.ndarray, kv: np.ndarray, large: bool, out: np.ndarray | None = None) -> np.ndarray:
        s = np.matmul(q, kv[..., :WIDTH].transpose(0, 1, 3, 2), out=out)
        if large:
            np.minimum(s, LARGEST, out=s)
        np.exp(s, out=s)
        s *= np.exp(self.p["near"])[self.back] * self.causal
        return s

    def log_probability(self, queries, keys, into, x: np.ndarray, target: np.ndarray, class_log: np.ndarray, ended: int = 0, large: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Natural logs of the target classes' probabilities, and of all classes from ``ended`` on together: a number per place of the runs' windows. x: (runs, places), the first window of a run being context only. ``large``: the tables' ``bounds``, if known."""
        here = x[:, STRIDE:]
        large = large or self.bounds(queries, keys, into)
        kv = windows(np.take(keys, x, axis=0))
        state = self.weigh(np.take(queries, here, axis=0).reshape(*kv.shape[:2], STRIDE, WIDTH), kv, large[0]) @ kv
        logits = classed((state[..., :WIDTH] / state[..., WIDTH:]).reshape(-1, WIDTH) @ into, class_log, here, large[1])
        picked = np.take(logits, np.arange(0, logits.size, CLASSES) + target)
        np.exp(logits, out=logits)
        sums = np.log(logits @ np.stack([np.ones(CLASSES), np.arange(CLASSES) >= ended], axis=1).astype(np.float32))
        return picked - sums[:, 0], sums[:, 1] - sums[:, 0]

    def gradient(self, emb: np.ndarray, x: np.ndarray, target: np.ndarray, weight: np.ndarray, class_log: np.ndarray):
        """Gradient of the mean loss by parameter. x: places' rows of ``emb`` and of ``class_log``; that by emb is of these rows.

        What is summed first, over ``TOGETHER`` runs at a time, is the gradient by the ``forms``, by
        the scores of each distance, and by each place's embedding.
        """
        p, (form, _), tables, (runs, places) = self.p, self.forms(), self.tables(emb), x.shape
        large, target, weight = self.bounds(*tables), target.reshape(runs, -1), (weight / max(1, np.count_nonzero(weight))).astype(np.float32).reshape(runs, -1)
        by_place = np.zeros((runs, places // STRIDE, STRIDE, WIDTH), np.float32)
        by_form, by_into, by_score = np.zeros((WIDTH, WIDTH), np.float32), np.zeros((WIDTH, CLASSES), np.float32), np.zeros((STRIDE, 2 * STRIDE), np.float32)
        for a in range(0, runs, TOGETHER):
            part = slice(a, a + TOGETHER)
            found = self.gradients(tables, form, large, x[part], target[part].ravel(), weight[part].reshape(-1, 1), class_log, by_place[part])
            for total, more in zip((by_form, by_into, by_score), found, strict=True):
                total += more
        by_form *= np.float32(WIDTH**-0.5)
        return {
            "emb": added(len(emb), x.ravel(), by_place), "q": by_form @ p["k"], "k": by_form.T @ p["q"], "v": by_into @ p["out"].T, "out": p["v"].T @ by_into,
            "near": np.bincount(self.back.ravel(), (by_score * self.causal).ravel(), 2 * STRIDE).astype(np.float32),
        }

    def gradients(self, tables: tuple, form: np.ndarray, large: tuple, x: np.ndarray, target: np.ndarray, weight: np.ndarray, class_log: np.ndarray, by_place: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of some runs: by what embeddings meet in, by what their means are multiplied with, and by scores; that by places is put into ``by_place``."""
        queries, keys, into = tables
        at = np.take(keys, x, axis=0)
        kv = windows(at)
        # weights, below them the gradients by their logarithms; and what these bring to the keys: gradients by means, below them queries
        both, brought = np.empty((*kv.shape[:2], 2 * STRIDE, 2 * STRIDE), np.float32), np.empty((*kv.shape[:2], 2 * STRIDE, WIDTH + 1), np.float32)
        ds, dh, q = both[:, :, STRIDE:], brought[:, :, :STRIDE], brought[:, :, STRIDE:, :WIDTH]
        q[...] = np.take(queries, x[:, STRIDE:], axis=0).reshape(q.shape)
        s = self.weigh(q, kv, large[0], both[:, :, :STRIDE])
        state = s @ kv
        total, h = state[..., WIDTH:], state[..., :WIDTH] / state[..., WIDTH:]
        flat = h.reshape(-1, WIDTH)
        d = classed(flat @ into, class_log, x[:, STRIDE:], large[1])
        np.exp(d, out=d)
        sums = d @ np.ones(CLASSES, np.float32)
        d.reshape(-1)[np.arange(0, d.size, CLASSES) + target] -= sums
        share = weight / sums[:, None]
        np.multiply((d @ into.T).reshape(h.shape), share.reshape(total.shape) / total, out=dh[..., :WIDTH])
        np.negative(np.einsum("abij,abij->abi", dh[..., :WIDTH], h), out=dh[..., WIDTH])
        np.matmul(dh, kv.transpose(0, 1, 3, 2), out=ds)
        ds *= s
        dq = (ds @ kv[..., :WIDTH]).reshape(-1, WIDTH)
        of_keys = both.transpose(0, 1, 3, 2) @ brought[..., :WIDTH]
        np.add((dq @ form.T).reshape(h.shape), of_keys[:, :, STRIDE:], out=by_place[:, 1:])
        by_place[:, :-1] += of_keys[:, :, :STRIDE]
        return at[:, STRIDE:, :WIDTH].reshape(-1, WIDTH).T @ dq, (flat * share).T @ d, ds.sum(axis=(0, 1))


def windows(x: np.ndarray) -> np.ndarray:
    """Of runs' places (runs, places, width), each window's with those before it, as a view."""
    runs, places, width = x.shape
    return np.lib.stride_tricks.as_strided(x, (runs, places // STRIDE - 1, 2 * STRIDE, width), (x.strides[0], STRIDE * x.strides[1], *x.strides[1:]))


def classed(logits: np.ndarray, class_log: np.ndarray, x: np.ndarray, large: bool) -> np.ndarray:
    """Logits of the classes, what the units ``x`` alone say of them included."""
    logits += np.take(class_log, x.ravel(), axis=0)
    if large:
        np.minimum(logits, 2 * LARGEST, out=logits)
    return logits


def added(n: int, at: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``n`` rows; each is the sum of the array's rows whose place in ``at`` has its number."""
    cells = at.astype(np.int64)[:, None] * WIDTH + np.arange(WIDTH)
    return np.bincount(cells.ravel(), x.ravel(), n * WIDTH).reshape(n, WIDTH).astype(np.float32)


class Learner:
    """Adam over the model's parameters; of the embeddings, only the rows that a step met."""

    def __init__(self, model: Attention, vocabulary: Vocabulary):
        self.model, self.v, self.step, self.seen = model, vocabulary, 0, 0
        # all but the embeddings lie in one array, of which the model's are views
        self.rest = [k for k in model.p if k != "emb"]
        whole = np.concatenate([model.p[k].ravel() for k in self.rest])
        for k, part in zip(self.rest, np.split(whole, np.cumsum([model.p[k].size for k in self.rest])[:-1]), strict=True):
            model.p[k] = part.reshape(model.p[k].shape)
        self.moved = [(x, np.zeros_like(x), np.zeros_like(x)) for x in (model.p["emb"], whole)]

    def learn(self, x: np.ndarray, weight: np.ndarray, seed: int) -> None:
        """One pass over all windows of a stream, in random order."""
        windows = len(x) // STRIDE
        runs = -(-(windows - 1) // RUN)
        more = (1 + runs * RUN) * STRIDE - len(x)
        x, weight = np.append(x, np.full(more + 1, EDGE, np.int16)), np.append(weight, np.zeros(more, bool))
        size = RUN * STRIDE
        place = np.arange(size + STRIDE)
        order = np.random.default_rng(seed).permutation(runs)
        for a in range(0, runs, BATCH):
            begin = (order[a : a + BATCH] * size)[:, None]
            here, scored = x[begin + place], weight[begin + place[STRIDE:]].ravel()
            if not scored.any():
                continue
            target = self.v.kind[x[begin + place[STRIDE:] + 1].ravel()]
            used = np.flatnonzero(np.bincount(here.ravel(), minlength=SIZE))
            row = np.zeros(SIZE, np.int16)
            row[used] = np.arange(len(used))
            g = self.model.gradient(self.model.p["emb"][used], row[here], target, scored, self.v.class_log[used])
            self.step += 1
            fade = np.float32(RATE * (1 - 0.99**self.step) ** 0.5 / (1 - 0.9**self.step))
            for (p, first, second), at, by in zip(self.moved, (used, slice(None)), (g["emb"], np.concatenate([g[k].ravel() for k in self.rest])), strict=True):
                one, two = 0.9 * first[at] + 0.1 * by, 0.99 * second[at] + 0.01 * by**2
                first[at], second[at] = one, two
                p[at] -= fade * one / (np.sqrt(two) + 1e-7)
            self.seen += int(scored.sum())


def round_of(doc_ids: list, rounds: int) -> np.ndarray:
    return (mix(np.array([zlib.crc32(str(d).encode()) for d in doc_ids], np.uint64) + U(1000)) % U(rounds)).astype(np.int64)


def train(sliced: DataFrame, vocabulary, model: Attention, number: int, rounds: int = ROUNDS) -> Attention:
    """One round: every task trains a copy of the model on its training documents of this round; copies are averaged by the ids they saw."""
    given = sliced.sparkSession.sparkContext.broadcast(model)

    def learn(batches):
        v = vocabulary.value
        learner = Learner(pickle.loads(pickle.dumps(given.value)), v)
        for _, own, _ in whole(batches):
            chosen = np.flatnonzero(~own.held & (round_of(own.doc_ids, rounds) == number))
            if len(chosen):
                x, weight, _ = stream(*own.words, v.unit, chosen)
                learner.learn(x, weight, number)
        if learner.seen:
            cells = np.concatenate([[1.0], *(learner.model.p[k].ravel() for k in Attention.NAMES)]) * learner.seen
            yield pa.RecordBatch.from_arrays([pa.array([packed(cells)], pa.binary())], names=["cells"])

    total = summed(sliced.select("slice", "part", "blob").mapInArrow(learn, "cells binary"))
    if total is not None:
        mean, at = (total[1:] / total[0]).astype(np.float32), 0
        for k in Attention.NAMES:
            n = model.p[k].size
            model.p[k] = mean[at : at + n].reshape(model.p[k].shape)
            at += n
    return model


def text_scores(model: Attention, v: Vocabulary, bounds, codes, ids, sizes, counts) -> np.ndarray:
    """Natural log of each text's probability: windows are scored SCORED at a time, and each place once. ``counts``: of the distinct words, in training documents."""
    every = np.arange(len(bounds) - 1)
    x, weight, first = stream(bounds, codes, ids, sizes, v.unit, every)
    tables = model.tables(model.p["emb"])
    large = model.bounds(*tables)
    x, out, ended = np.append(x, np.int16(EDGE)), np.zeros(len(weight)), np.zeros(len(weight))
    for a in range(STRIDE, len(weight), SCORED * STRIDE):
        b = min(len(weight), a + SCORED * STRIDE)
        here, after = x[a:b], x[a + 1 : b + 1]
        got, end = model.log_probability(*tables, x[None, a - STRIDE : b], v.kind[after], v.class_log, v.ended, large)
        out[a:b], ended[a:b] = np.where(weight[a:b], got + np.take(v.unit_log, here.astype(np.int32) * np.int32(SIZE) + after), 0), end
    begins = weight & v.begins[x[1:]]  # here a word, or the text, is at its end, and the next thing begins
    out[begins] -= ended[begins]
    total = np.add.reduceat(np.where(begins, out, 0), first) if len(first) else np.zeros(0)
    # of each word the places after its first id, to that at which it ends
    rest = np.where(begins, ended, out)
    closed = begins.copy()
    closed[first] = False
    last = np.flatnonzero(closed)
    run = np.cumsum(np.where(weight, rest, 0))
    opened = np.flatnonzero(begins & (x[1:] != EDGE))
    rest = run[last] - run[opened]
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    rare = np.concatenate([[0.0], np.cumsum(v.within[ids])])  # what stands within the units of rare ids
    head = first_ids(ids, sizes)
    times, types = v.times[head].astype(np.float64), v.types[head]
    known = times / np.maximum(times + types, 1)
    own = np.exp(rest + (rare[ends[1:]] - rare[ends[:-1] + 1])[codes]) if len(codes) else rest
    word = np.log((known * counts / np.maximum(times, 1))[codes] + (1 - known)[codes] * own + 1e-300) + v.within[head][codes] if len(codes) else rest
    return total + np.diff(np.concatenate([[0.0], np.cumsum(word)])[bounds])


def score_documents(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(8, -(-size // BUCKET_BYTES))
    sliced = materialise(slice_rows(own), "slices")
    counted = materialise(word_counts(sliced, buckets), "counts")
    types, tokens = counted.filter("slice = -1").agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    ends = sliced.agg(F.coalesce(F.sum("ends"), F.lit(0))).first()[0]
    train_tokens, vocabulary_size = tokens + ends, types + (ends > 0)
    v = Vocabulary(id_counts(sliced), summed(counted.filter("slice = -1").select(F.col("counts").alias("cells")), many=True))
    vocabulary = spark.sparkContext.broadcast(v.fit(pair_counts(sliced, v.unit)))
    model = Attention(vocabulary.value)
    for number in range(rounds if train_tokens else 0):
        model = train(sliced, vocabulary, model, number, rounds)
    ready = spark.sparkContext.broadcast(model)
    rest = np.log10(train_tokens + vocabulary_size + 1)

    def score(batches):
        for _, own, answers in whole(batches):
            c = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint64) for x in answers)]).astype(np.float64)
            n = np.diff(own.bounds) + 1
            per = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[own.codes])])[own.bounds])  # noqa: B023, E731
            base_score, known = per(np.log10(c + 1) - rest) + np.log10(ends + 1) - rest, per((c > 0).astype(np.int64)) + (ends > 0)
            total = text_scores(ready.value, vocabulary.value, *own.words, c) / np.log(10) if train_tokens else base_score
            yield pa.RecordBatch.from_arrays(
                [pa.array(own.doc_ids, pa.int64()), pa.array(own.held), pa.array(n), pa.array(known), pa.array(np.full(len(n), train_tokens)), pa.array(base_score), pa.array(total)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )
        release()

    answers = counted.filter("slice >= 0").select("slice", F.col("bucket").alias("part"), F.col("counts").alias("blob"))
    met = sliced.select("slice", "part", "blob").unionByName(answers).repartition(bounded_parts(max(8, -(-size // PART_BYTES))), "slice").sortWithinPartitions("slice", "part")
    return met.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op1_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
