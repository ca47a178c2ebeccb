"""Language ID by interpolated Kneser-Ney character models, one per language.

Characters are modelled within words (runs of letters, in lower case, between two bounds),
so a word's likelihood is the same wherever it stands and each distinct word of a step is
scored once. The models are kept in one sorted array of n-gram hashes with, per language,
the discounted probability of the n-gram and the weight it leaves to the next lower order
when it is a context. A text gets the language of lowest cross-entropy per character; it is
rejected where that entropy is above what texts of the language reach (calibrated on
training documents that the models haven't seen). Where a language's sample has few of
them, documents outside the sample calibrate as well; a language that is still short of
``ENOUGH`` has the limit of all languages' calibration together, or its own if that is higher.

Training reads a bounded sample of labelled documents: of each language the first in order of
a hash, at least one, up to ``PER_LANGUAGE`` (fewer where there are so many languages that
``TOTAL`` is met) and ``CHARACTERS``, so every labelled language is learnt and what the driver
gets is bounded whatever repeats or runs long; a document adds ``LONG`` characters at most.
Counts per language cover all documents. Everything predicted covers whole texts.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected;
with no labelled document at all every text is; ties go to the language that is first by
name; repeated rows are judged each on their own; a null doc_id is judged, and neither
held out nor learnt from; a very long text is a slice of its own, whose words are looked up
a block at a time; an empty table gives an empty table; further columns are carried along
unless they have a name that the operator adds, which is then replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm._text import joined, mix, release, slices
from textloom.session import table

ORDER = 5
#: Documents that the models of one language, and all models together, are fitted on (expected numbers of the hashed sample).
PER_LANGUAGE, TOTAL = 600, 8000
#: Characters of one language that its model is fitted on, and of all languages together; of one document; of a document that only calibrates.
CHARACTERS, ALL_CHARACTERS, LONG, CALIBRATION_LONG = 4_000_000, 40_000_000, 200_000, 20_000
#: Of the sampled documents of a language, one in so many calibrates its rejection.
CALIBRATE = 4
#: Calibrating documents that a language's own limit needs; how many there are at most where the sample has fewer.
ENOUGH, DRAWN = 20, 60
#: A text is rejected above this quantile of its language's calibration, plus a margin in bits, plus slack / characters.
QUANTILE, MARGIN, SLACK = 0.995, 0.75, 24.0
#: Bytes of text that a task scores at a time.
SLICE_BYTES = 1 << 20
#: Distinct words of a slice whose n-grams are looked up at a time.
BLOCK_WORDS = 8192
UNDETERMINED = "und"
ADDED = ("lang_pred", "score", "bits", "rejected")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; the documents where it is 2 are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def letter_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, each word's code in reading order, and the bounds of each text."""
    split = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}]+", " "), " ")
    flat, offsets = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(full)])[offsets - offsets[0]]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), bounds


def framed(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All characters of the words, each word between two zeros, and where each word starts."""
    text = "\0" + joined(distinct, "\0\0") + "\0" if len(distinct) else ""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    return points, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def gram_hashes(points: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """For n from 1 to ``order``, the hash of the n-gram that ends at each character (0 where it would leave the word)."""
    if not len(points):
        return [np.zeros(0, np.uint64)] * order
    place = np.arange(len(points)) - np.repeat(starts[:-1], np.diff(starts))
    out, h = [], np.zeros(len(points), np.uint64)
    for n in range(1, order + 1):
        # the n-gram's hash adds the character n - 1 places back to the (n - 1)-gram's, so both end at the same place
        back = np.concatenate([np.zeros(n - 1, np.uint64), points])[: len(points)]
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + back + np.uint64(n))
        out.append(np.where(place >= n - 1, h | np.uint64(1), np.uint64(0)))
    return out


class Models:
    """Kneser-Ney models of several languages over one sorted hash array per order."""

    def __init__(self, order: int = ORDER):
        self.order, self.languages, self.limits, self.base = order, [], np.zeros(0), np.zeros(0)
        self.keys: list[np.ndarray] = []
        self.gain: list[np.ndarray] = []
        self.leave: list[np.ndarray] = []

    @staticmethod
    def counts(distinct: pa.Array, times: np.ndarray, order: int):
        """One language's n-grams by order: (hash, context's hash, suffix's hash, count)."""
        points, starts = framed(distinct)
        hashes = gram_hashes(points, starts, order)
        weight = np.repeat(times, np.diff(starts))
        for n in range(order):
            h = hashes[n]
            context = np.concatenate([np.zeros(1, np.uint64), hashes[n - 1][:-1]]) if n else np.zeros(len(h), np.uint64)
            real = (h != 0) & (np.arange(len(h)) != np.repeat(starts[:-1], np.diff(starts)))  # the first bound is never predicted
            keys, first, inverse = np.unique(h[real], return_index=True, return_inverse=True)
            yield keys, context[real][first], (hashes[n - 1][real][first] if n else np.zeros(len(keys), np.uint64)), np.bincount(inverse, weight[real], len(keys))

    def fit(self, samples: dict[str, pa.Array]) -> Models:
        self.languages = sorted(samples)
        tables: list[dict[int, tuple]] = [{} for _ in range(self.order)]
        for k, lang in enumerate(self.languages):
            distinct, codes, _ = letter_words(samples[lang])
            grams = list(self.counts(distinct, np.bincount(codes, minlength=len(distinct)).astype(float), self.order))
            for n in range(self.order):
                keys, context, _, count = grams[n]
                if n < self.order - 1:  # below the highest order, how many characters stand before it; word starts keep their counts
                    u, c = np.unique(grams[n + 1][2], return_counts=True)
                    at = np.searchsorted(u, keys).clip(0, max(len(u) - 1, 0))
                    seen = len(u) and u[at] == keys
                    count = np.where(seen, c[at] if len(u) else 0, count)
                ones, twos = np.count_nonzero(count == 1), np.count_nonzero(count == 2)
                discount = ones / (ones + 2 * twos) if ones and twos else 0.5
                contexts, inverse = np.unique(context, return_inverse=True)
                total = np.bincount(inverse, count, len(contexts))
                types = np.bincount(inverse, minlength=len(contexts))
                tables[n][k] = (keys, (count - discount).clip(0) / total[inverse], contexts, discount * types / total)
        size = len(self.languages)
        self.base = np.full(size, 1 / 400)
        for n in range(self.order):
            keys = np.unique(np.concatenate([*(t[0] for t in tables[n].values()), *(t[2] for t in (tables[n + 1] if n + 1 < self.order else {}).values()), np.zeros(1, np.uint64)]))
            gain, leave = np.zeros((len(keys), size), np.float32), np.ones((len(keys), size), np.float32)
            for k, (own, p, _, _) in tables[n].items():
                gain[np.searchsorted(keys, own), k] = p
            for k, (_, _, contexts, w) in (tables[n + 1] if n + 1 < self.order else {}).items():
                leave[np.searchsorted(keys, contexts), k] = w
            leave[0] = 1  # hash 0: no such n-gram
            self.keys.append(keys), self.gain.append(gain), self.leave.append(leave)
        self.first = np.array([tables[0][k][3][0] if len(tables[0][k][3]) else 1.0 for k in range(size)], np.float32)
        return self

    def word_bits(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each word in each language, and its number of predicted characters."""
        points, starts = framed(distinct)
        if not len(distinct):
            return np.zeros((0, len(self.languages))), np.zeros(0)
        hashes = gram_hashes(points, starts, self.order)
        p = self.base.astype(np.float32)[None, :] * self.first[None, :]
        before = None
        for n in range(self.order):
            at = np.searchsorted(self.keys[n], hashes[n]).clip(0, len(self.keys[n]) - 1)
            at[self.keys[n][at] != hashes[n]] = 0
            missing = self.keys[n][at] == 0
            gain = self.gain[n][at]
            gain[missing] = 0
            if n:
                p = p * self.leave[n - 1][np.concatenate([[0], before[:-1]])]
            p = p + gain
            before = at
        bits = -np.log2(p)
        bits[starts[:-1]] = 0
        return np.add.reduceat(bits, starts[:-1], axis=0), np.diff(starts) - 1.0

    def text_bits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character of each text in each language, and its number of characters."""
        distinct, codes, bounds = letter_words(texts)
        blocks = [self.word_bits(distinct.slice(k, BLOCK_WORDS)) for k in range(0, max(1, len(distinct)), BLOCK_WORDS)]
        bits, sizes = (np.concatenate(x) for x in zip(*blocks, strict=True))
        run = np.concatenate([np.zeros((1, bits.shape[1])), np.cumsum(bits[codes], axis=0, dtype=np.float64)])
        n = np.concatenate([[0], np.cumsum(sizes[codes])])
        n = n[bounds[1:]] - n[bounds[:-1]]
        return (run[bounds[1:]] - run[bounds[:-1]]) / np.maximum(n, 1)[:, None], n

    def calibrate(self, samples: dict[str, pa.Array], quantile: float = QUANTILE, margin: float = MARGIN) -> Models:
        """Per language, the entropy above which a text is rejected."""
        own = []
        for k, lang in enumerate(self.languages):
            bits, n = self.text_bits(samples[lang]) if lang in samples else (np.zeros((0, len(self.languages))), np.zeros(0))
            own.append(bits[n > 0, k])
        every = np.concatenate([*own, np.zeros(0)])
        pooled = float(np.quantile(every, quantile)) + margin if len(every) else float(np.log2(400))  # without any, the bits of an unknown character
        limits = []
        for bits in own:
            limit = float(np.quantile(bits, quantile)) + margin if len(bits) else pooled
            limits.append(limit if len(bits) >= ENOUGH else max(limit, pooled))
        self.limits = np.array(limits)
        return self

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, bits per character and rejection of each text."""
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), np.ones(len(texts), bool)
        bits, n = self.text_bits(texts)
        best = bits.argmin(axis=1)
        low = bits[np.arange(len(bits)), best]
        score = 1 / np.exp2((low[:, None] - bits) * n[:, None]).sum(axis=1)  # the language's share of all likelihoods of the whole text
        none = n == 0
        langs = [UNDETERMINED if none[i] else self.languages[b] for i, b in enumerate(best)]
        return langs, np.where(none, 0, score), np.where(none, np.nan, low), none | (low > self.limits[best] + SLACK / np.maximum(n, 1))


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, total: int = TOTAL, characters: int = CHARACTERS, every: int = ALL_CHARACTERS) -> list[tuple[str, list[str], list[str]]]:
    """(language, texts to fit, texts to calibrate) of every labelled language: the first documents not held out in order of a hash, at least one of each.

    Of a language at most ``per_language`` texts and ``characters`` characters come, and at most ``DRAWN`` more calibrate; of a document longer than ``LONG`` a run of its words does, from a place that its hash picks.
    """
    known = docs.filter((fold(F.col("doc_id")) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    h = F.pmod("h", F.lit(1 << 30))
    told = known.groupBy("lang").agg(F.count("*").alias("n"), F.min(h).alias("first")).collect()
    counts = {r["lang"]: r["n"] for r in told}
    if not counts:
        return []
    each, characters = min(per_language, max(1, total // len(counts))), min(characters, max(LONG, every // len(counts)))
    most = each + DRAWN
    # some times as many as are needed, so that few rows are ranked; of small languages all, of each at least the first (which may be all of its rows)
    last = F.element_at(F.create_map(*[x for r in told for x in (F.lit(r["lang"]), F.lit(max(r["first"], int((1 << 30) * min(1.0, 4.0 * most / r["n"])))))]), F.col("lang"))
    start = (F.pmod(F.col("h"), F.greatest(F.length("text") - LONG, F.lit(1))) + 1).cast("int")
    run = F.regexp_replace(F.substring("text", start, F.lit(LONG)), r"(?s)^\S*\s|\s\S*$", "")
    drawn = known.filter(h <= last).withColumn("text", F.when(F.length("text") > LONG, run).otherwise(F.col("text")))
    by_hash = Window.partitionBy("lang").orderBy(h, "h", "text")
    ranked = drawn.withColumn("rank", F.row_number().over(by_hash)).filter(F.col("rank") <= most)
    used = F.sum(F.length("text")).over(by_hash.rowsBetween(Window.unboundedPreceding, 0))
    fits = (F.col("rank") <= each) & ((F.col("rank") == 1) | (used <= characters))
    fitted = ranked.withColumn("fits", fits).withColumn("n", F.sum(F.col("fits").cast("int")).over(Window.partitionBy("lang"))).filter(F.col("rank") <= F.col("n") + DRAWN)
    part = F.when(F.col("fits"), F.pmod(F.xxhash64(F.lit("calibrate"), "h"), F.lit(CALIBRATE))).otherwise(F.lit(-1))
    rows = fitted.select("lang", F.when(F.col("fits"), F.col("text")).otherwise(F.substring("text", 1, CALIBRATION_LONG)).alias("text"), part.alias("part"), "rank").collect()
    out = []
    for lang in sorted(counts):
        own = [(r["text"], r["part"]) for r in sorted((r for r in rows if r["lang"] == lang), key=lambda r: r["rank"])]
        calibrating = sum(p == 0 for _, p in own)
        few = calibrating < 8
        more = [t for t, p in own if p < 0][: DRAWN - calibrating] if calibrating < ENOUGH else []
        out.append((lang, [t for t, p in own if p > 0 or (few and p == 0)], [t for t, p in own if p == 0] + more))
    return out


def fit(docs: DataFrame, **options) -> Models:
    found = sample(docs, **options)
    models = Models().fit({k: pa.array(texts, pa.large_string()) for k, texts, _ in found}) if found else Models()
    models.calibrate({k: pa.array(texts, pa.large_string()) for k, _, texts in found if texts})
    del found
    release()
    return models


def identify(docs: DataFrame, models: Models | None = None) -> DataFrame:
    """``docs`` with lang_pred, score, bits and rejected. Without ``models``, they are fitted on ``docs`` first."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(models or fit(docs))
    names = [c for c in docs.columns if c not in ADDED]

    def predict(batches):
        models = held.value
        for piece, texts in slices(batches, limit=SLICE_BYTES):
            langs, score, bits, rejected = models.predict(texts)
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64()), pa.array(rejected)], names=[*piece.schema.names, *ADDED])

    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

    kept = docs.select(*names)
    schema = StructType([*kept.schema.fields])
    for name, kind in zip(ADDED, (StringType(), DoubleType(), DoubleType(), BooleanType()), strict=True):
        schema = schema.add(name, kind)
    return kept.mapInArrow(predict, schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = fit(docs)
    out = identify(docs.select("doc_id", "text"), models)
    return out.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score", "bits", "rejected")
