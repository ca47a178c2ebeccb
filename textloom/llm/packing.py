"""Packing by power-of-two decomposition.

A document's ids are cut, from the start, into pieces whose lengths are powers of two:
as many of the longest as fit, then the binary digits of what is left, largest first.
Every piece is a sequence of its own in the bucket of its length, so no sequence crosses
documents and none is padded.

Ids are those of the tokenizer as its file stands: the strings of its special tokens are
these tokens wherever they stand in a text, in just this case.

Defined results: a null or empty text is its end id alone; a null doc_id is packed like any
other; repeated rows are packed each on their own; equal lengths need no order, since each
piece is a sequence of its own; a very long text is a step of its own, of which a task holds
the ids (4 bytes each); an empty table gives an empty table; further columns, whatever their
names, are not read. Sequence ids are unique, ascending within a partition of the input, and the same in every rerun
over the same files.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm._text import slices, strings, words
from textloom.session import table

#: Longest sequence; a power of two.
LONGEST = 2048
#: The id that ends each document.
END = 1
#: Where the tokenizer's file is; None: word_bpe_49k.json of the installed vocabularies.
TOKENIZER = None
#: How the tokenizer writes bytes (fixed by its format): printable ones as they are, the others from U+0100 on, in order.
PRINTABLE = (*range(33, 127), *range(161, 173), *range(174, 256))
LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
#: Distinct chunks after which a worker starts a new generation of those it keeps; bytes of text of a step.
CACHE, SLICE_BYTES = 100_000, 2 << 20

SCHEMA = "doc_id long, start long, length long, bucket int, doc_tokens long, ids binary"


class ChunkTokenizer:
    """Ids of whole texts, with the ids of chunks between white space kept for reuse.

    The tokenizer's pattern never matches across white space, and its normaliser composes
    nothing with a space, so the ids of a text are those of its chunks in a row. Below
    U+0300 nothing composes at all (and but for U+0130 no letter grows in lower case), so there A-Z may be in lower case before (the
    normaliser's last step) and a stop or comma after a letter may stand apart. Texts with the string of a special token go through
    the tokenizer whole; chunks of other texts are ordinary text whatever they become in lower case.
    """

    def __init__(self, path: str | None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads would each keep memory
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks. Two generations are kept: a chunk in use passes from the older to the younger, which takes its place when full."""
        known, older, missing = self.known, self.older, []
        for c in chunks:
            if c not in known:
                if c in older:
                    known[c] = older[c]
                else:
                    missing.append(c)
        tokenize, rest = self.model.tokenize, []
        for c in missing:
            if not c.isalpha():
                rest.append(c)
            elif c.isascii():  # letters are one match of the pattern; those below U+0300 compose with nothing
                known[c] = array("I", [t.id for t in tokenize(c.lower())]).tobytes()
            elif max(c) < "\u0300" and "\u0130" not in c:
                known[c] = array("I", [t.id for t in tokenize(c.lower().encode().decode("latin-1").translate(LETTERS))]).tobytes()
            else:
                rest.append(c)
        for c, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            known[c] = array("I", e.ids).tobytes()
        found = [known[c] for c in chunks]
        if len(known) > CACHE:
            self.older, self.known = known, {}
        return found

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        chunks = text.replace("\n", " ").split(" ")
        distinct = list(set(chunks))
        found = dict(zip(distinct, self.learn(distinct), strict=True))
        return b"".join([found[c] for c in chunks])

    def all_ids(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text."""
        marked = np.zeros(len(texts), bool)
        for token in self.special:
            marked |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        beyond = marked | pc.match_substring_regex(texts, r"[\x{0130}\x{0300}-\x{10FFFF}]").to_numpy(zero_copy_only=False)
        apart = pc.replace_substring_regex(pc.ascii_lower(texts.filter(pa.array(~beyond))), r"(\p{L})([.,])([ \n]|$)", r"\1 \2\3")
        distinct, codes, bounds = words(apart)
        found, codes = self.learn(strings(distinct)), codes.tolist()
        spans, out = iter(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)), []
        for i, odd in enumerate(beyond):
            if marked[i]:
                self.tokenizer.encode_special_tokens = False
                out.append(array("I", self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids).tobytes())
                self.tokenizer.encode_special_tokens = True
            elif odd:
                out.append(self.ids(texts[i].as_py()))
            else:
                first, last = next(spans)
                out.append(b"".join([found[c] for c in codes[first:last]]))
        return out


_tokenizers: dict = {}


def chunk_tokenizer(path: str | None) -> ChunkTokenizer:
    """One per Python worker, so that what it knows serves all tasks of the worker."""
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


def binary_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Powers of two that sum to n, largest first, none above ``longest``."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_power_of_two(docs: DataFrame, longest: int = LONGEST, end: int = END, tokenizer: str | None = TOKENIZER) -> DataFrame:
    """One row per piece: doc_id, start, length, bucket (log2 of the length), doc_tokens, ids (unsigned 32-bit, little-endian), sequence_id, offset."""
    if longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    tail = np.array([end], np.uint32).tobytes()

    def pack(batches):
        made = chunk_tokenizer(tokenizer)
        for piece, texts in slices(batches, limit=SLICE_BYTES):
            out = ([], [], [], [], [], [])
            for doc_id, ids in zip(piece.column("doc_id").to_pylist(), made.all_ids(texts), strict=True):
                ids += tail
                at = 0
                for n in binary_lengths(len(ids) // 4, longest):
                    for column, value in zip(out, (doc_id, at, n, n.bit_length() - 1, len(ids) // 4, ids[4 * at : 4 * (at + n)]), strict=True):
                        column.append(value)
                    at += n
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "start", "length", "bucket", "doc_tokens", "ids"])

    packed = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, SCHEMA)
    return packed.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def pieces(docs: DataFrame) -> DataFrame:
    """Pieces with a checksum in place of their ids."""
    return pack_power_of_two(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(table(spark, sf_dir, "documents"))
