"""N-gram Jaccard self-join: a size-aware heavy-light join on sets of word shingles.

Documents with equal sets are one node. Light sets (below a size boundary) enumerate, for
each size that a partner can have, all their subsets of the fixed size that the two must
share; sets that meet in such a subset link, with nothing left to verify. Heavy sets are
put on inverted lists, one per shingle, and the lists are scanned. A set is on the lists of
its prefix: in one order for all sets, its first shingles, as many as leave too few to be
linked by. The order puts the corpus' rare shingles first (``commonness``), so that shared
passages are seldom on a list; any order gives the same links. The boundary is the size at
which enumerating a set costs more than putting it on lists and verifying it.

A list of the whole corpus only ties its members, of sizes that can link, to the first (a
slice of documents sends each list once, with its own members tied): no pairs are made. Sets
that are tied, over any number of lists, are a group of candidates. Groups are dealt in
blocks of bounded size, and within a block the lists are scanned for real: for each set,
shared prefix shingles are counted over the lists of the sets before it, within the size
bounds; candidates that are connected already are skipped, a lower bound of the symmetric
difference (parity sketches) discards most others, the rest is intersected. Where a group has
more than one block, each block is first scanned by itself, then one set of each class found
in a block with those of other blocks; only sets outside the group's largest class are then
scanned against all blocks, since links within that class are known. What comes out is a
spanning forest of all links, so components are exact while a group of n near copies is read
a few times and never makes n² rows.

Shingles and sets are compared by 64-bit hashes.

Defined results: a null or empty text, or one of white space, has the empty set and is
linked with nothing (also not with its like); fewer words than a shingle are one shingle;
a null doc_id takes no part and comes back with a null component; rows with the same
doc_id are one document: their sets are linked, whatever they hold; sets of equal size need
no order; a very long text is a slice, and a block, of its own, of which a task holds the
shingles (8 bytes each, a few times over); an empty table gives an empty table; further
columns, whatever their names, are not read.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm._text import bounded_parts, cuts_of, mix, release, slices, strings, words
from textloom.operators.components import connected_components
from textloom.session import materialise, table

#: Words of a shingle, and the least similarity of linked sets as numerator / denominator.
SHINGLE, SIMILAR = 3, (90, 100)
#: Members and shingles of a verification block at most (a longer document is a block of its own).
BLOCK_SETS, BLOCK_ELEMENTS = 2048, 2_000_000
#: Sets of a list that meet in pairs, at most, and fewest and most bits of their sketches, where a group has more than one block.
PAIRED, PARITY_BITS = 32, (256, 1 << 17)
#: Rounds in which one set of each class is compared, at most.
LEADER_ROUNDS = 8
#: Shingles whose keys meet in one bucket.
BUCKET_ELEMENTS = 1_500_000
#: Cells (a power of two) of the table of common shingles, one byte each: what is broadcast, at every size of the input.
CELL_BITS = 23
#: Shingles counted in one bucket.
COUNT_ELEMENTS = 2_000_000
#: Bytes of text whose sets a task holds at a time.
SLICE_BYTES = 2 << 20
#: Candidates' ids are broadcast up to this size when their texts are fetched, joined by shuffle beyond it.
BROADCAST_BYTES = 32 << 20
#: Parts that the copies of one set are dealt over when they learn their class.
SALTS = 16

U = np.uint64
ODD = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9))


def shared(s: int, r: int, similar=SIMILAR) -> int:
    """Elements that linked sets of sizes s and r share at least: i / (s + r - i) >= similar."""
    a, b = similar
    return -(-a * (s + r) // (a + b))


def partners(s: int, similar=SIMILAR) -> range:
    """Sizes that a set linked with one of size s can have."""
    a, b = similar
    return range(-(-a * s // b), b * s // a + 1)


def enumeration_cost(s: int, similar=SIMILAR) -> int:
    """Keys of a light set of size s."""
    return sum(comb(s, shared(s, r, similar)) for r in partners(s, similar))


def prefix(s: int, similar=SIMILAR) -> int:
    """Elements of a set of size s of which linked sets share one at least, when taken in the same order."""
    a, b = similar
    return s - shared(s, -(-a * s // b), similar) + 1


def list_cost(s: int, similar=SIMILAR) -> int:
    """List entries of a heavy set of size s, and its elements for a verification."""
    return prefix(s, similar) + s


@lru_cache(maxsize=8)
def boundary(similar=SIMILAR) -> int:
    """The first size at which enumeration costs more than lists."""
    s = 1
    while enumeration_cost(s, similar) <= list_cost(s, similar):
        s += 1
    return s


def fixed(*factors: tuple[int, int]) -> np.uint64:
    """A sum of products modulo 2**64."""
    return U(sum(int(a) * int(b) for a, b in factors) & (1 << 64) - 1)


def word_hashes(distinct: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, strings(distinct.cast(pa.large_binary()))), np.uint64, len(distinct))


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Each text's set, as sorted hashes."""
    distinct, codes, bounds = words(texts)
    h = word_hashes(distinct)[codes]
    out = []
    rolled = np.zeros(max(0, len(h) - shingle + 1), np.uint64)
    for k in range(shingle if len(rolled) else 0):
        rolled = mix(rolled * ODD[0] + h[k : k + len(rolled)])
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= shingle:
            out.append(np.unique(rolled[a : b - shingle + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for x in h[a:b]:
                whole = mix(whole * ODD[1] + x)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def light_keys(elements: np.ndarray, similar=SIMILAR) -> tuple[list[int], list[int]]:
    """Keys of all fixed-size subsets of a light set, and their roles: 0 and 1 for the smaller and larger of two sizes, 2 for equal sizes."""
    s, total, keys, roles = len(elements), mix(elements).sum(dtype=np.uint64), [], []
    out = mix(elements)
    for r in partners(s, similar):
        left = s - shared(s, r, similar)
        if left < 0 or shared(s, r, similar) > r:
            continue
        gone = np.array([out[list(c)].sum(dtype=np.uint64) for c in combinations(range(s), left)], np.uint64) if left != 1 else out
        low, high = min(s, r), max(s, r)
        keys.append(mix((total - gone) * ODD[0] + fixed((low, ODD[1]), (high, ODD[2]))))
        roles.append(np.full(len(gone), 2 if s == r else int(s > r), np.uint8))
    return np.concatenate(keys), np.concatenate(roles)


def prefix_keys(elements: np.ndarray, common: np.ndarray | None, similar=SIMILAR) -> tuple[np.ndarray, int]:
    """Keys of a heavy set's prefix, rare elements first, and its role: 3 and the size class; linked sets are of the same or of neighbouring classes."""
    a, b = similar
    often = np.zeros(len(elements), np.uint8) if common is None else common[(elements >> U(64 - CELL_BITS)).astype(np.int64)]
    order = np.lexsort((elements, often))
    return mix(elements[order[: prefix(len(elements), similar)]] * ODD[0] + ODD[1]), 3 + int(log(len(elements)) / (log(b / a) * (1 + 1e-9)))


def set_keys(sets: list[np.ndarray], similar=SIMILAR, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of many sets: keys, roles (3 and more: a list's, to be verified) and the set of each."""
    edge, keys, roles, of = boundary(similar), [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
    least = max(1, -(-similar[0] * edge // similar[1]))  # light partners of heavy sets are on the lists, too
    for i, x in enumerate(sets):
        if 0 < len(x) < edge:
            k, r = light_keys(x, similar)
            keys.append(k), roles.append(r), of.append(np.full(len(k), i))
        if len(x) >= least:
            k, r = prefix_keys(x, common, similar)
            keys.append(k), roles.append(np.full(len(k), r, np.uint8)), of.append(np.full(len(k), i))
    return np.concatenate(keys), np.concatenate(roles), np.concatenate(of)


def sketches(sets: list[np.ndarray], width: int) -> np.ndarray:
    """The parity of how many elements fall into each of ``width`` cells, as bits."""
    out = np.zeros((len(sets), width // 64), np.uint64)
    for row, x in enumerate(sets):
        odd = np.bincount((mix(x + ODD[1]) >> U(40)).astype(np.int64) % width, minlength=width) & 1
        out[row] = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)
    return out


def forest(sets: list[np.ndarray], side: np.ndarray | None = None, similar=SIMILAR, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets, by a scan of the inverted lists of their prefixes. ``side``: only links between a 0 and a 1 are looked for. ``known``: classes that are connected already."""
    order = np.argsort([len(x) for x in sets], kind="stable")
    sets = [sets[i] for i in order]
    sizes = np.array([len(x) for x in sets], np.int64)
    if not sizes.sum():
        return []
    a, b = similar
    differ = max(1, (b - a) * 2 * int(sizes.max(initial=1)) // (a + b) + 1)
    width = 256
    while width < min(4 * differ, 8192):
        width *= 2
    sketch = sketches(sets, width)
    # lists of prefixes, the block's rare elements first: entries by element, then by set
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    by = np.lexsort((code, times[code], owner))
    place = np.arange(len(by)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes)
    on = (place < np.array([prefix(int(n), similar) if n else 0 for n in sizes])[owner]) & (times[code[by]] > 1)
    entry, holder = code[by][on], owner[on]
    by = np.argsort(entry, kind="stable")
    held = holder[by]
    at = np.empty(len(by), np.int64)
    at[by] = np.arange(len(by))  # where on its list each entry of a set stands
    start = np.searchsorted(entry[by], entry)
    bounds = np.searchsorted(holder, np.arange(len(sets) + 1))
    root, found = np.arange(len(sets)) if known is None else np.unique(known[order], return_inverse=True)[1], []
    sides = None if side is None else side[order]
    for i in range(1, len(sets)):
        low = int(np.searchsorted(sizes, -(-a * sizes[i] // b)))
        lists = [held[x:y] for x, y in zip(start[bounds[i] : bounds[i + 1]].tolist(), at[bounds[i] : bounds[i + 1]].tolist(), strict=True) if x < y]
        if not lists or low >= i:
            continue
        met = np.bincount(np.concatenate(lists), minlength=i)[low:i]
        maybe = np.nonzero(met)[0] + low
        maybe = maybe[root[maybe] != root[i]]
        if sides is not None:
            maybe = maybe[sides[maybe] != sides[i]]
        if not len(maybe):
            continue
        both = sizes[maybe] + sizes[i]
        apart = np.bitwise_count(sketch[maybe] ^ sketch[i]).sum(axis=1, dtype=np.int64)
        maybe = maybe[apart <= both - 2 * -(-a * both // (a + b))]
        for j in maybe[np.argsort(-met[maybe - low], kind="stable")]:  # those that share most of the prefix first
            if root[j] == root[i]:
                continue
            x, y = sets[j], sets[i]
            spot = np.searchsorted(y, x)
            spot[spot == len(y)] = 0
            inter = int(np.count_nonzero(y[spot] == x))
            if b * inter >= a * (len(x) + len(y) - inter):
                found.append((int(order[j]), int(order[i])))
                root[root == root[i]] = root[j]
    return found


def verified(candidates: DataFrame, similar=SIMILAR, shingle: int = SHINGLE) -> DataFrame:
    """Links (a, b) of a spanning forest. ``candidates``: grp, side_a, side_b (two sides to be compared, or one block), block (the row's side), node, known (its class so far), text; rows of a group come together."""

    def check(batches):
        held: list = []
        key = None

        def done():
            sets, nodes, side, known = [x[1] for x in held], [x[0] for x in held], np.array([x[2] for x in held]), np.array([x[3] for x in held])
            cross = (side != key[1]).astype(int) if key[1] != key[2] else None
            pairs = [(nodes[i], nodes[j]) for i, j in forest(sets, cross, similar, known) if nodes[i] != nodes[j]]
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

        for piece, texts in slices(batches):
            sets = shingle_sets(texts, shingle)
            columns = [piece.column(c).to_pylist() for c in ("grp", "side_a", "side_b", "block", "node", "known")]
            for *now, block, node, known, own, made in zip(*columns, sets, node_ids(sets).tolist(), strict=True):
                if made != node:  # another text of the same doc_id
                    continue
                if held and now != key:
                    yield done()
                    held = []
                key = now
                held.append((node, own, block, known))
        if held:
            yield done()

    return candidates.mapInArrow(check, "a long, b long")


def node_ids(sets: list[np.ndarray]) -> np.ndarray:
    """One 64-bit id per set, the same for equal sets."""
    return mix(np.array([mix(x).sum(dtype=np.uint64) for x in sets], np.uint64) + np.array([len(x) for x in sets], np.uint64) * ODD[2]).view(np.int64)


def ties(key: np.ndarray, node: np.ndarray, role: np.ndarray):
    """Rows of keys that nodes meet in: (key, row's node, the first node, role), without the first itself. A gap between size classes parts a key's nodes."""
    by = np.lexsort((node, role, key))
    key, node, role = key[by], node[by], role[by]
    gap = (role[:-1] >= 3) & (role[1:] > role[:-1].astype(np.int64) + 1)
    starts = np.nonzero(np.concatenate([[True], (key[1:] != key[:-1]) | gap]))[0] if len(key) else np.zeros(0, np.int64)
    if not len(starts):
        return key, node, node, role
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    low, high = np.minimum.reduceat(role, starts), np.maximum.reduceat(role, starts)
    first = np.repeat(node[starts], sizes)
    met = np.repeat((low >= 2) | (low < high), sizes) & (node != first)
    return key[met], node[met], first[met], role[met]


def tied(key: np.ndarray, node: np.ndarray, role: np.ndarray):
    """``ties`` without their keys."""
    return ties(key, node, role)[1:]


def commonness(docs: DataFrame, total: int, shingle: int = SHINGLE) -> np.ndarray:
    """For each cell of hashes, how often its most frequent shingle occurs in all documents (eighths of a power of two, 0: once at most).

    The table has 2**CELL_BITS bytes whatever the input, so it can be broadcast. With more
    shingles a cell tells less about rare ones; common ones still stand out.
    """
    bits = min(CELL_BITS, max(3, (total // COUNT_ELEMENTS).bit_length()))

    def send(batches):
        for _, texts in slices(batches, limit=SLICE_BYTES):
            sets = shingle_sets(texts, shingle)
            once = np.unique(node_ids(sets), return_index=True)[1]
            h = np.sort(np.concatenate([np.zeros(0, np.uint64), *(sets[i] for i in once)]))
            bucket = (h >> U(64 - bits)).astype(np.int64)
            rest = (h << U(bits) >> U(32)).astype(np.uint32)
            rows = [(k, rest[x:y].tobytes()) for k, x, y in cuts_of(bucket)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "rest"])

    def count(batches):
        held, now = [], None

        def done():
            h = np.sort(np.concatenate([np.frombuffer(x, np.uint32) for x in held]))
            starts = np.nonzero(np.concatenate([[True], h[1:] != h[:-1]]))[0]
            times = np.diff(np.append(starts, len(h)))
            cells = np.zeros(1 << CELL_BITS - bits, np.uint8)
            often = times > 1
            cell = h[starts[often]].astype(np.int64) >> 32 - (CELL_BITS - bits)
            np.maximum.at(cells, cell, np.minimum(255, 8 * np.log2(times[often])).astype(np.uint8))
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([cells.tobytes()], pa.binary())], names=["bucket", "cells"])

        for batch in batches:
            for k, rest in zip(batch.column("bucket").to_pylist(), batch.column("rest").to_pylist(), strict=True):
                if held and k != now:
                    yield done()
                    held = []
                now = k
                held.append(rest)
        if held:
            yield done()

    sent = docs.select("text").mapInArrow(send, "bucket int, rest binary")
    counted = sent.repartition(bounded_parts(1 << bits), "bucket").sortWithinPartitions("bucket").mapInArrow(count, "bucket int, cells binary")
    out = np.zeros((1 << bits, 1 << CELL_BITS - bits), np.uint8)
    for row in counted.collect():  # 2**CELL_BITS bytes in all
        out[row.bucket] = np.frombuffer(row.cells, np.uint8)
    return out.reshape(-1)


def met_nodes(docs: DataFrame, buckets: int, similar=SIMILAR, shingle: int = SHINGLE, common=None) -> DataFrame:
    """key, node, first, open: nodes tied to the first node of a key (open: a list's, to be verified; key is 0 of others).

    A slice sends each key once per bucket and size class in packed rows; nodes that meet within the slice are tied there.
    ``common``: the broadcast table of ``commonness``.
    """
    names, kinds = ["bucket", "keys", "nodes", "roles"], (pa.int32(), pa.binary(), pa.binary(), pa.binary())

    def send(batches):
        for _, texts in slices(batches, limit=SLICE_BYTES):
            sets = shingle_sets(texts, shingle)
            nodes = node_ids(sets)
            once = np.unique(nodes, return_index=True)[1]
            sets, nodes = [sets[i] for i in once if len(sets[i])], np.array([nodes[i] for i in once if len(sets[i])], np.int64)
            key, role, of = set_keys(sets, similar, common.value if common else None)
            node = nodes[of] if len(of) else np.zeros(0, np.int64)
            heavy = role >= 2
            on, a, first, r = ties(key[heavy], node[heavy], role[heavy])
            rows = [(-1, on.tobytes(), np.stack([a, first], axis=1).tobytes(), r.tobytes())] if len(a) else []
            by = np.lexsort((node, role, key))
            key, node, role = key[by], node[by], role[by]
            again = np.concatenate([[False], (key[1:] == key[:-1]) & (role[1:] >= 2) & (role[1:] == role[:-1])]) if len(key) else np.zeros(0, bool)
            key, node, role = key[~again], node[~again], role[~again]
            bucket = ((key >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
            rows += [(k, key[x:y].tobytes(), node[x:y].tobytes(), role[x:y].tobytes()) for k, x, y in cuts_of(bucket)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def tie(batches):
        held, now = [], None
        edge = lambda key, a, first, r: pa.RecordBatch.from_arrays([pa.array(np.where(r >= 3, key, U(0)).view(np.int64)), pa.array(a), pa.array(first), pa.array(r >= 3)], names=["key", "node", "first", "open"])

        def done():
            return edge(*ties(*(np.concatenate([np.frombuffer(x[i], t) for x in held]) for i, t in enumerate((np.uint64, np.int64, np.uint8)))))

        for batch in batches:
            for i in range(batch.num_rows):
                k, *row = (batch.column(c)[i].as_py() for c in names)
                if k < 0:
                    pairs = np.frombuffer(row[1], np.int64).reshape(-1, 2)
                    yield edge(np.frombuffer(row[0], np.uint64), pairs[:, 0], pairs[:, 1], np.frombuffer(row[2], np.uint8))
                    continue
                if held and k != now:
                    yield done()
                    held = []
                now = k
                held.append(row)
        if held:
            yield done()

    sent = docs.select("text").mapInArrow(send, "bucket int, keys binary, nodes binary, roles binary")
    return sent.repartition(bounded_parts(buckets), "bucket").sortWithinPartitions("bucket").mapInArrow(tie, "key long, node long, first long, open boolean")


def differing(n: int, similar=SIMILAR) -> int:
    """Elements at most that are in one only of two linked sets, the larger of size n."""
    a, b = similar
    return (b - a) * 2 * n // (a + b) + 1


def parity_width(n: int, similar=SIMILAR) -> int:
    """Bits of the sketch of a set of size n (a power of two): sets that have nothing in common differ in about twice as many as linked ones may."""
    return min(max(1 << (4 * differing(n, similar) - 1).bit_length(), PARITY_BITS[0]), PARITY_BITS[1])


def sketched(docs: DataFrame, members: DataFrame, similar, shingle: int, broadcast_bytes: int) -> DataFrame:
    """node, sketch of ``members`` (doc_id, node), from their texts."""

    def draw(batches):
        for piece, texts in slices(batches, limit=SLICE_BYTES):
            sets = shingle_sets(texts, shingle)
            own = (node_ids(sets) == piece.column("node").to_numpy()).tolist()  # else another text of the same doc_id
            rows = [(node, sketches([x], parity_width(len(x), similar))[0].tobytes()) for node, x, fits in zip(piece.column("node").to_pylist(), sets, own, strict=True) if fits]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["node", "sketch"])

    asked = members.select("doc_id", "node")
    asked = F.broadcast(asked) if members.count() * 32 <= broadcast_bytes else asked
    drawn = docs.join(asked, "doc_id").select("node", "text").mapInArrow(draw, "node long, sketch binary")
    return materialise(drawn.groupBy("node").agg(F.first("sketch").alias("sketch")), "drawn")


def folded(x: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(x.reshape(-1, words), axis=0)


def told_apart(pairs: DataFrame, similar=SIMILAR) -> DataFrame:
    """Those of ``pairs`` (a, b, n_a, n_b, sketch_a, sketch_b) that sketches don't tell apart."""
    low, high = similar

    def run(batches):
        for batch in batches:
            left = []
            for a, b, n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")), strict=True):
                words = min(len(x), len(y)) // 8
                apart = int(np.bitwise_count(folded(np.frombuffer(x, np.uint64), words) ^ folded(np.frombuffer(y, np.uint64), words)).sum())
                if apart <= n + m - 2 * -(-low * (n + m) // (low + high)):
                    left.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in left], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def parted(docs: DataFrame, members: DataFrame, lists: DataFrame, similar, shingle: int, broadcast_bytes: int) -> DataFrame:
    """``members`` (doc_id, node, n, grp) with their groups found anew; what is a candidate no more is left out.

    Two sets on one list have a rare shingle in common, which in a large corpus many have by
    chance: tied by lists alone, most candidates percolate into one group. Here the members of
    a list meet in pairs, and only those that sizes and sketches don't tell apart are tied. A
    list of more than ``PAIRED`` sets ties all of them, as before, so that a group of near
    copies makes no pairs.
    """
    low, high = similar
    sized = members.select("node", "n")
    own = materialise(lists.join(sized, "node"), "lists")
    many = own.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("first"))
    star = own.join(many.filter(F.col("c") > PAIRED), "key").select(F.col("node").alias("a"), F.col("first").alias("b")).filter("a <> b").distinct()
    few = own.join(many.filter((F.col("c") > 1) & (F.col("c") <= PAIRED)).select("key"), "key")
    x, y = (few.select("key", F.col("node").alias(c), F.col("n").alias(f"n_{c}")) for c in "ab")
    pairs = x.join(y, "key").filter((F.col("a") < F.col("b")) & (high * F.least("n_a", "n_b") >= low * F.greatest("n_a", "n_b"))).drop("key").distinct()
    pairs = materialise(pairs, "pairs")
    drawn = sketched(docs, members, similar, shingle, broadcast_bytes)
    for c in "ab":
        pairs = pairs.join(drawn.select(F.col("node").alias(c), F.col("sketch").alias(f"sketch_{c}")), c)
    near = materialise(told_apart(pairs, similar).unionByName(star), "near")
    return members.drop("grp").join(connected_components(near).select("node", F.col("component").alias("grp")), "node")


def class_of(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``known``: the class that links put each node in (itself, without any)."""
    return nodes.join(connected_components(links).select("node", F.col("component").alias("known")), "node", "left").withColumn("known", F.coalesce("known", "node"))


def linked(docs: DataFrame, members: DataFrame, sure: DataFrame, lists: DataFrame, similar, shingle: int, broadcast_bytes: int, sets: int = BLOCK_SETS, elements: int = BLOCK_ELEMENTS) -> DataFrame:
    """Links (a, b) between candidates. ``members``: doc_id, node, n (size), grp. ``sure``: links that need no verification. ``lists``: key, node, what groups come from."""

    def scanned(dealt: DataFrame) -> DataFrame:
        dealt = materialise(dealt.select("doc_id", "node", "known", "grp", "block", "side_a", "side_b"), "dealt")
        small = dealt.count() * 56 <= broadcast_bytes
        texts = docs.join(F.broadcast(dealt) if small else dealt, "doc_id").select("grp", "side_a", "side_b", "block", "node", "known", "text")
        return materialise(verified(texts.repartition("grp", "side_a", "side_b").sortWithinPartitions("grp", "side_a", "side_b"), similar, shingle), "links")

    def blocks(rows: DataFrame, names: list[str]) -> DataFrame:
        """Blocks that rows of one kind take; only where it is more than one."""
        return rows.groupBy(*names).agg(F.ceil(F.greatest(F.count("*") / F.lit(sets), F.sum("n") / F.lit(elements))).cast("int").alias("blocks")).filter("blocks > 1")

    def put(rows: DataFrame, names: list[str], salt: str) -> DataFrame:
        """``rows`` with ``block``. The list of what takes more than one block is bounded by rows / a block's, and is broadcast if small."""
        many = materialise(blocks(rows, names), "blocks")
        many = F.broadcast(many) if many.count() * 32 <= broadcast_bytes else many
        return rows.join(many, names, "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64(F.lit(salt), "node"), F.col("blocks")), F.lit(0)).cast("int"))

    members = materialise(put(members, ["grp"], "own"), "members")
    large = members.filter("blocks > 1").select("doc_id", "node", "n", "grp")
    if large.head(1):
        large = parted(docs, large, lists, similar, shingle, broadcast_bytes)
        members = materialise(put(members.filter("blocks is null").select(*large.columns).unionByName(large), ["grp"], "own"), "members")
    links = sure.unionByName(scanned(members.select("*", F.col("node").alias("known"), F.col("block").alias("side_a"), F.col("block").alias("side_b"))))
    big = members.filter("blocks > 1").drop("blocks")
    if not big.head(1):
        return links
    big = materialise(class_of(links, big), "classes")
    for number in range(LEADER_ROUNDS):  # each round leaves up to as many times fewer classes as a block has sets
        classes = big.groupBy("grp", "known").agg(F.min("node").alias("node"))
        several = classes.groupBy("grp").count().filter("count > 1").select("grp")
        leaders = materialise(big.join(classes.select("node"), "node", "left_semi").join(several, "grp", "left_semi").drop("block"), "leaders")
        before = leaders.count()
        if not before:
            break
        dealt = put(leaders, ["grp"], f"leaders {number}").select("*", F.col("block").alias("side_a"), F.col("block").alias("side_b"))
        links = links.unionByName(scanned(dealt))
        big = materialise(class_of(links, big.drop("known")), "classes")
        if big.join(several, "grp", "left_semi").select("grp", "known").distinct().count() * 2 > before:
            break
    most = big.groupBy("grp", "known").agg(F.count("*").alias("c")).groupBy("grp").agg(F.max_by("known", F.struct("c", "known")).alias("largest"), F.count("*").alias("classes"))
    most = most.filter("classes > 1").select("grp", "largest")
    few = put(big.drop("block").join(most, "grp").filter("known <> largest").drop("largest"), ["grp"], "few").withColumn("few", F.coalesce("blocks", F.lit(1))).drop("blocks")
    wide = big.groupBy("grp").agg(F.max("block").alias("last"))
    asked = few.join(wide, "grp").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    asked = asked.select("doc_id", "node", "known", "grp", F.col("block").alias("side_a"), (-1 - F.col("other")).alias("side_b"), F.col("block").alias("block"))
    parts = few.groupBy("grp").agg(F.max("few").alias("few"))
    all_of = big.join(parts, "grp").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("few") - 1)))
    all_of = all_of.select("doc_id", "node", "known", "grp", F.col("other").alias("side_a"), (-1 - F.col("block")).alias("side_b"), (-1 - F.col("block")).alias("block"))
    return links.unionByName(scanned(asked.unionByName(all_of)))


def jaccard_classes(docs: DataFrame, similar=SIMILAR, shingle: int = SHINGLE, broadcast_bytes: int = BROADCAST_BYTES, block_sets: int = BLOCK_SETS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""

    def describe(batches):
        for piece, texts in slices(batches, limit=SLICE_BYTES):
            sets = shingle_sets(texts, shingle)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array(node_ids(sets))], names=["doc_id", "n_shingles", "node"])

    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sets = materialise(docs.mapInArrow(describe, "doc_id long, n_shingles long, node long"), "sets")
    total = sets.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    buckets = max(8, -(-total // BUCKET_ELEMENTS))
    named_docs = docs.filter("doc_id is not null")
    common = docs.sparkSession.sparkContext.broadcast(commonness(named_docs, total, shingle))
    edges = materialise(met_nodes(named_docs, buckets, similar, shingle, common).distinct(), "met")
    common.destroy()  # the table of edges outlives it
    release()
    full = sets.filter("doc_id is not null and n_shingles > 0").select("doc_id", "n_shingles", "node")
    reps = materialise(full.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.count("*").alias("copies")), "reps")
    same = full.select("doc_id", "node").distinct().groupBy("doc_id").agg(F.min("node").alias("b"), F.count("*").alias("c")).filter("c > 1").select("doc_id", "b")
    sure = edges.filter("not open").select(F.col("node").alias("a"), F.col("first").alias("b"))
    sure = sure.unionByName(full.select("doc_id", F.col("node").alias("a")).distinct().join(same, "doc_id").select("a", "b"))
    groups = connected_components(edges.filter("open").select("node", "first")).select("node", F.col("component").alias("grp"))
    lists = edges.filter("open").select("key", F.explode(F.array("node", "first")).alias("node")).distinct()
    links = linked(named_docs, groups.join(reps, "node").select("doc_id", "node", "n", "grp"), sure, lists, similar, shingle, broadcast_bytes, block_sets)
    parts = connected_components(links).select("node", "component")
    classes = parts.join(reps, "node").groupBy("component").agg(F.min("doc_id").alias("component_id")).join(parts, "component").select("node", "component_id")
    # only sets with copies or links have to tell their documents; each does so once per salt, so copies of one set are dealt over as many tasks
    named = reps.join(classes, "node", "left").filter("copies > 1 or component_id is not null").select("node", F.coalesce("component_id", "doc_id").alias("component_id"))
    named = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    told = sets.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit("salt")), F.lit(SALTS)).cast("int")).join(named, ["node", "salt"], "left")
    return told.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, similar=SIMILAR, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without the documents that are linked, over any number of links, with one of a smaller doc_id.

    Documents with the empty set and rows with a null doc_id stay; rows with one doc_id are
    one document and stay or go together.
    """
    classes = jaccard_classes(docs, similar, shingle)
    gone = classes.filter("doc_id is not null and component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


def oracle_sql() -> str:
    """DuckDB: links by counting shared shingles, components by a recursive closure over copies' representatives."""
    return r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END)) AS s FROM w),
c AS (SELECT min(doc_id) AS rep, s, len(s) AS n FROM g WHERE len(s) > 0 GROUP BY s),
e AS (SELECT rep, n, unnest(s) AS x FROM c),
p AS (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(n, m) AS (SELECT rep, rep FROM c UNION SELECT r.n, l.b FROM r JOIN l ON r.m = l.a),
k AS (SELECT n, min(m) AS component_id FROM r GROUP BY n)
SELECT g.doc_id, CAST(len(g.s) AS BIGINT) AS n_shingles, coalesce(k.component_id, g.doc_id) AS component_id FROM g LEFT JOIN c ON g.s = c.s LEFT JOIN k ON k.n = c.rep"""
