"""Hard-negative mining with a vector-approximation file.

Vectors are whole numbers (floor of ``SCALE`` times each component). They are dealt into
blocks of some ``BLOCK_ROWS`` rows; within a block each dimension is cut into ``CELLS`` cells
of about equally many rows, and a row is approximated by its cells, a byte each. An anchor
makes a table of the least and the greatest product of each cell, so that a row's score is
bounded from below and from above by looking its cells up. Only rows whose bounds leave them
in question are scored exactly.

First the positives: rows of an anchor's label that may be among its ``POSITIVES`` best of a
block (upper bound not below that many lower bounds). The blocks' best are merged. Then each
anchor returns with its positives' scores, which give windows of negative scores; a block's
rows of other labels whose bounds meet a window, and which as many surely better rows in the
window don't exclude, are scored, and the blocks' first in each window are merged.

Anchors are a stated query set: each group of ``GROUP_ANCHORS`` of them meets each block once.
Blocks and groups are dealt by a hash of the row, so one label, id or vector with a third of
all rows is spread like any others. Blocks are put on piles, whose number is fixed until a
pile has ``HELD`` of them; a task holds a pile's blocks while the groups pass one by one, so
an anchor is sent once for each pile, and nothing is broadcast. Scores of all anchors with all
rows are bounded, which is as many as both multiplied.

Defined results: rows with a null id, label or vector, with a null or non-finite component, or
with one beyond ``MOST`` take no part. Rows are compared with rows of the same number of
components only. An anchor is no positive or negative of itself nor of rows with its id; rows
that share an id are anchors and candidates each on their own, repeated rows as well, so their
results repeat. Ties of score go to the smaller id, then to the earlier row. Without positives
or negatives an anchor gives no row. An empty table gives an empty table; further columns,
whatever their names, are not read.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm._text import MOST_PARTS, release
from textloom.session import materialise, table

#: Whole numbers that a component of 1 is cut into, and components of these at most (products of 2^9 such still fit in a long).
SCALE, MOST = 256, 1 << 26
#: Rows of a block, anchors of a group, and how many of them are bounded at a time.
BLOCK_ROWS, GROUP_ANCHORS, ANCHORS = 4096, 256, 64
#: Piles of blocks, unless one of them had more blocks than a task holds.
PILES, HELD = 64, 16
#: Cells of a dimension, at most 256.
CELLS = 64
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these hundredths of its positive's.
LOW, HIGH = 50, 95

PACKED = "kind string, part int, n int, dims int, row binary, id binary, label binary, vector binary, cells binary, low binary, high binary"
POSITIVE = "anchor_row long, anchor_id long, row long, id long, score long, rank int"
NEGATIVE = "anchor_row long, anchor_id long, positive int, row long, negative_id long, negative_score long, scored long"


def whole_vectors(rows: DataFrame, key: str, vector: str, label: Column, scale: int = SCALE) -> DataFrame:
    """row, id, label, dims, vector (whole numbers) of the rows that take part."""
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * scale))
    sound = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) * scale < MOST))
    kept = rows.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.size(vector).alias("dims"), F.when(sound, x).alias("vector"))
    return kept.filter("id is not null and label is not null and vector is not null and dims > 0").withColumn("row", F.monotonically_increasing_id())


def _cut(x: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """cells (dims x rows, a byte each), and the least and greatest whole number of each cell (dims x cells)."""
    n, dims = x.shape
    code, low, high = np.zeros((dims, n), np.uint8), np.zeros((dims, cells), np.int64), np.zeros((dims, cells), np.int64)
    at = (np.arange(1, cells) * n) // cells
    for d in range(dims):
        column = x[:, d]
        ordered = np.sort(column)
        edges = np.unique(ordered[at])
        edges = edges[edges > ordered[0]]
        code[d] = np.searchsorted(edges, column, "right")
        k = len(edges) + 1
        low[d, 0], low[d, 1:k], high[d, : k - 1], high[d, k - 1] = ordered[0], edges, edges - 1, ordered[-1]
    return code, low, high


def pack(rows: DataFrame, kind: str, parts: int, cells: int) -> DataFrame:
    """Rows dealt into ``parts``: per part and number of components one packed row, with cells unless ``cells`` is 0."""

    def build(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        dims = group.column("dims")[0].as_py()
        x = group.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, dims)
        order = np.lexsort((group.column("row").to_numpy(), group.column("id").to_numpy()))
        x = x[order]
        made = [a.tobytes() for a in _cut(x, cells)] if cells else [None] * 3
        columns = [group.column(c).to_numpy()[order].astype(np.int64).tobytes() for c in ("row", "id", "label")]
        values = [kind, group.column("part")[0].as_py(), len(x), dims, *columns, x.astype(np.int32).tobytes(), *made]
        types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 7]
        return pa.table({f.split()[0]: pa.array([v], t) for f, v, t in zip(PACKED.split(", "), values, types, strict=True)})

    return rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")).groupBy("part", "dims").applyInArrow(build, PACKED)


class Block:
    """A packed row opened again."""

    def __init__(self, packed: dict):
        of = lambda c, kind, *shape: np.frombuffer(packed[c], kind).reshape(*shape)
        n, dims = packed["n"], packed["dims"]
        self.row, self.id, self.label = (of(c, np.int64, n) for c in ("row", "id", "label"))
        self.vector = of("vector", np.int32, n, dims)
        if packed.get("cells") is not None:
            self.cells, self.low, self.high = of("cells", np.uint8, dims, n), of("low", np.int64, dims, -1), of("high", np.int64, dims, -1)

    @cached_property
    def spread(self) -> tuple[np.ndarray, np.ndarray]:
        """The sum and the difference of the greatest and the least number of each row's cells (dims x rows)."""
        low, high = (np.take_along_axis(x, self.cells.astype(np.int64), axis=1) for x in (self.low, self.high))
        return (high + low).astype(np.float64), (high - low).astype(np.float64)

    def bounds(self, q: np.ndarray, rows: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest score of ``rows`` with ``q``, one anchor or several, from the cells alone."""
        q, (twice, apart) = q.astype(np.int64), (x[:, rows] for x in self.spread)
        if len(twice) * int(np.abs(q).max(initial=0)) * int(max(np.abs(twice).max(initial=0), apart.max(initial=0))) < 1 << 53:  # exact as doubles
            middle, around = (q.astype(np.float64) @ twice).astype(np.int64), (np.abs(q).astype(np.float64) @ apart).astype(np.int64)
        else:
            middle, around = q @ twice.astype(np.int64), np.abs(q) @ apart.astype(np.int64)
        return (middle - around) // 2, (middle + around) // 2

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        return self.vector[rows].astype(np.int64) @ q.astype(np.int64)

    def best(self, rows: np.ndarray, q: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The first of ``rows`` by exact score (rows stand in order of id), and their scores."""
        score = self.scores(rows, q)
        order = np.argsort(-score, kind="stable")[:most]
        return rows[order], score[order]


def _largest(x: np.ndarray, k: int):
    """The k-th largest; None if there are fewer."""
    return np.partition(x, len(x) - k)[len(x) - k] if len(x) >= k else None


def nearest_of_label(block: Block, anchors: Block, most: int):
    """For each anchor its place in its group, a block's ``most`` best rows of its label, and their scores."""
    for label in np.unique(anchors.label):
        own, asked = np.flatnonzero(block.label == label), np.flatnonzero(anchors.label == label)
        for some in (asked[k : k + ANCHORS] for k in range(0, len(asked), ANCHORS)):
            lows, highs = block.bounds(anchors.vector[some], own)
            for i, low, high in zip(some.tolist(), lows, highs, strict=True):
                other = block.id[own] != anchors.id[i]
                rows, low, high = own[other], low[other], high[other]
                if len(rows) > most:
                    rows = rows[high >= _largest(low, most)]
                yield i, *block.best(rows, anchors.vector[i], most)


def in_windows(block: Block, q: np.ndarray, anchor_id: int, label: int, windows: list[tuple[int, int]], most: int, bounds: tuple | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """For each window (least and greatest score) a block's first ``most`` rows of other labels and their scores; and how many were scored."""
    low, high = block.bounds(q) if bounds is None else bounds
    found, scored = [], 0
    if not windows:
        return found, scored
    near = np.flatnonzero((high >= min(w[0] for w in windows)) & (low <= max(w[1] for w in windows)) & (block.label != label) & (block.id != anchor_id))
    low, high = low[near], high[near]
    for least, greatest in windows:
        at = np.flatnonzero((high >= least) & (low <= greatest))
        sure = low[at][(low[at] >= least) & (high[at] <= greatest)]
        if (enough := _largest(sure, most)) is not None:
            at = at[high[at] >= enough]
        rows = near[at]
        scored += len(rows)
        score = block.scores(rows, q)
        rows = rows[(score >= least) & (score <= greatest)]
        found.append(block.best(rows, q, most))
    return found, scored


def _met(blocks: DataFrame, groups: DataFrame, parts: int) -> DataFrame:
    """The blocks of each pile, and after them all groups of anchors."""
    piles = max(min(parts, PILES), -(-parts // HELD))
    b = blocks.withColumn("pile", F.pmod("part", F.lit(piles)))
    g = groups.withColumn("pile", F.explode(F.sequence(F.lit(0), F.lit(piles - 1))))
    return b.unionByName(g, allowMissingColumns=True).repartition(min(3 * piles, MOST_PARTS), "pile").sortWithinPartitions("pile", "kind")


def _opened(batches):
    """Each group of anchors, its row's values, and a block of its pile that has as many components."""
    pile, held = None, []
    for batch in batches:
        for row in range(batch.num_rows):
            values = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
            if values["pile"] != pile:
                pile, held = values["pile"], []
            if values["kind"] == "block":
                held.append(Block(values))
                continue
            anchors = Block(values)
            for block in held:
                if block.vector.shape[1] == anchors.vector.shape[1]:
                    yield values, block, anchors


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True) if rows else [[]] * len(fields), fields, strict=True)], names=[f[0] for f in fields])


def positives(met: DataFrame, most: int = POSITIVES) -> DataFrame:
    """anchor_row, anchor_id, row, id, score, rank: each anchor's best rows of its label."""

    def find(batches):
        for _, block, anchors in _opened(batches):
            rows = []
            for i, at, score in nearest_of_label(block, anchors, most):
                rows += [(int(anchors.row[i]), int(anchors.id[i]), int(block.row[j]), int(block.id[j]), int(s), None) for j, s in zip(at, score, strict=True)]
            yield _batch(rows, POSITIVE)
        release()

    order = Window.partitionBy("anchor_row").orderBy(F.desc("score"), "id", "row")
    return met.mapInArrow(find, POSITIVE).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def negatives(met: DataFrame, wanted: str = "wanted", most: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_row, anchor_id, positive (its rank), row, negative_id, negative_score, scored, of each positive's first rows in its window.

    ``met`` has, for each anchor of its group in order, the array of its positives' scores. scored counts what was scored exactly in the row's block.
    """

    def find(batches):
        for values, block, anchors in _opened(batches):
            rows = []
            for k in range(0, len(anchors.id), ANCHORS):
                some = range(k, min(k + ANCHORS, len(anchors.id)))
                for i, *bounds in zip(some, *block.bounds(anchors.vector[k : k + ANCHORS]), strict=True):
                    windows = [(-(-low * s // 100), high * s // 100) for s in values[wanted][i]]
                    found, scored = in_windows(block, anchors.vector[i], anchors.id[i], anchors.label[i], windows, most, bounds)
                    rows += [(int(anchors.row[i]), int(anchors.id[i]), rank + 1, int(block.row[j]), int(block.id[j]), int(s), scored) for rank, (at, score) in enumerate(found) for j, s in zip(at, score, strict=True)]
            yield _batch(rows, NEGATIVE)
        release()

    order = Window.partitionBy("anchor_row", "positive").orderBy(F.desc("negative_score"), "negative_id", "row")
    return met.mapInArrow(find, NEGATIVE).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def mine(rows: DataFrame, anchors: Column, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block_rows: int = BLOCK_ROWS, group_anchors: int = GROUP_ANCHORS, cells: int = CELLS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, scored. ``rows``: of ``whole_vectors``; ``anchors``: which of them ask."""
    rows = materialise(rows, "vectors")
    asked = rows.filter(anchors)
    counts = rows.agg(F.count("*").alias("n"), F.count_if(anchors).alias("asked")).first()
    parts, groups = max(1, -(-counts["n"] // block_rows)), max(1, -(-counts["asked"] // group_anchors))
    blocks, packed = materialise(pack(rows, "block", parts, cells), "blocks"), materialise(pack(asked, "group", groups, 0), "anchors")
    found = materialise(positives(_met(blocks, packed, parts), n_positives), "positives")
    # the windows of a group's anchors, in the order in which the group has them
    place = F.struct("anchor_id", "anchor_row", "scores")
    of_anchor = asked.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id"), "dims", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("part"))
    scores = found.groupBy("anchor_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores"))
    wanted = of_anchor.join(scores, "anchor_row", "left").withColumn("scores", F.coalesce("scores", F.array().cast("array<bigint>")))
    wanted = wanted.groupBy("part", "dims").agg(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["scores"]).alias("wanted"))
    mined = negatives(_met(blocks, packed.join(wanted, ["part", "dims"]), parts), most=n_negatives, low=low, high=high)
    of_positive = found.select("anchor_row", F.col("rank").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = mined.join(of_positive, ["anchor_row", "positive"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "scored")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    # the operator also tells how many rows were scored; the query's columns are those of its SQL
    return mine(whole_vectors(rows, "vec_id", "embedding", label), F.col("id") % 50 == 0).drop("scored")


def oracle_sql() -> str:
    return f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
p AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
q AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT q.anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, p.id AS negative_id, positive_score, p.score AS negative_score
FROM q JOIN p ON q.anchor_id = p.anchor_id AND NOT p.same AND {LOW} * positive_score <= 100 * p.score AND 100 * p.score <= {HIGH} * positive_score
WINDOW w AS (PARTITION BY q.anchor_id, positive_id ORDER BY p.score DESC, p.id) QUALIFY row_number() OVER w <= {NEGATIVES}"""
