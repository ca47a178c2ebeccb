"""Approximate nearest neighbours by largest inner product: a hierarchical k-means tree.

The tree is fitted on a bounded sample (``SAMPLE``); every vector is put in a leaf of it. A
query goes through the tree best bin first: a priority queue holds the unopened nodes by
inner product with their centres, the best is opened, and leaves are visited in the order
in which they come out. The number of visits is widened until the recall of calibration
queries, measured against brute force over all rows, reaches ``TARGET``.

Queries and vectors meet by part. Neighbouring leaves share a part of bounded size, and a
query goes there once, with the list of the leaves that it visits; a leaf above that size is
dealt over parts by hash, so one leaf with a third of all vectors is many tasks. Parts grow
with the table up to ``PARTS[1]`` vectors, so that copies of queries grow slower than rows.
Within a part a leaf's vectors are compared with its visitors only. Scores of the nearest are
computed again, one product at a time, in double precision on the original vectors, and the
parts' best are merged by window. The recall that calibration measured comes with each row.

Defined results: vectors that are null, zero, or hold null or non-finite components, and
rows with a null id, take no part, nor do those whose length isn't the most frequent one
(ties: the shortest). Ties of score go to the smaller id. Rows with one id are candidates
each on their own, but never for that id. With fewer candidates than asked for, all come.
An empty table gives an empty table; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm._text import bounded_parts, mix
from textloom.session import materialise, table

#: Expected rows of the sample that the tree is fitted on (twice as many at most, whatever repeats); children of a node at most.
SAMPLE, BRANCH = 40_000, 16
#: Calibration queries (expected; four times as many at most), and the recall they must reach.
CALIBRATION, TARGET = 150, 0.95
#: Vectors of a part: at least and at most, and the number of parts that lies between.
PARTS = (4096, 65_536, 256)
#: Queries that a task compares at a time.
BLOCK = 512
NEIGHBOURS = 20


class Tree:
    """Centres of all nodes; children of node i are the nodes first[i] .. first[i] + count[i]; leaves have none and a number."""

    def __init__(self, vectors: np.ndarray, leaf: float, branch: int = BRANCH, seed: int = 5):
        """``leaf``: rows of a leaf; a node has as many children as it takes, up to ``branch``."""
        rng = np.random.default_rng(seed)
        centres, first, count, waiting = [vectors.mean(axis=0) if len(vectors) else np.zeros(1)], [0], [0], [(0, np.arange(len(vectors)))]
        while waiting:
            node, rows = waiting.pop()
            if len(rows) <= 1.5 * leaf:
                continue
            made, near = self.split(vectors[rows], int(np.clip(np.ceil(len(rows) / leaf), 2, branch)), rng)
            if len(made) < 2:
                continue
            first[node], count[node] = len(centres), len(made)
            for k, c in enumerate(made):
                waiting.append((len(centres), rows[near == k]))
                centres.append(c), first.append(0), count.append(0)
        self.centres, self.first, self.count = np.array(centres), np.array(first), np.array(count)
        self.number = np.cumsum(self.count == 0) - 1
        self.leaves = int((self.count == 0).sum())

    @staticmethod
    def split(x: np.ndarray, branch: int, rng) -> tuple[np.ndarray, np.ndarray]:
        """k-means; centres without rows are left out (equal vectors can't be split)."""
        centres = x[rng.choice(len(x), min(branch, len(x)), replace=False)]
        for _ in range(10):
            near = ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
            kept = np.unique(near)
            centres = np.stack([x[near == k].mean(axis=0) for k in kept])
        near = ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        kept, near = np.unique(near, return_inverse=True)
        return centres[kept], near

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Each vector's leaf: the nearest child at every level."""
        node, active = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(active := active[self.count[node[active]] > 0]):
            for n in np.unique(node[active]):
                rows = active[node[active] == n]
                c = self.centres[self.first[n] : self.first[n] + self.count[n]]
                node[rows] = self.first[n] + ((c**2).sum(axis=1) - 2 * x[rows] @ c.T).argmin(axis=1)
        return self.number[node]

    def visits(self, q: np.ndarray):
        """Leaves in best-bin-first order."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.count[node]:
                yield int(self.number[node])
                continue
            a = self.first[node]
            for k, s in enumerate((self.centres[a : a + self.count[node]] @ q).tolist()):
                heapq.heappush(queue, (-s, int(a) + k))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def best(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, most: int):
    """For each query the ``most`` best of ``vectors`` (in order of own id): (query row, vector row, score).

    A matrix product finds what can be among the best; the exact score is each pair's own sum.
    """
    rough = queries @ vectors.T
    rough[ids[:, None] == own[None, :]] = -np.inf
    n = rough.shape[1]
    least = np.partition(rough, max(0, n - most), axis=1)[:, max(0, n - most)] if n > most else np.full(len(rough), -np.inf)
    slack = 1e-9 * (np.abs(queries).sum(axis=1) * np.abs(vectors).max(initial=0) + 1e-300)
    q, v = np.nonzero((rough >= (least - slack)[:, None]) & (rough > -np.inf))
    exact = (queries[q] * vectors[v]).sum(axis=1)
    by = np.lexsort((own[v], -exact, q))
    q, v, exact = q[by], v[by], exact[by]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    keep = rank < most
    return q[keep], v[keep], exact[keep]


def best_of(parts: list, most: int) -> tuple:
    """Each query's best of gathered (query ids, vector ids, scores)."""
    q, v, s = (np.concatenate(c) for c in zip(*parts, strict=True))
    by = np.lexsort((v, -s, q))
    q, v, s = q[by], v[by], s[by]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < most
    return q[keep], v[keep], s[keep]


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part."""
    rows = rows.select(F.col("vec_id").cast("long"), "embedding")
    if "double" not in rows.schema["embedding"].dataType.simpleString() and "float" not in rows.schema["embedding"].dataType.simpleString():
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    finite = F.forall(F.col("embedding").cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    length = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("embedding") == (length["n"] if length else 0))


def brute_force(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, most: int, tree: Tree) -> DataFrame:
    """The nearest of each task's rows to a bounded set of queries: query, vec_id, leaf, score."""
    given = rows.sparkSession.sparkContext.broadcast((ids, queries, tree))

    def search(batches):
        ids, queries, tree = given.value
        for batch in batches:
            own, x = batch.column("vec_id").to_numpy(), matrix(batch.column("embedding"))
            if len(own):
                by = np.argsort(own, kind="stable")
                q, v, s = best(queries, ids, x[by], own[by], most)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(own[by][v]), pa.array(tree.assign(x[by][v])), pa.array(s)], names=["query_id", "vec_id", "leaf", "score"])

    return rows.mapInArrow(search, "query_id long, vec_id long, leaf long, score double")


def ranked(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def calibrate(rows: DataFrame, tree: Tree, ids: np.ndarray, queries: np.ndarray, most: int, target: float) -> tuple[int, float]:
    """The least number of leaf visits with which the queries' recall reaches the target, and that recall."""
    truth = ranked(brute_force(rows, ids, queries, most, tree), most).select("query_id", "leaf").collect()
    place = {}
    for i, q in zip(ids.tolist(), queries, strict=True):
        place[i] = {leaf: k + 1 for k, leaf in enumerate(tree.visits(q))}
    needed = np.sort([place[r["query_id"]][r["leaf"]] for r in truth])
    if not len(needed):
        return tree.leaves, 1.0
    visits = int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)])
    return visits, float(np.searchsorted(needed, visits, "right") / len(needed))


class Plan:
    """Which parts hold the vectors of each leaf, and how many leaves a query visits."""

    def __init__(self, tree: Tree, sizes: np.ndarray, part: int, visits: int, most: int):
        self.tree, self.sizes, self.visits, self.most = tree, sizes, visits, most
        self.count = np.maximum(1, -(-sizes // part))
        self.first = np.zeros(len(sizes), np.int64)
        number, room = -1, 0
        for leaf in range(len(sizes)):  # leaves are numbered in order of the tree, so neighbours are near each other
            if self.count[leaf] > 1:
                self.first[leaf], number, room = number + 1, number + int(self.count[leaf]), 0
            else:
                if sizes[leaf] > room:
                    number, room = number + 1, part
                self.first[leaf], room = number, room - int(sizes[leaf])

    def parts_of(self, leaves: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The part of each vector of the given leaves; ``rows``: hashes."""
        return self.first[leaves] + (rows % self.count[leaves].astype(np.uint64)).astype(np.int64)

    def asked(self, q: np.ndarray) -> dict[int, list[int]]:
        """The leaves that a query visits, by part."""
        seen, found = 0, {}
        for k, leaf in enumerate(self.tree.visits(q)):
            if k >= self.visits and seen > self.most:
                break
            seen += self.sizes[leaf]
            if self.sizes[leaf]:
                for p in range(int(self.first[leaf]), int(self.first[leaf] + self.count[leaf])):
                    found.setdefault(p, []).append(leaf)
        return found


def prepare(rows: DataFrame, every: int, most: int, sample: int, calibration: int, target: float) -> tuple[Tree, int, float, int]:
    """Of usable rows: a tree fitted on a sample, the visits that a query makes, the recall measured with them, and the number of rows."""
    is_query = F.pmod(F.col("vec_id"), F.lit(every)) == 0
    n, n_queries = rows.agg(F.count("*"), F.count_if(is_query)).first()
    key = lambda salt, *of: F.pmod(F.xxhash64(F.lit(salt), *of), F.lit(1 << 30))
    draw = lambda salt, share, *of: key(salt, *of) < F.lit(int((1 << 30) * min(1.0, share)))
    of_row = ("vec_id", "embedding")  # rows that share an id are drawn apart
    got = rows.filter(draw("tree", sample / max(1, n), *of_row)).orderBy(key("tree", *of_row), "vec_id").limit(2 * sample).toPandas().sort_values("vec_id", kind="stable")
    vectors = np.array(got["embedding"].tolist(), float) if len(got) else np.zeros((0, 1))
    tree = Tree(vectors, leaf=max(4.0, len(vectors) / max(1.0, n**0.5)))  # as many leaves as a leaf has rows
    asked = rows.filter(is_query & draw("calibrate", calibration / max(1, n_queries), "vec_id")).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).orderBy("vec_id").limit(4 * calibration).toPandas()
    if not len(asked):
        return tree, tree.leaves, 1.0, n
    return tree, *calibrate(rows, tree, asked["vec_id"].to_numpy(np.int64), np.array(asked["embedding"].tolist(), float), most, target), n


def nearest(rows: DataFrame, every: int, most: int = NEIGHBOURS, sample: int = SAMPLE, calibration: int = CALIBRATION, target: float = TARGET, part: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score, recall for the rows whose vec_id is divisible by ``every``, against all rows."""
    spark = rows.sparkSession
    rows = usable(rows)
    tree, visits, recall, n = prepare(rows, every, most, sample, calibration, target)
    given, shape = spark.sparkContext.broadcast(tree), rows.schema["embedding"].dataType.simpleString()

    def put(batches):
        tree = given.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(tree.assign(matrix(batch.column("embedding"))) if batch.num_rows else np.zeros(0, np.int64)), batch.column("vec_id"), batch.column("embedding")], names=["leaf", "vec_id", "embedding"])

    leaves = materialise(rows.mapInArrow(put, f"leaf long, vec_id long, embedding {shape}"), "leaves")
    sizes = np.zeros(max(1, tree.leaves), np.int64)
    for r in leaves.groupBy("leaf").count().collect():  # bounded by the sample, as the leaves are
        sizes[r["leaf"]] = r["count"]
    plan = spark.sparkContext.broadcast(Plan(tree, sizes, part or int(np.clip(n // PARTS[2], *PARTS[:2])), visits, most))
    names = ["part", "kind", "leaf", "visited", "vec_id", "embedding"]

    def deal(batches):
        plan = plan_of.value
        for batch in batches:
            leaf, ids = batch.column("leaf").to_numpy(), batch.column("vec_id").to_numpy()
            parts = plan.parts_of(leaf, mix(ids.astype(np.uint64) + np.arange(len(ids), dtype=np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(parts), pa.array(np.zeros(len(ids), np.int8)), batch.column("leaf"), pa.nulls(len(ids), pa.binary()), batch.column("vec_id"), batch.column("embedding")], names=names)

    def visit(batches):
        plan = plan_of.value
        for batch in batches:
            row, part, visited = [], [], []
            for i, q in enumerate(matrix(batch.column("embedding"))):
                for p, own in plan.asked(q).items():
                    row.append(i), part.append(p), visited.append(np.array(own, np.int32).tobytes())
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(np.ones(len(row), np.int8)), pa.nulls(len(row), pa.int64()), pa.array(visited, pa.binary()), batch.column("vec_id").take(at), batch.column("embedding").take(at)], names=names)

    plan_of, kind = plan, f"part long, kind tinyint, leaf long, visited binary, vec_id long, embedding {shape}"
    asking = rows.filter(F.pmod(F.col("vec_id"), F.lit(every)) == 0).mapInArrow(visit, kind)
    stored = leaves.mapInArrow(deal, kind)

    def compared(held, ids, x, visited):
        """The best that a block of queries finds in a part: each leaf with its visitors."""
        leaf, own, vectors = held
        lists = [np.frombuffer(v, np.int32) for v in visited]
        who, where = np.repeat(np.arange(len(ids)), [len(v) for v in lists]), np.concatenate(lists)
        by = np.argsort(where, kind="stable")
        who, where = who[by], where[by]
        found = [(ids[:0], own[:0], np.zeros(0))]
        for k in np.unique(where):
            a, b = np.searchsorted(leaf, k), np.searchsorted(leaf, k, "right")
            if a == b:
                continue
            asks = who[np.searchsorted(where, k) : np.searchsorted(where, k, "right")]
            q, v, s = best(x[asks], ids[asks], vectors[a:b], own[a:b], most)
            found.append((ids[asks][q], own[a:b][v], s))
        return best_of(found, most)

    def search(batches):
        key, held, ready = None, [], None
        for batch in batches:
            parts, kinds = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.concatenate([[0], np.nonzero((parts[1:] != parts[:-1]) | (kinds[1:] != kinds[:-1]))[0] + 1, [len(parts)]])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                ids, x = batch.column("vec_id").slice(a, b - a).to_numpy(), matrix(batch.column("embedding").slice(a, b - a))
                if parts[a] != key:
                    key, held, ready = parts[a], [], None
                if kinds[a] == 0:
                    held.append((batch.column("leaf").slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.int64), ids, x))
                    continue
                if ready is None:
                    if not held:
                        continue
                    leaf, own, vectors = (np.concatenate(c) for c in zip(*held, strict=True))
                    by = np.lexsort((own, leaf))
                    ready, held = (leaf[by], own[by], vectors[by]), []
                visited = batch.column("visited").slice(a, b - a).to_pylist()
                for i in range(0, len(ids), BLOCK):
                    got = compared(ready, ids[i : i + BLOCK], x[i : i + BLOCK], visited[i : i + BLOCK])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], names=["query_id", "vec_id", "score"])

    many = int(plan.value.first[-1] + plan.value.count[-1])
    met = stored.union(asking).repartition(bounded_parts(max(many, 1)), "part").sortWithinPartitions("part", "kind")
    found = ranked(met.mapInArrow(search, "query_id long, vec_id long, score double"), most)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", F.lit(recall).alias("recall"))


def op3_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), every=20)
