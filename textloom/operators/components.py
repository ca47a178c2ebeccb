"""Connected components of an edge table, without a driver-side graph.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014). Minimum neighbours are found by a partial aggregate and
joined back. Nodes with more than ``HUB`` edges, and more than one in ``HUBS`` of all, are
joined back by broadcast (there can't be more than 2 * ``HUBS`` of these), so that a node
with a huge number of neighbours is never gathered in one task. Each round is written to the
shared folder, which cuts the lineage, and the round before is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import discard, materialise

#: Rounds before the loop is taken to be stuck; the algorithm needs O(log² n) of them.
ROUNDS = 60
#: Edges of a node from which it is a hub, and the share of all edges that it must have: one in so many.
HUB, HUBS = 4096, 5000


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """u, v, m (the least neighbour of u) of every edge."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    most = max(HUB, total // HUBS)
    if total <= most:
        return edges.join(least.select("u", "m"), "u")
    marked = edges.join(F.broadcast(least.filter(F.col("n") > most).select("u", F.col("m").alias("hub"))), "u", "left")
    rest = marked.filter("hub is null").select("u", "v").join(least.select("u", "m"), "u")
    return marked.filter("hub is not null").select("u", "v", F.col("hub").alias("m")).unionByName(rest)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, 2 * total).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    moved = _with_least(edges, total).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(edges.groupBy("u").agg(F.min("v").alias("v"))).distinct()


def connected_components(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """node, component (its smallest node) for every node of ``edges`` (two columns of the same orderable type).

    Null ends and loops are dropped, repeated edges count once; without edges there are no rows.
    """
    a, b = edges.columns
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    edges, seen = materialise(edges, "components"), None
    total = edges.count()
    for _ in range(rounds):
        after = materialise(_small_star(_large_star(edges, total), total), "components")
        discard(edges)
        edges = after
        # wrapping sum over a hash of every edge: the same set of edges twice in a row means that all are stars
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if state == seen or not state[0]:
            break
        seen, total = state, max(1, state[0])
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
