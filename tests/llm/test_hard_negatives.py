"""Hard negatives and their bounds against brute force."""

import math
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from textloom.llm import hard_negatives as H


def plain(rows, positives=5, negatives=3):
    """rows: (id, label, vector or None); what mine() returns, by loops."""
    sound = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) and abs(x) * 256 < H.MOST for x in v)]
    out = []
    for a, label, q in sound:
        if a % 50:
            continue
        others = sorted(((-sum(x * y for x, y in zip(q, v, strict=True)), i, own) for i, own, v in sound if i != a and len(v) == len(q)), key=lambda x: x[:2])
        for s, p, own in [x for x in others if x[2] == label][:positives]:
            met = [x for x in others if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
            out += [(a, p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(met)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("id", F.lit("clash"))
    found = H.mine(H.whole_vectors(df, "vec_id", "embedding", F.col("label")), F.col("id") % 50 == 0, **more)
    return sorted(tuple(r)[:6] for r in found.collect()), found


def test_odd_rows_ties_and_repeats_over_many_blocks(spark):
    rnd = random.Random(7)
    near = lambda: [rnd.gauss(0.05, 0.1) for _ in range(6)]
    rows = [(i, rnd.choice([1, 1, 1, 2, 3]), near()) for i in range(400)]
    rows += [(i, label, rows[50][2]) for i, label in ((500, 1), (501, 2), (502, 1), (502, 1), (503, None), (550, 2), (550, 2))]  # copies, repeated rows and anchors
    rows += [(600, 1, None), (601, 1, []), (602, 1, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (603, 2, [math.nan] * 6), (604, 2, [math.inf, 0.0, 0.0, 0.0, 0.0, 0.0]), (None, 1, near()), (605, 1, [1e300] * 6)]
    rows += [(700, 1, [0.5, 0.5]), (701, 1, [0.9, 0.9]), (702, 2, [0.4, 0.6]), (703, 2, [0.0, 0.0]), (750, 9, near()), (800, 4, [-0.5, -0.5]), (801, 4, [0.5, 0.5])]
    got, found = mined(spark, rows, block_rows=60, group_anchors=3, cells=8)
    assert got == plain(rows) and any(r[0] == 700 for r in got) and len(got) > 60
    assert mined(spark, rows, block_rows=60, group_anchors=3, cells=256)[0] == got == mined(spark, rows)[0]
    assert mined(spark, [])[0] == [] and found.columns[-1] == "scored"


def test_bounds_hold_and_leave_few_rows_in_question():
    rng = np.random.default_rng(2)
    x = np.floor(256 * rng.normal(0, 0.125, (3000, 32))).astype(np.int64)
    code, low, high = H._cut(x, 64)
    block = H.Block.__new__(H.Block)
    block.cells, block.low, block.high, block.vector = code, low, high, x
    block.id, block.label = np.arange(3000), rng.integers(0, 2, 3000)
    for q in x[:20]:
        a, b = block.bounds(q)
        assert (a <= x @ q).all() and (x @ q <= b).all()
    found, scored = H.in_windows(block, x[0], 0, 0, [(2000, 6000)], 3)
    score = x @ x[0]
    want = sorted((-s, i) for i, s in enumerate(score) if i and block.label[i] and 2000 <= s <= 6000)[:3]
    assert [(-s, i) for i, s in zip(*found[0], strict=True)] == want and scored < 400
    one, least, most = H._cut(np.full((5, 2), 7), 4)  # all rows equal: one cell
    assert (one == 0).all() and (least[:, 0] == 7).all() and (most[:, 0] == 7).all()


def test_the_query_has_the_columns_of_its_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW embeddings AS FROM '/root/testdata/sf0.001/embeddings.parquet'")
    want = con.sql(H.oracle_sql())
    got = H.op12_hard_negatives(spark, "/root/testdata/sf0.001")
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
