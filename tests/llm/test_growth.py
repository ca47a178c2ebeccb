"""What operators write and send as their input grows."""

import random

import numpy as np
from pyspark.sql import functions as F

from textloom.llm import hard_negatives, ngram_join


def test_candidates_that_percolate_by_chance_are_parted(spark, monkeypatch):
    """Sets that have a rare shingle with some others each are one group by lists; before, each text was then read once for every block of it."""
    rng = random.Random(4)
    texts = [[rng.choice("abcdefghijkl") for _ in range(40)] for _ in range(240)]
    for i in range(0, 240, 12):  # near copies, one word off at the end: linked; and some that differ too much
        texts += [[*texts[i][:-1], f"last{i}"], [*texts[i][:20], *(f"z{i}y{j}" for j in range(20))]]
    texts += [[*(f"c{j}" for j in range(40)), f"end{i}"] for i in range(50)]  # more near copies than a list pairs
    sets = [{tuple(t[k : k + 3]) for k in range(len(t) - 2)} for t in texts]
    root = list(range(len(sets)))
    for j in range(len(sets)):
        for i in range(j):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root = [root[i] if x == root[j] else x for x in root]
    least = {r: min(i for i, x in enumerate(root) if x == r) for r in set(root)}
    dealt, write = [], ngram_join.materialise

    def seen(df, label):
        out = write(df, label)
        if label == "dealt":
            dealt.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "materialise", seen)
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_classes(frame, (80, 100), 3, block_sets=16).collect()}
    assert got == {i: least[r] for i, r in enumerate(root)} and sum(i != c for i, c in got.items()) == 20 + 49
    assert sum(dealt) < 2 * len(texts)


def test_anchors_are_sent_once_a_pile_and_never_broadcast(spark, monkeypatch):
    """Before, all anchors times all blocks were one side of a broadcast join, whose size Spark took for that of the anchors alone."""
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(0.05, 0.1, (600, 6))).astype(np.int64)
    label, plans, sent = rng.integers(0, 3, 600), [], []

    def positives(met, *more):
        plans.append(met._jdf.queryExecution().executedPlan().toString())
        sent.append(met.filter("kind = 'group'").count() if "kind" in met.columns else met.count())
        return found(met, *more)

    found = hard_negatives.positives
    monkeypatch.setattr(hard_negatives, "positives", positives)
    monkeypatch.setattr(hard_negatives, "PILES", 2, raising=False)
    frame = spark.createDataFrame([(i, int(label[i]), (x[i] / 256).tolist()) for i in range(600)], "vec_id long, label int, embedding array<double>")
    rows = hard_negatives.mine(hard_negatives.whole_vectors(frame, "vec_id", "embedding", F.col("label")), F.col("id") % 50 == 0, block_rows=20, group_anchors=3, cells=8).collect()
    want = []
    for a in range(0, 600, 50):
        order = sorted((int(-(x[i] @ x[a])), i) for i in range(600) if i != a)
        for s, p in [(-s, i) for s, i in order if label[i] == label[a]][:5]:
            met = [(-t, i) for t, i in order if label[i] != label[a] and 50 * s <= -100 * t <= 95 * s][:3]
            want += [(a, p, r + 1, i, s, t) for r, (t, i) in enumerate(met)]
    assert sorted(tuple(r)[:6] for r in rows) == sorted(want) and len(want) > 100
    assert "Broadcast" not in plans[0] and sent[0] <= 12 * 2  # at most 12 groups and two piles; 30 blocks


def test_bounds_beyond_exact_doubles():
    rng = np.random.default_rng(6)
    block = hard_negatives.Block.__new__(hard_negatives.Block)
    x = rng.integers(-(1 << 26), 1 << 26, (300, 40))
    block.cells, block.low, block.high = hard_negatives._cut(x, 16)
    low, high = block.bounds(x[:9])
    for q, a, b in zip(x, low, high, strict=False):
        own, least, most = np.zeros(300, np.int64), np.zeros(300, np.int64), q @ x.T
        for d, code in enumerate(block.cells):
            sides = np.stack([q[d] * block.low[d][code], q[d] * block.high[d][code]])
            own, least = own + sides.min(axis=0), least + sides.max(axis=0)
        assert (a == own).all() and (b == least).all() and (a <= most).all() and (most <= b).all()
