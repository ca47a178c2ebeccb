"""Kept tables against what batch queries give, whatever order rows come in and however often a stream starts."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from textloom.operators import records
from textloom.streaming import kept as k
from textloom.streaming.scan import stream_table

LOG = "repo string, seq long, path string, old_path string, ts string, subject string, arrived_at timestamp"


def folder():
    return tempfile.mkdtemp(prefix="textloom-kept-")


def feed(spark, root, rows, schema, updates):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    found = updates(stream_table(spark, f"{root}/in"))
    k.keep(found, f"{root}/table").awaitTermination()
    return found.schema


def commits(n, seed):
    rnd, import_time = random.Random(seed), __import__("datetime").datetime
    rows = [(rnd.choice(["r", "s", None]), rnd.randrange(40), rnd.choice(["a", "b", "c", None]), rnd.choice([None, None, "a", "z"]), None, rnd.choice(["Bugfix", "x", None]), import_time(2024, 1, 1, i // 60 % 24, i % 60)) for i in range(n)]
    return [(r, None if i % 17 == 0 else s, p, o, f"t{s:03}", f"{'fix' if s % 3 == 0 else 'x'}" if s % 5 else None, at) for i, (r, s, p, o, _, _, at) in enumerate(rows)]


def stats(log):
    seen = {}
    for r, s, p, o, ts, subject, _ in log:
        if s is not None and p is not None:
            for name in {p, o} - {None}:
                seen.setdefault((r, name), {})[s] = (ts, subject is not None and "fix" in subject)
    return {key: (len(of), of[max(of)][0], sum(f for _, f in of.values()) / len(of)) for key, of in seen.items()}


def history_of(spark, root, schema):
    return {(r.repo, r.path): tuple(r)[2:] for r in k.kept_history(k.kept(spark, f"{root}/table", schema, k.HISTORY_KEY)).collect()}


@pytest.mark.parametrize("bounded", [False, True])
def test_history_over_files_restarts_and_lost_triggers(spark, bounded):
    root, log = folder(), commits(240, 4)
    updates = (lambda rows: k.history_updates(rows, arrived="arrived_at", repeats_within="10 days")) if bounded else k.history_updates
    for i in range(0, 180, 60):
        schema = feed(spark, root, log[i : i + 60], LOG, updates)
    assert history_of(spark, root, schema) == stats(log[:180])
    # a trigger that wrote its rows and was lost before it was committed: readers don't see it, and it is done again over its rows
    system = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    last = max(k._numbers(spark, f"{root}/table/progress/commits"))
    system.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/table/progress/commits/{last}"), False)
    if not bounded:  # with a watermark the last trigger is one without rows
        assert history_of(spark, root, schema) != stats(log[:180])
    schema = feed(spark, root, log[180:], LOG, updates)
    assert history_of(spark, root, schema) == stats(log)
    k.fold(spark, f"{root}/table", schema, k.HISTORY_KEY)
    assert history_of(spark, root, schema) == stats(log) and not k._numbers(spark, f"{root}/table/updates")
    late = [("r", -5, "a", "old", "t-05", "fix", log[-1][-1]), log[3]]
    feed(spark, root, late, LOG, updates)
    assert history_of(spark, root, schema) == stats(log + late)
    k.fold(spark, f"{root}/table", schema, k.HISTORY_KEY)
    k.fold(spark, f"{root}/table", schema, k.HISTORY_KEY)
    assert history_of(spark, root, schema) == stats(log + late) and len(k._numbers(spark, f"{root}/table/folded")) == 1


def test_importers_of_the_newest_versions(spark):
    root = folder()
    targets = F.flatten(F.transform(records.specifiers(F.col("content")), lambda s: records.module_targets(F.col("path"), s)))
    updates = lambda rows: k.link_updates(rows, "path", "seq", targets)
    one = [("src/a.ts", 1, "import x from './b'"), ("src/c.ts", 2, "import y from '../lib/d.js'\nimport z from 'react'"), (None, 1, "import './b'"), ("src/e.ts", None, "import './b'")]
    two = [("src/a.ts", 3, "const q = require('./c')"), ("src/c.ts", 1, "import './late'"), ("src/f.ts", 1, "import './b.ts'"), ("src/f.ts", 1, "import './b.ts'")]
    three = [("src/f.ts", 2, None), ("src/g.ts", 1, ""), ("src/a.ts", 2, "import './late'")]
    for rows in (one, two, three):
        schema = feed(spark, root, rows, "path string, seq long, content string", updates)
    links = k.reverse(k.kept(spark, f"{root}/table", schema, ["importer"]))
    newest = spark.createDataFrame([two[0], one[1]], "path string, seq long, content string")
    want = records.module_paths(records.import_edges(newest, "path", "content")).distinct()
    got = sorted((r.target, r.importer) for r in links.collect())
    assert got == sorted((r.target, r.importer) for r in want.collect()) and ("lib/d.js", "src/c.ts") in got and ("src/c.ts", "src/a.ts") in got


def test_nothing_has_come(spark):
    root = folder()
    schema = feed(spark, root, [], LOG, k.history_updates)
    assert history_of(spark, root, schema) == {}
    k.fold(spark, f"{root}/table", schema, k.HISTORY_KEY)
    assert history_of(spark, root, schema) == {}
