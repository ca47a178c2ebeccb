"""History across renames against a walk back by hand."""

import random

from pyspark.sql import functions as F

from textloom.operators import history

LOG = "repo string, seq long, path string, old_path string, ts string, subject string"


def walk(path, log):
    """Commits of a path: back in time, changing the name at each rename."""
    name, found = path, []
    for seq in sorted({r[1] for r in log}, reverse=True):
        rows = [r for r in log if r[1] == seq]
        if any(name in (r[2], r[3]) for r in rows):
            found.append(seq)
        olds = sorted(r[3] for r in rows if r[2] == name and r[3] not in (None, name))
        name = olds[0] if olds else name
    return found


def seen(spark, log, paths):
    df = spark.createDataFrame(log, LOG)
    asked = spark.createDataFrame([("r", p) for p in paths], "repo string, path string")
    got = {}
    for r in history.commits_of(asked, df).collect():
        got.setdefault(r.path, []).append(r.seq)
    for p in paths:
        assert sorted(got.get(p, []), reverse=True) == walk(p, log), p


def row(seq, path, old=None, subject="x"):
    return ("r", seq, path, old, f"t{seq:03}", subject)


def test_swaps_reuse_and_two_renames_of_one_name(spark):
    swap = [row(1, "a"), row(2, "b"), row(3, "b", "a"), row(3, "a", "b"), row(4, "a"), row(5, "t", "a"), row(5, "a", "b"), row(5, "b", "t")]
    seen(spark, swap, ["a", "b", "t"])
    twice = [row(1, "a"), row(2, "b", "a"), row(3, "a"), row(4, "c", "a"), row(5, "a"), row(5, "a"), row(6, "d", "c"), row(7, "d", "d")]
    seen(spark, twice, ["a", "b", "c", "d", "e"])
    assert walk("d", twice) == [7, 6, 4, 3, 2, 1]


def test_random_logs(spark):
    rnd = random.Random(9)
    log = []
    for seq in range(120):
        for _ in range(rnd.randrange(1, 3)):
            log.append(row(seq, rnd.choice("abcdefg"), rnd.choice("abcdefg") if rnd.random() < 0.3 else None))
    seen(spark, log, list("abcdefgz"))


def test_statistics_and_reasons(spark):
    log = spark.createDataFrame([row(1, "x", None, "Bugfix"), row(2, "y", "x", "move"), row(3, "y", None, None), (None, 4, "y", None, "t", "s"), ("r", None, "y", None, "t", "s")], LOG)
    paths = spark.createDataFrame([("r", "y"), ("r", "no"), ("q", "y"), ("r", "d\\z")], "repo string, path string")
    got = {(r.repo, r.path): tuple(r)[2:] for r in history.history(paths, log.filter("repo is not null")).collect()}
    assert got[("r", "y")][:2] == (3, "t003") and abs(got[("r", "y")][2] - 1 / 3) < 1e-9 and got[("r", "y")][3] is None
    assert got[("r", "no")] == (0, None, 0.0, "no commit history for this path") and got[("q", "y")][3] == "not a git repository" and ("r", "d/z") in got
    assert history.history(paths, log.limit(0), paths.select("repo")).filter("reason = 'no commit history for this path'").count() == 4


def test_renames_that_the_log_lacks(spark):
    text = lambda k: "".join(f"{k} {i}\n" for i in range(30))
    log = spark.createDataFrame([("r", 1, "a", None, "added"), ("r", 2, "a", None, "deleted"), ("r", 2, "b", None, "added"), ("r", 3, "c", None, "added"), ("r", 3, "e", "d", "renamed"), ("r", 4, "b", None, "deleted"), ("r", 5, "f", None, "added")], "repo string, seq long, path string, old_path string, status string")
    contents = spark.createDataFrame([("r", 1, "a", text("a")), ("r", 2, "a", text("a")), ("r", 2, "b", text("a") + "more\n"), ("r", 3, "c", text("a")), ("r", 4, "b", text("a")), ("r", 5, "f", text("a"))], "repo string, seq long, path string, content string")
    got = {(r.seq, r.path): r.old_path for r in history.with_renames(log, contents).collect()}
    assert got == {(1, "a"): None, (2, "a"): None, (2, "b"): "a", (3, "c"): None, (3, "e"): "d", (4, "b"): None, (5, "f"): None}  # a rename is one commit's
    asked = spark.createDataFrame([("r", "b")], "repo string, path string")
    assert {r.seq for r in history.commits_of(asked, history.with_renames(log, contents).withColumn("ts", F.lit("t"))).collect()} == {1, 2, 4}
