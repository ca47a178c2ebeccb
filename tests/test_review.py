import random

from pyspark.sql import functions as F

from textloom.operators import diffs, locate, review

PATCH = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,3 +1,4 @@\n one\n-two\n+TWO\n+\n+more\n three\n@@ -20,2 +21,2 @@\n twenty\n-gone\n+come\n"
TEXT = "one\nTWO\n\nmore\nthree\n" + "\n".join(f"filler number {i}" for i in range(6, 21)) + "\ntwenty\ncome\n"


def frames(spark, comments, schema):
    changes = review.change_sets(spark.createDataFrame([("x.py", PATCH)], "path string, diff string"), "path", "diff")
    files = spark.createDataFrame([("x.py", TEXT), ("plain.py", "alpha\nbeta\n"), ("empty.py", "")], "path string, content string")
    return spark.createDataFrame(comments, schema), changes, files


def test_positions(spark):
    rows = [
        (1, "x.py", "TWO\nmore", None), (2, "x.py", "two", None), (3, "x.py", "filler number 9", None), (4, "x.py", None, 22), (5, "x.py", None, 10), (6, "x.py", "", 99),
        (7, "x.py", "filler numbr 19", None), (8, "x.py", "something else entirely", None), (9, "plain.py", "beta", None), (10, "absent.py", "beta", 3), (11, "x\\y", None, None), (12, "x.py", "twenty\r\n  come", 1), (13, "empty.py", "a", None), (14, None, "a", None),
    ]
    comments, changes, files = frames(spark, rows, "id int, path string, existing_code string, hint_line int")
    got = {r["id"]: (r["start_line"], r["end_line"], r["located_by"]) for r in review.position(comments, changes, files).collect()}
    assert got == {
        1: (2, 4, "text_match"), 2: (2, 2, "text_match"), 3: (9, 9, "text_match"), 4: (22, 22, "hunk_align"), 5: (1, 1, "hunk_align"), 6: (22, 22, "hunk_align"),
        7: (9, 9, "fuzzy_match"), 8: (0, 0, "failed"), 9: (2, 2, "fuzzy_match"), 10: (0, 0, "failed"), 11: (0, 0, "failed"), 12: (21, 22, "text_match"), 13: (0, 0, "failed"), 14: (0, 0, "failed"),
    }


def test_verdicts(spark):
    own = [("x.py", "TWO")]
    rows = [
        (1, "x.py", "TWO", 2, 2, own), (2, "x.py", "three", 5, 5, None), (3, "x.py", "nowhere", 2, 2, []), (4, "x.py", None, 0, 0, None), (5, "gone.py", "a", 1, 1, None),
        (6, "x.py", "TWO\n\nmore", 1, 9, [*own, ("x.py", "absent")]), (7, "x.py", " ", 22, 22, [(None, "TWO")]), (8, "plain.py", "beta", 2, 2, None), (9, "empty.py", "", 1, 1, None), (10, "x.py", "TWO", 2, 2, own),
    ]
    comments, changes, files = frames(spark, rows, "id int, path string, existing_code string, start_line int, end_line int, evidence array<struct<path string, snippet string>>")
    of = lambda df: {r["id"]: r["reason"] for r in df.collect()}
    got = of(review.reflect(comments, changes, files, "id"))
    assert got == {
        1: "passed all checks", 2: "failed: line_in_hunk, existing_code_in_diff", 3: "failed: existing_code_found, existing_code_in_diff", 4: "failed: line_in_hunk", 5: "file not found",
        6: "failed: evidence_valid", 7: "failed: evidence_valid", 8: "failed: line_in_hunk, existing_code_in_diff", 9: "file not found", 10: "passed all checks",
    }
    assert of(review.reflect(comments, changes, files, "id", strict=False))[8] == "passed all checks"
    assert of(review.reflect(comments, changes, files.withColumn("untracked", F.col("path") == "plain.py"), "id"))[8] == "passed all checks"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_fuzzy_against_brute_force(spark):
    rng, cases = random.Random(5), []
    for k in range(60):
        lines = ["".join(rng.choice("ab c") for _ in range(rng.randint(8, 24))).strip() or "a" for _ in range(rng.randint(1, 8))]
        at, n = rng.randrange(len(lines)), rng.randint(1, 2)
        target = ["".join(c if rng.random() > 0.1 else "z" for c in x) for x in lines[at : at + n]]
        cases.append((k, lines, target))
    want = {}
    for k, lines, target in cases:
        ratio = lambda i: sum(map(levenshtein, lines[i : i + len(target)], target)) / sum(max(map(len, p)) for p in zip(lines[i:], target))  # noqa: B023, E731
        want[k] = next((i + 1 for i in range(len(lines) - len(target) + 1) if ratio(i) < 0.15), None)
    df = spark.createDataFrame(cases, "k int, lines array<string>, target array<string>")
    got = {r["k"]: r["at"] for r in df.select("k", locate.locate_fuzzy(F.col("lines"), F.col("target")).alias("at")).collect()}
    assert got == want and len(set(want.values())) > 3


def test_hunks_between(spark):
    hints = spark.createDataFrame([("f", 1), ("f", 12), ("f", 17), ("f", 99), ("f", 31)], "f string, hint int")
    hunks = spark.createDataFrame([("f", 0, 5, 10), ("f", 1, 20, 24), ("f", 2, 30, 33)], "f string, number int, start int, end int")
    got = {r["hint"]: (r["hunk"], r["line"]) for r in locate.align(hints, hunks, ["f"], "hint", "start", "end", "number").collect()}
    assert got == {1: (0, 5), 12: (0, 5), 17: (1, 20), 99: (2, 33), 31: (2, 31)}


def test_targets_and_snapshots(spark):
    files = spark.createDataFrame([("HEAD", "a.py", "1"), ("WORKTREE", "a.py", "2"), ("WORKTREE", "b.py", "x\ny\n"), ("WORKTREE", "c.png", "z"), ("WORKTREE", "d.bin", "\0"), ("b", "a.py", "")], "snapshot string, path string, content string")
    fresh = review.untracked(files)
    assert {r["path"] for r in fresh.collect()} == {"b.py", "c.png", "d.bin"}
    found = review.targets(review.workspace_diffs(spark.createDataFrame([("x.py", PATCH)], "path string, diff string"), fresh).withColumnRenamed("path", "file"), "file", "diff")
    assert {(r["path"], r["additions"], r["deletions"], r["status"], r["outcome"]) for r in found.collect()} == {("x.py", 4, 2, "modified", "kept"), ("b.py", 2, 0, "added", "kept")}
    wanted = spark.createDataFrame([("b", "a.py"), ("HEAD", "a.py"), ("b", "none")], "snapshot string, path string")
    assert {(r["snapshot"], r["path"]): r["content"] for r in review.content_at(wanted, files).collect()} == {("b", "a.py"): "2", ("HEAD", "a.py"): "1", ("b", "none"): None}


def test_nothing_changed(spark):
    none = review.change_sets(spark.createDataFrame([("a", " "), ("b", None)], "path string, diff string"), "path", "diff")
    assert none.count() == 0
    assert diffs.parse(spark.createDataFrame([(1, PATCH)], "id int, d string"), "id", "d").select("old_count", "new_count").distinct().count() == 2
