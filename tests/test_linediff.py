"""Line diffs: minimal scripts against a plain table, patches that give the new text, renames."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.operators import diffs, linediff


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def seen(old, new):
    a, b = linediff.split_lines(old), linediff.split_lines(new)
    edits = sum(a1 - a0 + b1 - b0 for a0, a1, b0, b1 in linediff.changes(a, b))
    assert edits == len(a) + len(b) - 2 * lcs(a, b)
    diff = linediff.unified("p", "p", old, new)
    assert linediff.apply(old, diff) == new
    marks = [x[0] for x in diff.split("\n") if x and not x.startswith(("---", "+++"))]
    if all(not x.startswith(("--", "++")) for x in a + b):
        assert marks.count("-") + marks.count("+") == edits


@settings(max_examples=300, deadline=None)
@given(st.text("abc\n", max_size=60), st.text("abc\n", max_size=60))
def test_minimal_and_applies(old, new):
    seen(old, new)


@pytest.mark.parametrize("letters, edits", [(3, 400), (40, 400), (4000, 60)])
def test_long_files_beyond_the_greedy_search(letters, edits):
    rnd = random.Random(letters)
    old = [f"{rnd.randrange(letters)}" for _ in range(900)]
    new = list(old)
    for _ in range(edits):
        at = rnd.randrange(len(new))
        new[at : at + rnd.randrange(2)] = [f"{rnd.randrange(letters)}"] * rnd.randrange(3)
    seen("\n".join(old) + "\n", "\n".join(new))
    seen("\n".join(old), "\n".join(reversed(new)) + "\n")


def test_format():
    old = "".join(f"{i}\n" for i in range(1, 21))
    new = old.replace("\n3\n", "\nthree\n").replace("\n18\n", "\n").replace("\n9\n", "\n9\nmore\n")
    assert linediff.unified("a", "a", old, new).split("\n")[1:] == ["--- a/a", "+++ b/a", "@@ -1,12 +1,13 @@", " 1", " 2", "-3", "+three", " 4", " 5", " 6", " 7", " 8", " 9", "+more", " 10", " 11", " 12", "@@ -15,6 +16,5 @@", " 15", " 16", " 17", "-18", " 19", " 20", ""]
    assert linediff.unified("n", "n", None, "x").split("\n")[1:] == ["new file mode 100644", "--- /dev/null", "+++ b/n", "@@ -0,0 +1 @@", "+x", "\\ No newline at end of file", ""]
    assert linediff.unified("n", "n", "x\ny\n", None).split("\n")[1:] == ["deleted file mode 100644", "--- a/n", "+++ /dev/null", "@@ -1,2 +0,0 @@", "-x", "-y", ""]
    assert linediff.unified("n", "n", None, "") == "diff --git a/n b/n\nnew file mode 100644\n"
    assert linediff.unified("a", "b", "x", "x") == "diff --git a/a b/b\nrename from a\nrename to b\n"
    assert "Binary files a/n and b/n differ" in linediff.unified("n", "n", "x\0", "x") and linediff.unified("n", "n", "x", "x") == ""
    with pytest.raises(ValueError):
        linediff.apply("other\n", linediff.unified("n", "n", "x\n", "y\n"))
    with pytest.raises(ValueError):
        linediff.apply("x\0", linediff.unified("n", "n", "x\0", "x"))


def test_snapshots_renames_and_what_the_parser_says(spark):
    text = lambda k, n=40: "".join(f"{k} line {i}\n" for i in range(n))
    before = [("same", text("s")), ("edited", text("e")), ("gone", "other\n"), ("old/a", text("a")), ("old/b", text("a") + text("b")), ("null", None), ("bin", "x\0y"), ("end", "x"), ("empty", "")]
    after = [("same", text("s")), ("edited", text("e").replace("line 7\n", "new\n")), ("fresh", "brand\nnew\n"), ("new/a", text("a")), ("new/b", text("a") + text("b", 38)), ("null", "now\n"), ("bin", "x\0z"), ("end", "x\n"), ("empty", "no more\n")]
    a, b = (spark.createDataFrame(x, "path string, content string") for x in (before, after))
    found = linediff.snapshot_diffs(a, b)
    rows = {(r.old_path, r.new_path): r.diff for r in found.collect()}
    assert set(rows) == {("edited", "edited"), ("gone", None), (None, "fresh"), ("old/a", "new/a"), ("old/b", "new/b"), (None, "null"), ("bin", "bin"), ("end", "end"), ("empty", "empty")}
    for (old, new), diff in rows.items():
        if old != "bin":
            assert linediff.apply(dict(before).get(old), diff) == (dict(after)[new] if new else None)
    parsed = {(r.old_path, r.new_path): (r.insertions, r.deletions, r.is_new, r.is_deleted, r.is_renamed, r.is_binary) for r in diffs.summary(diffs.parse(found.selectExpr("coalesce(new_path, old_path) p", "diff"), "p", "diff"), "p").collect()}
    assert parsed[("edited", "edited")] == (1, 1, False, False, False, False) and parsed[("old/b", "new/b")] == (0, 2, False, False, True, False)
    assert parsed[("gone", "")] == (0, 1, False, True, False, False) and parsed[("bin", "bin")][5] and parsed[("end", "end")][:2] == (1, 1)
    plain = {(r.old_path, r.new_path) for r in linediff.snapshot_diffs(a, b, follow=False).collect()}
    assert ("old/a", None) in plain and (None, "new/a") in plain
    assert linediff.snapshot_diffs(a.limit(0), b).filter("old_path is not null").count() == 0
    done = linediff.patched(a.filter("path = 'edited'").withColumn("patched", a.path), a.content, F.lit(rows["edited", "edited"]))
    assert done.columns == ["path", "content", "patched", "patched", "patch_error"] and done.first()[-2] == dict(after)["edited"]


def test_few_texts_are_held_at_a_time():
    """A batch of Arrow's is thousands of rows; before, all of its texts and diffs were held as Python strings at once."""
    import tracemalloc

    import pyarrow as pa

    text = ["".join(f"line {i} {j}\n" for j in range(300)) for i in range(600)]
    new = [x.replace("line 7", "changed") for x in text]
    batch = pa.RecordBatch.from_arrays([pa.array([f"p{i}" for i in range(600)])] * 2 + [pa.array(text), pa.array(new)], names=["old_path", "new_path", "old", "new"])
    tracemalloc.start()
    try:
        rows = sum(x.num_rows for x in linediff._compared(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 600 and peak < batch.nbytes / 2
