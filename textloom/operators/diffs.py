"""Unified diffs: synthesised for new files, parsed into files, hunks and numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def post_snapshot(ref: Column) -> Column:
    """HEAD: the work tree; a..b: b; other refs: the work tree. Three dots are rejected (null)."""
    return F.when(ref.contains("..."), None).when(ref.rlike(r"^.+?\.\..+$"), F.regexp_extract(ref, r"^(.+?)\.\.(.+)$", 2)).otherwise(F.lit("WORKTREE"))


def pre_snapshot(ref: Column) -> Column:
    return F.when(ref.contains("..."), None).when(ref.rlike(r"^.+?\.\..+$"), F.regexp_extract(ref, r"^(.+?)\.\.(.+)$", 1)).otherwise(F.lit("HEAD"))


def search_snapshot(ref: Column) -> Column:
    """Where a search looks: HEAD: the work tree; a..b: b; any other ref, unlike in ``post_snapshot``: itself."""
    return F.when(ref == "HEAD", "WORKTREE").when(ref.rlike(r"^.+?\.\..+$"), F.regexp_extract(ref, r"^(.+?)\.\.(.+)$", 2)).otherwise(ref)


def file_lines(text: Column) -> Column:
    """Lines of a file without the empty one after a final line end."""
    split = F.split(text, "\n", -1)
    return F.when(F.element_at(split, -1) == "", F.slice(split, 1, F.size(split) - 1)).otherwise(split)


def synthesize(path: Column, text: Column) -> Column:
    """A diff that adds the whole file; empty for a binary or missing one."""
    body = file_lines(text)
    diff = F.concat(
        F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\nnew file mode 100644\n--- /dev/null\n+++ b/"), path,
        F.lit("\n@@ -0,0 +1,"), F.size(body).cast("string"), F.lit(" @@\n"), F.array_join(F.transform(body, lambda x: F.concat(F.lit("+"), x)), "\n"),
    )
    return F.when(text.isNull() | (F.instr(F.substring(text, 1, 8000), "\0") > 0), "").otherwise(diff)


def file_blocks(diffs: DataFrame, key: str, diff: str) -> DataFrame:
    """key, block, body: one row for each file of a diff."""
    return diffs.select(key, F.posexplode(F.split(diff, r"(?m)(?=^diff --git )")).alias("block", "body")).filter(F.col("body").startswith("diff --git "))


def parse(diffs: DataFrame, key: str, diff: str) -> DataFrame:
    """Changed lines of multi-file diffs.

    key, block, old_path, new_path, is_new, is_deleted, is_renamed, is_binary, hunk, old_start, old_count, new_start,
    new_count (1 where the header has none), at (place in the hunk), type (context / added / deleted), content, old_no, new_no. A file without hunks is one row
    with null hunk. Header lines are those before the first ``@@``.
    """
    blocks = file_blocks(diffs, key, diff)
    header = F.split(F.element_at(F.split("body", r"(?m)^@@ ", 2), 1), "\n", -1)
    last = lambda pattern: F.element_at(F.filter(F.transform(header, lambda x: F.regexp_extract(x, pattern, 1)), lambda x: x != ""), -1)
    has = lambda pattern: F.exists(header, lambda x: x.rlike(pattern))
    bare = lambda c: F.when(c == "/dev/null", "").otherwise(F.regexp_replace(c, "^[ab]/", ""))
    git = F.element_at(header, 1)
    old = F.coalesce(F.try_element_at(F.filter(F.transform(header, lambda x: F.regexp_extract(x, r"^--- ([^\t]+)", 1)), lambda x: x != ""), F.lit(-1)), F.regexp_extract(git, r"^diff --git (a/.*) b/.*$", 1))
    new = F.coalesce(F.try_element_at(F.filter(F.transform(header, lambda x: F.regexp_extract(x, r"^\+\+\+ ([^\t]+)", 1)), lambda x: x != ""), F.lit(-1)), F.regexp_extract(git, r"^diff --git a/.* (b/.*)$", 1))
    files = blocks.select(
        key, "block", bare(old).alias("old_path"), bare(new).alias("new_path"), (has("^new file mode") | has("^--- /dev/null")).alias("is_new"), (has("^deleted file mode") | has(r"^\+\+\+ /dev/null")).alias("is_deleted"),
        has("^rename (from|to) ").alias("is_renamed"), has("^(Binary files .* differ|GIT binary patch)").alias("is_binary"),
        F.posexplode_outer(F.filter(F.split("body", r"(?m)(?=^@@ )"), lambda x: x.startswith("@@ "))).alias("hunk", "hunk_text"),
    )
    numbers = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    number = lambda i: F.regexp_extract("hunk_text", numbers, i).cast("int")
    body = F.filter(F.slice(F.split("hunk_text", "\n", -1), 2, F.greatest(F.size(F.split("hunk_text", "\n", -1)) - 1, F.lit(0))), lambda x: (x != "") & ~x.startswith("\\"))
    count = lambda i: F.when(F.regexp_extract("hunk_text", numbers, i) == "", 1).otherwise(F.regexp_extract("hunk_text", numbers, i).cast("int"))
    found = {"old_start": number(1), "old_count": count(2), "new_start": number(3), "new_count": count(4)}
    rows = files.withColumns({k: F.when(F.col("hunk").isNotNull(), v) for k, v in found.items()})
    rows = rows.select("*", F.posexplode_outer(F.when(F.col("hunk").isNotNull(), body)).alias("at", "raw"))
    mark = F.substring("raw", 1, 1)
    rows = rows.withColumn("type", F.when(mark == "+", "added").when(mark == "-", "deleted").when(F.col("raw").isNotNull(), "context")).withColumn("content", F.expr("substring(raw, 2)"))
    before = Window.partitionBy(key, "block", "hunk").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    side = lambda own: F.coalesce(F.sum((F.col("type").isin("context", own)).cast("int")).over(before), F.lit(0))
    return rows.withColumns({
        "new_no": F.when(F.col("type").isin("context", "added"), F.col("new_start") + side("added")),
        "old_no": F.when(F.col("type").isin("context", "deleted"), F.col("old_start") + side("deleted")),
    }).drop("hunk_text", "raw")


def summary(changed: DataFrame, key: str) -> DataFrame:
    """Per file of ``parse``: insertions, deletions, and whether it is binary; files without any path are dropped unless binary."""
    names = [key, "block", "old_path", "new_path", "is_new", "is_deleted", "is_renamed", "is_binary"]
    out = changed.groupBy(*names).agg(F.count_if(F.col("type") == "added").alias("insertions"), F.count_if(F.col("type") == "deleted").alias("deletions"))
    return out.filter((F.col("old_path") != "") | (F.col("new_path") != "") | F.col("is_binary"))


def status(is_new: Column, is_deleted: Column, is_renamed: Column) -> Column:
    return F.when(is_new, "added").when(is_deleted, "deleted").when(is_renamed, "renamed").otherwise("modified")
