"""Review of a change: which files are looked at, where comments stand, and whether their claims hold.

Files are rows (path, content), changes rows of ``change_sets``, comments rows that name a
path; each is joined by path. What is kept of a file is as large as its own text or diff.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import norm_line, norm_lines, slashes
from textloom.operators import diffs, locate, selection

#: The checks of a claim, in order (fixed values).
CHECKS = ("line_in_hunk", "existing_code_found", "existing_code_in_diff", "evidence_valid")


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, though the body names it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def content_at(paths: DataFrame, files: DataFrame, snapshot: str = "snapshot", worktree: str = "WORKTREE") -> DataFrame:
    """``paths`` (snapshot, path) with content: of that snapshot, else of the work tree; an empty text counts as missing."""
    there = files.filter("content <> ''").select(F.col("snapshot").alias("_s"), F.col("path").alias("_p"), F.col("content").alias("_c"))
    tree = there.filter(F.col("_s") == worktree).select(F.col("_p").alias("_wp"), F.col("_c").alias("_wc"))
    out = paths.join(there, (F.col(snapshot) == F.col("_s")) & (F.col("path") == F.col("_p")), "left").join(tree, F.col("path") == F.col("_wp"), "left")
    return out.withColumn("content", F.coalesce("_c", "_wc")).drop("_s", "_p", "_c", "_wp", "_wc")


def untracked(files: DataFrame, head: str = "HEAD", worktree: str = "WORKTREE") -> DataFrame:
    """path, content of the files that only the work tree has."""
    known = files.filter(F.col("snapshot") == head).select("path")
    return files.filter(F.col("snapshot") == worktree).join(known, "path", "left_anti").select("path", "content")


def statuses(files: DataFrame, head: str = "HEAD", worktree: str = "WORKTREE") -> DataFrame:
    """path, status (untracked or modified) of the files that the work tree has otherwise than the head, or not at all."""
    old, new = (files.filter(F.col("snapshot") == s).select("path", F.col("content").alias(name)) for s, name in ((head, "_old"), (worktree, "_new")))
    both = old.withColumn("_known", F.lit(True)).join(new, "path", "full")
    changed = F.col("_known").isNull() | ~F.col("_old").eqNullSafe(F.col("_new"))
    return both.filter(changed).select("path", F.when(F.col("_known").isNull(), "untracked").otherwise("modified").alias("status"))


def workspace_diffs(tracked: DataFrame, new_files: DataFrame) -> DataFrame:
    """path, diff: those of tracked files, and a synthesised one for each new file whose name and content aren't binary."""
    made = new_files.filter(~selection.is_binary_path(F.col("path"))).select("path", diffs.synthesize(F.col("path"), F.col("content")).alias("diff"))
    return tracked.select("path", "diff").unionByName(made.filter("diff <> ''"))


def targets(changes: DataFrame, key: str, diff: str, exclude=selection.LEFT_OUT, include=()) -> DataFrame:
    """key, path, diff, additions, deletions, status, outcome of every changed file of the diffs.

    Files whose diff is binary aren't there at all; outcome is kept, or why the path is left out.
    """
    found = diffs.summary(diffs.parse(changes, key, diff), key).filter("not is_binary")
    path = F.when(F.col("new_path") != "", F.col("new_path")).otherwise(F.col("old_path"))
    found = found.withColumn("path", path).join(diffs.file_blocks(changes, key, diff), [key, "block"])
    return found.select(
        key, "path", F.col("body").alias("diff"), F.col("insertions").alias("additions"), "deletions",
        diffs.status(F.col("is_new"), F.col("is_deleted"), F.col("is_renamed")).alias("status"), F.coalesce(selection.drop_reason(F.col("path"), exclude, include), F.lit("kept")).alias("outcome"),
    )


def target_totals(found: DataFrame) -> DataFrame:
    return found.agg(F.count_if(F.col("outcome") == "kept").alias("total_files"), F.count_if(F.col("outcome") != "kept").alias("filtered_out"))


def change_sets(changes: DataFrame, path: str, diff: str) -> DataFrame:
    """path, is_new, hunks, new_sides, old_sides, added, changed of the first file of each diff; diffs without a file give no row.

    hunks: array<struct<start, end>> of the new side; sides: for each hunk its numbered lines
    that aren't blank; added: numbers of added lines; changed: contents of added and deleted lines.
    """
    rows = diffs.parse(changes, path, diff)
    item = F.struct("block", "hunk", "at", "type", norm_line(F.col("content")).alias("line"), "new_no", "old_no", "new_start", "new_count")
    files = rows.groupBy(path).agg(F.array_sort(F.collect_list(item)).alias("_all"), F.min_by("is_new", "block").alias("is_new"))
    files = files.withColumn("_lines", F.filter("_all", lambda x: (x["block"] == F.get("_all", F.lit(0))["block"]) & x["hunk"].isNotNull())).drop("_all")
    heads = F.array_distinct(F.transform("_lines", lambda x: F.struct(x["hunk"].alias("hunk"), x["new_start"].alias("start"), (x["new_start"] + x["new_count"] - 1).alias("end"))))

    def sides(number: str) -> Column:
        kept = F.filter("_lines", lambda x: x[number].isNotNull() & (x["line"] != ""))
        own = lambda h: F.transform(F.filter(F.col("_kept"), lambda x: x["hunk"] == h["hunk"]), lambda x: F.struct(x[number].alias("n"), x["line"].alias("line")))
        return kept, F.transform("hunks", own)

    out = files.withColumn("hunks", heads)
    for name, number in (("new_sides", "new_no"), ("old_sides", "old_no")):
        kept, own = sides(number)
        out = out.withColumn("_kept", kept).withColumn(name, own).drop("_kept")
    added = F.transform(F.filter("_lines", lambda x: x["type"] == "added"), lambda x: x["new_no"])
    changed = F.array_distinct(F.transform(F.filter("_lines", lambda x: x["type"].isin("added", "deleted") & (x["line"] != "")), lambda x: x["line"]))
    return out.select(F.col(path).alias("path"), "is_new", "hunks", "new_sides", "old_sides", added.alias("added"), changed.alias("changed"))


def span(side: Column, target: Column, find=locate.run_at) -> Column:
    """struct<start, end>: original numbers of the first run of the target in numbered lines; null if there is none."""

    def of(s: Column) -> Column:
        at = bound(F.transform(s, lambda x: x["line"]), lambda lines: find(lines, target))
        return bound(at, lambda i: F.when(i.isNotNull(), F.struct(F.get(s, i - 1)["n"].alias("start"), F.get(s, i + F.size(target) - 2)["n"].alias("end"))))

    return bound(side, of)


def first_span(sides: Column, target: Column) -> Column:
    return F.get(F.filter(F.transform(sides, lambda s: span(s, target)), lambda x: x.isNotNull()), F.lit(0))


def aligned(hunks: Column, hint: Column) -> Column:
    """The line of ``locate.align`` from one file's hunks as an array; null without hunks."""
    inside = F.exists(hunks, lambda h: hint.between(h["start"], h["end"]))
    first, last = F.get(hunks, F.lit(0)), F.try_element_at(hunks, F.lit(-1))
    near = F.array_min(F.transform(hunks, lambda h, i: F.struct(F.abs(hint - h["start"]).alias("d"), i.alias("i"), h["start"].alias("start"))))["start"]
    return F.when(F.size(hunks) > 0, F.when(inside, hint).when(hint < first["start"], first["start"]).when(hint > last["end"], last["end"]).otherwise(near))


def position(comments: DataFrame, changes: DataFrame, files: DataFrame, code: str = "existing_code", suggestion: str | None = None, hint: str = "hint_line") -> DataFrame:
    """``comments`` with start_line, end_line and located_by.

    text_match: the code's lines in a row on a hunk's new side, else an old side, else in the
    file, and only if the file has a diff; hunk_align: the hint; fuzzy_match: the file's first
    window near enough; failed: 0, 0. Null or blank code and a hint below 1 are none.
    """
    own = F.when(F.col(code) != "", F.col(code))
    target = norm_lines(F.coalesce(own, F.col(suggestion) if suggestion else F.lit(""), F.lit("")))
    rows = comments.withColumn("path", slashes(F.col("path"))).withColumn("_target", target)
    rows = rows.join(changes.withColumn("_has", F.lit(True)), "path", "left").join(files.select("path", locate.numbered(F.col("content")).alias("_file")), "path", "left")
    some, t = F.size("_target") > 0, F.col("_target")
    rows = rows.withColumn("_text", F.when(some & F.col("_has"), F.coalesce(first_span(F.col("new_sides"), t), first_span(F.col("old_sides"), t), span(F.col("_file"), t))))
    rows = rows.withColumn("_hunk", F.when(F.col("_text").isNull() & (F.col(hint) > 0), aligned(F.col("hunks"), F.col(hint))))
    rows = rows.withColumn("_near", F.when(F.col("_text").isNull() & F.col("_hunk").isNull() & some, span(F.col("_file"), t, locate.locate_fuzzy)))
    pick = lambda end: F.coalesce(F.col(f"_text.{end}"), F.col("_hunk"), F.col(f"_near.{end}"), F.lit(0)).cast("int")
    by = locate.cascade(F.coalesce("_text.start", F.lit(0)), F.coalesce("_hunk", F.lit(0)), F.coalesce("_near.start", F.lit(0)))
    return rows.select(*comments.columns, pick("start").alias("start_line"), pick("end").alias("end_line"), by.alias("located_by"))


def evidence_valid(comments: DataFrame, files: DataFrame, key: str, evidence: str = "evidence") -> DataFrame:
    """key, evidence_valid for comments with evidence: every snippet's lines stand in a row in its file. A missing path, snippet or file fails."""
    items = comments.select(key, F.explode(evidence).alias("e")).select(key, slashes(F.col("e.path")).alias("path"), F.col("e.snippet").alias("_snippet"))
    met = items.join(files.filter("content <> ''").select("path", norm_lines(F.col("content")).alias("_file")), "path", "left")
    said = F.coalesce(F.trim("_snippet") != "", F.lit(False)) & F.col("_file").isNotNull()
    target = norm_lines(F.col("_snippet"))
    holds = bound(target, lambda t: (F.size(t) == 0) | locate.run_at(F.col("_file"), t).isNotNull())
    return met.groupBy(key).agg(F.bool_and(F.coalesce(said & holds, F.lit(False))).alias("evidence_valid"))


def reflect(comments: DataFrame, changes: DataFrame, files: DataFrame, key: str, code: str = "existing_code", evidence: str | None = "evidence", strict: bool = True) -> DataFrame:
    """``comments`` (key, path, start_line, end_line, code, evidence) with verdict, reason, checks.

    A file that is missing or empty fails all checks. A new file passes those on the change:
    strict takes a file for new if its diff or ``files.untracked`` says so, otherwise one
    without any diff is new as well. No code, or no evidence, passes the checks on it.
    """
    tracked = F.coalesce(F.col("untracked"), F.lit(False)) if "untracked" in files.columns else F.lit(False)
    texts = files.filter("content <> ''").select("path", norm_lines(F.col("content")).alias("_file"), tracked.alias("_untracked"))
    rows = comments.withColumn("path", slashes(F.col("path"))).withColumn("_target", norm_lines(F.coalesce(F.col(code), F.lit(""))))
    rows = rows.join(changes.withColumn("_has", F.lit(True)), "path", "left").join(texts, "path", "left")
    if evidence:
        rows = rows.join(evidence_valid(comments, files, key, evidence), key, "left")
    else:
        rows = rows.withColumn("evidence_valid", F.lit(True))
    none, whole = F.size("_target") == 0, F.col("_has").isNull() & (F.col("_untracked") if strict else F.lit(True))
    ranged = (F.col("start_line") > 0) & (F.col("end_line") >= F.col("start_line"))
    passed = {
        "line_in_hunk": ranged & (whole | F.col("is_new") | F.exists("added", lambda n: n.between(F.col("start_line"), F.col("end_line")))),
        "existing_code_found": none | locate.run_at(F.col("_file"), F.col("_target")).isNotNull(),
        "existing_code_in_diff": none | whole | F.arrays_overlap("_target", "changed"),
        "evidence_valid": F.coalesce("evidence_valid", F.lit(True)),
    }
    there = F.col("_file").isNotNull()
    rows = rows.withColumns({f"_c{i}": F.coalesce(there & passed[c], F.lit(False)) for i, c in enumerate(CHECKS)})
    keep, failed = locate.verdict({c: F.col(f"_c{i}") for i, c in enumerate(CHECKS)})
    reason = F.when(~there, "file not found").when(keep == "keep", "passed all checks").otherwise(F.concat(F.lit("failed: "), failed))
    checks = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"_c{i}").alias("passed")) for i, c in enumerate(CHECKS)])
    return rows.select(*comments.columns, keep.alias("verdict"), reason.alias("reason"), checks.alias("checks"))
