"""Line diffs of two snapshots: minimal edit scripts, unified hunks, renames, and patches applied.

The two versions of a path meet in a full outer join, and only paths whose content differs go
on. Each is one row, so a file's versions are in one task, as its text is anyway. The edit
script is minimal: common ends and lines that only one side has are set aside, which costs
no match, then the greedy search by number of edits (Myers) runs up to ``EDITS`` edits, and
beyond it rows of common-subsequence lengths, a bit each, halve the problem (Hirschberg), so
memory stays linear and two unrelated files cost (lines x lines) / 64 steps.

Renames: a path that only the old snapshot has and one that only the new has are one file
if lines of at least ``SIMILAR`` of the longer content are common to both. Candidates meet
by their rarest lines: as many as leave less than that share, so no pair is lost, and common
lines are no keys. Pairs are then taken where each is the other's best, until none is left.

Defined results: null content is no file; an empty one has no lines; a last line without a
line end differs from the same line with one; a NUL in the first 8000 characters makes a file
binary, whose diff has no hunks; lines end at ``\\n`` only; a path that a snapshot holds
several times is one file for each content. An empty snapshot gives additions or deletions only.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from textloom.session import discard, materialise

#: Lines around a change; edits up to which the greedy search goes; area that is solved by a plain table.
AROUND, EDITS, TABLE = 3, 200, 1024
#: Share of the longer content, in characters, that a renamed file keeps.
SIMILAR = 0.5
#: Characters in which a NUL makes a file binary.
SNIFF = 8000
#: Files that a task holds as Python strings at a time.
ROWS = 64


def _run(a: np.ndarray, b: np.ndarray, x: int, y: int) -> int:
    """How many lines are equal from x and y on."""
    most, done, step = min(len(a) - x, len(b) - y), 0, 16
    while done < most:
        take = min(step, most - done)
        unlike = np.flatnonzero(a[x + done : x + done + take] != b[y + done : y + done + take])
        if len(unlike):
            return done + int(unlike[0])
        done, step = done + take, step * 4
    return max(most, 0)


def _greedy(a: np.ndarray, b: np.ndarray, limit: int) -> list[tuple[int, int, int]] | None:
    """Runs (x, y, length) of a minimal script of at most ``limit`` edits; None if it takes more."""
    n, m = len(a), len(b)
    reach, trail = {1: 0}, []
    for d in range(limit + 1):
        trail.append(dict(reach))
        for k in range(-d, d + 1, 2):
            down = reach.get(k + 1, -1) if d else 0
            right = reach.get(k - 1, -2) + 1 if d else -1
            x = max(down if 0 <= down - k <= m else -1, right if right <= n and 0 <= right - k <= m else -1)
            if x < 0:
                reach[k] = -2
                continue
            x += _run(a, b, x, x - k)
            reach[k] = x
            if x == n and x - k == m:
                return _walk_back(trail, n, m)
    return None


def _walk_back(trail: list[dict], x: int, y: int) -> list[tuple[int, int, int]]:
    runs = []
    m = y
    for d in range(len(trail) - 1, 0, -1):
        reach, k = trail[d], x - y
        down, right = reach.get(k + 1, -1), reach.get(k - 1, -2) + 1
        down, right = (down if 0 <= down - k <= m else -1), (right if 0 <= right - k <= m else -1)
        if down >= right:
            bx, by, px, py = down, down - k, down, down - k - 1
        else:
            bx, by, px, py = right, right - k, right - 1, right - k
        if x > bx:
            runs.append((bx, by, x - bx))
        x, y = px, py
    if x:
        runs.append((0, 0, x))
    return runs[::-1]


def _lengths(a: list, b: list) -> np.ndarray:
    """Length of the longest common subsequence of b and each beginning of a (bit by bit; a zero is a step up)."""
    n = len(a)
    full, at = (1 << n) - 1, {}
    for i, c in enumerate(a):
        at.setdefault(c, []).append(i)
    often = {c: sum(1 << i for i in places) for c, places in at.items() if len(places) * 256 >= n}
    row = full
    for c in b:
        if places := at.get(c):
            met = row & (often[c] if c in often else sum(1 << i for i in places))
            row = ((row + met) | (row - met)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes((n + 7) // 8, "little"), np.uint8), count=n, bitorder="little")
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _plain(a: list, b: list) -> list[tuple[int, int]]:
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif table[i + 1][j] >= table[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _halved(a: list, b: list) -> list[tuple[int, int]]:
    """Matched places of a longest common subsequence, by halving b."""
    out, waiting = [], [(0, len(a), 0, len(b))]
    while waiting:
        a0, a1, b0, b1 = waiting.pop()
        if a0 == a1 or b0 == b1:
            continue
        if (a1 - a0) * (b1 - b0) <= TABLE or b1 - b0 == 1:
            out += [(a0 + i, b0 + j) for i, j in _plain(a[a0:a1], b[b0:b1])]
            continue
        mid = (b0 + b1) // 2
        cut = a0 + int(np.argmax(_lengths(a[a0:a1], b[b0:mid]) + _lengths(a[a0:a1][::-1], b[mid:b1][::-1])[::-1]))
        waiting += [(cut, a1, mid, b1), (a0, cut, b0, mid)]
    return sorted(out)


def matches(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of a longest common subsequence of two arrays of numbers."""
    head = _run(a, b, 0, 0)
    tail = min(_run(a[::-1], b[::-1], 0, 0), min(len(a), len(b)) - head)
    ia = np.flatnonzero(np.isin(a[head : len(a) - tail], b[head : len(b) - tail])) + head
    ib = np.flatnonzero(np.isin(b[head : len(b) - tail], a[head : len(a) - tail])) + head
    x, y = a[ia], b[ib]
    runs = _greedy(x, y, EDITS)
    if runs is None:
        met = np.array(_halved(x.tolist(), y.tolist()), np.int64).reshape(-1, 2)
        px, py = met[:, 0], met[:, 1]
    else:
        px = np.concatenate([np.arange(i, i + n) for i, _, n in runs] or [np.empty(0)]).astype(np.int64)
        py = np.concatenate([np.arange(j, j + n) for _, j, n in runs] or [np.empty(0)]).astype(np.int64)
    ends = np.arange(tail)
    return np.concatenate([np.arange(head), ia[px], len(a) - tail + ends]), np.concatenate([np.arange(head), ib[py], len(b) - tail + ends])


def split_lines(text: str | None) -> list[str]:
    """Lines with their line ends; the last may lack one."""
    parts = (text or "").split("\n")
    return [x + "\n" for x in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def changes(old: list[str], new: list[str]) -> list[tuple[int, int, int, int]]:
    """(a0, a1, b0, b1) of a minimal script, in order: old lines a0..a1 become new lines b0..b1."""
    codes: dict[str, int] = {}
    a, b = (np.array([codes.setdefault(x, len(codes)) for x in side], np.int64) for side in (old, new))
    ma, mb = matches(a, b)
    pa_, pb = np.concatenate([[-1], ma, [len(a)]]), np.concatenate([[-1], mb, [len(b)]])
    at = np.flatnonzero((np.diff(pa_) > 1) | (np.diff(pb) > 1))
    return [(int(pa_[i]) + 1, int(pa_[i + 1]), int(pb[i]) + 1, int(pb[i + 1])) for i in at]


def hunks(old: list[str], new: list[str], around: int = AROUND) -> list[str]:
    """Unified hunks: changes that are no more than twice ``around`` lines apart are one."""
    groups: list[list[tuple[int, int, int, int]]] = []
    for c in changes(old, new):
        if groups and c[0] - groups[-1][-1][1] <= 2 * around:
            groups[-1].append(c)
        else:
            groups.append([c])
    said = lambda mark, lines: [mark + x if x.endswith("\n") else f"{mark}{x}\n\\ No newline at end of file\n" for x in lines]
    place = lambda start, size: f"{start + (size > 0)}" if size == 1 else f"{start + (size > 0)},{size}"
    out = []
    for group in groups:
        a0, b0 = max(0, group[0][0] - around), max(0, group[0][2] - min(around, group[0][0]))
        a1 = min(len(old), group[-1][1] + around)
        b1 = group[-1][3] + a1 - group[-1][1]
        body, at = [], a0
        for c in group:
            body += said(" ", old[at : c[0]]) + said("-", old[c[0] : c[1]]) + said("+", new[c[2] : c[3]])
            at = c[1]
        body += said(" ", old[at:a1])
        out.append(f"@@ -{place(a0, a1 - a0)} +{place(b0, b1 - b0)} @@\n" + "".join(body))
    return out


def is_binary(text: str | None) -> bool:
    return text is not None and "\0" in text[:SNIFF]


def unified(old_path: str, new_path: str, old: str | None, new: str | None, around: int = AROUND) -> str:
    """The diff of one file; None is a side without it. Empty if nothing differs."""
    if old == new and old_path == new_path:
        return ""
    out = f"diff --git a/{old_path} b/{new_path}\n"
    out += "new file mode 100644\n" if old is None else "deleted file mode 100644\n" if new is None else f"rename from {old_path}\nrename to {new_path}\n" if old_path != new_path else ""
    if old == new:
        return out
    left, right = "/dev/null" if old is None else f"a/{old_path}", "/dev/null" if new is None else f"b/{new_path}"
    if is_binary(old) or is_binary(new):
        return out + f"Binary files {left} and {right} differ\n"
    body = hunks(split_lines(old), split_lines(new), around)
    return out + (f"--- {left}\n+++ {right}\n" + "".join(body) if body else "")


HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+\d+(?:,\d+)? @@")


def apply(old: str | None, diff: str) -> str | None:
    """The new content from the old one and its diff; None if the file is deleted. Raises ValueError where the diff doesn't fit."""
    lines, out, at = split_lines(old), [], 0
    rows = diff.split("\n")
    i = next((k for k, x in enumerate(rows) if x.startswith("@@ ")), len(rows))
    if any(x.startswith("Binary files ") for x in rows[:i]):
        raise ValueError("a binary diff holds no content")
    gone = any(x.startswith("deleted file mode") for x in rows[:i])
    while i < len(rows) and (head := HUNK.match(rows[i])):
        start, size = int(head[1]), 1 if head[2] is None else int(head[2])
        start -= size > 0
        out += lines[at:start]
        at, i = start, i + 1
        while i < len(rows) and rows[i][:1] in (" ", "-", "+"):
            end = "" if i + 1 < len(rows) and rows[i + 1].startswith("\\") else "\n"
            line = rows[i][1:] + end
            if rows[i][0] != "+":
                if at >= len(lines) or lines[at] != line:
                    raise ValueError(f"line {at + 1} isn't the diff's")
                at += 1
            if rows[i][0] != "-":
                out.append(line)
            i += 1 if end else 2
    return None if gone else "".join(out + lines[at:])


def _few(batches):
    """Batches of at most ``ROWS`` rows: a batch of thousands of texts would be held as Python strings, with all that is made of them, at once."""
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            yield batch.slice(a, ROWS)


def _compared(batches):
    for batch in _few(batches):
        columns = [batch.column(c).to_pylist() for c in ("old_path", "new_path", "old", "new")]
        found = [unified(a if a is not None else b, b if b is not None else a, old, new) for a, b, old, new in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("old_path"), batch.column("new_path"), pa.array(found, pa.string())], names=["old_path", "new_path", "diff"])


def _weighed(files: DataFrame, within: str | None) -> DataFrame:
    """path (with what it is within), line (a hash), size (characters of all its copies), total (of the file)."""
    split = F.split("content", "\n", -1)
    apart = F.col(within) if within else F.lit(0)
    lines = files.select(F.struct(apart.alias("within"), "path").alias("path"), F.length("content").alias("total"), F.posexplode(split).alias("at", "line"), (F.size(split) - 1).alias("last"))
    # a line end belongs to its line
    lines = lines.select("path", "total", F.xxhash64("line", "path.within").alias("line"), (F.length("line") + (F.col("at") < F.col("last")).cast("int")).alias("size"))
    return lines.filter("size > 0").groupBy("path", "total", "line").agg(F.sum("size").alias("size"))


def renames(gone: DataFrame, come: DataFrame, least: float = SIMILAR, within: str | None = None) -> DataFrame:
    """old, new, similarity of the files (path, content) that are renamed; each path is in one pair at most.

    ``within``: a column (a commit, say) that both sides have, is returned first, and is equal in a pair. Lines are compared by 64-bit hashes. Equal contents come first, then the most similar; ties go to the smaller paths.
    """
    sides = [materialise(_weighed(x.filter("content is not null and content <> ''"), within), "lines") for x in (gone, come)]
    often = sides[0].unionByName(sides[1]).groupBy("line").agg(F.count("*").alias("df"))

    def rarest(side: DataFrame) -> DataFrame:
        """The lines without which too little would be left to share."""
        order = Window.partitionBy("path").orderBy("df", "line").rowsBetween(Window.unboundedPreceding, -1)
        placed = side.join(often, "line").withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
        return placed.filter(F.col("total") - F.col("before") >= F.col("total") * least).select("path", "line", "total")

    a, b = (rarest(s).select(F.col("path").alias(n), "line", F.col("total").alias(f"{n}_total")) for s, n in zip(sides, ("old", "new"), strict=True))
    fits = F.col("old.within").eqNullSafe(F.col("new.within")) & (F.col("old_total") >= F.col("new_total") * least) & (F.col("new_total") >= F.col("old_total") * least)
    met = a.join(b, "line").filter(fits).select("old", "new").distinct()
    shared = met.join(sides[0].select(F.col("path").alias("old"), "line", F.col("size").alias("s"), F.col("total").alias("t")), "old")
    shared = shared.join(sides[1].select(F.col("path").alias("new"), "line", F.col("size").alias("s2"), F.col("total").alias("t2")), ["new", "line"])
    scored = shared.groupBy("old", "new").agg((F.sum(F.least("s", "s2")) / F.max(F.greatest("t", "t2"))).alias("similarity")).filter(F.col("similarity") >= least)
    left, taken = materialise(scored, "renames"), None
    while True:
        best = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(F.desc("similarity"), "old", "new"))
        now = materialise(left.withColumns({"_a": best("old"), "_b": best("new")}).filter("_a = 1 and _b = 1").drop("_a", "_b"), "renames")
        taken = now if taken is None else taken.unionByName(now)
        rest = materialise(left.join(now.select("old"), "old", "left_anti").join(now.select("new"), "new", "left_anti"), "renames")
        discard(left)
        left = rest
        if not left.head(1):
            for x in (*sides, left):
                discard(x)
            own = [F.col("old.within").alias(within)] if within else []
            return taken.select(*own, F.col("old.path").alias("old"), F.col("new.path").alias("new"), "similarity")


def snapshot_diffs(before: DataFrame, after: DataFrame, follow: bool = True, least: float = SIMILAR) -> DataFrame:
    """old_path, new_path, diff of every path (path, content) whose content differs between two snapshots; a missing path is null. ``follow``: renamed files are one row."""
    there = "path is not null and content is not null"
    old, new = before.filter(there).select(F.col("path").alias("old_path"), F.col("content").alias("old")), after.filter(there).select(F.col("path").alias("new_path"), F.col("content").alias("new"))
    both = old.join(new, F.col("old_path") == F.col("new_path"), "full").filter(~F.col("old").eqNullSafe(F.col("new")))
    if follow:
        one = materialise(both, "versions")
        gone, come = one.filter("new_path is null"), one.filter("old_path is null")
        moved = materialise(renames(gone.select(F.col("old_path").alias("path"), F.col("old").alias("content")), come.select(F.col("new_path").alias("path"), F.col("new").alias("content")), least), "moved").select(F.col("old").alias("_o"), F.col("new").alias("_n"))
        stay = one.filter("old_path is not null and new_path is not null")
        stay = stay.unionByName(gone.join(moved, gone.old_path == F.col("_o"), "left_anti")).unionByName(come.join(moved, come.new_path == F.col("_n"), "left_anti"))
        both = stay.unionByName(moved.join(gone.select("old_path", "old"), F.col("_o") == F.col("old_path")).join(come.select("new_path", "new"), F.col("_n") == F.col("new_path")).select("old_path", "old", "new_path", "new"))
    return both.select("old_path", "new_path", "old", "new").mapInArrow(_compared, "old_path string, new_path string, diff string").filter("diff <> ''")


def patched(files: DataFrame, content: Column, diff: Column) -> DataFrame:
    """``files`` with patched, the content after its diff, and patch_error where the diff doesn't fit."""
    names = files.columns

    def run(batches):
        for batch in _few(batches):
            found, errors = [], []
            for old, text in zip(batch.column("_old").to_pylist(), batch.column("_diff").to_pylist(), strict=True):
                try:
                    found.append(old if text is None else apply(old, text))
                    errors.append(None)
                except ValueError as e:
                    found.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(found, pa.string()), pa.array(errors, pa.string())], names=["_row", "patched", "patch_error"])

    held = files.select(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)]).alias("_row"), content.alias("_old"), diff.alias("_diff"))
    out = held.mapInArrow(run, StructType([held.schema["_row"], StructField("patched", StringType()), StructField("patch_error", StringType())]))
    return out.select(*[F.col("_row")[f"c{i}"].alias(c) for i, c in enumerate(names)], "patched", "patch_error")
