"""Positions of snippets in files: exact, by nearest hunk, by edit distance; and checks of claims about them."""

from __future__ import annotations

import math
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import norm_line, norm_lines
from textloom.operators import ranges
from textloom.session import materialise, spread

#: Edit distance over length below which a window matches.
FUZZY = 0.15


def numbered(text: Column) -> Column:
    """array<struct<n, line>>: normalised lines that aren't blank, with their original numbers."""
    raw = F.split(text, "\n", -1)
    return F.filter(F.transform(raw, lambda x, i: F.struct((i + 1).alias("n"), norm_line(x).alias("line"))), lambda x: x["line"] != "")


def run_at(lines: Column, target: Column) -> Column:
    """First place (from 1) in ``lines`` where ``target`` stands in a row; null if nowhere or if the target is empty."""
    n = F.size(target)
    places = F.when((n > 0) & (F.size(lines) >= n), F.sequence(F.lit(1), F.size(lines) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.try_element_at(F.filter(places, lambda i: (F.get(lines, i - 1) == F.get(target, F.lit(0))) & (F.slice(lines, i, n) == target)), F.lit(1))


def locate_exact(comments: DataFrame, files: DataFrame, on: list[str], code: str, text: str) -> DataFrame:
    """``comments`` with start_line and end_line of the first exact run of the snippet's lines; 0 if there is none."""
    joined = comments.join(files, on, "left").withColumn("_lines", numbered(F.col(text))).withColumn("_target", norm_lines(F.coalesce(F.col(code), F.lit(""))))
    joined = joined.withColumn("_at", run_at(F.transform("_lines", lambda x: x["line"]), F.col("_target")))
    number = lambda i: F.coalesce(F.get("_lines", i - 1)["n"], F.lit(0))
    return joined.withColumn("start_line", number(F.col("_at"))).withColumn("end_line", number(F.col("_at") + F.size("_target") - 1)).drop("_lines", "_target", "_at", text)


def first_line_index(files: DataFrame, key: str, text: str) -> DataFrame:
    """line, key, p (from 0): every line that isn't blank."""
    return files.select(key, F.posexplode(norm_lines(F.col(text))).alias("p", "line"))


def search_snippets(snippets: DataFrame, files: DataFrame, snippet_key: str, snippet: str, key: str, text: str) -> DataFrame:
    """Every file's first run of every snippet. Empty snippets match nothing; a key that has several snippets is found where one of them is.

    Equal snippets are searched as one, and only what is found is told to each key that has
    them. A snippet meets the files by the one of its lines that stands in the fewest places; a
    snippet with a line that stands nowhere meets none. Its other lines are then looked up
    where they would have to stand: rows of a file and place, no file's text. Lines are
    compared by two 64-bit hashes.
    """
    hashed = (F.xxhash64("line").alias("h"), F.xxhash64(F.lit("second"), "line").alias("h2"))
    own = snippets.select(F.struct(F.col(snippet_key).alias("k")).alias("key"), norm_lines(F.col(snippet)).alias("ls")).filter(F.size("ls") > 0)
    own = materialise(own.select("key", "ls", F.struct(F.xxhash64("ls").alias("a"), F.xxhash64(F.lit("second"), "ls").alias("b")).alias("_s")).distinct(), "snippets")
    wanted = own.groupBy("_s").agg(F.first("ls").alias("ls")).select("_s", F.posexplode("ls").alias("i", "line")).select("_s", "i", *hashed)
    index = first_line_index(files.select(F.col(key).alias("_k"), F.col(text).alias("_t")), "_k", "_t").select("_k", "p", *hashed)
    index = materialise(index, "lines")
    known = wanted.join(index.groupBy("h", "h2").agg(F.count("*").alias("places")), ["h", "h2"], "left").withColumn("places", F.coalesce("places", F.lit(0)))
    rarest = known.groupBy("_s").agg(F.min(F.struct("places", "i", "h", "h2")).alias("r"), F.count("*").alias("n")).filter("r.places > 0")
    met = index.join(rarest.select("_s", "n", "r.i", "r.h", "r.h2"), ["h", "h2"]).select("_s", "_k", "n", (F.col("p") - F.col("i")).alias("at"), "i").filter("at >= 0")
    met = materialise(met, "met")
    rest = met.filter("n > 1").withColumnRenamed("i", "_seen").join(wanted, "_s").filter("i <> _seen").select("_s", "_k", "n", "at", (F.col("at") + F.col("i")).alias("p"), "h", "h2")
    whole = rest.join(index, ["_k", "p", "h", "h2"]).groupBy("_s", "_k", "n", "at").agg(F.count("*").alias("_found")).filter("_found = n - 1")
    found = met.filter("n = 1").select("_s", "_k", "at").unionByName(whole.select("_s", "_k", "at")).groupBy("_s", "_k").agg(F.min("at").alias("at"))
    # a snippet that many keys have is dealt over tasks with what it is found in; only keys with several snippets have to be brought together again
    keys = own.select("key", "_s").distinct()
    many = keys.groupBy("_s").agg(F.ceil(F.count("*") / SHARED).cast("int").alias("salts"))
    told = keys.join(keys.groupBy("key").agg((F.count("*") > 1).alias("several")), "key").join(many, "_s").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    found = materialise(found, "found").join(many, "_s").withColumn("salt", F.pmod(F.xxhash64("_k"), F.col("salts")).cast("int"))
    told = materialise(told, "keys")
    out = lambda which: found.join(told.filter(which).select("_s", "salt", "key"), ["_s", "salt"]).select("key", "_k", "at")
    several = out("several").groupBy("key", "_k").agg(F.min("at").alias("at"))
    return out("not several").unionByName(several).select(F.col("key.k").alias(snippet_key), F.col("_k").alias(key), (F.col("at") + 1).alias("at"))


def locate_fuzzy(lines: Column, target: Column, limit: float = FUZZY) -> Column:
    """The first window of as many lines whose edit distance over the longer length is under the limit."""
    n = F.size(target)
    places = F.when((n > 0) & (F.size(lines) >= n), F.sequence(F.lit(1), F.size(lines) - n + 1)).otherwise(F.array().cast("array<int>"))

    def near(i):
        pairs = F.zip_with(F.slice(lines, i, n), target, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        longest = F.aggregate(pairs, F.lit(0), lambda t, x: t + F.greatest(F.length(x["a"]), F.length(x["b"])))
        apart = F.aggregate(pairs, F.lit(0), lambda t, x: t + F.abs(F.length(x["a"]) - F.length(x["b"])))
        # no further than the window may differ; a line beyond that rules the window out
        most = F.ceil(longest * F.lit(limit)).cast("int")
        apart_by = lambda d: F.when(d < 0, longest).otherwise(d)
        distance = F.aggregate(F.transform(pairs, lambda x: F.call_function("levenshtein", x["a"], x["b"], most)), F.lit(0), lambda t, d: t + apart_by(d))
        return F.when(apart / longest >= limit, False).otherwise(distance / longest < limit)  # lengths alone rule most windows out

    return F.try_element_at(F.filter(places, near), F.lit(1))


#: Characters of a key of the edit-distance join: of lines whose pieces are long enough, and of others.
GRAMS = (5, 3)
#: Different keys of a file's snippets up to which its lines are indexed by these keys only.
ASKED = 20_000
#: Lines of a file's snippets that a task holds while the file's lines pass; files that are asked for more are indexed.
TOLD = 256
#: Keys with an equal snippet that one task is told at a time.
SHARED = 512


def near_lines(snippets: DataFrame, files: DataFrame, on: list[str], limit: float = FUZZY) -> DataFrame:
    """_s, at: windows that may be near enough. ``snippets``: on, _s, _target; ``files``: on, p (from 1), line.

    A window under the limit has a line whose distance is under limit / (1 - limit) of its
    target line's length. Cut into one piece more than that allows edits, the target line has a
    piece that stands unchanged in the window's, shifted by no more places than edits: pieces
    meet lines by file and first characters. Lines too short for an edit must be equal.
    """
    ratio = limit / (1 - limit)
    lines = snippets.select(*on, "_s", F.posexplode("_target").alias("i", "t")).withColumn("edits", F.greatest(F.ceil(F.length("t") * F.lit(ratio)) - 1, F.lit(0)).cast("int"))
    many = lines.groupBy(*on).agg(F.count("*").alias("c")).filter(F.col("c") > TOLD).select(*on)
    return _passed(lines.join(many, on, "left_anti"), files, on).unionByName(_indexed(lines.join(many, on, "left_semi"), files, on, ratio)).distinct()


def _passed(lines: DataFrame, files: DataFrame, on: list[str]) -> DataFrame:
    """_s, at by looking for the pieces of ``lines`` (on, _s, i, t, edits) in each line of their file, which come after them."""
    known = lambda df: df.dropna(subset=on)
    asked = known(lines).select(*on, F.lit(0).alias("p"), F.col("t").alias("line"), "_s", "i", "edits")
    own = known(files).join(known(lines).select(*on).distinct(), on, "left_semi").select(*on, "p", "line").withColumns({"_s": F.lit(None).cast("long"), "i": F.lit(None).cast("int"), "edits": F.lit(None).cast("int")})
    # by a hash of its own: where both sides are dealt by the file already, Spark 4.1 takes their union for dealt, though adaptive execution coalesces each side in its own way
    met = spread(asked.unionByName(own).withColumn("_part", F.xxhash64(*on)), "_part").sortWithinPartitions(*on, F.col("edits").asc_nulls_last())

    def find(batches):
        file, equal, near = None, {}, {}
        for batch in batches:
            found = []
            for *key, p, line, s, i, edits in zip(*(batch.column(c).to_pylist() for c in (*on, "p", "line", "_s", "i", "edits")), strict=True):
                if key != file:
                    file, equal, near = key, {}, {}
                if edits == 0:
                    equal.setdefault(line, []).append((s, i))
                elif edits is not None:
                    cuts = [len(line) * j // (edits + 1) for j in range(edits + 2)]
                    pieces = [(max(0, a - edits), b + edits, line[a:b]) for a, b in zip(cuts, cuts[1:])]  # noqa: B905
                    near.setdefault((len(line), edits), []).append((s, i, pieces))
                else:
                    found += [(s, p - i) for s, i in equal.get(line, ())]
                    for (size, most), asking in near.items():
                        if abs(size - len(line)) <= most:
                            found += [(s, p - i) for s, i, pieces in asking if p > i and any(line.find(x, a, b) >= 0 for a, b, x in pieces)]
            found = [x for x in found if x[1] > 0]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int32())], names=["_s", "at"])

    return met.mapInArrow(find, "_s long, at int")


def _indexed(lines: DataFrame, files: DataFrame, on: list[str], ratio: float) -> DataFrame:
    """_s, at by an index of what begins at each character of a file's lines."""
    cut = lambda j: F.floor(F.length("t") * j / (F.col("edits") + 1)).cast("int")
    pieces = lines.select(*on, "_s", "i", "t", "edits", F.explode(F.sequence(F.lit(0), F.col("edits"))).alias("j")).withColumn("start", cut(F.col("j")))
    pieces = pieces.withColumn("piece", F.substring(F.col("t"), F.col("start") + 1, cut(F.col("j") + 1) - F.col("start")))
    (long, short), most = GRAMS, math.ceil(1 / ratio) + 1  # a piece is shorter than that
    size = F.when(F.col("edits") == 0, 0).when(F.floor(F.length("t") / (F.col("edits") + 1)) >= long, long).otherwise(short)
    pieces = pieces.withColumn("size", size).withColumn("key", F.when(F.col("size") == 0, F.col("t")).otherwise(F.substring(F.col("piece"), F.lit(1), F.col("size"))))
    pieces = pieces.select(*on, "_s", "i", "edits", "start", "piece", "key", "size")
    # a file's lines are indexed where one of its snippets asks: else every character would be two rows
    hashed = lambda size, key: F.xxhash64(size, key)
    keys = pieces.select(*on, hashed(F.col("size"), F.col("key")).alias("h")).distinct()
    few = keys.groupBy(*on).agg(F.count("*").alias("n")).filter(F.col("n") <= ASKED)
    asked = keys.join(few, on, "left_semi").groupBy(*on).agg(F.collect_list("h").alias("_asked"))
    asked = lines.select(*on).distinct().join(asked, on, "left")
    own = files.join(asked, on)
    # what begins at each character, found in one pass: a substring by its place would walk a long line anew for each
    own = own.withColumn("seen", F.regexp_extract_all("line", F.lit(f"(?s)(?=(.{{1,{most}}}))."), F.lit(1)))
    spots = lambda g: F.filter(F.transform("seen", lambda x, i: F.struct(F.lit(g).alias("size"), i.alias("spot"), F.substring(x, 1, g).alias("key"), x.alias("seen"))), lambda x: F.length(x["key"]) == g)
    whole = F.array(F.struct(F.lit(0).alias("size"), F.lit(0).alias("spot"), F.col("line").alias("key"), F.lit("").alias("seen")))
    some = lambda g, found: F.filter(found, lambda x: F.col("_asked").isNull() | F.array_contains("_asked", hashed(F.lit(g), x["key"])))
    index = own.select(*on, "p", F.explode(F.concat(some(0, whole), some(long, spots(long)), some(short, spots(short)))).alias("k")).select(*on, "p", "k.*")
    met = pieces.join(index, [*on, "size", "key"]).filter(F.abs(F.col("spot") - F.col("start")) <= F.col("edits"))
    met = met.filter((F.col("size") == 0) | F.col("seen").startswith(F.col("piece")))
    return met.select("_s", (F.col("p") - F.col("i")).cast("int").alias("at")).filter("at > 0").distinct()


def edit_distance(a: str, b: str, most: int) -> int | None:
    """The edit distance; None if it is above ``most``. A row of the table is one long number (Myers 1999, Hyyrö 2003)."""
    same = len(commonprefix((a, b)))
    a, b = a[same:][::-1], b[same:][::-1]
    same = len(commonprefix((a, b)))
    a, b = sorted((a[same:], b[same:]), key=len)
    if not a or len(b) - len(a) > most:
        return len(b) if len(b) - len(a) <= most else None
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    every, last, more, less, score = (1 << len(a)) - 1, 1 << len(a) - 1, (1 << len(a)) - 1, 0, len(a)
    for left, c in zip(range(len(b) - 1, -1, -1), b, strict=True):
        here = at.get(c, 0)
        x = (((here & more) + more) ^ more) | here
        up, down = less | every & ~(x | more), more & x
        score += bool(up & last) - bool(down & last)
        if score - left > most:
            return None
        up, down = up << 1 | 1, down << 1
        x = here | less
        more, less = (down | ~(x | up)) & every, up & x & every
    return score


def _measured(batches):
    """_s, at, n, d, longest of lines that are near enough. Batches: _s, at, n, line, t, most."""
    for batch in batches:
        rows = []
        for s, at, n, line, t, most in zip(*(batch.column(c).to_pylist() for c in ("_s", "at", "n", "line", "t", "most")), strict=True):
            if (d := edit_distance(line, t, most)) is not None:
                rows.append((s, at, n, d, max(len(line), len(t))))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), *[pa.int32()] * 4))], names=["_s", "at", "n", "d", "longest"])


def fuzzy_join(snippets: DataFrame, files: DataFrame, on: list[str], code: str, text: str, limit: float = FUZZY) -> DataFrame:
    """``snippets`` with at: the first window of its file's lines (blank ones don't count) that is near enough, as in ``locate_fuzzy``; null if there is none; and measured, how many windows were.

    Only the windows of ``near_lines`` are measured, line by line, and a line's distance is only followed as far as the whole snippet allows.
    """
    names = snippets.columns
    wanted = snippets.select(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)]).alias("_row"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(on)], norm_lines(F.coalesce(F.col(code), F.lit(""))).alias("_target"))
    wanted = materialise(wanted.withColumn("_s", F.monotonically_increasing_id()), "snippets")
    keys = [f"_k{i}" for i in range(len(on))]
    index = files.select(*[F.col(c).alias(k) for c, k in zip(on, keys, strict=True)], F.posexplode(norm_lines(F.col(text))).alias("p", "line")).withColumn("p", F.col("p") + 1)
    some = wanted.filter(F.size("_target") > 0).select(*keys, "_s", "_target")
    near = materialise(near_lines(some, index, keys, limit), "windows")
    total = F.aggregate("_target", F.lit(0), lambda t, x: t + F.length(x))
    parts = near.join(some, "_s").select(*keys, "_s", "at", F.size("_target").alias("n"), F.ceil(total * F.lit(limit / (1 - limit))).cast("int").alias("most"), F.posexplode("_target").alias("i", "t")).withColumn("p", F.col("at") + F.col("i"))
    met = parts.join(spread(index, *keys), [*keys, "p"]).filter(F.abs(F.length("line") - F.length("t")) <= F.col("most"))
    measured = met.select("_s", "at", "n", "line", "t", "most").mapInArrow(_measured, "_s long, at int, n int, d int, longest int")
    whole = measured.groupBy("_s", "at", "n").agg(F.count("*").alias("lines"), F.sum("d").alias("d"), F.sum("longest").alias("longest"))
    first = whole.filter((F.col("lines") == F.col("n")) & (F.col("d") / F.col("longest") < limit)).groupBy("_s").agg(F.min("at").alias("at"))
    out = wanted.join(first, "_s", "left").join(near.groupBy("_s").agg(F.count("*").alias("measured")), "_s", "left")
    return out.select(*[F.col("_row")[f"c{i}"].alias(c) for i, c in enumerate(names)], "at", F.coalesce("measured", F.lit(0)).alias("measured"))


def align(hints: DataFrame, hunks: DataFrame, on: list[str], hint: str, start: str, end: str, number: str) -> DataFrame:
    """``hints`` with hunk and line: the first hunk that holds the hint, at the hint.

    Before the first hunk its start, after the last its end, and between them the start of
    the hunk with the nearest start (ties: the first). Hunks are in order of ``number``. Hints
    of files without hunks drop out. The hunk that holds a hint is found by a range join, the
    starts on either side by as-of joins, so a file with many of both isn't one group.
    """
    h = F.struct(F.col(number).alias("number"), F.col(start).alias("start"), F.col(end).alias("end"))
    asked = hints.filter(F.col(hint).isNotNull()).select(*on, hint).distinct()
    held = ranges.range_join(asked, hunks.select(*on, h.alias("_h"), start, end), on, hint, start, end)
    held = held.groupBy(*[F.col(f"point.{c}").alias(c) for c in (*on, hint)]).agg(F.min_by("range._h", "range._h.number").alias("_in"))
    starts = hunks.select(*on, F.col(start).alias("_start"), h.alias("_h"))
    near = ranges.asof(ranges.asof(asked, starts, on, hint, "_start", "_h", "_before"), starts, on, hint, "_start", "_h", "_after", strict=True, forward=True)
    ends = hunks.groupBy(*on).agg(F.min_by(h, F.col(number)).alias("_first"), F.max_by(h, F.col(number)).alias("_last"))
    met = near.join(ends, on).join(held, [*on, hint], "left")
    apart = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(hint) - F.col(f"{c}.start")).alias("d"), F.col(f"{c}.number").alias("number"), F.col(f"{c}.start").alias("start")))
    nearest = F.least(apart("_before"), apart("_after"))
    before, after = F.col(hint) < F.col("_first.start"), F.col(hint) > F.col("_last.end")
    hunk = F.when(F.col("_in").isNotNull(), F.col("_in.number")).when(before, F.col("_first.number")).when(after, F.col("_last.number")).otherwise(nearest["number"])
    line = F.when(F.col("_in").isNotNull(), F.col(hint)).when(before, F.col("_first.start")).when(after, F.col("_last.end")).otherwise(nearest["start"])
    placed = met.select(*on, hint, hunk.alias("hunk"), line.alias("line"))
    return hints.join(placed, [*on, hint]).select(*hints.columns, "hunk", "line")


def cascade(text_match: Column, hunk_align: Column, fuzzy: Column) -> Column:
    """located_by, by the first strategy that gave a line."""
    return F.when(text_match > 0, "text_match").when(hunk_align > 0, "hunk_align").when(fuzzy > 0, "fuzzy_match").otherwise("failed")


def verdict(checks: dict[str, Column]) -> tuple[Column, Column]:
    """(keep or drop, names of the failed checks in order)."""
    items = F.array(*[F.struct(F.lit(k).alias("name"), F.coalesce(v, F.lit(False)).alias("passed")) for k, v in checks.items()])
    failed = F.transform(F.filter(items, lambda c: ~c["passed"]), lambda c: c["name"])
    return F.when(F.size(failed) == 0, "keep").otherwise("drop"), F.array_join(failed, ", ")


def lines_in_range(claims: DataFrame, changed: DataFrame, on: list[str], start: str, end: str, line: str) -> DataFrame:
    """The claims whose range holds a changed line of their file: those whose last changed line up to the end isn't before the start."""
    last = ranges.asof(claims, changed.select(*on, F.col(line).alias("_line")), on, end, "_line", "_line", "_last_changed")
    return last.filter(F.col("_last_changed") >= F.col(start)).select(*claims.columns)
