"""Lines of a corpus: search with bounded results, and context around an anchor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import ere
from textloom.functions.patterns import any_glob

#: Matches returned, lines of context on either side, lines of context at most.
MATCHES, AROUND, CONTEXT = 50, 10, 200


def lines(files: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (from 1), content; a text's final empty line is no line."""
    split = F.split(text, "\n", -1)
    split = F.when(F.element_at(split, -1) == "", F.slice(split, 1, F.size(split) - 1)).otherwise(split)
    return files.select(key, F.posexplode(split).alias("_at", "content")).select(key, (F.col("_at") + 1).alias("line"), "content")


#: Why a search has no rows; the same for an expression that isn't one (fixed value).
NO_MATCHES = "no matches or invalid pattern"


def holds(text: Column, query: tuple) -> Column | None:
    """Whether a text holds what ``ere.held`` says that it must, where that is worth asking: literals of at least three characters."""
    if query[0] == "has":
        return text.contains(query[1]) if len(query[1]) > 2 else None
    if query[0] not in ("and", "or"):
        return None
    parts = [holds(text, x) for x in query[1:]]
    if query[0] == "or" and None in [p if p is None else 1 for p in parts]:
        return None
    out = None
    for p in parts:
        if p is not None:
            out = p if out is None else (out & p if query[0] == "and" else out | p)
    return out


def passes(where: Column, include=(), exclude=()) -> Column:
    """Whether a path passes globs."""
    ok = where.rlike(any_glob(include)) if include else F.lit(True)
    return ok & ~where.rlike(any_glob(exclude)) if exclude else ok


def is_text(text: Column) -> Column:
    """No NUL within the first 8000 characters."""
    return F.instr(F.substring(text, 1, 8000), "\0") == 0


def search(files: DataFrame, key: str, text: str, query: str, include=(), exclude=(), path: str | None = None) -> DataFrame:
    """Lines that match a POSIX extended expression, in files whose path passes; binary texts are skipped.

    An empty query matches nothing, and neither does an invalid expression (``ere.compile_ere``
    says why it is). Literals that a match must hold are looked for in the whole text first;
    a single one goes down to the scan.
    """
    found, _ = ere.compile_ere(query)
    if not query or found is None:
        return lines(files.filter(F.lit(False)), key, text)
    files = files.filter(is_text(F.col(text)))
    must = holds(F.col(text), ere.held(ere.parse(query)))
    if must is not None:
        files = files.filter(must)
    if include or exclude:
        files = files.filter(passes(F.col(path or key).cast("string"), include, exclude))
    return lines(files, key, text).filter(F.col("content").rlike(found))


def first_matches(found: DataFrame, key: str, most: int = MATCHES) -> DataFrame:
    """The first matches in order of file and line."""
    return found.orderBy(key, "line").limit(most)


def totals(found: DataFrame, most: int = MATCHES) -> DataFrame:
    return found.agg(F.count("*").alias("total_matches")).withColumn("truncated", F.col("total_matches") > most)


def outcome(files: DataFrame, key: str, text: str, query: str, include=(), exclude=(), path: str | None = None, most: int = MATCHES) -> DataFrame:
    """One row: query, total_matches, truncated, reason (why there is none; null if the query matched anywhere, in files that the paths leave out as well)."""
    out = lambda found, why: totals(found, most).select(F.lit(query).alias("query"), "total_matches", "truncated", why.alias("reason"))
    if not query:
        return out(search(files, key, text, query), F.lit("empty query"))
    own = files.select(F.col(path or key).cast("string").alias("_path"), F.col(text).alias("_text"))
    found = search(own, "_path", "_text", query).agg(F.count("*").alias("n"), F.count_if(passes(F.col("_path"), include, exclude)).alias("total_matches"))
    return found.select(F.lit(query).alias("query"), "total_matches", (F.col("total_matches") > most).alias("truncated"), F.when(F.col("n") == 0, NO_MATCHES).alias("reason"))


def outcomes(files: DataFrame, key: str, text: str, queries: list[str], include=(), exclude=(), path: str | None = None, most: int = MATCHES) -> DataFrame:
    """The rows of ``outcome`` of several expressions, in one pass over the files."""
    own = files.select(F.col(path or key).cast("string").alias("_path"), F.col(text).alias("_text")).filter(is_text(F.col("_text")))
    valid = {q: found for q in dict.fromkeys(queries) if q and (found := ere.compile_ere(q)[0]) is not None}
    content, ok = F.col("content"), passes(F.col("_path"), include, exclude)
    hits = {q: content.rlike(found) for q, found in valid.items()}
    counts = lines(own, "_path", "_text").agg(*[F.struct(F.count_if(h).alias("n"), F.count_if(h & ok).alias("total")).alias(f"q{i}") for i, h in enumerate(hits.values())] or [F.count("*")])
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("total"))
    at = {q: F.col(f"q{i}") for i, q in enumerate(hits)}
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(q).alias("query"), at.get(q, none).alias("c")) for q in queries])).alias("r")).select("r.query", "r.c")
    reason = F.when(F.col("query") == "", "empty query").when(F.col("c.n") == 0, NO_MATCHES)
    return rows.select("query", F.col("c.total").alias("total_matches"), (F.col("c.total") > most).alias("truncated"), reason.alias("reason"))


def context(files: DataFrame, text: str, start: Column, end: Column, most: int = CONTEXT) -> DataFrame:
    """Adds start_line, end_line, content, truncated, reason: the lines start..end, within the file and the cap."""
    split = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    n = F.size(split)
    low, high = F.greatest(start, F.lit(1)), F.least(end, n)
    kept = F.least(high, low + most - 1)
    missing = F.col(text).isNull() | (F.col(text) == "")
    bad = missing | (low > high)
    return (
        files.withColumn("start_line", F.when(bad, 0).otherwise(low)).withColumn("end_line", F.when(bad, 0).otherwise(kept))
        .withColumn("content", F.when(bad, "").otherwise(F.array_join(F.slice(split, low, kept - low + 1), "\n")))
        .withColumn("truncated", ~bad & (high > kept))
        .withColumn("reason", F.when(missing, "file not found").when(low > high, "range is outside the file"))
    )


def around(files: DataFrame, text: str, anchor: Column, before: int = AROUND, after: int = AROUND, most: int = CONTEXT) -> DataFrame:
    return context(files, text, anchor - before, anchor + after, most)
